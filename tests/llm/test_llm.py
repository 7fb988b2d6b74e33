"""The llm operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from polyloom.llm import embedding_dedup, fingerprints, langid, line_dedup, mixing, passages, pieces, simhash, substring_exact, toxicity
from polyloom.llm.common import connected_components
from polyloom.llm.registry import PIECES

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "pre") for b in ("na", "dor", "vi", "stel", "qua", "ment")]


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [say(rng, rng.randint(30, 200)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 3]) for i in range(12)]
    out += [(200 + i, base[5] + f" tail{i}") for i in range(30)]
    out += [(300 + i, base[6][:500] + "\n" + say(rng, 80) + "\n" + base[7][-450:]) for i in range(5)]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one two"), (405, "ab" * 1500), (406, "Élan über " * 90), (406, "same id, other text"), (407, base[8]), (407, base[8])]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.5) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long, th double").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def simhash_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [0, 16])
def test_simhash_matches_brute_force(spark, docs, corpus, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(docs).collect())
    fps = [(i, simhash_of(t)) for i, t in corpus]
    u = Union()
    distinct = {f for _, f in fps}
    least = {f: min(i for i, g in fps if g == f) for f in distinct}
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 2:
                u.join(least[a], least[b])
    assert got == sorted((i, f, u.find(least[f])) for i, f in fps)
    assert simhash.groups(empty(spark)).count() == 0


def test_a_text_alone_in_its_block(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "_BLOCK", 4)
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 3], [1, 1], [7, 5, 5, 4, 1, 1, 1]], pa.list_(pa.int64()))], names=["h"])
    (got,) = simhash.bit_majority(iter([batch]))
    assert got.column(0).to_pylist() == [1, 1, 5]


def test_simhash_links_at_one_and_two_bits(spark, monkeypatch):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:10]:
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(6)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for hot in (0, 16):
        monkeypatch.setattr(simhash, "HOT", hot)
        for bits in (1, 2):
            u, v = Union(), Union()
            for r in simhash.links(spark.createDataFrame(signed, "fp long"), bits).collect():
                assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits
                u.join(r.a, r.b)
            for (a,) in signed:
                for (b,) in signed:
                    if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                        v.join(a, b)
            assert {f: u.find(f) for (f,) in signed} == {f: v.find(f) for (f,) in signed}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fp long"), 3)


def test_simhash_writes_few_files(spark, monkeypatch):
    rng = random.Random(2)
    texts = [say(rng, 4) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:50])], "doc_id long, text string").repartition(16)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    files, stored = {}, simhash.stored

    def counted(df, name):
        out = stored(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
        assert simhash.groups(docs).count() == 3050
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert files.keys() == {"simhash", "simhash-keys", "simhash-members"} and max(files.values()) <= 4


@pytest.mark.parametrize("hot, chunk", [(20_000, 1 << 19), (0, 700)])
def test_repeated_bytes_match_brute_force(spark, docs, corpus, hot, chunk, monkeypatch):
    monkeypatch.setattr(substring_exact, "HOT_KINDS", hot)
    monkeypatch.setattr(substring_exact, "CHUNK", chunk)
    n = 400
    seen = Counter()
    for _, t in corpus:
        b = (t or "").encode()
        seen.update(b[k : k + n] for k in range(len(b) - n + 1))
    want = []
    for i, t in corpus:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                cover[k : k + n] = b"\1" * n
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = len(re.findall(b"\1+", bytes(cover)))
        want.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring_exact.remove_repeats(docs, n).collect()]
    assert sorted(got) == sorted(want)
    assert substring_exact.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [3, 1 << 20])
def test_induced_sorting(limit):
    from polyloom.llm.induced_sorting import suffix_array

    rng = random.Random(1)
    texts = [bytes(rng.randrange(rng.choice((1, 2, 3, 250))) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += [b"", b"a", b"aaaa", b"abababab", b"mississippi", ("Élan über " * 30).encode()]
    for t in texts:
        assert suffix_array(t, limit) == sorted(range(len(t)), key=lambda i: t[i:])


def test_rolling_and_sliding():
    rng = np.random.default_rng(0)
    b = rng.integers(0, 3, 900).astype(np.uint8)
    for length in (1, 7, 64, 400):
        h = substring_exact.rolling(b, length)
        same = defaultdict(set)
        for i, x in enumerate(h.tolist()):
            same[b[i : i + length].tobytes()].add(x)
        assert len(h) == len(b) - length + 1 and all(len(v) == 1 for v in same.values())
    x = rng.integers(0, 99, 100).astype(np.uint64)
    assert substring_exact.sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(94)]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("least", [16, 0])
def test_lines_match_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    lines = [say(rng, 6) for _ in range(25)] + ["short", "", "x" * 3000, "a\0b\0c and a \U0001f600 more", "long enough, aaaaaab"]
    rows = []
    for i in range(40):
        part = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(lines)
            if rng.random() < 0.4 and s:
                k = rng.randrange(len(s))
                s = rng.choice([s[:k] + s[k + 1 :], s[:k] + "é" + s[k:], s[:k] + rng.choice("zyxw日") + s[k + 1 :]])
            part.append(rng.choice(["", "  "]) + s)
        rows.append((i, "\n".join(part), "x", i))
    rows += [(90, None, "x", 0), (91, "", "x", 0), (92, rows[0][1], None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop string, l_ int").repartition(3)
    every = [(i, n, raw, raw.strip(" \t\r\x0b\x0c")) for i, t, *_ in rows if t is not None for n, raw in enumerate(t.split("\n"))]
    judged = sorted((i, n, s) for i, n, _, s in every if len(s) >= least)
    first = {}
    for i, n, s in judged:
        first.setdefault(s, (i, n))
    near = {a for a in first for b in first if a != b and first[b] < first[a] and one_edit(a, b)}
    gone = {(i, n) for i, n, s in judged if (i, n) > first[s] or s in near}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r["drop"], r.l_) for r in line_dedup.dedup_lines(docs, min_chars=least).collect()}
    for i, t, d, x in rows:
        kept = None if t is None else "\n".join(raw for n, raw in enumerate(t.split("\n")) if (i, n) not in gone)
        n = 0 if t is None else t.count("\n") + 1
        assert got[i] == (kept, n, sum(k[0] == i for k in gone), d, x)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_mix_targets_and_quota(spark):
    rng = random.Random(2)
    rows = [(i, say(rng, rng.randint(1, 60)), f"s{i % 4}" if i % 9 else None) for i in range(800)] + [(900, None, "s0"), (901, "", "s9"), (902, "a b c", "tiny"), (902, "a b c", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, bin_docs=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5), bin_docs=7).collect()))
    size = defaultdict(int)
    taken, target = defaultdict(int), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(size.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * size[s]}
        if not over:
            want |= {s: level * w[s] for s in free}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        free -= over
    assert target == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - target[s]) <= 61
    assert sum(r.copies for r in got if r["size"]) == mixing.take(docs).filter("trim(text) <> ''").count()
    assert mixing.mix(empty(spark)).count() == 0


def test_inclusion_follows_the_expected_copies(spark):
    rng = random.Random(14)
    rows = [(i, say(rng, 20 if i % 2 else 300), "a" if i < 3000 else "b") for i in range(4500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source, n in (("a", 3000), ("b", 1500)):
        some = [r for r in got if r.source == source]
        size, rate = some[0].source_size, some[0].target / some[0].source_size
        full = sum(r["size"] * (2000 * r["size"] // (r["size"] + 100)) for r in some) / size
        for words in (20, 300):
            kind = [r.copies for r in some if r["size"] == words]
            want = rate * (1 + min(0.5, (3 - rate) / (2 * rate)) * (2000 * words // (words + 100) - full) / 1000)
            assert sum(kind) / len(kind) == pytest.approx(want, abs=0.06), (source, words)
            assert set(kind) <= {int(want), int(want) + 1}
    # the lean is real
    short, long = ([r.copies for r in got if r.source == "a" and r["size"] == w] for w in (20, 300))
    assert sum(long) / len(long) > 1.2 * sum(short) / len(short)


def test_take_gives_repeated_rows_their_share(spark):
    rows = [(1, "a b c d", "s", k) for k in range(5)] + [(2, "e f", "s", 0), (3, None, "s", 0), (4, "g h i", None, 1), (1, "a b c d", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, th_ int").withColumn("each_", F.lit("x")).withColumn("row_", F.lit(1))
    m = mixing.mix(docs).collect()
    got = mixing.take(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.source, r.th_) for r in got.collect())
    for key in {(r.doc_id, r.source) for r in m}:
        total = sum(r.copies for r in m if (r.doc_id, r.source) == key and r["size"])
        each = [n for (i, s, _), n in kept.items() if (i, s) == key]
        assert sum(each) == total and (not each or max(each) - min(each) <= 1)
    assert mixing.take(docs.limit(0)).count() == 0


def test_pareto_tilt_raises_inclusion(spark):
    rows = [(i, "a b c d e", "s", 4.0 if i % 2 else 1.0) for i in range(2000)] + [(i, "a b c d e", "t", 1.0) for i in range(2000, 2500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), tilt="q").filter("source = 's'").collect()
    heavy, light = sum(r.copies for r in got if r.doc_id % 2), sum(r.copies for r in got if r.doc_id % 2 == 0)
    assert heavy > 2 * light


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(PIECES)


def test_pieces_equal_the_library(vocabulary, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    bits = ["a", "the ", " ", "  ", "\n", "é", "日", "\U0001f600", "ing", "\t", "<s>", "0", "12", "Ö", "\xa0", "x" * 37, "aa"]
    texts = [t for _, t in corpus if t] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(vocabulary.encode(t), "<i4")
        assert ids.tolist() == sp.encode(t)
        assert vocabulary.decode(ids) == t


def test_new_stretches_take_few_comparisons(monkeypatch):
    import sentencepiece

    class Counted(dict):
        looks = 0

        def get(self, key, default=None):
            Counted.looks += 1
            return super().get(key, default)

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["er", "an", "tion", "st", "nd", "ble", "he"]) for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() + rng.choice(["", "", ",", ".\nThe", "&&&"]) for _ in range(40)) for _ in range(100)]
    v = pieces.Vocabulary(PIECES)
    v._fits = Counted()
    monkeypatch.setattr(pieces, "_loaded", {(PIECES, "bpe"): v})
    (batch,) = pieces._encoder(PIECES, "bpe", 0)(iter([pa.RecordBatch.from_pydict({"text": texts})]))
    assert batch.to_pydict() == {"ids": [sp.encode(t) for t in texts], "exact": [True] * 100}
    assert Counted.looks < 22_000


def test_batches_and_groups_of_characters(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(7)
    bits = ["the", "The", "anti", " ", "  ", "\n", ".", ",,", "&&", "é", "日本", "12", "\U0001f600", "\u0301", "x" * 70, "'s", "-", "_", "Ж"]
    texts = ["", *["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(400)], ""]
    for ahead, chars, entries in ((1 << 15, 1 << 20, 300_000), (3, 1 << 20, 50), (1 << 15, 200, 20)):
        for name, value in (("AHEAD", ahead), ("AHEAD_CHARS", chars), ("CACHE_ENTRIES", entries)):
            monkeypatch.setattr(pieces, name, value)
        v = pieces.Vocabulary(PIECES)
        assert [np.frombuffer(r, "<i4").tolist() for r in v.encode_all(texts)] == [sp.encode(t) for t in texts]
    assert v._stretch.findall("▁the,▁▁a") == ["▁the", ",", "▁▁a"]
    v.byte_fallback = False
    assert v._pattern().findall("▁the,▁▁a") == ["▁the,", "▁▁a"]


def test_search_window_stays_bounded(vocabulary):
    runs = list(vocabulary.search(iter("abc" * 20_000)))
    assert "".join(p for r in runs for p in r) == "abc" * 20_000
    assert max(sum(map(len, r)) for r in runs) <= 200


def test_unigram_search_is_optimal(tmp_path, vocabulary):
    v = object.__new__(pieces.Vocabulary)
    v.kind, v.ids, v.score = "unigram", {"a": 0, "b": 1, "ab": 2, "bab": 3, "ba": 4}, [-1.0, -1.5, -1.9, -2.2, -2.0]
    v.max_len, v.starts = 3, {"a", "b", "ab", "ba", "bab"}
    rng = random.Random(0)
    for _ in range(50):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 150)))
        best = [0.0] + [-1e9] * len(t)
        for i in range(len(t)):
            for p, k in v.ids.items():
                if t.startswith(p, i):
                    best[i + len(p)] = max(best[i + len(p)], best[i] + v.score[k])
        got = [p for r in v.search(iter(t)) for p in r]
        assert "".join(got) == t and sum(v.score[v.ids[p]] for p in got) == pytest.approx(best[-1])


def test_encode_decode_frames(spark, docs, corpus):
    enc = pieces.encode(docs, PIECES)
    assert enc.filter("exact").count() == sum(t is not None for _, t in corpus)
    assert enc.filter("ids is null").count() == 1
    assert sorted(map(repr, (tuple(r) for r in pieces.decode(enc, PIECES).collect()))) == sorted(map(repr, corpus))
    assert pieces.encode(empty(spark), PIECES).count() == 0


def test_language(spark):
    rng = random.Random(8)
    abc = {"xx": "abcde ", "yy": "efghé ", "zz": "klmno "}
    rows = [(i, "".join(rng.choice(abc[k]) for _ in range(120)), k) for i in range(240) for k in (rng.choice(list(abc)),)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 3 <> 1"))
    odd = spark.createDataFrame([(1000, None, None), (1001, "", "xx"), (1002, "123 !!", "xx"), (1003, "abcde " * 200_000, "xx"), (1003, "klmno" * 30, "xx")], docs.schema)
    got = langid.predict(docs.union(odd), model).collect()
    named = {(r.doc_id, r.lang_pred) for r in got}
    right = [r for r in got if r.doc_id < 1000 and r.doc_id % 3 == 1]
    truth = {i: k for i, _, k in rows}
    assert sum(truth[r.doc_id] == r.lang_pred for r in right) >= 0.98 * len(right)
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (1003, "xx"), (1003, "zz")} <= named
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.predict(docs, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_long_text_scores_as_its_counts(monkeypatch):
    model = langid.LanguageModel(("a", "b"), np.zeros(2), np.random.default_rng(0).standard_normal((1 << 10, 2)).astype(np.float32), (1, 2, 3))
    text = "".join(random.Random(0).choice("abc dé") for _ in range(3000))
    whole = langid.text_counts(text, (1, 2, 3), 10) @ model.log_prob
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert langid.text_counts(text, (1, 2, 3), 10) @ model.log_prob == pytest.approx(whole)
    assert langid.batch_scores([text, "ab", text], model)[[0, 2]] == pytest.approx(np.stack([whole, whole]), rel=1e-4)


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["zorgblat", "vuxkrim", "hendwif"]
    rows, labels = [], []
    for i in range(900):
        w = say(rng, rng.randint(30, 120)).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (950, None), (951, ""), *[(952, f"{say(rng, 9)} Zorgblat {say(rng, 7)} hendwif {say(rng, 8)} vuxkrim {say(rng, 9)} zorgblat")] * 2], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (951, None), (77777, 1)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.train(docs, lab.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r.score)
    test = [i for i in range(900) if held(i)]
    assert sum((got[i][0] >= 0.5) == (i % 4 == 0) for i in test) >= 0.95 * len(test)
    assert got[950][0] < 0.5 and got[951][0] < 0.5 and len(got[952]) == 2 and min(got[952]) >= 0.5
    assert all(0 <= s <= 1 for v in got.values() for s in v)
    # long texts are read whole, in training too
    filler = say(rng, 30_000)
    long = docs.select("doc_id", F.when(F.col("doc_id") == 4, F.concat(F.lit(filler), F.lit(" zorgblat hendwif vuxkrim " * 40), F.lit(filler))).otherwise(F.col("text")).alias("text"), F.lit(1).alias("score"))
    scores = {r.doc_id: r.score for r in toxicity.score(long, model).filter("doc_id in (4, 5)").collect()}
    assert scores[4] >= 0.5 > scores[5]
    again = toxicity.train(long.repartition(5), lab, sample_chars=1 << 14)
    assert toxicity.score(docs, again).filter("doc_id < 900").select(F.sum(((F.col("score") >= 0.5) == (F.col("doc_id") % 4 == 0)).cast("int"))).first()[0] >= 855
    plain = toxicity.train(docs, lab.limit(0))
    assert toxicity.score(docs, plain).filter("score >= 0.5").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0


def test_passages(spark, docs, corpus):
    got = [r for r in passages.near_passages(docs).collect()]
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    seen = Counter()
    words = [(i, (t or "").lower().split()) for i, t in corpus]
    for _, w in words:
        seen.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    for i, w in words:
        hit = any(seen[tuple(w[k : k + 50])] > 1 for k in range(len(w) - 49))
        if len(by[i]) == 1:
            assert (by[i][0].n_passages > 0) == hit, i
    assert len({by[200 + k][0].component_id for k in range(30)} | {by[5][0].component_id}) == 1
    assert by[400][0].n_passages == 0 and by[400][0].component_id == 400
    assert passages.near_passages(empty(spark)).count() == 0


def test_near_passage_with_an_edit(spark):
    rng = random.Random(12)
    p = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    q = [*p[:60], "changed", *p[61:]]
    other = [f"v{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(["x1", "x2", *p])), (2, " ".join(["y1", *q, "y2"])), (3, " ".join(other))], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.near_passages(docs).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].n_passages == 0
    assert got[1].n_passage_words >= 100


def test_windows_and_surroundings():
    x = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    v, lo, c, hi = passages.compact_windows(x, 20, 0)
    h = passages._mix(x ^ np.uint64(0x94D049BB133111EB))
    for a, m, z in zip(lo, c, hi):
        assert h[a : z + 1].argmin() + a == m and z - a + 1 >= 20
        # it ends at a smaller hash, or where a stretch of 20 that holds m cannot reach
        assert (a == 0 or h[a - 1] < h[m] or m - a == 19) and (z == 299 or h[z + 1] < h[m] or z - m == 19)
    # several texts at once give what each gives by itself
    text = np.repeat([3, 4, 9], [100, 15, 185])
    together = [tuple(w) for w in zip(*passages.compact_windows(x, 20, 1, text))]
    apart = [(v, lo + s, c + s, hi + s) for s, e in ((0, 100), (100, 115), (115, 300)) for v, lo, c, hi in zip(*passages.compact_windows(x[s:e], 20, 1))]
    assert together == apart
    y = np.concatenate([x[:7], x[40:140], x[:9]])
    k = lambda z, at: tuple(int(q[0]) for q in passages.surroundings(z, np.zeros(len(z), np.int64), np.array([at]), 20))
    assert k(x, 80)[:3] == k(y, 47)[:3] and k(x, 80)[0] != k(x, 81)[0] and k(x, 80)[3] == 80 and k(x, 45)[0] != k(y, 12)[0]


def test_similarity_counts_facing_stretches():
    rng = np.random.default_rng(2)
    w, mid = 46, 45
    a = rng.integers(1, 1 << 16, 91).astype(np.uint16)
    full = np.array([mid])

    def spans(b, before=full, after=full):
        p, q = passages.similar(a[None], b[None], before, after, w, 0.8)
        return int(p[0]), int(q[0])

    assert spans(a) == (0, 45) and spans(a, np.array([10]), full) == (35, 45)
    assert spans(a, full, np.array([3])) == (0, 3)
    for k in (5, 14):
        b = a.copy()
        b[45 - k // 2 : 45 + k - k // 2] = 0
        p, q = spans(b)
        assert (p <= q) == (k == 5)
    # a word put in: what follows is one place off
    b = np.concatenate([a[:50], np.array([0] * 5, np.uint16), a[54:90]])
    assert spans(b) == (0, 45)
    b = np.concatenate([a[:50], np.array([0] * 6, np.uint16), a[54:89]])
    assert spans(b)[1] < 45
    # X Y against Y X
    assert spans(np.concatenate([a[46:], a[:46]]))[0] > spans(np.concatenate([a[46:], a[:46]]))[1]


def test_large_groups_find_what_all_pairs_find():
    rng = np.random.default_rng(6)
    w, n = 46, 120
    rows = []
    # one passage's edge: most share 30 places with the first and nothing else; some crowds share their own surroundings as well
    base = rng.integers(1, 1 << 16, 91).astype(np.uint16)
    own = [rng.integers(1, 1 << 16, 91).astype(np.uint16) for _ in range(8)]
    for k in range(n):
        z = rng.integers(1, 1 << 16, 91).astype(np.uint16) if k % 3 else own[rng.integers(8)].copy()
        r = rng.integers(20, 46)
        z[45 : 45 + r] = base[45 : 45 + r]
        for _ in range(rng.integers(0, 2)):
            c = rng.integers(0, 87)
            z[c : c + 4] = rng.integers(1, 1 << 16, 4)
        rows.append(z)
    x, place = np.array(rows), np.full(n, 1 << 40 | 45 << 16 | 45)
    g = passages._Groups(w, 0.8)
    comp, lo, hi = g.large(x, place)
    all_comp, all_lo, all_hi = g.small([n], x, place)
    assert comp.tolist() == all_comp.tolist() and len(set(comp.tolist())) > 20 and ((hi >= lo) == (all_hi >= all_lo)).all()


def test_crowds_are_compared_once_and_components_are_whole(monkeypatch):
    rng = np.random.default_rng(8)
    w, n = 46, 600
    base = rng.integers(1, 1 << 16, 91).astype(np.uint16)
    x = rng.integers(1, 1 << 16, (n, 91)).astype(np.uint16)
    for k in range(n):
        if k % 3:
            x[k] = base
            if k % 3 == 2:
                x[k, rng.integers(86) :][:5] = rng.integers(1, 1 << 16, 5)
        else:
            # outsiders, the first row among them: a part of the passage, and what two or three have in common
            x[k, 30:60] = base[30:60]
            x[k, 70:] = x[k - k % 9, 70:]
    x[1:] = x[1 + rng.permutation(n - 1)]
    place = np.full(n, 1 << 40 | 45 << 16 | 45)
    g = passages._Groups(w, 0.8)
    compared, compare = [], g._compare
    monkeypatch.setattr(g, "_compare", lambda x, place, i, j, lo, hi: (compared.append(len(i)), compare(x, place, i, j, lo, hi))[1])
    comp = g.large(x, place)[0]
    assert sum(compared) < 5 * n
    assert comp.tolist() == g.small([n], x, place)[0].tolist() and np.bincount(comp).max() == 400
    # a label that falls in the second round only
    links = {(0, 4), (2, 5), (4, 6), (5, 6)}
    monkeypatch.setattr(g, "_compare", lambda x, place, i, j, lo, hi: np.array([p in links for p in zip(i.tolist(), j.tolist())]))
    assert g.small([7], x[:7], place[:7])[0].tolist() == [0, 1, 0, 3, 0, 0, 0]


def passage_truth(texts, words=50, similarity=0.8):
    """Pairs of texts with facing stretches of that similarity (words put in or left out move the stretches by one word at most), by brute force."""
    width = words - 4
    sh = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (t.lower().split() for t in texts)]
    out = set()
    for a, x in enumerate(sh):
        for b in range(a + 1, len(sh)):
            y = sh[b]
            where = defaultdict(list)
            for j, s in enumerate(y):
                where[s].append(j)
            shifts = {j - i for i, s in enumerate(x) for j in where.get(s, ())}
            for d in shifts:
                for i in range(max(0, -d), min(len(x), len(y) - d) - width + 1):
                    p, q = set(x[i : i + width]), set(y[i + d : i + d + width])
                    if len(p & q) >= similarity * len(p | q):
                        out.add((a, b))
                        break
    return out


@pytest.mark.parametrize("bucket", [8192, 6])
def test_near_passages_recall(spark, bucket, monkeypatch):
    monkeypatch.setattr(passages, "BUCKET", bucket)
    rng = random.Random(41)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, family = [], []
    # isolated pairs at the limit: 50 words, one of them changed, unlike surroundings
    for f in range(120):
        p = [word() for _ in range(50)]
        q = list(p)
        q[rng.randrange(6, 44)] = word()
        for z in (p, q):
            texts.append(" ".join([word() for _ in range(rng.randint(5, 60))] + z + [word() for _ in range(rng.randint(5, 60))]))
            family.append(f)
    # crowds of near copies: each member's passage is edited by itself, so that many are similar to few others only
    for f in range(120, 126):
        p = [word() for _ in range(70)]
        for _ in range(25):
            q = list(p)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(70)
                q[k : k + 1] = rng.choice([[word()], [], [q[k] if k < len(q) else word(), word()]])
            texts.append(" ".join([word() for _ in range(20)] + q + [word() for _ in range(20)]))
            family.append(f)
    # a short phrase that many texts share is no passage
    phrase = [word() for _ in range(12)]
    for f in range(126, 166):
        texts.append(" ".join([word() for _ in range(60)] + phrase + [word() for _ in range(60)]))
        family.append(f)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in passages.near_passages(docs).collect()}
    true = passage_truth([t for t, f in zip(texts, family) if f < 120])
    assert len(true) == 120
    found = sum(got[a].component_id == got[b].component_id == a for a, b in true)
    assert found >= 0.9 * len(true)
    n = 240
    crowd = passage_truth(texts[n : n + 150])
    u = Union()
    for a, b in crowd:
        u.join(n + a, n + b)
    same = sum(got[n + a].component_id == got[n + b].component_id for a, b in crowd)
    assert same >= 0.97 * len(crowd)
    for i, f in enumerate(family):
        assert family[got[i].component_id] == f
        assert f < 126 or got[i].n_passages == 0


def test_near_passages_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(passages, "BUCKET", 6)
    rng = random.Random(57)
    word = lambda: f"w{rng.randrange(10**6)}"
    pairs = []
    # 50 words, one of them changed, put in, left out or doubled
    for f in range(300):
        p = [word() for _ in range(50)]
        if f % 5 == 4:
            k = rng.randrange(8, 40)
            p[k + 1 : k + 3] = [p[k]] * 2
        q = list(p)
        k = rng.randrange(6, 44)
        q[k : k + 1] = [[word()], [q[k], word()], [], [q[k], q[k]], [q[k], q[k]]][f % 5]
        pairs.append((p, q))
    # one sentence in all of them, so that its hashes have many classes and few are alike
    sentence = [word() for _ in range(12)]
    for f in range(300, 330):
        p = [word() for _ in range(20)] + sentence + [word() for _ in range(20)]
        q = list(p)
        q[25] = word()
        pairs.append((p, q))
    around = lambda z: " ".join([word() for _ in range(50)] + z + [word() for _ in range(50)])
    texts = [around(z) for pair in pairs for z in pair]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in passages.near_passages(docs).collect()}
    true = [(k, k + 1) for k in range(0, len(texts), 2) if passage_truth(texts[k : k + 2])]
    assert len(true) > 250
    assert [(a, b) for a, b in true if not got[a] == got[b] == a] == []


def tokens_of(t):
    """The rule by itself: character classes, then runs."""
    vowel = set(fingerprints._VOWELS)
    letter = {c for c in map(chr, range(256)) if c.isascii() and c.isalnum() or c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"}
    out, i = [], 0
    while i < len(t):
        if t[i] in " \t\n\v\f\r":
            i += 1
        elif t[i] not in letter:
            out.append(t[i])
            i += 1
        else:
            j = i
            while j < len(t) and t[j] in letter:
                j += 1
            if j - i <= 16:
                out.append(t[i:j])
                i = j
            while i < j:
                n = next((k for k in range(3) if i + k < j and t[i + k] in vowel), None)
                n = 1 if n is None else n + 1
                out.append(t[i : i + n])
                i += n
    return out


def sketch_of(t, k=3):
    """The fingerprint, computed by itself: closed syncmers over token hashes, least 64 with their first places."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in tokens_of(t)]

    def chain(part):
        x = 42
        for y in part:
            x = xxhash.xxh64_intdigest((y & (1 << 64) - 1).to_bytes(8, "little"), x)
        return x

    if len(h) < k:
        found = [(chain(h) >> 32, 0)] if h else []
    else:
        found = [(chain(h[i : i + k]) >> 32, i) for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]
    first = {}
    for x, i in found:
        first.setdefault(x, i)
    return "".join(f"{x:08x}{i:06x}" for x, i in sorted(first.items())[:64])


def likeness_of(a, b):
    x, y = ({f[i : i + 8]: int(f[i + 8 : i + 14], 16) for i in range(0, len(f), 14)} for f in (a, b))
    if not x and not y:
        return 1.0
    least = sorted(set(x) | set(y))[:64]
    off = [x[h] - y[h] for h in least if h in x and h in y]
    held = [o for i, o in enumerate(off) if len(off) == 1 or any(abs(o - p) <= 16 for j, p in enumerate(off) if j != i)]
    return len(held) / len(least)


def test_fingerprints_match_an_independent_computation(spark, docs, corpus):
    got = fingerprints.compare_edited(docs, ranges=5).collect()
    assert len(got) == len(corpus)
    unique = [(i, t or "") for i, t in corpus if i not in (406, 407)]
    ordered = sorted(corpus, key=lambda r: -r[0])
    nxt = {i: ordered[(k + 1) % len(ordered)] for k, (i, _) in enumerate(ordered)}
    by = {r.doc_id: r for r in got}
    for i, t in unique:
        assert by[i].fingerprint == sketch_of(t)
        if nxt[i][0] in (406, 407):
            continue
        half = len(t) // 2
        edited = t[: len(t) - half] + (nxt[i][1] or "")[:half]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[i].n_chars == len(t)
        assert by[i].edited_fingerprint == sketch_of(edited)
        assert by[i].near_edited == pytest.approx(likeness_of(sketch_of(t), sketch_of(edited)))
        assert by[i].near_next == pytest.approx(likeness_of(sketch_of(t), sketch_of(nxt[i][1] or "")))
    long = [by[i] for i, t in unique if len(t) > 400 and i < 40]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    one = fingerprints.compare_edited(docs.filter("doc_id = 3")).first()
    assert one.near_next == 1.0
    assert fingerprints.compare_edited(empty(spark)).count() == 0
    found = {r.doc_id: r.anchors for r in fingerprints.anchors(docs).filter("doc_id in (3, 400, 403)").collect()}
    assert len(found[403]) == 1 and found[400] == [] and len(found[3]) > 5


def test_next_document_with_crowded_and_missing_ids(spark):
    rows = [(1, f"text {k}") for k in range(60)] + [(None, f"none {k}") for k in range(40)] + [(i, f"t{i}") for i in range(2, 30)] + [(1, "text 5")] * 2
    d = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ("doc_id", "text"), 7)
    got = d.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
    assert sorted(map(str, (tuple(r.next) for r in got))) == sorted(map(str, rows))
    after = {(r.doc_id, r.text): tuple(r.next) for r in got}
    assert all(after[(i, f"t{i}")] == (i - 1, f"t{i - 1}") for i in range(3, 30)) and after[(2, "t2")][0] == 1
    # ids go down, once around
    assert sum((b[0] if b[0] is not None else -1) > (a[0] if a[0] is not None else -1) for a, b in after.items()) == 1
    text_ids = spark.createDataFrame([("b", "x y"), ("a", "z"), (None, None), ("7", "q")], "doc_id string, text string")
    assert fingerprints.compare_edited(text_ids).count() == 4


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    rows = []
    for i in range(700):
        c = centres[rng.integers(60)] if i % 2 else rng.standard_normal(24)
        rows.append((i, [float(v) for v in (c + 0.08 * rng.standard_normal(24)).astype(np.float32)], int(rng.integers(3))))
    rows += [(700 + i, rows[1][1], rows[1][2]) for i in range(40)]
    rows += [(800, None, 1), (801, [0.0] * 24, 1), (802, [float("nan")] * 24, 1), (803, rows[1][1], None), (804, [1.0, 2.0], 1), (805, [2.0, 4.0], 1), (806, [float("inf")] + [0.0] * 23, 1), (807, [], 1), (808, [None, 1.0], 1)]
    v = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "vec_id long, embedding array<float>, label int, id int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(v, leaf=32).collect()}
    ok = [(i, np.array(e, float) / np.linalg.norm(e), c) for i, e, c in rows if e and c is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    true, found = 0, 0
    u = Union()
    n = Counter()
    for a, x, c in ok:
        for b, y, d in ok:
            if a != b and c == d and len(x) == len(y) and x @ y >= 0.98:
                n[a] += 1
                u.join(a, b)
    for i, *_ in rows:
        assert got[i].n_links <= n[i] and got[i].kept == (got[i].component_id == i)
        true, found = true + n[i], found + got[i].n_links
    assert true > 1500 and found >= 0.97 * true
    assert got[804].n_links == 1 and got[805].component_id == 804 and got[803].n_links == 0 and got[801].component_id == 801
    assert embedding_dedup.near_duplicates(v.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0), (5, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.5, 0.5], 2), (None, [-1.0, 0.5], 2), (9, [0.5, 0.5], 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 1, 1, False), (1, 1, 1, True), (None, 1, 9, False), (None, 0, None, True), (9, 1, 9, True)])
    )


def test_forest_leaves_stay_small_whatever_the_sample(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = embedding_dedup.Forest.fit(x[:256], 8, 5, 5, 0.04, 1)
    row, tree, node = f.leaves(x)
    assert np.unique(row).size == len(x) and np.bincount(node[tree == 0]).max() <= 300
    near = x + 0.02 * rng.standard_normal(x.shape)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    row2, tree2, node2 = f.leaves(near)
    both = set(zip(row.tolist(), tree.tolist(), node.tolist())) & set(zip(row2.tolist(), tree2.tolist(), node2.tolist()))
    close = np.flatnonzero((x * near).sum(axis=1) >= 0.98)
    assert len(close) > 10_000 and np.isin(close, [r for r, _, _ in both]).mean() >= 0.9


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    rows = []
    for i in range(300):
        t = "\n".join(say(rng, 12) for _ in range(6))
        if i % 10 == 0:
            t += " zorgblat vuxkrim zorgblat hendwif"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(400, rows[1][1], "en", "s0", 1), (401, "shared boiler plate line here\n" + say(rng, 60), "en", None, 1), (402, "shared boiler plate line here\n" + say(rng, 60), "en", None, 1), (403, None, None, None, None), (404, "", "en", "s1", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    ids = []
    for _, stage in P.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert tuple(d.columns) == P.COLUMNS
        d.write.parquet(f"{sf}/out{len(ids)}")
        d = spark.read.parquet(f"{sf}/out{len(ids)}")
        ids.append({r.doc_id for r in d.collect()})
    clean = {i for i in range(300) if i % 10}
    assert not any(i < 300 and i % 10 == 0 for i in ids[0]) and clean | {400, 401, 402, 403, 404} == ids[0]
    assert ids[1] == ids[0] - {400}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/out1").collect()}
    assert text[401].startswith("shared") and not text[402].startswith("shared")
    assert ids[2] == ids[1] - {404}
    out = P.run(spark, sf)
    assert out.filter("not exact").count() == 0 and set(out.columns) == {"doc_id", "source", "ids", "n_ids", "exact"}
    assert {r.doc_id for r in out.collect()} == ids[3]


@pytest.mark.parametrize("hot, sample", [(0, 64), (4, 1), (16, 64)])
def test_near_copies_match_brute_force(spark, hot, sample, monkeypatch):
    import corpus_pipeline as P
    from polyloom.llm import near_copies

    monkeypatch.setattr(near_copies, "HOT", hot)
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rng = random.Random(21)
    mark = say(rng, 40).split()
    rows = []
    for i in range(25):
        w = say(rng, rng.randint(20, 200)).split()
        if i % 2:
            w = mark + w
        rows.append(w)
        for k in range(rng.randint(1, 8)):
            # edits of the first and edits of the last copy: chains whose ends are not similar
            c = list(rows[-1] if i % 3 else w)
            for _ in range(rng.randint(1, 1 + len(w) // 25)):
                c[rng.randrange(len(c))] = f"e{rng.randrange(10**6)}"
            rows.append(c)
    texts = [" ".join(w) for w in rows] + [None, "", "one", "One", "one two three four", "one two three five", rows[0][0].upper(), " ".join(rows[3]).upper()]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    u = Union()
    for a, x in enumerate(sets):
        u.find(a)
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                u.join(a, b)
    want = {u.find(a) for a in range(len(texts))}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(want) and len(want) < len(texts) - 25
    assert P.drop_near_copies(spark, empty(spark), "").count() == 0


def test_simhash_is_a_step_of_the_near_copies(spark, monkeypatch):
    import corpus_pipeline as P
    from polyloom.llm import near_copies

    rng = random.Random(33)
    texts = []
    for _ in range(12):
        w = say(rng, 400).split()
        texts += [" ".join(w), " ".join([*w, "tail"]), " ".join([*w[:200], "else", *w[201:]])]
    texts += [None, "", "one two"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    calls, verified = [], near_copies._verified

    def noted(pairs, base, texts, similarity, name):
        calls.append((name, {tuple(r) for r in pairs.collect()}))
        return verified(pairs, base, texts, similarity, name)

    monkeypatch.setattr(near_copies, "_verified", noted)
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == [*range(0, 36, 3), 36, 38]
    # fingerprints first, and what they connect is not compared again
    calls = dict(calls)
    assert calls["near-simhash-links"] and not {frozenset(p) for p in calls["near-simhash-links"]} & {frozenset(p) for p in calls["near-links"]}


def test_fingerprints_are_free_of_context(spark):
    rng = random.Random(31)
    texts = [say(rng, 170) for _ in range(8)]
    han = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1200)) for _ in range(4)]
    code = ["".join(rng.choice("bcdfghjklm0123456789aeXYZ+/=") for _ in range(1200)) for _ in range(4)]
    pairs = [(t[:n], t[: n + 1], 0.9) for t in texts + han + code for n in (400, 800) if len(t) > n]
    pairs += [("字" + t, t, 0.95) for t in han] + [("q" + t, t, 0.95) for t in texts + code] + [(t[:600] + "字" + t[600:], t, 0.8) for t in han + code]
    pairs += [(t[400:] + t[:400], t, 0.7) for t in texts + han] + [("x" * 400, "x" * 401, 1.0)]
    d = spark.createDataFrame(pairs, "a string, b string, least double")
    like = lambda d: d.select("*", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("x"))
    assert [(r.a[:20], len(r.a), r.x, r.least) for r in like(d).filter("x < least").collect()] == []
    # texts of unlike words, and unlike texts of the same few syllables
    far = spark.createDataFrame([(a, b) for a, b in zip(han, han[1:])] + [(a, b) for a, b in zip(code, code[1:])], "a string, b string")
    assert like(far).filter("x > 0.05").count() == 0
    # the next document is short, so the edited text shrinks from over 400 characters to fewer
    rows = [(2 * i + 1, t[:600]) for i, t in enumerate(texts) if len(t) >= 600] + [(2 * i, "ab cd") for i in range(len(texts))]
    got = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_chars = 600").collect()
    assert got and min(r.near_edited for r in got) >= 0.3
    # short texts have several anchors, very long ones a sketch of the same size
    few = fingerprints.anchors(spark.createDataFrame([(" ".join(t.split()[:12]),) for t in texts], "text string")).collect()
    assert min(len(r.anchors) for r in few) >= 6
    long = spark.createDataFrame([(say(rng, 60_000),)], "text string").select("text", fingerprints.fingerprint(F.col("text")).alias("f")).first()
    assert long.f == sketch_of(long.text)


@pytest.mark.parametrize("name", ["toxicity", "simhash", "pieces", "langid", "mix", "lines", "bytes", "passages", "fingerprints", "near_copies"])
def test_odd_rows_of_every_operator(spark, name):
    """Null ids and texts, empty and very long texts, repeated rows, columns whose names the operators use themselves."""
    from polyloom.llm import near_copies

    rng = random.Random(77)
    long = say(rng, 40_000)
    rows = [(None, "a text without an id " + say(rng, 60)), (None, None), (None, "a text without an id " + say(rng, 60)), (1, None), (2, ""), (3, long), (4, long), (5, "x" * 200_000), (6, say(rng, 80)), (6, say(rng, 80)), (7, "twice " * 3), (7, "twice " * 3), (8, "\t\n ")]
    odd = ["node", "key", "v", "th_", "copies", "row_", "label", "fp", "least", "component", "h1", "line", "size", "score", "next", "t_", "n", "u", "each_"]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(7).alias(c) for c in odd]).repartition(3)
    run = {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, spark.createDataFrame([(6, 1), (7, 0), (3, 0)], "doc_id long, toxic int"))),
        "simhash": simhash.groups,
        "pieces": lambda d: pieces.encode(d, PIECES),
        "langid": lambda d: langid.predict(d, langid.train(d)),
        "mix": mixing.mix,
        "lines": line_dedup.dedup_lines,
        "bytes": substring_exact.remove_repeats,
        "passages": passages.near_passages,
        "fingerprints": fingerprints.compare_edited,
        "near_copies": near_copies.one_of_each,
    }[name]
    got = run(docs).collect()
    if name == "near_copies":
        # one of the two long texts, of the two equal rows, and of the texts without a word; two texts without an id and two of id 6 differ
        assert len(got) == 8 and set(got[0].asDict()) == set(docs.columns)
    else:
        assert len(got) == len(rows)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by = {r.doc_id: r for r in got}
    if name == "passages":
        assert by[3].component_id == by[4].component_id == 3 and by[3].n_passage_words == 40_000
    if name == "bytes":
        assert by[3].n_removed == by[3].n_bytes == by[4].n_removed and by[5].n_removed == 200_000 and by[6].n_removed == 0
    if name == "lines":
        assert by[4].n_removed == 1 and by[3].n_removed == 0
    if name == "pieces":
        assert by[3].exact and by[5].exact
    if name == "simhash":
        assert by[3].component_id == by[4].component_id == 3 and by[1].component_id == by[2].component_id == 1
    assert run(docs.limit(0)).count() == 0
