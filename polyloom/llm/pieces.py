"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a boundary after each character and an edge for each vocabulary piece.  Only the boundaries of the last ``max_len``
characters can still be extended, so only they are kept, with backpointers; whenever the paths of all of them
pass through one boundary, the ids up to it are committed and forgotten.  Memory does not grow with the text.

What makes a path survive depends on the model.  Unigram models add piece scores.  For merge (BPE) models
the result of merging has no additive score, but it has a local test: a sequence of pieces is what
merging yields exactly if each neighbouring pair is (merging the pair's characters gives the pair again).
So each boundary keeps the one piece that fits the survivor at the piece's start.

White space, and a change between groups of characters that no piece joins (letters and commas, mostly), split a text into
stretches over which no piece reaches; there all paths meet, so the stretches'
ids are remembered (up to a bound) and a stretch seen before is not searched again.  New stretches of many
texts are searched together, in order: what survives at a boundary depends on nothing after it, so the boundaries of
the prefix that a stretch shares with the one before are taken over.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Entries of either half of the memory for stretches; with both full about 150 MB a Python worker.
CACHE_ENTRIES = 300_000
#: New stretches that are searched together, at most, and the characters of text they may wait for.
AHEAD, AHEAD_CHARS = 1 << 15, 1 << 20
#: Groups of characters that are told apart, at most.
GROUPS = 8


class Vocabulary:
    """Pieces of a model file, read with the sentencepiece library; the search itself is ours."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.kind = kind
        self.unknown = sp.unk_id()
        self.ids: dict[str, int] = {}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte_ids = [self.unknown] * 256
        self.out: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.out[i] = bytes([int(piece[1:-1], 16)])
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not (sp.is_control(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.out[i] = piece.replace(SPACE, " ").encode()
        self.byte_fallback = any(b != self.unknown for b in self.byte_ids)
        self.max_len = max(map(len, self.ids), default=1)
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self._stretch = self._pattern()
        self._fits: dict[tuple[str, str], bool] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        #: id of each piece, -1 for a string that only ends pieces
        self._ends = dict.fromkeys((p[k:] for p in self.ids for k in range(1, len(p))), -1) | self.ids

    def _pattern(self) -> re.Pattern[str]:
        """A stretch: spaces and what follows of one group.  Without byte pieces all is one group, since neighbouring unknown characters make one id."""
        group: dict[str, set[str]] = {}
        for p in self.ids if self.byte_fallback and self.apart else ():
            p = p.lstrip(SPACE)
            for a, b in zip(p, p[1:]):
                x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
                if x is not y:
                    x |= y
                    group |= dict.fromkeys(y, x)
        largest = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)[:GROUPS]
        sets = ["".join(map(re.escape, sorted(g))) for g in largest]
        return re.compile(f"{SPACE}*(?:{''.join(f'[{x}]+|' for x in sets)}[^{SPACE}{''.join(sets)}]+)|{SPACE}+")

    # -- merge models ----------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Pieces by plain merging (best score first, then leftmost).  Only for strings of two pieces' length."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * CACHE_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self.merged(left + right) == [left, right]
        return known

    # -- search ----------------------------------------------------------------------------------------------------

    def search(self, chars: Iterator[str]) -> Iterator[list[str]]:
        """Pieces of a stream of characters, in committed runs."""
        starts, ids, score, fits, top = self.starts, self.ids, self.score, self.fits, self.max_len
        merge = self.kind == "bpe"
        window = ""
        # boundary k lies after window[:k]; piece[k] ends there on the surviving path, from boundary back[k]
        piece: list[str | None] = [None]
        back = [0]
        total = [0.0]
        done = 0  # boundaries from which all edges have been followed
        first = ""  # the piece before boundary 0, committed
        ended = False
        while True:
            more = "" if ended else "".join(islice(chars, 64))
            ended = ended or not more
            window += more
            n = len(window)
            piece += [None] * (n + 1 - len(piece))
            back += [0] * (n + 1 - len(back))
            total += [0.0] * (n + 1 - len(total))
            # an edge may reach top characters ahead: follow those that lie wholly in the window
            while done < (n if ended else n - top):
                s = done
                done += 1
                before = piece[s] if s else first
                single = window[s]
                if merge:
                    for e in range(s + 1, min(n, s + top) + 1):
                        sub = window[s:e]
                        if sub not in starts:
                            break
                        if piece[e] is None and (sub in ids or e == s + 1) and (not before or fits(before, sub)):
                            piece[e], back[e] = sub, s
                    if single not in starts and piece[s + 1] is None:
                        piece[s + 1], back[s + 1] = single, s
                else:
                    for e in range(s + 1, min(n, s + top) + 1):
                        sub = window[s:e]
                        if sub not in starts:
                            break
                        k = ids.get(sub)
                        if k is not None and (piece[e] is None or total[s] + score[k] > total[e]):
                            piece[e], back[e], total[e] = sub, s, total[s] + score[k]
                    if piece[s + 1] is None or (single not in ids and total[s] - 1e4 > total[s + 1]):
                        piece[s + 1], back[s + 1], total[s + 1] = single, s, total[s] - 1e4
            if ended:
                cut = n
            else:
                # the live boundaries: those some edge still to be followed can start from
                live = {k for k in range(done, n + 1) if k == done or piece[k] is not None}
                while len(live) > 1:
                    k = max(live)
                    live.discard(k)
                    live.add(back[k])
                cut = live.pop()
            if cut:
                run = []
                k = cut
                while k:
                    run.append(piece[k])
                    k = back[k]
                run.reverse()
                yield run
                first = run[-1]
                window = window[cut:]
                piece = [None, *piece[cut + 1 :]]
                back = [0, *[max(0, b - cut) for b in back[cut + 1 :]]]
                base = total[cut]
                total = [t - base for t in total[cut:]]
                done -= cut
            if ended:
                return

    def _shorts(self, texts: list[str]) -> Iterator[list[str]]:
        """``search`` of a merge model for texts of up to 64 characters; sorted ones share the boundaries of their common prefixes.

        Each boundary looks back for the piece that ends there and fits the survivor at its start, shortest first (exactly one does).
        """
        ends, known, fits = self._ends.get, self._fits.get, self.fits
        piece = [""] * 65
        back = [0] * 65
        last = ""
        for text in texts:
            n = len(text)
            shared, most = 0, min(n, len(last))
            while shared < most and text[shared] == last[shared]:
                shared += 1
            last = text
            for e in range(shared + 1, n + 1):
                s = e - 1
                sub = text[s]
                if ends(sub) is not None:
                    while s:
                        good = known((piece[s], sub))
                        if good is None:
                            good = fits(piece[s], sub)
                        if good:
                            break
                        s -= 1
                        sub = text[s:e]
                        while ends(sub) < 0:
                            s -= 1
                            sub = text[s:e]
                piece[e], back[e] = sub, s
            run = []
            while n:
                run.append(piece[n])
                n = back[n]
            run.reverse()
            yield run

    def _ids_of(self, run: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in run]
        except KeyError:
            pass
        out: list[int] = []
        for p in run:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def stretch(self, text: str) -> bytes:
        """Ids (int32, little endian) of a stretch."""
        if len(text) <= 64 and self.kind == "bpe":
            ids = self._ids_of(next(self._shorts([text])))
            return struct.pack(f"<{len(ids)}i", *ids)
        return b"".join(np.array(self._ids_of(run), "<i4").tobytes() for run in self.search(iter(text)))

    def _learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids of new stretches of up to 64 characters; they are remembered."""
        if self.kind == "bpe":
            new = sorted(stretches)
            found = {s: struct.pack(f"<{len(ids)}i", *ids) for s, ids in zip(new, map(self._ids_of, self._shorts(new)))}
        else:
            found = {s: self.stretch(s) for s in stretches}
        if len(self._new) + len(found) > CACHE_ENTRIES:
            self._old, self._new = self._new, {}
        self._new |= found
        return found

    def _fill(self, holes: list[tuple[list, int, str]]) -> None:
        """Put the ids of the new stretches where they are wanted."""
        found = self._learn({s for _, _, s in holes})
        for row, i, s in holes:
            row[i] = found[s]
        holes.clear()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids (int32, little endian) of texts; one space is put before each, as the model expects."""
        out: list[bytes] = []
        rows: list[list] = []
        holes: list[tuple[list, int, str]] = []
        chars = 0
        for text in texts:
            rows.append(row := [])
            if not text:
                continue
            chars += len(text)
            text = SPACE + text.replace(" ", SPACE)
            if not self.apart:
                row.append(self.stretch(text))
                continue
            new, old = self._new, self._old
            for s in self._stretch.findall(text) if len(text) < 1 << 20 else (m.group() for m in self._stretch.finditer(text)):
                ids = new.get(s)
                if ids is None:
                    ids = old.get(s)
                    if ids is not None:
                        if len(new) >= CACHE_ENTRIES:
                            self._old, self._new = old, new = new, {}
                        new[s] = ids
                    elif len(s) > 64:
                        ids = self.stretch(s)
                    else:
                        holes.append((row, len(row), s))
                row.append(ids)
                if len(holes) == AHEAD:
                    self._fill(holes)
                    new, old = self._new, self._old
            if chars >= AHEAD_CHARS:
                self._fill(holes)
                out += map(b"".join, rows)
                rows, chars = [], 0
        self._fill(holes)
        return [*out, *map(b"".join, rows)]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD.  The space put before it is taken away again."""
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, kind: str = "bpe") -> Vocabulary:
    """The model, read once a Python process."""
    key = (path, kind)
    if key not in _loaded:
        _loaded[key] = Vocabulary(path, kind)
    return _loaded[key]


def _encoder(path: str, kind: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, kind)
        for batch in batches:
            texts = batch.column(n)
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                raw = [None if t is None else r for t, r in zip(part, v.encode_all([t or "" for t in part]))]
                same = [None if t is None else v.decode(np.frombuffer(r, "<i4")) == t for t, r in zip(part, raw)]
                offsets = np.cumsum([0, *[0 if r is None else len(r) // 4 for r in raw]]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(r for r in raw if r), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([r is None for r in raw]))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, 256) for c in batch.columns[:n]], lists, pa.array(same, pa.bool_())], names=[*batch.schema.names[:n], "ids", "exact"])

    return run


def encode(docs: DataFrame, path: str, kind: str = "bpe", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols``, ``ids`` (array<int>) and ``exact``: whether decoding gives the text again.

    Null texts have null ids; an empty text has no ids and is exact.  A text with the model's own space sign (U+2581) decodes to
    spaces and is not exact.  Rows may repeat; other columns are ignored.  ``path`` must be readable on the executors.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return docs.select(*id_cols, "text").mapInArrow(_encoder(path, kind, len(id_cols)), f"{kinds}, ids array<int>, exact boolean")


def _decoder(path: str, kind: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, kind)
        for batch in batches:
            texts = [None if ids is None else v.decode(np.array(ids, np.int64)) for ids in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "text"])

    return run


def decode(tokens: DataFrame, path: str, kind: str = "bpe", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` and ``text`` of column ``ids``; null ids give a null text."""
    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in id_cols)
    return tokens.select(*id_cols, "ids").mapInArrow(_decoder(path, kind, len(id_cols)), f"{kinds}, text string")
