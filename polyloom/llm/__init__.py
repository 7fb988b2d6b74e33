"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()`` are
what ``__spark_entry__`` adds when the folder is there.
"""

from __future__ import annotations

from polyloom.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
