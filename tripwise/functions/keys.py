"""Deterministic pseudo-random keys: a function of the row key, not of the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(key: Column | str | list[str], seed: int | str) -> Column:
    """32 hex digits that order rows randomly but repeatably; a null hashes as an empty text."""
    columns = [F.col(k) if isinstance(k, str) else k for k in (key if isinstance(key, list) else [key])]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.md5(F.concat(text, F.lit(f":{seed}")))


def draw(key: Column | str, purpose: str, n: int) -> Column:
    """A repeatable integer in ``[0, n)`` per key and purpose."""
    digits = F.substring(shuffle_key(key, purpose), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % n


def pick(words: list[str], index: Column) -> Column:
    """The word at a zero-based index."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))
