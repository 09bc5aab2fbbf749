"""Line dedup by overlapping windows of three lines.

The hashes of every three consecutive lines are counted over all documents; every
occurrence after the first (in the order of document id, text and position) is removed,
covered lines of overlapping windows counting once.

Defined cases: a null text has no lines; a text of fewer than three lines has no window and
stays whole; null ids come first; rows that are equal in id and text are judged alike, as
the first of them; extra columns travel in one struct.

Both joins shuffle at every size: what repeats grows with the data, so it is never
broadcast, and a small table runs the plan that a large one runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.words import slices
from tripwise.sources.shared import written

WINDOW_LINES = 3


def line_windows(docs: DataFrame, key: str, text: str, n: int = WINDOW_LINES) -> DataFrame:
    """``doc, own, pos, h1, h2``: 128 bits for every ``n`` consecutive lines; ``own`` marks the text."""
    lines = docs.select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("own"), F.split(text, "\n").alias("lines")
    ).filter(F.size("lines") >= n)

    def hashed(i):
        window = [F.get("lines", i + k) for k in range(n)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*window).alias("h1"),
            F.xxhash64(F.lit(n), *reversed(window)).alias("h2"),
        )

    places = F.sequence(F.lit(0), F.size("lines") - n)
    return lines.select("doc", "own", F.explode(F.transform(places, hashed)).alias("w")).select(
        "doc", "own", "w.*"
    )


def repeated_positions(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW_LINES
) -> DataFrame:
    """``doc, own, positions`` of the windows that occurred before."""
    windows = written(line_windows(docs, key, text, n), "line_windows")
    place = F.struct("doc", "own", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = written(first.filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"), "first_windows")
    later = windows.join(first.hint("shuffle_hash"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc", "own").agg(F.collect_set("pos").alias("positions"))


def without_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WINDOW_LINES
) -> DataFrame:
    """``row`` (the document), ``n_lines, n_removed, kept`` (the text that stays) and ``kept_sha256``."""
    found = written(repeated_positions(docs, key, text, n), "repeated_lines")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"))
    joined = rows.join(
        found.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("own")), "left"
    ).select("row", F.col("row").getField(text).alias("text"), "positions")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("row", "n_lines", "n_removed", "kept", "kept_sha256")
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                out = []
                for value, positions in zip(part["text"].to_pylist(), part["positions"].to_pylist()):
                    lines = [] if value is None else value.split("\n")
                    keep = np.ones(len(lines), bool)
                    for k in range(n) if positions else ():
                        keep[np.array(positions) + k] = False
                    kept = value if keep.all() else "\n".join(x for x, k in zip(lines, keep) if k)
                    digest = hashlib.sha256((kept or "").encode()).hexdigest()
                    out.append((len(lines), len(lines) - int(keep.sum()), kept, digest))
                columns = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([part["row"], *arrays], names)

    schema = joined.select("row").schema
    for name, kind in (("n_lines", "long"), ("n_removed", "long"), ("kept", "string"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(cut, schema)
