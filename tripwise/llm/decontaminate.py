"""Benchmark decontamination: a broadcast set of benchmark n-grams against every training token window.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII bytes. A window is ``n``
consecutive words of a benchmark item; a shorter item that has words is one window. A
training word inside any occurrence of a window is hit.

Defined cases: a null text has no words; a null item id hits words but is not listed; an
item without words has no window; repeated rows are judged each on its own; columns of the
documents travel untouched in one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tripwise.llm.tables import text_bytes
from tripwise.llm.words import Words, letter_words, slices, words_of
from tripwise.sources.shared import written

WINDOW = 13
# Benchmark text that one broadcast set may hold: with its hashes and windows some 16 times as much
# in memory. A larger benchmark is scanned slice by slice.
SET_BYTES = 1 << 20

SPAN = StructType([StructField("first", LongType()), StructField("last", LongType())])
SPAN_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


class NgramSet:
    """Sorted hashes of the windows of one length, and the item and text of each."""

    def __init__(self, n: int, hashes: np.ndarray, items: np.ndarray, texts: list[bytes]):
        order = np.argsort(hashes, kind="stable")
        self.n, self.hashes, self.items = n, hashes[order], items[order]
        self.texts = [texts[i] for i in order]

    def hits(self, words: Words) -> Iterator[tuple[int, int]]:
        """``(word, item)`` of every verified window occurrence."""
        hashes = words.run_hashes(self.n)
        starts = words.starts_of(self.n)
        hashes = hashes[starts]
        low = np.searchsorted(self.hashes, hashes, "left")
        found = low < len(self.hashes)
        found[found] = self.hashes[low[found]] == hashes[found]
        for k in np.flatnonzero(found):
            text = words.text_of(starts[k], self.n)
            at = low[k]
            while at < len(self.hashes) and self.hashes[at] == hashes[k]:
                if self.texts[at] == text:
                    yield starts[k], self.items[at]
                at += 1


def ngram_sets(texts: pa.Array, n: int) -> list[NgramSet]:
    """One set for each window length; items are numbered by their row."""
    words = words_of(texts, letter_words(), fold=True)
    counts = np.diff(words.bounds)
    sets = []
    for length in np.unique(np.minimum(counts[counts > 0], n)):
        length = int(length)
        hashes, starts = words.run_hashes(length), words.starts_of(length)
        items = words.row_of(starts)
        used = counts[items] >= n if length == n else counts[items] == length
        starts, items = starts[used], items[used]
        sets.append(
            NgramSet(length, hashes[starts], items, [words.text_of(s, length) for s in starts])
        )
    return sets


def _scan(rows: DataFrame, items: pa.Table, n: int) -> DataFrame:
    """Add what one slice of the benchmark hits to ``n_words, spans, items``."""
    ids = items["item"].to_pylist()
    sets = ngram_sets(items["text"].combine_chunks(), n)
    shared = rows.sparkSession.sparkContext.broadcast((ids, sets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets = shared.value
        names = ("row", "text", "n_words", "spans", "items")
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                words = words_of(part["text"], letter_words(), fold=True)
                hit = np.zeros(len(words.hashes) + 1, np.int64)
                found: dict[int, set[str]] = {}
                for ngrams in sets:
                    for word, item in ngrams.hits(words):
                        hit[word] += 1
                        hit[word + ngrams.n] -= 1
                        own = found.setdefault(int(words.row_of(word)), set())
                        if ids[item] is not None:
                            own.add(ids[item])
                spans = part["spans"].to_pylist()
                items = part["items"].to_pylist()
                covered = np.cumsum(hit[:-1]) > 0
                for row, own in found.items():
                    first, last = words.bounds[row], words.bounds[row + 1]
                    here = covered[first:last].copy()
                    for span in spans[row]:
                        here[span["first"] : span["last"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
                    spans[row] = [
                        {"first": int(a), "last": int(b)} for a, b in zip(edges[::2], edges[1::2])
                    ]
                    items[row] = sorted(own.union(items[row]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["row"],
                        part["text"],
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(spans, SPAN_ARROW),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names,
                )

    return rows.mapInArrow(scan, rows.schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``row`` (the document), ``text, n_words, spans`` (runs of hit words) and ``items`` (sorted ids).

    The broadcast set is bounded by ``set_bytes`` of benchmark text (or one longer item);
    a larger benchmark is cut by hash of the item into slices, scanned one after the other.
    """
    empty_spans = F.array().cast(ArrayType(SPAN))
    empty_items = F.array().cast(ArrayType(StringType()))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(text).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        empty_spans.alias("spans"),
        empty_items.alias("items"),
    )
    tests = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")
    )
    parts = max(1, -(-text_bytes(tests) // set_bytes))
    for k in range(parts):
        own = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        rows = _scan(rows if k == 0 else written(rows, "decontaminated"), own.toArrow(), n)
    return rows


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(
        spans, F.lit(0).cast("bigint"), lambda sum_, s: sum_ + s["last"] - s["first"]
    )


def is_contaminated(n_words: str = "n_words", spans: str = "spans") -> Column:
    """At least one word in twenty is hit."""
    return (n_hit(spans) > 0) & (n_hit(spans) * 20 >= F.col(n_words))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return contamination(docs, benchmark, **options).filter(~is_contaminated()).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with the hit words cut out of ``text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                words = words_of(part["text"], letter_words(), fold=True)
                texts, base = [], 0
                for row, (text, spans) in enumerate(zip(part["text"].to_pylist(), part["spans"].to_pylist())):
                    raw, at, kept = (text or "").encode(), 0, []
                    first = words.bounds[row]
                    for span in spans:
                        kept.append(raw[at : words.starts[first + span["first"]] - base])
                        at = words.ends[first + span["last"] - 1] - base
                    texts.append(b"".join([*kept, raw[at:]]).decode() if spans else text)
                    base += len(raw)
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(texts, pa.string())], ["row", "text"])

    marked = contamination(docs, benchmark, text=text, **options).select("row", "text", "spans")
    cleaned = marked.mapInArrow(cut, marked.select("row", "text").schema)
    return cleaned.select(F.col("row").withField(text, F.col("text")).alias("row")).select("row.*")
