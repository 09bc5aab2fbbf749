"""Substring dedup by repeated-phrase automata.

A word is removed when a window of ``WINDOW`` consecutive words that covers it starts
anywhere else as well. Every window has an anchor, the smallest hash among its runs of
``ANCHOR`` words, and equal windows have equal anchors. So

1. blocks of texts name their anchors, and anchors that occur twice are found in hash shards;
2. the windows at such anchors are hashed and counted in the same way, which confirms the
   recurring passages (runs of recurring windows);
3. the passages of each block of texts are compiled into an automaton, one shard of the
   whole set, and its texts are streamed through it to locate every occurrence.

Texts without a recurring anchor hold no passage and need no automaton. A block hands a hash
on once, however often it occurs, so no shard grows with a frequent passage.

Defined cases: a null text has no words; a text shorter than a window stays whole; rows that
are equal in text are copies of each other, also when ids repeat or are null; extra columns
travel in one struct.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.llm.tables import parts_for, text_bytes
from tripwise.llm.words import Words, packed, slices, space_words, words_of
from tripwise.sources.shared import written

WINDOW = 35
ANCHOR = 8
BLOCK_BYTES = 4 << 20


def window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (their first words), the first smallest anchor of each, and all anchor hashes."""
    starts = words.starts_of(window)
    grams = words.run_hashes(anchor)
    if not len(starts):
        return starts, starts, grams
    at = np.arange(len(grams))
    width, best = 1, at
    reach = window - anchor + 1

    def smaller(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(grams[left] <= grams[right], left, right)

    while 2 * width <= reach:
        n = len(best) - width
        best = smaller(best[:n], best[width : width + n])
        width *= 2
    return starts, smaller(best[starts], best[starts + reach - width]), grams


def _sharded(block: str, hashes: np.ndarray, twice: np.ndarray, shards: int) -> list[tuple]:
    """Rows ``block, shard, hashes, twice`` of sorted distinct hashes."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    return [
        (block, int(s), packed(hashes[cuts[s] : cuts[s + 1]]), packed(twice[cuts[s] : cuts[s + 1]]))
        for s in np.flatnonzero(np.diff(cuts))
    ]


def _recurring(shard: pa.Table) -> pa.Table:
    """For each block the hashes of one shard that occur twice: in the block or in two blocks."""
    hashes = [np.frombuffer(h.as_py(), np.uint64) for h in shard["hashes"]]
    twice = [np.frombuffer(t.as_py(), bool) for t in shard["twice"]]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.bincount(at, 1 + np.concatenate(twice)) > 1
    cuts = np.cumsum([0, *map(len, hashes)])
    found = [packed(h[n[at[a:b]]]) for h, a, b in zip(hashes, cuts, cuts[1:])]
    out = pa.table({"block": shard["block"], "found": pa.array(found, pa.binary())})
    return out.filter(pa.array([len(f) > 0 for f in found]))


def recurring_hashes(sharded: DataFrame, shards: int) -> DataFrame:
    """``block, found``: packed recurring hashes of each block, from all shards."""
    rows = sharded.repartition(shards, "shard").groupBy("shard")
    return rows.applyInArrow(_recurring, "block string, found binary")


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them occur twice."""
    values, counts = np.unique(hashes, return_counts=True)
    return values, counts > 1


def _scan(rows: DataFrame, window: int, anchor: int, shards: int) -> DataFrame:
    """``kind`` 0: a block's anchors by shard; 1: the texts of a block and the anchors of each."""
    schema = (
        "kind int, block string, shard bigint, hashes binary, twice binary, "
        "keys array<binary>, ids array<bigint>, anchors array<binary>"
    )
    arrow = pa.schema(
        [
            ("kind", pa.int32()),
            ("block", pa.string()),
            ("shard", pa.int64()),
            ("hashes", pa.binary()),
            ("twice", pa.binary()),
            ("keys", pa.list_(pa.binary())),
            ("ids", pa.list_(pa.int64())),
            ("anchors", pa.list_(pa.binary())),
        ]
    )

    def flush(held: list[tuple]) -> pa.RecordBatch:
        block = uuid.uuid4().hex
        everything = np.concatenate([a for *_, a in held])
        rows = [(0, *r, None, None, None) for r in _sharded(block, *_distinct(everything), shards)]
        with_any = [(k, i, packed(np.unique(a))) for k, i, a in held if len(a)]
        keys, ids, anchors = map(list, zip(*with_any)) if with_any else ([], [], [])
        rows.append((1, block, None, None, None, keys, ids, anchors))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_bytes = [], 0
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                words = words_of(part["text"], space_words())
                starts, best, grams = window_anchors(words, window, anchor)
                # Windows of a text that share an anchor name it once.
                new = np.ones(len(best), bool)
                new[1:] = best[1:] != best[:-1]
                best = best[new]
                cuts = np.searchsorted(best, words.bounds)
                for k, (key, id_) in enumerate(zip(part["key"].to_pylist(), part["id"].to_pylist())):
                    held.append((key, id_, grams[best[cuts[k] : cuts[k + 1]]]))
                n_bytes += len(words.data)
                if n_bytes >= BLOCK_BYTES:
                    yield flush(held)
                    held, n_bytes = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(scan, schema)


def _affected(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block that hold recurring anchors, and these anchors."""
    out: list[tuple] = []
    if left.num_rows and right.num_rows:
        found = np.sort(np.concatenate([np.frombuffer(f.as_py(), np.uint64) for f in right["found"]]))
        for keys, ids, anchors in zip(left["keys"], left["ids"], left["anchors"]):
            for key, id_, own in zip(keys.as_py(), ids.as_py(), anchors.as_py()):
                own = np.frombuffer(own, np.uint64)
                at = np.minimum(np.searchsorted(found, own), len(found) - 1)
                held = own[found[at] == own]
                if len(held):
                    out.append((key, id_, packed(held)))
    columns = zip(*out) if out else ((), (), ())
    kinds = (pa.binary(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "id", "anchors"])


def _candidate_blocks(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Blocks of affected texts: ``block, keys, texts, copied`` and the hashes of their candidate windows."""
    schema = "block string, keys array<binary>, texts array<string>, hashes binary, twice binary"

    def flush(keys: list, texts: list, held: list, again: list) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        twice = (counts > 1) | np.isin(values, np.concatenate(again))
        row = (uuid.uuid4().hex, keys, texts, packed(values), packed(twice))
        kinds = (pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds)], ["block", "keys", "texts", "hashes", "twice"]
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held, again, n_bytes = [], [], [], [], 0
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                words = words_of(part["text"], space_words())
                starts, best, grams = window_anchors(words, window, anchor)
                hashes = words.run_hashes(window)
                cuts = np.searchsorted(starts, words.bounds)
                columns = (part[c].to_pylist() for c in ("key", "text", "anchors", "copies"))
                for k, (key, text, anchors, copies) in enumerate(zip(*columns)):
                    own = slice(cuts[k], cuts[k + 1])
                    used = np.isin(grams[best[own]], np.frombuffer(anchors, np.uint64))
                    found = hashes[starts[own][used]]
                    keys.append(key)
                    texts.append(text)
                    held.append(found)
                    again.append(found if copies > 1 else found[:0])
                n_bytes += len(words.data)
                if n_bytes >= BLOCK_BYTES:
                    yield flush(keys, texts, held, again)
                    keys, texts, held, again, n_bytes = [], [], [], [], 0
        if keys:
            yield flush(keys, texts, held, again)

    return texts.mapInArrow(scan, schema)


def passages(words: list[int], starts: np.ndarray, window: int) -> Iterator[tuple[int, ...]]:
    """Maximal runs of recurring windows as word sequences."""
    if len(starts):
        breaks = np.flatnonzero(np.diff(starts) > 1)
        for a, b in zip([0, *(breaks + 1)], [*breaks, len(starts) - 1]):
            yield tuple(words[starts[a] : starts[b] + window])


def _located(texts: list[str], found: np.ndarray, window: int) -> Iterator[tuple[int, int, str]]:
    """``(words, removed, kept text)`` of each text, by an automaton of the passages of all of them."""
    cut = [text.encode().split() for text in texts]
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in words] for words in cut]
    column = pa.array(texts, pa.string())
    words = words_of(column, space_words())
    starts = words.starts_of(window)
    starts = starts[np.isin(words.run_hashes(window)[starts], found)]
    cuts = np.searchsorted(starts, words.bounds)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for k, code in enumerate(coded):
        for passage in passages(code, starts[cuts[k] : cuts[k + 1]] - words.bounds[k], window):
            automaton.add_word(passage)
    automaton.make_automaton()
    for own, code in zip(cut, coded):
        edges = np.zeros(len(own) + 1, np.int64)
        if len(automaton):
            for last, length in automaton.iter(tuple(code)):
                edges[last + 1 - length] += 1
                edges[last + 1] -= 1
        kept = [w for w, n in zip(own, np.cumsum(edges)) if not n]
        yield len(own), len(own) - len(kept), b" ".join(kept).decode()


def _cleaned(window: int):
    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            found = np.sort(np.concatenate([np.frombuffer(f.as_py(), np.uint64) for f in right["found"]]))
            keys = [k for block in left["keys"].to_pylist() for k in block]
            texts = pa.chunked_array(left["texts"]).combine_chunks().flatten()
            for low, high in slices(texts):
                some = texts.slice(low, high - low).to_pylist()
                for key, (n, removed, kept) in zip(keys[low:high], _located(some, found, window)):
                    if removed:
                        out.append((key, removed, kept))
        columns = zip(*out) if out else ((), (), ())
        kinds = (pa.binary(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "n_removed", "kept"])

    return clean


def text_key(text: str):
    """SHA-256 of a text; the key under which equal texts are one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def repeated_passages(
    docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id"
) -> DataFrame:
    """``key, n_removed, kept``: the distinct texts that lose words, and what stays of them.

    ``key`` of the documents only helps to fetch one text of each kind; it may repeat or be null.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(
        text_key(text).alias("key"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")
    )
    shards = parts_for(text_bytes(rows, "text"))
    scanned = written(_scan(rows, window, anchor, shards), "anchors")
    sharded = scanned.filter("kind = 0").select("block", "shard", "hashes", "twice")
    found = recurring_hashes(sharded, shards)
    blocks = scanned.filter("kind = 1").select("block", "keys", "ids", "anchors")
    affected = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _affected, "key binary, id bigint, anchors binary"
    )
    affected = written(affected, "affected")
    # One text of each kind, and how many there are.
    texts = affected.groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("of"), F.max("anchors").alias("anchors")
    )
    texts = written(texts.withColumnRenamed("key", "wanted"), "wanted")
    used = rows.join(texts, (F.col("key") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("of")))
    used = used.select("key", "text", "anchors", "copies")
    candidates = written(_candidate_blocks(used, window, anchor), "candidates")

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, twice in zip(*(batch[c].to_pylist() for c in ("block", "hashes", "twice"))):
                out = _sharded(block, np.frombuffer(hashes, np.uint64), np.frombuffer(twice, bool), shards)
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
                columns = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "shard", "hashes", "twice"]
                )

    windows = candidates.select("block", "hashes", "twice").mapInArrow(
        by_shard, "block string, shard bigint, hashes binary, twice binary"
    )
    confirmed = recurring_hashes(windows, shards)
    cleaned = candidates.select("block", "keys", "texts").groupBy("block").cogroup(confirmed.groupBy("block"))
    return cleaned.applyInArrow(_cleaned(window), "key binary, n_removed bigint, kept string")


def without_repeats(
    docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id"
) -> DataFrame:
    """``row`` (the document), ``n_words, n_removed`` and ``kept`` (its words that stay; null: all)."""
    cleaned = written(repeated_passages(docs, text, window, anchor, key), "passages")
    cleaned = cleaned.withColumnRenamed("key", "_key").dropDuplicates(["_key"])
    rows = docs.select(
        F.struct("*").alias("row"), text_key(text).alias("key"), F.coalesce(text, F.lit("")).alias("text")
    )
    joined = rows.join(cleaned, F.col("key") == F.col("_key"), "left")
    return joined.select("row", "text", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "kept")


def repeat_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` of every document.

    Word counts and digests of whole texts come from a scan of their own, so only hashes meet
    the texts that lose words.
    """
    cleaned = repeated_passages(docs, text, key=key, **options)
    cleaned = written(
        cleaned.select(
            F.col("key").alias("_key"), F.col("n_removed").alias("_removed"), F.sha2("kept", 256).alias("_sha")
        ),
        "passages",
    )
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys = [], [], []
            for value in batch["text"]:
                raw = value.as_py().encode()
                words = raw.split()
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                keys.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(digests), pa.array(keys, pa.binary())],
                ["id", "n_words", "sha", "key"],
            )

    schema = rows.select("id").schema.add("n_words", "long").add("sha", "string").add("key", "binary")
    whole = rows.mapInArrow(counted, schema)
    # A repeated row was fetched twice.
    joined = whole.join(cleaned.dropDuplicates(["_key"]), F.col("key") == F.col("_key"), "left")
    return joined.select(
        F.col("id").alias("key"),
        "n_words",
        F.coalesce("_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_sha", "sha").alias("kept_sha256"),
    )
