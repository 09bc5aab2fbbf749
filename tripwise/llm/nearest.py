"""Approximate nearest neighbours over shifted Hilbert curves.

Vectors are projected to a few dimensions by random orthonormal directions, shifted at random and
ordered along a Hilbert curve, once for each of ``CURVES`` curves. Spark range-partitions each
ordering and numbers its rows; consecutive places are blocks, and a query is compared with the vectors
of the blocks within ``window`` places of its own on every curve. What the curves find is merged, and the best
are ranked again by the exact distance of the original vectors.

The window is not a constant: true neighbours of a bounded sample of vectors are found by brute force,
and the window is the least that reaches ``TARGET_RECALL`` of them on the curves of this very table.
Every vector is indexed. Equal vectors are indexed once, with their smallest ids, as no answer needs
more than k + 1 of them; queries with equal vectors are searched once and answered each.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, or have no id,
take no part; vectors are compared with those of their own length; rows that repeat id and vector are
one, rows that repeat an id with another vector are candidates and queries of their own; ties go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.operators.ranks import numbered
from tripwise.sources.shared import discard, written

CURVES = 8
DIMENSIONS = 8
BITS = 7
FIT_VECTORS = 16_384
SAMPLE_QUERIES = 128
TARGET_RECALL = 0.96
LEAST_WINDOW = 1024
BLOCK = 1024
#: Queries from so many consecutive blocks search another block together.
QUERY_BLOCKS = 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below ``2 ** bits``).

    Gray-code rotations from the highest bit down, as J. Skilling describes them.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        high, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(dims):
            swap = np.where(x[i] & high, low, (x[0] ^ x[i]) & low)
            x[i] ^= np.where(x[i] & high, np.uint32(0), swap)
            x[0] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    keys = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            keys = keys << 1 | (x[i] >> np.uint32(bit) & np.uint32(1)).astype(np.int64)
    return keys


@dataclass
class Curves:
    """Projections and grids of all curves; ``spans`` has the middle and width of sampled lengths."""

    count: int
    scale: float
    spans: dict[int, tuple[np.ndarray, np.ndarray]]
    seed: int = 42
    bits: int = BITS
    held: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "held": {}}

    def directions(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions of all curves side by side, and each curve's shift as a share of the width."""
        if length not in self.held:
            rng = np.random.default_rng([self.seed, length])
            dims = min(DIMENSIONS, length)
            sides = [np.linalg.qr(rng.normal(size=(length, dims)))[0] for _ in range(self.count)]
            self.held[length] = np.hstack(sides), rng.random(self.count * dims)
        return self.held[length]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions(x.shape[1])[0]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Key of each row of ``x`` (scaled vectors of one length) on every curve."""
        length = x.shape[1]
        shift = self.directions(length)[1]
        middle, width = self.spans.get(length) or (np.zeros(len(shift)), np.full(len(shift), 2.0))
        y = (self.projected(x) - middle) / width + 0.5 + shift
        cells = np.clip(y * (1 << self.bits) / 2, 0, (1 << self.bits) - 1).astype(np.uint32)
        return np.array([hilbert_keys(part, self.bits) for part in np.split(cells, self.count, axis=1)])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the vectors that take part, repeated rows once."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).distinct()


def vector_classes(rows: DataFrame, asks: Column) -> tuple[DataFrame, Column]:
    """``class, v, asks``: equal vectors once, and the hash that names their class, proven to be unique."""
    for seed in range(8):
        name = F.xxhash64("v", F.lit(seed))
        classes = rows.groupBy("v").agg(F.bool_or(asks).alias("asks"))
        classes = written(classes.select(name.alias("class"), "v", "asks"), "classes")
        n = classes.agg(F.count("*"), F.count_distinct("class")).first()
        if n[0] == n[1]:
            return classes, name
        discard(classes)
    raise RuntimeError("No seed gives distinct hashes")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length at a time, with their vectors as a matrix."""
    lengths = np.diff(batch["v"].offsets.to_numpy())
    for length in np.unique(lengths):
        rows = batch.take(pa.array(np.flatnonzero(lengths == length)))
        yield rows, rows["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _sample(classes: DataFrame, count: int, total: int, seed: int) -> DataFrame:
    """About ``count`` classes, whatever the layout of the table."""
    draw = F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 30))
    return classes.filter(draw < int(min(1.0, count / total) * (1 << 30)) + 1)


def fit_curves(classes: DataFrame, curves: int = CURVES, fit_vectors: int = FIT_VECTORS, seed: int = 42) -> Curves:
    """Grids around the projections of about ``fit_vectors`` vectors; others are clipped to them."""
    total = max(1, classes.count())
    by_length: dict[int, list[np.ndarray]] = {}
    for batch in _sample(classes, fit_vectors, total, seed).select("v").toArrow().to_batches():
        for _, x in _by_length(batch):
            by_length.setdefault(x.shape[1], []).append(x)
    most = max((np.abs(x).max() for parts in by_length.values() for x in parts), default=1.0)
    fitted = Curves(curves, 2.0 ** -np.frexp(most)[1], {}, seed)
    for length, parts in by_length.items():
        y = fitted.projected(np.vstack(parts) * fitted.scale)
        low, high = np.percentile(y, [0.1, 99.9], axis=0)
        fitted.spans[length] = (low + high) / 2, np.maximum(high - low, 1e-12) * 1.25
    return fitted


def _squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)
    return np.maximum(np.nan_to_num(d, nan=np.inf), 0)


def _least(d: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` least of every row."""
    if d.shape[1] <= count:
        return np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.argpartition(d, count - 1, axis=1)[:, :count]


def fit_window(
    classes: DataFrame,
    curves: Curves,
    k: int,
    sample_queries: int = SAMPLE_QUERIES,
    target_recall: float = TARGET_RECALL,
) -> int:
    """Places to either side of a vector that hold ``target_recall`` of the neighbours of sampled vectors.

    A neighbour counts as held if one of the curves has it that near.
    """
    total = max(1, classes.count())
    asked: dict[int, list] = {}
    for batch in _sample(classes, sample_queries, total, curves.seed + 1).select("class", "v").toArrow().to_batches():
        for rows, x in _by_length(batch):
            asked.setdefault(x.shape[1], []).append((rows["class"].to_numpy(), x * curves.scale))
    queries = {n: tuple(np.concatenate(c) for c in zip(*parts)) for n, parts in asked.items()}
    shared = classes.sparkSession.sparkContext.broadcast((curves, queries))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves, queries = shared.value
        for batch in batches:
            for rows, x in _by_length(batch):
                if x.shape[1] not in queries:
                    continue
                names, q = queries[x.shape[1]]
                own, x = rows["class"].to_numpy(), x * curves.scale
                for at in range(0, len(x), 4096):
                    d = _squared(q, x[at : at + 4096])
                    d[names[:, None] == own[at : at + 4096]] = np.inf
                    best = _least(d, k)
                    found = np.take_along_axis(d, best, axis=1)
                    i, j = np.nonzero(np.isfinite(found))
                    to = best[i, j] + at
                    keys = curves.keys(x[to]).T
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[i]),
                            pa.array(np.full(len(i), x.shape[1])),
                            pa.array(found[i, j]),
                            pa.array(list(keys), pa.list_(pa.int64())),
                        ],
                        ["query", "length", "d", "keys"],
                    )

    found = classes.select("class", "v").mapInArrow(nearest, "query bigint, length bigint, d double, keys array<bigint>")
    order = Window.partitionBy("query", "length").orderBy("d")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).toArrow()
    if not found.num_rows:
        return LEAST_WINDOW
    marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in np.unique(found["length"].to_numpy()):
        part = found.filter(pa.array(found["length"].to_numpy() == length))
        names, q = queries[length]
        row = {name: i for i, name in enumerate(names.tolist())}
        own = curves.keys(q)[:, [row[name] for name in part["query"].to_pylist()]]
        other = np.array(part["keys"].to_pylist()).T
        marks[int(length)] = np.minimum(own, other), np.maximum(own, other)
    sent = classes.sparkSession.sparkContext.broadcast((curves, marks))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many keys of each curve lie between the marks."""
        curves, marks = sent.value
        counts = {n: np.zeros(low.shape, np.int64) for n, (low, _) in marks.items()}
        for batch in batches:
            for _, x in _by_length(batch):
                if x.shape[1] in marks:
                    for c, keys in enumerate(np.sort(curves.keys(x * curves.scale), axis=1)):
                        low, high = (side[c] for side in marks[x.shape[1]])
                        counts[x.shape[1]][c] += np.searchsorted(keys, high, "right") - np.searchsorted(keys, low)
        for n, count in counts.items():
            curve, pair = np.indices(count.shape).reshape(2, -1)
            columns = [np.full(curve.shape, n), curve, pair, count.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "curve", "pair", "n"])

    counted = classes.select("v").mapInArrow(between, "length bigint, curve bigint, pair bigint, n bigint")
    counted = counted.groupBy("length", "pair", "curve").agg(F.sum("n").alias("n"))
    needed = counted.groupBy("length", "pair").agg(F.min("n").alias("n"))
    return max(LEAST_WINDOW, int(needed.agg(F.percentile("n", target_recall)).first()[0]) + 1)


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every class with its keys on all curves and its scaled vector as 32-bit numbers."""
        curves = shared.value
        most = np.finfo(np.float32).max
        for batch in batches:
            for rows, x in _by_length(batch):
                for at in range(0, len(x), 2048):
                    part = rows.slice(at, 2048)
                    scaled = x[at : at + 2048] * curves.scale
                    codes = np.clip(scaled, -most, most).astype(np.float32)
                    columns = [
                        part["class"],
                        part["asks"],
                        pa.array(np.full(part.num_rows, x.shape[1], np.int64)),
                        pa.array(list(curves.keys(scaled).T), pa.list_(pa.int64())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["class", "asks", "length", "keys", "code"])

    return run


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Classes and vectors of coded rows of one length."""
    codes = b"".join(table["code"].to_pylist())
    x = np.frombuffer(codes, np.float32).reshape(table.num_rows, -1)
    return table["class"].to_numpy(), x.astype(np.float64)


def _searched(count: int):
    def run(visitors: pa.Table, held: pa.Table) -> pa.Table:
        """The ``count`` nearest of a block for each query that visits it."""
        found = []
        if visitors.num_rows and held.num_rows:
            names, x = _matrix(held)
            for at in range(0, visitors.num_rows, 1024):
                asking, q = _matrix(visitors.slice(at, 1024))
                d = _squared(q, x)
                best = _least(d, count)
                nearest = np.take_along_axis(d, best, axis=1)
                found.append((np.repeat(asking, best.shape[1]), names[best.ravel()], nearest.ravel()))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(dict(zip(("query", "class", "d"), columns)))

    return run


def window_candidates(classes: DataFrame, curves: Curves, window: int, count: int, block: int = BLOCK) -> DataFrame:
    """``query, class, d``: the nearest classes in the windows of each asking class, ``count`` at least of each.

    Only keys are sorted; a vector is sent once for each curve, to the block of its place.
    """
    shared = classes.sparkSession.sparkContext.broadcast(curves)
    schema = "class bigint, asks boolean, length bigint, keys array<bigint>, code binary"
    coded = written(classes.mapInArrow(_coded(shared), schema), "coded")
    placed = coded.select("class", "asks", "length", F.posexplode("keys").alias("curve", "key"))
    placed = numbered(placed, ["key", "class"], ["length", "curve"])
    placed = written(placed.select("class", "asks", "length", "curve", (F.col("place") - 1).alias("place")), "places")
    codes = coded.select("class", "code")
    run = block * QUERY_BLOCKS
    where = ("length", "curve", "block", "run")

    def whole(place: Column, size: int) -> Column:
        return F.floor(F.greatest(place, F.lit(0)) / size)

    place = F.col("place")
    asking = placed.filter("asks").withColumn("run", whole(place, run)).join(codes, "class")
    visited = F.sequence(whole(place - window, block), whole(place + window, block))
    visitors = asking.withColumn("block", F.explode(visited))
    # Queries visit a block by runs of their places; the block goes to every run that may reach it.
    held = placed.withColumn("block", whole(place, block))
    first, last = F.col("block") * block - window, F.col("block") * block + (block - 1) + window
    reached = F.sequence(whole(first - block, run), whole(last + block, run))
    reached = held.select("length", "curve", "block").distinct().withColumn("run", F.explode(reached))
    reached = reached.join(visitors.select(*where).distinct(), list(where), "left_semi")
    held = held.join(reached, ["length", "curve", "block"]).join(codes, "class")
    columns = (*where, "class", "code")
    visitors, held = (side.select(*columns).toDF(*columns).groupBy(*where) for side in (visitors, held))
    pairs = visitors.cogroup(held)
    found = pairs.applyInArrow(_searched(count), "query bigint, class bigint, d double")
    return found.groupBy("query", "class").agg(F.min("d").alias("d"))


def nearest_vectors(
    df: DataFrame,
    asks: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    window: int | None = None,
    **options,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each row of which ``asks`` holds.

    ``asks`` is a condition on the column ``id``; ``score`` is the Euclidean distance.
    """
    rows = written(usable(df, key, vector), "usable")
    classes, name = vector_classes(rows, asks)
    curves = fit_curves(classes, **options)
    window = window or fit_window(classes, curves, k)
    found = window_candidates(classes, curves, window, k + 5)
    first = Window.partitionBy("query").orderBy("d", "class")
    # The query's own class is among them.
    best = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= 2 * k + 1)

    own = classes.select(F.col("class").alias("query"), F.col("v").alias("q"))
    away = F.zip_with("q", "v", lambda a, b: (a - b) * (a - b))
    score = F.sqrt(F.aggregate(away, F.lit(0.0), lambda total, x: total + x)).alias("score")
    scored = best.select("query", "class").join(classes.select("class", "v"), "class").join(own, "query")
    scored = written(scored.select("query", "class", score), "scored")

    members = rows.select("id", name.alias("class"))
    in_class = Window.partitionBy("class").orderBy("id")
    listed = members.withColumn("place", F.row_number().over(in_class)).filter(F.col("place") <= k + 1)
    nearest = Window.partitionBy("query").orderBy("score", "id", "class")
    answers = scored.join(listed.drop("place"), "class").withColumn("place", F.row_number().over(nearest))
    answers = written(answers.filter(F.col("place") <= k + 1), "answers")
    queries = members.filter(asks).select(F.col("id").alias("query_id"), F.col("class").alias("query"))
    answered = queries.join(answers, "query").filter("id <> query_id OR class <> query")
    of_query = Window.partitionBy("query_id", "query").orderBy("place")
    ranked = answered.withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
