"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Every document has a 60-bit hash. A source's target is met by whole copies of all its
documents and, for the rest, by its documents with the smallest hashes: word counts are
summed by source and hash bucket, the bucket in which the running sum meets the rest is
found, and only that bucket is cut into finer ones, level by level.

Defined cases: a null text has no words; a null source is a source of its own, after all
others; documents that share a hash (repeated rows) stay together; a document without
words is taken with its neighbours in hash order; an empty table gives an empty result.
The hash of a null key is that of the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.sources.shared import written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
LEVEL_BITS = 12
LEVELS = 5


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def row_hash(key: Column | str) -> Column:
    """60 bits of the md5 of the key as text."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: one row for each source.

    Sources share all words by weight. A source whose share exceeds ``max_copies`` times its
    size stops there; taking such sources in the order of size over weight, the shares of the
    others follow at once from what is left. Windows run over one row per source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ).withColumn("weight", F.col("weight").cast("bigint"))
    order = (F.col("source_size").cast("double") / F.col("weight")).asc()
    tied = Window.orderBy(order, F.col("source").asc_nulls_last())
    before = tied.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    heavy = F.sum("weight").over(everything)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_copies
    open_weight = heavy - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighted.withColumn("left", total - capped).withColumn("open", open_weight)
    # The first source of the order that stays below its limit sets the level for all after it.
    stays = F.col("left") * F.col("weight") <= F.col("source_size") * max_copies * F.col("open")
    levelled = levelled.withColumn("place", F.row_number().over(tied)).withColumn("stays", stays)
    first = F.min(F.when(F.col("stays"), F.struct("place", "left", "open"))).over(everything)
    levelled = levelled.withColumn("level", first)
    free = F.col("place") >= F.col("level.place")
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open")
    limit = (F.col("source_size") * max_copies).cast("double")
    return levelled.select(
        "source", "source_size", F.when(free, share).otherwise(limit).alias("target")
    )


def thresholds(rows: DataFrame, targets: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``source, below``: the first hash that is no longer taken for the rest of the target.

    ``rows`` has ``source, size, hash``; ``targets`` has ``source, copies, rest``. A hash is taken
    when half its words still fit: ``2 * words before + own words <= 2 * rest``.
    """
    state = targets.select(
        "source", "rest", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("before")
    )
    for level in range(1, levels + 1):
        width = 1 << LEVEL_BITS * (levels - level)
        span = 1 << LEVEL_BITS * (levels - level + 1)
        held = state.select(F.col("source").alias("held"), "rest", "low", "before")
        inside = rows.join(held, F.col("source").eqNullSafe(F.col("held")))
        inside = inside.filter((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + span))
        bucket = F.shiftright(F.col("hash") - F.col("low"), LEVEL_BITS * (levels - level))
        counted = inside.groupBy("source", "rest", "low", "before", bucket.alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        order = Window.partitionBy("source").orderBy("bucket")
        sums = counted.withColumn(
            "upto",
            F.col("before")
            + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        # All hashes of a bucket are taken for sure when they fit together.
        open_ = sums.filter(F.col("upto") + F.col("words") > F.col("rest"))
        first = open_.groupBy("source").agg(
            F.min_by(F.struct("low", "bucket", "upto"), "bucket").alias("at")
        )
        found = first.select(
            F.col("source").alias("found"),
            (F.col("at.low") + F.col("at.bucket") * width).alias("next"),
            F.col("at.upto").alias("upto"),
        )
        whole = F.col("low") + span
        state = state.join(found, F.col("source").eqNullSafe(F.col("found")), "left").select(
            "source",
            "rest",
            F.coalesce("next", whole).alias("low"),
            F.coalesce("upto", F.col("before")).alias("before"),
        )
        state = written(state, f"thresholds_{level}")
    # ``low`` is now one hash, the first that does not fit wholly.
    held = state.select(F.col("source").alias("held"), F.col("low"))
    edge = rows.join(held, F.col("source").eqNullSafe(F.col("held")) & (F.col("hash") == F.col("low")))
    edge = edge.groupBy(F.col("held").alias("edge")).agg(F.sum("size").alias("words"))
    takes = F.col("before") * 2 + F.col("words") <= F.col("rest") * 2
    return state.join(edge, F.col("source").eqNullSafe(F.col("edge")), "left").select(
        "source", (F.col("low") + F.when(takes, 1).otherwise(0)).alias("below")
    )


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return written(
        docs.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            row_hash(key).alias("hash"),
            word_count(text).alias("size"),
        ),
        "sizes",
    )


def source_cuts(sized: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """``of`` (the source), ``source_size, target``, whole ``copies`` and the hash ``below`` which one more is taken."""
    targets = source_targets(sized, weights, max_copies)
    copies = F.floor(F.col("target") / F.col("source_size")).cast("bigint")
    copies = F.when(F.col("source_size") > 0, F.least(copies, F.lit(max_copies).cast("bigint")))
    targets = targets.withColumn("copies", F.coalesce(copies, F.lit(1).cast("bigint")))
    targets = targets.withColumn(
        "rest", F.col("target") - (F.col("copies") * F.col("source_size")).cast("double")
    )
    targets = written(targets, "targets")
    below = thresholds(sized, targets).select(F.col("source").alias("cut"), "below")
    joined = targets.join(below, F.col("source").eqNullSafe(F.col("cut")), "left")
    return written(
        joined.select(
            F.col("source").alias("of"),
            "source_size",
            "target",
            "copies",
            F.when(F.col("copies") < max_copies, F.col("below")).alias("below"),
        ),
        "cuts",
    )


def taken_copies() -> Column:
    return F.col("copies") + F.coalesce(F.col("hash") < F.col("below"), F.lit(False)).cast("bigint")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """``key, source, hash, size, source_size, target, copies, taken`` of every document."""
    sized = _sized(docs, key, text, source)
    cuts = source_cuts(sized, weights, max_copies)
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("copies", taken_copies())
    return joined.select(
        "key",
        "source",
        "hash",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """The documents as the mix takes them: repeated as often as taken, left out where not.

    The decision needs a document's source and hash only, so texts meet nothing but the
    table of sources.
    """
    cuts = source_cuts(_sized(docs, key, text, source), weights, max_copies)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), row_hash(key).alias("hash"))
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    times = joined.select("row", taken_copies().alias("times")).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("row.*")
