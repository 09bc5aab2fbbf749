"""Exact samples, shuffles and splits that do not depend on the partitioning.

Rows are ordered by the md5 of ``key`` and ``seed``, nulls first among equal hashes. ``key``,
a column or a list of columns, must identify a row; a key that repeats at a cut is refused.
Exact sizes need the hash of the k-th row. It is found by counting hash prefixes
(at most 65,536 groups per class, combined before the shuffle) and ranking only
the rows of the one prefix that holds it, so no class ever meets in one task. Counts and
cuts are written tables of one row per class, joined like any other table, so any number of classes will do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tripwise.functions.keys import shuffle_key
from tripwise.operators.ranks import brackets_at_ranks, numbered
from tripwise.sources.shared import written

PREFIX_DIGITS = 4
HASH_DIGITS = 32
RANKED_ROWS = 1_000_000


def _cuts(
    hashed: DataFrame, quota: Callable[[DataFrame], DataFrame], ranked_rows: int = RANKED_ROWS
) -> DataFrame:
    """Per class the ``(hash, key)`` of its quota-th row; no row where the quota is 0.

    ``hashed`` has the columns ``class``, ``key`` and ``hash``; ``quota`` turns ``class, total``
    into ``class, want``.
    """
    in_order = Window.partitionBy("class").orderBy("lead")
    before = F.coalesce(
        F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )

    digits = PREFIX_DIGITS
    lead = F.substring("hash", 1, digits).alias("lead")
    counted = written(hashed.groupBy("class", lead).agg(F.count("*").alias("n")), "prefix_counts")
    wants = quota(counted.groupBy("class").agg(F.sum("n").alias("total")))
    wants = wants.select(F.col("class").alias("want_class"), "want")
    marks = counted.withColumn("before", before)
    marks = marks.join(wants, F.col("class").eqNullSafe(F.col("want_class")))
    holding = written(_holding(marks), "holding")

    while digits < HASH_DIGITS and (holding.agg(F.max("n")).first()[0] or 0) > ranked_rows:
        inside = _inside(hashed, holding, digits)
        digits += PREFIX_DIGITS
        counted = inside.groupBy(
            "class", F.substring("hash", 1, digits).alias("lead"), "want"
        ).agg(F.count("*").alias("n"))
        holding = written(_holding(counted.withColumn("before", before)), "holding")

    in_order = Window.partitionBy("class").orderBy("hash", "key")
    ranked = _inside(hashed, holding, digits).select(
        "*",
        F.row_number().over(in_order).alias("rank"),
        F.lead(F.struct("hash", "key")).over(in_order).alias("next"),
    )
    repeats = F.coalesce(F.col("next") == F.struct("hash", "key"), F.lit(False))
    message = "The key does not identify a row: add columns that tell its rows apart"
    return written(
        ranked.filter(F.col("rank") == F.col("want")).select(
            F.col("class").alias("cut_class"),
            F.when(repeats, F.raise_error(F.lit(message))).otherwise(F.col("hash")).alias("cut_hash"),
            F.col("key").alias("cut_key"),
        ),
        "cuts",
    )


def _holding(marks: DataFrame) -> DataFrame:
    """The prefix in which the wanted row lies, and its rank inside it."""
    return marks.filter(
        (F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n"))
    ).select("class", "lead", (F.col("want") - F.col("before")).alias("want"), "n")


def _inside(hashed: DataFrame, found: DataFrame, digits: int) -> DataFrame:
    held = found.select(F.col("class").alias("held_class"), "lead", "want")
    return hashed.join(
        held,
        F.col("class").eqNullSafe(F.col("held_class"))
        & (F.substring("hash", 1, digits) == F.col("lead")),
    ).select("class", "key", "hash", "want")


def _key(key: str | list[str]) -> Column:
    return F.struct(*key) if isinstance(key, list) else F.col(key)


def sample_exact(df: DataFrame, key: str | list[str], n: int, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` random rows without replacement: a plain filter up to the hash of the n-th row."""
    hashed = df.select(
        F.lit(0).alias("class"), _key(key).alias("key"), shuffle_key(key, seed).alias("hash")
    )
    want = F.least(F.lit(n).cast("bigint"), "total").alias("want")
    cuts = _cuts(hashed, lambda totals: totals.select("class", want))
    cut = cuts.select(F.struct("cut_hash", "cut_key").alias("cut")).scalar()
    return df.filter(F.struct(shuffle_key(key, seed), _key(key)) <= cut)


def _image(kind: DataType, key: Column) -> Column:
    """A number that never falls where the key rises: nulls first, NaN last, ends of texts cut off."""
    if isinstance(kind, (NumericType, BooleanType)):
        number = key.cast("double")
    elif isinstance(kind, TimestampType):
        number = F.unix_micros(key).cast("double")
    elif isinstance(kind, (DateType, TimestampNTZType)):
        number = F.unix_date(key.cast("date")).cast("double")
    elif isinstance(kind, (StringType, BinaryType)):
        start = F.rpad(F.hex(F.substring(key.cast("binary"), 1, 6)), 12, "0")
        number = F.conv(start, 16, 10).cast("double")
    else:
        raise TypeError(f"No order of {kind.simpleString()} keys")
    infinity = F.lit(float("inf"))
    return F.coalesce(F.when(F.isnan(number), infinity).otherwise(number), -infinity)


def head_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in key order (null keys first, NaN last), in range partitions.

    The key can be a number, a boolean, a date, a time, a text or bytes. A rank search over numbers in
    the order of the keys finds the last one wanted. Where more rows share that number than are wanted
    (long common beginnings of texts, times of one day, repeated keys), those alone are
    numbered by range partition, in the order of their keys and of a hash of the row.
    """
    image = _image(df.schema[key].dataType, F.col(key))
    found = brackets_at_ranks(
        df.select(image.alias("image")), {"image": lambda rows: [min(n, rows) - 1] if n > 0 else []}
    )
    if not found:
        return df.limit(0)
    ((rank, cut),) = found["image"].items()
    left = rank + 1 - cut.below
    if left == cut.inside:
        return df.filter(image <= F.lit(cut.low)).orderBy(key)
    kept = df.filter(image < F.lit(cut.low))
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    placed = df.filter(image == F.lit(cut.low)).withColumn("_row", F.xxhash64(*plain))
    placed = numbered(placed, [key, "_row"], name="_place")
    return kept.unionByName(placed.filter(F.col("_place") <= left).select(*df.columns)).orderBy(key)


def shuffled(
    df: DataFrame,
    key: str,
    seed: int = 42,
    position: str = "position",
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in random order.

    The position is the row count of all smaller hash prefixes plus the rank among
    the rows of the same prefix. There are at most ``16 ** prefix_digits`` prefixes,
    which bounds both the broadcast table of counts and the one window over it; five
    digits suit tables of some 10^11 rows and more.
    """
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    hashed = hashed.withColumn("_lead", F.substring("_hash", 1, prefix_digits))
    counts = hashed.groupBy("_lead").agg(F.count("*").alias("n"))
    preceding = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_lead", F.coalesce(F.sum("n").over(preceding), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_lead").orderBy("_hash", key)) - 1
    return (
        hashed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_lead")
        .select(*df.columns, (F.col("_offset") + F.col("_rank")).alias(position))
    )


def _allotted(totals: DataFrame, test_fraction: float) -> DataFrame:
    """``class, want``: ``ceil(test_fraction * rows)`` test rows dealt out by largest remainder.

    Every class gets the whole part of its share; what is left goes, one row each, to the classes
    with the largest remainders, earlier classes first among equal ones. A class never gives its
    last row, so it takes no extra row that would be that one.
    """
    totals = written(totals, "class_totals")
    rows = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    tested = math.ceil(test_fraction * rows)
    share = F.col("total").cast("decimal(19,0)") * F.lit(tested).cast("decimal(19,0)")
    shares = totals.withColumns(
        {
            "whole": F.least(F.floor(share / F.lit(max(rows, 1))).cast("bigint"), F.col("total") - 1),
            "rest": (share % F.lit(max(rows, 1)).cast("decimal(19,0)")).cast("bigint"),
        }
    )
    left = tested - (shares.agg(F.sum("whole")).first()[0] or 0)
    room = F.col("whole") + 1 < F.col("total")
    order = [F.when(room, F.col("rest")).otherwise(F.lit(-1)).desc(), F.col("class")]
    placed = numbered(shares, order)
    extra = (room & (F.col("place") <= left)).cast("bigint")
    return placed.select("class", (F.col("whole") + extra).alias("want"))


def stratified_split(
    df: DataFrame, key: str | list[str], label: str, test_fraction: float, seed: int = 42
) -> DataFrame:
    """Add ``split``: ``ceil(test_fraction * rows)`` rows are 'test', dealt out over the classes.

    Sizes per class follow by largest remainder, see ``_allotted``.
    """
    hashed = df.select(
        F.col(label).alias("class"), _key(key).alias("key"), shuffle_key(key, seed).alias("hash")
    )
    cuts = _cuts(hashed, lambda totals: _allotted(totals, test_fraction))
    in_test = F.struct(shuffle_key(key, seed), _key(key)) <= F.struct("cut_hash", "cut_key")
    in_test = F.col("cut_hash").isNotNull() & in_test
    return df.join(cuts, F.col(label).eqNullSafe(F.col("cut_class")), "left").select(
        *df.columns, F.when(in_test, "test").otherwise("train").alias("split")
    )
