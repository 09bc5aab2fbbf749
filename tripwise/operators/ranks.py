"""Exact order statistics and running sums without a column, a group or a table in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tripwise.sources.shared import written

BINS = 4096
# A sketch of this accuracy is off by at most a 10,000th of the ranks; brackets
# are taken between its quantiles, one step wider on both sides.
SKETCH_ACCURACY = 10_000
SKETCH_STEPS = 1_000


class Bracket(NamedTuple):
    """Smallest and largest candidate value, how many values are below and how many inside.

    ``below`` and ``inside`` are ``None`` until a pass has counted them.
    """

    low: float
    high: float
    below: int | None
    inside: int | None

    @property
    def closed(self) -> bool:
        return self.low == self.high and self.below is not None


def running_sums(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """Add to each row, for every name in ``sums``, the sum of the column over the rows before it.

    "Before" means in ``order``, which must tell rows apart, and within ``group``. Rows are
    range-partitioned and written once; inside a partition they are added up in order,
    and what earlier partitions hold comes from one row for each partition and group. So
    no group, however large, meets in one task.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    values = {f"_own_{name}": value for name, value in sums.items()}
    ranged = df.withColumns(values).repartitionByRange(*group, *order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    names = [F.col(c).alias(f"_of_{c}") for c in group]
    totals = ranged.groupBy(*names, F.col("_part").alias("_of_part")).agg(
        *[F.sum(own).alias(f"_all_{name}") for name, own in zip(sums, values)]
    )
    earlier = Window.partitionBy(*[f"_of_{c}" for c in group]).orderBy("_of_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[f"_of_{c}" for c in group],
        "_of_part",
        *[F.coalesce(F.sum(f"_all_{name}").over(earlier), F.lit(0)).alias(f"_ahead_{name}") for name in sums],
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({f"_in_{name}": F.sum(own).over(inside) for name, own in zip(sums, values)})
    same = F.col("_part") == F.col("_of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    found = {name: F.col(f"_ahead_{name}") + F.coalesce(f"_in_{name}", F.lit(0)) for name in sums}
    return rows.join(totals, same).select(*df.columns, *[value.alias(name) for name, value in found.items()])


def numbered(
    df: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), name: str = "place"
) -> DataFrame:
    """Add the number 1, 2, 3, ... of each row in ``order`` within its ``group``."""
    counted = running_sums(df, order, {name: F.lit(1).cast("bigint")}, group)
    return counted.withColumn(name, F.col(name) + 1)


def values_at_ranks(
    df: DataFrame, ranks: dict[str, Callable[[int], Iterable[int]]], bins: int = BINS
) -> dict[str, dict[int, float]]:
    """Per column, the values (as doubles) at the zero-based ranks chosen from its value count.

    Null and NaN are left out; a column without values has no entry.
    """
    found = brackets_at_ranks(df, ranks, bins)
    return {c: {rank: bracket.low for rank, bracket in of.items()} for c, of in found.items()}


def brackets_at_ranks(
    df: DataFrame, ranks: dict[str, Callable[[int], Iterable[int]]], bins: int = BINS
) -> dict[str, dict[int, Bracket]]:
    """As ``values_at_ranks``, with the numbers of smaller and of equal values.

    One scan counts the values of all columns and sketches their quantiles; a bracket around
    each rank is taken between two of them. A further scan counts the values below each bracket and
    in ``bins`` equal steps of it, keeps the step that holds the rank and goes on between the smallest
    and the largest value in that step, until both are equal. A 1,000th of the values is left after
    the first scan and a 4,096th of these after each other one, so two or three scans do for any table; a
    scan shuffles at most ``bins`` rows per bracket and task, however often a value repeats.
    """
    columns = list(ranks)
    values = {c: F.col(c).cast("double") for c in columns}
    values = {c: F.when(~F.isnan(v), v) for c, v in values.items()}
    grid = [i / SKETCH_STEPS for i in range(SKETCH_STEPS + 1)]
    measures = []
    for i, c in enumerate(columns):
        measures += [
            F.count(values[c]).alias(f"n{i}"),
            F.min(values[c]).alias(f"lo{i}"),
            F.max(values[c]).alias(f"hi{i}"),
            F.percentile_approx(values[c], grid, SKETCH_ACCURACY).alias(f"grid{i}"),
        ]
    (row,) = _scanned(df.agg(*measures))
    brackets: dict[tuple[str, int], Bracket] = {}
    ends: dict[str, Bracket] = {}
    for i, c in enumerate(columns):
        n, low, high, quantiles = (row[f"{name}{i}"] for name in ("n", "lo", "hi", "grid"))
        if not n:
            continue
        ends[c] = Bracket(low, high, None, None)
        for rank in ranks[c](n):
            if not 0 <= rank < n:
                raise ValueError(f"No rank {rank} among {n} values of {c}")
            step = rank * SKETCH_STEPS // n
            first = low if step < 2 else quantiles[step - 1]
            last = high if step > SKETCH_STEPS - 3 else quantiles[step + 2]
            brackets[c, rank] = Bracket(low, high, 0, n) if low == high else Bracket(first, last, None, None)

    while not all(bracket.closed for bracket in brackets.values()):
        brackets.update(_narrowed(df, values, brackets, ends, bins))

    found: dict[str, dict[int, Bracket]] = {}
    for (c, rank), bracket in brackets.items():
        found.setdefault(c, {})[rank] = bracket
    return found


def _scanned(df: DataFrame) -> list[Row]:
    """A small aggregate; each call is one scan of the table behind it."""
    return df.collect()


def _step(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Number of the step that holds ``x``; ``lo`` and ``hi`` never share one unless they are equal."""
    # Halving keeps the width finite for values at both ends of the double range.
    width = hi / 2 - lo / 2
    if width == 0 or math.isinf(width):
        ends = F.when(x == F.lit(lo), 0).when(x == F.lit(hi), 2).otherwise(1)
        return ends.cast("bigint")
    return F.least(F.floor((x / 2 - lo / 2) / F.lit(width) * F.lit(float(bins))), F.lit(bins - 1))


def _narrowed(
    df: DataFrame,
    values: dict[str, Column],
    brackets: dict[tuple[str, int], Bracket],
    ends: dict[str, Bracket],
    bins: int,
) -> dict[tuple[str, int], Bracket]:
    """One scan: the open brackets, each reduced to the step that holds its rank.

    A bracket whose rank turns out to lie elsewhere starts again between the column's ends.
    """
    open_ = {name: bracket for name, bracket in brackets.items() if not bracket.closed}
    spans = sorted({(c, bracket.low, bracket.high) for (c, _), bracket in open_.items()})
    pieces = []
    for i, (c, lo, hi) in enumerate(spans):
        x = values[c]
        step = F.when(x < F.lit(lo), F.lit(-1)).when(x <= F.lit(hi), _step(x, lo, hi, bins))
        pieces.append(F.struct(F.lit(i).alias("span"), step.cast("bigint").alias("step"), x.alias("x")))
    counted = (
        df.select(F.explode(F.array(*pieces)).alias("piece"))
        .select("piece.*")
        .filter(F.col("step").isNotNull())
        .groupBy("span", "step")
        .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    preceding = Window.partitionBy("span").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(preceding), F.lit(0)))
    wanted = F.lit(False)
    for (c, rank), bracket in open_.items():
        i = spans.index((c, bracket.low, bracket.high))
        holds = (F.col("before") <= rank) & (F.lit(rank) < F.col("before") + F.col("n"))
        wanted = wanted | ((F.col("span") == i) & (F.col("step") >= 0) & holds)
    narrowed = {name: ends[name[0]] for name in open_}
    for hit in _scanned(counted.filter(wanted)):
        for (c, rank), bracket in open_.items():
            inside = hit["before"] <= rank < hit["before"] + hit["n"]
            if spans[hit["span"]] == (c, bracket.low, bracket.high) and inside:
                narrowed[c, rank] = Bracket(hit["lo"], hit["hi"], hit["before"], hit["n"])
    return narrowed
