import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tests.plans import plan_of
from tripwise.operators import ranks, sampling


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def rows(spark):
    """1,000 rows: a third in class 'a', one row alone in 'solo', some without a class."""
    label = (
        F.when(F.col("id") == 0, "solo")
        .when(F.col("id") % 3 == 0, "a")
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise("b")
    )
    return spark.range(1000).select("id", label.alias("label"))


@pytest.mark.parametrize("n", [0, 1, 137, 1000, 5000])
def test_sample_is_exact(rows, n):
    sample = sampling.sample_exact(rows, "id", n).collect()
    assert sorted(r["id"] for r in sample) == sorted(order(range(1000))[:n])


@pytest.fixture(scope="module")
def keyed(spark):
    """1,000 rows: 200 without a key, the others share 160 keys; ``id`` tells them apart."""
    return spark.range(1000).selectExpr(
        "id", "CASE WHEN id >= 200 THEN id % 160 END AS key", "id % 2 AS label"
    )


@pytest.mark.parametrize("n", [90, 110, 150, 2000])
def test_sample_of_null_and_repeated_keys(keyed, n):
    assert sampling.sample_exact(keyed, ["key", "id"], n).count() == min(n, 1000)


def test_split_of_null_and_repeated_keys(keyed):
    split = sampling.stratified_split(keyed, ["key", "id"], "label", 0.02)
    assert {(r["label"], r["count"]) for r in split.filter("split = 'test'").groupBy("label").count().collect()} == {(0, 10), (1, 10)}


def test_one_null_key_is_a_key_and_a_repeated_key_is_refused(spark, keyed):
    single = spark.range(100).selectExpr("CASE WHEN id > 0 THEN id END AS key")
    for n in range(0, 101, 10):
        assert sampling.sample_exact(single, "key", n).count() == n
    with pytest.raises(Exception, match="does not identify a row"):
        sampling.sample_exact(keyed.selectExpr("1 AS key"), "key", 150).count()


def test_sample_does_not_depend_on_the_partitioning_but_on_the_seed(rows):
    def ids(df, seed):
        return {r["id"] for r in sampling.sample_exact(df, "id", 50, seed).collect()}

    assert ids(rows, 1) == ids(rows.repartition(13), 1)
    assert ids(rows, 1) != ids(rows, 2)


def test_cut_is_found_through_several_prefix_levels(rows):
    hashed = rows.select(
        F.lit(0).alias("class"), F.col("id").alias("key"), F.md5(F.concat("id", F.lit(":42"))).alias("hash")
    )
    for ranked_rows in (0, 1, 10**6):
        cut = sampling._cuts(hashed, lambda t: t.select("class", F.lit(500).alias("want")), ranked_rows).collect()
        assert [r["cut_key"] for r in cut] == [order(range(1000))[499]]


def test_shuffle_numbers_every_row_once(rows):
    placed = sampling.shuffled(rows.repartition(5), "id").orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(1000))
    assert [r["id"] for r in placed] == order(range(1000))


def allotted(totals, fraction):
    """Test rows per class: whole shares, then one row each to the largest remainders."""
    n = sum(totals.values())
    tested = math.ceil(fraction * n)
    want = {c: min(t * tested // n, t - 1) for c, t in totals.items()}
    order_ = sorted(totals, key=lambda c: (-(totals[c] * tested % n), c is not None, c or ""))
    for c in [c for c in order_ if want[c] + 1 < totals[c]][: tested - sum(want.values())]:
        want[c] += 1
    return want


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.25, 0.3333, 0.999])
def test_split_sizes_are_exact(rows, fraction):
    split = sampling.stratified_split(rows, "id", "label", fraction)
    assert split.count() == 1000
    counts = {
        (r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()
    }
    labels = ("a", "b", "solo", None)
    totals = {c: counts.get((c, "test"), 0) + counts.get((c, "train"), 0) for c in labels}
    tested = {c: counts.get((c, "test"), 0) for c in labels}
    assert tested == allotted(totals, fraction)
    if fraction < 0.9:
        assert sum(tested.values()) == math.ceil(fraction * 1000)
    in_test = {r["id"] for r in split.filter("label = 'a' AND split = 'test'").collect()}
    members = [r["id"] for r in rows.filter("label = 'a'").collect()]
    assert in_test == set(order(members)[: len(in_test)])


def test_split_is_the_same_for_any_partitioning(rows):
    def test_ids(df):
        split = sampling.stratified_split(df, "id", "label", 0.25)
        return {r["id"] for r in split.filter("split = 'test'").collect()}

    assert test_ids(rows) == test_ids(rows.repartition(11))


def test_split_of_many_classes_and_a_dominant_one(spark):
    """20,000 classes of two rows and one of 40,000 rows; the total is exact and every share within one row."""
    label = F.when(F.col("id") < 40_000, F.lit(-1)).otherwise(F.floor(F.col("id") / 2)).alias("label")
    rows = spark.range(80_000).select("id", label)
    split = sampling.stratified_split(rows, "id", "label", 0.3)
    tested = split.groupBy("label").agg(F.count_if(F.col("split") == "test").alias("n"), F.count("*").alias("total"))
    found = {r["label"]: r["n"] for r in tested.collect()}
    assert sum(found.values()) == 24_000 and found[-1] == 12_000
    assert len(found) == 20_001 and max(n for c, n in found.items() if c != -1) == 1


def test_split_of_an_empty_table(rows):
    assert sampling.stratified_split(rows.limit(0), "id", "label", 0.25).count() == 0


def test_split_itself_is_a_filter_without_shuffle(rows):
    plan = plan_of(sampling.stratified_split(rows, "id", "label", 0.25))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("n", [0, 4, 137, 5000])
def test_head_of_large_keys(rows, n):
    large = rows.repartition(9).withColumn("id", F.col("id") + 2**62)
    head = sampling.head_sample(large, "id", n)
    assert [r["id"] - 2**62 for r in head.orderBy("id").collect()] == list(range(min(n, 1000)))


@pytest.mark.parametrize("n", [1, 3, 40, 299])
def test_head_by_any_ordered_key(spark, n):
    """Texts with long common beginnings, days, times of one day, decimals and repeated keys."""
    rows = spark.range(300).selectExpr(
        "id",
        "concat('same beginning ', lpad(id * 7 % 300, 4, '0')) AS text",
        "date_add(DATE'2020-01-01', int(id * 7 % 300)) AS day",
        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7 % 300) AS time",
        "timestamp'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7 % 300) AS instant",
        "CAST(id * 7 % 300 AS decimal(20,3)) / 1000 AS number",
        "CAST(lpad(id * 7 % 300, 4, '0') AS binary) AS bytes",
        "map('id', id) AS kept",
    )
    wanted = {r["id"] for r in rows.filter(f"id * 7 % 300 < {n}").collect()}
    for key in ("text", "day", "time", "instant", "number", "bytes"):
        head = sampling.head_sample(rows.repartition(5), key, n)
        got = head.collect()
        assert {r["id"] for r in got} == wanted and len(got) == n, key
        assert [r[key] for r in got] == sorted(r[key] for r in got)
    repeated = sampling.head_sample(rows.withColumn("key", F.col("id") % 3), "key", n).collect()
    assert sorted(r["key"] for r in repeated) == sorted(i % 3 for i in range(300))[:n]
    with pytest.raises(TypeError):
        sampling.head_sample(rows, "kept", n)


def test_head_takes_few_scans_and_comes_in_partitions(spark, monkeypatch):
    scans = []
    monkeypatch.setattr(ranks, "_scanned", lambda df: scans.append(1) or df.collect())
    rows = spark.range(200_000).selectExpr("id", "hash(id) / 7D AS key")
    head = sampling.head_sample(rows, "key", 50_000)
    assert len(scans) == 2
    assert "rangepartitioning(key" in plan_of(head) and "Limit" not in plan_of(head)
    assert head.count() == 50_000
    assert head.agg(F.max("key")).first()[0] <= rows.join(head.select("id"), "id", "left_anti").agg(F.min("key")).first()[0]


@pytest.mark.parametrize("n, nulls", [(20, 20), (50, 50), (100, 50), (995, 50), (2000, 50)])
def test_head_keeps_null_and_nan_keys(spark, n, nulls):
    key = "CASE WHEN id < 50 THEN NULL WHEN id >= 990 THEN double('NaN') ELSE id + 0.5D END AS key"
    rows = spark.range(1000).selectExpr("id", key)
    head = sampling.head_sample(rows, "key", n).collect()
    assert len(head) == min(n, 1000)
    assert sum(r["key"] is None for r in head) == nulls
    assert [r["id"] for r in head if r["key"] is not None and r["key"] == r["key"]] == list(range(50, min(max(n, 50), 990)))
