import pytest
from pyspark.sql.types import StructType

from tripwise.sources.contracts import (
    SchemaMismatch,
    described,
    load_checked,
    require_schema,
    schema_differences,
)
from tripwise.sources.shared import fresh_path
from tripwise.sources.sinks import write_table
from tripwise.sources.tables import TRIP_SCHEMA

WANTED = (
    StructType()
    .add("id", "long")
    .add("fare", "double")
    .add("at", "timestamp_ntz", nullable=False)
    .add("note", "string")
)
pytestmark = pytest.mark.usefixtures("spark")


def kinds(ddl, **options):
    found = schema_differences(StructType.fromDDL(ddl), WANTED, **options)
    return [(d.column, d.kind, d.wanted, d.found) for d in found]


def test_all_differences_are_reported_at_once():
    found = kinds("id string, FARE float, more int", allow_extra=False, widen=False)
    assert found == [
        ("id", "type", "bigint", "string"),
        ("fare", "name", "fare", "FARE"),
        ("fare", "type", "double", "float"),
        ("at", "missing", "timestamp_ntz", None),
        ("note", "missing", "string", None),
        ("more", "extra", None, "int"),
    ]


def test_wider_types_extra_columns_and_nulls():
    same = "id int, fare float, at timestamp_ntz, note string, more int"
    assert kinds(same) == []
    assert kinds(same, nulls=True) == [("at", "nullability", "not null", "nullable")]
    assert kinds("id bigint, fare double, at timestamp_ntz NOT NULL, note string", nulls=True, allow_extra=False) == []
    assert kinds("id double, fare bigint, at timestamp, note int")[:2] == [
        ("id", "type", "bigint", "double"),
        ("fare", "type", "double", "bigint"),
    ]


def test_a_mismatch_is_raised_before_any_job(spark):
    df = spark.range(3).selectExpr("id", "raise_error('a job ran') AS fare")
    with pytest.raises(SchemaMismatch) as raised:
        require_schema(df, WANTED)
    assert [d.column for d in raised.value.differences] == ["fare", "at", "note"]
    assert isinstance(raised.value, KeyError) and "at: missing, expected timestamp_ntz" in str(raised.value)


def test_files_are_checked_by_footer_and_header(spark):
    good = spark.createDataFrame([], TRIP_SCHEMA)
    for suffix in ("parquet", "csv"):
        path = write_table(good, fresh_path(spark, f"t.{suffix}"), single_file=True)
        assert load_checked(spark, path, TRIP_SCHEMA).schema.names == TRIP_SCHEMA.names
        path = write_table(good.drop("tip_amount").withColumnRenamed("VendorID", "vendor"), fresh_path(spark, f"t.{suffix}"), single_file=True)
        with pytest.raises(SchemaMismatch) as raised:
            load_checked(spark, path, TRIP_SCHEMA)
        assert {d.column for d in raised.value.differences if d.kind == "missing"} == {"VendorID", "tip_amount"}
    turned = write_table(good.select(*reversed(TRIP_SCHEMA.names)), fresh_path(spark, "t.csv"), single_file=True)
    with pytest.raises(SchemaMismatch, match="place"):
        load_checked(spark, turned, TRIP_SCHEMA)


def test_description_is_a_table(spark):
    rows = [tuple(r) for r in described(spark.createDataFrame([], WANTED)).orderBy("position").collect()]
    assert rows[0] == (1, "id", "bigint", True) and rows[2] == (3, "at", "timestamp_ntz", False)
