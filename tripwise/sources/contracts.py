"""What a table must look like, checked before any job reads it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from tripwise.sources.tables import load_table

# Types that Spark reads as another one without a loss.
WIDENS = {
    "tinyint": {"smallint", "int", "bigint", "double"},
    "smallint": {"int", "bigint", "double"},
    "int": {"bigint", "double"},
    "float": {"double"},
    "date": {"timestamp_ntz"},
}


@dataclass(frozen=True)
class Difference:
    """One column that is not as the contract says; ``found`` is ``None`` for a missing column."""

    column: str
    kind: str
    wanted: str | None
    found: str | None

    def __str__(self) -> str:
        if self.kind == "missing":
            return f"{self.column}: missing, expected {self.wanted}"
        if self.kind == "extra":
            return f"{self.column}: not expected ({self.found})"
        return f"{self.column}: {self.kind} {self.found}, expected {self.wanted}"


class SchemaMismatch(KeyError):
    """All differences between a table and its contract; a ``KeyError``, as for a missing column."""

    def __init__(self, differences: list[Difference]):
        super().__init__("; ".join(map(str, differences)))
        self.differences = differences


def _fits(found: DataType, wanted: DataType, widen: bool) -> bool:
    a, b = found.simpleString(), wanted.simpleString()
    return a == b or widen and b in WIDENS.get(a, ())


def schema_differences(
    found: StructType, wanted: StructType, allow_extra: bool = True, widen: bool = True, nulls: bool = False
) -> list[Difference]:
    """Every difference at once, in the order of the contract, extra columns last.

    A narrower numeric type fits a wider one if ``widen``. With ``nulls``, a column that the contract
    calls not nullable must say so itself; file formats rarely do, so this is off by default. Names
    differ in case only if the table has no column of the exact name.
    """
    exact = {f.name: f for f in found.fields}
    folded = {f.name.lower(): f for f in found.fields}
    out, used = [], set()
    for field in wanted.fields:
        held = exact.get(field.name) or folded.get(field.name.lower())
        kind = field.dataType.simpleString()
        if held is None:
            out.append(Difference(field.name, "missing", kind, None))
            continue
        used.add(held.name)
        if held.name != field.name:
            out.append(Difference(field.name, "name", field.name, held.name))
        if not _fits(held.dataType, field.dataType, widen):
            out.append(Difference(field.name, "type", kind, held.dataType.simpleString()))
        if nulls and held.nullable and not field.nullable:
            out.append(Difference(field.name, "nullability", "not null", "nullable"))
    if not allow_extra:
        extra = [f for f in found.fields if f.name not in used]
        out += [Difference(f.name, "extra", None, f.dataType.simpleString()) for f in extra]
    return out


def require_schema(df: DataFrame, wanted: StructType, **options) -> DataFrame:
    """The table itself, or a ``SchemaMismatch`` with all differences; reads metadata only."""
    differences = schema_differences(df.schema, wanted, **options)
    if differences:
        raise SchemaMismatch(differences)
    return df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of a headed CSV, all read as text: no inference pass."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def load_checked(spark: SparkSession, path: str, wanted: StructType, **options) -> DataFrame:
    """Load a table that keeps the contract.

    Parquet footers are compared with names and types. A CSV file has names only; they must be those
    of the contract in its order, as Spark would put values under the wrong names otherwise.
    """
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        header = csv_header(spark, path)
        known = {f.name: f for f in wanted.fields}
        differences = [
            Difference(f.name, "missing", f.dataType.simpleString(), None) for f in wanted.fields if f.name not in header
        ]
        differences += [Difference(c, "extra", None, "text") for c in header if c not in known]
        if not differences:
            moved = [(f.name, c) for f, c in zip(wanted.fields, header) if f.name != c]
            differences = [Difference(name, "place", name, c) for name, c in moved]
        if differences:
            raise SchemaMismatch(differences)
        return load_table(spark, path, wanted)
    return require_schema(load_table(spark, path), wanted, **options)


def described(df: DataFrame) -> DataFrame:
    """``position, column, type, nullable`` of a table, as a table."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")
