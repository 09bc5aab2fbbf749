"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


SINGLE_FILE_ROWS = 100_000
# Spark's own CSV formats stop at milliseconds.
CSV_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def write_table(
    df: DataFrame,
    path: str,
    force_csv: bool = False,
    single_file: bool = False,
    compression: str | None = None,
) -> str:
    """Overwrite ``path`` with Parquet, or with headed CSV for a CSV suffix or ``force_csv``.

    ``single_file`` pulls the result through one task. It is meant for
    aggregates of a few rows (the hourly profile has 24) and off by default; a result of more
    than ``SINGLE_FILE_ROWS`` rows is refused before anything is written.
    """
    if single_file and df.limit(SINGLE_FILE_ROWS + 1).count() > SINGLE_FILE_ROWS:
        raise ValueError(f"More than {SINGLE_FILE_ROWS} rows are not written as a single file")
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    suffix = path.lower().rstrip("/")
    if force_csv or suffix.endswith((".csv", ".csv.gz")):
        if compression is None and suffix.endswith(".gz"):
            compression = "gzip"
        writer = writer.option("header", True).options(**CSV_FORMATS)
        if compression:
            writer = writer.option("compression", compression)
        writer.csv(path)
    else:
        if compression:
            writer = writer.option("compression", compression)
        writer.parquet(path)
    return path
