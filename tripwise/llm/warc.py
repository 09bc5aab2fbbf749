"""WARC archives: written as Spark text files, read back by boundary-chain verification.

The reader cuts files of any size at the record magic, wherever it stands, also inside
payloads. Every piece is a candidate record and names its successor: the place behind its
header, content and closing line breaks. Tasks follow these links inside their own split;
between splits pointer jumping from the start of each file keeps the reachable records
only, so a magic inside a payload is rejected and its piece goes back to its record.

Defined cases: a null payload is an empty one; a null URL has no target header and line
breaks in a URL are percent-encoded; rows with the smallest id of an equal payload (several,
when rows repeat) are all responses; a null id comes after all others; bytes before the
first record, or a broken record, end the chain of that file; no pages make no archives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwise.sources.shared import fresh_path, written

MAGIC = b"WARC/1."
BETWEEN = b"\r\n" + MAGIC
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"


def warc_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """``value``: one record for each page, without its last line break.

    Equal payloads of at least ``revisit_bytes`` bytes are stored once, with the smallest key;
    the others become revisit records that refer to it.
    """
    rows = pages.select(
        F.col(key).cast("string").alias("id"),
        F.col(key).alias("key"),
        F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        pages.select(
            F.col(key).alias("key"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload")
        )
        .filter(F.octet_length("payload") >= revisit_bytes)
        .groupBy(F.sha2("payload", 256).alias("same"))
        .agg(F.min("key").alias("first"), F.count("*").alias("copies"))
        .filter(F.col("first").isNotNull() & (F.col("copies") > 1))
        .select("same", "first")
    )
    repeated = written(repeated, "repeated_payloads")
    rows = rows.join(repeated, F.col("digest") == F.col("same"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce("id", F.lit("")),
        F.lit(">"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), "url")).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit("\r\nWARC-Payload-Length: "),
        F.col("n").cast("string"),
        F.lit("\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(F.col("n").cast("string")),
    )
    body = F.when(revisit, "").otherwise(F.col("payload"))
    return rows.select(F.concat(header, F.lit("\r\n\r\n"), body, F.lit("\r\n")).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """One archive per task; text output commits whole files only, so lost executors leave no half ones."""
    warc_records(pages, **columns).write.option("lineSep", "\r\n").text(path)


SEGMENTS = (
    "file string, block bigint, at bigint, size bigint, next bigint, leaves bigint, whole boolean, "
    "id string, kind string, refers string, head bigint, content bigint, payload_bytes bigint, digest string"
)
_NAMES = [part.split()[0] for part in SEGMENTS.split(", ")]
_ARROW = pa.schema(
    [
        (name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[part.split()[1]])
        for name, part in zip(_NAMES, SEGMENTS.split(", "))
    ]
)


def _page_of(urn: bytes | None) -> str | None:
    if urn is None or not urn.startswith(b"<urn:page:"):
        return None
    return urn[10:-1].decode() or None


def _segment(file: str, block: int, at: int, value: bytes) -> list:
    """A candidate record; ``at`` is where its bytes behind the magic start."""
    size = len(value) + len(BETWEEN)
    # A payload that begins with the magic takes the last line break of its header with it.
    head = (value + b"\r\n").find(b"\r\n\r\n")
    fields = {}
    for line in value[:head].split(b"\r\n")[1:] if head > 0 else ():
        name, _, content = line.partition(b":")
        fields[name.strip().lower()] = content.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return [file, block, at, size, None, None, False, None, None, None, None, None, None, None]
    n = int(length)
    body = head + 4
    # A record is followed by the magic of the next one, or by the end of the file.
    whole = len(value) in (body + n + 2, body + n + 4) and value[body + n :] in (b"\r\n", b"\r\n\r\n")
    stored = fields.get(b"warc-type") != b"revisit"
    declared = fields.get(b"warc-payload-digest", b"").decode("latin-1").rpartition(":")[2] or None
    digest = hashlib.sha256(value[body : body + n]).hexdigest() if stored and whole else declared
    full = fields.get(b"warc-payload-length", b"")
    return [
        file,
        block,
        at,
        size,
        at + body + n + 4 + len(MAGIC),
        None,
        whole,
        _page_of(fields.get(b"warc-record-id")),
        fields.get(b"warc-type", b"").decode("latin-1"),
        _page_of(fields.get(b"warc-refers-to")),
        body,
        n,
        n if stored else int(full) if full.isdigit() else None,
        digest,
    ]


def _linked(rows: list[list]) -> pa.RecordBatch:
    """Set ``leaves``: where the chain from a candidate leaves the split, if it is not broken inside."""
    end = rows[-1][2] + rows[-1][3] if rows else 0
    leaves: dict[int, int | None] = {}
    for row in reversed(rows):
        at, following = row[2], row[4]
        if following is not None:
            row[5] = leaves.get(following) if following < end else following
        leaves[at] = row[5]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), _ARROW.types)], _NAMES
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", BETWEEN.decode())
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
    )


def _split_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Pieces with their place relative to the first piece of their split."""
    current, at = None, 0
    for batch in batches:
        for file, block, value in zip(
            batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"]
        ):
            value = value.as_py()
            if (file, block) != current:
                current, at = (file, block), 0
                if block == 0 and value.startswith(MAGIC):
                    value, at = value[len(MAGIC) :], len(MAGIC)
            yield file, block, at, value
            at += len(value) + len(BETWEEN)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for file, block, at, value in _split_offsets(batches):
        if rows and (rows[-1][0], rows[-1][1]) != (file, block):
            yield _linked(rows)
            rows = []
        rows.append(_segment(file, block, at, value))
    if rows:
        yield _linked(rows)


def _walk(block: pd.DataFrame) -> pd.DataFrame:
    """Mark the records on the chain from the entry of one split."""
    block = block.sort_values("at", kind="stable")
    following = dict(zip(block["at"], block["next"]))
    at, chain = block["entry"].iloc[0], set()
    while at in following and at not in chain:
        chain.add(at)
        at = following[at]
    return block.assign(reached=block["at"].isin(chain)).drop(columns="entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every real record."""
    found = written(_pieces(spark, path).mapInArrow(_candidates, SEGMENTS), "candidates")

    # Bytes of the splits before each one: a row per split.
    totals = found.groupBy("file", "block").agg(F.sum("size").alias("n"), F.min("at").alias("least"))
    totals = totals.withColumn("n", F.col("n") + F.col("least"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = written(bases, "split_offsets")
    placed = found.join(bases, ["file", "block"])
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")})
    placed = written(placed.drop("base"), "placed")

    # Pointer jumping over the places where chains enter splits.
    jumps = placed.filter("leaves IS NOT NULL").select("file", "at", "leaves")
    starts = placed.filter((F.col("block") == 0) & (F.col("at") == len(MAGIC))).select("file", "at")
    targets = jumps.select("file", F.col("leaves").alias("at")).unionByName(starts).distinct()
    jumps = written(jumps.join(targets, ["file", "at"]), "jumps")
    reached = written(starts, "entries")
    n, more = -1, reached.count()
    while more > n:
        n = more
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = written(reached.unionByName(ahead).distinct(), "entries")
        twice = jumps.select("file", F.col("at").alias("from"), F.col("leaves").alias("at"))
        twice = twice.join(jumps, ["file", "at"]).select("file", F.col("from").alias("at"), "leaves")
        jumps = written(twice, "jumps")
        more = reached.count()

    entry = placed.join(reached, ["file", "at"]).select("file", "block", F.col("at").alias("entry"))
    chained = placed.join(entry, ["file", "block"])
    schema = placed.schema.add("reached", "boolean")
    records = written(chained.groupBy("file", "block").applyInPandas(_walk, schema), "records")
    whole = records.filter(F.col("reached") & F.col("whole")).select(
        "id", "payload_bytes", "digest", "kind", "refers"
    )
    if records.filter("reached AND NOT whole").isEmpty():
        return _result(whole)
    return _result(whole.unionByName(_rejoined(spark, path, placed, records, bases)))


def _result(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("id").cast("bigint").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").cast("bigint").alias("refers_to"),
    )


def _rejoined(
    spark: SparkSession, path: str, placed: DataFrame, records: DataFrame, bases: DataFrame
) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and put together."""
    torn = records.filter("reached AND NOT whole").select(
        "file", F.col("at").alias("own"), F.col("next").alias("until"), "id", "kind", "refers", "head", "content"
    )
    heads = written(torn, "torn")
    # Each piece belongs to the last torn record that starts at or before it.
    marks = heads.select("file", F.col("own").alias("at"), "own", "until")
    pieces = placed.select("file", "block", "at").join(
        heads.select("file").distinct(), "file", "left_semi"
    ).join(marks, ["file", "at"], "left")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn(
        "mark", F.last(F.when(F.col("own").isNotNull(), F.struct("own", "until")), True).over(upto)
    ).filter(F.col("at") < F.col("mark.until"))
    pieces = pieces.join(bases, ["file", "block"]).select(
        "file", "block", (F.col("at") - F.col("base")).alias("at"), "base", F.col("mark.own").alias("own")
    )
    pieces = written(pieces, "torn_pieces")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, at, value in _split_offsets(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block]), pa.array([at]), pa.array([value], pa.binary())],
                ["file", "block", "at", "value"],
            )

    values = _pieces(spark, path).mapInArrow(raw, "file string, block bigint, at bigint, value binary")
    parts = values.join(pieces, ["file", "block", "at"]).join(heads, ["file", "own"])

    def rejoin(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.assign(place=pieces["at"] + pieces["base"]).sort_values("place")
        first = pieces.iloc[0]
        whole = BETWEEN.join(pieces["value"])
        payload = whole[first["head"] : first["head"] + first["content"]]
        return pd.DataFrame(
            {
                "id": [first["id"]],
                "payload_bytes": [len(payload)],
                "digest": [hashlib.sha256(payload).hexdigest()],
                "kind": [first["kind"]],
                "refers": [first["refers"]],
            }
        )

    return parts.groupBy("file", "own").applyInPandas(
        rejoin, "id string, payload_bytes bigint, digest string, kind string, refers string"
    )


def archive_pages(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archives and read them back."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    write_archives(pages, path, **columns)
    return read_archives(spark, path)
