"""Conversation prefix trie by whole-sequence collapse.

Turns are numbered in their conversation, and a running sum of position-dependent turn digests
(128 bits) names every prefix. Conversations whose last prefix is the same are one weighted
sequence with a list of its ends; only one of them is kept. Sequences that are no other's proper
prefix (an anti-join) are the leaves, and the weighted prefixes of the kept sequences are the nodes.

Texts are read once and never moved: what travels is a turn's digest and length. Numbers and
running sums inside a conversation are found by range partition or by chunk of positions with the
sums before it, so a conversation of a third of all turns is many tasks. Copies, frequent first
turns and the root are combined before every shuffle. A subtree's sum of ``bytes`` of distinct nodes
counts each node for the least conversation through it: those are the last nodes of its path, so
one number for each sequence says where they begin.

Defined cases: rows without a conversation id take no part; a null role or text is empty; turns of
the same number (null first) come in order of the MD5 of role and text; rows that repeat are turns
that repeat; ids count as 64-bit integers; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.operators.ranks import numbered
from tripwise.sources.shared import discard, written

#: Consecutive turns that are summed in one go.
CHUNK_TURNS = 65_536
#: Bytes of an end list that travel as one row.
LIST_BYTES = 1 << 20
PARTS = ("h1", "h2", "h3", "h4")
ROOT = "0-0-0-0-0"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """MD5 of a turn; the length of the role keeps ``ab, c`` and ``a, bc`` apart."""
    size = F.octet_length(role).cast("string")
    return F.md5(F.concat(size, F.lit(":"), role, text).cast("binary"))


def ordered_turns(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, pos, digest, bytes`` of every turn, ``pos`` from 1 without gaps."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    turns = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        turn_digest(F.coalesce(F.col(role).cast("string"), F.lit("")), said).alias("digest"),
        F.octet_length(said).cast("bigint").alias("bytes"),
    )
    placed = numbered(turns, ["turn", "digest"], ["conv_id"], "pos")
    return written(placed.select("conv_id", "pos", "digest", "bytes"), "ordered_turns")


def crossed(turns: DataFrame, group: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations as ``conv_id, pos, digest, bytes`` and all their ids as ``conv_id``.

    Conversation c starts with the first h turns of c - c % ``group`` (h = crc32 of its decimal id,
    modulo ``modulus``) and goes on with its own turns after its first h.
    """
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus
    convs = counted.select(
        "conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    )
    bases = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    convs = written(convs, "convs")
    own = turns.join(convs, "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    heads = turns.filter((F.col("pos") < modulus) & (F.col("conv_id") % group == 0))
    heads = heads.withColumnRenamed("conv_id", "base").join(convs, "base").filter("pos <= h")
    heads = heads.select("conv_id", "pos", "digest", "bytes")
    return own.unionByName(heads), convs.select("conv_id")


def _named(sums: list[Column], depth: Column) -> Column:
    return F.concat_ws("-", depth.cast("string"), *[(s % (1 << 32)).cast("string") for s in sums])


def named_prefixes(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """``conv_id, depth, node, parent, digest, bytes, before``: the prefix that ends with each turn.

    ``before`` is the bytes of the turns ahead of it.
    """
    mark = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")).cast("binary"))
    marked = turns.withColumn("mark", mark).withColumn("chunk", F.floor((F.col("pos") - 1) / chunk_turns))
    parts = {p: F.conv(F.substring("mark", 8 * i + 1, 8), 16, 10).cast("bigint") for i, p in enumerate(PARTS)}
    marked = marked.withColumns(parts).drop("mark")
    summed = (*PARTS, "bytes")
    totals = marked.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(f"{c}_all") for c in summed])
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "conv_id", "chunk", *[F.coalesce(F.sum(f"{c}_all").over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in summed]
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in summed}).join(totals, ["conv_id", "chunk"])
    upto = {c: F.col(f"{c}_upto") + F.col(f"{c}_ahead") for c in summed}
    return rows.select(
        "conv_id",
        F.col("pos").cast("bigint").alias("depth"),
        _named([upto[p] for p in PARTS], F.col("pos")).alias("node"),
        _named([upto[p] - F.col(p) for p in PARTS], F.col("pos") - 1).alias("parent"),
        "digest",
        "bytes",
        (upto["bytes"] - F.col("bytes")).alias("before"),
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sequence in sorted rows ``seq, conv_id``, as pieces of the list of its ends."""
    for batch in batches:
        seqs, convs = batch["seq"], batch["conv_id"]
        n = len(seqs)
        edges = pc.indices_nonzero(pc.not_equal(seqs.slice(1), seqs.slice(0, max(0, n - 1)))).to_pylist()
        bounds = [0, *[e + 1 for e in edges], n]
        step = LIST_BYTES // 20
        out = []
        for low, high in zip(bounds, bounds[1:]):
            for at in range(low, high, step):
                ids = convs.slice(at, min(step, high - at)).to_pylist()
                if ids:
                    out.append((seqs[low].as_py(), ids[0], len(ids), ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["seq", "first", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a sequence from its pieces, which follow each other in order."""
    held, out = None, []

    def closed():
        return held[0], held[1], held[2], held[3].hexdigest()

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0] == row["seq"]:
                held[2] += row["n"]
                held[3].update(b",")
            else:
                if held:
                    out.append(closed())
                held = [row["seq"], row["first"], row["n"], hashlib.sha256()]
            held[3].update(row["ids"].encode())
        if len(out) >= 10_000:
            yield _sequences(out)
            out = []
    if held:
        yield _sequences([*out, closed()])


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["seq", "conv_id", "weight", "ends_sha256"])


def weighted_sequences(ends: DataFrame) -> DataFrame:
    """``seq, conv_id, weight, ends_sha256`` from ``conv_id, seq``: identical conversations once.

    The ids of one sequence are put in order and joined in as many tasks as they fill; only the
    finished pieces of a list meet in one, where they are hashed one after the other.
    """
    ranged = ends.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = ranged.mapInArrow(_chunks, "seq string, first bigint, n bigint, ids string")
    pieces = pieces.repartition("seq").sortWithinPartitions("seq", "first")
    return pieces.mapInArrow(_digests, "seq string, conv_id bigint, weight bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """The nodes of the trie of conversations ``conv_id, pos, digest, bytes``, all ids in ``convs``.

    A node is ``conv_id`` (its smallest member) and ``depth``; ``digest`` is its last turn's.
    """
    prefixes = written(named_prefixes(turns, chunk_turns), "prefixes")
    last = prefixes.groupBy("conv_id").agg(
        F.max(F.struct("depth", "node")).alias("last"), F.sum("bytes").alias("total")
    )
    ends = convs.distinct().join(last, "conv_id", "left").select(
        "conv_id",
        F.coalesce("last.node", F.lit(ROOT)).alias("seq"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )
    ends = written(ends, "ends")
    seqs = weighted_sequences(ends).join(ends.select("conv_id", "total"), "conv_id")
    seqs = written(seqs, "sequences")
    discard(ends)

    kept = prefixes.join(seqs.select("conv_id", "weight"), "conv_id")
    top = seqs.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(ROOT).alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(0).cast("bigint").alias("bytes"),
        F.lit(0).cast("bigint").alias("before"),
        "weight",
    )
    kept = written(kept.unionByName(top), "kept_prefixes")
    discard(prefixes)
    nodes = kept.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("parent").alias("parent"),
        F.max("digest").alias("digest"),
        F.sum("weight").alias("n_convs"),
        F.max("before").alias("before"),
    )
    nodes = written(nodes, "nodes")

    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    children = written(children, "children")
    leaves = seqs.join(children, seqs.seq == children.parent, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    # Nodes counted for a conversation are the last of its path, so the first of them says which.
    begin = nodes.groupBy("conv_id").agg(F.min("before").alias("begin"))
    paths = seqs.select("conv_id", "total").join(leaves, "conv_id", "left").join(begin, "conv_id", "left")
    through = kept.join(paths, "conv_id")
    rest = F.col("total") - F.col("before")
    once = F.col("total") - F.greatest("before", F.coalesce("begin", "total"))
    below = through.groupBy("node").agg(
        F.sum(F.coalesce("leaf", F.lit(0))).cast("bigint").alias("n_leaves"),
        F.sum(F.col("weight") * rest - once).alias("saved_tokens"),
    )
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = (
        nodes.drop("before")
        .join(below, "node")
        .join(children.withColumnRenamed("parent", "node"), "node", "left")
        .join(seqs.select(F.col("seq").alias("node"), "ends_sha256"), "node", "left")
    )
    counted = written(out, "counted_nodes")
    discard(kept, children, seqs)
    return counted.join(above, "parent", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        "digest",
    )
