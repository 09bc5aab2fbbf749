"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their hashes. It is cut into fragments, as many as
the largest symmetric difference that two similar sets of a size class can have, and two
more: similar sets then agree on at least two whole fragments. Sets that agree on a fragment
are candidates; their overlap is counted fragment by fragment and summed per pair.

Equal sets are one class from the start. In a group of sets that share a fragment every
member is compared with one pivot only, the member that shares most fragments with others
(the original of a family of copies does): first with the pivot of most of its groups, then with those it is not yet
connected to. Groups that are still spread over several components
are then cut into blocks, and the members of two blocks are compared with each other in one task.
A block pair hands on a forest. So no pair inside a component is listed and no link between components is missed.

Every comparison is made by sketches first, one bit for each of many fine fragments of a set; only sets that
these allow to be similar are cut into n-grams and have their overlaps counted.

Defined cases: null texts and texts without words have an empty set and link with nothing;
null ids and repeated rows are rows of their own, joined to their class by the set, not by
the id; extra columns travel in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.llm.components import components
from tripwise.llm.tables import parts_for, small_batches, swept_shuffles, text_bytes
from tripwise.llm.words import Words, mixed, packed, per_worker, slices, space_words, words_of
from tripwise.sources.shared import discard, written

SHINGLE = 3
PERCENT = 90
BLOCK_BYTES = 4 << 20
COUNTED_FRAGMENTS = 4
# Sets of a group that are compared with each other at once, and bytes or cells of the matrices for it.
BLOCK_SETS = 256
SKETCH_CELLS = 1 << 25
# The largest exchanges are made in as many rounds, of which one stands on disk at a time.
ROUNDS = 3
# Pairs that a block pair lists for each of its members, if it has no more that may be similar.
LISTED_PAIRS = 1
INCIDENCE_CELLS = 1 << 23
# The least and the largest number of fine fragments, as powers of two: 16 bytes and 64 KB.
LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 7, 19
MOST_FILTER_BITS = 1 << 29


class Classes:
    """Size classes and the number of fragments of each, for a similarity in percent."""

    def __init__(self, percent: int, largest: int):
        bounds = [1]
        while bounds[-1] <= largest + 1:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
        self.bounds = np.array(bounds, np.int64)
        small = self.bounds[1:] - 1
        differing = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
        # Sets that may not differ at all are equal, so they are one class already.
        self.fragments = np.where(differing > 0, differing + 2, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, "right") - 1


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of the distinct shingles of each text, in order of row and hash.

    A text of fewer than ``n`` words has its whole word sequence as one shingle.
    """
    counts = np.diff(words.bounds)
    rows, hashes = [], []
    for length in range(1, n + 1):
        starts = words.starts_of(length)
        row = words.row_of(starts)
        used = counts[row] >= n if length == n else counts[row] == length
        rows.append(row[used])
        hashes.append(words.run_hashes(length)[starts[used]])
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _range_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def set_digests(value: np.ndarray, cuts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    sizes = np.diff(cuts).astype(np.uint64)
    return tuple(
        mixed(_range_sums(mixed(value + np.uint64(k)), cuts) + sizes).view(np.int64)
        for k in (2 * seed + 1, 2 * seed + 2)
    )


def fragment_signatures(
    row: np.ndarray, value: np.ndarray, sizes: np.ndarray, classes: Classes
) -> tuple[np.ndarray, np.ndarray]:
    """``(signature, row)``: what each set holds in every fragment of its schemes.

    A set takes part in the scheme of its own class and, as the larger partner, in that of the
    class below. Agreement on empty fragments only needs two of them, so pairs of empty
    fragments have signatures as well.
    """
    out, out_rows = [], []
    spread = mixed(value + np.uint64(99))
    for below in (0, 1):
        scheme = classes.of(sizes) - below
        count = np.where((scheme >= 0) & (sizes > 0), classes.fragments[np.maximum(scheme, 0)], 0)
        offset = np.concatenate([[0], np.cumsum(count)])
        used = count[row] > 0
        r, v = row[used], value[used]
        fragment = ((v >> np.uint64(32)) * count[r].astype(np.uint64)) >> np.uint64(32)
        cell = offset[r] + fragment.astype(np.int64)
        cuts = np.searchsorted(cell, np.arange(offset[-1] + 1))
        owner = np.repeat(np.arange(len(sizes)), count)
        name = mixed((scheme[owner].astype(np.uint64) << np.uint64(32)) + (np.arange(offset[-1]) - offset[owner]).astype(np.uint64))
        filled = np.diff(cuts) > 0
        sums = _range_sums(spread[used], cuts)
        out.append(mixed(sums + name)[filled])
        out_rows.append(owner[filled])
        empty = np.flatnonzero(~filled)
        for own in np.unique(owner[empty]):
            names = name[empty[owner[empty] == own]]
            for k in range(len(names) - 1):
                out.append(mixed(mixed(names[k] + np.uint64(7)) + names[k + 1 :]))
                out_rows.append(np.full(len(names) - 1 - k, own))
    return np.concatenate(out), np.concatenate(out_rows)


def _stars(signature: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of equal signatures: ``(signature, pivot)`` and ``(signature, node, pivot)`` of the others."""
    order = np.lexsort((node, signature))
    signature, node = signature[order], node[order]
    new = np.ones(len(node), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
    signature, node = signature[new], node[new]
    first = np.ones(len(node), bool)
    first[1:] = signature[1:] != signature[:-1]
    pivot = node[first][np.cumsum(first) - 1]
    return signature[first], node[first], signature[~first], node[~first], pivot[~first]


def _classes(percent: int, sizes: np.ndarray) -> Classes:
    """One table per worker, for sets up to the largest power of two met."""
    largest = 1 << int(sizes.max(initial=1)).bit_length()
    return per_worker(f"classes_{percent}_{largest}", lambda: Classes(percent, largest))


SETS = "id bigint, own bigint, n bigint, node bigint, check bigint, sketch binary"


def _sets(docs: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """Size, digests and sketch of each document's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["text"]):
                words = words_of(batch["text"].slice(low, high - low), space_words(), fold=True)
                row, value = shingle_sets(words, n)
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                node, check = set_digests(value, cuts, seed)
                sketches = [_sketch(value[a:b], percent) if b > a else None for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].slice(low, high - low) for c in ("id", "own")),
                        *(pa.array(c, pa.int64()) for c in (np.diff(cuts), node, check)),
                        pa.array(sketches, pa.binary()),
                    ],
                    ["id", "own", "n", "node", "check", "sketch"],
                )

    return docs.mapInArrow(scan, SETS)


SHARDS = "shard bigint, signatures binary, nodes binary, members binary"
MEMBERS = "signature bigint, node bigint, pivot bigint"


def _shards(docs: DataFrame, n: int, percent: int, shards: int, seed: int, turn: int) -> DataFrame:
    """The pivots of each block of texts that belong to one shard of the signatures, for the signatures of one round.

    The other members of groups inside a block travel packed, to any shard, so a group of very many
    copies costs its shard one row per block.
    """

    def block_rows(signature: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        signature, pivots, *members = _stars(signature, node)
        shard = ((signature >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        held = np.flatnonzero(np.diff(cuts))
        signatures = [packed(signature[cuts[s] : cuts[s + 1]]) for s in held]
        nodes = [packed(pivots[cuts[s] : cuts[s + 1]]) for s in held]
        inside = [None] * len(held)
        if len(members[0]):
            held = np.append(held, int(members[0].sum() % np.uint64(shards)))
            signatures, nodes = [*signatures, b""], [*nodes, b""]
            inside.append(packed(np.stack([m.view(np.int64) for m in members])))
        return pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), *(pa.array(c, pa.binary()) for c in (signatures, nodes, inside))],
            ["shard", "signatures", "nodes", "members"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_bytes = 0
        for batch in batches:
            for low, high in slices(batch["text"]):
                words = words_of(batch["text"].slice(low, high - low), space_words(), fold=True)
                row, value = shingle_sets(words, n)
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                sizes = np.diff(cuts)
                node, _ = set_digests(value, cuts, seed)
                signature, holder = fragment_signatures(row, value, sizes, _classes(percent, sizes))
                own = signature % np.uint64(ROUNDS) == turn
                held.append((signature[own], node[holder[own]]))
                n_bytes += len(words.data)
                if n_bytes >= BLOCK_BYTES:
                    yield block_rows(*map(np.concatenate, zip(*held)))
                    held, n_bytes = [], 0
        if held:
            yield block_rows(*map(np.concatenate, zip(*held)))

    return docs.mapInArrow(scan, SHARDS)


def _shard_members(shard: pa.Table) -> pa.Table:
    """``signature, node, pivot`` of the members of groups, those across blocks and those inside one."""

    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(v.as_py() for v in shard[name]), kind)

    _, _, signature, node, pivot = _stars(joined("signatures", np.uint64), joined("nodes", np.int64))
    inside = [np.frombuffer(v.as_py(), np.int64).reshape(3, -1) for v in shard["members"].drop_null()]
    columns = np.concatenate([np.stack([signature.view(np.int64), node, pivot]), *inside], 1)
    return pa.table(list(columns), ["signature", "node", "pivot"])


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose id may be among the wanted ones, by a bitmap of their hashes.

    So only these texts are shuffled for the join. The bitmap has some 64 bits for each wanted id and
    ``MOST_FILTER_BITS`` at most (64 MB), which is also the bound of what is broadcast; a full one
    lets everything pass.
    """
    bits = 1 << (64 * wanted.count()).bit_length()
    bits = max(1 << 15, min(MOST_FILTER_BITS, bits))

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(5)), F.lit(bits)) + 1

    bitmaps = wanted.groupBy(F.bitmap_bucket_number(place("of")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("of"))).alias("_bitmap")
    )
    at = F.bitmap_bit_position(place("id"))
    byte = F.conv(F.hex(F.expr("substring(_bitmap, int(_at div 8) + 1, 1)")), 16, 10).cast("int")
    placed = docs.withColumns({"_bucket": F.bitmap_bucket_number(place("id")), "_at": at})
    held = placed.join(F.broadcast(bitmaps), "_bucket").filter(F.getbit(byte, F.expr("int(_at % 8)")) == 1)
    return held.select(*docs.columns)


GRAMS = "node bigint, fragment bigint, n bigint, grams binary, first bigint, chosen boolean"


def _fragment_rows(docs: DataFrame, wanted: DataFrame, n: int, seed: int, fragments: int) -> DataFrame:
    """``node, fragment, n, grams`` of the sets that pairs need, made from one text of each class.

    ``first`` and ``chosen`` of the wanted ones stand beside it.
    """
    used = _likely(docs, wanted).join(wanted, F.col("id").eqNullSafe(F.col("of")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["text"]):
                words = words_of(batch["text"].slice(low, high - low), space_words(), fold=True)
                row, value = shingle_sets(words, n)
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                node, _ = set_digests(value, cuts, seed)
                asked = batch["node"].slice(low, high - low).to_numpy()
                nodes, numbers, sizes, grams, places = [], [], [], [], []
                for k in np.flatnonzero(node == asked):
                    own = value[cuts[k] : cuts[k + 1]]
                    part = ((own >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(int)
                    edges = np.searchsorted(part, np.arange(fragments + 1))
                    for f in range(fragments):
                        nodes.append(node[k])
                        numbers.append(f)
                        sizes.append(len(own))
                        grams.append(packed(own[edges[f] : edges[f + 1]]))
                        places.append(low + k)
                columns = zip((nodes, numbers, sizes, grams), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))
                tags = (batch[c].take(pa.array(places, pa.int64())) for c in ("first", "chosen"))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(values, kind) for values, kind in columns), *tags],
                    ["node", "fragment", "n", "grams", "first", "chosen"],
                )

    return used.select("text", "node", "first", "chosen").mapInArrow(cut, GRAMS)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _verified(sets: DataFrame, percent: int, pairs: DataFrame | None = None) -> DataFrame:
    """The pairs ``a, b`` that are similar: partial overlaps per fragment, summed per pair.

    Without pairs each set is compared with its ``first`` one, so its n-grams are sent once.
    """
    left = sets.select(F.col("node").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("grams").alias("g_a"), F.col("first").alias("b"))
    right = sets if pairs is not None else sets.filter("chosen")
    right = right.select(F.col("node").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    left = left.filter("b IS NOT NULL") if pairs is None else pairs.join(left.drop("b"), "a")
    joined = left.join(right, ["b", "fragment"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), True))
                for x, y in zip(batch["g_a"], batch["g_b"])
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("a", "b", "fragment", "n_a", "n_b")), pa.array(both, pa.int64())],
                ["a", "b", "fragment", "n_a", "n_b", "both"],
            )

    partial = joined.select("a", "b", "fragment", "n_a", "n_b", "g_a", "g_b").mapInArrow(
        overlap, "a bigint, b bigint, fragment bigint, n_a bigint, n_b bigint, both bigint"
    )
    # A repeated row gives its fragments twice.
    once = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("both").alias("both"))
    summed = once.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return summed.filter(F.col("both") * 100 >= union * percent).select("a", "b")


def set_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = SHINGLE,
    percent: int = PERCENT,
    fragments: int = COUNTED_FRAGMENTS,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``id, own`` (hash of the text), ``n, node`` of every document, and ``node, component`` of the sets that link."""
    rows = docs.select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("own"), F.col(text).alias("text")
    )
    shards = parts_for(text_bytes(rows, "text"))
    sets = written(_sets(rows, n, percent, seed), "sets")
    nodes = sets.filter("n > 0").groupBy("node").agg(
        F.min("id").alias("of"), F.min("check").alias("low"), F.max("check").alias("high")
    )
    if not nodes.filter("low <> high").isEmpty():
        if seed > 8:
            raise RuntimeError("No seed gives distinct digests")
        return set_components(docs, key, text, n, percent, fragments, seed + 1)

    parts = []
    for turn in range(ROUNDS):
        dealt = _shards(rows, n, percent, shards, seed, turn).repartition(shards, "shard")
        parts.append(written(dealt.groupBy("shard").applyInArrow(_shard_members, MEMBERS), "members"))
    members = reduce(DataFrame.unionByName, parts)
    nodes = written(nodes.select("node", "of"), "nodes")

    # Every node of a group with its signature; local pivots are members as well.
    groups = members.select("signature", "node").unionByName(
        members.select("signature", F.col("pivot").alias("node"))
    )
    plain = written(groups.distinct(), "groups")
    discard(*parts)
    sizes = written(plain.groupBy("signature").agg(F.count("*").alias("size")), "group_sizes")
    shared = plain.join(sizes, "signature").groupBy("node").agg(F.sum("size").alias("shared"))
    shared = written(shared, "shared")
    groups = plain.join(shared, "node").select(
        "signature", "node", F.struct(-F.col("shared"), "node").alias("order"), F.lit(True).alias("is_pivot")
    )
    groups = written(groups, "ordered_groups")
    discard(plain, sizes)
    pivot = groups.groupBy("signature").agg(F.min("order").alias("first"))
    pivot = written(pivot, "pivots")
    pairs = groups.join(pivot, "signature").filter(F.col("order") != F.col("first"))
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("first.node").alias("b")).agg(F.count("*").alias("times"))
    pairs = written(pairs, "pairs")
    first = written(pairs.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("times", "b"))["b"].alias("first")), "firsts")
    discard(shared, pivot)
    sketches = sets.join(groups.select("node").distinct(), "node", "left_semi").select("node", "n", "sketch")
    sketches = written(sketches.dropDuplicates(["node"]), "sketches")

    def grams_of(wanted: DataFrame) -> DataFrame:
        return written(_fragment_rows(rows, wanted, n, seed, fragments), "fragments")

    def grams_of_nodes(some: DataFrame) -> DataFrame:
        wanted = nodes.join(some, "node").withColumns(
            {"first": F.lit(None).cast("bigint"), "chosen": F.lit(None).cast("boolean")}
        )
        return grams_of(written(wanted, "wanted"))

    once = _likely_pairs(first.select(F.col("node").alias("a"), F.col("first").alias("b")), sketches, percent)
    once = written(once, "likely_firsts")
    chosen = once.select(F.col("b").alias("node"), F.lit(True).alias("chosen")).distinct()
    wanted = nodes.join(_ends(once), "node").join(once.toDF("node", "first"), "node", "left").join(chosen, "node", "left")
    grams = grams_of(written(wanted.select("node", "of", "first", "chosen"), "wanted"))
    links = written(_verified(grams, percent), "first_links")
    done = components(links)
    discard(links, first, once, grams)
    # Pairs that lie in one component by now need no comparison.
    rest = written(_apart(pairs, done), "rest_pairs")
    discard(pairs)
    parts = [
        written(_likely_pairs(_in_turn(rest, "a", turn), sketches, percent), "likely_pairs") for turn in range(ROUNDS)
    ]
    likely = reduce(DataFrame.unionByName, parts)
    discard(rest)
    if not likely.isEmpty():
        grams = grams_of_nodes(_ends(likely))
        links = written(_verified(grams, percent, likely), "links")
        done = components(_stars_of(done).unionByName(links))
        discard(links, grams)
    discard(*parts)
    members = _undecided(groups, done)
    parts = [
        written(_promising_rows(_in_turn(members, "signature", turn), done, sketches, percent), "promising")
        for turn in range(ROUNDS)
    ]
    promising = reduce(DataFrame.unionByName, parts)
    discard(members, groups, sketches)
    sets = sets.select("id", "own", "n", "node")
    if promising.isEmpty():
        return sets, done
    listed = promising.filter("other IS NOT NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    listed = written(listed.distinct(), "listed_pairs")
    dealt = promising.filter("other IS NULL")
    grams = grams_of_nodes(_ends(listed).unionByName(dealt.select("node")).distinct())
    more = _verified(grams, percent, listed).unionByName(_block_links(dealt, grams, percent))
    more = written(more, "block_links")
    discard(*parts, listed, grams)
    return sets, components(_stars_of(done).unionByName(more))


def _in_turn(rows: DataFrame, column: str, turn: int) -> DataFrame:
    """The rows of one round, dealt by a column."""
    return rows.filter(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(ROUNDS)) == turn)


def _stars_of(done: DataFrame) -> DataFrame:
    return done.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _apart(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that lie in different components."""
    ends = (done.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    for c, end in zip("ab", ends):
        pairs = pairs.join(end, c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    return pairs.filter("of_a <> of_b").select("a", "b")


def _with_component(groups: DataFrame, done: DataFrame) -> DataFrame:
    joined = groups.join(done, "node", "left")
    return joined.withColumn("component", F.coalesce("component", "node"))


def _spans(groups: DataFrame, done: DataFrame) -> DataFrame:
    """``signature, low, high, pivots``: whether a group lies in one component, and its possible pivots."""
    return _with_component(groups, done).groupBy("signature").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("is_pivot").alias("pivots")
    )


def _differing(sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of similar sets of these sizes."""
    return (sizes + others) * (100 - percent) // (100 + percent)


def _sketch(own: np.ndarray, percent: int) -> bytes:
    """One bit for each of many fine fragments of a set: whether it holds an odd number of n-grams.

    Each n-gram that two sets do not share turns one bit, so similar sets agree on all but as many bits
    as they may differ in n-grams. There are at least four times as many, of which other sets differ in
    about half. Neighbouring bits can be added up to halve their number.
    """
    wanted = 4 * int(_differing(np.int64(len(own)), np.int64(len(own)), percent)) + 1
    bits = int(np.clip(wanted.bit_length(), LEAST_SKETCH_BITS, MOST_SKETCH_BITS))
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _stacked(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def _halved(sketches: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(sketches, axis=1)
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)


def _turned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ, over the last axis."""
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(-1, dtype=np.int64)


def _likely_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that their sketches allow to be similar; others send no n-grams."""
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch[c].to_numpy() for c in ("n_a", "n_b"))
            first, second = (np.array(batch[c].to_pylist(), object) for c in ("s_a", "s_b"))
            lengths = [np.fromiter(map(len, s), np.int64, len(s)) for s in (first, second)]
            close = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            kept = np.zeros(len(n), bool)
            for pair in np.unique(np.stack(lengths)[:, close], axis=1).T:
                own = np.flatnonzero(close & (lengths[0] == pair[0]) & (lengths[1] == pair[1]))
                x, y = _stacked(list(first[own])), _stacked(list(second[own]))
                while x.shape[1] > y.shape[1]:
                    x = _halved(x)
                while y.shape[1] > x.shape[1]:
                    y = _halved(y)
                kept[own] = _turned(x, y) <= _differing(n[own], m[own], percent)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return joined.mapInArrow(agreeing, "a bigint, b bigint")


def _compared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of a block pair are to be compared: across blocks or, in one block, all; not inside a component."""
    block, component = table["block"].to_numpy(), table["component"].to_numpy()
    pairs = component[:, None] != component
    if table["low"][0].as_py() != table["high"][0].as_py():
        pairs &= block[:, None] != block
    return pairs, table["node"].to_numpy()


def _promising(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The pairs ``node, other`` of a block pair that may be similar by their sketches; if many, their rows without ``other``."""
        pairs, _ = _compared(table)
        sizes = table["n"].to_numpy()
        small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
        pairs &= 100 * small >= percent * large
        sketches = table["sketch"].to_pylist()
        lengths = np.array([len(s) for s in sketches])
        likely = np.zeros(pairs.shape, bool)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            x = _stacked([sketches[i] for i in own])
            for wider in (length, 2 * length):
                other = np.flatnonzero(lengths == wider)
                if not len(other) or not pairs[np.ix_(own, other)].any():
                    continue
                y = _stacked([sketches[i] for i in other])
                if wider > length:
                    y = _halved(y)
                step = max(1, SKETCH_CELLS // (len(other) * int(length)))
                for at in range(0, len(own), step):
                    rows = own[at : at + step]
                    turned = _turned(x[at : at + step, None], y)
                    differ = turned <= _differing(sizes[rows][:, None], sizes[other], percent)
                    likely[np.ix_(rows, other)] = differ & pairs[np.ix_(rows, other)]
        likely |= likely.T
        first, second = np.nonzero(np.triu(likely))
        columns = ["signature", "low", "high", "block", "node", "component"]
        if len(first) <= LISTED_PAIRS * len(sizes):
            found = table.select(columns).take(pa.array(first))
            return found.append_column("other", table["node"].take(pa.array(second)))
        found = table.select(columns).filter(pa.array(likely.any(1)))
        return found.append_column("other", pa.nulls(len(found), pa.int64()))

    return run


def _counted(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """A node of the same connected part for each row of a block pair that has a link.

        Overlaps are counted fragment by fragment, as products of the rows' incidence with its
        n-grams, and summed per pair.
        """
        pairs, nodes = _compared(table)
        parts = [[np.frombuffer(p, np.uint64) for p in row] for row in table["parts"].to_pylist()]
        own = [np.sort(np.concatenate(p)) for p in parts]
        sizes = np.array([len(g) for g in own])
        everything = np.concatenate(own)
        holder = np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(everything, kind="stable")
        everything, holder = everything[order], holder[order]
        column = np.cumsum(np.concatenate([[0], everything[1:] != everything[:-1]])) if len(everything) else holder
        both = np.zeros(pairs.shape, np.float64)
        width = max(1, INCIDENCE_CELLS // len(own))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, [first, first + width])
            held = np.zeros((len(own), width), np.float32)
            held[holder[low:high], column[low:high] - first] = 1
            both += held @ held.T
        union = sizes[:, None] + sizes - both
        hit = pairs & (100 * both >= percent * union)
        root = np.arange(len(nodes))
        while True:
            new = np.minimum(root, np.where(hit, root, len(root)).min(1, initial=len(root)))
            new = new[new]
            if (new == root).all():
                break
            root = new
        linked = root != np.arange(len(nodes))
        return pa.table({"a": nodes[linked], "b": nodes[root[linked]]})

    return run


def _undecided(groups: DataFrame, done: DataFrame) -> DataFrame:
    """``signature, node, blocks`` of the groups that still lie in several components; those with the same members are one."""
    # The other member of a group of two has met its pivot.
    spans = _spans(groups, done).filter("low < high AND pivots > 2").select("signature")
    members = written(groups.select("signature", "node").join(spans, "signature"), "undecided")
    names = [F.xxhash64("node", F.lit(i)) for i in range(3)]
    same = members.groupBy("signature").agg(
        F.count("*").alias("size"), *[F.bit_xor(name).alias(f"h{i}") for i, name in enumerate(names)]
    )
    one = same.groupBy("size", "h0", "h1", "h2").agg(F.min("signature").alias("signature"))
    blocks = F.ceil(F.col("size") / BLOCK_SETS)
    found = written(members.join(one.select("signature", blocks.alias("blocks")), "signature"), "undecided_once")
    discard(members)
    return found


def _promising_rows(members: DataFrame, done: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The members of undecided groups that may be similar to others there, as pairs or by block pairs.

    Groups are cut into blocks, and the rows of two blocks are compared with each other at once.
    """
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = _with_component(members, done).join(sketches, "node")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    columns = ["block", "node", "component", "n", "sketch"]
    dealt = members.select("signature", *columns, other)
    dealt = dealt.select("signature", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *columns)
    schema = "signature bigint, low bigint, high bigint, block bigint, node bigint, component bigint, other bigint"
    return dealt.groupBy("signature", "low", "high").applyInArrow(_promising(percent), schema)


def _block_links(promising: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """``a, b``: connections among the promising members of block pairs, by their n-grams.

    What comes out is a forest of a block pair, not its pairs.
    """
    whole = grams.groupBy("node").agg(F.collect_set("grams").alias("parts"))
    compared = promising.join(whole, "node").groupBy("signature", "low", "high").applyInArrow(_counted(percent), "a bigint, b bigint")
    return compared.distinct()


def _labelled(docs: DataFrame, key: str, text: str, options: dict) -> DataFrame:
    with small_batches(docs.sparkSession), swept_shuffles(docs.sparkSession):
        sets, done = set_components(docs, key, text, **options)
    labelled = sets.join(done, "node", "left")
    return written(
        labelled.select("id", "own", "n", F.coalesce("component", "node").alias("component")), "labelled"
    )


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id, n_shingles, component_id`` of every document."""
    labelled = _labelled(docs, key, text, options)
    least = labelled.filter("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    least = written(least, "least_ids")
    own = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return labelled.join(least, "component", "left").select(
        "id", F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document of each group with the smallest id (null last); of rows equal in id and text one stays."""
    labelled = _labelled(docs, key, text, options)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "own"))
    grouped = labelled.filter("n > 0").groupBy("component").agg(first.alias("kept"))
    kept = grouped.select(F.col("kept.id").alias("_kept"), F.col("kept.own").alias("_text")).unionByName(
        labelled.filter("n = 0").select(F.col("id").alias("_kept"), F.col("own").alias("_text")).distinct()
    )
    # Null ids are equal here; join and window name the same columns, so rows are shuffled once.
    same = ["_known", "_id", "_own"]

    def keyed(rows: DataFrame, key: Column, own: Column, *others: Column) -> DataFrame:
        return rows.select(key.isNotNull().alias("_known"), F.coalesce(key, F.lit(0)).alias("_id"), own.alias("_own"), *others)

    rows = keyed(docs, F.col(key).cast("bigint"), F.xxhash64(text), F.struct("*").alias("row"))
    kept = keyed(written(kept, "kept"), F.col("_kept"), F.col("_text"))
    repeated = Window.partitionBy(*same).orderBy("_id")
    joined = rows.join(kept, same, "left_semi")
    return joined.withColumn("_copy", F.row_number().over(repeated)).filter("_copy = 1").select("row.*")
