"""Prefix trie, spelling variants and nearest neighbours against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tripwise.llm import nearest, prefix_trie, spelling

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    """Nodes of the rebuilt conversations of ``rows``, by the contract."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(
            key=lambda t: (
                (t[0] is not None, t[0] or 0),
                hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest(),
            )
        )
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = own.get(conv - (conv % 5 if conv >= 0 else -(-conv % 5)), [])
        rebuilt[conv] = tuple(t[1:] for t in [*base[:h], *turns[h:]])
    members = defaultdict(set)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(conv)
    out = set()
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, digest))
    return out


def found_trie(df, chunk_turns=prefix_trie.CHUNK_TURNS):
    rebuilt, convs = prefix_trie.crossed(prefix_trie.ordered_turns(df))
    nodes = prefix_trie.prefix_trie(rebuilt, convs, chunk_turns).drop("digest").collect()
    assert len(nodes) == len({tuple(r) for r in nodes})
    return {tuple(r) for r in nodes}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(-6, 25)),
            st.one_of(st.none(), st.integers(0, 12)),
            st.sampled_from([None, "", "user", "assistant"]),
            st.sampled_from([None, "", "a", "ab", "é"]),
        ),
        max_size=150,
    )
)
def test_trie_equals_its_definition(spark, rows):
    assert found_trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_trie_of_copies_long_conversations_and_odd_rows(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 60, 5) for t in range(4)]
    rows += [(1000, t, "user", str(t % 7)) for t in range(120)]
    rows += [(1001, t, "user", str(t % 7)) for t in range(130)]
    rows += [(3, None, "user", "x"), (3, None, "user", "x"), (None, 1, "user", "x"), (7, 5, None, None)]
    rows += [(9, 1, "a", "bc"), (14, 1, "ab", "c"), (20, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("digest", F.lit("clash")).withColumn("pos", F.lit(1))
    wanted = plain_trie(rows)
    assert found_trie(df) == wanted
    assert found_trie(df.repartition(13), chunk_turns=16) == wanted
    assert found_trie(df.limit(0)) == set()


def plain_variants(rows):
    """Rows of the contract for ``(doc_id, text)``."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    partners = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(partners[w]), form[w], words.get(form[w]), root))
    return out


def found_variants(df, **options):
    got = spelling.spelling_groups(df, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len({r["word"] for r in got})
    return {tuple(r) for r in got}


def misspelt(seed, alphabet, count):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=rng.randint(4, 9))) for _ in range(20)]
    words = []
    for _ in range(count):
        word = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = rng.choices(alphabet, k=rng.randint(0, 1))
        words.append("".join(word))
    return words


@pytest.mark.parametrize("alphabet, group_chars", [("abc", 200_000), ("ab", 40), ("abÀÿ×", 200)])
def test_variants_equal_brute_force(spark, alphabet, group_chars):
    rows = [(i, " ".join(misspelt(i, alphabet, 400))) for i in range(8)]
    rows += [(None, "Hello hello HELLO hellO0hello"), (5, None), (6, ""), (7, "hell' hellos, hellos hellos")]
    rows += [(9, ("a" * 3000 + " ") * 5 + ("a" * 3001 + "\n") * 9 + ("b" + "a" * 3000 + ".") * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert found_variants(df, group_chars=group_chars) == plain_variants(rows)


def test_variants_of_words_with_one_beginning(spark):
    """More words than a group holds share one half; the halves are cut and no pair is lost."""
    rng = random.Random(5)
    words = {"same" * 3 + "".join(rng.choices("abcdef", k=4)) for _ in range(500)}
    rows = [(1, " ".join(list(words) * 4))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = plain_variants(rows)
    assert sum(r[2] for r in wanted) > 1000
    assert found_variants(df, group_chars=300) == wanted
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_acceptor_is_minimal():
    """Twelve words of one length, all endings alike: a chain of states."""
    acceptor = spelling.Acceptor()
    first = acceptor.compiled(sorted(a + b + "xyz" for a in "abc" for b in "defg"))
    assert len(acceptor.arcs) == 6 and acceptor.sizes[first] == 12
    assert len(acceptor.replacements(first)) == 12 * 5 // 2


def plain_neighbours(rows, every, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and any(v) and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, v in rows:
        if i % every == 0:
            others = []
            for j, w in rows:
                if (j, w) != (i, v) and len(w) == len(v):
                    total = 0.0
                    for a, b in zip(v, w):
                        total += (a - b) * (a - b)
                    others.append((math.sqrt(total), j))
            out |= {(i, r, j, d) for r, (d, j) in enumerate(sorted(others)[:k], 1)}
    return out


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1040)] + [(i, rng.normal(size=3).tolist()) for i in range(2000, 2012)]
    rows += [(10, rows[3][1]), (20, rows[20][1]), (20, rows[20][1]), (30, [0.0] * 6), (40, None), (50, [])]
    rows += [(60, [1.0, float("nan")]), (70, [float("inf")]), (80, [None, 1.0]), (None, rows[1][1]), (90, [5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.withColumn("class", F.lit("clash")).withColumn("v", F.lit(0))
    asks = F.col("id") % 10 == 0
    found = nearest.nearest_vectors(df, asks).collect()
    assert {tuple(r) for r in found} == plain_neighbours(rows, 10, 10) and len(found) == len(set(found))
    assert nearest.nearest_vectors(df.limit(0), asks).count() == 0


def test_small_windows_keep_their_places_across_partitions(spark):
    """With windows as wide as the table every block layout finds all neighbours."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7)
    rows_, asks = nearest.usable(df, "vec_id", "embedding"), F.col("id") % 20 == 0
    classes, _ = nearest.vector_classes(rows_, asks)
    curves = nearest.fit_curves(classes)
    everything = nearest.window_candidates(classes, curves, 400, 400, block=16)
    assert everything.count() == 20 * 400
    some = nearest.window_candidates(classes, curves, 10, 400, block=16).groupBy("query").count()
    counts = [r["count"] for r in some.collect()]
    assert len(counts) == 20 and min(counts) >= 21 and max(counts) < 400


def test_window_reaches_the_recall(spark):
    """Clustered vectors, a third of them in one cluster of near copies."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 16))
    x = middles[np.where(rng.random(6000) < 1 / 3, 0, rng.integers(0, 40, 6000))] + 0.05 * rng.normal(size=(6000, 16))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest.nearest_vectors(df, F.col("id") % 50 == 0)
    got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    d = ((x[::50, None] - x) ** 2).sum(2)
    true = {(50 * q, int(j)) for q, row in enumerate(d) for j in np.argsort(row)[1:11]}
    assert len(got & true) >= 0.9 * len(true)


def test_hilbert_keys_visit_every_cell_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = nearest.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
