import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, differences, duckdb_result, spark_result
from tests.llm import brute
from tripwise.llm import components, queries, urls, vectors, warc
from tripwise.llm.tables import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_result_as_duckdb(spark, name):
    found = spark_result(queries.QUERIES[name](spark, SF_DIR))
    assert differences(found, duckdb_result(connect(SF_DIR), queries.ORACLE_SQL[name])) == ""


def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.partition("://")[2]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end].translate(brute.UPPER), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h + p), h + p, v)
        for h, p, v in urls.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return host, path, max(fits)[1:] if fits else None


def test_urls_follow_the_rules(spark):
    odd = [
        (1, None),
        (2, ""),
        (3, "no scheme"),
        (4, "http://ORG/x"),
        (5, "http://Sub.Example.ORG/es/1?a=1&b=2#z"),
        (6, "http://example.org/en/12"),
        (7, "http://notexample.org/es/"),
        (8, "ftp://x.com"),
        (9, "http://x.com?q=/de/"),
        (10, "http://x.com/de/" + "ä1-" * 20_000),
        (10, "http://x.com/fr/"),
        (None, "http://a.net/b\nc"),
        (11, "a://b://c.com/fr/x"),
    ]
    df = spark.createDataFrame(odd, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    found = urls.judged_urls(df)
    own = sorted(map(tuple, found.select("key", "host", "path", "rule", "verdict").collect()), key=repr)
    assert len(own) == len(odd)
    wanted = []
    for key, url in odd:
        host, path, rule = judged(url)
        wanted.append((key, host, path, *(rule or (None, None))))
    for a, b in zip(own, sorted(wanted, key=repr)):
        assert a[:4] == b[:4] and a[4] in ("allow", "block") and (b[4] is None or a[4] == b[4])
    one_class = urls.judged_urls(df.filter("page_id = 4"))
    assert one_class.first()["verdict"] == "allow"
    assert urls.judged_urls(df.limit(0)).count() == 0


def test_trees_learn_what_rules_say(spark):
    """Trees fitted on half of the labelled URLs, against the rules on the other half."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").filter("url IS NOT NULL")
    n = urls.judged_urls(pages).filter("rule IS NOT NULL").count()
    known = urls.judged_urls(pages, train_urls=n // 2).filter("rule IS NOT NULL")
    known = known.join(pages.select(F.col("page_id").alias("key"), "url"), "key")
    unseen = known.filter(~urls.is_fitted("url", (n // 2) / n, 42))
    total = unseen.count()
    agree = unseen.filter((F.col("score") >= 0.5) == (F.col("verdict") == "block")).count()
    assert n // 4 < total < 3 * n // 4 and agree >= 0.9 * total


def test_scores_do_not_depend_on_the_layout(spark):
    """More labelled URLs than Spark ML takes split candidates from without drawing."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").filter("url IS NOT NULL")
    many = pages.crossJoin(spark.range(24).withColumnRenamed("id", "k"))
    many = many.select((F.col("page_id") * 24 + F.col("k")).alias("page_id"), F.concat("url", F.lit("/"), F.col("k").cast("string")).alias("url"))
    found = [
        {(r["key"], r["score"]) for r in urls.judged_urls(many.repartition(n)).select("key", "score").collect()} for n in (3, 8)
    ]
    assert found[0] == found[1] and len(found[0]) == many.count()


def fake_record(n):
    return f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n"


@pytest.mark.parametrize("split", [64, 300, 10_000_000])
def test_archives_round_trip(spark, split):
    pages = [
        (1, "http://a/", "x" * 100),
        (2, None, "x" * 100),
        (3, "http://a/\r\nWARC/1.1", "y" * 99),
        (4, "http://a/", "y" * 99),
        (5, "u", None),
        (6, "u", ""),
        (7, "u", "ü" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n"),
        (8, "u", f"a\r\n{fake_record(5)}hello\r\n\r\n{fake_record(3)}abc\r\n\r\n"),
        (9, "u", f"\r\n{fake_record(100000)}"),
        (10, "u", "\r\nWARC/1." * 30),
        (11, "u", "WARC/1.1\r\n"),
        (12, "u", "z\r\n" * 400),
        (12, "u", "z\r\n" * 400),
        (13, "u", "z\r\n" * 400),
        (None, "u", "z\r\n" * 400),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.archive_pages(df.coalesce(2)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = []
    for key, _, html in pages:
        raw = (html or "").encode()
        same = [k for k, _, h in pages if (h or "").encode() == raw and k is not None]
        revisit = len(raw) >= 100 and key != min(same)
        wanted.append(
            (key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None)
        )
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    pairs += [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    found = components.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    wanted = brute.groups({n for p in pairs for n in p}, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in found.collect()} == {n: wanted[n] for n in linked}


def vector_rows():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    rows = [*base]
    for size in (0.05, 0.1, 0.15):
        rows += [b + size * rng.normal(size=16) for b in base[:30]]
    rows += [base[0] + 0.08 * rng.normal(size=16) for _ in range(200)]
    rows += [base[1]] * 50
    return [(k, [float(x) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("block", [16, 4096])
def test_vectors_against_brute_force(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    found = {r["row"]["vec_id"]: r for r in vectors.linked_vectors(df, block=block).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    counts = np.array([found[k]["n_links"] for k in range(len(rows))])
    assert (counts <= hit.sum(1)).all() and counts.sum() >= 0.97 * hit.sum()
    wanted = brute.groups(range(len(rows)), zip(*np.nonzero(hit)))
    same = sum(found[k]["component_id"] == wanted[k] for k in wanted)
    assert same >= 0.97 * len(rows)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in found.items())


def linked_partners(spark, hot, partners, **options):
    """The share of the partners at cosine 0.91 that get into one component; the first ``hot`` rows are near copies."""
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(size=(n, 32))
    x[:hot] = x[0] + 0.001 * rng.normal(size=(hot, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    first, second = np.arange(hot, hot + partners), np.arange(n - partners, n)
    away = rng.normal(size=(partners, 32))
    away -= (away * x[first]).sum(1)[:, None] * x[first]
    x[second] = 0.91 * x[first] + (1 - 0.91**2) ** 0.5 * away / np.linalg.norm(away, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>").repartition(8)
    found = vectors.linked_vectors(df, **options).select("row.vec_id", "component_id").collect()
    own = {r["vec_id"]: r["component_id"] for r in found}
    return np.mean([own[a] == own[b] for a, b in zip(first.tolist(), second.tolist())])


def test_a_hot_group_does_not_set_the_visits_of_others(spark):
    assert linked_partners(spark, hot=2000, partners=1000) >= 0.97


def test_visits_without_pairs_in_the_sample(spark):
    assert linked_partners(spark, hot=0, partners=300, sample_queries=1) >= 0.97


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]),
        (2, [2.0, 0.0]),
        (2, [0.0, 1.0]),
        (3, None),
        (4, [0.0, 0.0]),
        (5, [nan, 1.0]),
        (6, [inf, 1.0]),
        (7, [None, 1.0]),
        (8, [1.0, 0.0, 0.0]),
        (None, [1.0, 0.0]),
        (9, [1.0, 0.0]),
        (9, [1.0, 0.0]),
        (10, []),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("n", F.lit(0))
    found = vectors.linked_vectors(df).collect()
    assert len(found) == len(rows)
    links = sorted((r["row"]["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in found)
    assert links == sorted(
        [(0, 0, 0), (1, 3, 1), (2, 3, 1), (2, 0, 2), (9, 3, 1), (9, 3, 1)]
        + [(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 10)]
    )
    assert vectors.linked_vectors(df.limit(0)).count() == 0
    assert vectors.linked_vectors(df.filter("vec_id = 4")).first()["n_links"] == 0


def near_copies():
    """Texts with scattered new words or appended ones, at similarities around 0.8 and 0.9."""
    rng = np.random.default_rng(11)
    texts = []
    for size in (60, 300, 900):
        for share in (0.01, 0.015, 0.02, 0.022, 0.025, 0.03):
            base = [f"s{size}_{share}_{i}" for i in range(size)]
            own = list(base)
            for at in rng.choice(size, max(1, round(share * size)), replace=False):
                own[at] = f"n{rng.integers(1 << 40)}"
            texts += [" ".join(base), " ".join(own)]
        for share in (0.05, 0.12, 0.22, 0.26):
            base = [f"b{size}_{share}_{i}" for i in range(size)]
            more = [f"m{rng.integers(1 << 40)}" for _ in range(round(share * size))]
            texts += [" ".join(base), " ".join(base + more)]
    return texts


def test_near_copy_stage_against_brute_force(spark):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = [brute.shingles(t, 5) for t in texts]
    links = brute.jaccard_links(sets, 80)
    assert len(links) > len(brute.jaccard_links(sets, 90)) + 10
    kept = corpus_pipeline.keep_one_of_each_group(spark, df, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute.groups(range(len(texts)), links).values()))


def test_vectors_of_two_lengths_are_compared_with_their_own(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.01])]
    rows += [(6, []), (7, [5e-324, 0.0]), (8, [1e300, 1e299, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.linked_vectors(df).select("row.vec_id", "n_links", "component_id").collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (0, 6), 7: (2, 1), 8: (2, 4)}


def test_sparse_links_are_found_by_the_grid(spark):
    """Forty pairs of cosine 0.91 among 5,000 unclustered vectors, beside a hot group of a third."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(40):
        away = rng.normal(size=32)
        away -= away @ x[i] * x[i]
        x[i + 100] = 0.91 * x[i] + (1 - 0.91**2) ** 0.5 * away / np.linalg.norm(away)
    x[3000:] = x[3000] + 0.01 * rng.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in vectors.linked_vectors(df, block=256).select("row.vec_id", "n_links").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    linked = np.flatnonzero(true)
    share = np.array([found[i] / true[i] for i in linked])
    assert share.max() <= 1 and share[linked < 3000].mean() >= 0.9 and share[linked >= 3000].mean() >= 0.9
    assert len(linked) >= 2080


def test_codebooks_visit_nearest_cells_first():
    rng = np.random.default_rng(9)
    grid = vectors.Grid(rng.normal(size=(500, 8)), 7)
    x = rng.normal(size=(5, 8))
    first, second = grid.distances(x)
    for a, b, cells in zip(first, second, grid.visits(x, 49)):
        sums = [a[c // 7] + b[c % 7] for c in cells]
        assert sorted(cells) == list(range(49)) and sums == sorted(sums)
    target = rng.integers(0, 49, 5)
    ranks = vectors._ranks(grid, x, target)
    wanted = [list(cells).index(t) + 1 for cells, t in zip(grid.visits(x, 49), target)]
    assert ranks.tolist() == wanted
