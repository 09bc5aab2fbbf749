import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from tests.plans import plan_of
from tripwise.catalog import queries
from tripwise.functions.text import (
    ENGLISH_STOP_WORDS,
    clean_text,
    drop_stop_words,
    tokens,
    with_counts,
    with_terms,
    word_ngrams,
)
from tripwise.operators import sentiment, tfidf
from tripwise.plans.review_sentiment import review_sentiment
from tripwise.sources.reviews import synthetic_reviews
from tripwise.sources.shared import written

TEXTS = [
    "",
    "   ",
    "?!",
    "x",
    "Great PHONE, great phone!",
    "See HTTP://A.example/Path?q=1 or www.b.example now",
    "thanks @Some_One2 and a@b",
    "z http://q now",
    "tab\tand wide\nspaces",
    "Élan vital",
    "the broken items and the broken items",
]


def cleaned_by_hand(text):
    text = text.lower()
    for pattern in (r"http\S+|www\.\S+", r"@[A-Za-z0-9_]+", r"[^a-z0-9\s]", r"\s+"):
        text = re.sub(pattern, " ", text)
    return text.strip()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def clean_all(spark, texts):
    rows = frame(spark, texts).select("doc_id", clean_text("text").alias("c")).orderBy("doc_id")
    return [r["c"] for r in rows.collect()]


def test_cleaning(spark):
    assert clean_all(spark, TEXTS) == [cleaned_by_hand(t) for t in TEXTS]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.text(st.sampled_from("ab1_@.:/ htpw \u0085 　\x1c\té–😀"), max_size=40),
        min_size=20,
        max_size=60,
    )
)
def test_cleaning_of_odd_characters(spark, texts):
    assert clean_all(spark, texts) == [cleaned_by_hand(t) for t in texts]


def test_stop_words_are_the_ones_spark_ships(spark):
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens_and_stop_words_keep_order_and_repetitions(spark):
    df = frame(spark, ["the a big dog and x big cat"])
    df = df.withColumn("t", tokens(clean_text("text")))
    row = df.select("t", drop_stop_words("t").alias("kept"), drop_stop_words("t", []).alias("all")).first()
    assert row["t"] == ["the", "big", "dog", "and", "big", "cat"]
    assert row["kept"] == ["big", "dog", "big", "cat"]
    assert row["all"] == row["t"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(spark, n):
    words = [[], ["one"], ["one", "two"], ["one", "two", "three", "four"]]
    df = spark.createDataFrame([(w,) for w in words], "words array<string>")
    found = [r[0] for r in df.select(word_ngrams("words", n)).collect()]
    assert found == [[" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for w in words]


def tfidf_by_hand(texts, min_df, max_df):
    counts = []
    for text in texts:
        words = [w for w in cleaned_by_hand(text).split() if len(w) > 1 and w not in ENGLISH_STOP_WORDS]
        counts.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    n, df = len(texts), Counter(t for c in counts for t in c)
    idf = {
        t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if d >= min_df and d <= max_df * n
    }
    rows = defaultdict(float)
    for i, c in enumerate(counts):
        length = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items() if t in idf))
        for t, k in c.items():
            if t in idf:
                rows[i, t] = k * idf[t] / length
    return rows


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "ab", "", "é", None]))), min_size=1))
def test_counts_inside_the_row(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, terms array<string>")
    counted = with_counts(df, "terms", "counts")
    assert "Exchange" not in plan_of(counted)
    for r in counted.collect():
        wanted = sorted(Counter(t for t in r["terms"] or [] if t is not None).items())
        assert [tuple(c) for c in r["counts"] or []] == wanted


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_tfidf_by_broadcast_and_by_shuffle(spark, threshold):
    texts = TEXTS + ["great items", "broken phone great", "phone broken items", "great"]
    docs = tfidf.term_vectors(with_terms(frame(spark, texts)), "doc_id")
    model = tfidf.fit_tfidf(docs, "counts.term", min_df=2, max_df=0.3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        weights = model.transform(docs, "doc_id")
        found = {(r["doc_id"], r["term"]): r["tfidf"] for r in weights.collect()}
        assert ("BroadcastHashJoin" in plan_of(weights)) == (threshold == "10MB")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == pytest.approx(dict(tfidf_by_hand(texts, 2, 0.3)))
    assert model.n_terms == model.vocabulary.count()


def test_large_vocabularies_are_hashed_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "HASHED_TERMS", 1)
    texts = TEXTS + ["great items", "broken phone great", "phone broken items", "great"]
    docs = tfidf.term_vectors(with_terms(frame(spark, texts)), "doc_id")
    weights = tfidf.fit_tfidf(docs, "counts.term", min_df=2, max_df=0.3).transform(docs, "doc_id")
    assert "ShuffledHashJoin" in plan_of(weights) and "SortMergeJoin" not in plan_of(weights)
    found = {(r["doc_id"], r["term"]): r["tfidf"] for r in weights.collect()}
    assert found == pytest.approx(dict(tfidf_by_hand(texts, 2, 0.3)))


def test_tfidf_in_rounds(spark, monkeypatch):
    """Shuffle files of a round go before the next; rows with the same key or none stay in one round."""
    standing, measured = [], tfidf.TfidfModel._measured

    def watched(self, vectors, key):
        standing.append(spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size())
        return measured(self, vectors, key)

    texts = TEXTS + ["great items", "broken phone great", "phone broken items", "great"] * 9
    docs = with_terms(frame(spark, texts)).withColumn("doc_id", F.expr("nullif(doc_id % 20, 7)"))
    vectors = tfidf.term_vectors(docs, "doc_id")
    once = tfidf.fit_tfidf(docs)
    model = tfidf.fit_tfidf(docs, rounds=2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(tfidf.TfidfModel, "_measured", watched)
    try:
        found = model.transform_in_rounds(vectors, "doc_id", 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(standing) == 5 and standing == sorted(standing, reverse=True)
    assert "Exchange" not in plan_of(found)

    def rows(df):
        return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rows(model.vocabulary) == rows(once.vocabulary) and model.n_terms == once.n_terms
    assert rows(found) == rows(once.transform(vectors, "doc_id"))


def test_tfidf_query_works_in_rounds(spark, tmp_path, monkeypatch):
    texts = TEXTS + ["great items", "broken phone great", "phone broken items", "great"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    whole = queries.document_tfidf(spark, str(tmp_path))
    monkeypatch.setattr(tfidf, "ROUND_BYTES", 1)
    monkeypatch.setattr(tfidf, "MOST_ROUNDS", 3)
    rounds = queries.document_tfidf(spark, str(tmp_path))
    assert "Exchange" not in plan_of(rounds)
    wanted = {k: round(v, 6) for k, v in tfidf_by_hand(texts, 2, 0.85).items()}
    for weights in (whole, rounds):
        assert {(r["doc_id"], r["term"]): r["tfidf"] for r in weights.collect()} == pytest.approx(wanted, abs=2e-6)


def test_terms_are_counted_and_weighted_without_moving_texts(spark):
    docs = with_terms(frame(spark, TEXTS))
    assert "Exchange" not in plan_of(tfidf.term_counts(docs, "doc_id"))
    plan = plan_of(tfidf.fit_tfidf(docs).transform(tfidf.term_vectors(docs, "doc_id"), "doc_id"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan
    shuffled = plan.split("Exchange hashpartitioning")[1].splitlines()[1]
    assert "Project" in shuffled and "text" not in shuffled


def test_reviews_are_balanced_and_repeatable(spark):
    reviews = synthetic_reviews(spark, 400)
    rows = reviews.orderBy("review_id").collect()
    assert Counter(r["sentiment"] for r in rows) == {"positive": 200, "negative": 200}
    assert rows == synthetic_reviews(spark, 400).repartition(7).orderBy("review_id").collect()
    assert rows != synthetic_reviews(spark, 400, seed=1).orderBy("review_id").collect()
    assert not any("{" in r["text"] for r in rows)
    for r in rows:
        words = cleaned_by_hand(r["text"]).split()
        if words[0] == "such":
            first, second = words[2], words[4]
            assert first != second
            lexicon = sentiment.REVIEW_LEXICON
            assert lexicon[first] == lexicon[second] == (1.0 if r["sentiment"] == "positive" else -1.0)


def polar(spark, words, lexicon):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, words array<string>")
    table = sentiment.lexicon_table(spark, lexicon)
    rows = sentiment.text_polarity(df, "id", "words", table).orderBy("id").collect()
    return [r["polarity"] for r in rows]


def test_polarity_and_classes(spark):
    words = [["great", "great", "bad"], ["bad"], ["table"], ["great", "bad"], [], None]
    found = polar(spark, words, sentiment.REVIEW_LEXICON)
    assert found == pytest.approx([1 / 3, -1, 0, 0, 0, 0])
    graded = polar(spark, words, {"great": 0.8, "bad": -0.5, "table": float("inf")})
    assert graded == pytest.approx([(0.8 * 2 - 0.5) / 3, -0.5, 0, 0.15, 0, 0])
    df = spark.createDataFrame([(0.1,), (0.0,), (-0.2,)], "p double")
    classes = [r[0] for r in df.select(sentiment.sentiment_class("p")).collect()]
    assert classes == ["Positive", "Neutral", "Negative"]


def test_plan_of_polarity_does_not_grow_with_the_lexicon(spark):
    df = spark.createDataFrame([(1, ["w1", "w7"])], "id int, words array<string>")
    plans, found = set(), []
    for size in (10, 10_000):
        rows = spark.range(size).selectExpr("concat('w', id) AS word", "id / 100 AS polarity")
        scored = sentiment.text_polarity(df, "id", "words", written(rows, "lexicon"))
        plans.add(len(plan_of(scored).splitlines()))
        found.append(scored.first()["polarity"])
        assert "Exchange" in plan_of(scored) and "words" not in plan_of(scored).split("Exchange")[1].splitlines()[0]
    assert len(plans) == 1 and found == [0.04, 0.04]


def test_learned_lexicon(spark):
    rows = [(["good", "good", "film"], True)] * 6 + [(["bad", "film"], False)] * 6 + [(["rare"], True), (None, False), (["film"], None)]
    df = spark.createDataFrame(rows, "words array<string>, up boolean")
    found = {r["word"]: r["polarity"] for r in sentiment.learned_lexicon(df, "words", F.col("up")).collect()}
    p, q = 7 / 9, 1 / 9
    assert found == {"good": pytest.approx((p - q) / (p + q)), "bad": pytest.approx((q - p) / (p + q))}
    assert sentiment.learned_lexicon(df.limit(0), "words", F.col("up")).count() == 0


def g2(a, b, c, d):
    """Log-likelihood ratio of a of c against b of d."""
    share = (a + b) / (c + d)
    return 2 * sum(n * math.log(n / (size * share)) for n, size in ((a, c), (b, d)) if n)


def test_phrases_mark_a_class_rather_than_being_frequent(spark):
    rows = [("p", ["fast delivery"] * 6 + ["the item"] * 20)] + [("n", ["the item"] * 25 + ["broken items"] * 3 + ["late"])]
    df = spark.createDataFrame(rows + [(None, ["the item"])], "c string, phrases array<string>")
    top = sentiment.class_phrases(df, "c", "phrases", k=2)
    found = {(r["c"], r["rank"]): (r["phrase"], r["n"], r["g2"]) for r in top.collect()}
    assert found["p", 1] == ("fast delivery", 6, pytest.approx(g2(6, 0, 26, 30), abs=1e-6))
    assert found["n", 1] == ("broken items", 3, pytest.approx(g2(3, 0, 29, 27), abs=1e-6))
    assert found[None, 1] == ("the item", 1, pytest.approx(g2(1, 45, 1, 55), abs=1e-6))
    assert ("p", 2) not in found
    assert "WindowGroupLimit" in plan_of(top)


def test_phrases_are_counted_once_and_only_if_asked_for(spark):
    """Scores and classes need no phrases; the counts are one shuffle that sizes and totals read again."""
    refused = "CASE WHEN id < 9 THEN raise_error('counted') ELSE 'x' END"
    df = spark.range(9).selectExpr("'c' AS c", f"array(CAST({refused} AS STRING)) AS phrases")
    sentiment.class_phrases(df, "c", "phrases")
    rows = [("p", ["fast delivery"] * 6 + ["the item"]), ("n", ["the item"] * 9)]
    top = sentiment.class_phrases(spark.createDataFrame(rows, "c string, phrases array<string>"), "c", "phrases")
    assert sorted(tuple(r)[:3] for r in top.collect()) == [("n", "the item", 9), ("p", "fast delivery", 6)]
    final = plan_of(top).split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1


def test_texts_are_dealt_out_before_they_are_cleaned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "written", lambda df, name: seen.append(plan_of(df)) or df)
    queries._words(spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in seen[0].split("Exchange")[1] and "regexp_replace" in seen[0].split("Exchange")[0]


def test_lexicon_may_hold_stop_words(spark):
    reviews = frame(spark, ["not what we ordered", "broken items again, broken items"])
    result = review_sentiment(reviews, "doc_id", lexicon={"not": -1.0, "broken": -0.5}, phrases_per_class=1)
    assert [r["polarity"] for r in result.scored.orderBy("doc_id").collect()] == [-1.0, -0.5]
    assert [tuple(r) for r in result.classes.collect()] == [("Negative", 2)]
    assert result.phrases.count() == 0
    assert result.scored.columns == ["doc_id", "text", "polarity", "sentiment_class"]
