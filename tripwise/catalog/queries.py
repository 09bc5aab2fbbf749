"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripwise.catalog import inputs
from tripwise.functions.text import clean_text, drop_stop_words, terms_of, with_terms, with_words
from tripwise.operators import (
    certificates,
    features,
    metrics,
    profiles,
    sales,
    sampling,
    sentiment,
    tfidf,
)
from tripwise.plans.review_classifier import ReviewClassifier, classify_reviews
from tripwise.plans.review_sentiment import ReviewSentiment, word_sentiment
from tripwise.plans.tip_classifier import TipClassifier, classify_tips
from tripwise.plans.tip_report import report_tips
from tripwise.plans.trip_profile import profile_trips
from tripwise.sources.shared import bytes_of, discard, fresh_path, written, written_in_rounds
from tripwise.sources.sinks import write_table
from tripwise.sources.tables import TRIP_COLUMNS, load_table, parse_timestamps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE_ROWS = 1000
TEXT_MIN_DF = 5
SHOWN_REGIONS = ["ASIA", "EUROPE"]
SHOWN_CATEGORIES = ["ECONOMY", "PROMO"]


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Equal results for sums that were added up in another order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.valid_trips(inputs.trips(spark, sf_dir))


# Trip profile


@query("hourly_profile")
def hourly_profile(spark, sf_dir):
    return profile_trips(inputs.trips(spark, sf_dir)).hourly


@query("busiest_hour")
def busiest_hour(spark, sf_dir):
    return profile_trips(inputs.trips(spark, sf_dir)).busiest_hour


@query("highest_avg_fare_hour")
def highest_avg_fare_hour(spark, sf_dir):
    return profile_trips(inputs.trips(spark, sf_dir)).highest_avg_fare_hour


@query("revenue_totals")
def revenue_totals(spark, sf_dir):
    summary = profile_trips(inputs.trips(spark, sf_dir)).summary
    return summary.select("total_rides", "total_fare_amount", "total_tip_amount", "total_amount")


@query("fare_averages")
def fare_averages(spark, sf_dir):
    summary = profile_trips(inputs.trips(spark, sf_dir)).summary
    return summary.select("average_fare", "average_tip", "average_total")


@query("weekday_weekend")
def weekday_weekend(spark, sf_dir):
    return profile_trips(inputs.trips(spark, sf_dir)).weekend


@query("weekday_weekend_fri_sat")
def weekday_weekend_fri_sat(spark, sf_dir):
    return profile_trips(inputs.trips(spark, sf_dir), weekend_days="fri_sat").weekend


@query("time_cube")
def time_cube(spark, sf_dir):
    """The one pass behind all profiles; its sums are decimals, shown as doubles."""
    cube = profile_trips(inputs.trips(spark, sf_dir)).cube
    return cube.withColumns({f"{c}_sum": F.col(f"{c}_sum").cast("double") for c in profiles.MEASURES})


@query("trips_preview")
def trips_preview(spark, sf_dir):
    columns = ["trip_id", "tpep_pickup_datetime", "fare_amount", "tip_amount", "total_amount"]
    return profiles.preview(inputs.trips(spark, sf_dir), "trip_id", 5, columns)


@query("trips_projected")
def trips_projected(spark, sf_dir):
    return inputs.trips(spark, sf_dir).select(*TRIP_COLUMNS)


@query("valid_trips")
def valid_trips(spark, sf_dir):
    return _valid(spark, sf_dir)


@query("high_tip_counts")
def high_tip_counts(spark, sf_dir):
    return report_tips(inputs.trips(spark, sf_dir), "trip_id").high_tips


@query("tip_rate_histogram")
def tip_rate_histogram(spark, sf_dir):
    return report_tips(inputs.trips(spark, sf_dir), "trip_id").tip_rates


# Sources and sinks


def _reload(df: DataFrame, name: str, schema: StructType | None = None, **options) -> DataFrame:
    path = write_table(df, fresh_path(df.sparkSession, name), **options)
    return load_table(df.sparkSession, path, schema)


@query("parquet_roundtrip")
def parquet_roundtrip(spark, sf_dir):
    hourly = hourly_profile(spark, sf_dir)
    return _reload(hourly, "hourly.parquet", single_file=True)


@query("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    hourly = hourly_profile(spark, sf_dir)
    return _reload(hourly, "hourly.csv", hourly.schema, single_file=True)


@query("csv_gzip_roundtrip")
def csv_gzip_roundtrip(spark, sf_dir):
    trips = inputs.trips(spark, sf_dir)
    return _reload(trips, "trips.csv.gz", trips.schema)


@query("processed_export")
def processed_export(spark, sf_dir):
    path = fresh_path(spark, "processed.csv")
    report = report_tips(inputs.trips(spark, sf_dir), "trip_id", export_path=path)
    return load_table(spark, path, report.processed.schema)


@query("timestamp_coercion")
def timestamp_coercion(spark, sf_dir):
    trips = inputs.trips(spark, sf_dir)
    text = F.when(F.col("trip_id") % 19 == 0, F.concat(F.lit("bad "), F.col("trip_id").cast("string")))
    as_text = trips.select(
        "trip_id",
        text.otherwise(F.col("tpep_pickup_datetime").cast("string")).alias("tpep_pickup_datetime"),
    )
    return parse_timestamps(as_text)


# Samples, shuffles, splits


@query("sample_exact")
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(inputs.trips(spark, sf_dir), "trip_id", SAMPLE_ROWS)


@query("sample_exact_by_cut")
def sample_exact_by_cut(spark, sf_dir):
    sampled = sampling.sample_exact(inputs.trips(spark, sf_dir), "trip_id", 10 * SAMPLE_ROWS)
    return sampled.select("trip_id", "fare_amount")


@query("sample_exact_null_keys")
def sample_exact_null_keys(spark, sf_dir):
    """A key that is null or repeated for many trips, with a second column that tells them apart."""
    trips = inputs.trips(spark, sf_dir)
    sampled = sampling.sample_exact(trips, ["store_and_fwd_flag", "trip_id"], SAMPLE_ROWS)
    return sampled.select("trip_id", "store_and_fwd_flag")


@query("head_sample")
def head_sample(spark, sf_dir):
    return sampling.head_sample(inputs.trips(spark, sf_dir), "trip_id", SAMPLE_ROWS)


@query("shuffled_reviews")
def shuffled_reviews(spark, sf_dir):
    return sampling.shuffled(inputs.reviews(spark, sf_dir), "review_id")


@query("stratified_split")
def stratified_split(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels")
    return sampling.stratified_split(labels, "doc_id", "toxic", 0.25)


# Feature preparation


@query("trip_features")
def trip_features(spark, sf_dir):
    return features.trip_features(inputs.trips(spark, sf_dir))


@query("model_input")
def model_input(spark, sf_dir):
    return features.model_input(features.trip_features(inputs.trips(spark, sf_dir)), "trip_id")


def _numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = features.with_pickup_parts(inputs.trips(spark, sf_dir))
    return parts.select("trip_id", *features.NUMERIC_FEATURES)


@query("median_impute")
def median_impute(spark, sf_dir):
    numbers = _numeric(spark, sf_dir)
    names = features.NUMERIC_FEATURES
    model = features.MedianImputer(inputCols=names, outputCols=names).fit(numbers)
    return model.transform(numbers)


@query("standard_scale")
def standard_scale(spark, sf_dir):
    numbers = features.model_input(features.trip_features(inputs.trips(spark, sf_dir)), "trip_id")
    names = features.NUMERIC_FEATURES
    model = features.PopulationScaler(inputCols=names, outputCols=names).fit(numbers)
    return rounded(model.transform(numbers).select("trip_id", *names), 6, *names)


@query("constant_impute")
def constant_impute(spark, sf_dir):
    names = features.CATEGORICAL_FEATURES
    trips = inputs.trips(spark, sf_dir).select("trip_id", *names)
    return features.constant_impute(trips, names)


@query("one_hot")
def one_hot(spark, sf_dir):
    """The slot of the 1 in each category's vector, 0 for all zeros; fitted on the training rows."""
    names = features.CATEGORICAL_FEATURES
    trips = inputs.trips(spark, sf_dir)
    rows = features.model_input(features.trip_features(trips), "trip_id")
    split = sampling.stratified_split(rows, "trip_id", features.TARGET, 0.25)
    train = split.filter("split = 'train'").select(*names)
    model = features.LevelIndexer(inputCols=names, outputCols=[f"{c}_slot" for c in names]).fit(train)
    coded = model.transform(trips.select("trip_id", *names))
    return coded.select("trip_id", *[F.col(f"{c}_slot").alias(c) for c in names])


@query("pipeline_vectors")
def pipeline_vectors(spark, sf_dir):
    """The assembled feature vectors of all rows: scaled numbers, then the places of the ones.

    The pipeline is fitted on the training rows.
    """
    rows = written(features.model_input(features.trip_features(inputs.trips(spark, sf_dir)), "trip_id"), "model_input")
    split = sampling.stratified_split(rows, "trip_id", features.TARGET, 0.25)
    pipeline = features.preprocessing(features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES)
    model = pipeline.fit(split.filter("split = 'train'"))
    vectors = model.transform(rows).select("trip_id", vector_to_array("features").alias("v"))
    numbers = [F.get("v", F.lit(i)).alias(c) for i, c in enumerate(features.NUMERIC_FEATURES)]
    first = len(numbers)
    ones = F.filter(F.sequence(F.lit(first), F.size("v") - 1), lambda i: F.get("v", i) == 1.0)
    places = F.array_join(F.transform(ones, lambda i: (i - first + 1).cast("string")), ",")
    found = vectors.select("trip_id", *numbers, places.alias("ones"), F.size("v").alias("n_slots"))
    return rounded(found, 6, *features.NUMERIC_FEATURES)


# Text


@query("synthetic_reviews")
def synthetic_reviews(spark, sf_dir):
    return inputs.reviews(spark, sf_dir)


@query("sentiment_label_counts")
def sentiment_label_counts(spark, sf_dir):
    return profiles.value_counts(inputs.text_labels(spark, sf_dir), "sentiment")


@query("clean_text")
def clean_documents(spark, sf_dir):
    return inputs.documents(spark, sf_dir).select("doc_id", clean_text("text").alias("clean_text"))


def _dealt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents.

    The given file cannot be split (one row group), so texts are dealt out by document before they
    are cleaned; cleaning is most of the work.
    """
    return with_words(inputs.documents(spark, sf_dir).repartition("doc_id"), "text", "doc_id")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, cleaned once and written for the several passes that read them."""
    return written(_dealt_words(spark, sf_dir), "words")


def _listed(words: DataFrame) -> DataFrame:
    return words.select(
        "doc_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words")
    )


@query("tokens")
def document_tokens(spark, sf_dir):
    return _listed(with_words(inputs.documents(spark, sf_dir), "text", "doc_id"))


@query("stopword_filtered")
def stopword_filtered(spark, sf_dir):
    words = with_words(inputs.documents(spark, sf_dir), "text", "doc_id")
    return _listed(words.select("doc_id", drop_stop_words("words").alias("words")))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_terms(inputs.documents(spark, sf_dir)).select("doc_id", "terms")


@query("ngrams")
def ngram_counts(spark, sf_dir):
    return tfidf.term_counts(_terms(spark, sf_dir), "doc_id")


@query("doc_freq_vocab")
def doc_freq_vocab(spark, sf_dir):
    return rounded(tfidf.vocabulary(_terms(spark, sf_dir)), 6, "idf")


@query("tfidf")
def document_tfidf(spark, sf_dir):
    """In rounds: the counts of all documents at once would take many times the disk of the documents."""
    words = _dealt_words(spark, sf_dir).select("doc_id", drop_stop_words("words").alias("words"))
    words = written_in_rounds([words], "words")
    rounds = tfidf.rounds_of(bytes_of(words))
    terms = words.select("doc_id", terms_of("words").alias("terms"))
    model = tfidf.fit_tfidf(terms, rounds=min(rounds, tfidf.COUNT_ROUNDS))
    weights = model.transform_in_rounds(tfidf.term_vectors(terms, "doc_id"), "doc_id", rounds)
    discard(words, model.vocabulary)
    return rounded(weights, 6, "tfidf")


# Sentiment


def _lexicon(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """Learned from the labelled documents."""
    labelled = words.join(inputs.text_labels(spark, sf_dir), "doc_id")
    learned = sentiment.learned_lexicon(labelled, "words", F.col("sentiment") == "positive")
    return written(learned, "lexicon")


def _sentiment(spark: SparkSession, sf_dir: str) -> ReviewSentiment:
    words = _words(spark, sf_dir)
    return word_sentiment(words, "doc_id", _lexicon(spark, sf_dir, words))


@query("learned_lexicon")
def learned_lexicon(spark, sf_dir):
    return _lexicon(spark, sf_dir, _words(spark, sf_dir))


@query("lexicon_polarity")
def lexicon_polarity(spark, sf_dir):
    return _sentiment(spark, sf_dir).scores


@query("sentiment_classes")
def sentiment_classes(spark, sf_dir):
    return _sentiment(spark, sf_dir).classes


@query("sentiment_phrases")
def sentiment_phrases(spark, sf_dir):
    return _sentiment(spark, sf_dir).phrases


# Evaluation of fixed rules, so that the metrics are checked exactly


def _ruled_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.trip_features(inputs.trips(spark, sf_dir))
    return rows.select(
        F.col("high_tip").alias("label"),
        (F.col("payment_type") >= 3).cast("int").alias("prediction"),
        (F.floor(F.col("fare_amount") / 5) / F.lit(100.0)).alias("score"),
    )


def _ruled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, judged by the sign of their polarity."""
    scores = _sentiment(spark, sf_dir).scores
    judged = F.when(F.col("polarity") > 0, "positive").otherwise("negative").alias("prediction")
    labels = inputs.text_labels(spark, sf_dir)
    return labels.join(scores, "doc_id").select(F.col("sentiment").alias("label"), judged)


@query("binary_metrics")
def binary_metrics(spark, sf_dir):
    result = metrics.binary_metrics(_ruled_trips(spark, sf_dir))
    return rounded(result, 6, "accuracy", "precision", "recall", "f1")


@query("roc_auc")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_ruled_trips(spark, sf_dir)), 6, "roc_auc")


@query("classification_report")
def classification_report(spark, sf_dir):
    result = metrics.classification_report(_ruled_texts(spark, sf_dir))
    return rounded(result, 6, "precision", "recall", "f1")


@query("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_ruled_texts(spark, sf_dir), ["positive", "negative"])


# Sales


def _dated(daily: DataFrame) -> DataFrame:
    """Days as ISO text, which every client reads the same way."""
    return daily.withColumn("sale_date", F.col("sale_date").cast("string"))


@query("daily_sales")
def daily_sales(spark, sf_dir):
    return _dated(sales.daily_sales(inputs.sales(spark, sf_dir, "sale_date", "sales")))


@query("daily_sales_filtered")
def daily_sales_filtered(spark, sf_dir):
    rows = inputs.sales(spark, sf_dir, "sale_date", "region", "category", "sales")
    chosen = sales.filter_sales(rows, SHOWN_REGIONS, SHOWN_CATEGORIES)
    return _dated(sales.daily_sales(chosen))


@query("profit_share")
def profit_share(spark, sf_dir):
    return rounded(sales.profit_share(inputs.sales(spark, sf_dir, "category", "profit")), 6, "share")


@query("underperforming_regions")
def underperforming_regions(spark, sf_dir):
    return sales.underperforming_regions(inputs.sales(spark, sf_dir, "region", "sales"))


@query("high_margin_categories")
def high_margin_categories(spark, sf_dir):
    rows = inputs.sales(spark, sf_dir, "category", "sales", "profit")
    return rounded(sales.high_margin_categories(rows), 6, "margin")


# Fitted models: what SQL can say of any right fit


def _tips(spark: SparkSession, sf_dir: str) -> TipClassifier:
    return classify_tips(inputs.trips(spark, sf_dir), "trip_id")


def _reviews(spark: SparkSession, sf_dir: str) -> ReviewClassifier:
    """Labelled documents are long, so a term counts from five of them on; the file has one row group."""
    labelled = inputs.labelled_texts(spark, sf_dir).repartition("doc_id")
    return classify_reviews(labelled, "doc_id", min_df=TEXT_MIN_DF)


@query("rf_predictions")
def rf_predictions(spark, sf_dir):
    return certificates.score_checks(_tips(spark, sf_dir).predictions, "trip_id", features.TARGET)


@query("rf_evaluation")
def rf_evaluation(spark, sf_dir):
    """Sizes of the split, the checks of the forest, and whether it tells high tips better than chance."""
    tips = _tips(spark, sf_dir)
    rates = tips.metrics()
    better = rates.select((F.col("roc_auc").between(0.5, 1.0)).alias("better_than_chance")).scalar()
    sizes = tips.predictions.agg(F.count("*").alias("n_test"), F.sum(features.TARGET).alias("n_high"))
    n_train = tips.train.agg(F.count("*").alias("n")).scalar()
    checked = certificates.rate_checks(rates).select(F.struct("*").alias("rates")).scalar()
    forest = tips.checks().select(F.struct("*").alias("forest")).scalar()
    found = sizes.select("*", n_train.alias("n_train"), better.alias("better_than_chance"), checked.alias("r"), forest.alias("f"))
    return found.select("n_train", "n_test", "n_high", "better_than_chance", "r.*", "f.*")


@query("lr_predictions")
def lr_predictions(spark, sf_dir):
    return certificates.score_checks(_reviews(spark, sf_dir).predictions, "doc_id", "sentiment")


@query("lr_evaluation")
def lr_evaluation(spark, sf_dir):
    """One row for each class and average: how many test texts, and whether the rates fit together.

    An average of F1 is not the harmonic mean of averages, so only classes and the accuracy must agree.
    """
    report = _reviews(spark, sf_dir).report()
    checked = certificates.rate_checks(report, "class", "support")
    averages = F.col("class").isin("macro avg", "weighted avg")
    return checked.withColumn("f1_agrees", F.col("f1_agrees") | averages)


@query("lr_fit")
def lr_fit(spark, sf_dir):
    """Rows and terms of the fit, and whether the slope is down to a thousandth of where it began."""
    checks = _reviews(spark, sf_dir).checks()
    return checks.select("n_rows", "n_terms", (F.col("slope") <= 1e-3 * F.col("steepest")).alias("converged"))


@query("top_tokens")
def top_tokens(spark, sf_dir):
    reviews = _reviews(spark, sf_dir)
    return certificates.token_checks(reviews.top_tokens(12), reviews.vocabulary())
