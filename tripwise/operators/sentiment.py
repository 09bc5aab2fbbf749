"""Lexicon polarity, sentiment classes and the phrases that mark a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwise.functions.text import exploded

# The opinion words of the review generator and their polarity.
POSITIVE_ADJECTIVES = [
    "amazing", "fantastic", "great", "excellent", "awesome",
    "wonderful", "perfect", "positive", "delightful", "incredible",
]
NEGATIVE_ADJECTIVES = [
    "terrible", "awful", "bad", "horrible", "disappointing",
    "poor", "worst", "ugly", "nasty", "dreadful",
]
REVIEW_LEXICON = {
    **dict.fromkeys(POSITIVE_ADJECTIVES, 1.0),
    **dict.fromkeys(NEGATIVE_ADJECTIVES, -1.0),
}


# Decimals make a text's sum independent of the order in which tasks finish.
POLARITY = "decimal(18,6)"


def lexicon_table(spark: SparkSession, polarity: dict[str, float]) -> DataFrame:
    """``word, polarity`` of a lexicon given as a dict."""
    return spark.createDataFrame(list(polarity.items()), "word string, polarity double")


def learned_lexicon(
    df: DataFrame, words: str, positive: Column, min_texts: int = 5, steps: int = 1000
) -> DataFrame:
    """``word, polarity`` from texts whose opinion is known: ``(p - q) / (p + q)``.

    p and q are the (smoothed) shares of the positive and of the other texts that hold the word, so
    the polarity lies between -1 and 1; it is rounded to a ``steps``-th. Words of fewer than
    ``min_texts`` texts, and words that come out at 0, are left out. Texts are counted, not
    words: repetitions go inside the row, and counts are combined before the shuffle.
    """
    known = df.select(words, positive.cast("bigint").alias("up")).filter(F.col("up").isNotNull())
    sizes = known.agg(
        F.struct(F.count("*").alias("all"), F.coalesce(F.sum("up"), F.lit(0)).alias("up")).alias("sizes")
    ).scalar()
    counted = (
        exploded(known, F.array_distinct(words), "word", "up")
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("up").alias("up"))
        .filter(F.col("n") >= min_texts)
        .withColumn("sizes", sizes)
    )
    p = (F.col("up") + 1) / (F.col("sizes.up") + 2)
    q = (F.col("n") - F.col("up") + 1) / (F.col("sizes.all") - F.col("sizes.up") + 2)
    found = counted.select("word", p.alias("p"), q.alias("q"))
    rounded = F.floor((F.col("p") - F.col("q")) / (F.col("p") + F.col("q")) * steps + 0.5) / F.lit(float(steps))
    return found.select("word", rounded.alias("polarity")).filter(F.col("polarity") != 0)


def text_polarity(df: DataFrame, key: str, words: str, lexicon: DataFrame) -> DataFrame:
    """``key, polarity``: mean polarity of a text's words that the lexicon knows, 0 without any.

    The lexicon is a relation of ``word, polarity`` and may be of any size: Spark broadcasts it
    if its statistics say that it is small and shuffles otherwise. What is shuffled of the texts
    are words, never texts, and each task adds up the hits of a text first.
    """
    rated = lexicon.filter(F.col("polarity").isNotNull()).select(
        "word", F.col("polarity").try_cast(POLARITY).alias("polarity")
    )
    hits = exploded(df, words, "word", key).join(rated, "word").select(key, "polarity", F.lit(1).alias("n"))
    # Texts without a known word take part with a sum of nothing.
    every = df.select(key, F.lit(0).cast(POLARITY).alias("polarity"), F.lit(0).alias("n"))
    summed = hits.unionByName(every).groupBy(key).agg(F.sum("polarity").alias("total"), F.sum("n").alias("n"))
    mean = F.try_divide(F.col("total").cast("double"), F.col("n").cast("double"))
    return summed.select(key, F.coalesce(mean, F.lit(0.0)).alias("polarity"))


def sentiment_class(score: Column | str) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")


def class_phrases(df: DataFrame, class_column: str, phrases: str, k: int = 5) -> DataFrame:
    """The ``k`` phrases that mark each class: ``class, phrase, n, g2, rank``.

    ``g2`` is the log-likelihood ratio of the phrase's share in the class against its share in all
    other classes; only phrases with the larger share in the class are listed, and equal
    ratios (to six digits) go in phrase order. Everything comes from the counts per class and phrase,
    which Spark shuffles once and reads again; nothing runs until the result is asked for. The
    rank limit is applied in each task before rows move to the class's task.
    """
    counted = (
        exploded(df, phrases, "phrase", class_column)
        .groupBy(class_column, "phrase")
        .agg(F.count("*").alias("n"))
    )
    sizes = counted.groupBy(F.col(class_column).alias("_class")).agg(F.sum("n").alias("size"))
    whole = counted.agg(F.sum("n").alias("whole")).scalar()
    everywhere = F.sum("n").over(Window.partitionBy("phrase")).alias("all")
    rows = counted.select(class_column, "phrase", "n", everywhere, whole.alias("whole"))
    rows = rows.join(sizes, F.col(class_column).eqNullSafe(F.col("_class")))
    shares = {
        "inside": F.col("n").cast("double"),
        "outside": (F.col("all") - F.col("n")).cast("double"),
        "of_class": F.col("size").cast("double"),
        "of_rest": (F.col("whole") - F.col("size")).cast("double"),
    }
    rows = rows.withColumns(shares).withColumn("share", F.col("all").cast("double") / F.col("whole").cast("double"))

    def part(seen: str, size: str) -> Column:
        seen, expected = F.col(seen), F.col(size) * F.col("share")
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = F.round(2 * (part("inside", "of_class") + part("outside", "of_rest")), 6)
    marked = rows.filter(F.col("inside") * F.col("of_rest") > F.col("outside") * F.col("of_class"))
    marked = marked.select(class_column, "phrase", "n", ratio.alias("g2"))
    order = Window.partitionBy(class_column).orderBy(F.col("g2").desc(), F.col("phrase"))
    return marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
