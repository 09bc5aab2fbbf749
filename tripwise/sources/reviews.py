"""Generator of labelled product reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.functions.keys import draw, pick
from tripwise.operators.sentiment import NEGATIVE_ADJECTIVES, POSITIVE_ADJECTIVES

# What reviews talk about, and their sentences. "experience" is in
# both lists and so twice as likely.
PRODUCTS = [
    "phone", "movie", "restaurant", "service", "delivery",
    "hotel", "app", "browser", "experience", "meal",
]
ACTIVITIES = [
    "experience", "purchase", "visit", "order", "stay",
    "trip", "session", "review", "performance", "support",
]
POSITIVE_TEMPLATES = [
    "I absolutely loved the {item}. It was {adj}.",
    "The {item} was so {adj} and made my day.",
    "What a {adj} {item} — I will use it again.",
    "Such a {adj} and {adj2} {item}. Highly recommended!",
    "I had an {adj} time with the {item}.",
]
NEGATIVE_TEMPLATES = [
    "I hated the {item}. It was {adj}.",
    "The {item} was really {adj} and frustrating.",
    "What a {adj} {item} — I will never use it again.",
    "Such a {adj} and {adj2} {item}. Very disappointing.",
    "I had a {adj} time with the {item}.",
]


def synthetic_reviews(spark: SparkSession, n_samples: int = 1200, seed: int = 42) -> DataFrame:
    """``review_id, text, sentiment`` with as many positive as negative texts."""
    return reviews_for(spark.range(n_samples // 2), "id", seed)


def reviews_for(pairs: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One positive and one negative review per row of ``pairs``; a map-only job of any size."""
    ids = pairs.select(
        F.explode(F.array(F.col(key) * 2, F.col(key) * 2 + 1)).alias("review_id")
    )
    drawn = ids.select(
        "review_id",
        draw("review_id", f"{seed}:item", len(PRODUCTS) + len(ACTIVITIES)).alias("item"),
        draw("review_id", f"{seed}:adj", 10).alias("adj"),
        # A step of 1 to 9 around the ring of ten: never the first adjective again.
        (1 + draw("review_id", f"{seed}:adj2", 9)).alias("step"),
        draw("review_id", f"{seed}:template", 5).alias("template"),
    )
    positive = F.col("review_id") % 2 == 0
    text = F.when(positive, _fill(POSITIVE_TEMPLATES, POSITIVE_ADJECTIVES)).otherwise(
        _fill(NEGATIVE_TEMPLATES, NEGATIVE_ADJECTIVES)
    )
    return drawn.select(
        "review_id",
        text.alias("text"),
        F.when(positive, "positive").otherwise("negative").alias("sentiment"),
    )


def _fill(templates: list[str], adjectives: list[str]) -> Column:
    slots = {
        "{item}": pick(PRODUCTS + ACTIVITIES, F.col("item")),
        "{adj2}": pick(adjectives, (F.col("adj") + F.col("step")) % len(adjectives)),
        "{adj}": pick(adjectives, F.col("adj")),
    }
    text = pick(templates, F.col("template"))
    for slot, word in slots.items():
        text = F.replace(text, F.lit(slot), word)
    return text
