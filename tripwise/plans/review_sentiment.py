"""Lexicon sentiment of reviews: score, class, class counts and the phrases that mark a class."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tripwise.functions.text import drop_stop_words, terms_of, with_words
from tripwise.operators.profiles import value_counts
from tripwise.operators.sentiment import (
    REVIEW_LEXICON,
    class_phrases,
    lexicon_table,
    sentiment_class,
    text_polarity,
)
from tripwise.sources.shared import written


@dataclass
class ReviewSentiment:
    """``scores`` is a written table of ``key, polarity, sentiment_class``; the others read it."""

    scores: DataFrame
    classes: DataFrame
    phrases: DataFrame
    scored: DataFrame | None = None


def word_sentiment(
    words: DataFrame,
    key: str,
    lexicon: DataFrame,
    stop_words: Iterable[str] | None = None,
    phrases_per_class: int = 5,
) -> ReviewSentiment:
    """Sentiment of texts given as ``key, words``, with a lexicon of ``word, polarity``."""
    scores = text_polarity(words, key, "words", lexicon)
    scores = written(scores.withColumn("sentiment_class", sentiment_class("polarity")), "review_scores")
    pairs = words.select(key, drop_stop_words("words", stop_words).alias("words"))
    pairs = pairs.select(key, terms_of("words", (2, 2)).alias("phrases"))
    classed = pairs.join(scores.select(key, "sentiment_class"), key)
    return ReviewSentiment(
        scores=scores,
        classes=value_counts(scores, "sentiment_class"),
        phrases=class_phrases(classed, "sentiment_class", "phrases", phrases_per_class),
    )


def review_sentiment(
    reviews: DataFrame,
    key: str,
    text: str = "text",
    lexicon: DataFrame | dict[str, float] = REVIEW_LEXICON,
    stop_words: Iterable[str] | None = None,
    phrases_per_class: int = 5,
) -> ReviewSentiment:
    """Score every review on all its words; phrases are word pairs without stop words.

    ``key`` identifies a review; ``lexicon`` is a table of ``word, polarity`` or a dict. Texts are
    cleaned once, into a written table of words. ``scored`` has the columns of the reviews.
    """
    if isinstance(lexicon, dict):
        lexicon = lexicon_table(reviews.sparkSession, lexicon)
    words = written(with_words(reviews, text, key), "words")
    result = word_sentiment(words, key, lexicon, stop_words, phrases_per_class)
    scored = reviews.join(result.scores, key).select(*reviews.columns, "polarity", "sentiment_class")
    result.scored = scored
    return result
