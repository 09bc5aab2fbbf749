"""Text cleaning and tokens as built-in expressions.

Give each stage its own column (``with_terms`` does): an expression that is
referenced twice inside one projection would run its regexes twice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space in Unicode text
# patterns, and the patterns of the cleaning chain.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = rf"http[^{WHITESPACE}]+|www\.[^{WHITESPACE}]+"
MENTION_PATTERN = r"@[A-Za-z0-9_]+"
NOT_WORD_PATTERN = r"[^a-z0-9]+"

# The English stop words that Spark ML ships
# (StopWordsRemover.loadDefaultStopWords), in its order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()


def clean_text(text: Column | str) -> Column:
    """Lower-case, drop URLs and mentions, keep ``a-z0-9`` words separated by one space.

    Replacing each run of other characters by a space does in one pass what
    "other characters to spaces, then collapse white space" does in two.
    """
    out = F.lower(text)
    out = F.regexp_replace(out, URL_PATTERN, " ")
    out = F.regexp_replace(out, MENTION_PATTERN, " ")
    return F.trim(F.regexp_replace(out, NOT_WORD_PATTERN, " "))


def tokens(clean: Column | str) -> Column:
    """Words of at least two characters of an already cleaned text, in order."""
    return F.filter(F.split(clean, " "), lambda w: F.length(w) >= 2)


def drop_stop_words(words: Column | str, stop_words: Iterable[str] | None = None) -> Column:
    """Remove stop words but keep order and repetitions; ``None`` means English."""
    stop = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    if not stop:
        return F.col(words) if isinstance(words, str) else words
    return F.filter(words, lambda w: ~w.isin(stop))


def word_ngrams(words: Column | str, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by a space.

    Each run of n - 1 words is paired with the word after it, which stays linear
    in the length of the text; slicing every run out of the array would not.
    """
    words = F.col(words) if isinstance(words, str) else words
    grams = words
    for shift in range(1, n):
        pairs = F.greatest(F.size(words) - shift, F.lit(0))
        following = F.slice(words, shift + 1, pairs)
        grams = F.zip_with(
            F.slice(grams, 1, pairs), following, lambda left, right: F.concat_ws(" ", left, right)
        )
    return grams


def terms_of(words: Column | str, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """The n-grams of all lengths in ``ngram_range``."""
    low, high = ngram_range
    grams = [word_ngrams(words, n) for n in range(low, high + 1)]
    return F.concat(*grams) if len(grams) > 1 else grams[0]


def with_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The ``keep`` columns and ``words``, all words of the cleaned text; null is an empty text."""
    cleaned = df.select(*keep, clean_text(F.coalesce(F.col(text), F.lit(""))).alias("clean_text"))
    return cleaned.select(*keep, tokens("clean_text").alias("words"))


def with_terms(
    df: DataFrame,
    text: str = "text",
    ngram_range: tuple[int, int] = (1, 2),
    stop_words: Iterable[str] | None = None,
    terms: str = "terms",
) -> DataFrame:
    """Add ``clean_text``, ``words`` (stop words removed) and ``terms`` (the n-grams of the words)."""
    staged = df.withColumn("clean_text", clean_text(F.coalesce(F.col(text), F.lit(""))))
    staged = staged.withColumn("words", drop_stop_words(tokens("clean_text"), stop_words))
    return staged.withColumn(terms, terms_of("words", ngram_range))


def with_counts(df: DataFrame, values: str, counts: str) -> DataFrame:
    """Add ``counts``: the distinct elements of an array with their numbers, as ``term, tf`` structs.

    Counted inside the row: equal elements are neighbours after sorting, and a run begins where
    an element differs from the one before it. Nulls are not counted. Nothing is exploded or shuffled.
    """
    staged = df.withColumn("_sorted", F.sort_array(F.array_compact(values)))

    def begins(x: Column, i: Column) -> Column:
        return F.when((i == 0) | (x != F.get("_sorted", i - 1)), i)

    staged = staged.withColumn("_begins", F.array_compact(F.transform("_sorted", begins)))
    ends = F.concat(F.slice("_begins", 2, F.size("_begins")), F.array(F.size("_sorted")))
    staged = staged.withColumn("_ends", F.slice(ends, 1, F.size("_begins")))

    def run(begin: Column, end: Column) -> Column:
        return F.struct(F.get("_sorted", begin).alias("term"), (end - begin).cast("bigint").alias("tf"))

    return staged.withColumn(counts, F.zip_with("_begins", "_ends", run)).drop("_sorted", "_begins", "_ends")


def exploded(df: DataFrame, values: Column | str, name: str, *keep: str) -> DataFrame:
    """``keep`` columns and one row per array element.

    A plain ``explode`` makes Spark infer a "not empty" filter and push it below
    the projections that compute the array, which runs the text regexes again in
    the filter. The outer form infers nothing; its null for an empty array goes here.
    """
    rows = df.select(*keep, F.explode_outer(values).alias(name))
    return rows.filter(F.col(name).isNotNull())
