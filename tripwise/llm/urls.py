"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules are a short hand-kept list ``(host, path, verdict)``. A rule fits its host and all
subdomains if the URL's path starts with the rule's; the longest rule wins, among equals the
one listed first. Trees are trained on URLs that rules have labelled.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, fits no rule
and is scored like any other; when the labelled URLs have one class only (or there are none),
every other URL gets that class (or ``allow``). Repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise.sources.shared import written

Rule = tuple[str, str, str]

RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# Labelled URLs that the trees are fitted on, about; chosen by hash.
TRAIN_URLS = 20_000
FIT_PARTITIONS = 32
LEXICAL = [
    "url_length",
    "host_length",
    "path_length",
    "host_depth",
    "path_depth",
    "digit_ratio",
    "hyphens",
    "parameters",
    "has_fragment",
    "entropy",
    "suffix_share",
    "suffix_blocked",
    "ending_share",
    "ending_blocked",
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host after the first ``://`` and the path behind it."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def matched_rule(rules: list[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, decided in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        in_host = (F.col(host) == name) | F.col(host).endswith(f".{name}")
        fits = in_host & F.col(path).startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, all beyond ASCII counting as one.

    One pass of ``replace`` for each distinct character, of which there are 129 at most.
    """
    folded = F.regexp_replace(text, r"[^\x00-\x7F]", "\u0080")
    length = F.length(folded).cast("double")

    def part(character: Column) -> Column:
        share = (length - F.length(F.replace(folded, character, F.lit("")))) / length
        return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    letters = F.filter(F.array_distinct(F.split(folded, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda total, c: total + part(c))


def with_lexical(df: DataFrame, url: str) -> DataFrame:
    """Length, depth, digit, parameter and entropy features and the two suffixes of a URL."""
    text = F.coalesce(F.col(url), F.lit(""))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_depth": F.regexp_count("host", F.lit(r"\.")).cast("double"),
            "path_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(digits, F.length(text)), F.lit(0.0)).cast("double"),
            "hyphens": F.regexp_count(text, F.lit("-")).cast("double"),
            "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "has_fragment": F.contains(text, F.lit("#")).cast("double"),
            "entropy": entropy(text),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
            "ending": F.regexp_extract("path", r"^/([^/]*)", 1),
        }
    )


def suffix_statistics(labelled: DataFrame, column: str) -> DataFrame:
    """Share of the labelled URLs with a suffix and, smoothed, how many of them are blocked."""
    n = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("base")).first()
    total, base = max(n["n"], 1), n["base"] or 0.0
    return labelled.groupBy(F.col(column).alias(f"{column}_of")).agg(
        (F.count("*") / F.lit(float(total))).alias(f"{column}_share"),
        ((F.sum("label") + F.lit(10.0 * base)) / (F.count("*") + F.lit(10.0))).alias(
            f"{column}_blocked"
        ),
    )


def is_fitted(url: str, share: float, seed: int) -> Column:
    """Whether the hash of a URL puts it among this share of all."""
    draw = F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit(seed)), F.lit(1 << 30))
    return draw < int(min(1.0, share) * (1 << 30)) + 1


def judged_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: list[Rule] = RULES,
    train_urls: int = TRAIN_URLS,
    trees: int = 10,
    depth: int = 4,
    threshold: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """``key, host, path, rule, verdict, score``; the verdict is the rule's, else the trees'.

    About ``train_urls`` labelled URLs (hash of the URL) train the trees; everything is judged.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rows = rows.select("key", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(rules)
    rows = rows.withColumns({"rule": rule, "decided": verdict})
    rows = with_lexical(rows, "url").withColumn("label", (F.col("decided") == "block").cast("double"))

    counts = rows.agg(F.count("label").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if counts["lo"] == counts["hi"]:
        only = "block" if counts["lo"] == 1.0 else "allow"
        return rows.select(
            "key",
            "host",
            "path",
            "rule",
            F.coalesce("decided", F.lit(only)).alias("verdict"),
            F.lit(counts["lo"] or 0.0).cast("double").alias("score"),
        )

    chosen = is_fitted("url", train_urls / counts["n"], seed)
    labelled = rows.filter(F.col("label").isNotNull() & chosen)
    labelled = written(labelled, "labelled_urls")
    statistics = {c: written(suffix_statistics(labelled, c), c) for c in ("suffix", "ending")}
    assembler = VectorAssembler(inputCols=LEXICAL, outputCol="features")

    def features(df: DataFrame) -> DataFrame:
        for column, table in statistics.items():
            df = df.join(table, F.col(column) == F.col(f"{column}_of"), "left")
        return assembler.transform(df.fillna(0.0, LEXICAL))

    # Spark draws split candidates by partition and position; rows have fixed places, whatever the layout.
    placed = features(labelled).repartition(FIT_PARTITIONS, "url").sortWithinPartitions("url", "key")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.3).fit(
        placed.select("features", "label")
    )
    scored = model.transform(features(rows)).withColumn("score", vector_to_array("probability")[1])
    found = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "key", "host", "path", "rule", F.coalesce("decided", found).alias("verdict"), "score"
    )
