"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from tripwise.catalog.inputs import TRIPS_SQL
from tripwise.functions.text import (
    ENGLISH_STOP_WORDS,
    MENTION_PATTERN,
    NOT_WORD_PATTERN,
    URL_PATTERN,
)
from tripwise.operators.features import CATEGORICAL_FEATURES as CATEGORICAL
from tripwise.operators.features import NUMERIC_FEATURES as NUMERIC
from tripwise.operators.sentiment import NEGATIVE_ADJECTIVES, POSITIVE_ADJECTIVES
from tripwise.sources.reviews import (
    ACTIVITIES,
    NEGATIVE_TEMPLATES,
    POSITIVE_TEMPLATES,
    PRODUCTS,
)



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _hash(key: str, seed: str) -> str:
    return f"md5(concat(CAST({key} AS VARCHAR), ':{seed}'))"


def _draw(key: str, purpose: str, n: int) -> str:
    return f"(CAST(('0x' || substr({_hash(key, purpose)}, 1, 8)) AS BIGINT) % {n})"


def _clean(column: str) -> str:
    out = f"lower({column})"
    for pattern in (URL_PATTERN, MENTION_PATTERN, NOT_WORD_PATTERN):
        out = f"regexp_replace({out}, {_text(pattern)}, ' ', 'g')"
    return f"trim({out})"


def _words(clean: str, stop: bool) -> str:
    kept = f" AND NOT list_contains({_list(ENGLISH_STOP_WORDS)}, w)" if stop else ""
    return f"list_filter(string_split({clean}, ' '), lambda w: length(w) >= 2{kept})"


def _bigrams(words: str) -> str:
    return (
        f"list_transform(range(1, greatest(len({words}), 1)), "
        f"lambda i: {words}[i] || ' ' || {words}[i + 1])"
    )


def _filled(templates: list[str], adjectives: list[str]) -> str:
    words = _list(adjectives)
    out = f"({_list(templates)})[template + 1]"
    out = f"replace({out}, '{{item}}', ({_list(PRODUCTS + ACTIVITIES)})[item + 1])"
    out = f"replace({out}, '{{adj2}}', ({words})[(adj + step) % 10 + 1])"
    return f"replace({out}, '{{adj}}', ({words})[adj + 1])"


# Shared table expressions

TRIPS = "trips AS (" + TRIPS_SQL.format(events="events") + ")"
VALID = f"{TRIPS}, valid AS (SELECT * FROM trips WHERE fare_amount > 0)"
FEATURES = f"""{TRIPS}, rated AS (
  SELECT *, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
    CAST(isodow(tpep_pickup_datetime) - 1 AS INTEGER) AS pickup_dayofweek,
    tip_amount / fare_amount AS tip_rate
  FROM trips
  WHERE tpep_pickup_datetime IS NOT NULL AND fare_amount > 0 AND trip_distance >= 0
    AND passenger_count > 0),
features AS (SELECT *, CAST(coalesce(tip_rate >= 25e-2, false) AS INTEGER) AS high_tip FROM rated)"""
MODEL_INPUT = f"""{FEATURES}, model_input AS (
  SELECT trip_id, {", ".join(NUMERIC + CATEGORICAL)}, high_tip FROM features
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC + CATEGORICAL)})"""
REVIEWS = f"""ids AS (
  SELECT o_orderkey * 2 + side AS review_id FROM orders, (VALUES (0), (1)) s(side)),
drawn AS (
  SELECT review_id, {_draw("review_id", "42:item", 20)} AS item,
    {_draw("review_id", "42:adj", 10)} AS adj, 1 + {_draw("review_id", "42:adj2", 9)} AS step,
    {_draw("review_id", "42:template", 5)} AS template
  FROM ids),
reviews AS (
  SELECT CAST(review_id AS BIGINT) AS review_id,
    CASE WHEN review_id % 2 = 0 THEN {_filled(POSITIVE_TEMPLATES, POSITIVE_ADJECTIVES)}
         ELSE {_filled(NEGATIVE_TEMPLATES, NEGATIVE_ADJECTIVES)} END AS text,
    CASE WHEN review_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment
  FROM drawn)"""
LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS sentiment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL)"""
LEXICON = f"""{LABELLED},
labelled_words AS (
  SELECT sentiment, {_words(_clean("coalesce(text, '')"), stop=False)} AS words FROM labelled),
sizes AS (SELECT count(*) AS all_texts, count(*) FILTER (WHERE sentiment = 'positive') AS up_texts FROM labelled),
seen AS (
  SELECT word, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS up
  FROM (SELECT sentiment, unnest(list_distinct(words)) AS word FROM labelled_words) GROUP BY word HAVING count(*) >= 5),
shares AS (
  SELECT word, CAST(up + 1 AS DOUBLE) / (up_texts + 2) AS p,
    CAST(n - up + 1 AS DOUBLE) / (all_texts - up_texts + 2) AS q FROM seen, sizes),
lexicon AS (
  SELECT * FROM (SELECT word, floor((p - q) / (p + q) * 1000 + 5e-1) / 1000e0 AS polarity FROM shares) WHERE polarity <> 0)"""
POLAR = f"""{LEXICON},
every_word AS (
  SELECT doc_id, unnest({_words(_clean("coalesce(text, '')"), stop=False)}) AS word FROM documents),
rated AS (
  SELECT doc_id, CAST(sum(CAST(polarity AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean
  FROM every_word JOIN lexicon USING (word) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(mean, 0e0) AS polarity, CASE WHEN mean > 0 THEN 'Positive' WHEN mean < 0 THEN 'Negative'
    ELSE 'Neutral' END AS sentiment_class FROM documents LEFT JOIN rated USING (doc_id))"""
RULED_TEXTS = f"""{POLAR}, ruled AS (
  SELECT sentiment AS label, CASE WHEN polarity > 0 THEN 'positive' ELSE 'negative' END AS prediction
  FROM labelled JOIN scored USING (doc_id))"""
RULED_TRIPS = f"""{FEATURES}, ruled AS (
  SELECT high_tip AS label, CAST(payment_type >= 3 AS INTEGER) AS prediction,
    floor(fare_amount / 5) / 100e0 AS score
  FROM features)"""
CLEANED = f"cleaned AS (SELECT doc_id, {_clean('text')} AS clean_text FROM documents)"
TERMS = f"""{CLEANED},
worded AS (SELECT doc_id, {_words("clean_text", stop=True)} AS words FROM cleaned),
terms AS (
  SELECT doc_id, unnest(words) AS term FROM worded
  UNION ALL SELECT doc_id, unnest({_bigrams("words")}) AS term FROM worded),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)"""
VOCABULARY = f"""{TERMS}, total AS (SELECT count(*) AS n FROM documents),
vocabulary AS (
  SELECT term, df, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
  WHERE df >= 2 AND df <= 85e-2 * n)"""
SALES = """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS sale_date, r_name AS region, p_type AS category,
    CAST(l_extendedprice * (1e0 - l_discount) AS DECIMAL(18,4)) AS sales,
    CAST(l_extendedprice * (1e0 - l_discount) - 6e-1 * l_quantity * p_retailprice
         AS DECIMAL(18,4)) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey)"""
MONEY = {c: f"CAST({c} AS DECIMAL(28,4))" for c in ("fare_amount", "tip_amount", "total_amount")}
SUM = {c: f"CAST(sum({value}) AS DOUBLE)" for c, value in MONEY.items()}
MEAN = {c: f"CAST(sum({value}) AS DOUBLE) / count({c})" for c, value in MONEY.items()}
HOURLY = f"""{VALID}, hourly AS (
  SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour, {MEAN["fare_amount"]} AS avg_fare,
    count(fare_amount) AS trip_count, {SUM["fare_amount"]} AS total_fare
  FROM valid WHERE tpep_pickup_datetime IS NOT NULL GROUP BY 1)"""


def _weekend(rule: str) -> str:
    return f"""WITH {VALID}
SELECT CAST({rule} AS INTEGER) AS is_weekend,
  CASE WHEN {rule} THEN 'weekend' ELSE 'weekday' END AS day_type,
  count(fare_amount) AS trip_count, {MEAN["fare_amount"]} AS avg_fare
FROM valid WHERE tpep_pickup_datetime IS NOT NULL GROUP BY 1, 2"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0e0)"


def _split(table: str, key: str, label: str) -> str:
    return f"""SELECT * EXCLUDE (total, n, tested, whole, rest, room, extra, rn),
    CASE WHEN rn <= whole + extra THEN 'test' ELSE 'train' END AS split
  FROM (SELECT t.*, c.* EXCLUDE ({label}),
      row_number() OVER (PARTITION BY t.{label} ORDER BY {_hash("t." + key, "42")}, t.{key}) AS rn
    FROM {table} t JOIN (
      SELECT *, CASE WHEN room AND row_number() OVER (ORDER BY CASE WHEN room THEN rest ELSE -1 END DESC,
        {label} NULLS FIRST) <= tested - CAST(sum(whole) OVER () AS BIGINT) THEN 1 ELSE 0 END AS extra
      FROM (SELECT *, whole + 1 < total AS room FROM (
        SELECT *, least(total * tested // n, total - 1) AS whole, total * tested % n AS rest
        FROM (SELECT *, CAST(ceil(25e-2 * n) AS BIGINT) AS tested
          FROM (SELECT {label}, count(*) AS total, CAST(sum(count(*)) OVER () AS BIGINT) AS n
            FROM {table} GROUP BY {label}))))) c ON t.{label} IS NOT DISTINCT FROM c.{label})"""


TEXT_SPLIT = f"""{LABELLED}, text_split AS (
  {_split("labelled", "doc_id", "sentiment").replace("25e-2", "2e-1")})"""


def _histogram() -> str:
    edge = "CASE WHEN {i} = 30 THEN hi ELSE lo + {i} * ((hi - lo) / 30e0) END"
    at, after = edge.format(i="guess"), edge.format(i="(guess + 1)")
    return f"""WITH {FEATURES}, data AS (SELECT coalesce(tip_rate, 0e0) AS x FROM features),
span AS (
  SELECT min(x) - CASE WHEN min(x) = max(x) THEN 5e-1 ELSE 0e0 END AS lo,
    max(x) + CASE WHEN min(x) = max(x) THEN 5e-1 ELSE 0e0 END AS hi FROM data),
guessed AS (
  SELECT x, lo, hi, least(CAST(floor((x - lo) / (hi - lo) * 30e0) AS BIGINT), 29) AS guess
  FROM data, span),
placed AS (
  SELECT guess - CASE WHEN x < {at} THEN 1 ELSE 0 END
    + CASE WHEN guess < 29 AND x >= {after} THEN 1 ELSE 0 END AS bin FROM guessed)
SELECT b.bin, {edge.format(i="b.bin")} AS lower, {edge.format(i="(b.bin + 1)")} AS upper,
  (SELECT count(*) FROM placed p WHERE p.bin = b.bin) AS n
FROM (SELECT range AS bin FROM range(30)) b, span"""


def _median_impute() -> str:
    medians = ", ".join(f"median({c}) AS {c}" for c in NUMERIC)
    filled = ", ".join(f"coalesce(n.{c}, m.{c}) AS {c}" for c in NUMERIC)
    return f"""WITH {TRIPS}, numbers AS (
  SELECT trip_id, passenger_count, trip_distance, fare_amount, total_amount,
    CAST(hour(tpep_pickup_datetime) AS DOUBLE) AS pickup_hour,
    CAST(isodow(tpep_pickup_datetime) - 1 AS DOUBLE) AS pickup_dayofweek FROM trips),
medians AS (SELECT {medians} FROM numbers)
SELECT trip_id, {filled} FROM numbers n, medians m"""


def _standard_scale() -> str:
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMERIC))
    scaled = ", ".join(f"round(({c} - m{i}) / s{i}, 6) + 0e0 AS {c}" for i, c in enumerate(NUMERIC))
    return f"""WITH {MODEL_INPUT}, stats AS (SELECT {stats} FROM model_input)
SELECT trip_id, {scaled} FROM model_input, stats"""


def _one_hot() -> str:
    levels, slots = [], []
    for c in CATEGORICAL:
        levels.append(
            f"{c}_levels AS (SELECT {c}_text, row_number() OVER (ORDER BY {c}_text) AS slot FROM "
            f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS {c}_text FROM split WHERE split = 'train'))"
        )
        slots.append(
            f"CAST(coalesce((SELECT slot FROM {c}_levels l "
            f"WHERE l.{c}_text = coalesce(CAST(t.{c} AS VARCHAR), 'missing')), 0) AS INTEGER) AS {c}"
        )
    return f"""WITH {MODEL_INPUT}, split AS ({_split("model_input", "trip_id", "high_tip")}),
{", ".join(levels)}
SELECT trip_id, {", ".join(slots)} FROM trips t"""


def _pipeline_vectors() -> str:
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMERIC))
    scaled = ", ".join(f"round(({c} - m{i}) / s{i}, 6) + 0e0 AS {c}" for i, c in enumerate(NUMERIC))
    levels = " UNION ALL ".join(
        f"SELECT {i} AS feature, CAST({c} AS VARCHAR) AS level FROM train" for i, c in enumerate(CATEGORICAL)
    )
    held = " UNION ALL ".join(
        f"SELECT trip_id, {i} AS feature, CAST({c} AS VARCHAR) AS level FROM model_input"
        for i, c in enumerate(CATEGORICAL)
    )
    return f"""WITH {MODEL_INPUT}, train AS (
  SELECT * FROM ({_split("model_input", "trip_id", "high_tip")}) WHERE split = 'train'),
stats AS (SELECT {stats} FROM train),
slots AS (SELECT *, row_number() OVER (ORDER BY feature, level) AS slot FROM (SELECT DISTINCT * FROM ({levels}))),
ones AS (
  SELECT trip_id, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) AS ones
  FROM ({held}) h JOIN slots USING (feature, level) GROUP BY trip_id)
SELECT trip_id, {scaled}, coalesce(ones, '') AS ones,
  CAST({len(NUMERIC)} + (SELECT count(*) FROM slots) AS INTEGER) AS n_slots
FROM model_input LEFT JOIN ones USING (trip_id), stats"""


def _lr_fit() -> str:
    return f"""WITH {TEXT_SPLIT},
worded AS (SELECT doc_id, {_words(_clean("coalesce(text, '')"), stop=True)} AS words FROM text_split WHERE split = 'train'),
terms AS (
  SELECT DISTINCT doc_id, term FROM (
    SELECT doc_id, unnest(words) AS term FROM worded
    UNION ALL SELECT doc_id, unnest({_bigrams("words")}) AS term FROM worded)),
vocabulary AS (
  SELECT term FROM terms GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 85e-2 * (SELECT count(*) FROM worded))
SELECT (SELECT count(*) FROM worded) AS n_rows, (SELECT count(*) FROM vocabulary) AS n_terms, true AS converged"""


def _report() -> str:
    classes = "(SELECT label AS class FROM ruled UNION SELECT prediction FROM ruled)"
    precision, recall = _ratio("tp", "predicted"), _ratio("tp", "support")
    return f"""WITH {RULED_TEXTS}, totals AS (
  SELECT class, count(*) FILTER (WHERE label = class) AS support,
    count(*) FILTER (WHERE prediction = class) AS predicted,
    count(*) FILTER (WHERE label = class AND prediction = class) AS tp
  FROM ruled, {classes} GROUP BY class),
rates AS (SELECT class, {precision} AS p, {recall} AS r, support, tp FROM totals),
scores AS (SELECT *, coalesce(2e0 * p * r / nullif(p + r, 0), 0e0) AS f FROM rates),
listed AS (
  SELECT class, p, r, f, support FROM scores
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support),
    sum(tp) / sum(support), sum(support) FROM scores
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) FROM scores)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM listed"""


def oracle_sql() -> dict[str, str]:
    hourly = f"WITH {HOURLY} SELECT * FROM hourly"
    trips_whole = f"WITH {TRIPS} SELECT * FROM trips"
    features_whole = f"WITH {FEATURES} SELECT * FROM features"
    words = "SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, array_to_string(words, ' ') AS words"
    daily = "SELECT CAST(sale_date AS VARCHAR) AS sale_date, CAST(sum(sales) AS DOUBLE) AS sales FROM sales"
    sampled = f"WITH {TRIPS} SELECT {{columns}} FROM trips ORDER BY {_hash('trip_id', '42')}, trip_id LIMIT "
    filled = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'missing') AS {c}" for c in CATEGORICAL)
    return {
        "hourly_profile": hourly,
        "busiest_hour": f"{hourly} ORDER BY trip_count DESC, pickup_hour LIMIT 1",
        "highest_avg_fare_hour": f"{hourly} ORDER BY avg_fare DESC, pickup_hour LIMIT 1",
        "revenue_totals": f"""WITH {VALID}
SELECT count(*) AS total_rides, {SUM["fare_amount"]} AS total_fare_amount,
  {SUM["tip_amount"]} AS total_tip_amount, {SUM["total_amount"]} AS total_amount FROM valid""",
        "fare_averages": f"""WITH {VALID}
SELECT {MEAN["fare_amount"]} AS average_fare, {MEAN["tip_amount"]} AS average_tip,
  {MEAN["total_amount"]} AS average_total FROM valid""",
        "time_cube": f"""WITH {VALID}
SELECT CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
  CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS day_of_week, count(*) AS n_rows,
  {", ".join(f"count({c}) AS {c}_count, {SUM[c]} AS {c}_sum" for c in MONEY)}
FROM valid GROUP BY 1, 2""",
        "weekday_weekend": _weekend("isodow(tpep_pickup_datetime) >= 6"),
        "weekday_weekend_fri_sat": _weekend("isodow(tpep_pickup_datetime) IN (5, 6)"),
        "trips_preview": f"""WITH {TRIPS}
SELECT trip_id, tpep_pickup_datetime, fare_amount, tip_amount, total_amount
FROM trips ORDER BY trip_id LIMIT 5""",
        "trips_projected": f"""WITH {TRIPS}
SELECT tpep_pickup_datetime, VendorID, passenger_count, trip_distance, RatecodeID,
  store_and_fwd_flag, payment_type, fare_amount, tip_amount, total_amount FROM trips""",
        "valid_trips": f"WITH {VALID} SELECT * FROM valid",
        "high_tip_counts": f"WITH {FEATURES} SELECT high_tip, count(*) AS n FROM features GROUP BY 1",
        "tip_rate_histogram": _histogram(),
        "parquet_roundtrip": hourly,
        "csv_roundtrip": hourly,
        "csv_gzip_roundtrip": trips_whole,
        "processed_export": features_whole,
        "timestamp_coercion": f"""WITH {TRIPS}
SELECT trip_id, try_cast(CASE WHEN trip_id % 19 = 0 THEN concat('bad ', CAST(trip_id AS VARCHAR))
  ELSE CAST(tpep_pickup_datetime AS VARCHAR) END AS TIMESTAMP) AS tpep_pickup_datetime FROM trips""",
        "sample_exact": sampled.format(columns="*") + "1000",
        "sample_exact_by_cut": sampled.format(columns="trip_id, fare_amount") + "10000",
        "sample_exact_null_keys": f"""WITH {TRIPS} SELECT trip_id, store_and_fwd_flag FROM trips
ORDER BY md5(concat(coalesce(store_and_fwd_flag, ''), '|', CAST(trip_id AS VARCHAR), ':42')) LIMIT 1000""",
        "head_sample": f"{trips_whole} ORDER BY trip_id LIMIT 1000",
        "shuffled_reviews": f"""WITH {REVIEWS}
SELECT *, row_number() OVER (ORDER BY {_hash("review_id", "42")}, review_id) - 1 AS position
FROM reviews""",
        "stratified_split": f"""WITH split AS ({_split("labels", "doc_id", "toxic")})
SELECT doc_id, quality, toxic, split FROM split""",
        "trip_features": features_whole,
        "model_input": f"WITH {MODEL_INPUT} SELECT * FROM model_input",
        "median_impute": _median_impute(),
        "standard_scale": _standard_scale(),
        "constant_impute": f"WITH {TRIPS} SELECT trip_id, {filled} FROM trips",
        "one_hot": _one_hot(),
        "pipeline_vectors": _pipeline_vectors(),
        "rf_predictions": f"""WITH {MODEL_INPUT}, split AS ({_split("model_input", "trip_id", "high_tip")})
SELECT trip_id, high_tip, true AS score_in_range, true AS class_agrees FROM split WHERE split = 'test'""",
        "rf_evaluation": f"""WITH {MODEL_INPUT}, split AS ({_split("model_input", "trip_id", "high_tip")})
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
  count(*) FILTER (WHERE split = 'test' AND high_tip = 1) AS n_high, true AS better_than_chance,
  true AS rates_in_range, true AS f1_agrees, CAST(100 AS BIGINT) AS n_trees, true AS rows_add_up,
  true AS leaves_vote, true AS within_depth FROM split""",
        "lr_predictions": f"""WITH {TEXT_SPLIT}
SELECT doc_id, sentiment, true AS score_in_range, true AS class_agrees FROM text_split WHERE split = 'test'""",
        "lr_evaluation": f"""WITH {TEXT_SPLIT}, tested AS (SELECT sentiment FROM text_split WHERE split = 'test')
SELECT class, CAST(n AS BIGINT) AS support, true AS rates_in_range, true AS f1_agrees FROM (
  SELECT sentiment AS class, count(*) AS n FROM tested GROUP BY 1
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT count(*) FROM tested))""",
        "lr_fit": _lr_fit(),
        "top_tokens": """SELECT unnest(['positive', 'negative']) AS side, CAST(12 AS BIGINT) AS n_tokens,
  true AS signs_agree, true AS in_vocabulary""",
        "synthetic_reviews": f"WITH {REVIEWS} SELECT * FROM reviews",
        "sentiment_label_counts": f"WITH {LABELLED} SELECT sentiment, count(*) AS n FROM labelled GROUP BY 1",
        "clean_text": f"WITH {CLEANED} SELECT * FROM cleaned",
        "tokens": f"""WITH {CLEANED},
worded AS (SELECT doc_id, {_words("clean_text", stop=False)} AS words FROM cleaned)
{words} FROM worded""",
        "stopword_filtered": f"""WITH {CLEANED},
worded AS (SELECT doc_id, {_words("clean_text", stop=True)} AS words FROM cleaned)
{words} FROM worded""",
        "ngrams": f"WITH {TERMS} SELECT * FROM tf",
        "doc_freq_vocab": f"WITH {VOCABULARY} SELECT term, df, round(idf, 6) AS idf FROM vocabulary",
        "tfidf": f"""WITH {VOCABULARY},
weighted AS (SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN vocabulary USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf
FROM weighted""",
        "learned_lexicon": f"WITH {LEXICON} SELECT * FROM lexicon",
        "lexicon_polarity": f"WITH {POLAR} SELECT * FROM scored",
        "sentiment_classes": f"WITH {POLAR} SELECT sentiment_class, count(*) AS n FROM scored GROUP BY 1",
        "sentiment_phrases": f"""WITH {POLAR},
kept AS (
  SELECT sentiment_class, {_words(_clean("coalesce(text, '')"), stop=True)} AS words
  FROM documents JOIN scored USING (doc_id)),
counted AS (
  SELECT sentiment_class, phrase, count(*) AS n
  FROM (SELECT sentiment_class, unnest({_bigrams("words")}) AS phrase FROM kept) GROUP BY ALL),
sized AS (
  SELECT *, CAST(n AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY phrase) AS DOUBLE) - n AS b,
    CAST(sum(n) OVER (PARTITION BY sentiment_class) AS DOUBLE) AS size, CAST(sum(n) OVER () AS DOUBLE) AS whole
  FROM counted),
ratios AS (
  SELECT sentiment_class, phrase, n, round(2 * (a * ln(a / (size * ((a + b) / whole)))
    + CASE WHEN b > 0 THEN b * ln(b / ((whole - size) * ((a + b) / whole))) ELSE 0e0 END), 6) AS g2
  FROM sized WHERE a * (whole - size) > b * size)
SELECT sentiment_class, phrase, n, g2, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sentiment_class ORDER BY g2 DESC, phrase) AS rank
  FROM ratios) WHERE rank <= 5""",
        "binary_metrics": f"""WITH {RULED_TRIPS}, counts AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS agreed,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE prediction = 1) AS predicted, count(*) FILTER (WHERE label = 1) AS actual
  FROM ruled),
rates AS (
  SELECT {_ratio("agreed", "n")} AS a, {_ratio("tp", "predicted")} AS p, {_ratio("tp", "actual")} AS r
  FROM counts)
SELECT round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
  round(coalesce(2e0 * p * r / nullif(p + r, 0), 0e0), 6) AS f1 FROM rates""",
        "roc_auc": f"""WITH {RULED_TRIPS}, by_score AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ruled GROUP BY score),
ranked AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS below FROM by_score)
SELECT CAST(sum(pos + neg) AS BIGINT) AS n,
  round(CAST(sum(pos * (below + neg / 2e0)) AS DOUBLE) / (sum(pos) * sum(neg)), 6) AS roc_auc
FROM ranked""",
        "classification_report": _report(),
        "confusion_matrix": f"""WITH {RULED_TEXTS}
SELECT label AS actual, count(*) FILTER (WHERE prediction = 'positive') AS positive,
  count(*) FILTER (WHERE prediction = 'negative') AS negative FROM ruled GROUP BY 1""",
        "daily_sales": f"WITH {SALES} {daily} GROUP BY 1",
        "daily_sales_filtered": f"""WITH {SALES} {daily}
WHERE region IN ('ASIA', 'EUROPE') AND category IN ('ECONOMY', 'PROMO') GROUP BY 1""",
        "profit_share": f"""WITH {SALES}
SELECT category, CAST(sum(profit) AS DOUBLE) AS profit,
  round(CAST(sum(profit) AS DOUBLE) / (SELECT CAST(sum(profit) AS DOUBLE) FROM sales), 6) AS share
FROM sales GROUP BY 1""",
        "underperforming_regions": f"""WITH {SALES}, per_region AS (
  SELECT region, CAST(sum(sales) AS DOUBLE) AS sales FROM sales GROUP BY 1)
SELECT * FROM per_region WHERE sales < (SELECT avg(sales) FROM per_region)""",
        "high_margin_categories": f"""WITH {SALES}
SELECT category, round(CAST(sum(profit) AS DOUBLE) / CAST(sum(sales) AS DOUBLE), 6) AS margin
FROM sales GROUP BY 1
ORDER BY CAST(sum(profit) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) DESC, category LIMIT 3""",
    }
