"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.llm import (
    decontaminate,
    lines,
    mixing,
    nearest,
    ngram_join,
    prefix_trie,
    spelling,
    substrings,
    toxicity,
    urls,
    vectors,
    warc,
    wavelet,
)
from tripwise.llm.tables import table

TOKENIZER = "byte_bpe_50k.json"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judged_urls(table(spark, sf_dir, "pages"))
    return judged.withColumnRenamed("key", "page_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeat_digests(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("key", "doc_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "row.doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet.token_table(docs, public_tokenizers.path(TOKENIZER))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.linked_documents(table(spark, sf_dir, "documents"))
    return linked.withColumnRenamed("id", "doc_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "row.doc_id",
        toxicity.held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.without_repeated_lines(docs)
    return cut.select("row.doc_id", "n_lines", "n_removed", "kept_sha256")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    linked = vectors.linked_vectors(rows)
    return linked.select("row.vec_id", "n_links", "component_id", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = spelling.spelling_groups(table(spark, sf_dir, "documents"))
    return grouped.select("word", "form", "root", "n", "n_near", "form_n")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    rebuilt, convs = prefix_trie.crossed(turns)
    return prefix_trie.prefix_trie(rebuilt, convs).drop("digest")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_substring_dedup,
        op3_benchmark_decontamination,
        op4_token_ids,
        op5_ngram_jaccard_join,
        op6_source_mixing,
        op7_warc,
        op8_toxicity,
        op9_line_dedup,
        op10_embedding_near_dedup,
        op11_spelling_variants,
        op12_conversation_prefix_trie,
        op13_nearest_neighbours,
    )
}

FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The table of the reflected CRC-32 and the checksum of the UTF-8 bytes of a text with it.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""
CRC = """xor(list_reduce(list_transform(range(CAST(octet_length(encode({0})) AS BIGINT)),
  lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, list(p) AS ps FROM win JOIN rep USING (s) GROUP BY doc_id),
words AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM (SELECT doc_id, unnest(ps) AS p FROM hit)),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS k, count(*) AS n
  FROM words w ANTI JOIN cov USING (doc_id, p) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({FOLD.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({FOLD.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
win AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT win.doc_id, win.n, win.p, g.item_id FROM win JOIN g ON win.s = g.s AND win.n = g.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER win AS place,
    CAST((sum(source_size) OVER () - coalesce(sum(source_size) OVER before, 0) * 3) AS BIGINT) AS rest,
    CAST((sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS BIGINT) AS open_
  FROM s WINDOW win AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST),
    before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT place AS p0, rest AS r0, open_ AS o0 FROM o WHERE rest * weight <= source_size * 3 * open_ ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN place >= p0 THEN CAST(weight * r0 AS DOUBLE) / o0
    ELSE CAST(source_size * 3 AS DOUBLE) END AS target FROM o, f),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 1 END AS copies FROM t),
r AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - CAST(c.copies * c.source_size AS DOUBLE) AS left_,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN copies < 3 AND 2 * (upto - own) + own <= 2 * left_ THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
win AS (SELECT doc_id, p, l[p:p + 2] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM ranked WHERE k > 1),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS k, count(*) AS n FROM lines ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_spelling_variants": f"""
WITH {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({FOLD.format('text')}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
checked AS (SELECT run, k, {CRC.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS c FROM once, crc),
damaged AS (SELECT k, CASE WHEN c % 97 = 0 THEN substr(run, 1, c % length(run)) || substr(run, c % length(run) + 2)
  ELSE run END AS word FROM checked),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || '|' || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocab)),
gone AS (SELECT DISTINCT word, n, replace(rest, '|', '') AS rest FROM cut),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT g.word, g.n, v.word, v.n FROM gone g JOIN vocab v ON g.rest = v.word
  UNION ALL SELECT v.word, v.n, g.word, g.n FROM gone g JOIN vocab v ON g.rest = v.word),
best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word, n),
known AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 2 * v.n THEN b.near_n END AS form_n FROM vocab v LEFT JOIN best b USING (word))
SELECT k.*, last.root FROM known k JOIN (
  WITH RECURSIVE steps AS (SELECT word, word AS root FROM known
    UNION ALL SELECT s.word, k.form FROM steps s JOIN known k ON k.word = s.root WHERE k.form IS NOT NULL)
  SELECT s.word, s.root FROM steps s JOIN known k ON k.word = s.root WHERE k.form IS NULL) last USING (word)""",
    "op12_conversation_prefix_trie": f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST,
    md5(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) AS l FROM t GROUP BY conv_id),
heads AS (SELECT conv_id, l, {CRC.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM own, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS node FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends
  FROM member GROUP BY node, d),
valued AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(node[d].text)) END AS saved,
    (SELECT count(*) FROM node c WHERE c.d = node.d + 1 AND c.node[1:node.d] = node.node) AS n_children FROM node),
below AS (SELECT x.node, x.d, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, CAST(sum(y.saved) AS BIGINT) AS saved_tokens
  FROM valued x JOIN valued y ON y.d >= x.d AND y.node[1:x.d] = x.node GROUP BY x.node, x.d)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens,
  sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN below b ON b.node = v.node AND b.d = v.d
  LEFT JOIN node p ON p.d = v.d - 1 AND p.node = v.node[1:v.d - 1]""",
    # The windows of tables of up to about a thousand vectors hold them all; there the search is exact.
    "op13_nearest_neighbours": """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, q.e,
    sqrt(list_reduce(list_transform(range(len(q.e)), lambda i: (q.e[i + 1] - c.e[i + 1]) * (q.e[i + 1] - c.e[i + 1])),
      lambda a, b: a + b, 0e0)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR q.e <> c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    # Tables of up to about two thousand vectors have no grid; there all are compared.
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) >= 9e-1 * a.size * b.size),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT m.vec_id, (SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS n_links,
  (SELECT min(b) FROM reach r WHERE r.a = m.vec_id) AS component_id,
  m.vec_id = (SELECT min(b) FROM reach r WHERE r.a = m.vec_id) AS kept FROM embeddings m""",
}
