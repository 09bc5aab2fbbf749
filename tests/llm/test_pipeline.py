"""Every stage of the corpus pipeline against plain Python, each on the rows that the one before it kept."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_text_operators import plain_ftrl
from tripwise.llm import queries, toxicity
from tripwise.llm.words import letter_words, words_of

BITS = toxicity.FEATURE_BITS
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("row", pa.string()), ("n", pa.int64()), ("score", pa.float64())]
)


def texts():
    """``(doc_id, text, source)``: clean and toxic prose, near copies, benchmark passages and odd rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(180):
        words = rng.choices(vocabulary, k=rng.randint(30, 90))
        if i % 6 == 0:
            words[3:9] = ["vile", "scum", "awful", "vile", "trash", "scum"]
        rows.append((i, " ".join(words), "abc"[i % 3] if i % 4 else "hot"))
    for k, i in enumerate(range(1, 40, 6)):
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + k, " ".join(words), "a"))
        rows.append((300 + k, rows[i][1] + " with two", None))
    item = " ".join(vocabulary[:20])
    rows += [(400, rows[2][1][:60] + " " + item, "b"), (401, rows[3][1] * 5 + " " + item, "b")]
    rows += [(500, None, "a"), (501, "", "a"), (502, " \n ", None), (503, "one", "b"), (504, "ONE", "b")]
    rows += [(505, "same row", "c"), (505, "same row", "c"), (None, "without an id", "c"), (None, rows[5][1], "c")]
    rows += [(506, "  two  spaces\tand ñandú 日本 ", "a"), (507, " ".join(f"long{i}" for i in range(20_000)), "hot")]
    return rows, item


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, item = texts()
    columns = [*zip(*rows), ["clash"] * len(rows), [7] * len(rows), [0.5] * len(rows)]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA), path / "documents.parquet")
    labels = [(i, int("vile" in (t or ""))) for i, t, _ in rows if i is not None and i < 180] + [(None, 1), (9999, 1), (5, None)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "toxic": pa.array([r[1] for r in labels], pa.int32())}), path / "labels.parquet")
    items = [("t1", item), ("t2", None), (None, ""), ("t1", item)]
    pq.write_table(pa.table({"item_id": [r[0] for r in items], "text": pa.array([r[1] for r in items], pa.string())}), path / "benchmark.parquet")
    return str(path)


def grams(text):
    words = words_of(pa.array([text or ""]), letter_words(), fold=True)
    return sorted(set(toxicity.gram_features(words, BITS)[1].tolist()))


def shown(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def plain_toxicity(spark, rows, folder):
    """FTRL over the labelled rows that are not held out, in the order of the operator's hash."""
    labels = {}
    for r in pq.read_table(f"{folder}/labels.parquet").to_pylist():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            labels[r["doc_id"]] = max(r["toxic"], labels.get(r["doc_id"], 0))
    ids = spark.createDataFrame([(i,) for i in labels], "id bigint").selectExpr("id", "xxhash64(id, 42) AS h").collect()
    order = {r["id"]: r["h"] for r in ids}
    known = sorted((order[i], grams(t), labels[i]) for i, t, _ in rows if i in labels)
    weights = plain_ftrl([(y, x) for _, x, y in known], toxicity.Ftrl())
    bias = weights.pop("bias", 0.0)
    kept = Counter()
    for row in rows:
        total = bias + sum(weights.get(i, 0.0) for i in grams(row[1]))
        if 1 / (1 + np.exp(-total)) < toxicity.THRESHOLD:
            kept[row] += 1
    return kept


def plain_groups(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [brute.shingles(t, 5) for _, t, _ in rows]
    root = brute.groups(range(len(rows)), brute.jaccard_links(sets, 80))
    return {rows[k] for k in root if root[k] == k}, [[rows[j] for j in root if root[j] == k] for k in root if root[k] == k]


def plain_clean(rows, folder):
    items = [r["text"] for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    windows = set()
    for text in items:
        words = brute.LETTER_WORDS.findall((text or "").translate(brute.UPPER))
        n = min(13, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    kept = []
    for row in rows:
        words = brute.LETTER_WORDS.findall((row[1] or "").translate(brute.UPPER))
        hit = set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.append(row)
    return Counter(kept)


def plain_mix(rows):
    """Each document as often as the SQL of the mixing operator takes it."""
    connection = duckdb.connect()
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], names=["doc_id", "text", "source"])
    connection.register("documents", table)
    sql = queries.ORACLE_SQL["op6_source_mixing"].replace("SELECT doc_id, size, source_size, target,", "SELECT doc_id, size,").replace(
        "CAST(size * (copies + CASE", "CAST(1 * (copies + CASE"
    )
    taken = {(i, size): n for i, size, n in connection.execute(sql).fetchall()}
    words = {row: len(brute.SPACE_WORDS.findall(row[1] or "")) for row in rows}
    return Counter({row: n for row in rows if (n := taken[row[0], words[row]])})


def plain_tokens(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    start, out = 0, []
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return Counter(out)


def test_each_stage_keeps_the_right_rows(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]

    docs = stages["toxicity"](spark, docs, folder)
    kept = shown(docs.collect())
    assert kept == plain_toxicity(spark, rows, folder)
    assert len(rows) - 40 < kept.total() < len(rows) - 20 and docs.schema.names == SCHEMA.names

    docs = corpus_pipeline.written(stages["ngram_jaccard_join"](spark, docs, folder), "grouped")
    least, groups = plain_groups(list(kept))
    kept = shown(docs.collect())
    assert set(kept) == least and kept.total() == len(least) and max(map(len, groups)) >= 3

    docs = corpus_pipeline.written(stages["benchmark_decontamination"](spark, docs, folder), "clean")
    wanted = plain_clean(list(kept.elements()), folder)
    assert shown(docs.collect()) == wanted and wanted.total() < kept.total()

    docs = corpus_pipeline.written(stages["source_mixing"](spark, docs, folder), "mixed")
    mixed_ = plain_mix(list(wanted))
    assert shown(docs.collect()) == mixed_ and docs.schema.names == SCHEMA.names

    tokens = stages["token_ids"](spark, docs, folder)
    wanted = plain_tokens(list(mixed_.elements()))
    assert Counter(tuple(r) for r in tokens.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == wanted
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == wanted


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.count() == 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
