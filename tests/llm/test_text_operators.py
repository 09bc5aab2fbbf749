import math
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tripwise.llm import decontaminate, lines, mixing, ngram_join, substrings, toxicity, wavelet
from tripwise.llm.queries import TOKENIZER
from tripwise.llm.tables import BATCH_BYTES, BATCH_SETTING, SWEEP_SETTING, small_batches, table

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(60))
CASES = [
    (1, LONG, "a"),
    (2, f"before  {LONG}\tafter", "a"),
    (3, None, None),
    (4, "", "a"),
    (None, LONG, "b"),
    (4, " \n\t ", "a"),
    (5, "one", "a"),
    (5, "one", "a"),
    (6, "ONE", None),
    (7, "same " * 100, "c"),
    (8, LONG.replace("w30 ", "x30 ") + " " + LONG[:100] + " ñandú Ünï\u00a0code", "c"),
    (9, " ".join(f"v{i}" for i in range(30_000)), "c"),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(*row, k, -k) for k, row in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int, row int")


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF_DIR, "documents")


def by_row(df):
    return {r["row"]["row"]: r for r in df.collect()}


def test_substring_dedup_edges(cases):
    found = by_row(substrings.without_repeats(cases))
    wanted = brute.removed_words([c[1] for c in CASES])
    for k, (n, removed, kept) in enumerate(wanted):
        own = found[-k]
        assert own["n_removed"] == removed
        if removed:
            assert own["kept"] == kept
    assert len(found) == len(CASES)


def test_substring_digests(documents):
    rows = documents.select("doc_id", "text").collect()
    found = {r["key"]: r for r in substrings.repeat_digests(documents).collect()}
    for row, (n, removed, kept) in zip(rows, brute.removed_words([r["text"] for r in rows])):
        own = found[row["doc_id"]]
        assert (own["n_words"], own["n_removed"]) == (n, removed)
        assert own["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_decontamination_edges(spark, cases):
    tests = [("t1", LONG[:80]), ("t2", "ONE"), (None, "v5 v6"), ("t3", None), ("t4", "..."), ("t2", "one")]
    benchmark = spark.createDataFrame(tests, "item_id string, text string")
    whole = by_row(decontaminate.contamination(cases, benchmark))
    for parts in (1, 40):
        found = by_row(decontaminate.contamination(cases, benchmark, set_bytes=parts))
        assert {k: (r["spans"], r["items"]) for k, r in found.items()} == {
            k: (r["spans"], r["items"]) for k, r in whole.items()
        }
    for k, (_, text, _) in enumerate(CASES):
        words = brute.LETTER_WORDS.findall((text or "").translate(brute.UPPER))
        hit, items = set(), set()
        for item, test in tests:
            grams = brute.LETTER_WORDS.findall((test or "").translate(brute.UPPER))
            n = min(len(grams), 13)
            wanted = {tuple(grams[i : i + n]) for i in range(len(grams) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    items |= {item} - {None}
        own = whole[-k]
        assert own["n_words"] == len(words)
        assert sum(s["last"] - s["first"] for s in own["spans"]) == len(hit)
        assert own["items"] == sorted(items)
    cut = {r["row"]: r["text"] for r in decontaminate.remove_spans(cases, benchmark).collect()}
    assert cut[-6] == "" and "v5" not in cut[-11].split() and "v7" in cut[-11].split()


def test_decontamination_of_nothing(spark, cases):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.remove_documents(cases, empty).count() == len(CASES)
    assert decontaminate.remove_documents(cases.limit(0), empty).count() == 0


def wanted_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_encoder_equals_the_library():
    texts = [
        "a  b",
        " lead",
        "trail ",
        "x\n y\n\nz",
        "tab\t tab",
        "a \u00a0b\u3000 c",
        "it's 12 o'clock -- (ok)",
        "<|endoftext|> a<|endoftext|> b",
        "",
        " ",
        "   ",
        "ñandú 日本 語",
        "a" * 3000,
    ]
    texts += ["same words\u0085 same words " * 9, "\u2003x y \u3000 z", "à b à\u00a0c ", "日本 語 " * 400]
    encoder = wavelet.Encoder(public_tokenizers.path(TOKENIZER))
    for _ in range(2):
        found = encoder.encode(texts)
        assert [np.frombuffer(f, "<u4").tolist() + [0] for f in found] == wanted_ids(texts)


def test_encoder_with_small_memory_small_slices_and_equal_hashes(monkeypatch):
    texts = [f"word{i % 7} word{i % 11}  x{i}" for i in range(200)] + ["unbroken" * 2000, None or ""]
    wanted = wanted_ids(texts)
    monkeypatch.setattr(wavelet, "CACHED_BYTES", 3000)
    monkeypatch.setattr(wavelet, "SLICE_BYTES", 300)
    encoder = wavelet.Encoder(public_tokenizers.path(TOKENIZER))
    assert [np.frombuffer(f, "<u4").tolist() + [0] for f in encoder.encode(texts)] == wanted
    assert encoder.held <= 3000
    monkeypatch.setattr(wavelet, "mixed", lambda x: x * np.uint64(0))
    assert [np.frombuffer(f, "<u4").tolist() + [0] for f in encoder.encode(texts)] == wanted


def test_encoder_cuts_where_the_library_does():
    rng = np.random.default_rng(5)
    pieces = ["a", "s", "t", "Z", "é", "ß", "×", "÷", "日", "ſ", "\u0301", "1", "٣", " ", " ", "\n", "\n", "\r", "\t", "\u0085", "\u00a0", "\u2003"]
    pieces += [".", ",", "'", "-", "|", "<", "Ġ", "Ċ", "\x00", "\x1c", "😀", "word", "été", "'s", "'ll"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 40))) for _ in range(3000)]
    marked = ["".join(rng.choice([*pieces, "<|endoftext|>"], 12)) for _ in range(300)]
    for own in (texts, marked, [" ".join(texts)]):
        encoder = wavelet.Encoder(public_tokenizers.path(TOKENIZER))
        for _ in range(2):
            found = encoder.encode(own)
            assert [np.frombuffer(f, "<u4").tolist() + [0] for f in found] == wanted_ids(own)


def test_words_beside_marks_and_lines_are_run_once(monkeypatch):
    words = ["".join(chr(97 + int(c)) for c in f"{i * 7919:07d}") for i in range(1, 1001)]
    encoder = wavelet.Encoder(public_tokenizers.path(TOKENIZER))
    ran = []
    plain = encoder._run
    monkeypatch.setattr(encoder, "_run", lambda texts: ran.extend(texts) or plain(texts))
    for text in (" ".join(f"a {w} {w}. {w}, {w}! {w}" for w in words), "a\n" + "\n".join(f"{w}.\n{w}" for w in words)):
        (found,) = encoder.encode([text])
        assert np.frombuffer(found, "<u4").tolist() + [0] == wanted_ids([text])[0]
    # Each word with a space and without, some to a text.
    assert sum(map(len, ran)) <= 1.2 * 2 * sum(len(w) + 1 for w in words) and len(ran) <= 50


def test_access_reads_without_decoding(monkeypatch):
    """A matrix holds the bytes of its file alone, and one access unpacks one block a plane at most."""
    ids = np.random.default_rng(2).integers(0, 1 << 16, 100_000).astype(np.uint32)
    payload = wavelet.encode_shard([1], np.array([100_000]), ids, 16)
    assert len(payload) < 2.2 * len(ids)
    matrix = wavelet.WaveletMatrix(payload)
    assert all(part.base is not None for part in (*matrix.bits, *matrix.ranks))
    unpacked = []
    plain = np.unpackbits
    monkeypatch.setattr(wavelet.np, "unpackbits", lambda a, **k: unpacked.append(len(a)) or plain(a, **k))
    assert matrix.access(77_777) == ids[77_777]
    assert sum(unpacked) <= 16 * wavelet.BLOCK // 8


def test_token_table_edges(cases):
    rows = sorted(
        CASES, key=lambda c: (c[0] is not None, c[0] or 0, (c[1] or "").encode())
    )
    start, wanted = 0, []
    for (key, *_), ids in zip(rows, wanted_ids([c[1] for c in rows])):
        wanted.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = wavelet.token_table(cases, public_tokenizers.path(TOKENIZER), shard_bytes=400)
    order = lambda r: (r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(wanted, key=order)
    assert wavelet.token_table(cases.limit(0), public_tokenizers.path(TOKENIZER)).count() == 0


def test_consecutive_copies_keep_their_places(spark):
    docs = spark.createDataFrame([(None, "x"), (0, "x"), (2, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    copied = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(3))))
    path = public_tokenizers.path(TOKENIZER)
    once = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.token_table(docs, path).collect()}
    rows = wavelet.token_table(copied.coalesce(1), path).orderBy("start").collect()
    assert len(rows) == 15 and {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows} == once
    assert [r["doc_id"] for r in rows] == [None] * 3 + [0] * 3 + [2] * 6 + [3] * 3
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(15)]


def test_wavelet_matrix_queries():
    ids = np.random.default_rng(1).integers(0, 40, 3000).astype(np.uint32)
    matrix = wavelet.WaveletMatrix(wavelet.encode_shard([5, None], np.array([1000, 2000]), ids, 6))
    assert matrix.decode().tolist() == ids.tolist()
    assert matrix.doc_ids == [5, None]
    for at in (0, 511, 512, 1777, 2999):
        assert matrix.access(at) == ids[at]
    for value in (0, 7, 39, 40, 63, 64):
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places)
        assert matrix.count(value, 1500) == (places < 1500).sum()
        for k in (0, len(places) // 2, len(places) - 1):
            if len(places):
                assert matrix.occurrence(value, k) == places[k]
    with pytest.raises(IndexError):
        matrix.occurrence(40, 0)


@pytest.mark.parametrize("percent", [90, 70])
def test_jaccard_join(documents, percent):
    rows = documents.select("doc_id", "text").collect()
    sets = [brute.shingles(r["text"]) for r in rows]
    links = brute.jaccard_links(sets, percent)
    wanted = brute.groups([r["doc_id"] for r in rows], [(rows[a]["doc_id"], rows[b]["doc_id"]) for a, b in links])
    found = ngram_join.linked_documents(documents, percent=percent).collect()
    assert {r["id"]: r["component_id"] for r in found} == wanted
    assert {r["id"]: r["n_shingles"] for r in found} == {r["doc_id"]: len(s) for r, s in zip(rows, sets)}


def test_jaccard_join_of_families(spark):
    """Texts of all small sizes with one word changed, dropped or added, and chains of them."""
    rng = np.random.default_rng(3)
    texts = []
    for size in [*range(1, 45), 120]:
        base = [f"f{size}_{i}" for i in range(size)]
        texts.append(" ".join(base))
        for _ in range(6):
            own = texts[-1].split()
            at = int(rng.integers(0, max(1, len(own))))
            change = rng.integers(0, 3)
            own[at : at + (change > 0)] = [] if change == 2 else [f"n{rng.integers(1 << 30)}"]
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links = brute.jaccard_links([brute.shingles(t) for t in texts])
    found = {r["id"]: r["component_id"] for r in ngram_join.linked_documents(df).collect()}
    assert found == brute.groups(range(len(texts)), links)


def test_jaccard_join_edges(cases):
    found = ngram_join.linked_documents(cases).collect()
    assert len(found) == len(CASES)
    own = {(r["id"], r["n_shingles"]): r["component_id"] for r in found}
    assert own[3, 0] == 3 and own[4, 0] == 4 and own[5, 1] == 5 and own[6, 1] == 5
    assert own[None, 58] == 1 and own[1, 58] == 1
    kept = ngram_join.one_of_each_group(cases)
    assert kept.columns == cases.columns
    # Rows -6 and -7 are equal in id and text; either may stay.
    assert sorted(-7 if r["row"] == -6 else r["row"] for r in kept.collect()) == [-11, -10, -9, -7, -5, -3, -2, 0]
    assert ngram_join.linked_documents(cases.limit(0)).count() == 0


def test_mixing_edges(cases):
    mixed = mixing.mix(cases).collect()
    assert len(mixed) == len(CASES)
    words = [len(brute.SPACE_WORDS.findall(c[1] or "")) for c in CASES]
    assert sorted(r["size"] for r in mixed) == sorted(words)
    assert abs(sum({r["source"]: r["target"] for r in mixed}.values()) - sum(words)) < 1e-6
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in mixed)
    out = mixing.mixed_documents(cases)
    assert out.columns == cases.columns
    assert out.count() == sum(r["copies"] for r in mixed)
    assert mixing.mix(cases.limit(0)).count() == 0


def test_mixing_targets(documents):
    rows = mixing.mix(documents).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest / 2 + 1
        assert own[0]["target"] <= 3 * own[0]["source_size"]


def test_line_dedup_edges(spark):
    rows = [
        (2, "a\nb\nc\nd"),
        (1, "a\nb\nc"),
        (3, "x\na\nb\nc\nd\ny"),
        (4, None),
        (5, "a\nb"),
        (None, "q\nr\ns"),
        (6, "q\nr\ns\nq\nr\ns"),
        (7, "z\nz\nz\nz"),
        (8, ""),
        (8, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r["row"]["doc_id"] or 0, r["n_lines"], r["n_removed"], r["kept"]) for r in lines.without_repeated_lines(df).filter("row.doc_id IS NULL OR row.doc_id <> 4").collect())
    assert found == [
        (0, 3, 0, "q\nr\ns"),
        (1, 3, 0, "a\nb\nc"),
        (2, 4, 3, "d"),
        (3, 6, 4, "x\ny"),
        (5, 2, 0, "a\nb"),
        (6, 6, 6, ""),
        (7, 4, 3, "z"),
        (8, 1, 0, ""),
        (8, 1, 0, ""),
    ]
    assert lines.without_repeated_lines(df.limit(0)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train_toxicity(docs, labels)
    scored = toxicity.scored(docs, model).select("row.doc_id", "score")
    held = scored.join(labels, "doc_id").filter(toxicity.held_out()).select("score", "toxic").collect()
    hits = sum(r["score"] >= 0.7 and r["toxic"] == 1 for r in held)
    toxic = sum(r["toxic"] for r in held)
    wrong = sum(r["score"] >= 0.7 and r["toxic"] == 0 for r in held)
    assert hits >= 0.7 * toxic and wrong <= 0.01 * len(held)
    assert len(model.features) < 20_000


def test_toxicity_edges(spark, cases):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (5, 0), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.train_toxicity(cases, labels)
    scored = toxicity.scored(cases, model).collect()
    assert len(scored) == len(CASES) and all(0 <= r["score"] <= 1 for r in scored)
    kept = toxicity.not_toxic(cases, model)
    assert kept.columns == cases.columns
    nothing = toxicity.train_toxicity(cases, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(cases, nothing).collect()} == {0.5}
    assert toxicity.scored(cases.limit(0), model).count() == 0


def plain_ftrl(samples, settings):
    """FTRL-proximal, one coordinate at a time, with dicts."""
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "bias" else settings.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * l1) / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for label, features in samples:
            at = [*features, "bias"]
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            g = (p - label) * (settings.positive_weight if label else 1.0)
            for i in at:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / settings.alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(5)
    samples = []
    for _ in range(300):
        label = float(rng.random() < 0.3)
        features = rng.integers(0, 30, 6)
        samples.append((label, np.unique(np.append(features, 40 + int(label)) if rng.random() < 0.8 else features)))
    settings = toxicity.Ftrl(alpha=0.7, l1=1.5, epochs=3)
    features, weights, bias = toxicity.fit_ftrl(samples, settings, 6)
    wanted = plain_ftrl([(y, x.tolist()) for y, x in samples], settings)
    assert bias == pytest.approx(wanted.pop("bias", 0.0))
    assert dict(zip(features.tolist(), weights)) == pytest.approx(wanted)


def test_settings_are_compared_on_training_rows_alone(spark):
    """Labels of held-out rows are wrong on purpose and change nothing."""
    words = F.when(F.col("id") % 4 == 0, "vile awful words").otherwise("some kind words")
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" x"), (F.col("id") % 17)).alias("text"))
    truth = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    wrong = truth.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    candidates = [toxicity.Ftrl(), toxicity.Ftrl(l1=1e6)]
    found = [
        sorted(map(tuple, toxicity.compared_settings(docs, labels, candidates, bits=12).collect())) for labels in (truth, wrong)
    ]
    assert found[0] == found[1]
    (_, n, toxic, caught, alarms, loss), (*_, dull) = found[0]
    assert n == docs.filter(~toxicity.held_out()).count() and toxic == caught and alarms == 0
    assert loss < dull


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join_of_chains_in_small_blocks(spark, monkeypatch, n, percent):
    """Chains in which only neighbours are similar, so that one pivot decides little, beside a shared passage."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for chain in range(6):
        text = [*rng.choice(words, 150), *words[:150]] if chain < 4 else list(rng.choice(words, 40))
        for _ in range(9):
            texts.append(" ".join(text))
            for at in rng.integers(0, len(text) // 2, 1 + 2 * (percent == 80)):
                text[at] = rng.choice(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    links = brute.jaccard_links([brute.shingles(t, n) for t in texts], percent)
    wanted = brute.groups(range(len(texts)), links)
    found = ngram_join.linked_documents(docs, n=n, percent=percent).collect()
    assert {r["id"]: r["component_id"] for r in found} == wanted
    assert 6 < len(set(wanted.values())) < len(texts)


def test_bitmap_lets_every_wanted_id_pass(spark):
    docs = spark.range(50_000).selectExpr("IF(id = 5, NULL, id) AS id", "'x' AS text")
    wanted = spark.range(0, 50_000, 97).selectExpr("IF(id = 97, NULL, id) AS of", "id AS node")
    passed = {r["id"] for r in ngram_join._likely(docs, wanted).select("id").collect()}
    assert {r["of"] for r in wanted.collect()} <= passed and len(passed) < 2_500


def batch_bytes(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return [r["n"] for r in df.mapInArrow(sizes, "n bigint").collect()]


def test_near_copy_stage_hands_over_small_batches(spark, monkeypatch):
    """Long rows do not make batches of 10,000 of them, and the session's own setting comes back."""
    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    before = spark.conf.get(BATCH_SETTING, None)
    held = []
    plain = ngram_join.written

    def watched(df, name):
        held.append((name, max(batch_bytes(long)) if name == "likely_pairs" else 0))
        return plain(df, name)

    monkeypatch.setattr(ngram_join, "written", watched)
    docs = spark.createDataFrame([(1, LONG), (2, LONG + " more"), (3, "other words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each_group(docs, n=5, percent=80).collect()) == [1, 3]
    largest = dict(held)["likely_pairs"]
    assert 0 < largest <= 1.1 * BATCH_BYTES < 4000 * 2000
    assert spark.conf.get(BATCH_SETTING, None) == before
    with pytest.raises(ValueError), small_batches(spark, 1 << 16):
        assert max(batch_bytes(long)) <= 1.1 * (1 << 16)
        raise ValueError
    assert spark.conf.get(BATCH_SETTING, None) == before


def test_copies_connected_by_one_comparison_are_not_compared_again(spark, monkeypatch):
    """Copies of one text agree on many fragments, whose pivots differ; one comparison each connects them."""
    rows = [(i, " ".join(f"t{k}" if k != 3 * i else f"own{i}" for k in range(150))) for i in range(12)]
    left, plain = {}, ngram_join.written

    def counted(df, name):
        done = plain(df, name)
        left[name] = done.count() if name in ("firsts", "rest_pairs") else None
        return done

    monkeypatch.setattr(ngram_join, "written", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = ngram_join.one_of_each_group(df, n=5, percent=80).collect()
    assert [r["doc_id"] for r in kept] == [0] and 0 < left["firsts"] <= len(rows) and left["rest_pairs"] == 0


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_sketches_let_all_similar_sets_pass(n, percent):
    """Similar sets differ in no more bits than in n-grams, folded or not; the sketch is small beside the n-grams."""
    rng = np.random.default_rng(7)
    for size in (5, 40, 300, 3000, 20_000):
        own = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        sketch = ngram_join._stacked([ngram_join._sketch(own, percent)])
        assert sketch.size <= max(16, own.nbytes // 8)
        for changed in (0, size // 50, size // 20):
            other = np.unique(np.concatenate([own[changed:], rng.integers(0, 1 << 63, changed // 2, np.uint64)]))
            theirs = ngram_join._stacked([ngram_join._sketch(other, percent)])
            x, y = sorted((sketch, theirs), key=lambda s: s.shape[1])
            while y.shape[1] > x.shape[1]:
                y = ngram_join._halved(y)
            assert ngram_join._turned(x, y)[0] <= len(np.setxor1d(own, other))
        strange = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        strange = ngram_join._stacked([ngram_join._sketch(strange, percent)])
        if size >= 300 and strange.shape == sketch.shape:
            assert ngram_join._turned(sketch, strange)[0] > ngram_join._differing(np.int64(size), np.int64(size), percent)


def passages(rng, texts=30):
    """Texts of their own words that agree on passages, so they share fragments but are not similar."""
    common = [" ".join(f"c{k}_{i}" for i in range(40)) for k in range(4)]
    own = [" ".join(f"t{t}_{i}" for i in range(120)) for t in range(texts)]
    return [" ".join([*(common[k] for k in sorted(rng.choice(4, 3, False))), text]) for text in own]


def test_near_copy_stage_cuts_only_likely_sets_and_sweeps_shuffles(spark, monkeypatch):
    """Texts that share passages are told apart by sketches; no n-grams are sent for them and no shuffle stays."""
    texts = passages(np.random.default_rng(5))
    texts += [texts[0] + " more", texts[1] + " more words"]
    sent, swept, plain = [], [], ngram_join.written

    def counted(df, name):
        done = plain(df, name)
        swept.append(spark.conf.get(SWEEP_SETTING, None))
        if name == "fragments":
            sent.append(done.select("node").distinct().count())
        return done

    before = spark.conf.get(SWEEP_SETTING, None)
    monkeypatch.setattr(ngram_join, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = ngram_join.one_of_each_group(df, n=5, percent=80).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(30))
    assert sent and max(sent) <= 4
    assert swept[0] == "true" and spark.conf.get(SWEEP_SETTING, None) == before


@pytest.mark.parametrize("listed", [0, 1, 1000])
def test_promising_sets_as_pairs_and_by_blocks(spark, monkeypatch, listed):
    """Whether a block pair lists its pairs or hands on its rows, the components are those of brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "LISTED_PAIRS", listed)
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(4):
        text = [*rng.choice(words, 120), *words[:200]]
        for _ in range(10):
            texts.append(" ".join(text))
            for at in rng.integers(0, 120, 4):
                text[at] = rng.choice(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    links = brute.jaccard_links([brute.shingles(t, 5) for t in texts], 80)
    wanted = brute.groups(range(len(texts)), links)
    found = ngram_join.linked_documents(docs, n=5, percent=80).collect()
    assert {r["id"]: r["component_id"] for r in found} == wanted
