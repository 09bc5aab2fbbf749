"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed words, word pairs and pairs with one word between. Each
coordinate learns at its own rate and L1 keeps most of the weights at zero, so the model is a
short list that every task gets.

Defined cases: a null or empty text has no features, so it scores the bias; labelled rows
without a label, or whose document is missing, are left out; a document with several labels
is toxic if one says so; without any training rows, or with one class only, the weights are
zero but for the bias. Extra columns travel in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tripwise.llm.words import Words, letter_words, mixed, slices, words_of
from tripwise.sources.shared import written

# Labelled documents that the model is fitted on, about; chosen by hash of the id.
TRAIN_DOCS = 12_000
FEATURE_BITS = 20
THRESHOLD = 0.7
JUDGED = pa.schema(
    [(c, pa.int64()) for c in ("candidate", "n", "toxic", "caught", "false_alarms")] + [("loss", pa.float64())]
)


@dataclass
class Ftrl:
    """FTRL-proximal settings: learning rate ``alpha / (beta + sqrt(sum of squared gradients))``.

    ``l1`` is high enough that the many pairs met once or twice stay at zero; toxic texts are the
    rarer class and count ``positive_weight`` times.
    """

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 4
    positive_weight: float = 4.0


def gram_features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of all words, pairs and skip pairs, repetitions included."""
    h = words.hashes
    rows = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    out_rows, out = [rows], [mixed(h + np.uint64(1))]
    for gap, factor in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        same = rows[:-gap] == rows[gap:]
        pair = mixed(h[:-gap] * np.uint64(factor) + mixed(h[gap:] + np.uint64(gap)))
        out_rows.append(rows[:-gap][same])
        out.append(pair[same])
    features = (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate(out_rows), features


def _distinct(rows: np.ndarray, features: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << bits | features)
    return both >> bits, both & ((1 << bits) - 1)


def fit_ftrl(
    samples: list[tuple[float, np.ndarray]], settings: Ftrl, bits: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero features, their weights and the bias, from ``(label, distinct features)`` in order."""
    z = np.zeros((1 << bits) + 1)
    n = np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        l1 = np.where(at == bias, 0.0, settings.l1)
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / rate)

    prepared = [(label, np.append(features, features.dtype.type(bias))) for label, features in samples]
    for _ in range(settings.epochs):
        for label, at in prepared:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            gradient = (p - label) * (settings.positive_weight if label else 1.0)
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += squared
    everything = np.arange(1 << bits)
    w = weights(everything)
    held = np.flatnonzero(w)
    return held, w[held], float(weights(np.array([bias]))[0])


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def held_out(key: str = "doc_id") -> Column:
    """Every third document by crc32 of the id as text; a null id counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def _samples(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train_docs: int, bits: int, seed: int
) -> DataFrame:
    """``order, label, features`` of about ``train_docs`` labelled documents that are not held out.

    Ids are chosen before any text is read. Features are made where the texts are.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    share = min(1.0, train_docs / max(1, known.count()))
    order = F.xxhash64("_id", F.lit(seed))
    chosen = known.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_key") == F.col("_id")
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch["_text"]):
                part = batch.slice(low, high - low)
                words = words_of(part["_text"], letter_words(), fold=True)
                row, feature = _distinct(*gram_features(words, bits), bits)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                packed = [feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part["order"], part["_label"], pa.array(packed, pa.binary())],
                    ["order", "label", "features"],
                )

    return rows.select(order.alias("order"), "_label", "_text").mapInArrow(
        featured, "order bigint, label double, features binary"
    )


def compared_settings(
    docs: DataFrame,
    labels: DataFrame,
    candidates: list[Ftrl],
    folds: int = 3,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_docs: int = TRAIN_DOCS,
    bits: int = FEATURE_BITS,
    seed: int = 42,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``candidate, n, toxic, caught, false_alarms, log_loss`` by cross-validation.

    Only rows that training may see take part: each fold of them is scored by a model of the
    others, so settings can be chosen without a look at the held-out labels. One task fits one
    candidate and fold on the bounded sample.
    """
    samples = written(_samples(docs, labels, key, text, label, train_docs, bits, seed), "samples")
    trials = [F.lit(i) for i in range(len(candidates) * folds)]
    dealt = samples.withColumn("trial", F.explode(F.array(*trials)))

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("order", "ascending")])
        trial = rows["trial"][0].as_py()
        candidate, fold = divmod(trial, folds)
        order = rows["order"].to_numpy()
        held = mixed(order.view(np.uint64)) % np.uint64(folds) == np.uint64(fold)
        y = rows["label"].to_numpy()
        x = [np.frombuffer(f.as_py(), "<u4").astype(np.int64) for f in rows["features"]]
        seen = [(y[i], x[i]) for i in np.flatnonzero(~held)]
        features, weights, bias = fit_ftrl(seen, candidates[candidate], bits)
        dense = np.zeros(1 << bits)
        dense[features] = weights
        sums = np.array([dense[x[i]].sum() + bias for i in np.flatnonzero(held)])
        p = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
        up, alarm = y[held] == 1, p >= threshold
        loss = -np.log(np.where(up, p, 1 - p).clip(1e-15)).sum()
        found = {"n": int(held.sum()), "toxic": int(up.sum()), "caught": int((up & alarm).sum())}
        found |= {"candidate": candidate, "false_alarms": int((~up & alarm).sum()), "loss": float(loss)}
        return pa.Table.from_pylist([found], schema=JUDGED)

    judged = dealt.groupBy("trial").applyInArrow(judge, from_arrow_schema(JUDGED))
    sums = [F.sum(c).alias(c) for c in ("n", "toxic", "caught", "false_alarms")]
    return judged.groupBy("candidate").agg(*sums, (F.sum("loss") / F.sum("n")).alias("log_loss"))


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_docs: int = TRAIN_DOCS,
    settings: Ftrl = Ftrl(),
    bits: int = FEATURE_BITS,
    seed: int = 42,
) -> ToxicityModel:
    """Fit on about ``train_docs`` labelled documents that are not held out.

    FTRL is sequential, so one task runs it over the bounded sample.
    """
    samples = _samples(docs, labels, key, text, label, train_docs, bits, seed)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for y, packed in zip(batch["label"].to_pylist(), batch["features"]):
                held.append((y, np.frombuffer(packed.as_py(), "<u4")))
        features, weights, bias = fit_ftrl(held, settings, bits)
        features = np.append(features, -1)
        weights = np.append(weights, bias)
        yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(weights)], ["feature", "weight"])

    ordered = samples.repartition(1).sortWithinPartitions("order", "features")
    fitted = ordered.mapInArrow(fit, "feature bigint, weight double").toArrow()
    feature, weight = fitted["feature"].to_numpy(), fitted["weight"].to_numpy()
    if not len(feature):
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), 0.0, bits)
    is_bias = feature == -1
    return ToxicityModel(feature[~is_bias], weight[~is_bias], float(weight[is_bias][0]), bits)


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``row`` (the document) and its ``score`` between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = np.zeros(1 << model.bits)
        weights[model.features] = model.weights
        for batch in batches:
            for low, high in slices(batch["text"]):
                part = batch.slice(low, high - low)
                words = words_of(part["text"], letter_words(), fold=True)
                row, feature = gram_features(words, model.bits)
                used = weights[feature] != 0
                row, feature = _distinct(row[used], feature[used], model.bits)
                sums = np.bincount(row, weights[feature], part.num_rows) + model.bias
                score = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(score)], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(score, rows.select("row").schema.add("score", "double"))


def not_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    return scored(docs, model, text).filter(F.col("score") < threshold).select("row.*")
