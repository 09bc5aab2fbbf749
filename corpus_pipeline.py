"""The corpus pipeline: five filtering and encoding stages from documents to token files.

Each stage works on all rows that the one before it kept, written and read again, and all but the last
return the columns of their input, clashing names among them. Defined cases: a null or empty text
is clean prose without words, links with nothing and becomes the end id alone; a null id is kept as such;
of rows equal in id and text the near-copy stage keeps one; a null source is a source of its own; without
labels of both kinds nothing is toxic, without a benchmark nothing is contaminated; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripwise.llm import decontaminate, mixing, ngram_join, toxicity, wavelet
from tripwise.llm.queries import TOKENIZER
from tripwise.llm.tables import table
from tripwise.sources.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Words of a shingle and the similarity of near copies in this stage; ``op5_`` has its own.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those it is given, does not reject."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of five-word shingles 0.8 or more."""
    return ngram_join.one_of_each_group(docs, n=STAGE_SHINGLE, percent=STAGE_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` as read back from the token files."""
    return wavelet.token_table(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_ids", encode_tokens),
]

# Neither the trained classifier nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
