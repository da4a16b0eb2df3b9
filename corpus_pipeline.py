"""Corpus preparation in five stages, each written and read again by the next.

Every stage takes all that the one before it kept, and returns the columns of ``documents``; the last returns the packing.
In every stage rows that repeat are treated alike, each a row of its own (but for near duplicates, which are made one); ids
and sources may be null; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import common, decontaminate, language_mixture, line_dedup, ngram_join, packing

#: A text is of no language if trigrams drawn evenly fit it better than the mixture of languages does: mean log-probability of a trigram.
LEAST_FIT = -math.log(language_mixture.BUCKETS)

#: SQL has no tokenizer, no EM and no components by similarity.
ORACLE_SQL = None


def _recounted(out: DataFrame, docs: DataFrame, changed) -> DataFrame:
    """The columns of ``docs``; ``n_chars`` follows the text where that has changed."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (so null and empty texts), and those that no mixture of languages fits."""
    found = language_mixture.identify(docs, language_mixture.train(docs.select("doc_id", "text", "lang")), fit_col="_fit")
    return found.where((F.col("_lang") != language_mixture.UNKNOWN) & (F.col("_fit") >= LEAST_FIT)).select(*docs.columns)


def line_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines out of all texts but copied pages; a null source is no site."""
    found = line_dedup.drop_lines(docs, only_copies=True)
    return _recounted(found, docs, F.col("_n_dropped") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates, that of the least id; texts without words all stay."""
    return ngram_join.keep_one(docs)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark phrases out of the texts; a document of which no word is left goes. Texts without words stay as they are."""
    found = decontaminate.scan(docs, common.table(spark, sf_dir, "benchmark"))
    left = decontaminate.cut(found).where((F.col("_n_hit") == 0) | (F.col("_n_hit") < F.col("_n_words")))
    return _recounted(left, docs, F.col("_n_hit") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_boilerplate),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_spans),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
