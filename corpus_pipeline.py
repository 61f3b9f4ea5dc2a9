"""Corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from cohortlens.llm.queries import read
from cohortlens.sources.sinks import materialize

#: Rows per Arrow batch, set for the session by every stage: texts are long, and a task holds a few
#: copies of a batch on either side of its Python worker. It does not change results.
ARROW_ROWS = 1000
#: A document goes when it has no letter or its best language is less likely than not.
MIN_LANGUAGE_SCORE = 0.5
#: Near-duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns of these names under private ones, and the columns that give all
    of ``docs`` back."""
    taken, private = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in names:
            private[c] = "_" + c
            while private[c].lower() in taken:
                private[c] = "_" + private[c]
            taken.add(private[c].lower())
    return docs.withColumnsRenamed(private), [F.col(f"`{private.get(c, c)}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of ``docs``; keeps rows with a recognised language. A null
    text has none."""
    _small_batches(spark)
    own, columns = _aside(docs, "lang_pred", "score")
    found = language_id.identify(own)
    keep = (F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.filter(keep).select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in ten or more documents; ``n_chars`` follows."""
    _small_batches(spark)
    own, columns = _aside(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id; of equal rows one."""
    _small_batches(spark)
    return ngram_join.keep_one(docs, k=SHINGLE_WORDS, num=SIMILARITY_PERCENT, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, token range, sequence and place."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Naive Bayes, alignment and the tokenizer have no SQL form; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read back for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
