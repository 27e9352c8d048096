"""Training-data pipeline: five stages over documents, each written and read again.

Every stage works on all rows that its predecessor kept. The first four return the columns of documents;
the last returns pieces packed into sequences. ORACLE_SQL is None: learned scores and packing are no SQL.

In every stage a null text counts as empty, null ids are ids like any other, texts are judged whole at any length, columns besides
doc_id and text are carried as they came whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import common, entries, exact_dedup, ngram_join, packing, quality, toxicity


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality classifier keeps; empty texts and scores of exactly a half stay; copies are judged alike."""
    return quality.keep(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not call toxic (a score of exactly a half is); labels may be missing; copies are judged alike."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One whole row of each text, that of the largest id; of rows that repeat an id and text, one. Null ids stay only if no other has the text."""
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, Jaccard 0.8), that of the smallest id, null last; empty texts are one group."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens; every token once, rows that repeat each; an empty text is its end id."""
    return packing.pack(docs, entries.TOKENIZER)


STAGES = [("quality_classifier", keep_good), ("toxicity", keep_clean), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
