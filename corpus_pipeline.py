"""A training corpus from the documents table: each stage takes the rows that the one before kept.

Null texts count as empty in every stage, null sources are a source of their own, and other columns are carried along. Rows
are decided one by one: of equal texts the row with the largest id stays (a null id is the smallest; of repeated rows any
one), in near dedup rows of a null id stay, and rows of one id share their fate. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbmark.llm import bpe, exactdup, mixing, neardup, toxicity
from ebbmark.llm.queries import RANKS, table
from ebbmark.llm.shared import written

#: Documents with at least this score are rejected.
TOXIC = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents, by a lexicon learned from the labelled ones."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon, column="__score").filter(f"__score < {TOXIC}").drop("__score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exactdup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight draws them, in mixed order."""
    return mixing.mix(docs).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each row and decodes it again: tokens and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, RANKS)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("byte-level BPE", bpe_stage)]

#: SQL has no Aho-Corasick lexicon, MinHash components or BPE; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
