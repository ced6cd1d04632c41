"""A corpus from raw documents to packed sequences, in stages that are each written and reread.

In every stage a null text counts as empty, texts of any length are read whole, an empty table
gives an empty one, and all but the last return the columns that they got, extra ones included,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import common, dedup, mixing, overlap, packing, quality
from skein.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: those that fail the base rules, as empty texts do, and
    those above a certified cutoff. Repeated rows are judged alike; a null language is a stratum
    of its own, mostly without labels and so without cutoffs.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id stays; of rows that repeat it one stays, and null
    ids lose against others. Empty texts are equal.
    """
    return dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their shingles the one of the smallest id stays. Rows
    of a null id, and texts without words, link with nothing and stay.
    """
    return overlap.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, which may be never. Null sources are one source;
    texts without words are never taken; rows of one id, source and size share a decision.
    """
    return mixing.resample(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in sequences of 2048 tokens. Repeated rows, which
    the mix makes, are packed one by one; an empty text has its end alone.
    """
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_pack", best_fit_pack),
]

#: Certified cutoffs, components of links and vector packing are beyond plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on what its predecessor wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
