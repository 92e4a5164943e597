"""A training corpus from raw documents: quality filter, line dedup, near-dedup by fingerprint and shingles, mixing, packing.

Each stage takes the documents its predecessor kept; its result is written as Parquet and read again for the next. All but
the last return the columns of documents. Intermediate tables lie in the shared folder and are deleted by
``hyposcape.llm.common.release_tables`` once the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hyposcape.llm import common, line_dedup, mixing, near_copies, packing, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest id both of their fingerprint group (3 bits) and of their near copies, which three bits
    may miss (five-word similarity 0.8 or more)."""
    return simhash.rows_of_least(docs, simhash.components_of(docs), near_copies.components_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained network and a tokenizer are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
