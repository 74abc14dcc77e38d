"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again for the next one.  All but the last return
the columns of ``documents``; other columns of the input pass through as well.
An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontamination, jaccard_join, language_id, packing, quality_rules
from quadrille.llm.session import drop_written, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go, and those whose ``lang`` the text clearly contradicts; a null ``lang`` is not judged."""
    return language_id.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are frequent on their host go from the texts, and documents that are short, repetitive or left with too little go; a null text is short, a null source a host."""
    return quality_rules.keep_good(docs, chars_column="n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, one row of it where rows repeat; documents without words stay."""
    return jaccard_join.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; a null text holds none."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, as pieces in sequences; a null text is its end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("packing", packed),
]

#: SQL expresses neither the parses nor the packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        read, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            # what the stage before has written is read no more
            drop_written(read)
    return docs
