"""Numbers for terms: a table of all terms of some quads, and quads by number.

Quads hold their terms as strings, and need no dictionary to be queried.  One
is of use where many joins run over long terms, or numbers are asked for.  A
term's number is its 64-bit hash, so it is the same in every table; two terms
with one number are found and raised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIONS = ("graph", "s", "p", "o")


def terms_of(quads: DataFrame) -> DataFrame:
    """``id, term`` of every term, each once."""
    terms = quads.select(F.explode(F.array(*POSITIONS)).alias("term")).where("term IS NOT NULL").distinct()
    found = terms.groupBy(F.xxhash64("term").alias("id")).agg(F.min("term").alias("term"), F.max("term").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("two terms have one number: "), "term", F.lit(" "), "_other")).cast("string")
    return found.select("id", F.when(F.col("term") == F.col("_other"), F.col("term")).otherwise(clash).alias("term"))


def lookup(terms: DataFrame, *wanted: str) -> DataFrame:
    """``id, term`` of the wanted terms that are there."""
    return terms.where(F.col("term").isin(*wanted))


def encoded(quads: DataFrame) -> DataFrame:
    """The quads by number; the table of terms is not read."""
    return quads.select(*(c for c in quads.columns if c not in POSITIONS), *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in POSITIONS))


def decoded(numbers: DataFrame, terms: DataFrame) -> DataFrame:
    """The quads of numbers; numbers that the table lacks are null."""
    join = lambda df, c: df.join(terms.select(F.col("id").alias(c), F.col("term").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return reduce(join, POSITIONS, numbers).select(*numbers.columns)
