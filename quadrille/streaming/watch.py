"""Quads from a folder that grows: N-Triples files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ntriples import parse_lines
from ..terms import QUAD_COLUMNS


def stream_quads(spark: SparkSession, folder: str, dataset: str = "stream") -> DataFrame:
    """A streaming DataFrame of quads; each file is a graph."""
    lines = spark.readStream.text(folder).select("value", F.input_file_name().alias("_file"))
    found = parse_lines(lines, "value", F.concat(F.hex(F.xxhash64("_file")), F.lit("x")), ("_file",))
    return found.select(F.lit(dataset).alias("dataset"), F.coalesce("graph", F.concat(F.lit("<"), F.col("_file"), F.lit(">"))).alias("graph"), "s", "p", "o")


def watch(spark: SparkSession, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, list[str]], None], once: bool = False):
    """Call ``on_batch`` with the quads and graph names of each batch of new files, so that a store can replace those graphs."""

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(list(QUAD_COLUMNS)).persist()
        try:
            names = [r["graph"] for r in rows.select("graph").distinct().collect()]
            if names:
                on_batch(rows, names)
        finally:
            rows.unpersist()

    writer = stream_quads(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
