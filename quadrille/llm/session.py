"""What the operators share of a session: code on the workers, shared folders, written tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.lineage import file_system, new_folder, shared_folder
from ..plans.workers import ship_code
from .textkernel import tidy

#: Beginning of the names of columns that operators add to rows of others and take away again.
INTERNAL = "_quadrille_"
BATCH_ROWS, FEWER_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
#: Types of columns that workers write; a table with others is written by Spark.
PLAIN = {"boolean", "int", "bigint", "double", "string", "binary", "array<bigint>"}
#: Bytes of a row group that a worker writes.
ROW_GROUP = 4 << 20
#: Most values are hashes and bitmaps, of which dictionaries would be larger.
FORMAT = {"compression": "zstd", "compression_level": 3, "use_dictionary": False}


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, and batches of texts that fit their memory.

    Spark's own batch of 10,000 rows is meant for numbers; a session that has
    set a size, whichever, keeps it.
    """
    if BATCH_ROWS not in spark.conf.getAll:
        spark.conf.set(BATCH_ROWS, FEWER_ROWS)
    ship_code(spark)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again, which cuts the lineage."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _saver(folder: str, run: Callable | None, schema: pa.Schema):
    """Write what ``run`` yields to a hidden file of the task's attempt, and tell its name and rows."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        held: list[pa.RecordBatch] = []
        size = rows = 0
        out = None
        for batch in run(batches) if run else batches:
            if not batch.num_rows:
                continue
            held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))
            size, rows = size + batch.nbytes, rows + batch.num_rows
            if size >= ROW_GROUP:
                out = out or pq.ParquetWriter(f"{folder}/_{name}", schema, **FORMAT)
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            out = out or pq.ParquetWriter(f"{folder}/_{name}", schema, **FORMAT)
            out.write_table(pa.Table.from_batches(held))
        if out:
            out.close()
            held = []
            tidy()
            yield pa.record_batch({"name": [name], "rows": pa.array([rows], pa.int64())})

    return save


def saved(df: DataFrame, what: str, run: Callable | None = None, schema: str = "") -> tuple[DataFrame, int]:
    """As ``written``, of the rows or of ``df.mapInArrow(run, schema)``, and the number of rows.

    Where the shared folder is one of a local file system, the Python workers
    write the files: Hadoop starts three processes for each file that a task
    writes there, each of which shares the whole memory of the executor's JVM
    until it runs its own program, and is counted with it.  The driver
    renames the files of the attempts that ended; readers see no others.
    """
    spark = df.sparkSession
    kind = StructType.fromDDL(schema) if run else df.schema
    folder = new_folder(spark, what)
    files, at = file_system(spark, folder)
    if files.getUri().getScheme() != "file" or any(f.dataType.simpleString() not in PLAIN for f in kind):
        files.delete(at, True)
        out = written(df.mapInArrow(run, schema) if run else df, what)
        return out, out.count()
    local = at.toUri().getPath()
    parts = df.mapInArrow(_saver(local, run, to_arrow_schema(kind)), "name string, rows long").collect()
    for name, _ in parts:
        os.rename(f"{local}/_{name}", f"{local}/{name}")
    return spark.read.schema(kind).parquet(folder), sum(rows for _, rows in parts)


def drop_written(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(file) for file in table.inputFiles()}:
            if folder.rsplit("/", 1)[0].removeprefix("file:").strip("/") == shared_folder(spark).removeprefix("file:").strip("/"):
                files, at = file_system(spark, folder)
                files.delete(at, True)
