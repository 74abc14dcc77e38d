"""Tables that the Python workers write: no file of them costs a process beside an executor's JVM."""

import collections
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import jaccard_join
from quadrille.llm.components import connect
from quadrille.llm.session import drop_written, saved, ship, written
from quadrille.plans.lineage import shared_folder

KINDS = "a long, i int, s string, b binary, x double, t boolean, l array<long>"
ROWS = [(1, 2, "é", b"\x00", 0.5, True, [1, None]), (None,) * 7, (-(1 << 63), -1, "", b"", float("inf"), False, []), (1, 2, "é", b"\x00", 0.5, True, [1, None])]


def folder_of(table):
    return os.path.dirname(table.inputFiles()[0]).removeprefix("file:").replace("///", "/")


def counted(df):
    return collections.Counter(map(str, df.collect()))


def by_hadoop(folder):
    """Files that Hadoop's local file system wrote for tasks, for which it starts processes and leaves checksums."""
    return [f for f in os.listdir(folder) if f.endswith(".crc") and "SUCCESS" not in f]


def test_rows_come_back(spark):
    ship(spark)
    df = spark.createDataFrame(ROWS, KINDS).repartition(3)
    out, n = saved(df, "kinds")
    assert out.schema.simpleString() == df.schema.simpleString() and counted(out) == counted(df) and n == 4
    folder = folder_of(out)
    assert not by_hadoop(folder)
    # a file of an attempt that did not end is not read
    open(f"{folder}/_part-00000-999.parquet", "wb").close()
    assert counted(spark.read.schema(KINDS).parquet(folder)) == counted(df)
    drop_written(out)
    assert not os.path.exists(folder)


def test_no_rows_and_many_row_groups(spark, monkeypatch):
    ship(spark)
    out, n = saved(spark.createDataFrame([], KINDS), "none")
    assert out.isEmpty() and n == 0 and out.columns == KINDS.replace(",", "").split()[::2]

    def wide(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.record_batch({"k": pa.array([k] * 3, pa.int64()), "b": pa.array([bytes(8 << 20)] * 3)})

    out, n = saved(spark.range(0, 4, 1, 2), "wide", wide, "k long, b binary")
    assert n == 12 and {(r["k"], r["n"], r["size"]) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.max(F.length("b")).alias("size")).collect()} == {(k, 3, 8 << 20) for k in range(4)}


def test_a_failed_task_is_run_again_or_raises(spark):
    ship(spark)

    def broken(batches):
        for batch in batches:
            yield batch
            raise ValueError("broken off")

    with pytest.raises(Exception, match="broken off"):
        saved(spark.range(0, 9, 1, 3), "broken", broken, "id long")


def test_other_types_are_written_by_spark(spark):
    ship(spark)
    df = spark.sql("SELECT timestamp'2020-01-01 00:00:00' AS t, 1.5BD AS d")
    out, n = saved(df, "others")
    assert n == 1 and counted(out) == counted(df) and by_hadoop(folder_of(out))


def test_the_join_and_the_components_write_without_hadoop(spark, odd, monkeypatch):
    """Its files had checksums, so each had cost processes that count with the memory of the JVM."""
    monkeypatch.setattr(jaccard_join, "drop_written", lambda *tables: None)
    top = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(top))
    assert jaccard_join.keep_one(odd).count() > 5
    made = set(os.listdir(top)) - before
    assert len(made) > 5 and not [f for d in made for f in by_hadoop(f"{top}/{d}")]
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long")
    out = connect(edges)
    assert {tuple(r) for r in out.collect()} == {(2, 1), (3, 1), (9, 8)} and not by_hadoop(folder_of(out))
    assert by_hadoop(folder_of(written(edges, "edges")))
