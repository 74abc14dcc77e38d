"""Incremental refresh: what has changed between two listings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class SyncReport:
    mode: str
    added: list[str] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    unchanged: list[str] = field(default_factory=list)
    still_pending: list[str] = field(default_factory=list)


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``graph, status`` of two listings (graph, revision)."""
    a, b = stored.select("graph", F.col("revision").alias("old")), current.select("graph", F.col("revision").alias("new"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "graph", "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged")
    return both.select("graph", status.alias("status"))


def report(stored: DataFrame, current: DataFrame, graphs: Sequence[str] | None = None, full: bool = False) -> SyncReport:
    """The difference as lists.  Given some graphs, others that differ are pending; a full refresh takes all of them as changed that are in both."""
    out = SyncReport("full" if full else "incremental" if graphs is None else "targeted")
    for row in diff(stored, current).orderBy("graph").toLocalIterator():
        name, status = row["graph"], row["status"]
        if full and status == "unchanged":
            status = "changed"
        if graphs is not None and name not in graphs:
            if status != "unchanged":
                out.still_pending.append(name)
            continue
        getattr(out, status).append(name)
    return out


def updated_locations(known: DataFrame, listed: DataFrame, expired: Column | None = None) -> DataFrame:
    """``location`` of what is listed (location, hash) and new, changed, without a hash, or ``expired`` by a condition on known rows."""
    a = known.select("location", F.col("hash").alias("_old"), (F.lit(False) if expired is None else expired).alias("_expired"), F.lit(True).alias("_known"))
    both = listed.join(a, "location", "left")
    stale = F.col("_known").isNull() | F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("_old")) | F.col("_expired")
    return both.where(stale).select("location").distinct()


def vanished(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Known rows whose location is no longer listed."""
    return known.join(listed.select("location"), "location", "left_anti")


def preserved(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Quads of both, where a graph that exists keeps its own."""
    return existing.unionByName(incoming.join(existing.select("graph").distinct(), "graph", "left_anti"))


def overwritten(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Quads of both, where a graph that comes replaces the one that exists."""
    return existing.join(incoming.select("graph").distinct(), "graph", "left_anti").select(*existing.columns).unionByName(incoming)
