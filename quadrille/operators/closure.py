"""Transitive closures over edges (src, dst), and the import graph.

Closures are driver loops over frontiers that keep only new rows, so they end
on cycles.  A closure from seeds begins with the frontier on the driver, as
long as it and what was found are small by a fixed bound: a round is then one
job over the edges, which are not copied.  Beyond the bound, and in full
closures, frontiers are distributed and written each round.  ``keys`` are
further columns, such as the graph, within which edges are followed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from ..plans.local import local_frame
from ..terms import IMPORTS, is_iri

#: Rows of a frontier, and of all found, up to which the driver holds them, and the round from which on edges are read from a copy of their columns.
FRONTIER, FOUND, COPY_FROM = 10_000, 100_000, 4


def transitive(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All (src, dst) joined by one edge or more.  A node on a cycle reaches itself."""
    keys = list(keys)
    delta = checkpointed(edges.select(*keys, "src", "dst").distinct())
    found = delta
    # paths double in length each round, so the rounds are the logarithm of the longest path; what is found is a union of what each round wrote
    while not delta.isEmpty():
        left = delta.withColumnRenamed("dst", "mid")
        right = found.withColumnRenamed("src", "mid")
        after = left.join(right, [*keys, "mid"]).select(*keys, "src", "dst")
        before = found.withColumnRenamed("dst", "mid").join(delta.withColumnRenamed("src", "mid"), [*keys, "mid"]).select(*keys, "src", "dst")
        delta = checkpointed(after.unionByName(before).distinct().join(found, [*keys, "src", "dst"], "left_anti"))
        found = found.unionByName(delta)
    return found


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = -1, keys: Sequence[str] = ()) -> DataFrame:
    """``node, depth`` (and ``seed``) reached from each row of ``seeds`` (seed), the seed itself at depth 0.

    Every node once for each seed, at its least depth; ``depth`` below 0 sets no
    bound.
    """
    keys = list(keys)
    spark, edges = edges.sparkSession, edges.select(*keys, "src", "dst")
    columns = [*keys, "seed", "node"]
    schema = ", ".join(f"`{c}` string" for c in columns)
    first = seeds.select(*keys, "seed").distinct().limit(FRONTIER + 1).collect()
    held = {(*r, r["seed"]): 0 for r in first}
    live, step = list(held), 0
    while len(live) <= FRONTIER and len(held) <= FOUND:
        if not live or step == depth:
            return local_frame(spark, [(*row, d) for row, d in held.items()], schema + ", depth int")
        step += 1
        if step == COPY_FROM:
            edges = checkpointed(edges)
        new = _step(edges, local_frame(spark, live, schema), keys, small=True).limit(FRONTIER + FOUND + 1).collect()
        live = [tuple(r) for r in new if tuple(r) not in held]
        if len(new) > FRONTIER + FOUND:
            # too many to tell the new ones apart here: the round is done again, distributed
            step -= 1
            live = [row for row, d in held.items() if d == step]
            break
        held.update(dict.fromkeys(live, step))
    if len(first) > FRONTIER:
        found = checkpointed(seeds.select(*keys, "seed").distinct().withColumns({"node": F.col("seed"), "depth": F.lit(0)}))
        frontier = found
    else:
        found = local_frame(spark, [(*row, d) for row, d in held.items()], schema + ", depth int")
        frontier = local_frame(spark, [(*row, step) for row in live], schema + ", depth int")
    edges = checkpointed(edges.distinct())
    while step != depth and not frontier.isEmpty():
        step += 1
        new = _step(edges, frontier, keys)
        frontier = checkpointed(new.join(found, columns, "left_anti").withColumn("depth", F.lit(step)))
        found = found.unionByName(frontier)
    return found.select(*columns, "depth")


def _step(edges: DataFrame, frontier: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """Distinct (keys, seed, node) one edge behind the frontier."""
    here = frontier.select(*(F.col(k).alias(f"_{k}") for k in keys), "seed", F.col("node").alias("_at"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("src") == F.col("_at")]
    joined = edges.join(F.broadcast(here) if small else here, on)
    return joined.select(*keys, "seed", F.col("dst").alias("node")).distinct()


def forward(edges: DataFrame, node: str) -> DataFrame:
    """``node``: what one edge or more lead to from a node, without the node itself unless it lies on a cycle."""
    start = edges.where(F.col("src") == node).select(F.col("dst").alias("seed")).distinct()
    return reachable(edges, start).select("node").distinct()


def backward(edges: DataFrame, node: str) -> DataFrame:
    """``node``: what leads to a node by one edge or more."""
    return forward(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), node)


def edges_of(quads: DataFrame, predicate: str) -> DataFrame:
    """Edges of a predicate; restrict the quads to a scope first."""
    return quads.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def declared_imports(quads: DataFrame) -> DataFrame:
    """``graph, target`` of all import statements with an IRI."""
    return quads.where((F.col("p") == IMPORTS) & is_iri(F.col("o"))).select("graph", F.col("o").alias("target")).distinct()


def import_closure(edges: DataFrame, root: str, depth: int = -1) -> DataFrame:
    """``node, depth``: the root first, then what it imports; siblings in order of name."""
    spark = edges.sparkSession
    seeds = local_frame(spark, [(root,)], "seed string")
    return reachable(edges, seeds, depth).select("node", "depth").orderBy("depth", "node")


def importers(edges: DataFrame, node: str) -> DataFrame:
    """``node``: direct importers."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()


def missing_imports(imports: DataFrame, known: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``target`` of imports (graph, target) that no row of ``known`` (graph) resolves; ``within`` (node) restricts the importers."""
    if within is not None:
        imports = imports.join(within.select(F.col("node").alias("graph")), "graph", "left_semi")
    return imports.join(known.select(F.col("graph").alias("target")), "target", "left_anti").select("target").distinct()


def import_paths(edges: DataFrame, target: str, present: bool = True) -> DataFrame:
    """``path``: arrays of all simple paths to a target from nodes that nothing imports.

    A path is returned only where it begins at such a node, so a target that
    can be reached through a cycle only has none.  An absent target is not part
    of the paths: they end at its importers.
    """
    edges = checkpointed(edges.select("src", "dst").distinct())
    if present:
        live = local_frame(edges.sparkSession, [([target],)], "path array<string>")
    else:
        live = importers(edges, target).select(F.array("node").alias("path"))
        edges = checkpointed(edges.where(F.col("dst") != target))
    targets = edges.select(F.col("dst").alias("head")).distinct()
    live, done = checkpointed(live), None
    while not live.isEmpty():
        headed = live.withColumn("head", F.element_at("path", 1))
        ended = checkpointed(headed.join(targets, "head", "left_anti").select("path"))
        done = ended if done is None else done.unionByName(ended)
        grown = headed.join(edges, headed["head"] == edges["dst"]).where(~F.array_contains("path", F.col("src")))
        live = checkpointed(grown.select(F.concat(F.array("src"), "path").alias("path")))
    return live if done is None else done
