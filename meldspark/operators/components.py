"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


#: A node with more than one in so many edges is hot; so there are fewer hot nodes than that. With no
#: more edges than that of its own, it is not.
SHARE = 1000
#: Parts into which the edges of a hot node are dealt where they meet a row of its own.
SALTS = 8


def _hot(edges: DataFrame, on: str, total: int) -> list[int]:
    return [r[0] for r in edges.groupBy(on).count().where(f"count > {max(SHARE, total // SHARE)}").select(on).collect()]


def _met(edges: DataFrame, nodes: DataFrame, on: str, by: str, hot: list[int]) -> DataFrame:
    """Edges with the columns of ``nodes``, which has a row for a ``node``, for the node in column
    ``on``; the edges of a hot node are dealt by ``by``."""
    if not hot:
        return edges.join(nodes, edges[on] == nodes.node, "left").drop("node")
    parts = F.when(F.col("node").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = edges.withColumn("salt", F.when(F.col(on).isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = nodes.withColumn("part", F.explode(parts))
    return dealt.join(spread, (F.col(on) == F.col("node")) & (F.col("salt") == F.col("part")), "left").drop("node", "salt", "part")


def _low(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """The larger end of each edge is linked to the least of the smaller end and its neighbours."""
    return _met(edges, _low(edges), "b", "a", _hot(edges, "b", total)).select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    low = _low(edges)
    return low.select(F.col("node").alias("a"), F.col("m").alias("b")).union(_met(edges, low, "a", "b", _hot(edges, "a", total)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _leaves(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The edges of nodes that have no other, to a smaller node, and the rest."""
    ends = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"))
    inner = edges.select(F.col("b").alias("node")).distinct().withColumn("n", F.lit(2))
    one = materialize(ends.union(inner).groupBy("node").agg(F.sum("n").alias("n")).where("n = 1").select("node", F.lit(True).alias("leaf")), "leaf-nodes")
    told = materialize(_met(edges, one, "a", "b", _hot(edges, "a", total)), "told-edges")
    discard(one)
    return told.where("leaf").select("a", "b"), told.where("leaf is null").select("a", "b")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges ``(a, b)`` of long ids to ``(id, component)``; component is the smallest id reachable.

    Only ids with an edge to another id appear. Null ends and self loops are ignored; an empty
    table gives an empty result. No step gathers the neighbours of a node in one task: a node's
    minimum is a combinable aggregate, and the edges of a hot node are dealt into parts that each meet
    it. Nodes with one edge, to a smaller node, wait aside for the component of that node.
    """
    edges = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct()
    )
    edges = materialize(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    leaves, core = _leaves(edges, edges.count())
    parts = _stars(core, max_rounds).withColumnRenamed("id", "node")
    found = _met(leaves, parts, "b", "a", _hot(leaves, "b", leaves.count()))
    alone = leaves.select("b").distinct().join(parts, F.col("b") == F.col("node"), "left_anti")
    return parts.withColumnRenamed("node", "id").union(found.select("a", F.coalesce("component", "b"))).union(alone.select("b", "b"))


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    edges = materialize(edges, "edges")
    for _ in range(max_rounds):
        total = edges.count()
        large = materialize(_large_star(edges, total).distinct(), "edges")
        discard(edges)
        edges = materialize(_small_star(large, total).distinct(), "edges")
        discard(large)
        # a forest of stars: every node has one parent, and no parent has a parent
        low = edges.groupBy("a").agg(F.count("*").alias("n"))
        done = low.where("n > 1").isEmpty() and edges.join(low.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
