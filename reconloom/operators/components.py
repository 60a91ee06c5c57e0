"""Connected components by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.sources.durable import durable, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex it can reach.

    Returns ``(id, component)``, one row for each vertex that occurs in an edge
    between two different vertices. Rows with a null end and self-loops are
    ignored; repeated edges count once; an empty input gives an empty result.

    Each round contracts the graph: a vertex hooks to its smallest neighbour,
    two squarings shorten the chains, and the edges are renamed. Joins and
    ``min`` aggregates only, so a vertex with millions of edges is combined on
    the map side; nothing is collected but whether edges remain.
    """
    left = durable(_simple(edges.select(F.col(a).alias("lo"), F.col(b).alias("hi"))), "cc-edges")
    labels = durable(left.select(F.col("lo").alias("id")).union(left.select(F.col("hi").alias("id"))).distinct().withColumn("component", F.col("id")), "cc-labels")
    for _ in range(max_rounds):
        if left.isEmpty():
            return labels
        hook = left.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("to"))
        for _ in range(2):
            hook = _squared(hook)
        hook = durable(hook, "cc-hook")
        ends = _through(_through(left, hook, "lo"), hook, "hi")
        # a target that is itself hooked stays tied to where it goes
        chain = hook.select(F.col("to").alias("lo")).distinct().join(hook.select(F.col("v").alias("lo"), F.col("to").alias("hi")), "lo")
        after = durable(_simple(ends.unionByName(chain)), "cc-edges")
        named = durable(_through(labels, hook, "component"), "cc-labels")
        release(left, hook, labels)
        left, labels = after, named
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _simple(edges: DataFrame) -> DataFrame:
    return edges.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()


def _squared(hook: DataFrame) -> DataFrame:
    then = hook.select(F.col("v").alias("to"), F.col("to").alias("further"))
    return hook.join(then, "to", "left").select("v", F.coalesce("further", "to").alias("to"))


def _through(rows: DataFrame, hook: DataFrame, column: str) -> DataFrame:
    mapped = hook.select(F.col("v").alias(column), F.col("to").alias("_to"))
    return rows.join(mapped, column, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)
