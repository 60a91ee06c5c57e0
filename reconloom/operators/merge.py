"""Filling and rewriting: change-sets, unions of ids, foreign keys after a merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import key_ci, scalar_fill


def fill(current: DataFrame, old: DataFrame, id: str, kinds: dict[str, str]) -> DataFrame:
    """``current`` with each field of ``kinds`` filled from ``old`` where it is empty; booleans are or-ed instead."""
    both = current.alias("c").join(old.alias("o"), id, "left")
    made = []
    for name, kind in kinds.items():
        c, o = F.col(f"c.{name}"), F.col(f"o.{name}")
        made.append((F.coalesce(c, F.lit(False)) | F.coalesce(o, F.lit(False)) if kind == "boolean" else scalar_fill(c, o, kind)).alias(name))
    return both.select(id, *made)


def changeset(before: DataFrame, after: DataFrame, id: str, fields: Sequence[str]) -> DataFrame:
    """``id, field, old, new``: fields that differ and whose new value isn't null; rows that are new have null as old."""
    item = lambda c, a, b: F.struct(F.lit(c).alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new"))
    both = after.alias("a").join(before.alias("b"), id, "left")
    rows = both.select(id, F.explode(F.array(*[item(c, F.col(f"b.{c}"), F.col(f"a.{c}")) for c in fields])).alias("f")).select(id, "f.field", "f.old", "f.new")
    return rows.where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def rewrite_keys(rows: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """``rows`` with the foreign key of a merged source replaced by its destination, and ``moved``."""
    m = merges.select(F.col("source_id").alias(column), F.col("destination_id").alias("_to"))
    return rows.join(m, column, "left").withColumn("moved", F.col("_to").isNotNull()).withColumn(column, F.coalesce("_to", column)).drop("_to")


def reassigned_counts(merges: DataFrame, *children: tuple[str, DataFrame, str]) -> DataFrame:
    """``child, destination_id, moved``: rows of each child collection that a merge reassigns."""
    out = None
    for label, rows, column in children:
        part = rows.join(merges.withColumnRenamed("source_id", column), column).groupBy("destination_id").agg(F.count("*").alias("moved")).select(F.lit(label).alias("child"), "destination_id", "moved")
        out = part if out is None else out.unionByName(part)
    return out


def counter_delta(current: Column, old: Column) -> Column:
    """What is missing to the old counter."""
    return F.greatest(F.lit(0), F.coalesce(old, F.lit(0)) - F.coalesce(current, F.lit(0)))


def missing_history(current: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old entries that the current side does not have, once each."""
    return old.select(*keys).distinct().join(current.select(*keys), list(keys), "left_anti")


def external_id_union(current: DataFrame, old: DataFrame) -> DataFrame:
    """``id, endpoint, external_id, conflict``: for each endpoint the current id, else the old one; whether they differ. Null ids don't count."""
    both = current.select("id", key_ci(F.col("endpoint")).alias("endpoint"), "external_id", F.lit(0).alias("_p")).unionByName(old.select("id", key_ci(F.col("endpoint")).alias("endpoint"), "external_id", F.lit(1).alias("_p")))
    return both.where("external_id is not null").groupBy("id", "endpoint").agg(F.min_by("external_id", F.struct("_p", "external_id")).alias("external_id"), (F.count_distinct("external_id") > 1).alias("conflict"))


def missing_edges(current: DataFrame, old: DataFrame) -> DataFrame:
    """``child, parent`` edges to add: old ones that are not there, without self-loops."""
    return old.where("child <> parent").select("child", "parent").distinct().join(current, ["child", "parent"], "left_anti")


def common_evidence(hits: DataFrame, source: str, evidence: str, target: str) -> DataFrame:
    """``source, target``: the only target that all evidence of a source points to."""
    pairs = hits.select(source, evidence, target).distinct()
    total = pairs.groupBy(source).agg(F.count_distinct(evidence).alias("_all"))
    full = pairs.groupBy(source, target).agg(F.count("*").alias("_hit")).join(total, source).where("_hit = _all")
    return full.withColumn("_n", F.count("*").over(Window.partitionBy(source))).where("_n = 1").select(source, target)
