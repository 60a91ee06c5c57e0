"""Hierarchies with one parent each, walked by doubling: levels, roots and cycles in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.sources.durable import durable, release, scratch


def ancestry(entities: DataFrame) -> DataFrame:
    """``id, parent, level, root, cycle, on_cycle``, a row for each id of ``entities`` (``id, parent``).

    ``level`` is 0 for entities without a known parent, then one more than the parent's; ``root`` is the entity of level
    0 above. An entity on a cycle, or below one, has neither; ``cycle`` then names the cycle by its smallest id, and
    ``on_cycle`` says whether it lies on it. Null ids are left out, a parent that is not there or is the entity itself is
    none, and of several rows with one id the smallest parent counts. An empty table gives an empty one.

    Each round every open entity takes over where its target has got to, so after k rounds 2**k steps are known; a
    chain of a million takes 20 rounds. What is open after as many steps as there are parents leads to a cycle, and
    the targets it has then are exactly the entities on cycles. Rounds join open entities only, on ids.
    """
    with scratch() as made:
        rows = durable(entities.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent")), "ancestry-rows")
        known = rows.select(F.col("id").alias("_p"))
        linked = rows.join(known, F.col("parent") == F.col("_p"), "left").select("id", F.when(F.col("_p") != F.col("id"), F.col("_p")).alias("up"))
        first = durable(linked.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").alias("least")), "ancestry-open")
        done, open_ = first.where("up is null"), durable(first.where("up is not null"), "ancestry-open")
        total, k = open_.count(), 0
        while not open_.isEmpty() and (1 << k) <= total:
            there = done.unionByName(open_).select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("up", "root", "steps", "least")])
            moved = open_.join(there, F.col("up") == F.col("_id"))
            step = durable(moved.select("id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least")), "ancestry-open")
            done, before, open_ = done.unionByName(step.where("up is null")), open_, step.where("up is not null")
            if k:
                release(before)
            k += 1
        cyclic = durable(open_.select("up").distinct().select(F.col("up").alias("_on")), "ancestry-cycle")
        named = open_.join(cyclic, F.col("id") == F.col("_on")).select(F.col("id").alias("_c"), F.col("least").alias("cycle"))
        rest = open_.join(named, F.col("up") == F.col("_c"), "left").join(cyclic, F.col("id") == F.col("_on"), "left")
        none = F.lit(None)
        kind = rows.schema["id"].dataType
        ends = done.select("id", F.col("steps").alias("level"), "root", none.cast(kind).alias("cycle"), F.lit(False).alias("on_cycle"))
        looped = rest.select("id", none.cast("long").alias("level"), none.cast(kind).alias("root"), "cycle", F.col("_on").isNotNull().alias("on_cycle"))
        out = ends.unionByName(looped).join(rows, "id").select("id", "parent", "level", "root", "cycle", "on_cycle")
        return made.keep(out, "ancestry")


def opened_cycles(entities: DataFrame, order: str = "ordinal") -> DataFrame:
    """``id, parent``: the edges that a walk in ``order`` keeps, which goes up from each entity before it links it.

    On a cycle that walk meets its way again at the cycle's entity nearest to its start, so the edge to that entity
    is left out: for each cycle, the edge to where the first entity on it or below it enters. Self-loops are no edges."""
    with scratch() as made:
        found = ancestry(entities)
        edges = found.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("id")))
        looped = found.where("cycle is not null")
        if looped.isEmpty():
            return made.keep(edges.select("id", "parent"), "edges")
        below = ancestry(looped.select("id", F.when(~F.col("on_cycle"), F.col("parent")).alias("parent"))).select("id", F.col("root").alias("_entry"))
        place = entities.groupBy("id").agg(F.min(order).alias("_at"))
        entry = looped.join(below, "id").join(place, "id").groupBy("cycle").agg(F.min_by("_entry", F.struct("_at", "id")).alias("_entry")).select("_entry")
        dropped = looped.where("on_cycle").join(entry, F.col("parent") == F.col("_entry")).select("id")
        return made.keep(edges.join(dropped, "id", "left_anti").select("id", "parent"), "edges")
