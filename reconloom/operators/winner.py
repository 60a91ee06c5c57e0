"""Picking one row of a group, or none where two are equally good."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import casefolded, key_ci


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def unique_hits(hits: DataFrame, source: str, target: str) -> DataFrame:
    """``source, hits, target``: the number of different targets, and the target if there is one only."""
    return hits.groupBy(source).agg(F.count_distinct(target).alias("hits"), F.min(target).alias("_t")).select(source, "hits", F.when(F.col("hits") == 1, F.col("_t")).alias(target))


def unique_joined(left: DataFrame, right: DataFrame, on: Sequence[str], source: str, target: str) -> DataFrame:
    """``unique_hits`` of ``left`` joined to ``right`` on the columns ``on``, without its pairs.

    Sources with the same keys have the same targets, and targets with the same keys the same sources: only the different
    sets of keys meet, and a set counts for all targets that have it. A key that n sources and m targets have costs
    n + m rows, not n * m. Rows with a null key meet nothing."""
    given = " and ".join(f"`{c}` is not null" for c in on)
    sets = lambda df, id, name: df.where(given).groupBy(id).agg(F.array_sort(F.collect_set(F.struct(*on))).alias(name))
    own = sets(left, source, "_own")
    other = sets(right, target, "_other").groupBy("_other").agg(F.count(target).alias("_n"), F.min(target).alias("_t"))
    met = own.select("_own").distinct().select("_own", F.explode("_own").alias("_key")).join(other.select("*", F.explode("_other").alias("_key")).hint("merge"), "_key")
    counted = met.select("_own", "_other", "_n", "_t").distinct().groupBy("_own").agg(F.sum("_n").alias("hits"), F.min("_t").alias("_t"))
    return own.join(counted, "_own").select(source, "hits", F.when(F.col("hits") == 1, F.col("_t")).alias(target))


def winner_with_margin(scored: DataFrame, source: str, candidate: str, score: str, threshold: float, margin: float, per: str | None = None) -> DataFrame:
    """``source, candidate, score``: the best candidate at least at ``threshold`` and ``margin`` ahead of the second.

    ``per`` names the column within which only the best score counts as a rival
    (the candidate itself by default). Two best ones give none.
    """
    per = per or candidate
    best = scored.groupBy(source, per).agg(F.max_by(F.struct(candidate, score), F.col(score)).alias("_b"))
    flat = best.select(source, F.col(f"_b.{candidate}").alias(candidate), F.col(f"_b.{score}").alias(score))
    order = Window.partitionBy(source).orderBy(F.desc(score), F.col(candidate))
    ranked = flat.withColumn("_k", F.row_number().over(order)).withColumn("_second", F.lead(score).over(order))
    return ranked.where((F.col("_k") == 1) & (F.col(score) >= threshold) & (F.col("_second").isNull() | (F.col(score) - F.col("_second") >= margin))).drop("_k", "_second")


def unique_nearest(near: DataFrame, source: str, candidate: str, distance: str, margin: int = 1) -> DataFrame:
    """``source, candidate, distance``: the only nearest, if the next distance within the radius is far enough."""
    w = Window.partitionBy(source)
    best = near.withColumn("_b", F.min(distance).over(w))
    seen = best.withColumn("_at", F.count_if(F.col(distance) == F.col("_b")).over(w)).withColumn("_next", F.min(F.when(F.col(distance) > F.col("_b"), F.col(distance))).over(w))
    ok = (F.col(distance) == F.col("_b")) & (F.col("_at") == 1) & (F.col("_next").isNull() | (F.col("_next") - F.col("_b") >= max(1, margin)))
    return seen.where(ok).select(source, candidate, distance)


def survivor_order(usage: str = "usage", name: str = "name", id: str = "id") -> list[Column]:
    """Most used first, then snake_case names, then by name without case, then by id as text."""
    snake = F.col(name).rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$")
    return [F.desc(usage), F.when(snake, 0).otherwise(1), casefolded(F.col(name)), F.col(id).cast("string")]


def one_source_per_target(matches: DataFrame, target: str, ordinal: str) -> DataFrame:
    """``matches`` plus ``collides``: false for the first source of each target."""
    return matches.withColumn("collides", F.row_number().over(Window.partitionBy(target).orderBy(ordinal)) > 1)


def ordered_ci_distinct(*arrays: Column) -> Column:
    """Union of string arrays in order: first spelling of each key kept, blanks dropped.

    Spellings are sorted by key and compared with the one before. A lambda looks at its arguments only: whatever else it
    names is worked out anew for each element."""
    everything = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    spelled = F.transform(everything, lambda x, i: F.struct(key_ci(x).alias("key"), i.alias("at"), F.trim(x).alias("as")))
    by_key = F.array_sort(F.filter(spelled, lambda s: s["key"] != ""))
    before = F.concat(F.array(F.lit(None)), by_key)
    firsts = F.zip_with(by_key, before, lambda s, b: F.when(s["key"].isNotNull() & ~s["key"].eqNullSafe(b["key"]), F.struct(s["at"].alias("at"), s["as"].alias("as"))))
    return F.transform(F.array_sort(F.filter(firsts, lambda s: s.isNotNull())), lambda s: s["as"])


def grouped_ci_distinct(rows: DataFrame, group: str, order: Sequence[str], *values: Column, name: str = "values") -> DataFrame:
    """``group`` and, as ``name``, ``ordered_ci_distinct`` of the ``values`` of its rows: rows by ``order``, values of a row as given.

    Spellings with one key are combined before they meet, so a group holds its different keys, not its rows."""
    at = F.struct(*order, F.col("_v.at").alias("_at"), F.col("_v.as").alias("_as"))
    each = rows.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(k).alias("at"), key_ci(v).alias("key"), F.trim(v).alias("as")) for k, v in enumerate(values)])))
    firsts = each.groupBy(group, F.col("_v.key").alias("_key")).agg(F.min(at).alias("_m"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_key") != "", F.col("_m"))))
    return firsts.groupBy(group).agg(kept.alias("_all")).select(group, F.transform("_all", lambda m: m["_as"]).alias(name))


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Groups with more than one different value: ``keys, different``."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("different")).where("different > 1")
