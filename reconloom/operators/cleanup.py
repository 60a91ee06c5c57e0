"""Duplicate entities: groups, survivors, conflicts, and the plan of merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import casefolded, compact, key_ci
from reconloom.operators.components import connected_components
from reconloom.operators.names import spellings
from reconloom.operators.winner import conflicts, survivor_order


def groups_by_key(entities: DataFrame, key: Column, min_length: int = 4) -> DataFrame:
    """``key, ids, members``: entities with an equal key of at least ``min_length`` characters."""
    keyed = entities.select(key.alias("key"), F.col("id").cast("string").alias("id")).where(F.length("key") >= min_length)
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("members", F.size("ids").cast("long")).where("members > 1")


def duplicate_components(entities: DataFrame, norm: Callable[[Column], Column], min_length: int = 4, aliases: bool = True, protected: list[str] | None = None) -> DataFrame:
    """``id, component``: entities whose compact names agree, or whose alias is another's primary name.

    Edges go to the smallest owner of a key, so a key with many owners stays
    linear. Protected names take no part."""
    if protected:
        entities = entities.where(~key_ci(F.col("name")).isin([p.lower().strip() for p in protected]))
    keyed = spellings(entities).select("id", "primary", compact(norm(F.col("spelling"))).alias("key")).where(F.length("key") >= min_length)
    heads = keyed.where("primary").groupBy("key").agg(F.min("id").alias("head"))
    used = keyed if aliases else keyed.where("primary")
    edges = used.join(heads, "key").select(F.col("id").alias("a"), F.col("head").alias("b"))
    return connected_components(edges)


def survivors(members: DataFrame, group: str = "component") -> DataFrame:
    """``members`` plus ``rank`` in its group, ``conflict`` of the group, and ``survivor``.

    ``members``: ``id, name, usage, rich, signature``. If rich members differ, the
    group conflicts and the best of all is named; else the best rich member, or
    the best of all if none is rich.
    """
    rich = members.where("rich").groupBy(group).agg(F.count_distinct("signature").alias("_signatures"))
    order = Window.partitionBy(group).orderBy(*survivor_order())
    joined = members.join(rich, group, "left").withColumn("conflict", F.coalesce(F.col("_signatures") > 1, F.lit(False)))
    ranked = joined.withColumn("rank", F.row_number().over(order))
    pool = Window.partitionBy(group).orderBy(F.when(F.col("rich") & ~F.col("conflict"), 0).otherwise(1), "rank")
    return ranked.withColumn("survivor", F.row_number().over(pool) == 1).drop("_signatures")


def endpoint_conflicts(members: DataFrame, external: DataFrame, group: str = "component") -> DataFrame:
    """``group`` values in which one endpoint has different external ids. ``external``: ``id, endpoint, external_id``."""
    return conflicts(members.select(group, "id").join(external.where(F.trim("external_id") != "").select("id", key_ci(F.col("endpoint")).alias("endpoint"), F.trim("external_id").alias("external_id")).where("endpoint <> ''"), "id"), [group, "endpoint"], "external_id").select(group).distinct()


def external_name_conflicts(members: DataFrame, entities: DataFrame, norm: Callable[[Column], Column], group: str = "component") -> DataFrame:
    """Groups that have a name or alias which an entity outside of the group also has."""
    keyed = spellings(entities).select("id", norm(F.col("spelling")).alias("key")).distinct()
    owned = keyed.join(members.select("id", group), "id", "left")
    spread = owned.groupBy("key").agg(F.count_distinct(F.coalesce(F.col(group).cast("string"), F.concat(F.lit("-"), F.col("id").cast("string")))).alias("_n")).where("_n > 1")
    return owned.where(F.col(group).isNotNull()).join(spread, "key", "left_semi").select(group).distinct()


def alias_preflight(members: DataFrame, entities: DataFrame, group: str = "component") -> DataFrame:
    """``id, alias, action``: an alias of a group member that another entity has as a name or alias: ``clear`` if all owners are in the group, else ``conflict``."""
    keyed = spellings(entities).select("id", key_ci(F.col("spelling")).alias("key"), "primary", "spelling").join(members.select("id", group), "id", "left")
    own = keyed.where(~F.col("primary") & F.col(group).isNotNull()).select("id", F.col("spelling").alias("alias"), "key", F.col(group).alias("_g"))
    other = keyed.select(F.col("id").alias("_owner"), "key", F.col(group).alias("_og"))
    hits = own.join(other, "key").where(F.col("id") != F.col("_owner"))
    return hits.groupBy("id", "alias").agg(F.when(F.bool_or(~F.coalesce(F.col("_g") == F.col("_og"), F.lit(False))), "conflict").otherwise("clear").alias("action"))


def plan(members: DataFrame, norm: Callable[[Column], Column], external: DataFrame | None = None, entities: DataFrame | None = None, group: str = "component") -> DataFrame:
    """``destination_id, destination_name, source_ids, source_names, kind, auto_merge``: a row for each group of two and more.

    The kind is ``normalized-format`` if one normalised name is left, else
    ``joined-format``; the first conflict of external id, metadata and external
    name is added to it, and none with a conflict merges by itself.
    """
    ranked = survivors(members, group).withColumn("_norm", norm(F.col("name")))
    item = F.struct("rank", F.col("id").cast("string").alias("id"), "name", "survivor")
    rows = ranked.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("m"), F.count_distinct("_norm").alias("_norms"), F.bool_or("conflict").alias("_meta")).where(F.size("m") > 1)
    rows = _flagged(rows, endpoint_conflicts(members, external, group) if external is not None else None, group, "_ids")
    rows = _flagged(rows, external_name_conflicts(members, entities, norm, group) if entities is not None else None, group, "_names")
    base = F.when(F.col("_norms") == 1, "normalized-format").otherwise("joined-format")
    problem = F.when(F.col("_ids"), "-external-id-conflict").when(F.col("_meta"), "-metadata-conflict").when(F.col("_names"), "-external-name-conflict").otherwise("")
    kept = F.filter("m", lambda x: x["survivor"])[0]
    rest = F.filter("m", lambda x: ~x["survivor"])
    return rows.select(
        kept["id"].alias("destination_id"), kept["name"].alias("destination_name"), F.transform(rest, lambda x: x["id"]).alias("source_ids"), F.transform(rest, lambda x: x["name"]).alias("source_names"),
        F.concat(base, problem).alias("kind"), (problem == "").alias("auto_merge"),
    )


def _flagged(rows: DataFrame, found: DataFrame | None, group: str, name: str) -> DataFrame:
    if found is None:
        return rows.withColumn(name, F.lit(False))
    return rows.join(found.withColumn(name, F.lit(True)), group, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def plan_order(kind: str = "safe", score: str = "score") -> list[Column]:
    """Order of the safe list, or of the review list."""
    tail = [casefolded(F.col("destination_name")), F.col("source_names")]
    return tail if kind == "safe" else [F.desc(score), *tail]
