"""Restoring entities and relations: identity conflicts, merges of ambiguous duplicates, new ids, relation sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconloom.functions.normalize import compact, key_ci, plain_name, strip
from reconloom.operators import cleanup, fuzzy, hierarchy, merge
from reconloom.operators.names import ranked
from reconloom.operators.winner import ordered_ci_distinct
from reconloom.sources.durable import durable


def _ids_by_endpoint(ids: DataFrame, owner: str) -> DataFrame:
    kept = ids.select(owner, key_ci(F.col("endpoint")).alias("_e"), strip(F.coalesce("external_id", F.lit(""))).alias("_x"), *[c for c in ("position",) if c in ids.columns])
    return kept.where("_e <> '' and _x <> ''")


def identity_conflicts(found: DataFrame, old_ids: DataFrame, current_ids: DataFrame) -> DataFrame:
    """``name`` of the matched names (``name, id``) whose entity has another external id at an endpoint that the old entity has too.

    ``old_ids``: ``name, endpoint, external_id``; ``current_ids``: ``id, endpoint, external_id`` and, where an entity has
    several at one endpoint, ``position``, of which the last counts (without it the largest id). Endpoints compare
    without case and outer blanks; blank and null ones count for nothing."""
    theirs = _ids_by_endpoint(current_ids, "id")
    last = F.max_by("_x", F.struct("position", "_x")) if "position" in theirs.columns else F.max("_x")
    theirs = theirs.groupBy("id", "_e").agg(last.alias("_current"))
    own = _ids_by_endpoint(old_ids, "name").select("name", "_e", "_x")
    return found.where("id is not null").select("name", "id").join(own, "name").join(theirs, ["id", "_e"]).where(F.col("_x") != F.col("_current")).select("name").distinct()


def safe_merges(names: DataFrame, entities: DataFrame, external: DataFrame, aliases_block: bool = False) -> DataFrame:
    """``source_id, destination_id``: the merges that the ambiguous ``names`` (``name``) allow.

    Entities whose primary names are equal in compact form (four characters at least) to an ambiguous name are one,
    unless an endpoint has different ids among them, or those with rich metadata differ in it; the best ranked one with
    rich metadata stays, or the best ranked if none has any. With ``aliases_block`` (tags) an alias that belongs to an
    entity outside keeps the group apart too. ``entities``: ``id, ordinal, name, aliases, usage, rich, signature``;
    ``external``: ``id, endpoint, external_id``."""
    keys = names.select(compact(plain_name(F.col("name"))).alias("component")).where(F.length("component") >= 4).distinct()
    members = entities.withColumn("component", compact(plain_name(F.col("name")))).join(keys, "component", "left_semi")
    members = cleanup.survivors(members).where("not conflict")
    clashing = cleanup.endpoint_conflicts(members, external.where("external_id is not null"))
    members = members.join(clashing, "component", "left_anti")
    if aliases_block:
        foreign = cleanup.alias_preflight(members.select("id", "component"), entities).where("action = 'conflict'").select("id")
        members = members.join(members.join(foreign, "id").select("component").distinct(), "component", "left_anti")
    stays = members.where("survivor").select("component", F.col("id").alias("destination_id"))
    return members.where("not survivor").select("component", F.col("id").alias("source_id")).join(stays, "component").select("source_id", "destination_id")


def contracted(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """``entities`` with the sources of ``merges`` gone; survivors have their names and aliases too, and their usage.

    Names and aliases follow by rank of the merge: the survivor's own, then those of each source by ordinal; equal ones
    (without case) and the survivor's name are left out."""
    to = merges.select(F.col("source_id").alias("id"), F.col("destination_id").alias("_to"))
    placed = entities.join(to, "id", "left").withColumn("_to", F.coalesce("_to", "id"))
    lost = placed.where(F.col("_to") != F.col("id"))
    said = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    more = lost.groupBy("_to").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", said.alias("said")))), lambda x: x["said"])).alias("_more"), F.sum("usage").alias("_usage")).withColumnRenamed("_to", "id")
    kept = entities.join(to.select("id"), "id", "left_anti").join(more, "id", "left")
    every = F.filter(ordered_ci_distinct("aliases", "_more"), lambda a: key_ci(a) != key_ci(F.col("name")))
    return kept.withColumns({"aliases": F.when(F.col("_more").isNull(), F.col("aliases")).otherwise(every), "usage": F.col("usage") + F.coalesce("_usage", F.lit(0))}).select(*entities.columns)


def merge_then_resolve(incoming: DataFrame, entities: DataFrame, external: DataFrame, resolve: Callable[[DataFrame, DataFrame], DataFrame], aliases_block: bool = False, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(found, merges, entities)``: names resolved after the merges that ambiguous ones allow.

    ``resolve(incoming, entities)`` gives ``name, decision, id``. Ambiguous names propose ``safe_merges``; the entities
    are contracted, their external ids follow, and what was ambiguous is resolved again, until no merge is left: each
    round merges one group at least, and a group merges once, so a few rounds do. A name whose own group merged is
    ``merged`` with the survivor, whatever else resembles it. ``merges`` has every source with its last survivor, for
    ``merge.rewrite_keys`` on the children."""
    found = durable(resolve(incoming, entities).select("name", "decision", "id"), "resolved")
    merges = None
    for _ in range(most):
        open_ = found.where("decision = 'ambiguous'").select("name")
        new = durable(safe_merges(open_, entities, external, aliases_block), "merges")
        if new.isEmpty():
            return found, (new if merges is None else merges), entities
        keyed = entities.select(compact(plain_name(F.col("name"))).alias("_key"), "id")
        survivors = new.select(F.col("destination_id").alias("id")).distinct().join(keyed, "id").select("_key", F.col("id").alias("_own"))
        entities = durable(contracted(entities, new), "contracted")
        external = durable(merge.rewrite_keys(external, new, "id").select(*external.columns).distinct(), "contracted-ids")
        moved = new.select(F.col("source_id").alias("id"), F.col("destination_id").alias("_to"))
        # what pointed at a source points at its survivor
        settled = found.where("decision <> 'ambiguous'").join(moved, "id", "left").select("name", "decision", F.coalesce("_to", "id").alias("id"))
        again = open_.withColumn("_key", compact(plain_name(F.col("name")))).join(survivors, "_key", "left").join(resolve(open_, entities).select("name", "decision", "id"), "name")
        merged = F.col("_own").isNotNull()
        redone = again.select("name", F.when(merged, "merged").otherwise(F.col("decision")).alias("decision"), F.when(merged, F.col("_own")).otherwise(F.col("id")).alias("id"))
        found = durable(settled.unionByName(redone), "resolved")
        if merges is not None:
            older = merges.join(new.select(F.col("source_id").alias("destination_id"), F.col("destination_id").alias("_to")), "destination_id", "left").select("source_id", F.coalesce("_to", "destination_id").alias("destination_id"))
            new = durable(older.unionByName(new), "merges")
        merges = new
    raise RuntimeError(f"merges did not settle in {most} rounds")


def resolve_studios(incoming: DataFrame, entities: DataFrame, old_ids: DataFrame, current_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(found, merges, entities)`` of studio names: ``name, decision, id`` by ``fuzzy.MIGRATE_STUDIO`` after safe merges.

    Studios have no guard: a name that resembles an entity too little to reuse it is ``create``. A match whose external
    id says otherwise is a ``conflict``, neither used nor made anew."""
    found, merges, after = merge_then_resolve(incoming, entities, current_ids, lambda x, e: fuzzy.resolve(x, e, fuzzy.MIGRATE_STUDIO))
    return without_conflicts(found, merges, old_ids, current_ids), merges, after


def without_conflicts(found: DataFrame, merges: DataFrame, old_ids: DataFrame, current_ids: DataFrame) -> DataFrame:
    """``name, decision, id`` with ``conflict`` where the external ids differ and ``create`` where nothing was found."""
    now = merge.rewrite_keys(current_ids, merges, "id").select(*current_ids.columns)
    clash = identity_conflicts(found, old_ids, now).withColumn("_clash", F.lit(True))
    both = found.join(clash, "name", "left")
    way = F.when(F.col("_clash"), "conflict").when(F.col("decision") == "none", "create").otherwise(F.col("decision"))
    return both.select("name", way.alias("decision"), F.when(F.col("_clash").isNull(), F.col("id")).alias("id"))


def minted(found: DataFrame, entities: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``name, id, first`` of the names to create: new ids in a row after the largest of ``entities``, one for each normalised name.

    New rows follow by the smallest ``ordinal`` of their names in ``order`` (``name, ordinal``), else by normalised name, so reruns
    agree; ``first`` marks the name that the row is made under. Ids are numbers as text, as those of ``entities`` are;
    ids that are no numbers are passed over. Places come from sorted ranges, no task sorts all names."""
    asked = found.where("decision = 'create'").select("name").distinct().withColumn("_key", plain_name(F.col("name")))
    if order is not None:
        asked = asked.join(order.groupBy("name").agg(F.min("ordinal").alias("ordinal")), "name", "left")
    else:
        asked = asked.withColumn("ordinal", F.lit(0))
    heads = asked.groupBy("_key").agg(F.min_by("name", F.struct(F.coalesce(F.col("ordinal"), F.lit((1 << 62))), F.col("name"))).alias("_head"), F.min("ordinal").alias("_at"))
    placed = ranked(heads, F.col("_at").asc_nulls_last(), F.col("_key"), name="_n")
    top = entities.agg(F.coalesce(F.max(F.expr("try_cast(id AS BIGINT)")), F.lit(0).cast("long"))).first()[0]
    return durable(asked.join(placed, "_key").select("name", (F.col("_n") + F.lit(top)).cast("string").alias("id"), (F.col("name") == F.col("_head")).alias("first")), "minted")


def entity_ids(found: DataFrame, new: DataFrame) -> DataFrame:
    """``name, id, fresh``: where each name leads, to a matched entity or a new one; names that lead nowhere are left out."""
    old = found.where("id is not null").select("name", "id", F.lit(False).alias("fresh"))
    return old.unionByName(new.select("name", "id", F.lit(True).alias("fresh")))


def relations(won: DataFrame, old: DataFrame, current: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, before, after``: the media whose set of related entities grows.

    ``won``: ``old_id, current_id``, one old record a current one; ``old``: ``id, name, position``; ``current``: ``id,
    entity_id, position``; ``ids``: as of ``entity_ids``. What is there comes first in its order, then the old ones by
    position; each id once; names that lead nowhere add nothing."""
    was = current.where("entity_id is not null").select("id", "entity_id", F.lit(0).alias("_side"), "position")
    adds = won.select(F.col("old_id").alias("id"), "current_id").join(old, "id").join(ids.select("name", F.col("id").alias("entity_id")), "name")
    adds = adds.select(F.col("current_id").alias("id"), "entity_id", F.lit(1).alias("_side"), "position")
    each = was.unionByName(adds).groupBy("id", "entity_id").agg(F.min(F.struct("_side", "position")).alias("_at"))
    sets = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "entity_id"))).alias("_all"))
    before = F.transform(F.filter("_all", lambda x: x["_at"]["_side"] == 0), lambda x: x["entity_id"])
    after = F.transform("_all", lambda x: x["entity_id"])
    return sets.select("id", before.alias("before"), after.alias("after")).where(F.size("after") > F.size("before"))


def single_relation(won: DataFrame, old: DataFrame, current: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, entity_id`` of the media without a related entity (``current``: ``id, entity_id``) whose old record had one that leads somewhere."""
    taken = current.where("entity_id is not null").select("id")
    wanted = won.select(F.col("old_id").alias("id"), "current_id").join(old.select("id", "name"), "id").join(ids.select("name", F.col("id").alias("entity_id")), "name")
    return wanted.select(F.col("current_id").alias("id"), "entity_id").join(taken, "id", "left_anti").groupBy("id").agg(F.min("entity_id").alias("entity_id"))


def parents_to_set(old: DataFrame, current: DataFrame, ids: DataFrame, order: str = "ordinal") -> DataFrame:
    """``id, parent`` of the entities (studios) that get a parent: those without one now, by the old hierarchy ``name, parent, ordinal``.

    Both ends lead to an entity, matched or new; edges that would close a cycle of the old hierarchy, or make an entity
    its own parent, are left out."""
    at = ids.select("name", F.col("id"))
    mapped = old.join(at, "name").join(at.select(F.col("name").alias("parent"), F.col("id").alias("_pid")), "parent").select("id", F.col("_pid").alias("parent"), order)
    kept = hierarchy.opened_cycles(mapped, order)
    return kept.join(current.where("parent is not null").select("id"), "id", "left_anti")


def galleries(sources: DataFrame, matched: DataFrame, existing: DataFrame) -> DataFrame:
    """``source, decision, id``: what becomes of each old gallery.

    ``sources``: ``source, title, folder, zips`` (booleans whether it has a folder or archives); ``matched``: ``source,
    stage, id`` of ``names.cascade``. A match is reused and an ambiguous one passed over; one with files that matches
    nothing is ``unresolved``, for a new gallery would be without its files, and so is one without a title; the rest is
    ``create``, once for each normalised title, with an id minted after those of ``existing``."""
    both = sources.join(matched, "source", "left")
    files = F.coalesce(F.col("folder"), F.lit(False)) | F.coalesce(F.col("zips"), F.lit(False))
    way = F.when(F.col("stage") == "ambiguous", "ambiguous").when(F.col("id").isNotNull(), "reuse").when(files | (F.trim(F.coalesce("title", F.lit(""))) == ""), "unresolved").otherwise("create")
    decided = both.select("source", F.col("title").alias("name"), way.alias("decision"), F.when(F.col("stage") != "ambiguous", F.col("id")).alias("id"))
    new = minted(decided, existing).select("name", F.col("id").alias("_new"))
    return decided.join(new, "name", "left").select("source", "decision", F.when(F.col("decision") == "create", F.col("_new")).otherwise(F.col("id")).alias("id"))


def old_order(old: DataFrame) -> list[Column]:
    """The order in which old records count: their list order if ``ordinal`` is there, else ids by length and text, as numbers go."""
    return [F.col("ordinal")] if "ordinal" in old.columns else [F.length(F.col("id").cast("string")), F.col("id").cast("string")]


def first_sources(matches: DataFrame, old: DataFrame) -> DataFrame:
    """``old_id, current_id``: the first old record, in list order, of each current one that any matches; those without a row in ``old`` come last."""
    placed = old.select(F.col("id").alias("old_id"), F.struct(*old_order(old)).alias("_at"))
    return matches.where("current_id is not null").join(placed, "old_id", "left").groupBy("current_id").agg(F.min_by("old_id", F.struct(F.col("_at").isNull(), "_at", "old_id")).alias("old_id"))
