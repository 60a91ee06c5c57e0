"""The tasks a user runs, as functions of DataFrames: scan, preview, recheck, clean up, analyse, restore, review."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconloom.functions import normalize as N
from reconloom.operators import cleanup, fuzzy, hierarchy, media, merge, restore
from reconloom.plans import flow
from reconloom.sources.durable import durable


@dataclass(frozen=True)
class CleanupKind:
    """How one kind of entity is cleaned up."""

    norm: Callable[[Column], Column]
    window: int
    threshold: float
    veto: bool
    strict: bool  # external ids and external names also conflict


KINDS = {
    "tag": CleanupKind(N.tag_cleanup_name, 2, 0.96, True, False),
    "performer": CleanupKind(N.plain_name, 3, 0.98, False, True),
    "studio": CleanupKind(N.plain_name, 3, 0.96, False, True),
}


def scan(rows: DataFrame, mode: str, *limits: int, order: str = "id") -> DataFrame:
    """Rows that a run of ``mode`` looks at; limits count those only."""
    return flow.eligible(flow.targets(rows, mode), F.lit(True), [F.col(order)], *limits)


def preview(rows: DataFrame, mode: str, shown: int = 3) -> DataFrame:
    return scan(rows, mode, shown)


def recheck(rows: DataFrame, status: str, outcomes: DataFrame) -> DataFrame:
    """``id, status``: rows of a status with the next one that new outcomes (``id, outcome``) give; Imported stays."""
    joined = rows.where(F.col("status") == status).join(outcomes, "id", "left")
    return joined.select("id", F.when(F.col("outcome").isNull(), F.col("status")).otherwise(flow.transition(F.col("status"), F.col("outcome"))).alias("status"))


def cleanup_plan(entities: DataFrame, kind: str, external: DataFrame | None = None, protected: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The safe merges, and what needs a review: conflicting groups and similar names.

    ``entities``: ``id, ordinal, name, aliases, usage, rich, signature``.
    """
    how = KINDS[kind]
    components = cleanup.duplicate_components(entities, how.norm, protected=protected)
    members = components.join(entities, "id")
    every = cleanup.plan(members, how.norm, external if how.strict else None, entities if how.strict else None).withColumn("score", F.lit(1.0))
    left = entities if not protected else entities.where(~N.key_ci(F.col("name")).isin([p.lower().strip() for p in protected]))
    pairs = fuzzy.review_pairs(left, how.norm, how.window, max(0.9, min(1.0, how.threshold)), how.veto, components)
    two = pairs.select(F.concat_ws("|", "left_id", "right_id").alias("component"), F.explode(F.array("left_id", "right_id")).alias("id")).join(entities, "id")
    similar = cleanup.plan(two, how.norm).withColumn("kind", F.lit("fuzzy")).withColumn("auto_merge", F.lit(False))
    scores = pairs.select(F.array_sort(F.array("left_id", "right_id")).alias("_p"), F.col("score"))
    similar = similar.withColumn("_p", F.array_sort(F.concat(F.array("destination_id"), "source_ids"))).join(scores, "_p").drop("_p")
    safe = every.where("auto_merge").orderBy(*cleanup.plan_order("safe"))
    return safe, every.where("not auto_merge").unionByName(similar).orderBy(*cleanup.plan_order("review"))


def cleanup_apply(safe: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each child collection with its references to merged entities rewritten."""
    merges = safe.select(F.explode("source_ids").alias("source_id"), "destination_id")
    return {name: merge.rewrite_keys(rows, merges, column) for name, (rows, column) in children.items()}


def analyze_export(old: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The match of every old record, and the gate of a restore."""
    found = media.match_cascade(old, current)
    return found, flow.preflight(found)


def restore_export(matches: DataFrame, old: DataFrame, current: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Change-set of the current records that an old one matches; the first old record of a target counts. A gate that aborts gives none."""
    gate = flow.preflight(matches).first()
    changes = _changes(matches, old, current, kinds)
    return changes.limit(0) if gate["abort"] else changes


def _changes(matches: DataFrame, old: DataFrame, current: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return _filled(restore.first_sources(matches, old), old, current, kinds)


def _filled(won: DataFrame, old: DataFrame, current: DataFrame, kinds: dict[str, str]) -> DataFrame:
    source = won.join(old.withColumnRenamed("id", "old_id"), "old_id").select(F.col("current_id").alias("id"), *kinds)
    after = merge.fill(current.select("id", *kinds), source, "id", kinds)
    return merge.changeset(current, after, "id", list(kinds))


@dataclass(frozen=True)
class Side:
    """An export, or the library: tables by medium (``scenes``, ``images``) and by kind of entity.

    ``files``: ``id, path, size, fp_type, fp_value``; ``media``: ``id`` and fields, in an export with ``ordinal``, the place in
    its list; ``entities`` of ``tags``, ``performers``, ``studios`` and ``groups`` as their resolvers read them, an export
    needs names only; ``external``: ``name`` or ``id``, ``endpoint, external_id`` of tags; ``parents``: ``child, parent`` of
    tags, names in an export. Where they are left out nothing is done with them: ``identities`` (as ``external``) of
    performers and studios, ``studio_parents`` (export: ``name, parent, ordinal``; library: ``id, parent``), ``relations`` by
    medium and kind (export: ``id, name, position``; library: ``id, entity_id, position``)."""

    files: dict[str, DataFrame]
    media: dict[str, DataFrame]
    entities: dict[str, DataFrame]
    external: DataFrame
    parents: DataFrame
    identities: dict[str, DataFrame] = field(default_factory=dict)
    studio_parents: DataFrame | None = None
    relations: dict[str, dict[str, DataFrame]] = field(default_factory=dict)


def backup(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table written below ``folder`` and counted again; any failure is an error, so nothing is changed after it."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("errorifexists").parquet(paths[name])
        if df.sparkSession.read.schema(df.schema).parquet(paths[name]).count() != df.count():
            raise RuntimeError(f"the backup of {name} is not complete")
    return paths


def restore_run(old: Side, current: Side, fields: dict[str, dict[str, str]], backup_to: str | None = None) -> dict[str, DataFrame]:
    """A whole restore as change-sets: media are matched and the gate asked, the library is saved, then entities are resolved
    in the order tags, performers, studios, tag and studio parents, groups, and last fields and relations of scenes and images.

    Without ``backup_to`` it is an analysis: nothing is saved and a gate that aborts is only reported. Returns
    ``matches_<medium>``, ``gate``, for each kind of entity the decisions (``name, decision, id``), ``merges_<kind>``
    (``source_id, destination_id``: duplicates that ambiguous names merge first) and ``created_<kind>`` (``name, id,
    first``: new rows with their ids), ``parents`` of tags to add (``child, parent``) and ``studio_parents`` to set,
    ``changes_<medium>``, ``relations_<medium>_<kind>`` (``id, before, after``; of studios ``id, entity_id``) and ``stats``
    (``medium, kind, records``; old records of a target that an earlier one in the list has are ``collision``)."""
    found = {m: durable(media.match_cascade(old.files[m], current.files[m]), "restore-matches") for m in fields}
    won = {m: durable(restore.first_sources(df, old.media[m]), "restore-won") for m, df in found.items()}
    every = None
    for m, df in found.items():
        first = won[m].withColumnRenamed("old_id", "_first")
        part = df.join(first, "current_id", "left").select(F.lit(m).alias("medium"), F.when(F.col("old_id") != F.col("_first"), "collision").otherwise(F.col("kind")).alias("kind"))
        every = part if every is None else every.unionByName(part)
    gate = flow.preflight(reduce(DataFrame.unionByName, [df.select("kind") for df in found.values()]))
    if backup_to is not None:
        if gate.first()["abort"]:
            raise RuntimeError("too few old records match; nothing was changed")
        saved = {**{f"media_{m}": current.media[m] for m in fields}, **current.entities, "parents": current.parents, "external": current.external, **{f"identities_{k}": df for k, df in current.identities.items()}}
        saved |= {f"relations_{m}_{k}": df for m, own in current.relations.items() for k, df in own.items()}
        backup(saved | ({} if current.studio_parents is None else {"studio_parents": current.studio_parents}), backup_to)
    out = {"gate": gate, "stats": every.groupBy("medium", "kind").agg(F.count("*").alias("records"))}
    ids = _entities(old, current, out)
    there = ids["tags"]
    named = lambda side: there.select(F.col("name").alias(side), F.col("id").alias(f"_{side}"))
    wanted = old.parents.join(named("child"), "child").join(named("parent"), "parent").select(F.col("_child").alias("child"), F.col("_parent").alias("parent"))
    has = merge.rewrite_keys(merge.rewrite_keys(current.parents, out["merges_tags"], "child").drop("moved"), out["merges_tags"], "parent").drop("moved")
    out["parents"] = merge.missing_edges(has, wanted)
    if old.studio_parents is not None and current.studio_parents is not None:
        out["studio_parents"] = restore.parents_to_set(old.studio_parents, merge.rewrite_keys(current.studio_parents, out["merges_studios"], "id"), ids["studios"])
    for m, kinds in fields.items():
        out[f"matches_{m}"] = found[m]
        out[f"changes_{m}"] = _filled(won[m], old.media[m], current.media[m], kinds)
        for kind, rows in old.relations.get(m, {}).items():
            now = current.relations[m][kind]
            if kind in ("tags", "performers", "studios"):
                now = merge.rewrite_keys(now, out[f"merges_{kind}"], "entity_id").drop("moved")
            grow = restore.single_relation if kind == "studios" else restore.relations
            out[f"relations_{m}_{kind}"] = grow(won[m], rows, now, ids[kind])
    return out


def _entities(old: Side, current: Side, out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Decisions, merges and new ids of all kinds into ``out``; where each name leads, by kind."""
    from reconloom.operators import resolve

    none = {"usage": F.lit(0), "rich": F.lit(False), "signature": F.lit("")}
    full = {k: df.withColumns({c: v for c, v in none.items() if c not in df.columns}) for k, df in current.entities.items()}
    empty = lambda owner: current.external.limit(0).select(F.lit("").alias(owner), F.lit("").alias("endpoint"), F.lit("").alias("external_id"))
    mine, theirs = (lambda k: old.identities.get(k, empty("name"))), (lambda k: current.identities.get(k, empty("id")))
    tags = lambda x, e: resolve.resolve_tags(x, e, old.external, current.external)
    out["tags"], out["merges_tags"], _ = restore.merge_then_resolve(old.entities["tags"], full["tags"], current.external, tags, aliases_block=True)

    def performers(x, e):
        return resolve.resolve_performers(old.entities["performers"].join(x.select("name").distinct(), "name", "left_semi"), e, unclear="unclear")

    found, merges, _ = restore.merge_then_resolve(old.entities["performers"], full["performers"], theirs("performers"), performers)
    found = restore.without_conflicts(found, merges, mine("performers"), theirs("performers"))
    out["performers"] = found.withColumn("decision", F.when(F.col("decision") == "unclear", "ambiguous").otherwise(F.col("decision")))
    out["merges_performers"] = merges
    out["studios"], out["merges_studios"], _ = restore.resolve_studios(old.entities["studios"], full["studios"], mine("studios"), theirs("studios"))
    out["groups"] = resolve.resolve_groups(old.entities["groups"], current.entities["groups"])
    ids = {}
    for kind in ("tags", "performers", "studios", "groups"):
        order = old.entities[kind] if "ordinal" in old.entities[kind].columns else None
        out[kind] = durable(out[kind], f"restore-{kind}")
        out[f"created_{kind}"] = restore.minted(out[kind], current.entities[kind], order)
        ids[kind] = restore.entity_ids(out[kind], out[f"created_{kind}"])
    return ids


decide_review = flow.decide_review


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or an HTTP date; 0 for anything else."""
    seconds = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, (\d{2} \w{3} \d{4} [\d:]{8}) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"), F.lit(0.0)))


def hook_image_ids(payloads: DataFrame, body: str = "body", id: str = "id") -> DataFrame:
    """``id, image_id``: the image that a nested JSON payload names, by an image id key or as an object of type image; depth first."""
    import json

    def find(payload) -> str | None:
        waiting = [payload]
        while waiting:  # the first in document order that names an image
            here = waiting.pop()
            inner = here.values() if isinstance(here, dict) else here if isinstance(here, list) else ()
            if isinstance(here, dict):
                plain = {k.lower().translate({45: None, 95: None}): v for k, v in reversed(here.items())}
                id_ = plain.get("imageid")
                if id_ is None and str(plain.get("type") or "").lower() == "image":
                    id_ = here.get("id")
                if id_ is not None:
                    return str(id_)
            waiting.extend(reversed([*inner]))
        return None

    def read(text: str | None) -> str | None:
        try:
            return find(json.loads(text)) if text else None
        except ValueError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "image_id": pdf["body"].map(read)})

    rows = payloads.select(F.col(id).alias("id"), F.col(body).alias("body"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, image_id string")


def parents_first(entities: DataFrame) -> DataFrame:
    """``id, level``: 0 for entities without a known parent, then one more than the parent; entities on or below a cycle have none.

    ``entities``: ``id, parent``. Levels resolve in order, so a child finds its parent resolved."""
    return hierarchy.ancestry(entities).where("level is not null").select("id", "level")
