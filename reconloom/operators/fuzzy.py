"""Fuzzy name matching: candidates, an exact ratio, and winner rules.

Names match others with the same first character and a length within a window;
they are found by the segments they share (``segments``), each different pair of
normal forms once, and scored. What cannot reach the threshold can still be a
runner-up that makes a match ambiguous, so pairs are kept down to threshold - margin.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconloom.functions import normalize as N
from reconloom.operators.names import spellings, unambiguous_index
from reconloom.operators.segments import similar
from reconloom.operators.winner import unique_joined, winner_with_margin


def _numbered(c: str) -> Column:
    """The characters of a string, each with the number of times it has come up: two strings share as many as these sets do."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def candidates(left: DataFrame, right: DataFrame, window: int, threshold: float, min_length: int = 5, margin: float = 0.0) -> DataFrame:
    """All columns of ``left`` and ``right`` (which have ``left_norm`` and ``right_norm``) for pairs that can reach ``threshold - margin``.

    Incoming names shorter than ``min_length`` have no candidates; lengths differ by ``window`` at most. This lists whole
    blocks by first character and length, less the pairs that share too few characters; ``scored`` finds what it scores by segments."""
    n, least = F.length("left_norm"), threshold - margin - 1e-9
    a = left.where(n >= min_length).withColumns({"_first": F.substring("left_norm", 1, 1), "_chars": _numbered("left_norm")}).withColumn("_length", F.explode(F.sequence(F.greatest(n - window, F.lit(1)), n + window)))
    b = right.where(F.length("right_norm") >= 1).withColumns({"_first": F.substring("right_norm", 1, 1), "_length": F.length("right_norm"), "_others": _numbered("right_norm")})
    both = F.length("left_norm") + F.length("right_norm")
    near = a.join(b, ["_first", "_length"]).where(2.0 * F.least(F.length("left_norm"), F.length("right_norm")) / both >= least)
    return near.where(2.0 * F.size(F.array_intersect("_chars", "_others")) / both >= least).drop("_first", "_length", "_chars", "_others")


def scored(left: DataFrame, right: DataFrame, window: int, threshold: float, min_length: int = 5, margin: float = 0.0) -> DataFrame:
    """All columns of ``left`` and ``right`` and the ``score`` of their ``left_norm`` and ``right_norm``, from ``threshold - margin`` on."""
    return left.join(similar(left, right, window, threshold - margin - 1e-9, min_length), "left_norm").join(right, "right_norm")


@dataclass(frozen=True)
class Resolver:
    """The parameters in which the resolvers differ."""

    norm: Callable[[Column], Column]
    threshold: float
    margin: float
    window: int
    min_length: int = 5
    compact_length: int = 0  # 0: no compact stage
    fuzzy_norm: Callable[[Column], Column] | None = None
    per_key: bool = False
    veto_subsets: bool = False
    close_is_ambiguous: bool = False


def _compact_plain(c: Column) -> Column:
    return N.compact(N.plain_name(c))


IMPORT_STUDIO = Resolver(N.entity_name, 0.96, 0.03, 3)
IMPORT_PERFORMER = Resolver(N.entity_name, 0.98, 0.03, 3)
MIGRATE_TAG = Resolver(N.plain_name, 0.96, 0.02, 4, compact_length=4, fuzzy_norm=_compact_plain, veto_subsets=True, close_is_ambiguous=True)
MIGRATE_PERFORMER = Resolver(N.plain_name, 0.98, 0.03, 4, compact_length=4, fuzzy_norm=_compact_plain, close_is_ambiguous=True)
MIGRATE_STUDIO = Resolver(N.plain_name, 0.96, 0.03, 4, compact_length=4, fuzzy_norm=_compact_plain, close_is_ambiguous=True)
IMPORT_TAG = Resolver(N.tag_key, 0.96, 0.02, 2, per_key=True)


def resolve(incoming: DataFrame, entities: DataFrame, how: Resolver) -> DataFrame:
    """``name, decision, id, score`` for each different incoming name.

    Decisions: exact, compact, fuzzy, ambiguous, none. Equality with more than one
    entity is ambiguous and final; fuzzy is tried only without any equal name. Two
    similar entities less than the margin apart give ambiguous or none, as ``how``
    says, whether or not the second reaches the threshold itself.
    """
    names = incoming.select("name").distinct()
    source = spellings(entities)
    if how.per_key:
        index = unambiguous_index(entities, how.norm)
        stages = [(how.norm, "exact", 1, index)]
    else:
        stages = [(how.norm, "exact", 1, None)] + ([(lambda c: N.compact(how.norm(c)), "compact", how.compact_length, None)] if how.compact_length else [])
    done = None
    rest = names
    for norm, label, least, index in stages:
        keyed = index.select(F.col("key").alias("_key"), "id") if index is not None else source.select(norm(F.col("spelling")).alias("_key"), "id").where(F.length("_key") >= least).distinct()
        hits = unique_joined(rest.select("name", norm(F.col("name")).alias("_key")).where(F.length("_key") >= least), keyed, ["_key"], "name", "id")
        part = hits.select("name", F.when(F.col("hits") == 1, label).otherwise("ambiguous").alias("decision"), "id", F.lit(1.0).alias("score"))
        done = part if done is None else done.unionByName(part)
        rest = rest.join(hits, "name", "left_anti")
    norm = how.fuzzy_norm or how.norm
    left = rest.select("name", norm(F.col("name")).alias("left_norm"))
    keys = unambiguous_index(entities, how.norm).select(F.col("key").alias("right_norm"), "id") if how.per_key else source.select(norm(F.col("spelling")).alias("right_norm"), "id").distinct()
    if not how.per_key:
        # of the owners of one form the first and the last do: if there are two, none of them wins by it
        ends = keys.groupBy("right_norm").agg(F.min("id").alias("_a"), F.max("id").alias("_z"))
        keys = ends.select("right_norm", F.explode(F.array_distinct(F.array("_a", "_z"))).alias("id"))
    near = scored(left, keys, how.window, how.threshold, how.min_length, how.margin)
    won = winner_with_margin(near, "name", "id", "score", how.threshold, how.margin, "right_norm" if how.per_key else None)
    close = near.where(F.col("score") >= how.threshold).select("name").distinct().join(won, "name", "left_anti").select("name", F.lit("ambiguous").alias("decision"), F.lit(None).cast(entities.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("score"))
    if how.veto_subsets:
        named = entities.select("id", F.col("name").alias("_other"))
        won = won.join(named, "id").where(~N.token_subset(N.plain_name(F.col("name")), N.plain_name(F.col("_other"))))
    fuzzy = won.select("name", F.lit("fuzzy").alias("decision"), "id", "score")
    found = done.unionByName(fuzzy).unionByName(close) if how.close_is_ambiguous else done.unionByName(fuzzy)
    return names.join(found, "name", "left").select("name", F.coalesce("decision", F.lit("none")).alias("decision"), "id", "score")


def review_pairs(entities: DataFrame, norm: Callable[[Column], Column], window: int, threshold: float, veto: bool = True, components: DataFrame | None = None) -> DataFrame:
    """``left_id, right_id, score``: similar primary names, each unordered pair once, the earlier entity left; pairs of one component are left out."""
    keyed = entities.select("id", "ordinal", norm(F.col("name")).alias("n"))
    left = keyed.select(F.col("id").alias("left_id"), F.col("ordinal").alias("_lo"), F.col("n").alias("left_norm"))
    right = keyed.select(F.col("id").alias("right_id"), F.col("ordinal").alias("_ro"), F.col("n").alias("right_norm"))
    near = similar(left, right, window, threshold, 5)
    if veto:
        near = near.where(~N.token_subset(F.col("left_norm"), F.col("right_norm")))
    pairs = left.join(near, "left_norm").join(right, "right_norm").where("_lo < _ro")
    if components is not None:
        c = components.select("id", "component")
        pairs = pairs.join(c.select(F.col("id").alias("left_id"), F.col("component").alias("_lc")), "left_id", "left").join(c.select(F.col("id").alias("right_id"), F.col("component").alias("_rc")), "right_id", "left")
        pairs = pairs.where(~F.coalesce(F.col("_lc") == F.col("_rc"), F.lit(False)))
    return pairs.select("left_id", "right_id", "score")


def guarded(incoming: DataFrame, entities: DataFrame, threshold: float = 0.90, window: int = 6, min_length: int = 4) -> DataFrame:
    """``name, blocked``: whether any entity is so similar that none may be created under the name."""
    names = incoming.select("name").distinct()
    near = scored(names.select("name", _compact_plain(F.col("name")).alias("left_norm")), spellings(entities).select(_compact_plain(F.col("spelling")).alias("right_norm")).distinct(), window, threshold, min_length)
    near = near.where(F.col("score") >= threshold).select("name").distinct().withColumn("blocked", F.lit(True))
    return names.join(near, "name", "left").select("name", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def resolve_or_create(incoming: DataFrame, entities: DataFrame, how: Resolver) -> DataFrame:
    """``name, action, id``: reuse a resolved entity, report an ambiguous or blocked name, create the rest.

    Names are resolved against one snapshot; new names that normalise alike get
    one creation, under the smallest of them.
    """
    found = resolve(incoming, entities, how).join(guarded(incoming, entities), "name")
    action = F.when(F.col("decision").isin("exact", "compact", "fuzzy"), "reuse").when(F.col("decision") == "ambiguous", "ambiguous").when(F.col("blocked"), "blocked").otherwise("create")
    acted = found.select("name", action.alias("action"), "id")
    fresh = acted.where("action = 'create'").withColumn("_key", how.norm(F.col("name")))
    first = fresh.groupBy("_key").agg(F.min("name").alias("_first"))
    made = fresh.join(first, "_key").select("name", F.when(F.col("name") == F.col("_first"), "create").otherwise("join_new").alias("action"), F.concat(F.lit("new:"), F.col("_first")).alias("id"))
    return acted.where("action <> 'create'").unionByName(made)
