"""Looking names up: by key, by normalised name, by compact name, by external id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import compact, key_ci
from reconloom.operators.winner import first_of, unique_hits, unique_joined
from reconloom.sources.durable import durable


def spellings(entities: DataFrame, id: str = "id", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """``id, spelling, primary``: the name and each alias of an entity, blanks left out."""
    every = F.concat(F.array(F.struct(F.col(name).alias("spelling"), F.lit(True).alias("primary"))), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.struct(a.alias("spelling"), F.lit(False).alias("primary"))))
    return entities.select(id, F.explode(every).alias("_s")).select(id, "_s.spelling", "_s.primary").where(F.col("spelling").isNotNull() & (key_ci(F.col("spelling")) != ""))


def name_index(entities: DataFrame, first: bool = True, ordinal: str = "ordinal") -> DataFrame:
    """``key, id``: each case-insensitive name or alias with its first (or last) owner."""
    keyed = spellings(entities).join(entities.select("id", ordinal), "id").select(key_ci(F.col("spelling")).alias("key"), "id", ordinal)
    return first_of(keyed, ["key"], F.col(ordinal).asc() if first else F.col(ordinal).desc()).select("key", "id")


def unambiguous_index(entities: DataFrame, norm: Callable[[Column], Column]) -> DataFrame:
    """``key, id``: normalised names and aliases that belong to one entity only."""
    keyed = spellings(entities).select(norm(F.col("spelling")).alias("key"), "id").where("key <> ''")
    return unique_hits(keyed, "key", "id").where("hits = 1").select("key", "id")


def equality_match(incoming: DataFrame, entities: DataFrame, norm: Callable[[Column], Column], min_length: int = 1) -> DataFrame:
    """``name, hits, id`` for the names with a hit: the entity if exactly one has the normalised name among its names and aliases."""
    a = incoming.select("name", norm(F.col("name")).alias("_key")).where(F.length("_key") >= min_length)
    b = spellings(entities).select(norm(F.col("spelling")).alias("_key"), "id").where(F.length("_key") >= min_length).distinct()
    return unique_joined(a, b, ["_key"], "name", "id")


def staged_match(incoming: DataFrame, entities: DataFrame, norm: Callable[[Column], Column], compact_length: int = 4) -> DataFrame:
    """``name, stage, hits, id``: normalised equality, then compact equality for names without any normalised hit."""
    names = incoming.select("name").distinct()
    exact = equality_match(names, entities, norm).withColumn("stage", F.lit("normalized"))
    rest = names.join(exact, "name", "left_anti")
    close = equality_match(rest, entities, lambda c: compact(norm(c)), compact_length).withColumn("stage", F.lit("compact"))
    return exact.unionByName(close).select("name", "stage", "hits", "id")


def external_id_match(incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """``source, hits, id`` by (endpoint without case, id); both sides: an id column and ``endpoint, external_id``."""
    own = incoming.select("source", key_ci(F.col("endpoint")).alias("e"), F.col("external_id").alias("x"))
    other = entities.select("id", key_ci(F.col("endpoint")).alias("e"), F.col("external_id").alias("x"))
    return unique_joined(own, other, ["e", "x"], "source", "id")


def cascade(source: DataFrame, *stages: tuple[str, DataFrame]) -> DataFrame:
    """``source, stage, id``: the first stage that has one target for the source decides; one with more is ambiguous and final.

    ``source`` has ``source``; each stage has ``source, target``, or ``source, hits, target`` where the targets are counted already."""
    staged = None
    for k, (label, hits) in enumerate(stages):
        counted = hits if "hits" in hits.columns else unique_hits(hits, "source", "target")
        one = counted.select("source", F.struct(F.lit(k).alias("k"), F.when(F.col("hits") == 1, label).otherwise("ambiguous").alias("stage"), F.col("target").alias("id")).alias("m"))
        staged = one if staged is None else staged.unionByName(one)
    best = staged.groupBy("source").agg(F.min_by("m", "m.k").alias("m"))
    return source.select("source").distinct().join(best, "source", "left").select("source", F.coalesce("m.stage", F.lit("none")).alias("stage"), F.col("m.id").alias("id"))


def disjunctive_first(refs: DataFrame, rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """``ref, id``: the first row in order that agrees with the reference on any of ``keys``; an OR of equalities as a union of equi joins.

    Of the rows with one value only the first can be an answer, so references meet that one alone."""
    hits = None
    for k in keys:
        own = refs.where(F.col(k).isNotNull()).select("ref", F.col(k).alias("_v"))
        other = rows.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_v")).agg(F.min_by(F.struct("id", ordinal), ordinal).alias("_f"))
        part = own.join(other, "_v").select("ref", "_f.id", f"_f.{ordinal}")
        hits = part if hits is None else hits.unionByName(part)
    return hits.groupBy("ref").agg(F.min_by("id", ordinal).alias("id"))


def alias_owners(entities: DataFrame, norm: Callable[[Column], Column]) -> DataFrame:
    """``key, owner``: for each name or alias its last owner."""
    keyed = spellings(entities).join(entities.select("id", "ordinal"), "id").select(norm(F.col("spelling")).alias("key"), "id", "ordinal")
    return first_of(keyed, ["key"], F.col("ordinal").desc()).select("key", F.col("id").alias("owner"))


def safe_aliases(entities: DataFrame, norm: Callable[[Column], Column]) -> DataFrame:
    """``id, alias, safe``: whether an alias is its entity's own, or another's by name or alias."""
    own = spellings(entities).where(~F.col("primary")).select("id", F.col("spelling").alias("alias"), norm(F.col("spelling")).alias("key")).distinct()
    return own.join(alias_owners(entities, norm), "key", "left").select("id", "alias", (F.col("owner").isNull() | (F.col("owner") == F.col("id"))).alias("safe"))


def near_in_time(left: DataFrame, right: DataFrame, key: str, at: str, within: float) -> DataFrame:
    """``left_id, right_id``: the first row of ``right`` with an equal key and a time less than ``within`` seconds away.

    Times fall into cells of the tolerance; each left row looks at its own cell
    and the two beside it, so the band becomes an equi join."""
    cell = F.floor(F.col(at) / F.lit(within)).cast("long")
    a = left.select(F.col("id").alias("left_id"), F.col(key).alias("_k"), F.col(at).alias("_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    b = right.select(F.col("id").alias("right_id"), F.col(key).alias("_k"), F.col(at).alias("_b"), cell.alias("_c"))
    hits = a.join(b, ["_k", "_c"]).where((F.abs(F.col("_a") - F.col("_b")) < within) & (F.col("left_id") != F.col("right_id")))
    return hits.groupBy("left_id").agg(F.min("right_id").alias("right_id"))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` plus its row number in the order of all rows: ranges are sorted each for itself, after the rows of the ranges before."""
    dealt = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_part", "_before")
