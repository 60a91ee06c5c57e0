"""Resolvers that look at more than the name: external ids, primary names first, disambiguations, split aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import casefolded, compact, key_ci, plain_name, strip
from reconloom.operators import fuzzy
from reconloom.operators.names import external_id_match, ranked, spellings
from reconloom.operators.winner import ordered_ci_distinct, unique_joined


def resolve_tags(incoming: DataFrame, entities: DataFrame, old_ids: DataFrame, current_ids: DataFrame) -> DataFrame:
    """``name, decision, id, identity_conflict`` for each different incoming name.

    A unique primary name decides, whatever the external id says (if that points
    elsewhere, the two identities conflict and only the relation is made). Several
    entities with the primary name are told apart by the external id, or stay
    ambiguous. Without one the external id decides, then aliases and similar names
    (``fuzzy.MIGRATE_TAG``); what is left is ``blocked`` if any entity is too
    similar for a new one to be made, else ``create``. ``old_ids``: ``name,
    endpoint, external_id``; ``current_ids``: ``id, endpoint, external_id``.
    """
    names = incoming.select("name").distinct().withColumn("_key", plain_name(F.col("name"))).where("_key <> ''")
    keyed = entities.select("id", plain_name(F.col("name")).alias("_key"))
    primary = unique_joined(names, keyed, ["_key"], "name", "id").select("name", F.col("hits").alias("_p"), F.col("id").alias("_pid"))
    external = external_id_match(old_ids.withColumnRenamed("name", "source"), current_ids).select(F.col("source").alias("name"), F.col("hits").alias("_x"), F.col("id").alias("_xid"))
    external = external.join(keyed.select(F.col("id").alias("_xid"), F.col("_key").alias("_xkey")), "_xid", "left")
    decided = fuzzy.resolve(incoming, entities, fuzzy.MIGRATE_TAG).select("name", "decision", F.col("id").alias("_fid"))
    every = names.join(primary, "name", "left").join(external, "name", "left").join(decided, "name", "left").join(fuzzy.guarded(incoming, entities), "name", "left")
    way = (
        F.when(F.col("_p") == 1, "primary").when(F.col("_p") > 1, F.when((F.col("_x") == 1) & (F.col("_xkey") == F.col("_key")), "external").otherwise("ambiguous"))
        .when(F.col("_x") == 1, "external").when(F.col("_x") > 1, "ambiguous").when(F.col("decision") != "none", F.col("decision")).when(F.col("blocked"), "blocked").otherwise("create")
    )
    found = every.withColumn("_way", way)
    id = F.when(F.col("_way") == "primary", F.col("_pid")).when(F.col("_way") == "external", F.col("_xid")).when(F.col("_way").isin("exact", "compact", "fuzzy"), F.col("_fid"))
    return found.select("name", F.col("_way").alias("decision"), id.alias("id"), F.coalesce((F.col("_way") == "primary") & (F.col("_x") == 1) & (F.col("_xid") != F.col("_pid")), F.lit(False)).alias("identity_conflict"))


def resolve_performers(old: DataFrame, entities: DataFrame, unclear: str = "ambiguous") -> DataFrame:
    """``name, decision, id``: by name as ``fuzzy.MIGRATE_PERFORMER`` does, more strictly.

    ``old``: ``name, disambiguation``; a name with several different
    disambiguations is ``unclear``. An entity whose disambiguation differs from
    the old one, both given, is a ``conflict``: neither used nor made anew.
    ``entities``: ``id, ordinal, name, aliases, disambiguation``."""
    own = old.select("name", strip(casefolded(F.coalesce("disambiguation", F.lit("")))).alias("_d")).groupBy("name").agg(F.count_distinct("_d").alias("_n"), F.min("_d").alias("_d"))
    theirs = entities.select("id", strip(casefolded(F.coalesce("disambiguation", F.lit("")))).alias("_e"))
    found = fuzzy.resolve(own, entities, fuzzy.MIGRATE_PERFORMER).join(own, "name").join(theirs, "id", "left")
    clash = F.col("id").isNotNull() & (F.col("_d") != "") & (F.col("_e") != "") & (F.col("_d") != F.col("_e"))
    way = F.when(F.col("_n") > 1, unclear).when(clash, "conflict").when(F.col("decision") == "none", "create").otherwise(F.col("decision"))
    return found.select("name", way.alias("decision"), F.when(way.isin("exact", "compact", "fuzzy"), F.col("id")).alias("id"))


def split_aliases(raw: Column) -> Column:
    """The alias text as it is, and its parts at semicolons, line ends and commas."""
    parts = F.concat(F.array(raw), F.split(raw, ";"), F.split(raw, "\n"), F.split(raw, ","))
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(ordered_ci_distinct(parts))


def resolve_groups(incoming: DataFrame, groups: DataFrame) -> DataFrame:
    """``name, decision, id``: the one group with an equal normalised or compact name or alias part; none: ``create``; several: ``ambiguous``."""
    names = incoming.select("name").distinct().withColumn("_key", plain_name(F.col("name"))).where("_key <> ''").withColumn("_short", compact(F.col("_key")))
    each = spellings(groups.withColumn("aliases", split_aliases(F.col("aliases")))).select("id", plain_name(F.col("spelling")).alias("_key")).distinct()
    keys = lambda df, id, short, least: df.select(id, F.lit("whole").alias("_kind"), "_key").unionByName(df.where(F.length(short) >= least).select(id, F.lit("short").alias("_kind"), short.alias("_key")))
    hits = unique_joined(keys(names, "name", F.col("_short"), 4), keys(each, "id", compact(F.col("_key")), 4), ["_kind", "_key"], "name", "id")
    return names.join(hits, "name", "left").select("name", F.when(F.col("hits") == 1, "reuse").when(F.col("hits") > 1, "ambiguous").otherwise("create").alias("decision"), "id")


def appended_aliases(entities: DataFrame, found: DataFrame) -> DataFrame:
    """``id, aliases`` of the entities that resolved names (``name, id``) give a new alias: the old ones, then the new by name; none equal to the primary name."""
    new = found.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("_new"))
    both = entities.join(new, "id").withColumn("_primary", key_ci(F.col("name")))
    made = both.withColumn("_all", F.filter(ordered_ci_distinct("aliases", "_new"), lambda x: key_ci(x) != F.col("_primary")))
    return made.where(F.size("_all") > F.size(F.coalesce("aliases", F.array().cast("array<string>")))).select("id", F.col("_all").alias("aliases"))


def created(old: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """``name`` and ``fields`` of the rows to make: old entities that resolved to ``create``, one for each normalised name."""
    wanted = found.where("decision = 'create'").select("name").join(old, "name").withColumn("_key", plain_name(F.col("name")))
    return wanted.groupBy("_key").agg(F.min_by(F.struct("name", *fields), "name").alias("_r")).select("_r.*")


def lookup_batches(names: DataFrame, known: DataFrame, size: int = 50) -> DataFrame:
    """``source, name, batch`` of the different names of each source whose type is not known yet, in batches of ``size`` in name order."""
    key = lambda df: df.select(key_ci(F.col("source")).alias("source"), key_ci(F.col("name")).alias("name"))
    open_ = key(names).distinct().join(key(known), ["source", "name"], "left_anti").where("name <> ''")
    # places over all names, less the first place of the source: no source is one task
    placed = ranked(open_, F.col("source"), F.col("name"), name="_at")
    first = placed.groupBy("source").agg(F.min("_at").alias("_first"))
    return placed.join(first, "source").select("source", "name", F.floor((F.col("_at") - F.col("_first")) / size).cast("long").alias("batch"))


def singles(batches: DataFrame, answered: DataFrame, most: int = 20) -> DataFrame:
    """``source, name``: after unanswered batches the first ``most`` names of a source are asked for one by one."""
    left = batches.join(answered.select("source", "batch").distinct(), ["source", "batch"], "left_anti")
    order = Window.partitionBy("source").orderBy("name")
    return left.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("source", "name")


def validated_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``id, status, post_id``: what exact lookups by md5 found: ``match`` only where the answer names the md5 asked for.

    ``asked``: ``id, md5``; ``answers``: ``md5`` (as it was asked for), ``post_id, post_md5``. Case does not count. An answer with
    another md5 or none is a ``miss``, as no answer is; of several posts that fit, the smallest id counts."""
    want = asked.select("id", F.lower(strip(F.col("md5"))).alias("_md5"))
    right = answers.where(F.lower(strip(F.col("md5"))) == F.lower(strip(F.col("post_md5")))).groupBy(F.lower(strip(F.col("md5"))).alias("_md5")).agg(F.min("post_id").alias("post_id"))
    return want.join(right, "_md5", "left").select("id", F.when(F.col("post_id").isNull(), "miss").otherwise("match").alias("status"), "post_id")


def usage_counts(entities: DataFrame, *children: tuple[DataFrame, str]) -> DataFrame:
    """``id, usage``: references to each entity over all child collections, each a table and its foreign key; added up in one shuffle."""
    keys = None
    for rows, key in children:
        part = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
        keys = part if keys is None else keys.unionByName(part)
    total = keys.groupBy("id").agg(F.sum("n").alias("usage"))
    return entities.select("id").distinct().join(total, "id", "left").select("id", F.coalesce("usage", F.lit(0).cast("long")).alias("usage"))
