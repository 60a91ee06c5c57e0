"""Matching old records to current media by exact evidence, in stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG = ("md5", "oshash", "sha1", "sha256", "sha512")


def divided(hits: DataFrame, kind: str) -> DataFrame:
    """``old_id, current_id, kind, candidates`` from ``old_id, evidence, current_id``.

    Evidence without a hit isn't in ``hits`` and doesn't count. An object hit by
    all evidence is in the intersection: the only one there wins, else the only
    one at all; more are ambiguous.
    """
    pairs = hits.distinct()
    evidence = pairs.groupBy("old_id").agg(F.count_distinct("evidence").alias("_all"))
    each = pairs.groupBy("old_id", "current_id").agg(F.count("*").alias("_hit")).join(evidence, "old_id")
    summed = each.groupBy("old_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("_hit") == F.col("_all")).alias("_full"), F.min(F.when(F.col("_hit") == F.col("_all"), F.col("current_id"))).alias("_one"), F.min("current_id").alias("_any"))
    won = F.when(F.col("_full") == 1, F.col("_one")).when(F.col("candidates") == 1, F.col("_any"))
    return summed.select("old_id", won.alias("current_id"), F.when(won.isNotNull(), kind).otherwise("ambiguous").alias("kind"), "candidates")


def strong_hits(old: DataFrame, current: DataFrame, types: Sequence[str] = STRONG) -> DataFrame:
    """Equal strong fingerprints. Both sides: ``id, path, size, fp_type, fp_value``, a row for each fingerprint."""
    own = old.where(F.col("fp_type").isin(*types) & (F.col("fp_value") != "")).select(F.col("id").alias("old_id"), F.concat_ws("|", "path", "fp_type").alias("evidence"), "fp_type", F.lower("fp_value").alias("fp_value"))
    other = current.where(F.col("fp_type").isin(*types) & (F.col("fp_value") != "")).select(F.col("id").alias("current_id"), "fp_type", F.lower("fp_value").alias("fp_value"))
    return own.join(other, ["fp_type", "fp_value"]).select("old_id", "evidence", "current_id")


def path_hits(old: DataFrame, current: DataFrame) -> DataFrame:
    """Equal paths; all paths of an old record are one piece of evidence."""
    own = old.where("path is not null").select(F.col("id").alias("old_id"), "path").distinct()
    other = current.where("path is not null").select(F.col("id").alias("current_id"), "path").distinct()
    return own.join(other, "path").select("old_id", F.lit("path").alias("evidence"), "current_id")


def phash_size_hits(old: DataFrame, current: DataFrame, types: Sequence[str] = STRONG) -> DataFrame:
    """Equal perceptual hash and size, only for old files without any strong fingerprint and with a size above 0."""
    strong = old.where(F.col("fp_type").isin(*types) & (F.col("fp_value") != "")).select("id", "path").distinct()
    weak = old.where((F.col("fp_type") == "phash") & (F.col("fp_value") != "") & (F.col("size") > 0)).join(strong, ["id", "path"], "left_anti")
    own = weak.select(F.col("id").alias("old_id"), F.col("path").alias("evidence"), F.lower("fp_value").alias("v"), "size")
    other = current.where((F.col("fp_type") == "phash") & (F.col("size") > 0)).select(F.col("id").alias("current_id"), F.lower("fp_value").alias("v"), "size")
    return own.join(other, ["v", "size"]).select("old_id", "evidence", "current_id")


def match_cascade(old: DataFrame, current: DataFrame, types: Sequence[str] = STRONG) -> DataFrame:
    """``old_id, current_id, kind`` for every old record: fingerprint, exact-path, strict-phash, ambiguous or unmatched.

    A stage counts only for records without any candidate in the stages before.
    """
    stages = [divided(strong_hits(old, current, types), "fingerprint"), divided(path_hits(old, current), "exact-path"), divided(phash_size_hits(old, current, types), "strict-phash")]
    staged = None
    for k, s in enumerate(stages):
        s = s.select("old_id", F.struct(F.lit(k).alias("stage"), "current_id", "kind").alias("m"))
        staged = s if staged is None else staged.unionByName(s)
    best = staged.groupBy("old_id").agg(F.min_by("m", "m.stage").alias("m"))
    every = old.select(F.col("id").alias("old_id")).distinct()
    return every.join(best, "old_id", "left").select("old_id", F.col("m.current_id").alias("current_id"), F.coalesce("m.kind", F.lit("unmatched")).alias("kind"))
