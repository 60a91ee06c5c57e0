"""The workflow of lookups: gates, outcomes, status transitions, counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import band, key_ci

STATUSES = ("Imported", "NoMatch", "Review", "Unresolved")


def status_gate(tags: Column) -> Column:
    """The status that decides for an array of marker names: Imported, then NoMatch, Review, Unresolved; else Pending."""
    out = F.lit("Pending")
    for s in reversed(STATUSES):
        out = F.when(F.array_contains(tags, s), s).otherwise(out)
    return out


def status_names(tags: Column) -> Column:
    """The markers among an array of tag names, lower case."""
    return F.filter(F.transform(tags, key_ci), lambda t: t.isin(*[s.lower() for s in STATUSES]))


def other_tags(tags: Column) -> Column:
    """The tag names that are no markers, as they are."""
    return F.filter(tags, lambda t: ~F.coalesce(key_ci(t).isin(*[s.lower() for s in STATUSES]), F.lit(False)))


def targets(rows: DataFrame, mode: str) -> DataFrame:
    """Rows of a run by mode: ``no_match``, ``review``, ``deep`` (unresolved) or ``fast`` (all)."""
    want = {"no_match": "NoMatch", "review": "Review", "deep": "Unresolved"}.get(mode)
    return rows if want is None else rows.where(F.col("status") == want)


def eligible(rows: DataFrame, ok: Column, order: list[Column], *limits: int) -> DataFrame:
    """The first rows that are eligible; the smallest positive limit counts, none if there is none."""
    found = rows.where(ok).orderBy(*order)
    real = [n for n in limits if n and n > 0]
    return found.limit(min(real)) if real else found


def transition(state: Column, outcome: Column) -> Column:
    """The next status: Imported stays whatever a later lookup says; an unknown outcome never becomes a miss."""
    return (
        F.when(state == "Imported", "Imported").when(outcome == "match", "Imported").when(outcome == "candidate", "Review").when(outcome == "miss", "NoMatch").otherwise(F.lit("Unresolved"))
    )


def authoritative(outcomes: DataFrame, key: str, status: str = "status") -> DataFrame:
    """``key, attempts, no_match, retryable``: a miss counts only if there was a lookup and all of them missed."""
    return outcomes.groupBy(key).agg(
        F.count(status).alias("attempts"), (F.every(F.col(status) == "miss") & (F.count(status) > 0)).alias("no_match"), F.bool_or(F.col(status).isin("retryable_error", "unavailable")).alias("retryable")
    )


def run_stats(results: DataFrame, result: str = "result", provider: str = "provider") -> DataFrame:
    """One row of counters over results such as ``matched_x``, ``updated_x`` and ``unchanged_x``."""
    count = lambda prefix: F.count_if(F.col(result).startswith(prefix))
    return results.agg(F.count("*").alias("processed"), count("matched_").alias("matched"), count("updated_").alias("updated"), count("unchanged_").alias("unchanged"), F.count_if(F.col(result) == "failed").alias("failed"))


def rates(elapsed: Column, images: Column, kilobytes: Column) -> list[Column]:
    return [
        F.coalesce(F.round(F.try_divide(elapsed, images), 4), F.lit(0.0)).alias("seconds_per_image"),
        F.coalesce(F.round(F.try_divide(images * 60, elapsed), 4), F.lit(0.0)).alias("images_per_minute"),
        F.coalesce(F.round(F.try_divide(kilobytes, images), 4), F.lit(0.0)).alias("average_kb"),
    ]


def preflight(kinds: DataFrame, floor: float = 0.70, least: int = 100) -> DataFrame:
    """``records, matched, rate, abort``: a restore of many records stops if too few match."""
    totals = kinds.agg(F.count("*").alias("records"), F.count_if(~F.col("kind").isin("ambiguous", "unmatched")).alias("matched"))
    rate = F.coalesce(F.try_divide(F.col("matched"), F.col("records")), F.lit(0.0))
    return totals.select("records", "matched", F.round(rate, 6).alias("rate"), ((F.col("records") >= least) & (rate < floor)).alias("abort"))


def active_candidate(urls: Column, is_candidate) -> Column:
    """The last address that is a candidate, the only one that a reviewer decides on."""
    return F.try_element_at(F.filter(urls, is_candidate), F.lit(-1))


def decide_review(state: DataFrame, decisions: DataFrame, is_candidate) -> DataFrame:
    """``id, candidate, status, urls``: yes imports, no removes the address and marks NoMatch, neither leaves all as it is."""
    joined = state.join(decisions, "id", "left").withColumn("candidate", active_candidate(F.col("urls"), is_candidate))
    yes, no = (F.col("decision") == "yes") & F.col("candidate").isNotNull(), (F.col("decision") == "no") & F.col("candidate").isNotNull()
    return joined.select("id", "candidate", F.when(yes, "Imported").when(no, "NoMatch").otherwise(F.col("status")).alias("status"), F.when(no, F.filter("urls", lambda u: u != F.col("candidate"))).otherwise(F.col("urls")).alias("urls"))


def pending(rows: DataFrame, done: DataFrame, id: str = "id") -> DataFrame:
    """Rows that no earlier run has finished."""
    return rows.join(done.select(id).distinct(), id, "left_anti")


def failure_runs(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """``key, run, failures``: unbroken runs of failures, each success ends one."""
    w = Window.partitionBy(key).orderBy(order)
    marked = events.withColumn("_f", failed).withColumn("run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("_f").groupBy(key, "run").agg(F.count("*").alias("failures"), F.min(order).alias("first"))


def decision(exact: DataFrame, nearest: DataFrame, visual: DataFrame, outcomes: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, route, status``: exact match, unique near hash, visual candidate by band, else what the lookups allow."""
    best = visual.groupBy("id").agg(F.max("score").alias("score"))
    joined = ids.select("id").distinct().join(exact.select("id").distinct().withColumn("_e", F.lit(True)), "id", "left").join(nearest.select("id").distinct().withColumn("_n", F.lit(True)), "id", "left").join(best, "id", "left").join(authoritative(outcomes, "id").select("id", "no_match"), "id", "left")
    grade = band(F.col("score"))
    route = F.when(F.col("_e"), "exact").when(F.col("_n"), "near_hash").when(grade == "HIGH", "visual").when(grade == "REVIEW", "visual_review").otherwise("none")
    outcome = F.when(route.isin("exact", "near_hash", "visual"), "match").when(route == "visual_review", "candidate").when(F.coalesce("no_match", F.lit(False)), "miss").otherwise("unknown")
    return joined.select("id", route.alias("route"), transition(F.lit("Pending"), outcome).alias("status"))
