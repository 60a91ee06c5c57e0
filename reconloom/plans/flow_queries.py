"""Sinks, aggregates, workflow and stateful operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.operators import merge, names, winner
from reconloom.plans import flow
from reconloom.plans.binding import Surrogate, query
from reconloom.sources import export
from reconloom.streaming import stateful

# --- old and current state of the same objects: documents, some fields of which have gone missing
_CUR = Surrogate("documents", id="doc_id", title="CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE source END", rating="CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 100 END", organized="doc_id % 5 = 0", details="CASE WHEN doc_id % 2 = 0 THEN lang END")
_OLD = Surrogate("documents", id="CASE WHEN doc_id % 10 < 8 THEN doc_id ELSE -1 - doc_id END", title="lang || '-' || source", rating="doc_id % 7", organized="doc_id % 3 = 0", details="source")
_KINDS = {"title": "string", "rating": "int", "organized": "boolean", "details": "string"}
_AFTER = f"""(SELECT c.id, CASE WHEN c.title IS NULL OR c.title = '' THEN o.title ELSE c.title END AS title, CASE WHEN c.rating IS NULL OR c.rating = 0 THEN o.rating ELSE c.rating END AS rating,
 coalesce(c.organized, false) OR coalesce(o.organized, false) AS organized, coalesce(nullif(c.details, ''), o.details) AS details FROM {_CUR.sql} c LEFT JOIN {_OLD.sql} o ON c.id = o.id)"""
query("merge_entity_metadata", f"SELECT id, title, CAST(rating AS BIGINT) AS rating, organized, details FROM {_AFTER} a")(lambda t: _after(t).withColumn("rating", F.col("rating").cast("long")))


def _after(t):
    return merge.fill(_CUR.df(t), _OLD.df(t), "id", _KINDS)


def _changes(cols, after: str, before: str) -> str:
    return " UNION ALL ".join(f"SELECT a.id, '{c}' AS field, CAST(b.{c} AS VARCHAR) AS old, CAST(a.{c} AS VARCHAR) AS new FROM {after} a LEFT JOIN {before} b ON a.id = b.id WHERE a.{c} IS NOT NULL AND b.{c} IS DISTINCT FROM a.{c}" for c in cols)


query("restore_changeset", _changes(_KINDS, _AFTER, _CUR.sql))(lambda t: merge.changeset(_CUR.df(t), _after(t), "id", list(_KINDS)))
query("changeset", _changes(["title", "details"], _OLD.sql, _CUR.sql))(lambda t: merge.changeset(_CUR.df(t), _OLD.df(t), "id", ["title", "details"]))
query("counter_delta", f"SELECT c.id, CAST(greatest(0, coalesce(o.rating, 0) - coalesce(c.rating, 0)) AS BIGINT) AS add_n FROM {_CUR.sql} c LEFT JOIN {_OLD.sql} o ON c.id = o.id")(
    lambda t: _CUR.df(t).alias("c").join(_OLD.df(t).alias("o"), "id", "left").select("id", merge.counter_delta(F.col("c.rating"), F.col("o.rating")).cast("long").alias("add_n"))
)
_MERGES = Surrogate("customer", "c_custkey % 10 = 3", source_id="c_custkey", destination_id="c_custkey - 3")
query("merge_rewrite_fk", f"SELECT o_orderkey, coalesce(m.destination_id, o_custkey) AS o_custkey, m.destination_id IS NOT NULL AS moved FROM orders LEFT JOIN {_MERGES.sql} m ON o_custkey = m.source_id")(lambda t: merge.rewrite_keys(t.orders.select("o_orderkey", "o_custkey"), _MERGES.df(t), "o_custkey").select("o_orderkey", "o_custkey", "moved"))
query("studio_reassign_counts", f"""SELECT 'orders' AS child, m.destination_id, count(*) AS moved FROM orders JOIN {_MERGES.sql} m ON o_custkey = m.source_id GROUP BY 2
 UNION ALL SELECT 'events', m.destination_id, count(*) FROM events JOIN {_MERGES.sql} m ON user_id = m.source_id GROUP BY 2""")(lambda t: merge.reassigned_counts(_MERGES.df(t), ("orders", t.orders.select("o_custkey"), "o_custkey"), ("events", t.events.select("user_id"), "user_id")))
_FILES = Surrogate("documents", ordinal="doc_id", type="CASE WHEN doc_id % 9 = 0 THEN 'Folder' ELSE 'basic' END", path="CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'f/' || (doc_id % 300) END", size="n_chars", a="upper(md5(source))", b="CASE WHEN doc_id % 2 = 0 THEN md5(lang) ELSE '' END")


@query("file_index", f"""SELECT path, size, lower(a) AS first_md5, CASE WHEN b <> '' THEN b ELSE lower(a) END AS md5, CASE WHEN b <> '' THEN 1 ELSE 1 END AS types FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal DESC) AS k FROM {_FILES.sql} f WHERE lower(type) <> 'folder' AND trim(path) <> '') x WHERE k = 1""")
def file_index(t):
    fp = F.array(F.struct(F.lit("MD5").alias("type"), F.col("a").alias("fingerprint")), F.struct(F.lit("md5").alias("type"), F.col("b").alias("fingerprint")))
    rows = _FILES.df(t).withColumn("fingerprints", fp)
    first = winner.first_of(rows.where("lower(type) <> 'folder' and trim(path) <> ''"), ["path"], F.col("ordinal").desc()).select("path", F.lower("a").alias("first_md5"))
    made = export.file_index(rows.select("ordinal", "type", "path", "size", "fingerprints"))
    return made.join(first, "path").select("path", "size", "first_md5", F.try_element_at("fingerprints", F.lit("md5")).alias("md5"), F.size("fingerprints").alias("types"))


query("provider_exact_lookup", "SELECT doc_id, CASE WHEN l.quality IS NULL THEN 'miss' ELSE 'match' END AS status, l.quality AS value FROM documents LEFT JOIN labels l USING (doc_id)")(
    lambda t: t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "miss").otherwise("match").alias("status"), F.col("quality").alias("value"))
)

# --- workflow
_STATE = Surrogate("documents", id="doc_id", tag1="CASE doc_id % 5 WHEN 0 THEN 'Review' WHEN 1 THEN 'NoMatch' WHEN 2 THEN 'x' ELSE 'Unresolved' END", tag2="CASE doc_id % 7 WHEN 0 THEN 'Imported' WHEN 1 THEN 'Review' ELSE 'y' END")
_GATE = "CASE WHEN 'Imported' IN (tag1, tag2) THEN 'Imported' WHEN 'NoMatch' IN (tag1, tag2) THEN 'NoMatch' WHEN 'Review' IN (tag1, tag2) THEN 'Review' WHEN 'Unresolved' IN (tag1, tag2) THEN 'Unresolved' ELSE 'Pending' END"
_state = lambda t: _STATE.df(t).select("id", flow.status_gate(F.array("tag1", "tag2")).alias("status"))
query("status_gate", f"SELECT id, {_GATE} AS status FROM {_STATE.sql} s")(_state)
query("target_selection", f"SELECT id, m AS mode FROM (SELECT id, {_GATE} AS status FROM {_STATE.sql} s) x, (VALUES ('no_match', 'NoMatch'), ('review', 'Review'), ('deep', 'Unresolved')) v(m, w) WHERE status = w UNION ALL SELECT id, 'fast' FROM {_STATE.sql} s")(
    lambda t: _union([flow.targets(_state(t), m).select("id", F.lit(m).alias("mode")) for m in ("no_match", "review", "deep", "fast")])
)


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_OUT = "CASE event_type WHEN 'purchase' THEN 'match' WHEN 'error' THEN 'unavailable' WHEN 'view' THEN 'candidate' ELSE 'miss' END"
query("status_transition", f"SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'Imported' ELSE CASE {_OUT} WHEN 'match' THEN 'Imported' WHEN 'candidate' THEN 'Review' WHEN 'miss' THEN 'NoMatch' ELSE 'Unresolved' END END AS status FROM events")(
    lambda t: t.events.select("event_id", flow.transition(F.when(F.col("event_id") % 6 == 0, "Imported").otherwise("Pending"), F.expr(_OUT)).alias("status"))
)
query("incremental_pending", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: flow.pending(t.documents.select(F.col("doc_id").alias("id")), t.labels.select(F.col("doc_id").alias("id"))))
query("authoritative_miss", f"SELECT lookup_id, count(*) AS attempts, bool_and(s = 'miss') AND count(*) > 0 AS no_match, bool_or(s IN ('retryable_error','unavailable')) AS retryable FROM (SELECT CAST(floor(event_id / 3) AS BIGINT) AS lookup_id, {_OUT} AS s FROM events) e GROUP BY 1")(
    lambda t: flow.authoritative(t.events.select(F.expr("CAST(floor(event_id / 3) AS BIGINT)").alias("lookup_id"), F.expr(_OUT).alias("status")), "lookup_id")
)
_RES = "CASE event_type WHEN 'purchase' THEN 'updated_a' WHEN 'view' THEN 'matched_b' WHEN 'error' THEN 'failed' ELSE 'unchanged_a' END"
query("run_stats", f"SELECT count(*) AS processed, count(*) FILTER (WHERE r LIKE 'matched%') AS matched, count(*) FILTER (WHERE r LIKE 'updated%') AS updated, count(*) FILTER (WHERE r LIKE 'unchanged%') AS unchanged, count(*) FILTER (WHERE r = 'failed') AS failed FROM (SELECT {_RES} AS r FROM events) e")(
    lambda t: flow.run_stats(t.events.select(F.expr(_RES).alias("result")))
)
query("run_rates", "SELECT user_id, coalesce(round(span / nullif(n, 0), 4), 0) AS seconds_per_image, coalesce(round(n * 60 / nullif(span, 0), 4), 0) AS images_per_minute, coalesce(round(kb / nullif(n, 0), 4), 0) AS average_kb FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(max(event_id) - min(event_id) AS DOUBLE) AS span, CAST(sum(event_id) AS DOUBLE) AS kb FROM events GROUP BY 1) e")(
    lambda t: t.events.groupBy("user_id").agg(F.count("*").cast("double").alias("n"), (F.max("event_id") - F.min("event_id")).cast("double").alias("span"), F.sum("event_id").cast("double").alias("kb")).select("user_id", *flow.rates(F.col("span"), F.col("n"), F.col("kb")))
)
_URLS = Surrogate("pages", id="page_id", a="url", b="'https://m.example.org/en/' || page_id", c="'https://else.invalid/' || page_id", status="'Review'")
_DEC = Surrogate("pages", id="page_id", decision="CASE page_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'later' END")


@query("review_decision", f"""SELECT u.id, b AS candidate, CASE decision WHEN 'yes' THEN 'Imported' WHEN 'no' THEN 'NoMatch' ELSE status END AS status, CASE WHEN decision = 'no' THEN a || ' ' || c ELSE a || ' ' || b || ' ' || c END AS urls FROM {_URLS.sql} u LEFT JOIN {_DEC.sql} d ON u.id = d.id""")
def review(t):
    state = _URLS.df(t).select("id", F.array("a", "b", "c").alias("urls"), "status")
    return flow.decide_review(state, _DEC.df(t), lambda u: ~F.contains(u, F.lit("else.invalid"))).withColumn("urls", F.array_join("urls", " "))


query("failure_runs", """SELECT user_id, run, count(*) AS failures, min(event_id) AS first FROM (SELECT user_id, event_id, event_type IN ('error', 'click') AS f, CAST(sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM events) e WHERE f GROUP BY 1, 2""")(
    lambda t: flow.failure_runs(t.events, "user_id", "event_id", F.col("event_type").isin("error", "click"))
)
_calls = lambda t: t.events.select(F.concat(F.lit("h"), F.col("user_id") % 12).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), (F.col("event_type").isin("error", "click", "view")).alias("failed")).withColumn("at", F.col("us") / 1e6).drop("us")
_CALLS = "(SELECT 'h' || (user_id % 12) AS host, epoch_us(ts) / 1e6 AS tm, event_type IN ('error', 'click', 'view') AS failed FROM events)"
_STEPS = f"e AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY tm, failed) AS k FROM {_CALLS} c)"
_BREAKER = f"""WITH RECURSIVE {_STEPS}, s(host, k, failures, until, opened, rejected, passed) AS (SELECT DISTINCT host, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM e UNION ALL
 SELECT s.host, e.k, CASE WHEN tm < until THEN failures WHEN failed AND failures < 3 THEN failures + 1 ELSE 0 END, CASE WHEN tm >= until AND failed AND failures >= 3 THEN tm + 1200.0 ELSE until END, opened + CASE WHEN tm >= until AND failed AND failures >= 3 THEN 1 ELSE 0 END,
 rejected + CASE WHEN tm < until THEN 1 ELSE 0 END, passed + CASE WHEN tm < until THEN 0 ELSE 1 END FROM s JOIN e ON s.host = e.host AND e.k = s.k + 1)
 SELECT host, opened, rejected, passed, until AS open_until FROM s WHERE (host, k) IN (SELECT host, max(k) FROM e GROUP BY 1)"""
_PACE = f"""WITH RECURSIVE {_STEPS}, s(host, k, waits, waited, delay) AS (SELECT DISTINCT host, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE FROM e UNION ALL
 SELECT s.host, e.k, waits + CASE WHEN failed THEN 1 ELSE 0 END, waited + CASE WHEN failed THEN least(20.0, greatest(5.0, delay * 2)) ELSE 0.0 END, CASE WHEN failed THEN least(20.0, greatest(5.0, delay * 2)) WHEN delay / 2 >= 5.0 THEN delay / 2 ELSE 0.0 END
 FROM s JOIN e ON s.host = e.host AND e.k = s.k + 1) SELECT host, waits, waited, delay FROM s WHERE (host, k) IN (SELECT host, max(k) FROM e GROUP BY 1)"""
query("circuit_breaker", _BREAKER)(lambda t: stateful.circuit_breaker(_calls(t), 4, 1200.0))
query("adaptive_backoff", _PACE)(lambda t: stateful.adaptive_backoff(_calls(t)))

# --- ids, histories, relations
_EXT_OLD = Surrogate("documents", id="doc_id", endpoint="'HTTPS://' || lang", external_id="CASE WHEN doc_id % 3 < 2 THEN source END")
_EXT_CUR = Surrogate("documents", id="doc_id", endpoint="'https://' || lang", external_id="CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN source ELSE 'other' END")
query("external_id_union", f"SELECT coalesce(c.id, o.id) AS id, lower(coalesce(c.endpoint, o.endpoint)) AS endpoint, coalesce(c.external_id, o.external_id) AS external_id, coalesce(c.external_id <> o.external_id, false) AS conflict FROM {_EXT_CUR.sql} c FULL JOIN {_EXT_OLD.sql} o ON c.id = o.id WHERE coalesce(c.external_id, o.external_id) IS NOT NULL")(lambda t: merge.external_id_union(_EXT_CUR.df(t), _EXT_OLD.df(t)))
query("external_id_match", f"SELECT a.id AS source, count(DISTINCT b.id) AS hits, CASE WHEN count(DISTINCT b.id) = 1 THEN min(b.id) END AS id FROM {_EXT_OLD.sql} a JOIN {_EXT_CUR.sql} b ON lower(a.endpoint) = lower(b.endpoint) AND a.external_id || (a.id % 40) = b.external_id || (b.id % 40) GROUP BY 1")(
    lambda t: names.external_id_match(_EXT_OLD.df(t).select(F.col("id").alias("source"), "endpoint", F.concat("external_id", (F.col("id") % 40).cast("string")).alias("external_id")), _EXT_CUR.df(t).withColumn("external_id", F.concat("external_id", (F.col("id") % 40).cast("string"))))
)
query("history_anti_join", "SELECT DISTINCT o_custkey, o_orderdate FROM orders EXCEPT SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE -o_custkey END, o_orderdate FROM orders")(
    lambda t: merge.missing_history(t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey"))), t.orders, ["o_custkey", "o_orderdate"])
)
query("hierarchy_delta", "SELECT n_nationkey AS child, n_regionkey AS parent FROM nation WHERE n_nationkey <> n_regionkey EXCEPT SELECT n_nationkey, n_regionkey + n_nationkey % 2 * 100 FROM nation")(
    lambda t: merge.missing_edges(t.nation.select(F.col("n_nationkey").alias("child"), (F.col("n_regionkey") + F.col("n_nationkey") % 2 * 100).alias("parent")), t.nation.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")))
)
_EV = "(SELECT o_custkey % 300 AS src, o_orderpriority AS e, o_custkey % 7 AS tgt FROM orders)"
query("evidence_intersection", f"SELECT src, tgt FROM (SELECT a.src, a.tgt, count(*) OVER (PARTITION BY a.src) AS n FROM (SELECT src, tgt, count(DISTINCT e) AS k FROM {_EV} x GROUP BY 1, 2) a JOIN (SELECT src, count(DISTINCT e) AS alln FROM {_EV} y GROUP BY 1) b ON a.src = b.src WHERE k = alln) z WHERE n = 1")(
    lambda t: merge.common_evidence(t.orders.selectExpr("o_custkey % 300 AS src", "o_orderpriority AS e", "o_custkey % 7 AS tgt"), "src", "e", "tgt")
)
query("ordered_ci_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY k) AS roles FROM (SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS k, lower(role) FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN upper(role) ELSE role END AS role FROM conversations) c GROUP BY conv_id, lower(role)) x GROUP BY 1")(
    lambda t: t.conversations.withColumn("role", F.when(F.col("turn") % 2 == 1, F.upper("role")).otherwise(F.col("role"))).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m")).select("conv_id", F.array_join(winner.ordered_ci_distinct(F.transform("m", lambda x: x["role"]), F.array(F.lit(" "))), ",").alias("roles"))
)
query("merged_values", """SELECT p_type, string_agg(v, ',' ORDER BY k) AS aliases FROM (SELECT p_type, v, min(k) AS k FROM (SELECT p_type, p_brand AS v, p_partkey * 2 AS k FROM part UNION ALL SELECT p_type, lower(p_type), p_partkey * 2 + 1 FROM part) u GROUP BY 1, 2) x GROUP BY 1""")(
    lambda t: winner.grouped_ci_distinct(t.part, "p_type", ["p_partkey", "p_brand"], F.col("p_brand"), F.lower("p_type"), name="aliases").withColumn("aliases", F.array_join("aliases", ","))
)
query("relation_union", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ',' || p_type END || CASE WHEN p_name IN (p_brand, p_type) THEN '' ELSE ',' || p_name END AS ids FROM part")(lambda t: t.part.select("p_partkey", F.array_join(F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.array("p_brand", "p_name"))), ",").alias("ids")))
query("set_ops", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS both, c_custkey NOT IN (SELECT o_custkey FROM orders) AS only_left FROM customer")(
    lambda t: t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_b", F.lit(True)), "c_custkey", "left").select("c_custkey", F.col("_b").isNotNull().alias("both"), F.col("_b").isNull().alias("only_left"))
)
query("top_k_review", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 250")(lambda t: t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(250))
_NEAR = Surrogate("events", id="event_id", k="event_type", at="CAST(event_id * 7 % 4001 AS DOUBLE) / 10")
query("near_time_join", f"SELECT a.id AS left_id, min(b.id) AS right_id FROM {_NEAR.sql} a JOIN {_NEAR.sql} b ON a.k = b.k AND abs(a.at - b.at) < 0.25 AND a.id <> b.id GROUP BY 1")(lambda t: names.near_in_time(_NEAR.df(t), _NEAR.df(t), "k", "at", 0.25))
_REF = Surrogate("documents", "doc_id % 2 = 0", source="doc_id", folder="CASE WHEN doc_id % 3 = 0 THEN lang || n_chars END", zip="CASE WHEN doc_id % 5 = 0 THEN md5(text) END", title="lang || CAST(floor(n_chars / 4) AS BIGINT)")
_GAL = Surrogate("documents", "doc_id % 2 = 1", id="doc_id", ordinal="doc_id", folder="lang || n_chars", zip="md5(text)", title="lang || CAST(floor(n_chars / 4) AS BIGINT)")


def _stage(key: str) -> str:
    return f"(SELECT a.source, count(DISTINCT b.id) AS n, min(b.id) AS id FROM {_REF.sql} a JOIN {_GAL.sql} b ON a.{key} = b.{key} GROUP BY 1)"


@query("gallery_cascade", f"""SELECT r.source, CASE WHEN z.source IS NOT NULL THEN CASE WHEN z.n = 1 THEN 'zip' ELSE 'ambiguous' END WHEN f.source IS NOT NULL THEN CASE WHEN f.n = 1 THEN 'folder' ELSE 'ambiguous' END WHEN t.source IS NOT NULL THEN CASE WHEN t.n = 1 THEN 'title' ELSE 'ambiguous' END ELSE 'none' END AS stage,
 CASE WHEN z.source IS NOT NULL THEN CASE WHEN z.n = 1 THEN z.id END WHEN f.source IS NOT NULL THEN CASE WHEN f.n = 1 THEN f.id END WHEN t.n = 1 THEN t.id END AS id FROM {_REF.sql} r LEFT JOIN {_stage('zip')} z USING (source) LEFT JOIN {_stage('folder')} f USING (source) LEFT JOIN {_stage('title')} t USING (source)""")
def gallery(t):
    refs, rows = _REF.df(t), _GAL.df(t)
    hits = lambda k: winner.unique_joined(refs, rows, [k], "source", "id").withColumnRenamed("id", "target")
    return names.cascade(refs, ("zip", hits("zip")), ("folder", hits("folder")), ("title", hits("title")))


query("disjunctive_first_match", f"SELECT a.source AS ref, arg_min(b.id, b.ordinal) AS id FROM {_REF.sql} a JOIN {_GAL.sql} b ON a.folder = b.folder OR a.zip = b.zip OR a.title = b.title GROUP BY 1")(lambda t: names.disjunctive_first(_REF.df(t).withColumnRenamed("source", "ref"), _GAL.df(t), ["folder", "zip", "title"]))
query("attachment_canonicalize", "SELECT o_custkey, string_agg(DISTINCT CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 3 ELSE c_custkey END || '', ',' ORDER BY CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 3 ELSE c_custkey END || '') AS ids FROM (SELECT o_orderkey % 500 AS o_custkey, o_custkey AS c_custkey FROM orders) o GROUP BY 1")(
    lambda t: merge.rewrite_keys(t.orders.selectExpr("o_orderkey % 500 AS o_custkey", "o_custkey AS attached"), _MERGES.df(t), "attached").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("attached").cast("string"))), ",").alias("ids"))
)


@query("decision_pipeline", f"""WITH x AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS id, max(value) FILTER (WHERE event_type = 'view') AS score, bool_or(event_id % 97 = 0) AS ex, bool_or(event_id % 89 = 0) AS nh, bool_and(s = 'miss') AS nm FROM (SELECT *, {_OUT} AS s FROM events) e GROUP BY 1)
 , r AS (SELECT id, CASE WHEN ex THEN 'exact' WHEN nh THEN 'near_hash' WHEN score / 3 >= 92.95 THEN 'visual' WHEN score / 3 >= 84.95 THEN 'visual_review' ELSE 'none' END AS route, nm FROM x)
 SELECT id, route, CASE WHEN route IN ('exact','near_hash','visual') THEN 'Imported' WHEN route = 'visual_review' THEN 'Review' WHEN nm THEN 'NoMatch' ELSE 'Unresolved' END AS status FROM r""")
def decide(t):
    e = t.events.withColumn("id", F.expr("CAST(floor(event_id / 4) AS BIGINT)")).withColumn("status", F.expr(_OUT))
    return flow.decision(e.where("event_id % 97 = 0"), e.where("event_id % 89 = 0"), e.where("event_type = 'view'").select("id", (F.col("value") / 3).alias("score")), e.select("id", "status"), e)


