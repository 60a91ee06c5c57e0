"""Resolvers with more evidence than names, and small rules beside them, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.functions import normalize as N
from reconloom.operators import fuzzy, resolve, roles
from reconloom.plans import expected as E
from reconloom.plans import flow
from reconloom.plans.binding import Surrogate, q_compact, q_plain, query
from reconloom.plans.match_queries import _TAG, _plain, _typos


def _tag_rule() -> str:
    return f"""{E.decided(*_TAG)}, b AS ({E.blocked()}), kx AS (SELECT *, {q_plain('name')} AS key, 'x' || CAST(floor(ordinal / 2) AS BIGINT) AS ext FROM ent),
 pr AS (SELECT i.name, count(DISTINCT e.id) AS n, min(e.id) AS id FROM inc i JOIN kx e ON {q_plain('i.name')} = e.key GROUP BY 1),
 xt AS (SELECT i.name, count(DISTINCT e.id) AS n, min(e.id) AS id, min(e.key) AS key FROM inc i JOIN kx e ON 'x' || (length(i.name) * 2 + length(i.name) % 2) = e.ext GROUP BY 1),
 z AS (SELECT i.name, CASE WHEN pr.n = 1 THEN 'primary' WHEN pr.n > 1 THEN CASE WHEN xt.n = 1 AND xt.key = {q_plain('i.name')} THEN 'external' ELSE 'ambiguous' END WHEN xt.n = 1 THEN 'external' WHEN xt.n > 1 THEN 'ambiguous' WHEN d.decision <> 'none' THEN d.decision
 WHEN b.name IS NOT NULL THEN 'blocked' ELSE 'create' END AS decision, pr.id AS pid, xt.id AS xid, xt.n AS xn, d.id AS did FROM inc i LEFT JOIN pr USING (name) LEFT JOIN xt USING (name) LEFT JOIN d USING (name) LEFT JOIN b USING (name))
 SELECT name, decision, CASE decision WHEN 'primary' THEN pid WHEN 'external' THEN xid WHEN 'ambiguous' THEN NULL WHEN 'blocked' THEN NULL WHEN 'create' THEN NULL ELSE did END AS id, coalesce(decision = 'primary' AND xn = 1 AND xid <> pid, false) AS identity_conflict FROM z"""


@query("tag_resolution", _tag_rule)
def tag_resolution(t):
    old = _typos(t).select("name", F.lit("https://a").alias("endpoint"), F.concat(F.lit("x"), F.length("name") * 2 + F.length("name") % 2).alias("external_id"))
    current = _plain(t).select("id", F.lit("HTTPS://A").alias("endpoint"), F.concat(F.lit("x"), F.floor(F.col("ordinal") / 2)).alias("external_id"))
    return resolve.resolve_tags(_typos(t), _plain(t), old, current)


_PERFORMER = ("plain", "compact", 0.98, 0.03, 4, True, False, False, "ambiguous")
_D = "CASE WHEN {0} % 3 = 0 THEN '' ELSE 'D' || ({0} % 3) END"


@query("performer_resolution", lambda: f"""{E.decided(*_PERFORMER)}, z AS (SELECT d.name, d.id, CASE WHEN length(d.name) % 11 = 0 THEN 'ambiguous' WHEN e.id IS NOT NULL AND length(d.name) % 3 > 0 AND e.ordinal % 3 > 0 AND length(d.name) % 3 <> e.ordinal % 3 THEN 'conflict'
 WHEN decision = 'none' THEN 'create' ELSE decision END AS decision FROM d LEFT JOIN ent e ON d.id = e.id) SELECT name, decision, CASE WHEN decision IN ('exact', 'compact', 'fuzzy') THEN id END AS id FROM z""")
def performer_resolution(t):
    old = _typos(t).select("name", F.expr(_D.format("length(name)")).alias("disambiguation"))
    old = old.unionByName(old.where(F.length("name") % 11 == 0).select("name", F.lit("someone else").alias("disambiguation")))
    return resolve.resolve_performers(old, _plain(t).withColumn("disambiguation", F.expr(f"lower({_D.format('ordinal')})")))


_GROUPS = "(SELECT min(p_partkey) || '' AS id, p_name AS name, replace(p_name, ' ', '--') || '; ' || p_name || ' saga, ' || min(p_brand) || chr(10) || p_name || ' II' AS aliases FROM part GROUP BY p_name)"
_ASKED = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '') || ' Saga' WHEN 2 THEN p_brand WHEN 3 THEN 'unknown ' || p_name ELSE p_name || ' ii' END"


@query("group_resolution", f"""WITH g AS (SELECT * FROM {_GROUPS} q), inc AS (SELECT DISTINCT {_ASKED} AS name FROM part), v AS (SELECT id, name AS s FROM g UNION SELECT id, aliases FROM g UNION SELECT id, unnest(string_split(aliases, ';')) FROM g UNION SELECT id, unnest(string_split(aliases, chr(10))) FROM g UNION SELECT id, unnest(string_split(aliases, ',')) FROM g),
 h AS (SELECT i.name, count(DISTINCT v.id) AS n, min(v.id) AS id FROM inc i JOIN v ON {q_plain('i.name')} = {q_plain('v.s')} OR (length({q_compact(q_plain('i.name'))}) >= 4 AND {q_compact(q_plain('i.name'))} = {q_compact(q_plain('v.s'))}) GROUP BY 1)
 SELECT inc.name, CASE WHEN n = 1 THEN 'reuse' WHEN n > 1 THEN 'ambiguous' ELSE 'create' END AS decision, CASE WHEN n = 1 THEN h.id END AS id FROM inc LEFT JOIN h ON inc.name = h.name""")
def group_resolution(t):
    aliases = F.concat(F.replace("p_name", F.lit(" "), F.lit("--")), F.lit("; "), F.col("p_name"), F.lit(" saga, "), F.min("p_brand"), F.lit("\n"), F.col("p_name"), F.lit(" II"))
    groups = t.part.groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("id"), aliases.alias("aliases")).withColumnRenamed("p_name", "name")
    return resolve.resolve_groups(t.part.select(F.expr(_ASKED).alias("name")), groups)


_STUDIO = ("entity", "entity", 0.96, 0.03, 3, False, False, False, "none")


@query("alias_append", lambda: f"""{E.decided(*_STUDIO)}, dm AS MATERIALIZED (SELECT name, id FROM d), n AS (SELECT d.id, min(d.name) AS name, lower(trim(d.name)) AS k FROM dm d JOIN ent e ON d.id = e.id WHERE lower(trim(d.name)) NOT IN (lower(e.name), lower(replace(e.name, ' ', ''))) GROUP BY d.id, lower(trim(d.name)))
 SELECT e.id, (CASE WHEN replace(e.name, ' ', '') = e.name THEN '' ELSE replace(e.name, ' ', '') || ',' END) || x.names AS aliases FROM ent e JOIN (SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY 1) x ON e.id = x.id""")
def alias_append(t):
    found = fuzzy.resolve(_typos(t), _plain(t), fuzzy.IMPORT_STUDIO)
    return resolve.appended_aliases(_plain(t), found).select("id", F.array_join("aliases", ",").alias("aliases"))


@query("created_rows", lambda: f"{E.decided(*_PERFORMER)} SELECT min(name) AS name, arg_min(length(name), name) AS size FROM d WHERE decision = 'none' GROUP BY {q_plain('name')}")
def created_rows(t):
    found = fuzzy.resolve(_typos(t), _plain(t), fuzzy.MIGRATE_PERFORMER).withColumn("decision", F.when(F.col("decision") == "none", "create").otherwise(F.col("decision")))
    return resolve.created(_typos(t).withColumn("size", F.length("name").cast("long")), found, ["size"])


_ASK = "SELECT DISTINCT lower(lang) AS source, lower(source) AS name FROM documents WHERE trim(source) <> '' AND lang IS NOT NULL"
_KNOWN = "SELECT DISTINCT lower(lang), lower(source) FROM documents WHERE n_chars > 20000"
query("lookup_batches", f"SELECT source, name, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY name) - 1) / 2) AS BIGINT) AS batch FROM ({_ASK} EXCEPT {_KNOWN}) x")(
    lambda t: resolve.lookup_batches(t.documents.select(F.upper("lang").alias("source"), F.col("source").alias("name")).where("source is not null and name is not null"), t.documents.where("n_chars > 20000").select(F.col("lang").alias("source"), F.col("source").alias("name")), 2)
)
_IMAGES = Surrogate("pages", id="page_id", path="CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN url || '?Default=TRUE' ELSE url END")
query("custom_image", f"SELECT id, coalesce(trim(path) <> '' AND strpos(lower(path), 'default=true') = 0, false) AS custom FROM {_IMAGES.sql}")(lambda t: _IMAGES.df(t).select("id", N.custom_image(F.col("path")).alias("custom")))
query("source_allowed", "SELECT doc_id, coalesce(source IN ('src1', 'src3'), false) AS allowed FROM documents")(lambda t: t.documents.select("doc_id", N.allowed_source(F.col("source"), ("src1", "src3")).alias("allowed")))
_DATES = Surrogate("events", id="event_id", body="""CASE event_id % 6 WHEN 0 THEN '{"date": "", "timestamp": 0, "s": 1700000000, "iso": "2020-01-02"}' WHEN 1 THEN '{"iso": "20240229"}' WHEN 2 THEN '{"date": "2024-05-06T07:08:09Z"}' WHEN 3 THEN '{"other": 1}' WHEN 4 THEN '20231231T235959' ELSE '2021-03-04 05:06:07 +0200' END""")
query("date_object", f"SELECT id, CASE id % 6 WHEN 0 THEN '2023-11-14' WHEN 1 THEN '2024-02-29' WHEN 2 THEN '2024-05-06' WHEN 4 THEN '2023-12-31' WHEN 5 THEN '2021-03-04' END AS day FROM {_DATES.sql}")(lambda t: _DATES.df(t).select("id", N.source_date(N.date_text(F.col("body"))).alias("day")))
_CAUSES = Surrogate("events", id="event_id", kind="CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'http' WHEN 2 THEN 'network' WHEN 3 THEN 'foreign_key' ELSE 'other' END", code="CASE WHEN event_id % 2 = 0 THEN 503 ELSE 401 END")
query("retryable_cause", f"SELECT id, CASE kind WHEN 'open' THEN true WHEN 'network' THEN true WHEN 'http' THEN code = 503 WHEN 'other' THEN code = 503 ELSE false END AS retry FROM {_CAUSES.sql}")(
    lambda t: _CAUSES.df(t).select("id", N.retryable(F.array(F.struct(F.col("kind"), F.col("code")), F.struct(F.when(F.col("kind") == "other", "http").otherwise("other").alias("kind"), F.col("code")))).alias("retry"))
)
_ROLES = Surrogate("documents", id="doc_id", lang="coalesce(lang, 'xx')", source="coalesce(source, 'none')", flat="doc_id % 2 = 0")
query("role_rules", f"""SELECT id, source AS studio, 'Z ' || lang AS performers, CASE WHEN flat THEN lang || ',' || lang || ' x' ELSE lang || ',' || source || ',' || lang || '_x,conditional_dnp,z_' || lang || ',' || lang || ' x' END AS tags,
  CASE WHEN flat THEN lang || ',' || source || ',' || lang || '_x' ELSE lang || ',' || source || ',' || lang || '_x,conditional_dnp' END || ',z_' || lang || ',' || lang || ' x,Z ' || lang AS tags_only FROM {_ROLES.sql}""")(lambda t: _roles(_ROLES.df(t)))


def _roles(df):
    names = F.array("lang", "source", F.concat("lang", F.lit("_x")), F.lit("conditional_dnp"), F.concat(F.lit("z_"), "lang"))
    posts = df.select("id", "flat", names.alias("n"), F.array(F.lit("Conditional_DNP"), F.col("source"), F.concat("lang", F.lit(" x"))).alias("a"), F.array(F.concat(F.lit("Z "), "lang")).alias("c"))
    made = posts.select("id", roles.mapped(F.col("n"), F.col("a"), F.col("c"), F.col("flat")).alias("r"), roles.mapped(F.col("n"), F.col("a"), F.col("c"), F.col("flat"), "tags", "tags").alias("t"))
    return made.select("id", "r.studio", F.array_join("r.performers", ",").alias("performers"), F.array_join("r.tags", ",").alias("tags"), F.array_join("t.tags", ",").alias("tags_only"))


query("other_tags", "SELECT doc_id, coalesce(lang, 'review ') || ',x' AS tags, CASE WHEN doc_id % 2 = 0 THEN 'imported' ELSE 'nomatch' END AS status FROM documents")(
    lambda t: t.documents.select("doc_id", F.array(F.coalesce("lang", F.lit("review ")), F.when(F.col("doc_id") % 2 == 0, "IMPORTED").otherwise("NoMatch"), F.lit("x")).alias("tags")).select("doc_id", F.array_join(flow.other_tags(F.col("tags")), ",").alias("tags"), F.array_join(flow.status_names(F.col("tags")), ",").alias("status"))
)
query("backoff_jitter", "SELECT event_id, greatest(event_id % 30, least(20.0, 0.75 * pow(2.0, event_id % 8)) + event_id % 5 / 4.0 * greatest(0.05, least(20.0, 0.75 * pow(2.0, event_id % 8)) * 0.25)) AS wait FROM events")(
    lambda t: t.events.select("event_id", N.backoff(F.col("event_id") % 8, jitter=F.col("event_id") % 5 / 4.0, retry_after=(F.col("event_id") % 30).cast("double")).alias("wait"))
)
_CHILDREN = {"orders": "o_custkey", "events": "user_id", "lineitem": "l_suppkey", "conversations": "conv_id", "pages": "page_id", "labels": "doc_id", "supplier": "s_suppkey"}
query("usage_all_children", f"SELECT c_custkey AS id, CAST(coalesce(n, 0) AS BIGINT) AS usage FROM customer LEFT JOIN (SELECT k, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT {c} AS k FROM {t}' for t, c in _CHILDREN.items())}) u GROUP BY 1) z ON c_custkey = k")(
    lambda t: resolve.usage_counts(t.customer.select(F.col("c_custkey").alias("id")), *[(getattr(t, n), c) for n, c in _CHILDREN.items()])
)
_BAD = Surrogate("events", id="event_id", a="'' || event_id % 50", b="CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN '' WHEN 3 THEN '2.5' ELSE '7' END", c="event_id % 3")
query("usage_bad_values", f"SELECT id, CAST(CAST(a AS BIGINT) + CASE WHEN b = '7' THEN 7 ELSE 0 END + c AS BIGINT) AS usage FROM {_BAD.sql}")(lambda t: _BAD.df(t).select("id", N.usage_sum(F.col("a"), F.col("b"), F.col("c")).alias("usage")))
_META = Surrogate("part", id="p_partkey", a="CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END", b="CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_brand END", n="p_size % 4", f="p_size % 2 = 0")
_FIELDS = "[coalesce(a, ''), coalesce(b, ''), CASE WHEN n = 0 THEN '' ELSE '' || n END, CASE WHEN f THEN 'true' ELSE '' END]"
query("metadata_signature", f"SELECT id, sha256(CAST(to_json({_FIELDS}) AS VARCHAR)) AS signature, len(list_filter({_FIELDS}, lambda x: x <> '')) > 0 AS rich FROM {_META.sql}")(
    lambda t: _META.df(t).withColumn("m", N.metadata_fields((F.col("a"), "string"), (F.col("b"), "string"), (F.col("n"), "int"), (F.col("f"), "boolean"))).select("id", N.signature(F.col("m")).alias("signature"), N.nontrivial(F.col("m")).alias("rich"))
)
_GREF = Surrogate("documents", id="doc_id", folder="CASE doc_id % 4 WHEN 0 THEN ' /g//' || source || '/./x/' WHEN 1 THEN '  ' END", z="CASE WHEN doc_id % 3 = 0 THEN 'b//' || lang || '.zip' END", title="CASE WHEN doc_id % 5 > 0 THEN 'The_' || source || ' - ' || upper(lang) ELSE ' ' END")
query("gallery_key", f"SELECT id, CASE WHEN trim(folder) <> '' THEN 'folder:/g/' || source || '/x' WHEN z IS NOT NULL THEN 'zip:' || least('a/x.zip', 'b/' || lang || '.zip') || '|' || greatest('a/x.zip', 'b/' || lang || '.zip') WHEN trim(title) <> '' THEN 'title:' || {q_plain('title')} ELSE '' END AS key FROM {_GREF.sql} JOIN documents d ON d.doc_id = id")(
    lambda t: _GREF.df(t).select("id", N.relation_key(F.col("folder"), F.when(F.col("z").isNotNull(), F.array("z", F.lit("a/y/../x.zip"), F.lit(" "), F.lit(None))), F.col("title")).alias("key"))
)
_ASKED_MD5, _ANSWERED = Surrogate("documents", id="doc_id", md5="upper(md5('' || doc_id))"), Surrogate("documents", md5="md5('' || doc_id)", post_id="doc_id * 10", post_md5="CASE doc_id % 5 WHEN 0 THEN md5('other') WHEN 1 THEN NULL WHEN 2 THEN upper(md5('' || doc_id)) ELSE md5('' || doc_id) END")
query("provider_validated_lookup", "SELECT doc_id AS id, CASE WHEN doc_id % 5 < 2 THEN 'miss' ELSE 'match' END AS status, CASE WHEN doc_id % 5 >= 2 THEN doc_id * 10 END AS post_id FROM documents")(lambda t: resolve.validated_answers(_ASKED_MD5.df(t), _ANSWERED.df(t)))
