"""Scans, predicates and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.functions import normalize as N
from reconloom.plans.binding import NAMES, Surrogate, q_compact, q_entity, q_key, q_plain, q_strip, q_tag_cleanup, q_tag_key, query
from reconloom.plans.expected import reversed_ratio

query("scan_all", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first_key FROM orders")(lambda t: t.orders.agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first_key")))
query("scan_filtered_limit", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")(lambda t: t.orders.where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey"))
query("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")(lambda t: t.documents.where("doc_id = 42").select("doc_id", "lang", "source", "n_chars"))
query("entity_usage", "SELECT p_partkey AS id, count(l_partkey) AS usage FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")(
    lambda t: t.part.select(F.col("p_partkey").alias("id")).join(t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("usage"))
)

_FORMS = r"CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '{\"post\": ' || props || '}' ELSE '{\"posts\": [' || props || ']}' END"
_SHAPES = Surrogate("events", id="event_id", body=_FORMS.replace("\\", ""))


@query(
    "json_shape_normalize",
    f"""SELECT id, CAST(coalesce(json_extract_string(body, '$[0].k'), json_extract_string(body, '$.post.k'), json_extract_string(body, '$.posts[0].k'), json_extract_string(body, '$.k')) AS BIGINT) AS k FROM {_SHAPES.sql}""",
)
def json_shapes(t):
    get = lambda p: F.get_json_object("body", p)
    return _SHAPES.df(t).select("id", F.coalesce(get("$[0].k"), get("$.post.k"), get("$.posts[0].k"), get("$.k")).cast("long").alias("k"))


_BODIES = Surrogate("events", id="event_id", body="CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'oops <html>' ELSE props END", lenient="event_id % 10 = 1")


@query("safe_json_outcome", f"SELECT id, CASE WHEN trim(body) = '' THEN CASE WHEN lenient THEN 'miss' ELSE 'retryable_error' END WHEN json_valid(body) THEN 'match' ELSE 'retryable_error' END AS outcome FROM {_BODIES.sql}")
def json_outcome(t):
    return _BODIES.df(t).select("id", F.when(F.trim("body") == "", F.when(F.col("lenient"), "miss").otherwise("retryable_error")).when(F.try_parse_json("body").isNotNull(), "match").otherwise("retryable_error").alias("outcome"))


_N = NAMES.sql
for _name, _f, _q in (
    ("key_ci", N.key_ci, q_key), ("norm_tag_key", N.tag_key, q_tag_key), ("norm_entity", N.entity_name, q_entity), ("norm_tag_cleanup", N.tag_cleanup_name, q_tag_cleanup),
    ("norm_name", N.plain_name, q_plain), ("compact_name", lambda c: N.compact(N.plain_name(c)), lambda e: q_compact(q_plain(e))),
):
    query(_name, f"SELECT id, {_q('name')} AS norm FROM {_N} UNION ALL SELECT 'd' || doc_id, {_q('text')} FROM documents")(
        lambda t, f=_f: NAMES.df(t).unionByName(t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(0).cast("long").alias("ordinal"), F.col("text").alias("name"))).select("id", f(F.col("name")).alias("norm"))
    )

_FP = Surrogate("part", id="p_partkey", kind="CASE p_partkey % 6 WHEN 0 THEN 'MD5' WHEN 1 THEN 'OpenSubtitles Hash' WHEN 2 THEN 'perceptual-hash' WHEN 3 THEN ' SHA-256 ' WHEN 4 THEN 'crc 32' ELSE 'oshash' END")
_KIND = "regexp_replace(lower(kind), '[^a-z0-9]+', '', 'g')"
query("fp_type", f"SELECT id, CASE {_KIND} WHEN 'opensubtitles' THEN 'oshash' WHEN 'opensubtitleshash' THEN 'oshash' WHEN 'perceptualhash' THEN 'phash' ELSE {_KIND} END AS fp_type FROM {_FP.sql}")(lambda t: _FP.df(t).select("id", N.fingerprint_type(F.col("kind")).alias("fp_type")))
_FPS = Surrogate("documents", id="doc_id", a="CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(md5(source)) END", b="md5(lang)")
query("fingerprint_project", f"SELECT id, lower(CASE WHEN a <> '' THEN a ELSE b END) AS md5 FROM {_FPS.sql}")(
    lambda t: _FPS.df(t).select("id", F.lower(F.try_element_at(F.filter(F.array(F.struct(F.lit("md5").alias("t"), F.col("a").alias("v")), F.struct(F.lit("phash").alias("t"), F.col("b").alias("v")), F.struct(F.lit("md5").alias("t"), F.col("b").alias("v"))), lambda x: (x["t"] == "md5") & (F.trim(x["v"]) != "")), F.lit(1))["v"]).alias("md5"))
)
_PATHS = Surrogate("pages", id="page_id", path="CASE page_id % 4 WHEN 0 THEN '/a/./b//' || page_id || '/../x.jpg' WHEN 1 THEN '//host/' || page_id WHEN 2 THEN 'rel/../' || page_id ELSE '/lib/book.cbz/p' || page_id || '.JPG' END")
_MADE = "CASE page_id % 4 WHEN 0 THEN '/a/b/x.jpg' WHEN 1 THEN '//host/' || page_id WHEN 2 THEN page_id || '' ELSE '/lib/book.cbz/p' || page_id || '.JPG' END"
query("norm_path", f"SELECT page_id AS id, {_MADE} AS path FROM pages")(lambda t: _PATHS.df(t).select("id", N.posix_path("path").alias("path")))
_EXT = Surrogate("pages", id="page_id", path="CASE page_id % 3 WHEN 0 THEN '/lib/book.cbz/p' || page_id || '.JPG' WHEN 1 THEN url ELSE 'c:/x.zip#in/' || page_id || '.png?v=1' END")
query("url_extensions", f"""SELECT id, coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS extensions FROM (
  SELECT id, unnest(list_concat([regexp_extract(regexp_replace(trim(p), '\\?.*$', ''), '(\\.[a-z0-9]{{1,10}})$', 1) FOR p IN regexp_split_to_array(lower(path), '[#!|/]')],
    [CASE WHEN regexp_matches(lower(path), '\\.' || a || '($|[/\\\\#!|?])') THEN '.' || a ELSE '' END FOR a IN ['cbz','cbr','cb7','cbt','zip','rar','7z']])) AS e FROM {_EXT.sql}) x WHERE e <> '' GROUP BY id""")(lambda t: _EXT.df(t).select("id", F.array_join(N.extensions(F.col("path")), ",").alias("extensions")).where("extensions <> ''"))
_BARE = "regexp_replace(url, '#.*$', '')"
_URLKEY = rf"lower(regexp_extract({_BARE}, '^([^:/?]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(regexp_replace({_BARE}, '^[^:/?]+://[^/?]*', ''), '^([^?]*)', 1), '/+$', '') || regexp_extract({_BARE}, '(\?.*)$', 1)"
query("url_key", f"SELECT page_id, {_URLKEY} AS url_key FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(replace(url, 'http', 'HTTP'), 'example', 'EXAMPLE') ELSE url END AS url FROM pages) p")(
    lambda t: t.pages.select("page_id", F.expr("CASE WHEN page_id % 3 = 0 THEN replace(replace(url, 'http', 'HTTP'), 'example', 'EXAMPLE') ELSE url END").alias("url")).select("page_id", N.url_key(F.col("url")).alias("url_key"))
)
_SCORED = Surrogate("pages", id="page_id", url="url", score="CASE WHEN page_id % 5 = 0 THEN NULL ELSE (page_id % 130) - 10.25D + page_id % 7 * 0.05D END")
_TENTHS = "format('{:.1f}', least(greatest(score, 0.0), 100.0))"


@query("url_fragment_roundtrip", f"""SELECT id, CASE WHEN score IS NULL THEN {_BARE} ELSE {_BARE} || '#confidence=' || {_TENTHS} END AS stored, CASE WHEN score IS NULL THEN NULL ELSE CAST({_TENTHS} AS DOUBLE) END AS score
  FROM {_SCORED.sql.replace('10.25D', '10.25::DOUBLE').replace('0.05D', '0.05::DOUBLE')}""")
def fragment(t):
    made = _SCORED.df(t).withColumn("stored", N.with_confidence(F.col("url"), F.col("score")))
    return made.select("id", "stored", N.confidence_of(F.col("stored")).alias("score"))


#: Routes of the test addresses, as a caller would configure them.
ROUTES = [("blog", r"^https?://blog\.[^/]+/[a-z]{2}/(\d+)"), ("mobile", r"^https?://m\.[^/]+/[a-z]{2}/(\d+)"), ("site", r"^https?://[^/]+/[a-z]{2}/(\d+)")]
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}:' || regexp_extract(url, '{p}', 1)" for n, p in ROUTES) + " END"
query("url_route", f"SELECT page_id, {_ROUTE} AS route FROM pages")(lambda t: t.pages.select("page_id", N.route(F.col("url"), ROUTES).alias("route")))
query("url_supported", f"SELECT page_id, {_ROUTE} IS NOT NULL AS supported, {_ROUTE} IS NOT NULL OR contains(url, '#') AS candidate FROM pages")(
    lambda t: t.pages.select("page_id", N.route(F.col("url"), ROUTES).isNotNull().alias("supported"), (N.route(F.col("url"), ROUTES).isNotNull() | F.contains("url", F.lit("#"))).alias("candidate"))
)
query("candidate_url", f"SELECT page_id, CASE WHEN contains(url, 'utm') THEN NULL ELSE {_BARE} END AS direct, coalesce(CASE WHEN contains(url, 'utm') THEN NULL ELSE {_BARE} END, 'https://example.invalid/' || page_id) AS candidate FROM pages")(
    lambda t: t.pages.withColumn("direct", F.when(~F.contains("url", F.lit("utm")), F.regexp_replace("url", "#.*$", ""))).select("page_id", "direct", F.coalesce("direct", F.concat(F.lit("https://example.invalid/"), "page_id")).alias("candidate"))
)
query("confidence_band", "SELECT event_id, CASE WHEN s >= 92.95 THEN 'HIGH' WHEN s >= 84.95 THEN 'REVIEW' ELSE 'LOW' END AS band FROM (SELECT event_id, least(value, 100.0) AS s FROM events) e")(lambda t: t.events.select("event_id", N.band(F.least("value", F.lit(100.0))).alias("band")))
query("inconclusive_flag", "SELECT user_id, max(value) >= 85 AND coalesce(max(CASE WHEN event_type = 'view' THEN value END), 0) < 85 AS inconclusive FROM events GROUP BY user_id")(
    lambda t: t.events.groupBy("user_id").agg(F.max("value").alias("best"), F.coalesce(F.max(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0)).alias("own")).select("user_id", ((F.col("best") >= 85) & (F.col("own") < 85)).alias("inconclusive"))
)
_DATES = Surrogate("orders", id="o_orderkey", d="CASE o_orderkey % 6 WHEN 0 THEN '' || (946684800 + o_orderkey % 15000 * 86400) WHEN 1 THEN '' || ((946684800 + o_orderkey % 15000 * 86400) * CAST(1000 AS BIGINT)) WHEN 2 THEN '2019-03-0' || (1 + o_orderkey % 9) || 'T10:00:00Z' WHEN 3 THEN '2020-11-05 10:11:12 +0200' WHEN 4 THEN 'Tue Mar 05 10:11:12 +0000 2013' ELSE 'unknown' END")
query("date_normalize", f"""SELECT id, CASE WHEN regexp_full_match(d, '\\d{{9,13}}') THEN strftime(make_timestamp((CASE WHEN CAST(d AS BIGINT) > 10000000000 THEN CAST(d AS BIGINT) // 1000 ELSE CAST(d AS BIGINT) END) * 1000000), '%Y-%m-%d')
  WHEN regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(d, 1, 10) WHEN d LIKE 'Tue Mar%' THEN '2013-03-05' END AS day FROM {_DATES.sql}""")(lambda t: _DATES.df(t).select("id", N.source_date(F.col("d")).alias("day")))
_TRY = Surrogate("part", id="p_partkey", v="CASE p_partkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '3.9' WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN 'Yes' ELSE '1' END")
query("try_coerce", f"SELECT id, CAST(trunc(TRY_CAST(v AS DOUBLE)) AS BIGINT) AS i, TRY_CAST(v AS DOUBLE) AS f, lower(trim(v)) IN ('1','true','yes','on') AS b FROM {_TRY.sql}")(lambda t: _TRY.df(t).select("id", N.to_int(F.col("v")).alias("i"), F.col("v").try_cast("double").alias("f"), N.to_bool(F.col("v")).alias("b")))
_FILL = Surrogate("part", id="p_partkey", cur="CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE p_name END", old="p_brand", n="p_partkey % 4", m="p_size", b="p_partkey % 2 = 0", ob="p_partkey % 3 = 0")
query("scalar_fill", f"SELECT id, CASE WHEN cur IS NULL OR cur = '' THEN old ELSE cur END AS s, CAST(CASE WHEN n IS NULL OR n = 0 THEN m ELSE n END AS BIGINT) AS i, CASE WHEN b THEN b ELSE ob END AS f FROM {_FILL.sql}")(
    lambda t: _FILL.df(t).select("id", N.scalar_fill(F.col("cur"), F.col("old")).alias("s"), N.scalar_fill(F.col("n"), F.col("m"), "int").cast("long").alias("i"), N.scalar_fill(F.col("b"), F.col("ob"), "boolean").alias("f"))
)
query("canonical_json", """SELECT event_id, '{"a":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '"}' AS canonical FROM events""")(
    lambda t: t.events.select("event_id", N.canonical_map(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("a"), F.col("event_type")))).alias("canonical"))
)
query("sorted_ids", "SELECT o_custkey, string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS ids FROM orders GROUP BY o_custkey")(lambda t: t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))), ",").alias("ids")))
query("rich_signature", "SELECT p_partkey AS id, sha256(concat_ws('|', p_brand, p_type, CAST(p_size AS VARCHAR))) AS signature, p_size > 25 AS rich FROM part")(lambda t: t.part.select(F.col("p_partkey").alias("id"), F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")), 256).alias("signature"), (F.col("p_size") > 25).alias("rich")))
_ART = Surrogate("part", id="p_partkey", v="CASE p_partkey % 6 WHEN 0 THEN '/9j/4AAQSkZJRg' || p_partkey WHEN 1 THEN 'iVBORw0KGgoAAAAN' WHEN 2 THEN 'R0lGODlhAQABAIAA' WHEN 3 THEN 'https://example.org/a.png' WHEN 4 THEN 'PHN2ZyB4bWxucz0i' ELSE 'aGVsbG8gd29ybGQh' END")
query("mime_sniff", f"SELECT id, CASE WHEN v LIKE 'https://%' THEN v WHEN v LIKE '/9j/%' THEN 'data:image/jpeg;base64,' || v WHEN v LIKE 'iVBORw0KGgo%' THEN 'data:image/png;base64,' || v WHEN v LIKE 'R0lGODlh%' THEN 'data:image/gif;base64,' || v WHEN v LIKE 'PHN2Z%' THEN 'data:image/svg+xml;base64,' || v END AS uri FROM {_ART.sql}")(lambda t: _ART.df(t).select("id", N.data_uri(F.col("v")).alias("uri")))
_REL = Surrogate("documents", id="doc_id", folder="CASE WHEN doc_id % 3 = 0 THEN '/g/' || source END", zips="CASE WHEN doc_id % 2 = 0 THEN 'b.zip,a.zip' END", title="lang")
query("relation_key", f"SELECT id, coalesce('folder:' || folder, CASE WHEN zips IS NOT NULL THEN 'zip:a.zip|b.zip' END, 'title:' || title) AS k FROM {_REL.sql}")(
    lambda t: _REL.df(t).select("id", F.coalesce(F.concat(F.lit("folder:"), "folder"), F.concat(F.lit("zip:"), F.array_join(F.array_sort(F.split("zips", ",")), "|")), F.concat(F.lit("title:"), "title")).alias("k"))
)
query("backoff_schedule", "SELECT event_id, least(20.0, 0.75 * pow(2.0, event_id % 8)) AS wait FROM events")(lambda t: t.events.select("event_id", N.backoff(F.col("event_id") % 8).alias("wait")))
_CODE = Surrogate("events", id="event_id", code="CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 401 ELSE 524 END")
query("classify_outcome", f"SELECT id, CASE WHEN code BETWEEN 200 AND 299 THEN 'match' WHEN code = 404 THEN 'miss' WHEN code IN (408,425,429,500,502,503,504,520,521,522,523,524) THEN 'retryable_error' ELSE 'unavailable' END AS outcome FROM {_CODE.sql}")(lambda t: _CODE.df(t).select("id", N.outcome_class(F.col("code")).alias("outcome")))
query("effective_rate", "SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 AND p_partkey % 7 > 0 THEN least(p_size % 5, p_partkey % 7) WHEN p_size % 5 > 0 THEN p_size % 5 WHEN p_partkey % 7 > 0 THEN p_partkey % 7 END AS rate FROM part")(lambda t: t.part.select(F.col("p_partkey").alias("id"), N.effective_rate((F.col("p_size") % 5).cast("long"), F.col("p_partkey") % 7).alias("rate")))
_BITS = Surrogate("documents", id="doc_id", h="substr(md5(source), 1, 16)", g="substr(md5(lang), 1, 16)")
query("hamming_distance", f"SELECT id, CAST(bit_count(xor(CAST(('0x' || h) AS UBIGINT), CAST(('0x' || g) AS UBIGINT))) AS BIGINT) AS distance FROM {_BITS.sql}")(lambda t: _BITS.df(t).select("id", N.hamming(N.hash_bits(F.col("h")), N.hash_bits(F.col("g"))).cast("long").alias("distance")))
query("token_subset_veto", f"""SELECT a, b, len([e FOR e IN x IF NOT list_contains(y, e)]) = 0 AND len([e FOR e IN y IF NOT list_contains(x, e)]) > 0 OR len([e FOR e IN x IF NOT list_contains(y, e)]) > 0 AND len([e FOR e IN y IF NOT list_contains(x, e)]) = 0 AS veto
  FROM (SELECT p_name AS a, c AS b, string_split(p_name, ' ') AS x, string_split(c, ' ') AS y FROM (SELECT DISTINCT p_name FROM part) p, (VALUES ('red'), ('red ring'), ('old red ring')) v(c)) z""")(
    lambda t: t.part.select(F.col("p_name").alias("a")).distinct().withColumn("b", F.explode(F.array(F.lit("red"), F.lit("red ring"), F.lit("old red ring")))).select("a", "b", N.token_subset(F.col("a"), F.col("b")).alias("veto"))
)
_TOK = Surrogate("documents", id="doc_id", tags="lang || ' ' || source || ' ' || upper(lang) || ' Meta_x ' || source || '_b'", artist="source")
query("token_project", f"SELECT id, lang_ || ',' || src || ',Meta_x,' || src || '_b' AS tokens FROM (SELECT doc_id AS id, lang AS lang_, source AS src FROM documents) d")(
    lambda t: _TOK.df(t).select("id", F.array_join(_distinct(F.split("tags", " ")), ",").alias("tokens"))
)
query("typed_token_filter", "SELECT doc_id, source AS artist FROM documents WHERE CAST(substr(source, 4) AS BIGINT) % 4 = 1")(
    lambda t: t.documents.select("doc_id", F.explode(F.array("lang", "source")).alias("artist")).join(t.documents.select(F.col("source").alias("artist")).distinct().withColumn("kind", F.substring("artist", 4, 18).try_cast("bigint") % 4), "artist").where("kind = 1").select("doc_id", "artist")
)
query("role_mapping", "SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang END AS studio, CASE WHEN lang = 'en' THEN lang || ',x' ELSE source || ',' || lang || ',x' END AS tags FROM documents WHERE lang IN ('en')  UNION ALL SELECT doc_id, source, lang || ',x' FROM documents WHERE lang <> 'en'")(
    lambda t: t.documents.withColumn("artists", F.filter(F.array(F.lit("conditional_dnp"), F.col("source")), lambda a: ~a.isin("conditional_dnp", "third-party_edit"))).select("doc_id", F.try_element_at("artists", F.lit(1)).alias("studio"), F.array_join(F.concat(F.array_except(F.array("lang", "source", F.lit("x")), "artists"), F.slice("artists", 2, 9)), ",").alias("tags"))
)


def _distinct(c):
    from reconloom.operators.winner import ordered_ci_distinct

    return ordered_ci_distinct(c)


@query("sequence_ratio", reversed_ratio)
def ratio(t):
    from reconloom.operators.segments import sequence_ratio

    return t.part.select(F.col("p_partkey").alias("id"), F.round(sequence_ratio("p_name", F.reverse("p_name")), 9).alias("ratio"))


query("limit_eligible", f"SELECT id, {q_strip('name')} AS name FROM {_N} WHERE ordinal % 3 = 0 ORDER BY ordinal LIMIT 40")(lambda t: _eligible(NAMES.df(t)))


def _eligible(df):
    from reconloom.plans.flow import eligible

    return eligible(df, F.col("ordinal") % 3 == 0, [F.col("ordinal")], 0, 40, 90).select("id", N.strip(F.col("name")).alias("name"))
