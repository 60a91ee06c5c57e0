"""Joins, winner rules and clustering over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.functions import normalize as N
from reconloom.operators import cleanup, fuzzy, hamming, media, names, winner
from reconloom.plans import expected as E
from reconloom.plans.binding import BRANDED, NAMES, Surrogate, q_compact, q_key, q_plain, q_tag_key, query

# --- media cascade: even documents are the old export, odd ones the current library
_OLD = "doc_id % 2 = 0"
_ID, _HALF = "doc_id || ''", "CAST(floor(doc_id / 2) AS BIGINT)"
_PATH = f"CASE WHEN {_HALF} % 3 = 0 THEN 'p/' || {_HALF} ELSE 'q/' || doc_id END"
_MEDIA = {"id": _ID, "path": _PATH, "size": "n_chars", "md5": "md5(text)", "oshash": "md5(lang || n_chars)", "phash": "lang || CAST(floor(n_chars / 100) AS BIGINT)", "weak": f"doc_id % 2 = 0 AND {_HALF} % 5 = 0"}
_SIDE = {k: Surrogate("documents", w, **_MEDIA) for k, w in (("old", _OLD), ("cur", "doc_id % 2 = 1"))}


def _fingerprints(t, side):
    rows = _SIDE[side].df(t)
    pairs = [F.struct(F.lit(k).alias("t"), (F.when(~F.col("weak"), F.col(k)) if k != "phash" else F.col(k)).alias("v")) for k in ("md5", "oshash", "phash")]
    return rows.select("id", "path", "size", F.explode(F.array(*pairs)).alias("f")).select("id", "path", "size", F.col("f.t").alias("fp_type"), F.col("f.v").alias("fp_value")).where("fp_value is not null")


_CTE = f"""WITH o AS (SELECT * FROM {_SIDE['old'].sql} x), c AS (SELECT * FROM {_SIDE['cur'].sql} y),
 cf AS (SELECT id, 'md5' AS t, md5 AS v FROM c UNION ALL SELECT id, 'oshash', oshash FROM c),
 ev AS (SELECT id, 'md5' AS t, md5 AS v FROM o WHERE NOT weak UNION ALL SELECT id, 'oshash', oshash FROM o WHERE NOT weak),
 h0 AS (SELECT DISTINCT ev.id AS old_id, ev.t AS e, cf.id AS cid FROM ev JOIN cf ON ev.t = cf.t AND ev.v = cf.v),
 h1 AS (SELECT DISTINCT o.id AS old_id, 'path' AS e, c.id AS cid FROM o JOIN c ON o.path = c.path),
 h2 AS (SELECT DISTINCT o.id AS old_id, 'ph' AS e, c.id AS cid FROM o JOIN c ON lower(o.phash) = lower(c.phash) AND o.size = c.size WHERE o.weak AND o.size > 0 AND o.phash <> '')"""


def _div(h: str, kind: str) -> str:
    return f"""SELECT old_id, CASE WHEN full_n = 1 THEN one WHEN n = 1 THEN any_id END AS current_id, CASE WHEN full_n = 1 OR n = 1 THEN '{kind}' ELSE 'ambiguous' END AS kind, n AS candidates FROM (
 SELECT old_id, count(*) AS n, count(*) FILTER (WHERE k = alln) AS full_n, min(cid) FILTER (WHERE k = alln) AS one, min(cid) AS any_id FROM (
 SELECT a.old_id, a.cid, count(*) AS k, max(b.alln) AS alln FROM {h} a JOIN (SELECT old_id, count(DISTINCT e) AS alln FROM {h} GROUP BY 1) b ON a.old_id = b.old_id GROUP BY 1, 2) z GROUP BY 1) w"""


query("media_match_strong", f"{_CTE} {_div('h0', 'fingerprint')}")(lambda t: media.divided(media.strong_hits(_fingerprints(t, "old"), _fingerprints(t, "cur")), "fingerprint"))
query("media_match_path", f"{_CTE} {_div('h1', 'exact-path')}")(lambda t: media.divided(media.path_hits(_fingerprints(t, "old"), _fingerprints(t, "cur")), "exact-path"))
query("media_match_phash_size", f"{_CTE} {_div('h2', 'strict-phash')}")(lambda t: media.divided(media.phash_size_hits(_fingerprints(t, "old"), _fingerprints(t, "cur")), "strict-phash"))
_CASCADE = f"""{_CTE}, s0 AS ({_div('h0', 'fingerprint')}), s1 AS ({_div('h1', 'exact-path')}), s2 AS ({_div('h2', 'strict-phash')}),
 casc AS (SELECT o.id AS old_id, CASE WHEN s0.old_id IS NOT NULL THEN s0.current_id WHEN s1.old_id IS NOT NULL THEN s1.current_id ELSE s2.current_id END AS current_id,
 coalesce(s0.kind, s1.kind, s2.kind, 'unmatched') AS kind FROM o LEFT JOIN s0 ON o.id = s0.old_id LEFT JOIN s1 ON o.id = s1.old_id LEFT JOIN s2 ON o.id = s2.old_id)"""
query("media_match_cascade", f"{_CASCADE} SELECT * FROM casc")(lambda t: cascade_of(t))


def cascade_of(t):
    return media.match_cascade(_fingerprints(t, "old"), _fingerprints(t, "cur"))


query("preflight_gate", f"{_CASCADE} SELECT count(*) AS records, count(*) FILTER (WHERE kind NOT IN ('ambiguous','unmatched')) AS matched, round(count(*) FILTER (WHERE kind NOT IN ('ambiguous','unmatched')) / count(*), 6) AS rate, count(*) >= 100 AND count(*) FILTER (WHERE kind NOT IN ('ambiguous','unmatched')) / count(*) < 0.7 AS abort FROM casc")(lambda t: _flow().preflight(cascade_of(t)))
query("target_collisions", f"{_CASCADE} SELECT old_id, current_id, row_number() OVER (PARTITION BY current_id ORDER BY CAST(old_id AS BIGINT)) > 1 AS collides FROM casc WHERE current_id IS NOT NULL")(
    lambda t: winner.one_source_per_target(cascade_of(t).where("current_id is not null").withColumn("ordinal", F.col("old_id").cast("long")), "current_id", "ordinal").select("old_id", "current_id", "collides")
)


def _flow():
    from reconloom.plans import flow

    return flow


# --- names
_KEYED = "SELECT id, ordinal, name FROM " + NAMES.sql
_IN = Surrogate("part", name="CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '--') ELSE 'no such ' || p_name END")


def _entities(t):
    """One entity for each different name form, the first part that has it."""
    base = NAMES.df(t).groupBy("name").agg(F.min_by("id", "ordinal").alias("id"), F.min("ordinal").alias("ordinal"))
    return base.withColumn("aliases", F.array().cast("array<string>"))


_ENT = f"(SELECT name, arg_min(id, ordinal) AS id, min(ordinal) AS ordinal FROM {NAMES.sql} n GROUP BY name)"
query("name_lookup", f"SELECT i.name, e.id FROM (SELECT DISTINCT name FROM {_IN.sql} a) i LEFT JOIN (SELECT {q_key('name')} AS k, arg_min(id, ordinal) AS id FROM {_ENT} b GROUP BY 1) e ON {q_key('i.name')} = e.k")(
    lambda t: _IN.df(t).distinct().withColumn("key", N.key_ci(F.col("name"))).join(names.name_index(_entities(t)), "key", "left").select("name", "id")
)
_UNIQ = "SELECT i.name, count(DISTINCT e.id) AS hits, CASE WHEN count(DISTINCT e.id) = 1 THEN min(e.id) END AS id FROM (SELECT DISTINCT name FROM {inn} a) i JOIN {ent} e ON {ki} = {ke} WHERE length({ki}) >= {n} GROUP BY 1"
query("normalized_unique_match", _UNIQ.format(inn=_IN.sql, ent=_ENT, ki=q_tag_key("i.name"), ke=q_tag_key("e.name"), n=1))(lambda t: names.equality_match(_IN.df(t).distinct(), _entities(t), N.tag_key))
query("compact_unique_match", _UNIQ.format(inn=_IN.sql, ent=_ENT, ki=q_compact(q_plain("i.name")), ke=q_compact(q_plain("e.name")), n=4))(lambda t: names.equality_match(_IN.df(t).distinct(), _entities(t), lambda c: N.compact(N.plain_name(c)), 4))
query("unambiguous_index", f"SELECT {q_tag_key('name')} AS key, min(id) AS id FROM {_ENT} e WHERE {q_tag_key('name')} <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1")(lambda t: names.unambiguous_index(_entities(t), N.tag_key))
query("fuzzy_candidates", f"""SELECT l, r FROM (SELECT DISTINCT {q_plain('name')} AS l FROM {_IN.sql} a) a JOIN (SELECT DISTINCT {q_plain('name')} AS r FROM {_ENT} e) b
 ON substr(l, 1, 1) = substr(r, 1, 1) AND length(r) BETWEEN length(l) - 3 AND length(l) + 3 AND length(l) >= 5
 AND 2.0 * list_sum([least(length(l) - length(replace(l, c, '')), length(r) - length(replace(r, c, ''))) FOR c IN string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', '')]) / (length(l) + length(r)) >= 0.9 - 1e-9""")(
    lambda t: fuzzy.candidates(_IN.df(t).select(N.plain_name(F.col("name")).alias("left_norm")).distinct(), _entities(t).select(N.plain_name(F.col("name")).alias("right_norm")).distinct(), 3, 0.9).select(F.col("left_norm").alias("l"), F.col("right_norm").alias("r"))
)


def _typos(t):
    """Names with a letter doubled or added, to be found again."""
    return t.part.select(F.expr(E.TYPO).alias("name")).distinct()


def _plain(t):
    """Each name short and long, those with an r long twice; the alias is the name in one word."""
    forms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(more).alias("more")) for k, more in enumerate(E.FORMS)])
    each = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first")).select("p_name", "first", F.explode(forms).alias("f")).where("f.k < 2 or p_name like '%r%'")
    named = each.select((F.col("first") * 4 + F.col("f.k")).alias("ordinal"), F.concat("p_name", "f.more").alias("name"))
    twins = t.part.where("p_name like '%gear'").groupBy("p_name").agg((F.min("p_partkey") * 4 + 3).alias("ordinal")).select("ordinal", F.upper("p_name").alias("name"))
    return named.unionByName(twins).select(F.col("ordinal").cast("string").alias("id"), "ordinal", "name", F.array(F.regexp_replace("name", " ", "")).alias("aliases"))


@query("fuzzy_match", E.fuzzy_match)
def fuzzy_match(t):
    left, right = _typos(t).select("name", N.plain_name(F.col("name")).alias("left_norm")), _plain(t).select("id", N.plain_name(F.col("name")).alias("right_norm"))
    return winner.winner_with_margin(fuzzy.scored(left, right, 3, 0.9, 1, 0.03), "name", "id", "score", 0.9, 0.03)


query("fuzzy_review_pairs", E.review_pairs)(lambda t: fuzzy.review_pairs(_plain(t), N.tag_cleanup_name, 2, 0.8))
query("entity_match", E.resolver("entity", "entity", 0.96, 0.03, 3, False, False, False, "none"))(lambda t: fuzzy.resolve(_typos(t), _plain(t), fuzzy.IMPORT_STUDIO))
query("entity_decision", E.resolver("plain", "compact", 0.96, 0.03, 4, True, False, False, "ambiguous"))(lambda t: fuzzy.resolve(_typos(t), _plain(t), fuzzy.MIGRATE_STUDIO))
query("tag_reuse", E.resolver("tag", "tag", 0.96, 0.02, 2, False, True, False, "none"))(lambda t: fuzzy.resolve(_typos(t), _plain(t), fuzzy.IMPORT_TAG))
_TAG = ("plain", "compact", 0.96, 0.02, 4, True, False, True, "ambiguous")
query("resolve_tag_decision", E.resolver(*_TAG))(lambda t: fuzzy.resolve(_typos(t), _plain(t), fuzzy.MIGRATE_TAG))
query("resolve_or_create", E.creation(*_TAG))(lambda t: fuzzy.resolve_or_create(_typos(t), _plain(t), fuzzy.MIGRATE_TAG))
query("creation_guard", E.guard)(lambda t: fuzzy.guarded(_typos(t), _plain(t)))
_ODD_NAMES, _ODD_ROWS = E.folding()


@query("norm_unicode", f"SELECT p_partkey AS id, o.* EXCLUDE (id) FROM part JOIN ({_ODD_ROWS}) o ON o.id = p_partkey % {len(_ODD_NAMES)} + 1")
def norm_unicode(t):
    c, place = F.col("name"), (F.col("p_partkey") % len(_ODD_NAMES) + 1).cast("int")
    rows = t.part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(n) for _, n in _ODD_NAMES]), place).alias("name"))
    return rows.select("id", N.key_ci(c).alias("key"), N.tag_key(c).alias("tag"), N.entity_name(c).alias("entity"), N.tag_cleanup_name(c).alias("cleanup"), N.compact(N.plain_name(c)).alias("compact"))


# --- hashes from the signs of the embeddings
_SIGNS = "(SELECT vec_id AS id, list_sum([CASE WHEN embedding[k] > 0 THEN CAST(1 AS HUGEINT) << CAST(k - 1 AS INTEGER) ELSE 0 END FOR k IN range(1, 65)])::HUGEINT::UBIGINT AS bits FROM embeddings)"


def _hashes(t):

    text = F.array_join(F.reverse(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0"))), "")

    return t.embeddings.select(F.col("vec_id").alias("id"), F.conv(text, 2, -10).cast("long").alias("bits"))


#: Each hash, and as a further one the same with 0 to 8 bits turned over.
_BOTH = f"(SELECT id, bits FROM {_SIGNS} s UNION ALL SELECT id + 1000000, xor(bits, ((1::UBIGINT << CAST(id % 9 AS INTEGER)) - 1) << CAST(id % 50 AS INTEGER)) FROM {_SIGNS} s)"


def _turned(t):
    own = _hashes(t)
    turned = F.expr("bits ^ shiftleft(shiftleft(1L, CAST(id % 9 AS INT)) - 1L, CAST(id % 50 AS INT))")
    return own.unionByName(own.select((F.col("id") + 1000000).alias("id"), turned.alias("bits")))


def _near(radius: int) -> str:
    return f"(SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM {_BOTH} a JOIN {_BOTH} b ON a.id <> b.id AND bit_count(xor(a.bits, b.bits)) <= {radius})"


def _pairs(t, radius: int):
    found = hamming.within_radius(_turned(t), _turned(t), radius).where("left_id <> right_id")
    return found.withColumn("distance", F.col("distance").cast("long"))


for _radius in (3, 5, 9):
    query("hamming_range_join" + ("" if _radius == 5 else f"_{_radius}"), f"SELECT left_id, right_id, distance FROM {_near(_radius)} z WHERE left_id < right_id")(lambda t, r=_radius: _pairs(t, r).where("left_id < right_id"))
query("hamming_order", lambda: f"SELECT left_id, right_id, distance, row_number() OVER (PARTITION BY left_id ORDER BY distance, CAST(right_id AS VARCHAR)) AS place FROM {_near(5)} z")(lambda t: hamming.in_order(_pairs(t, 5)))
for _margin in (1, 2):
    query("hamming_unique_nearest" + ("" if _margin == 1 else "_margin"), f"""SELECT left_id, right_id, distance FROM (SELECT *, min(distance) OVER (PARTITION BY left_id) AS b, count(*) OVER (PARTITION BY left_id, distance) AS tied,
 lead(distance) OVER (PARTITION BY left_id ORDER BY distance) AS nxt FROM {_near(3)} z) y WHERE distance = b AND tied = 1 AND (nxt IS NULL OR nxt - b >= {_margin})""")(lambda t, m=_margin: hamming.unique_nearest(_turned(t), _turned(t), 3, m).withColumn("distance", F.col("distance").cast("long")))

# --- ranking
_VIS = Surrogate("events", id="user_id", ordinal="event_id", score="value", resolves="event_type <> 'error'", cand="event_type")
query("visual_rank", f"SELECT id, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS k FROM {_VIS.sql} v WHERE resolves) w WHERE k = 1")(lambda t: winner.first_of(_VIS.df(t).where("resolves"), ["id"], F.desc("score"), F.col("ordinal")).select("id", "ordinal", "score"))
query("winner_with_margin", f"""SELECT id, cand, score FROM (SELECT id, cand, max(score) AS score, row_number() OVER (PARTITION BY id ORDER BY max(score) DESC, cand) AS k, lead(max(score)) OVER (PARTITION BY id ORDER BY max(score) DESC, cand) AS second
 FROM {_VIS.sql} v GROUP BY id, cand) w WHERE k = 1 AND score >= 100 AND (second IS NULL OR score - second >= 5)""")(lambda t: winner.winner_with_margin(_VIS.df(t), "id", "cand", "score", 100, 5))
query("survivor_rank", f"SELECT id, row_number() OVER (PARTITION BY {q_compact(q_plain('name'))} ORDER BY usage DESC, CASE WHEN regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)*') THEN 0 ELSE 1 END, lower(name), id) AS rank FROM {BRANDED.sql} b")(
    lambda t: _ranked(t)
)


def _ranked(t):
    from pyspark.sql import Window

    rows = BRANDED.df(t).withColumn("key", N.compact(N.plain_name(F.col("name"))))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*winner.survivor_order()))).select("id", F.col("rank").cast("long").alias("rank"))


# --- clustering: brands and types as entities, with aliases to other primaries
_B = f"(SELECT id, ordinal, name, usage, alias, rich, signature, {q_compact(q_plain('name'))} AS k, {q_compact(q_plain('alias'))} AS ak FROM {BRANDED.sql} r)"
_CC = f"""WITH RECURSIVE b AS (SELECT * FROM {_B} q), heads AS (SELECT k, min(id) AS head FROM b WHERE length(k) >= 4 GROUP BY 1),
 e AS (SELECT b.id AS x, h.head AS y FROM b JOIN heads h ON b.k = h.k UNION SELECT b.id, h.head FROM b JOIN heads h ON b.ak = h.k),
 s AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
 r(x, y) AS (SELECT x, x FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x),
 comp AS (SELECT x AS id, min(y) AS component FROM r GROUP BY 1)"""


def _branded(t):
    return BRANDED.df(t).withColumn("aliases", F.when(F.col("alias").isNull(), F.array().cast("array<string>")).otherwise(F.array("alias")))


def _members(t):
    return cleanup.duplicate_components(_branded(t), N.plain_name).join(_branded(t), "id")


query("connected_components", f"{_CC} SELECT id, component FROM comp")(lambda t: cleanup.duplicate_components(_branded(t), N.plain_name))
query("dup_groups_by_key", f"SELECT k AS key, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(DISTINCT id) AS members FROM {_B} b WHERE length(k) >= 4 GROUP BY 1 HAVING count(DISTINCT id) > 1")(
    lambda t: cleanup.groups_by_key(_branded(t), N.compact(N.plain_name(F.col("name")))).select("key", F.array_join("ids", ",").alias("ids"), "members")
)
query("dup_names", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")(lambda t: t.part.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1"))
_PLAN = """ , m AS (SELECT b.*, c.component FROM b JOIN comp c ON b.id = c.id), g AS (SELECT component, count(DISTINCT signature) FILTER (WHERE rich) > 1 AS meta FROM m GROUP BY 1),
 rk AS (SELECT m.*, g.meta, row_number() OVER (PARTITION BY m.component ORDER BY usage DESC, CASE WHEN regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)*') THEN 0 ELSE 1 END, lower(name), id) AS rank FROM m JOIN g ON m.component = g.component),
 sv AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN rich AND NOT meta THEN 0 ELSE 1 END, rank) = 1 AS survivor FROM rk)"""


def _plan_sql(kinds: str, extra: str = "") -> str:
    return f"""{_CC}{_PLAN}{extra} SELECT max(id) FILTER (WHERE survivor) AS destination_id, string_agg(id, ',' ORDER BY rank) FILTER (WHERE NOT survivor) AS source_ids,
 CASE WHEN count(DISTINCT {q_plain('name')}) = 1 THEN 'normalized-format' ELSE 'joined-format' END || {kinds} AS kind FROM sv GROUP BY component HAVING count(*) > 1"""


_flat = lambda p: p.select("destination_id", F.array_join("source_ids", ",").alias("source_ids"), "kind")
query("tag_cleanup_safe", _plan_sql("CASE WHEN bool_or(meta) THEN '-metadata-conflict' ELSE '' END"))(lambda t: _flat(cleanup.plan(_members(t), N.plain_name)))
_EXT_ID = "(SELECT p_partkey || '' AS id, 'HTTPS://A' AS endpoint, CASE WHEN p_partkey % 6 = 0 THEN (p_partkey % 5) || '' END AS external_id FROM part)"
query("entity_cleanup_safe", _plan_sql("CASE WHEN count(DISTINCT x.external_id) > 1 THEN '-external-id-conflict' WHEN bool_or(meta) THEN '-metadata-conflict' WHEN bool_or(sp.k IS NOT NULL) THEN '-external-name-conflict' ELSE '' END",
    f""", keys AS (SELECT id, {q_plain('name')} AS k FROM b UNION SELECT id, {q_plain('alias')} FROM b WHERE alias IS NOT NULL), ow AS (SELECT keys.id, keys.k, coalesce(comp.component, '-' || keys.id) AS c FROM keys LEFT JOIN comp ON keys.id = comp.id),
 sp AS (SELECT DISTINCT ow.id, ow.k FROM ow JOIN (SELECT k FROM ow GROUP BY 1 HAVING count(DISTINCT c) > 1) z ON ow.k = z.k)""").replace("FROM sv GROUP BY component", f"FROM (SELECT sv.*, xx.external_id AS xid FROM sv LEFT JOIN {_EXT_ID} xx ON sv.id = xx.id) sv LEFT JOIN (SELECT DISTINCT id AS spid, 1 AS k FROM sp) sp ON sp.spid = sv.id GROUP BY component").replace("x.external_id", "xid").replace("xxid", "xx.external_id"))(
    lambda t: _flat(cleanup.plan(_members(t), N.plain_name, _external(t), _branded(t)))
)


def _external(t):
    return t.part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("HTTPS://A").alias("endpoint"), F.when(F.col("p_partkey") % 6 == 0, (F.col("p_partkey") % 5).cast("string")).alias("external_id"))


query("safe_formatting_merge", f"""WITH b AS (SELECT *, k AS component FROM {_B} q WHERE length(k) >= 4), g AS (SELECT component, count(DISTINCT signature) FILTER (WHERE rich) > 1 AS meta, count(*) AS n FROM b GROUP BY 1)
 SELECT b.component AS key, string_agg(id, ',' ORDER BY usage DESC, CASE WHEN regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)*') THEN 0 ELSE 1 END, lower(name), id) AS ranked, bool_or(meta) AS conflict FROM b JOIN g ON b.component = g.component WHERE n > 1 GROUP BY 1""")(
    lambda t: cleanup.survivors(_branded(t).withColumn("component", N.compact(N.plain_name(F.col("name")))).where("length(component) >= 4")).groupBy(F.col("component").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("ranked"), F.bool_or("conflict").alias("conflict"), F.count("*").alias("n")).where("n > 1").drop("n")
)
query("signature_conflict", f"{_CC}{_PLAN} SELECT component, count(DISTINCT signature) AS different FROM m WHERE rich GROUP BY 1 HAVING count(DISTINCT signature) > 1")(lambda t: winner.conflicts(_members(t).where("rich"), ["component"], "signature"))
query("endpoint_conflict", f"{_CC}{_PLAN} SELECT component FROM m JOIN {_EXT_ID} x ON m.id = x.id GROUP BY component, lower(endpoint) HAVING count(DISTINCT external_id) > 1")(lambda t: cleanup.endpoint_conflicts(_members(t), _external(t)))
query("plan_order", f"{_CC}{_PLAN}, p AS (SELECT max(name) FILTER (WHERE survivor) AS dest, string_agg(name, '|' ORDER BY rank) FILTER (WHERE NOT survivor) AS sources FROM sv GROUP BY component HAVING count(*) > 1) SELECT dest, sources, row_number() OVER (ORDER BY lower(dest), sources) AS rank FROM p")(
    lambda t: names.ranked(cleanup.plan(_members(t), N.plain_name).select(F.col("destination_name").alias("dest"), F.array_join("source_names", "|").alias("sources")), F.lower("dest"), F.col("sources"))
)
_AK = f"(SELECT id, {q_key('name')} AS k, true AS prim, name AS s FROM b UNION ALL SELECT id, {q_key('alias')}, false, alias FROM b WHERE alias IS NOT NULL)"
query("alias_preflight", f"""{_CC}, ks AS (SELECT a.*, c.component AS g FROM {_AK} a LEFT JOIN comp c ON a.id = c.id)
 SELECT o.id, o.s AS alias, CASE WHEN bool_or(NOT coalesce(o.g = x.g, false)) THEN 'conflict' ELSE 'clear' END AS action FROM ks o JOIN ks x ON o.k = x.k AND o.id <> x.id WHERE NOT o.prim AND o.g IS NOT NULL GROUP BY 1, 2""")(lambda t: cleanup.alias_preflight(cleanup.duplicate_components(_branded(t), N.plain_name), _branded(t)))
query("external_alias_conflict", f"""{_CC}, keys AS (SELECT id, {q_plain('name')} AS k FROM b UNION SELECT id, {q_plain('alias')} FROM b WHERE alias IS NOT NULL), ow AS (SELECT keys.id, keys.k, comp.component, coalesce(comp.component, '-' || keys.id) AS c FROM keys LEFT JOIN comp ON keys.id = comp.id)
 SELECT DISTINCT component FROM ow JOIN (SELECT k FROM ow GROUP BY 1 HAVING count(DISTINCT c) > 1) z ON ow.k = z.k WHERE component IS NOT NULL""")(lambda t: cleanup.external_name_conflicts(cleanup.duplicate_components(_branded(t), N.plain_name), _branded(t), N.plain_name))
query("safe_aliases", f"""WITH b AS (SELECT * FROM {_B} q), ks AS (SELECT id, ordinal, {q_plain('name')} AS k FROM b UNION ALL SELECT id, ordinal, {q_plain('alias')} FROM b WHERE alias IS NOT NULL), ow AS (SELECT k, arg_max(id, ordinal) AS owner FROM ks GROUP BY 1)
 SELECT b.id, b.alias, ow.owner = b.id AS safe FROM b JOIN ow ON ow.k = {q_plain('b.alias')} WHERE alias IS NOT NULL""")(lambda t: names.safe_aliases(_branded(t), N.plain_name))
