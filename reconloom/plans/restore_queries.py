"""Hierarchies, identities, merges, new ids and relations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconloom.operators import fuzzy, hierarchy, restore
from reconloom.plans import expected as E
from reconloom.plans.binding import Surrogate, q_compact, q_plain, query
from reconloom.plans.match_queries import _plain, _typos

# --- hierarchies: orders below earlier ones; some point forward and close cycles
_TREE = Surrogate("part", id="p_partkey", ordinal="(p_partkey * 37) % 1009 * 100000 + p_partkey", parent="CASE WHEN p_partkey % 97 = 5 THEN p_partkey + 2 WHEN p_partkey % 97 = 6 THEN p_partkey WHEN p_partkey % 97 = 8 THEN NULL ELSE p_partkey - 1 - p_partkey * 31 % 5 END")
_WALK = f"""WITH RECURSIVE n AS (SELECT * FROM {_TREE.sql} t), e AS (SELECT a.id, a.parent FROM n a JOIN n b ON a.parent = b.id AND a.id <> b.id),
 up(id, level, root) AS (SELECT n.id, 0, n.id FROM n WHERE n.id NOT IN (SELECT id FROM e) UNION ALL SELECT e.id, up.level + 1, up.root FROM up JOIN e ON e.parent = up.id),
 lost AS (SELECT e.* FROM e WHERE e.id NOT IN (SELECT id FROM up)), reach(x, y) AS (SELECT id, parent FROM lost UNION SELECT r.x, l.parent FROM reach r JOIN lost l ON r.y = l.id),
 ring AS (SELECT x AS id, (SELECT min(b.y) FROM reach b WHERE b.x = a.x) AS cycle FROM reach a WHERE x = y),
 named AS (SELECT DISTINCT r.x AS id, ring.cycle, r.x IN (SELECT id FROM ring) AS on_cycle FROM reach r JOIN ring ON r.y = ring.id)"""
query("hierarchy_levels", f"{_WALK} SELECT n.id, CAST(up.level AS BIGINT) AS level, up.root, named.cycle, coalesce(named.on_cycle, false) AS on_cycle FROM n LEFT JOIN up ON n.id = up.id LEFT JOIN named ON n.id = named.id")(lambda t: hierarchy.ancestry(_TREE.df(t).select("id", "parent")).drop("parent"))
query("hierarchy_opened", f"""{_WALK}, steps(s, x, k) AS (SELECT id, id, 0 FROM named UNION ALL SELECT s, l.parent, k + 1 FROM steps JOIN lost l ON steps.x = l.id WHERE steps.x NOT IN (SELECT id FROM ring)),
 entry AS (SELECT named.cycle, arg_min(steps.x, n.ordinal) AS door FROM steps JOIN named ON steps.s = named.id JOIN n ON n.id = steps.s WHERE steps.x IN (SELECT id FROM ring) GROUP BY 1)
 SELECT id, parent FROM e WHERE NOT (id IN (SELECT id FROM ring) AND parent IN (SELECT door FROM entry))""")(lambda t: _opened(t))


def _opened(t):
    rows = _TREE.df(t)
    known = rows.select(F.col("id").alias("parent"))
    return hierarchy.opened_cycles(rows, "ordinal").join(known, "parent", "left_semi").select("id", "parent")


# --- studios: exact, compact and similar names, duplicates by case that merge first, external ids that object
_STUDIO = ("plain", "compact", 0.96, 0.03, 4, True, False, False, "ambiguous")
_RICH, _SIGN = "ordinal % 3 > 0", "ordinal % 3 || ''"
_ENT = f"SELECT *, CAST(ordinal % 7 AS BIGINT) AS usage, {_RICH} AS rich, {_SIGN} AS signature, 'x' || ordinal % 5 AS ext, CASE WHEN ordinal % 11 = 0 THEN NULL ELSE 'https://a' || ordinal % 2 END AS endpoint FROM ent"
_KEYED = f"k AS (SELECT *, {q_compact(q_plain('name'))} AS key FROM ({_ENT}) q)"
_OBJECTS = "o.endpoint = 'https://a' || length(r.name) % 2 WHERE length(r.name) % 4 > 0 AND o.ext <> 'x' || length(r.name) % 5"
_MERGED = f"""{_KEYED}, amb AS (SELECT DISTINCT {q_compact(q_plain('name'))} AS key FROM d WHERE decision = 'ambiguous'),
 g AS (SELECT k.*, count(*) OVER (PARTITION BY key) AS n FROM k WHERE length(key) >= 4 AND key IN (SELECT key FROM amb)),
 bad AS (SELECT key FROM g WHERE rich GROUP BY 1 HAVING count(DISTINCT signature) > 1 UNION SELECT key FROM g WHERE endpoint IS NOT NULL GROUP BY key, endpoint HAVING count(DISTINCT ext) > 1),
 m AS (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY CASE WHEN rich THEN 0 ELSE 1 END, usage DESC, CASE WHEN regexp_full_match(name, '[a-z0-9]+(_[a-z0-9]+)*') THEN 0 ELSE 1 END, lower(name), id) AS dest FROM g WHERE n > 1 AND key NOT IN (SELECT key FROM bad)),
 mg AS (SELECT id AS source_id, dest AS destination_id FROM m WHERE id <> dest)"""


def _rich(t):
    return _plain(t).withColumns({"usage": F.expr("CAST(ordinal % 7 AS BIGINT)"), "rich": F.expr(_RICH), "signature": F.expr(_SIGN)})


def _current_ids(t):
    return _plain(t).select("id", F.expr("CASE WHEN ordinal % 11 = 0 THEN NULL ELSE 'HTTPS://A' || ordinal % 2 END").alias("endpoint"), F.expr("'x' || ordinal % 5").alias("external_id"))


def _old_ids(t):
    return _typos(t).where("length(name) % 4 > 0").select("name", F.expr("'https://a' || length(name) % 2").alias("endpoint"), F.expr("'x' || length(name) % 5").alias("external_id"))


def _decided(x, e):
    return fuzzy.resolve(x, e, fuzzy.MIGRATE_STUDIO)


query("ambiguous_merges", lambda: f"{E.decided(*_STUDIO)}, {_MERGED} SELECT source_id, destination_id FROM mg")(
    lambda t: restore.safe_merges(_decided(_typos(t), _plain(t)).where("decision = 'ambiguous'").select("name"), _rich(t), _current_ids(t))
)
#: Names whose group merged are the survivor's; a source's name elsewhere leads to its survivor. In these tables what stays ambiguous has no group that merges.
_FOUND = f"""{_MERGED}, s AS (SELECT DISTINCT key, dest FROM m), r AS (SELECT d.name, CASE WHEN s.dest IS NOT NULL AND decision = 'ambiguous' THEN 'merged' ELSE decision END AS decision, CASE WHEN decision = 'ambiguous' THEN s.dest ELSE coalesce(mg.destination_id, d.id) END AS id
 FROM d LEFT JOIN s ON s.key = {q_compact(q_plain('d.name'))} LEFT JOIN mg ON mg.source_id = d.id),
 owned AS (SELECT coalesce(mg.destination_id, k.id) AS id, endpoint, max(ext) AS ext FROM k LEFT JOIN mg ON mg.source_id = k.id WHERE endpoint IS NOT NULL GROUP BY 1, 2),
 cl AS (SELECT DISTINCT r.name FROM r JOIN owned o ON r.id = o.id AND {_OBJECTS}),
 z AS (SELECT r.name, CASE WHEN cl.name IS NOT NULL THEN 'conflict' WHEN decision = 'none' THEN 'create' ELSE decision END AS decision, CASE WHEN cl.name IS NULL THEN r.id END AS id FROM r LEFT JOIN cl ON r.name = cl.name)"""


def _studios(t):
    return restore.resolve_studios(_typos(t), _rich(t), _old_ids(t), _current_ids(t))[0]


query("studio_resolution", lambda: f"{E.decided(*_STUDIO)}, {_FOUND} SELECT name, decision, id FROM z")(_studios)
query("identity_conflicts", lambda: f"{E.decided(*_STUDIO)}, {_KEYED} SELECT DISTINCT r.name FROM d r JOIN k o ON r.id = o.id AND {_OBJECTS}")(
    lambda t: restore.identity_conflicts(_decided(_typos(t), _plain(t)), _old_ids(t), _current_ids(t))
)
_MINTED = f"""h AS (SELECT {q_plain('name')} AS key, arg_min(name, (length(name), name)) AS head, min(length(name)) AS place FROM z WHERE decision = 'create' GROUP BY 1),
 mw AS (SELECT *, CAST((SELECT max(CAST(id AS BIGINT)) FROM ent) + row_number() OVER (ORDER BY place, key) AS VARCHAR) AS id FROM h),
 nw AS (SELECT z.name, mw.id, z.name = mw.head AS first FROM z JOIN mw ON {q_plain('z.name')} = mw.key WHERE z.decision = 'create')"""


def _new(t, found):
    return restore.minted(found, _plain(t), _typos(t).select("name", F.length("name").alias("ordinal")))


query("minted_ids", lambda: f"{E.decided(*_STUDIO)}, {_FOUND}, {_MINTED} SELECT name, id, first FROM nw")(lambda t: _new(t, _studios(t)))


# --- relations: each document is an old record and a current one; old ones name studios, current ones have some
_REL = "SELECT d.doc_id AS old_id, d.doc_id || 'c' AS current_id, i.name, (length(i.name) + d.doc_id) % 17 AS position FROM documents d JOIN inc i ON length(i.name) % 13 = d.doc_id % 13 AND ascii(i.name) % 4 = d.doc_id % 4"
_HAS = "SELECT d.doc_id || 'c' AS id, e.id AS entity_id, e.ordinal % 19 AS position FROM documents d JOIN ent e ON e.ordinal % 29 = d.doc_id % 29"


def _names_of(t):
    return t.documents.join(_typos(t), (F.length("name") % 13 == F.col("doc_id") % 13) & (F.ascii("name") % 4 == F.col("doc_id") % 4)).select(F.col("doc_id").alias("id"), "name", ((F.length("name") + F.col("doc_id")) % 17).alias("position"))


def _has(t):
    return t.documents.join(_plain(t), F.col("ordinal") % 29 == F.col("doc_id") % 29).select(F.concat(F.col("doc_id").cast("string"), F.lit("c")).alias("id"), F.col("id").alias("entity_id"), (F.col("ordinal") % 19).alias("position"))


def _won(t):
    return t.documents.select(F.col("doc_id").alias("old_id"), F.concat(F.col("doc_id").cast("string"), F.lit("c")).alias("current_id"))


def _leads(t):
    found = _studios(t)
    return restore.entity_ids(found, _new(t, found))


_SETS = f"""led AS (SELECT name, id FROM z WHERE id IS NOT NULL UNION ALL SELECT name, id FROM nw), rel AS ({_REL}), has AS ({_HAS}),
 every AS (SELECT id, entity_id, 0 AS side, position FROM has UNION ALL SELECT current_id, led.id, 1, position FROM rel JOIN led ON rel.name = led.name),
 one AS (SELECT id, entity_id, min((side, position)) AS spot FROM every GROUP BY 1, 2)"""
query("restore_relations", lambda: f"""{E.decided(*_STUDIO)}, {_FOUND}, {_MINTED}, {_SETS} SELECT id, coalesce(string_agg(entity_id, ',' ORDER BY spot, entity_id) FILTER (WHERE spot[1] = 0), '') AS before, string_agg(entity_id, ',' ORDER BY spot, entity_id) AS after
 FROM one GROUP BY id HAVING count(*) > count(*) FILTER (WHERE spot[1] = 0)""")(lambda t: restore.relations(_won(t), _names_of(t), _has(t), _leads(t)).select("id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after")))
query("restore_single_relation", lambda: f"{E.decided(*_STUDIO)}, {_FOUND}, {_MINTED}, {_SETS} SELECT rel.current_id AS id, min(led.id) AS entity_id FROM rel JOIN led ON rel.name = led.name WHERE rel.current_id NOT IN (SELECT id FROM has WHERE CAST(entity_id AS BIGINT) % 5 < 2) GROUP BY 1")(
    lambda t: restore.single_relation(_won(t), _names_of(t), _has(t).withColumn("entity_id", F.when(F.col("entity_id").cast("long") % 5 < 2, F.col("entity_id"))), _leads(t))
)

# --- galleries: matched, ambiguous, with files, without title, to be created
_GAL = Surrogate("pages", source="page_id", title="CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Set ' || page_id % 40 ELSE 'set_' || page_id % 40 END", folder="page_id % 7 = 0", zips="page_id % 11 = 0", stage="CASE WHEN page_id % 6 = 0 THEN 'ambiguous' WHEN page_id % 6 = 1 THEN 'path' ELSE 'none' END", id="CASE WHEN page_id % 6 = 1 THEN page_id || '' END")
query("gallery_creation", f"""WITH g AS (SELECT *, CASE WHEN stage = 'ambiguous' THEN 'ambiguous' WHEN id IS NOT NULL THEN 'reuse' WHEN folder OR zips OR title = '' THEN 'unresolved' ELSE 'create' END AS decision, {q_plain('title')} AS key FROM {_GAL.sql} q),
 n AS (SELECT key, CAST((SELECT max(page_id) FROM pages) + row_number() OVER (ORDER BY key) AS VARCHAR) AS id FROM g WHERE decision = 'create' GROUP BY 1)
 SELECT source, decision, CASE WHEN decision = 'create' THEN n.id ELSE g.id END AS id FROM g LEFT JOIN n ON g.key = n.key""")(
    lambda t: restore.galleries(_GAL.df(t).select("source", "title", "folder", "zips"), _GAL.df(t).select("source", "stage", "id"), t.pages.select(F.col("page_id").cast("string").alias("id")))
)
