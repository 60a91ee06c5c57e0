"""SQL of the fuzzy resolvers, whose ratio no SQL engine has.

The ratios of the names that the tables can hold are computed here with
``difflib``, pair by pair and without blocks; the rules are SQL, without the
bounds by which the operators drop candidates.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from functools import cache

from reconloom.plans.binding import q_compact, q_entity, q_plain, q_tag_key

# The words that make up the names of the table ``part``.
FIRST = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
SECOND = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
#: What entity names add to a name; the third is for names with an r only. A fourth entity has the name of some gears in capitals.
LONG = " workshop of the northern rivers"
FORMS = ("", LONG, f"{LONG} ab")
#: What incoming names do to a name.
TYPO = f"""CASE p_partkey % 5 WHEN 0 THEN p_name || substr(p_name, length(p_name), 1) WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || '{LONG}' || substr('xs', 1 + CAST(p_size % 2 AS INT), 1) WHEN 3 THEN p_name || ' (old)' ELSE 'unheard of ' || p_name END"""

ENTITIES = " UNION ALL ".join(
    f"SELECT (min(p_partkey) * 4 + {k}) || '' AS id, min(p_partkey) * 4 + {k} AS ordinal, p_name || '{more}' AS name FROM part {'' if k < 2 else 'WHERE p_name LIKE ' + repr('%r%')} GROUP BY p_name" for k, more in enumerate(FORMS)
) + " UNION ALL SELECT (min(p_partkey) * 4 + 3) || '', min(p_partkey) * 4 + 3, upper(p_name) FROM part WHERE p_name LIKE '%gear' GROUP BY p_name"
_START = f"WITH inc AS MATERIALIZED (SELECT DISTINCT {TYPO} AS name FROM part), ent AS MATERIALIZED ({ENTITIES}), sp AS MATERIALIZED (SELECT id, name AS s FROM ent UNION ALL SELECT id, replace(name, ' ', '') FROM ent)"


def _python(kind: str) -> Callable[[str], str]:
    """A normaliser for names in ASCII."""
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    plain = lambda s: squeeze(re.sub(r"[^a-z0-9\s]+", " ", s.lower()))
    return {"plain": plain, "compact": lambda s: plain(s).replace(" ", ""), "entity": lambda s: squeeze(re.sub(r"[^a-z0-9\s()]+", " ", s.lower())), "tag": lambda s: squeeze(s.lower())}[kind]


_SQL = {"plain": q_plain, "compact": lambda e: q_compact(q_plain(e)), "entity": q_entity, "tag": q_tag_key}


@cache
def ratios(kind: str, window: int, least: float, incoming: bool = True) -> str:
    """A VALUES list of (left, right, ratio) for all names that start alike and differ in length by ``window`` at most."""
    norm, names = _python(kind), [f"{a} {b}" for a in FIRST for b in SECOND]
    entities = [n + more for n in names for k, more in enumerate(FORMS) if k < 2 or "r" in n]
    right = sorted({norm(x) for e in entities for x in ((e, e.replace(" ", "")) if incoming else (e,))})
    left = sorted({norm(x) for n in names for x in (n + n[-1], n, f"{n}{LONG}x", f"{n}{LONG}s", f"{n} (old)", f"unheard of {n}")}) if incoming else right
    by: dict[tuple[str, int], list[str]] = {}
    for r in right:
        by.setdefault((r[0], len(r)), []).append(r)
    rows = []
    for x in left:
        for n in range(len(x) - window, len(x) + window + 1):
            for y in by.get((x[0], n), ()):
                m = difflib.SequenceMatcher(None, x, y)
                if m.quick_ratio() >= least and m.ratio() >= least:
                    rows.append(f"('{x}', '{y}', {m.ratio()!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) r(l, r, s)"


def _winner(pairs: str, threshold: float, margin: float) -> str:
    """Best of ``pairs`` (name, id, s, rival), where one score counts for each rival."""
    return f"""SELECT *, s >= {threshold} AND (second IS NULL OR s - second >= {margin}) AS won FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, id) AS k, lead(s) OVER (PARTITION BY name ORDER BY s DESC, id) AS second
 FROM (SELECT name, rival, arg_max(id, s) AS id, max(s) AS s FROM ({pairs}) p GROUP BY name, rival) g) w WHERE k = 1 AND s >= {threshold}"""


def decided(kind: str, fuzzy: str, threshold: float, margin: float, window: int, compact: bool, per_key: bool, veto: bool, close: str) -> str:
    """CTEs up to ``d`` (name, decision, id, score)."""
    f, g = _SQL[kind], _SQL[fuzzy]
    table = ratios(fuzzy, window, 0.85)
    keys = f"SELECT {f('s')} AS key, min(id) AS id FROM sp GROUP BY 1 HAVING count(DISTINCT id) = 1" if per_key else f"SELECT DISTINCT {f('s')} AS key, id FROM sp"
    subset = ""
    if veto:
        a, b = (f"list_filter(string_split({q_plain(c)}, ' '), lambda x: x <> '')" for c in ("w.name", "e.name"))
        one = lambda x, y: f"len(list_filter({x}, lambda x: NOT list_contains({y}, x)))"
        subset = f" AND NOT (({one(a, b)} = 0) <> ({one(b, a)} = 0))"
    pairs = f"SELECT i.name, q.id, r.s, {'r.r' if per_key else 'q.id'} AS rival FROM rest i JOIN {table} ON r.l = {g('i.name')} JOIN ({keys if per_key else f'SELECT DISTINCT {g(chr(115))} AS key, id FROM sp'}) q ON q.key = r.r WHERE length(r.l) >= 5"
    second = f"SELECT i.name, count(DISTINCT sp.id) AS hits, min(sp.id) AS id, 'compact' AS how FROM inc i JOIN sp ON {q_compact(f('i.name'))} = {q_compact(f('sp.s'))} WHERE length({q_compact(f('i.name'))}) >= 4 AND i.name NOT IN (SELECT name FROM x0) GROUP BY 1"
    return f"""{_START}, x0 AS (SELECT i.name, count(DISTINCT q.id) AS hits, min(q.id) AS id, 'exact' AS how FROM inc i JOIN ({keys}) q ON q.key = {f('i.name')} GROUP BY 1),
 x AS (SELECT * FROM x0{' UNION ALL ' + second if compact else ''}), rest AS (SELECT name FROM inc WHERE name NOT IN (SELECT name FROM x)), w AS ({_winner(pairs, threshold, margin)}),
 f AS (SELECT w.name, CASE WHEN won THEN 'fuzzy' ELSE 'ambiguous' END AS how, CASE WHEN won THEN w.id END AS id, CASE WHEN won THEN w.s END AS s FROM w JOIN ent e ON w.id = e.id WHERE (won{subset}) {"OR NOT won" if close == "ambiguous" else ""}),
 d AS (SELECT inc.name, CASE WHEN x.hits = 1 THEN x.how WHEN x.hits > 1 THEN 'ambiguous' ELSE coalesce(f.how, 'none') END AS decision, CASE WHEN x.hits = 1 THEN x.id WHEN x.hits IS NULL THEN f.id END AS id, CASE WHEN x.hits IS NOT NULL THEN 1.0::DOUBLE ELSE f.s END AS score
 FROM inc LEFT JOIN x ON inc.name = x.name LEFT JOIN f ON inc.name = f.name)"""


def resolver(*how) -> Callable[[], str]:
    return lambda: f"{decided(*how)} SELECT name, decision, id, score FROM d"


def blocked() -> str:
    return f"SELECT DISTINCT i.name FROM inc i JOIN {ratios('compact', 6, 0.85)} ON r.l = {_SQL['compact']('i.name')} JOIN sp ON r.r = {_SQL['compact']('sp.s')} WHERE r.s >= 0.9"


def guard() -> str:
    return f"{_START}, b AS ({blocked()}) SELECT inc.name, b.name IS NOT NULL AS blocked FROM inc LEFT JOIN b ON inc.name = b.name"


def creation(*how) -> Callable[[], str]:
    return lambda: f"""{decided(*how)}, b AS ({blocked()}), a AS (SELECT d.name, d.id, CASE WHEN decision IN ('exact', 'compact', 'fuzzy') THEN 'reuse' WHEN decision = 'ambiguous' THEN 'ambiguous' WHEN b.name IS NOT NULL THEN 'blocked' ELSE 'create' END AS action FROM d LEFT JOIN b ON d.name = b.name),
 n AS (SELECT name, min(name) OVER (PARTITION BY {q_plain('name')}) AS head FROM a WHERE action = 'create') SELECT name, action, id FROM a WHERE action <> 'create' UNION ALL SELECT name, CASE WHEN name = head THEN 'create' ELSE 'join_new' END, 'new:' || head FROM n"""


def fuzzy_match() -> str:
    pairs = f"SELECT i.name, e.id, r.s, e.id AS rival FROM inc i JOIN {ratios('plain', 3, 0.85)} ON r.l = {q_plain('i.name')} JOIN ent e ON r.r = {q_plain('e.name')}"
    return f"{_START} SELECT name, id, s AS score FROM ({_winner(pairs, 0.9, 0.03)}) z WHERE won"


def review_pairs() -> str:
    one = lambda x, y: f"len(list_filter({x}, lambda x: NOT list_contains({y}, x)))"
    return f"""{_START}, en AS MATERIALIZED (SELECT id, ordinal, {q_plain('name')} AS n FROM ent), ew AS MATERIALIZED (SELECT *, string_split(n, ' ') AS w FROM en), rt AS MATERIALIZED (SELECT * FROM {ratios('plain', 2, 0.8, False)} WHERE length(r.l) >= 5)
 SELECT a.id AS left_id, b.id AS right_id, rt.s AS score FROM rt JOIN ew a ON rt.l = a.n JOIN ew b ON rt.r = b.n WHERE a.ordinal < b.ordinal AND NOT (({one('a.w', 'b.w')} = 0) <> ({one('b.w', 'a.w')} = 0))"""


def reversed_ratio() -> str:
    rows = ", ".join(f"('{n}', {difflib.SequenceMatcher(None, n, n[::-1]).ratio()!r}::DOUBLE)" for n in (f"{a} {b}" for a in FIRST for b in SECOND))
    return f"SELECT p_partkey AS id, round(s, 9) AS ratio FROM part JOIN (VALUES {rows}) r(n, s) ON p_name = n"


def folding() -> tuple[list[tuple[int, str]], str]:
    """Names that fold in other ways than by lower case, and the rows that the normalisers must make of them.

    Fixed values: the rows are written out, not computed."""
    names = [
        (1, "Straße_NORD"), (2, "ＦＵＬＬ　Ｗｉｄｔｈ！"), (3, "Artist:  ﬁne—Print"), (4, "ΟΔΥΣΣΕΥΣ (Ⅳ)"), (5, "Crème  Brûlée"), (6, "①②-½"), (7, "ｱﾆﾒ・ﾏﾝｶﾞ"), (8, " İstanbul　"), (9, "Étude №5"), (10, "ǅungla ﬀ ſ"),
    ]
    rows = [
        (1, "strasse_nord", "strasse nord", "strasse nord", "strasse nord", "strassenord"), (2, "ｆｕｌｌ　ｗｉｄｔｈ！", "full width!", "full width", "full width", "fullwidth"),
        (3, "artist:  fine—print", "fine—print", "artist fine print", "fine print", "artistfineprint"), (4, "οδυσσευσ (ⅳ)", "οδυσσευσ (iv)", "οδυσσευσ (iv)", "οδυσσευσ iv", "οδυσσευσiv"),
        (5, "crème  brûlée", "crème brûlée", "crème brûlée", "crème brûlée", "crèmebrûlée"), (6, "①②-½", "12 1⁄2", "12 1 2", "12 1 2", "1212"),
        (7, "ｱﾆﾒ・ﾏﾝｶﾞ", "アニメ・マンガ", "アニメ マンガ", "アニメ マンガ", "アニメマンガ"), (8, "i̇stanbul", "i̇stanbul", "i stanbul", "i stanbul", "istanbul"),
        (9, "étude №5", "étude no5", "étude no5", "étude no5", "étudeno5"), (10, "ǆungla ff s", "džungla ff s", "džungla ff s", "džungla ff s", "džunglaffs"),
    ]
    return names, "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(chr(39) + v + chr(39) for v in r)})" for i, *r in rows) + ") t(id, key, tag, entity, cleanup, compact)"
