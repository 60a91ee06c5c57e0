"""Hierarchies, merges, identities, new ids and relations on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from reconloom.operators import fuzzy, hierarchy, restore
from reconloom.plans import tasks


def _rows(df, *c):
    return {tuple(r) for r in (df.select(*c) if c else df).collect()}


def _brute(parent):
    out = {}
    for v in parent:
        path, at = [v], v
        while parent.get(at) is not None and parent[at] in parent and parent[at] != at and parent[at] not in path:
            at = parent[at]
            path.append(at)
        up = parent.get(at)
        if up is not None and up in path and up != at:
            ring = path[path.index(up) :]
            out[v] = (None, None, min(ring), v in ring)
        else:
            out[v] = (len(path) - 1, at, None, False)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_and_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    parent = {v: rng.choice([None, v, 999, *[rng.randrange(n) for _ in range(9)]]) for v in range(n)}
    got = hierarchy.ancestry(spark.createDataFrame([*parent.items(), (None, 3)], "id long, parent long")).collect()
    assert {r["id"]: (r["level"], r["root"], r["cycle"], r["on_cycle"]) for r in got} == _brute(parent) and len(got) == n
    order = rng.sample(range(n), n)
    kept = {r["id"]: r["parent"] for r in hierarchy.opened_cycles(spark.createDataFrame([(v, p, order[v]) for v, p in parent.items()], "id long, parent long, ordinal long")).collect()}
    dropped, done = set(), set()
    for v in sorted(parent, key=lambda v: order[v]):  # the walk: up to what is known or being walked
        way = []
        while v not in done and v not in way:
            way.append(v)
            up = parent[v]
            if up is None or up == v or up not in parent:
                break
            v = up
        else:
            if v in way:
                dropped.add(way[-1])
        done.update(way)
    assert kept == {v: p for v, p in parent.items() if p is not None and p != v and v not in dropped}


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = hierarchy.ancestry(chain)
    assert got.where("level = id and root = 0").count() == n
    assert hierarchy.ancestry(chain.limit(0)).count() == 0
    ring = spark.createDataFrame([(5, 6), (6, 7), (7, 5), (8, 5), (9, 8)], "id long, parent long")
    assert _rows(hierarchy.ancestry(ring), "id", "cycle", "on_cycle") == {(5, 5, True), (6, 5, True), (7, 5, True), (8, 5, False), (9, 5, False)}


_ENT = "id string, ordinal long, name string, aliases array<string>, usage long, rich boolean, signature string"


def _entities(spark):
    return spark.createDataFrame(
        [
            ("1", 1, "Big House", ["bh"], 5, False, ""), ("2", 2, "big_house", ["the house"], 9, True, "a"), ("3", 3, "Bighouse", [], 1, True, "a"),
            ("4", 4, "Two Minds", [], 1, True, "a"), ("5", 5, "two-minds", [], 1, True, "b"), ("6", 6, "Far Shore", [], 1, False, ""), ("7", 7, "far shore", [], 2, False, ""), ("8", 8, "Lone Pine", ["pine"], 1, False, ""),
        ], _ENT)


def _ids(spark, rows, owner="id"):
    return spark.createDataFrame(rows, f"{owner} string, endpoint string, external_id string")


def test_ambiguous_duplicates_merge_and_conflicts_stay(spark):
    external = _ids(spark, [("6", "HTTPS://S", "x"), ("7", "https://s ", "y"), ("3", "https://s", "z")])
    asked = spark.createDataFrame([("BIG HOUSE",), ("Two Minds",), ("far shore",), ("bh",), ("Lone Pine",), ("no such",)], "name string")
    found, merges, after = restore.merge_then_resolve(asked, _entities(spark), external, lambda x, e: fuzzy.resolve(x, e, fuzzy.MIGRATE_STUDIO))
    assert _rows(merges) == {("1", "2"), ("3", "2")}  # minds differ in metadata, shores in their ids
    assert _rows(found) == {("BIG HOUSE", "merged", "2"), ("Two Minds", "ambiguous", None), ("far shore", "ambiguous", None), ("bh", "exact", "2"), ("Lone Pine", "exact", "8"), ("no such", "none", None)}
    kept = {r["id"]: (r["name"], r["aliases"], r["usage"]) for r in after.collect()}
    assert kept["2"] == ("big_house", ["the house", "Big House", "bh", "Bighouse"], 15) and set(kept) == {"2", "4", "5", "6", "7", "8"}


def test_tags_do_not_merge_over_foreign_aliases(spark):
    rows = spark.createDataFrame([("1", 1, "long hair", ["tress"], 1, False, ""), ("2", 2, "long_hair", [], 2, False, ""), ("3", 3, "braid", ["Tress"], 1, False, "")], _ENT)
    asked, none = spark.createDataFrame([("Long Hair",)], "name string"), _ids(spark, [])
    assert restore.safe_merges(asked, rows, none).count() == 1 and restore.safe_merges(asked, rows, none, aliases_block=True).count() == 0


def test_identity_conflicts(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "name string, id string")
    old = _ids(spark, [("a", "HTTPS://S", "x"), ("b", "https://s", "x"), ("c", "https://s", "x"), ("d", "https://other", "q"), ("d", "", "q"), ("d", None, None)], "name")
    now = _ids(spark, [("1", "https://s", "y"), ("2", " https://S", "x"), ("4", "https://s", "z")])
    assert _rows(restore.identity_conflicts(found, old, now)) == {("a",)}
    twice = spark.createDataFrame([("2", "https://s", "z", 0), ("2", "https://s", "x", 1)], "id string, endpoint string, external_id string, position long")
    assert restore.identity_conflicts(found, old, twice).count() == 0  # the last of an endpoint counts


def test_studio_that_resembles_another_is_created(spark):
    """Ratio 0.92: too little to reuse the studio, and there is no guard that would lose it."""
    studios = spark.createDataFrame([("10", 1, "northern pictures", [], 0, False, "")], _ENT)
    asked = spark.createDataFrame([("northern pixtures x",), ("Northern Pictures",)], "name string")
    found, _, _ = restore.resolve_studios(asked, studios, _ids(spark, [], "name"), _ids(spark, []))
    assert _rows(found) == {("northern pixtures x", "create", None), ("Northern Pictures", "exact", "10")}
    assert fuzzy.guarded(asked, studios).where("blocked").count() == 2


def test_new_ids_are_dense_and_stable(spark):
    found = spark.createDataFrame([("B b", "create"), ("b-b", "create"), ("a", "create"), ("old", "exact")], "name string, decision string")
    there = spark.createDataFrame([("9",), ("41",), ("x7",)], "id string")
    assert _rows(restore.minted(found, there)) == {("a", "42", True), ("B b", "43", True), ("b-b", "43", False)}
    order = spark.createDataFrame([("b-b", 1), ("B b", 5), ("a", 3)], "name string, ordinal long")
    assert _rows(restore.minted(found, there, order)) == {("b-b", "42", True), ("B b", "42", False), ("a", "43", True)}


def test_relations_keep_what_is_there_first(spark):
    won = spark.createDataFrame([("o1", "c1"), ("o2", "c2")], "old_id string, current_id string")
    old = spark.createDataFrame([("o1", "x", 0), ("o1", "y", 1), ("o1", "y", 2), ("o1", "lost", 3), ("o2", "x", 0)], "id string, name string, position long")
    now = spark.createDataFrame([("c1", "7", 1), ("c1", "3", 0), ("c2", "1", 0), ("c3", None, 0)], "id string, entity_id string, position long")
    ids = spark.createDataFrame([("x", "1", False), ("y", "90", True)], "name string, id string, fresh boolean")
    got = restore.relations(won, old, now, ids).collect()
    assert [(r["id"], r["before"], r["after"]) for r in got] == [("c1", ["3", "7"], ["3", "7", "1", "90"])]
    assert _rows(restore.single_relation(won, old.where("position = 0"), now.where("id <> 'c1'"), ids)) == {("c1", "1")}


def test_galleries(spark):
    sources = spark.createDataFrame([(1, "A set", False, False), (2, "a-set", None, None), (3, "B", True, False), (4, "B", False, True), (5, " ", False, False), (6, "C", True, True), (7, "D", False, False)], "source long, title string, folder boolean, zips boolean")
    matched = spark.createDataFrame([(6, "path", "60"), (7, "ambiguous", None)], "source long, stage string, id string")
    got = _rows(restore.galleries(sources, matched, spark.createDataFrame([("60",)], "id string")))
    assert got == {(1, "create", "61"), (2, "create", "61"), (3, "unresolved", None), (4, "unresolved", None), (5, "unresolved", None), (6, "reuse", "60"), (7, "ambiguous", None)}


def test_restore_with_relations(spark):
    who = "id string, ordinal long, name string, aliases array<string>, disambiguation string"
    make = lambda kind, names: spark.createDataFrame([(f"{10 * kind + k}", k, n, [], "") for k, n in enumerate(names)], who)
    files = lambda rows: spark.createDataFrame([(i, f"/{i}", 5, "md5", v) for i, v in rows], "id string, path string, size long, fp_type string, fp_value string")
    none = _ids(spark, [], "name")
    names = {"tags": ["long hair", "brand new"], "performers": ["Ann Example"], "studios": ["Big House", "parent co", "fresh sub"], "groups": ["First Run"]}
    entities = {k: make(n, v) for n, (k, v) in enumerate(names.items())}
    old = tasks.Side(
        {"scenes": files([("10", "1"), ("9", "1")])}, {"scenes": spark.createDataFrame([("10", "second", 2), ("9", "first", 1)], "id string, title string, ordinal long")},
        entities | {"groups": entities["groups"].withColumn("aliases", F.lit(""))}, none, spark.createDataFrame([("brand new", "long hair")], "child string, parent string"), {"studios": _ids(spark, [("Big House", "https://s", "a")], "name")},
        spark.createDataFrame([("fresh sub", "parent co", 0), ("parent co", "fresh sub", 1)], "name string, parent string, ordinal long"),
        {"scenes": {"tags": spark.createDataFrame([("9", "brand new", 0), ("9", "long hair", 1), ("10", "long hair", 0)], "id string, name string, position long"), "studios": spark.createDataFrame([("9", "fresh sub", 0)], "id string, name string, position long")}},
    )
    names = {"tags": ["Long Hair", "long_hair"], "performers": ["ann example"], "studios": ["big house"], "groups": ["first-run"]}
    entities = {k: make(n + 4, v) for n, (k, v) in enumerate(names.items())}
    now = tasks.Side(
        {"scenes": files([("s", "1")])}, {"scenes": spark.createDataFrame([("s", "")], "id string, title string")}, entities | {"groups": entities["groups"].withColumn("aliases", F.lit(""))}, none.withColumnRenamed("name", "id"),
        spark.createDataFrame([], "child string, parent string"), {"studios": _ids(spark, [("60", "https://s", "b")])}, spark.createDataFrame([], "id string, parent string"),
        {"scenes": {"tags": spark.createDataFrame([("s", "40", 0)], "id string, entity_id string, position long"), "studios": spark.createDataFrame([], "id string, entity_id string, position long")}},
    )
    out = tasks.restore_run(old, now, {"scenes": {"title": "string"}})
    assert _rows(out["changes_scenes"], "new") == {("first",)}  # the first of the list, not of the ids as text
    assert _rows(out["tags"]) == {("long hair", "merged", "41"), ("brand new", "create", None)} and _rows(out["merges_tags"]) == {("40", "41")}
    assert _rows(out["created_tags"]) == {("brand new", "42", True)} and _rows(out["parents"]) == {("42", "41")}
    assert [(r["id"], r["before"], r["after"]) for r in out["relations_scenes_tags"].collect()] == [("s", ["41"], ["41", "42"])]
    assert _rows(out["studios"], "name", "decision") == {("Big House", "conflict"), ("parent co", "create"), ("fresh sub", "create")}
    fresh = {r["name"]: r["id"] for r in out["created_studios"].collect()}
    assert _rows(out["relations_scenes_studios"]) == {("s", fresh["fresh sub"])} and _rows(out["studio_parents"]) == {(fresh["fresh sub"], fresh["parent co"])}
