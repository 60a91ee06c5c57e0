import difflib
import json
import posixpath
import random
import time
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from reconloom.functions import normalize as N
from reconloom.operators import cleanup, fuzzy, hamming, media, merge, names, segments, winner
from reconloom.operators.components import connected_components
from reconloom.plans import expected, flow
from reconloom.sources import export
from reconloom.streaming.stateful import Breaker, adaptive_backoff, circuit_breaker


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalisers_differ(spark):
    for f, want in ((N.key_ci, "general:foo_(bar)-baz"), (N.tag_key, "foo (bar) baz"), (N.entity_name, "general foo (bar) baz"), (N.tag_cleanup_name, "foo bar baz"), (N.plain_name, "general foo bar baz")):
        assert one(spark, f(F.lit("  General:Foo_(bar)-baz "))) == want
    assert one(spark, N.compact(N.plain_name(F.lit("Ärger & Ring-7")))) == "ärgerring7"
    assert one(spark, N.folded(F.lit("Straße ﬁ"))) == "strasse fi"


def test_bands_follow_printed_tenths(spark):
    rows = spark.createDataFrame([(x,) for x in (92.9, 92.94, 92.95, 92.96, 84.94, 84.95)], "s double")
    assert [r[0] for r in rows.select(N.band(F.col("s"))).collect()] == ["REVIEW", "REVIEW", "HIGH", "HIGH", "LOW", "REVIEW"]


def test_dates(spark):
    cases = {"1262304000": "2010-01-01", "1262304000000": "2010-01-01", "2019-03-05T10:00:00Z": "2019-03-05", "Tue Mar 05 10:11:12 +0000 2013": "2013-03-05", "2020-01-02 junk": "2020-01-02", "soon": None, "": None}
    rows = spark.createDataFrame(list(cases.items()), "d string, want string").select("want", N.source_date(F.col("d")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_paths_and_hashes(spark):
    for p in ("/a/./b//c/../d", "//x/y", "../z", "a/", "."):
        assert one(spark, N.posix_path(F.lit(p))) == posixpath.normpath(p)
    assert one(spark, N.hash_bits(F.lit("ffffffffffffffff"))) == -1
    assert one(spark, N.hash_bits(F.lit("xyz"))) is None
    assert one(spark, N.hash_bits(F.lit("-1"))) is None


def test_hamming_bands_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for b in base:
        rows.append(b)
        for flips in (1, 2, 3, 4, 5, 8):
            x = b
            for k in rng.sample(range(64), flips):
                x ^= 1 << k
            rows.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in rows]
    df = spark.createDataFrame([*enumerate(signed), (9999, None)], "id long, bits long")
    for radius in (0, 3, 5):
        got = {tuple(r) for r in hamming.within_radius(df, df, radius).collect()}
        assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(rows) for j, b in enumerate(rows) if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize(("distances", "margin", "want"), [([5], 1, 5), ([1, 1], 1, None), ([1, 3], 1, 1), ([1, 3], 3, None), ([1, 2], 2, None), ([0, 1], 1, 0)])
def test_unique_nearest(spark, distances, margin, want):
    df = spark.createDataFrame([("s", f"c{k}", d) for k, d in enumerate(distances)], "src string, cand string, d int")
    got = winner.unique_nearest(df, "src", "cand", "d", margin).collect()
    assert ([r["d"] for r in got] or [None]) == [want]


def test_ties_have_no_winner(spark):
    df = spark.createDataFrame([("a", 1, 0.97), ("a", 2, 0.97), ("b", 1, 0.99), ("b", 2, 0.95), ("c", 1, 0.9)], "s string, c int, score double")
    assert {(r["s"], r["c"]) for r in winner.winner_with_margin(df, "s", "c", "score", 0.96, 0.03).collect()} == {("b", 1)}


def test_ordered_distinct_keeps_first_spelling(spark):
    got = one(spark, winner.ordered_ci_distinct(F.array(*[F.lit(x) for x in ("B", " a ", "b", "")]), F.array(F.lit("A"), F.lit("c"))))
    assert got == ["B", "a", "c"]


def test_ordered_distinct_of_many_spellings_is_not_quadratic(spark):
    """6,000 spellings compared in pairs take a minute."""
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda k: F.concat(F.when(k % 2 == 0, F.lit("Äb ")).otherwise(F.lit(" äB ")), (k % 4000).cast("string"))).alias("a"))
    start = time.perf_counter()
    got = long.select(winner.ordered_ci_distinct("a").alias("v")).first()["v"]
    assert time.perf_counter() - start < 15
    assert got == [f"Äb {k}" if k % 2 == 0 else f"äB {k}" for k in range(4000)]


def test_grouped_distinct_equals_arrays(spark):
    rows = spark.createDataFrame([("g", 2, "B", "x"), ("g", 1, " b ", None), ("g", 1, "a", "B"), ("h", 1, " ", None), (None, 3, "z", "Z")], "g string, k int, v string, w string")
    whole = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "v", "w"))).alias("m")).select("g", winner.ordered_ci_distinct(F.flatten(F.transform("m", lambda x: F.array(x["v"], x["w"])))).alias("values"))
    got = {r["g"]: r["values"] for r in winner.grouped_ci_distinct(rows, "g", ["k", "v"], F.col("v"), F.col("w")).collect()}
    assert got == {r["g"]: r["values"] for r in whole.collect()} == {"g": ["b", "a", "x"], "h": [], None: ["z"]}


def test_joined_sets_count_as_pairs_do(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice([*range(12), None]), rng.choice("abc"), rng.choice([*range(5), None])) for _ in range(n)]
    for n, m in ((60, 60), (25, 8), (0, 9)):
        a, b = spark.createDataFrame(some(n), "s int, e string, x int"), spark.createDataFrame(some(m), "t int, e string, x int")
        want = winner.unique_hits(a.join(b, ["e", "x"]), "s", "t")
        got = winner.unique_joined(a, b, ["e", "x"], "s", "t")
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_key_of_all_rows_costs_no_pairs(spark):
    """One external id on either side of 60,000 rows: 3.6e9 pairs."""
    ids = spark.range(60_000).select(F.col("id"), F.lit("HTTPS://x").alias("endpoint"), F.lit("1").alias("external_id"))
    start = time.perf_counter()
    got = names.external_id_match(ids.withColumnRenamed("id", "source"), ids).groupBy("hits", "id").count().collect()
    assert time.perf_counter() - start < 30
    assert [tuple(r) for r in got] == [(60_000, None, 60_000)]


def test_cascades_cost_no_pairs_of_rows_with_one_title(spark):
    """Three keys, one of them shared by 60,000 rows on either side."""
    rows = spark.range(60_000).select("id", F.col("id").alias("ordinal"), F.col("id").cast("string").alias("zip"), F.lit("t").alias("title"))
    refs = spark.range(60_000).select(F.col("id").alias("ref"), F.when(F.col("id") < 3, F.col("id").cast("string")).alias("zip"), F.when(F.col("id") < 59_999, "t").alias("title"))
    start = time.perf_counter()
    first = names.disjunctive_first(refs, rows, ["zip", "title"])
    found = names.cascade(refs.withColumnRenamed("ref", "source"), *[(k, winner.unique_joined(refs, rows, [k], "ref", "id").toDF("source", "hits", "target")) for k in ("zip", "title")])
    assert [tuple(r) for r in first.groupBy("id").count().collect()] == [(0, 59_999)]
    assert {tuple(r) for r in found.groupBy("stage").agg(F.count("*"), F.sum("id")).collect()} == {("zip", 3, 3), ("ambiguous", 59_996, None), ("none", 1, None)}
    assert time.perf_counter() - start < 30


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _fp(spark, rows):
    return spark.createDataFrame(rows, "id string, path string, size long, fp_type string, fp_value string")


def test_media_cascade_cases(spark):
    old = _fp(spark, [("1", "a", 5, "md5", "AA"), ("2", "b", 5, "md5", "bb"), ("3", "c", 5, "md5", "zz"), ("4", "d", 7, "phash", "p4"), ("5", "e", 7, "md5", "nohit"), ("5", "e", 7, "phash", "p5"), ("6", "f", 0, "phash", "p6"), ("7", "g", 9, "md5", "c7"), ("7", "g", 9, "oshash", "o7")])
    cur = _fp(spark, [("x", "q", 5, "md5", "aa"), ("y1", "q", 5, "md5", "bb"), ("y2", "q", 5, "md5", "bb"), ("z", "c", 5, "md5", "other"), ("w", "q", 7, "phash", "p4"), ("v", "q", 7, "phash", "p5"), ("u", "q", 0, "phash", "p6"), ("t", "q", 9, "md5", "c7"), ("s", "q", 9, "md5", "c7"), ("s", "q", 9, "oshash", "o7")])
    got = {r["old_id"]: (r["current_id"], r["kind"]) for r in media.match_cascade(old, cur).collect()}
    assert got == {"1": ("x", "fingerprint"), "2": (None, "ambiguous"), "3": ("z", "exact-path"), "4": ("w", "strict-phash"), "5": (None, "unmatched"), "6": (None, "unmatched"), "7": ("s", "fingerprint")}


def _named(spark, rows):
    return spark.createDataFrame(rows, "id string, ordinal long, name string, aliases array<string>")


def test_blocked_fuzzy_equals_unblocked(spark):
    left = ["silver ringo", "golden gear", "tide pool", "red widgets", "blue bolt"]
    right = ["silver ring", "golden gears", "tidepool", "red widget", "blue volt"]
    a = spark.createDataFrame([(x,) for x in left], "left_norm string")
    b = spark.createDataFrame([(x,) for x in right], "right_norm string")
    got = {(r[0], r[1]) for r in fuzzy.candidates(a, b, 3, 0.8).withColumn("s", segments.sequence_ratio("left_norm", "right_norm")).where("s >= 0.8").select("left_norm", "right_norm").collect()}
    assert got == {(x, y) for x in left for y in right if x[0] == y[0] and abs(len(x) - len(y)) <= 3 and difflib.SequenceMatcher(None, x, y).ratio() >= 0.8}


def _unblocked(names, entities, threshold, margin, window):
    """The rule over all pairs: the best entity, or None where it is below the threshold or too close to the second."""
    out = {}
    for x in names:
        scored = sorted(((difflib.SequenceMatcher(None, x, y).ratio(), i) for i, y in entities if y[0] == x[0] and abs(len(x) - len(y)) <= window), reverse=True)
        best = scored and scored[0][0] >= threshold
        out[x] = scored[0][1] if best and (len(scored) == 1 or scored[0][0] - scored[1][0] >= margin) else "close" if best else None
    return out


def test_runner_up_below_the_threshold_counts(spark):
    name = "abcdefghijklmnopqrstuvwxy"
    entities = [("1", name[:-1] + "z"), ("2", name + "qqq"), ("3", "a" + "b" * 24), ("4", "lonely and far away"), ("5", "twin studio number one"), ("6", "twin studio number two")]
    rng = random.Random(3)
    letters = "abcdefghij"
    entities += [(str(100 + k), "k" + "".join(rng.choices(letters, k=14))) for k in range(30)]
    names = [name, "lonely and far awayy", "twin studio number onee"]
    names += [y[:6] + rng.choice(letters) + y[6 + k % 2 :] for k, (_, y) in enumerate(entities[6:])]
    df = _named(spark, [(i, int(i), y, []) for i, y in entities])
    incoming = spark.createDataFrame([(x,) for x in names], "name string")
    for how, threshold, margin, window in ((fuzzy.IMPORT_STUDIO, 0.96, 0.03, 3), (fuzzy.Resolver(N.entity_name, 0.85, 0.05, 3, close_is_ambiguous=True), 0.85, 0.05, 3)):
        want = _unblocked(names, entities, threshold, margin, window)
        got = {r["name"]: (r["decision"], r["id"]) for r in fuzzy.resolve(incoming, df, how).collect()}
        for x in names:
            if want[x] in (None, "close"):
                assert got[x] == ("ambiguous" if want[x] == "close" and how.close_is_ambiguous else "none", None)
            else:
                assert got[x] == ("exact" if x in dict(map(reversed, entities)) else "fuzzy", want[x])
        assert want[name] in (None, "close") or threshold < 0.9


def test_all_bands_find_and_radius_is_checked(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(30)]
    rows = [(k, b) for k, b in enumerate(base)]
    for k, b in enumerate(base):
        x = b
        for p in rng.sample(range(63), k % 12):
            x ^= 1 << p
        rows.append((100 + k, x))
    df = spark.createDataFrame([*rows, (999, None)], "id long, bits long")
    for radius in (0, 3, 5, 7, 8, 11, 12, 30, 64):
        got = {(r[0], r[1]): r[2] for r in hamming.within_radius(df, df, radius).collect()}
        assert got == {(i, j): (a ^ b).bit_count() for i, a in rows for j, b in rows if (a ^ b).bit_count() <= radius}
    assert [r["distance"] for r in hamming.in_order(hamming.within_radius(df.where("id = 5"), df, 11)).orderBy("place").collect()][:2] == [0, 5]
    with pytest.raises(ValueError):
        hamming.within_radius(df, df, 65)


def test_written_folding_rows_are_those_of_unicode():
    names, sql = expected.folding()
    for i, v in names:
        assert f"({i}, '{v.casefold().strip()}', " in sql
        assert unicodedata.normalize("NFKC", v).casefold().strip().replace("artist:", "").strip().split()[0].split("_")[0].split("-")[0] in sql


def test_resolver_decisions(spark):
    entities = _named(spark, [("1", 1, "Silver Ring Extraordinaire", []), ("2", 2, "gold_gear", ["golden"]), ("3", 3, "Golden!", []), ("4", 4, "blue bolt", [])])
    names = spark.createDataFrame([("silver ring extraordinairee",), ("GOLD-GEAR",), ("golden",), ("bluebolt",), ("nothing like it",), (None,)], "name string")
    got = {r["name"]: (r["decision"], r["id"]) for r in fuzzy.resolve(names, entities, fuzzy.MIGRATE_STUDIO).collect()}
    assert got["silver ring extraordinairee"] == ("fuzzy", "1")
    assert got["GOLD-GEAR"] == ("exact", "2")
    assert got["golden"] == ("ambiguous", None)
    assert got["bluebolt"] == ("compact", "4")
    assert got["nothing like it"][0] == "none"


def test_cleanup_plan_rules(spark):
    rows = [("1", "long hair", 9, False, ""), ("2", "long_hair", 9, False, ""), ("3", "LongHair", 1, False, ""), ("4", "ring a", 1, True, "x"), ("5", "ring-a", 5, True, "y"), ("6", "abc", 1, False, ""), ("7", "a.b.c", 1, False, "")]
    entities = _named(spark, [(i, int(i), n, []) for i, n, *_ in rows])
    members = cleanup.duplicate_components(entities, N.tag_cleanup_name).join(spark.createDataFrame(rows, "id string, name string, usage long, rich boolean, signature string"), "id")
    got = {r["destination_id"]: (r["source_ids"], r["kind"], r["auto_merge"]) for r in cleanup.plan(members, N.tag_cleanup_name).collect()}
    assert got == {"2": (["1", "3"], "joined-format", True), "5": (["4"], "normalized-format-metadata-conflict", False)}
    guarded = cleanup.duplicate_components(entities, N.tag_cleanup_name, protected=["Long Hair"])
    assert {r["id"] for r in guarded.collect()} == {"2", "3", "4", "5"}


def test_unknown_is_not_a_miss(spark):
    rows = spark.createDataFrame([("a", "miss"), ("a", "miss"), ("b", "miss"), ("b", "retryable_error"), ("c", "unavailable"), ("d", None)], "id string, status string")
    got = {r["id"]: r["no_match"] for r in flow.authoritative(rows, "id").collect()}
    assert {k for k, v in got.items() if v} == {"a"}


def test_imported_is_never_left(spark):
    rows = spark.createDataFrame([(s, o) for s in ("Imported", "Pending") for o in ("match", "miss", "candidate", "error")], "s string, o string")
    got = {(r[0], r[1]): r[2] for r in rows.select("s", "o", flow.transition(F.col("s"), F.col("o")).alias("n")).collect()}
    assert all(got["Imported", o] == "Imported" for o in ("match", "miss", "candidate", "error"))
    assert [got["Pending", o] for o in ("match", "miss", "candidate", "error")] == ["Imported", "NoMatch", "Review", "Unresolved"]


def test_fill_and_changes(spark):
    cur = spark.createDataFrame([(1, "", 0, False), (2, "x", 5, True)], "id int, t string, n int, b boolean")
    old = spark.createDataFrame([(1, "old", 7, True), (2, "old", 7, False)], "id int, t string, n int, b boolean")
    after = merge.fill(cur, old, "id", {"t": "string", "n": "int", "b": "boolean"})
    assert {tuple(r) for r in after.collect()} == {(1, "old", 7, True), (2, "x", 5, True)}
    assert {(r["id"], r["field"], r["new"]) for r in merge.changeset(cur, after, "id", ["t", "n", "b"]).collect()} == {(1, "t", "old"), (1, "n", "7"), (1, "b", "true")}


def test_circuit_breaker(spark):
    for failures, opened in ((3, 0), (4, 1), (5, 1)):
        b = Breaker()
        for k in range(failures):
            b.see(float(k), True)
        assert (b.opened, b.rejected) == (opened, max(0, failures - 4))
    rows = [("h", float(k), True) for k in range(6)] + [("h", 200.0, False), ("g", 0.0, True), (None, 1.0, True)]
    got = {r["host"]: tuple(r)[1:] for r in circuit_breaker(spark.createDataFrame(rows, "host string, at double, failed boolean")).collect()}
    assert got == {"h": (1, 2, 5, 123.0), "g": (0, 0, 1, 0.0)}
    pace = adaptive_backoff(spark.createDataFrame([("h", 1.0, True), ("h", 2.0, True), ("h", 3.0, True), ("h", 4.0, True), ("h", 5.0, False)], "host string, at double, failed boolean")).first()
    assert (pace["waits"], pace["waited"], pace["delay"]) == (4, 55.0, 10.0)


def test_export_reader(spark, tmp_path):
    root = tmp_path / "e" / "nested"
    for folder in ("files", "scenes", "movies"):
        (root / folder).mkdir(parents=True)
    (root / "files" / "b.json").write_text(json.dumps({"type": "basic", "path": "x", "size": 3, "fingerprints": [{"type": "MD5", "fingerprint": "AB"}, {"type": "md5", "fingerprint": "cd"}]}))
    (root / "files" / "a.json").write_text(json.dumps({"type": "folder", "path": "y"}))
    (root / "files" / "c.json").write_text("{broken")
    (root / "files" / "d.json").write_text("[1]")
    assert export.folder_root(spark, str(tmp_path / "e")).endswith(str(root))
    schema = "type string, path string, size long, fingerprints array<struct<type:string,fingerprint:string>>"
    files = export.json_folder(spark, str(root / "files"), schema)
    assert [r["path"] for r in files.orderBy("ordinal").collect()] == ["y", "x"]
    index = export.file_index(files).collect()
    assert [(r["path"], r["size"], r["fingerprints"]) for r in index] == [("x", 3, {"md5": "cd"})]
    assert export.json_folder(spark, str(root / "absent"), schema).count() == 0
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../out.json", "{}")
    with pytest.raises(Exception, match="outside"):
        export.zip_root(spark, str(bad))
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "files").iterdir()):
            z.write(f, f"top/files/{f.name}")
        z.writestr("top/scenes/s.json", '{"id": "1"}')
        z.writestr("top/files/deeper/no.json", '{"path": "no"}')
        z.writestr("top/files/z.json", b"\xff{}")
    assert export.zip_root(spark, str(good)) == "top/"
    unpacked = export.export_rows(spark, str(good), "files", schema)
    assert [r["path"] for r in unpacked.orderBy("ordinal").collect()] == ["y", "x"]
    assert [r["path"] for r in export.export_rows(spark, str(tmp_path / "e"), "files", schema).orderBy("ordinal").collect()] == ["y", "x"]
    assert export.export_rows(spark, str(good), "groups", schema).count() == 0
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("a/files/x.json", "{}")
    with pytest.raises(ValueError, match="0 export roots"):
        export.zip_root(spark, str(bad))


def test_scans_prune_and_push(spark, data):
    plan = spark.read.parquet(f"{data}/documents.parquet").where("doc_id = 42").select("doc_id", "lang")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in plan
    assert "text" not in plan.split("ReadSchema:")[1].split(">")[0]
