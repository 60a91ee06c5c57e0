"""Segment joins, grids of cells and bands against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from reconloom.operators import fuzzy, grid, hamming, segments
from reconloom.sources.durable import durable


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def _damaged(rng, s, edits):
    for _ in range(edits):
        k = rng.randrange(len(s) + 1)
        s = s[:k] + rng.choice("abcdeé ") + s[k:] if rng.random() < 0.5 else s[:k] + s[k + 1 :]
    return s


@pytest.mark.parametrize(("least", "window", "min_length"), [(0.97, 3, 1), (0.9, 6, 4), (0.8, 2, 5), (0.6, 4, 1), (0.3, 3, 1)])
def test_segments_find_what_all_pairs_hold(spark, least, window, min_length):
    rng = random.Random(int(100 * least))
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20, 34]))) for _ in range(60)]
    left = sorted({_damaged(rng, s, rng.randrange(5)) for s in base for _ in range(2)} | {"", "x" * 300 + "abc"})
    right = sorted(set(base) | {_damaged(rng, s, 2) for s in base} | {"", "x" * 299 + "abd"})
    a, b = spark.createDataFrame([(x,) for x in left], "left_norm string"), spark.createDataFrame([(x,) for x in right], "right_norm string")
    got = {(r[0], r[1]): r[2] for r in segments.similar(a, b, window, least - 1e-9, min_length).collect()}
    want = {(x, y): _ratio(x, y) for x in left for y in right if len(x) >= min_length and y and x[:1] == y[:1] and abs(len(x) - len(y)) <= window and _ratio(x, y) >= least - 1e-9}
    assert got == want and want


def test_segments_equal_blocks_on_many_names_and_look_at_few(spark):
    rng = random.Random(3)
    part = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 6))) for _ in range(900)]
    names = sorted({" ".join(rng.choice(part) for _ in range(3)) for _ in range(20_000)})
    left = [_damaged(rng, s, 1) for s in rng.sample(names, 500)]
    a, b = spark.createDataFrame([(x,) for x in left], "left_norm string").distinct(), spark.createDataFrame([(x,) for x in names], "right_norm string")
    blocks = fuzzy.candidates(a, b, 3, 0.9, 5, 0.03).withColumn("score", segments.sequence_ratio("left_norm", "right_norm")).where(F.col("score") >= 0.9 - 0.03 - 1e-9)
    assert {tuple(r) for r in fuzzy.scored(a, b, 3, 0.9, 5, 0.03).select("left_norm", "right_norm", "score").collect()} == {tuple(r) for r in blocks.select("left_norm", "right_norm", "score").collect()}
    met = segments.sought(a, 3, 0.87, 5).join(segments.held(b, 3, 0.87), "key").count()
    block = sum(x[:1] == y[:1] and abs(len(x) - len(y)) <= 3 for x in left for y in names)
    assert 8 * met < block  # each place meets the few that share a segment, even with names of three short words


def test_work_grows_with_the_names(spark):
    """Ten times the names: about ten times the rows that segments meet, where each name has its near copies."""
    counts = []
    for n in (2_000, 20_000):
        rows = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("left_norm"))
        counts.append(segments.sought(rows, 3, 0.9, 5).join(segments.held(rows.withColumnRenamed("left_norm", "right_norm"), 3, 0.9), "key").count())
    assert counts[1] < 14 * counts[0]


def test_crowded_keys_meet_once_in_cells(spark):
    a = spark.createDataFrame([(k % 3 if k < 40 else 7 + k, k) for k in range(60)] + [(None, 99)], "key int, x long")
    b = spark.createDataFrame([(k % 2, k) for k in range(50)] + [(None, 99)], "key int, y long")
    got = sorted(tuple(r) for r in grid.joined(a, b, "key", "x", "y", cell=4).select("key", "x", "y").collect())
    assert got == sorted(tuple(r) for r in a.join(b, "key").select("key", "x", "y").collect())


def test_exploded_keys_are_not_broadcast(spark):
    """Two written tables of 2,000 rows: by their size Spark takes either for small, but their keys are 100,000 rows."""
    narrow = durable(spark.range(2000).select(F.col("id").alias("x")), "narrow")
    keyed = narrow.withColumn("key", F.explode(F.sequence(F.col("x") * 50, F.col("x") * 50 + 49)))
    met = grid.joined(keyed, keyed.withColumnRenamed("x", "y"), "key", "x", "y")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.where("x = y").count() == met.count() == 100_000


def test_segments_with_crowded_keys(spark):
    names = [f"abcdefgh{k:03d}" for k in range(150)]
    a = spark.createDataFrame([(x,) for x in names], "left_norm string")
    b = a.withColumnRenamed("left_norm", "right_norm")
    got = {(r[0], r[1]) for r in segments.pairs(a, b, 1, 0.8, 1, cell=8).collect()}
    assert got >= {(x, y) for x in names for y in names if _ratio(x, y) >= 0.8}


@pytest.mark.parametrize("parts", [0, 1, 3, 4, 7])
def test_each_kind_of_bands(spark, monkeypatch, parts):
    rng = random.Random(parts)
    rows = []
    for k in range(25):
        x = rng.getrandbits(64)
        rows.append((k, x))
        for p in rng.sample(range(64), k % 6):
            x ^= 1 << p
        rows.append((100 + k, x))
    radius = 2 if parts == 1 else 4
    monkeypatch.setattr(hamming, "plan", lambda r, m, n: hamming.Bands(parts, r // parts if parts else 0, 0, 0))
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in rows], "id long, bits long")
    got = {(r[0], r[1]): r[2] for r in hamming.within_radius(df, df, radius).collect()}
    assert got == {(i, j): (a ^ b).bit_count() for i, a in rows for j, b in rows if (a ^ b).bit_count() <= radius}


def test_bands_follow_the_number_of_hashes():
    small, large = hamming.plan(5, 10**4, 10**4), hamming.plan(5, 10**8, 10**8)
    assert large.parts < small.parts and large.compared < 1e12  # ten-bit bands make 6e13
    assert hamming.plan(5, 10**9, 10**9).compared / large.compared < 150
    assert hamming.plan(64, 1000, 1000).parts == 0 and hamming.plan(0, 10**8, 10**8).flips == 0


def test_equal_hashes_are_dealt_and_counted(spark):
    """All rows have one hash: the pairs come from many cells, and the nearest is decided without pairs."""
    df = spark.range(6000).withColumn("bits", F.lit(5).cast("long"))
    near = hamming.within_radius(df.where("id < 3"), df, 3)
    assert near.count() == 3 * 6000
    assert hamming.unique_nearest(df, df, 3).count() == 0
    two = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 1 << 40), (5, None)], "id long, bits long")
    assert {tuple(r) for r in hamming.unique_nearest(two, two, 3).collect()} == {(1, 2, 0), (2, 1, 0)}
    assert hamming.unique_nearest(two, two, 3, margin=2).count() == 0
