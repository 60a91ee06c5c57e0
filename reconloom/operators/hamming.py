"""Pairs of 64-bit hashes within a Hamming radius, by bands whose width follows the number of hashes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconloom.functions.normalize import hamming
from reconloom.operators.grid import CELL, joined
from reconloom.sources.durable import durable

#: Most values that one hash may look up, and what an exchanged row costs in comparisons.
MOST_PROBES, ROW_COST = 1024, 10


@dataclass(frozen=True)
class Bands:
    """``parts`` bands, looked up with up to ``flips`` bits turned; no bands (``parts`` 0): all values in blocks."""

    parts: int
    flips: int
    rows: float
    compared: float

    @property
    def cost(self) -> float:
        return ROW_COST * self.rows + self.compared

    @property
    def edges(self) -> list[int]:
        return [64 * k // self.parts for k in range(self.parts + 1)]


def plan(radius: int, left: int, right: int) -> Bands:
    """The cheapest bands for so many different hashes on either side.

    Of m bands one differs in at most radius // m bits, so looking up each band's value with that many bits turned
    finds every pair. Wide bands compare fewer hashes but look up more values; about log2(right) bits are best. Where
    a radius is so wide that bands no longer select, values are compared in blocks, which is then the cheapest."""
    blocks = Bands(0, 0, left * ceil(right / CELL) + right * ceil(left / CELL), left * right)
    choices = [blocks]
    for m in range(1, 65):
        width, flips = ceil(64 / m), radius // m
        probes = sum(comb(width, j) for j in range(flips + 1))
        if m * probes <= MOST_PROBES:
            met = m * left * probes
            choices.append(Bands(m, flips, met + m * right, met * right / 2 ** (64 // m)))
    return min(choices, key=lambda c: (c.cost, c.parts))


def _band(c: str, start: int, stop: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(c, 64 - stop), 64 - stop + start)


def _turned(k: int, value: Column, masks: list[int]) -> Column:
    """Keys of a band's value with the bits of each mask turned."""
    return F.transform(F.array(*map(F.lit, masks)).cast("array<long>"), lambda m: F.struct(F.lit(k).alias("band"), value.bitwiseXOR(m).alias("value")))


def values_within(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """``_a, _b, distance`` of the different values ``_a`` of ``left`` and ``_b`` of ``right`` (written tables) at most ``radius`` apart, each once."""
    left, right = left.select("_a"), right.select("_b")
    held, sought = left.count(), right.count()
    chosen = plan(radius, held, sought)
    # a value has a key once, so no key can have more rows than there are values
    meet = joined if max(held, sought) > CELL else lambda x, y, key, *_: x.join(y, key)
    if not chosen.parts:
        one = lambda df: df.withColumn("key", F.lit(0))
        met = meet(one(left), one(right), "key", "_a", "_b")
    else:
        seek, hold = [], []
        for k, (start, stop) in enumerate(zip(chosen.edges, chosen.edges[1:], strict=False)):
            masks = [sum(1 << b for b in bits) for j in range(chosen.flips + 1) for bits in combinations(range(stop - start), j)]
            masks = [m - (1 << 64) if m >> 63 else m for m in masks]
            seek.append(_turned(k, _band("_a", start, stop), masks))
            hold.append(F.struct(F.lit(k).alias("band"), _band("_b", start, stop).alias("value")))
        met = meet(left.withColumn("key", F.explode(F.flatten(F.array(*seek)))), right.withColumn("key", F.explode(F.array(*hold))), "key", "_a", "_b")
    near = met.withColumn("distance", hamming(F.col("_a"), F.col("_b"))).where(F.col("distance") <= radius).select("_a", "_b", "distance")
    return near.distinct() if chosen.parts > 1 else near


def _values(rows: DataFrame, bits: str, name: str) -> DataFrame:
    """Different values, and how many rows have each."""
    return durable(rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias(name)).agg(F.count("*").alias("n")), "hash-values")


def _checked(radius: int) -> None:
    if not 0 <= radius <= 64:
        raise ValueError(f"radius {radius} is not between 0 and 64")


def within_radius(left: DataFrame, right: DataFrame, radius: int, id: str = "id", bits: str = "bits") -> DataFrame:
    """``left_id, right_id, distance`` for all pairs at most ``radius`` (0 to 64) apart, numbered by distance and id by
    ``in_order``; null hashes pair with nothing, repeated rows count once.

    Different values are compared once, however many rows have them, by bands sized from their numbers (``plan``); ids
    are joined to the pairs of values, and if very many rows share a value, in a grid of cells.
    """
    _checked(radius)
    a, b = _values(left, bits, "_a"), _values(right, bits, "_b")
    near = values_within(a, b, radius)
    own = left.where(F.col(bits).isNotNull()).select(F.col(id).alias("left_id"), F.col(bits).alias("_a")).distinct()
    other = right.where(F.col(bits).isNotNull()).select(F.col(id).alias("right_id"), F.col(bits).alias("_b")).distinct()
    crowded = not a.where(F.col("n") > CELL).isEmpty() or not b.where(F.col("n") > CELL).isEmpty()
    meet = joined if crowded else lambda x, y, key, *_: x.join(y, key)
    return meet(meet(own, near, "_a", "left_id", "_b"), other, "_b", "left_id", "right_id").select("left_id", "right_id", "distance").distinct()


def unique_nearest(left: DataFrame, right: DataFrame, radius: int, margin: int = 1, id: str = "id", bits: str = "bits") -> DataFrame:
    """``left_id, right_id, distance``: the only nearest other row within ``radius``, if the next distance is at least ``margin`` more.

    A value's rows are counted, not listed: for each value of ``left`` and each distance it is known how many rows of
    ``right`` there are and which id is the smallest and the largest, so copies in any number cost no pairs. A row of
    ``right`` with the id of the left row does not count; an id with several hashes is a row for each."""
    _checked(radius)
    near = values_within(_values(left, bits, "_a"), _values(right, bits, "_b"), radius)
    rows = right.where(F.col(bits).isNotNull()).select(F.col(id).alias("right_id"), F.col(bits).alias("_b")).distinct()
    owners = rows.groupBy("_b").agg(F.count("*").alias("n"), F.min("right_id").alias("low"), F.max("right_id").alias("high"))
    at = near.join(owners, "_b").groupBy("_a", "distance").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    by_value = at.groupBy("_a").agg(F.array_sort(F.collect_list(F.struct("distance", "n", "low", "high"))).alias("at"))  # a row for each distance at most
    own = left.where(F.col(bits).isNotNull()).select(F.col(id).alias("left_id"), F.col(bits).alias("_a")).distinct()
    itself = rows.select(F.col("right_id").alias("left_id"), F.col("_b").alias("_self"))
    # an id may have several hashes: each of its rows within the radius is taken off at its distance
    offs = own.join(itself, "left_id").withColumn("distance", hamming(F.col("_a"), F.col("_self"))).where(F.col("distance") <= radius).groupBy("left_id", "_a").agg(F.collect_list("distance").alias("off"))
    full = own.join(offs, ["left_id", "_a"], "left").join(by_value, "_a")
    off = F.coalesce("off", F.array().cast("array<int>"))
    rest = F.transform("at", lambda x: F.struct(x["distance"].alias("distance"), (x["n"] - F.size(F.filter(off, lambda d: d == x["distance"]))).alias("n"), F.when(x["low"] == F.col("left_id"), x["high"]).otherwise(x["low"]).alias("id")))
    left_over = full.withColumn("_rest", F.filter(rest, lambda x: x["n"] > 0)).where(F.size("_rest") > 0)
    first, then = F.get("_rest", F.lit(0)), F.get("_rest", F.lit(1))
    only = (first["n"] == 1) & (then["distance"].isNull() | (then["distance"] - first["distance"] >= max(1, margin)))
    return left_over.where(only).select("left_id", first["id"].alias("right_id"), first["distance"].alias("distance"))


def in_order(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``place``: for each left id the nearest is first, equal distances go by id as text."""
    nearest = Window.partitionBy("left_id").orderBy("distance", F.col("right_id").cast("string"))
    return pairs.withColumn("place", F.row_number().over(nearest).cast("long"))
