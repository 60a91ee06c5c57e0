"""Similar strings by segments that survive, a lossless index for ratios of matching blocks.

A ratio of at least t leaves at most (1 - t)(a + b) characters of two strings
inserted or deleted. Cut the held string into one segment more than that: going
from the left, there is a first segment i before which exactly i characters were
inserted or deleted and in which none was. So it stands whole in the other string,
moved by -i, -i + 2, ... or i places, and whatever is left of the edits lies to its
right. An equi join on (first character, length, i, segment) finds every pair, and
a string looks at a handful of places for each length instead of at a whole block.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from reconloom.operators.grid import CELL, joined


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; not symmetric, so the incoming or earlier string stands left."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def edits(both: Column, least: float) -> Column:
    """Most insertions and deletions between strings of ``both`` characters together."""
    return F.floor(F.lit(1 - least) * both + F.lit(1e-9)).cast("int")


def _cuts(n: Column, window: int, least: float) -> tuple[Column, Column, Column]:
    """For a held string of ``n`` characters: the edits k, whether k + 1 segments fit, and their number."""
    k = edits(2 * n + window, least)
    fits = k + 1 <= n
    return k, fits, F.when(fits, k + 1).otherwise(1)


def held(rows: DataFrame, window: int, least: float) -> DataFrame:
    """``right_norm`` and its keys; a string too short for its segments has one empty segment."""
    n = F.length("right_norm")
    _, fits, parts = _cuts(n, window, least)
    edge = lambda i: F.floor(i * n / parts).cast("int")
    whole = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.substring("right_norm", 1, 1).alias("first"), n.alias("length"), i.alias("i"), F.when(fits, F.substr(F.col("right_norm"), edge(i) + 1, edge(i + 1) - edge(i))).otherwise("").alias("segment")))
    return rows.where(n >= 1).select("right_norm", F.explode(whole).alias("key"))


def sought(rows: DataFrame, window: int, least: float, min_length: int) -> DataFrame:
    """``left_norm`` and the keys under which similar strings are held."""
    a = F.length("left_norm")

    def places(n: Column) -> Column:
        k, fits, parts = _cuts(n, window, least)
        edge = lambda i: F.floor(i * n / parts).cast("int")
        key = lambda i, s: F.struct(F.substring("left_norm", 1, 1).alias("first"), n.alias("length"), i.alias("i"), F.when(fits, F.substr(F.col("left_norm"), edge(i) + s + 1, edge(i + 1) - edge(i))).otherwise("").alias("segment"))
        there = lambda i, s: ~fits | ((F.abs(a - n - s) <= k - i) & (edge(i) + s >= 0) & (edge(i + 1) + s <= a))
        moves = lambda i: F.transform(F.filter(F.sequence(-i, i, F.lit(2)), lambda s: there(i, s)), lambda s: key(i, s))
        return F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), moves))

    keys = F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(a - window, F.lit(1)), a + window), places)))
    return rows.where(a >= min_length).select("left_norm", F.explode(keys).alias("key"))


def pairs(left: DataFrame, right: DataFrame, window: int, least: float, min_length: int = 1, cell: int = CELL) -> DataFrame:
    """Different pairs ``left_norm, right_norm`` with one first character, lengths at most ``window`` apart and few enough
    edits (by Levenshtein's count, which is never more) that their ratio may reach ``least``.

    Keys with more than ``cell`` rows on a side are compared in a grid of cells (``grid.joined``).
    """
    a, b = sought(left.select("left_norm").distinct(), window, least, min_length), held(right.select("right_norm").distinct(), window, least)
    met = joined(a, b, "key", "left_norm", "right_norm", cell)
    n, m = F.length("left_norm"), F.length("right_norm")
    close = (F.abs(n - m) <= window) & (F.levenshtein("left_norm", "right_norm") <= edits(n + m, least))
    return met.where(close).select("left_norm", "right_norm").distinct()


def similar(left: DataFrame, right: DataFrame, window: int, least: float, min_length: int = 1) -> DataFrame:
    """``left_norm, right_norm, score``: the pairs whose ratio is at least ``least``, each once."""
    return pairs(left, right, window, least, min_length).withColumn("score", sequence_ratio("left_norm", "right_norm")).where(F.col("score") >= least)
