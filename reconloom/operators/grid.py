"""Equi joins in cells of bounded size, whatever the number of rows that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.sources.durable import durable

#: Most rows of either side, about, that one cell compares.
CELL = 4096


def joined(a: DataFrame, b: DataFrame, key: str, left: str, right: str, cell: int = CELL) -> DataFrame:
    """``a`` join ``b`` on ``key``; keys with more than ``cell`` rows on a side are dealt to a grid of cells.

    Rows of such a key go by a hash of ``left`` (of ``a``) or ``right`` (of ``b``) to a row or column of the grid, so each
    pair meets once, in one of many tasks. The crowded keys are counted first, with partial sums, and written as a
    table, which Spark broadcasts only while its own size check allows it. Rows with a null key meet nothing.

    The sides themselves are sorted, never broadcast: keys are exploded from narrow tables, whose size on disk, which
    is all that Spark knows before it runs, says nothing of the rows that the driver would have to hold.
    """
    many = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > cell)
    crowded = many(a, "_rows").join(many(b, "_columns"), key, "full").where(F.col(key).isNotNull())
    grid = durable(crowded.select(F.col(key).alias("_key"), *[F.coalesce(F.ceil(F.col(c) / cell), F.lit(1)).cast("int").alias(c) for c in ("_rows", "_columns")]), "grid")
    if grid.isEmpty():
        return a.join(b.hint("merge"), key)

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        wide = df.join(grid, F.col(key) == F.col("_key"), "left").drop("_key").fillna(1, ["_rows", "_columns"])
        placed = wide.withColumn(f"{own}_at", F.pmod(F.xxhash64(by), F.col(own)).cast("int")).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return placed.drop("_rows", "_columns")

    return dealt(a, left, "_rows", "_columns").join(dealt(b, right, "_columns", "_rows").hint("merge"), [key, "_rows_at", "_columns_at"]).drop("_rows_at", "_columns_at")
