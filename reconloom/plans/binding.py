"""Binding operators to the driver tables: a query in Spark and its DuckDB SQL under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reconloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


class Tables:
    """The tables of a data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register ``f(tables)`` as a query; ``sql`` may be made when it is asked for; without ``sql`` it is held against brute force in the tests."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


class Surrogate:
    """Rows that stand for a kind of entity, from a driver table: the same expressions in both engines."""

    def __init__(self, table: str, where: str = "1 = 1", **columns: str):
        self.table, self.where, self.columns = table, where, columns

    def df(self, t: Tables) -> DataFrame:
        return getattr(t, self.table).where(self.where).selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.table} WHERE {self.where})"


#: Parts as named entities whose spellings vary; five forms of 64 names.
NAMES = Surrogate(
    "part", id="p_partkey || ''", ordinal="p_partkey",
    name="CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'general:' || p_name WHEN 3 THEN '  ' || replace(p_name, ' ', '-') || '!' ELSE p_name || ' (' || p_brand || ')' END",
)
#: One entity for each brand and type, with an alias and a usage.
BRANDED = Surrogate(
    "part", id="p_partkey || ''", ordinal="p_partkey", usage="p_size",
    name="CASE p_partkey % 4 WHEN 0 THEN upper(p_type) || ' ' || p_brand WHEN 1 THEN lower(p_type) || '_' || lower(p_brand) WHEN 2 THEN p_type || '-' || p_brand ELSE p_type || p_brand END",
    alias="CASE WHEN p_partkey % 7 = 0 THEN p_name || p_brand WHEN p_partkey % 7 = 1 THEN p_type || ' ' || p_brand ELSE NULL END",
    rich="p_partkey % 11 = 0", signature="(p_partkey % 3) || ''",
)


def q_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def q_squeeze(e: str) -> str:
    return q_strip(rf"regexp_replace({e}, '\s+', ' ', 'g')")


def q_key(e: str) -> str:
    return q_strip(f"replace(lower({e}), 'ß', 'ss')")  # of all characters in the tables only the sharp s folds otherwise


_PREFIX = r"^\s*(?:artist|character|copyright|general|meta)\s*:\s*"


def q_tag_key(e: str) -> str:
    return q_strip(rf"regexp_replace(regexp_replace({q_key(e)}, '{_PREFIX}', ''), '[_\-\s]+', ' ', 'g')")


def q_entity(e: str) -> str:
    return q_squeeze(rf"regexp_replace(regexp_replace({q_key(e)}, '[_\-]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s()]+', ' ', 'g')")


def q_plain(e: str) -> str:
    return q_squeeze(rf"regexp_replace(regexp_replace({q_key(e)}, '[_\-]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g')")


def q_tag_cleanup(e: str) -> str:
    return q_plain(rf"regexp_replace({q_key(e)}, '{_PREFIX}', '')")


def q_compact(e: str) -> str:
    return rf"regexp_replace({e}, '[^\p{{L}}\p{{N}}]', '', 'g')"
