"""Paged collections as a data source: a partition is a range of pages, equality filters and a limit go to the server.

A client is a function ``fetch(page, per_page, where) -> (count, rows)``, named as ``module:function`` so that executors
can load it: ``page`` counts from 1, ``where`` maps columns to the values they may have, ``count`` is that of all
rows that fit, ``rows`` are dicts. Pages are read until ``page * per_page`` reaches the count.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType


def _loaded(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Pages(InputPartition):
    first: int
    last: int
    rows: int


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.client = options["client"]
        self.per_page, self.pages_each = int(options.get("per_page", 100)), int(options.get("pages_each", 10))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.where: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (name of the interface)
        """Equality with values goes to the server, once for each column; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] not in self.where:
                self.where[f.attribute[0]] = list(f.value) if isinstance(f, In) else [f.value]
            else:
                yield f

    def partitions(self) -> list[Pages]:
        """One request for the count, then ranges of pages; a limit leaves pages out."""
        count, _ = _loaded(self.client)(1, self.per_page, self.where)
        wanted = count if self.limit is None else min(count, self.limit)
        pages, step = ceil(wanted / self.per_page), self.pages_each
        return [Pages(k, min(k + step - 1, pages), min(wanted, (min(k + step - 1, pages)) * self.per_page) - (k - 1) * self.per_page) for k in range(1, pages + 1, step)]

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        fetch, left = _loaded(self.client), partition.rows
        for page in range(partition.first, partition.last + 1):
            for row in fetch(page, self.per_page, self.where)[1][:left]:
                left -= 1
                yield tuple(row.get(n) for n in self.names)


class PagedSource(DataSource):
    """Options: ``client``, ``per_page`` (100), ``pages_each`` (10 pages a partition), ``limit``. The schema is the caller's."""

    @classmethod
    def name(cls) -> str:
        return "reconloom_paged"

    def schema(self) -> str:
        raise ValueError("a paged collection is read with a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def read_pages(spark: SparkSession, client: str, schema: StructType | str, limit: int | None = None, per_page: int = 100, pages_each: int = 10) -> DataFrame:
    """The rows of a paged collection; filters of the form column = value and column in (values) are pushed to the client.

    A page that is shorter than promised gives fewer rows; an empty collection gives none. The collection should not
    change while it is read: the count is asked for once."""
    from reconloom.sources.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    reader = spark.read.format(PagedSource.name()).schema(schema).option("client", client).option("per_page", per_page).option("pages_each", pages_each)
    return (reader if limit is None else reader.option("limit", limit)).load()
