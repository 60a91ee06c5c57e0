"""What the corpus operators share: text batches, word splitting, fold of a row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of characters outside this set.
SPACES = " \t\n\x0b\x0c\r"


#: The largest non-negative hash.
MOST_HASH = (1 << 63) - 1


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


def words(text: str | None) -> list[bytes]:
    """UTF-8 words: ``bytes.split`` breaks at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that the texts of one slice have about ``size`` bytes, or are one text.

    Bounds the Python objects and the numpy scratch space of a task whatever the batch size."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def sampled(rows: DataFrame, total: int, most: int, *key: Column | str) -> DataFrame:
    """About ``most`` of ``total`` rows by a hash of ``key``, the same in every run; all where there are no more.

    The limit is a 63-bit number, so the share is as fine for 5e10 rows as for 5e4."""
    return rows if total <= most else rows.where(F.xxhash64(*key).bitwiseAND(F.lit(MOST_HASH)) < F.lit(hash_limit(total, most)))


def hash_limit(total: int, most: int) -> int:
    return (MOST_HASH + 1) * most // total


#: Bytes of the small side of a hash join that a task holds, on average.
HELD = 64 << 20


def hashed(texts: DataFrame, small: DataFrame, on: list[str], size: int, how: str = "inner") -> DataFrame:
    """Joins rows with long texts, unsorted, to hash tables of ``small``, of about ``size`` bytes, in as many tasks as
    keep HELD bytes of it or less each."""
    tasks = -(-size // HELD)
    if tasks > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        texts, small = texts.repartition(tasks, *on), small.repartition(tasks, *on)
    return texts.join(small.hint("shuffle_hash"), on, how)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def with_fields(df: DataFrame, more: str) -> StructType:
    """Schema of ``df`` followed by the fields of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def carry(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])
