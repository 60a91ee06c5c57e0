"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reconloom.llm.common import fresh, text_slices, words
from reconloom.sources.durable import durable, release

#: Ranges that a source's keys are cut into; each is sorted by itself.
BUCKETS = 1024
#: Passes that fill what the document at the border leaves open.
FILLS = 3
_SYMBOLS = re.compile(r"[!*$%#&|<>{}]")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``size`` (words) and ``weight`` (quality: words among words and symbols)."""
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*keep, *StructType.fromDDL("size long, weight double").fields])

    def apply(batches):
        for batch, texts in text_slices(batches, text):
            n = [len(words(t)) for t in texts]
            odd = [len(_SYMBOLS.findall(t)) if t else 0 for t in texts]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array([(1 + a) / (1 + a + b) for a, b in zip(n, odd, strict=True)], pa.float64())], names=schema.names)

    return docs.mapInArrow(apply, schema)


def targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. That is one water level: with
    sources in order of ``most * size / weight``, those below the level are full
    and the rest get level times weight. One row for each source.
    """
    k = len(weights)
    ranked = totals.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") % k + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(order), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(order), F.lit(0.0)))
    leveled = w.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    return leveled.select("source", "source_size", F.round(F.least(F.col("_cap"), F.coalesce(F.max("_level").over(every) * F.col("_w"), F.col("_cap"))), 6).alias("target"))


def decide(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "", doc_id: str = "doc_id", source: str = "source", text: str = "text", quality: str | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, source, mark, rows, size, source_size, target, copies``: one
    row for each different (id, source, text), ``rows`` of them equal; equal rows
    are taken alike. ``mark`` is a hash of text and source for joining back.

    Every document is taken ``floor(target / source_size)`` times, complete
    epochs; the rest of the target is filled in the order of -ln(u) / quality
    weight, with u a hash of the id, so reruns agree. Keys fall into ranges whose
    sums are added up first, so no task sorts a whole source; documents that no
    longer fit are passed over, in three passes. Null texts and sources are
    valid: size 0, and a source of their own. ``quality`` names the column with
    the quality weight (larger: sooner; null, negative and zero: last); without it
    the weight is the share of words among words and symbols. An empty table gives
    an empty one; further columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text), F.col(source)).alias("mark"), F.col(text).alias("text"))
    if quality is not None:
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text), F.col(source)).alias("mark"), F.greatest(F.coalesce(F.col(quality).cast("double"), F.lit(0.0)), F.lit(1e-12)).alias("given"), F.col(text).alias("text"))
    sized = sizes(rows).groupBy("doc_id", "source", "mark").agg(F.count("*").alias("rows"), F.first("size").alias("size"), F.max("weight" if quality is None else "given").alias("weight"))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    key = -F.log(u) / F.col("weight")
    base = durable(sized.withColumn("key", key).withColumn("bucket", F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("key")))).cast("int")).withColumn("need", F.col("size") * F.col("rows")).drop("weight"), "mix-sized")
    goal = durable(targets(base.groupBy("source").agg(F.sum("need").alias("source_size")), weights, most), "mix-targets")
    state = base.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    state = state.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long"))
    state = state.withColumn("gap", F.col("target") - F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) * F.col("source_size")).withColumn("extra", F.lit(0).cast("long"))
    for _ in range(FILLS):
        state = durable(_filled(state), "mix-state")
    release(base, goal)
    return state.select("doc_id", "source", "mark", "rows", "size", "source_size", "target", (F.col("copies") + F.col("extra")).alias("copies"))


def _filled(state: DataFrame) -> DataFrame:
    """One pass: untaken documents that fit the gap, in key order, while their sum does; the gap shrinks by what they take."""
    open_ = (F.col("extra") == 0) & (F.col("need") > 0) & (F.col("need") <= F.col("gap"))
    need = F.when(open_, F.col("need")).otherwise(F.lit(0))
    sums = state.groupBy("source", "bucket").agg(F.sum(need).alias("_sum"))
    starts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.sum("_sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("_sum")).alias("_before"))
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    placed = state.withColumn("_upto", F.sum(need).over(own)).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    taken = placed.withColumn("extra", F.when(open_ & (F.col("_before") + F.col("_upto") <= F.col("gap")), F.lit(1).cast("long")).otherwise(F.col("extra")))
    used = taken.groupBy("source").agg(F.sum(F.col("extra") * F.col("need")).alias("_used")).select(F.col("source").alias("_u"), "_used")
    rest = taken.drop("_s", "_b", "_before", "_upto").join(used, F.col("source").eqNullSafe(F.col("_u")))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) * F.col("source_size")
    return rest.withColumn("gap", F.col("target") - whole - F.col("_used")).drop("_u", "_used").select(*state.columns)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as ``decide`` says, with the columns of ``docs``.

    Takes the options of ``decide``. Equal rows are taken alike, each as often as the others; rows with null ids,
    texts or sources are mixed like others. An empty table gives an empty one; columns keep their names, whatever they are.
    """
    chosen = decide(docs, **options).where("copies > 0")
    d, s, t = options.get("doc_id", "doc_id"), options.get("source", "source"), options.get("text", "text")
    mark, own, other, copies, n = (fresh(docs, c) for c in ("mix_mark", "mix_id", "mix_other", "mix_copies", "mix_n"))
    marked = docs.withColumn(mark, F.xxhash64(F.col(t), F.col(s)))
    pairs = chosen.select(F.col("doc_id").alias(own), F.col("mark").alias(other), F.col("copies").alias(copies))
    both = marked.join(pairs, F.col(d).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(other)))
    return both.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
