"""Incremental scans as streams: a ledger of what was done, so that a batch that runs again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def ledger(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all finished batches with their ``batch_id``; none before the first."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*struct.fields, *StructType.fromDDL("batch_id long").fields])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def process_batch(batch: DataFrame, batch_id: int, path: str, decide: Callable[[DataFrame], DataFrame], schema: StructType | str, id: str = "id") -> None:
    """Decide on the ids of one micro-batch that no other batch has decided on, and write them as the batch's part of the ledger.

    The part is written over, and other parts decide which ids are new, so a batch that is run again after a failure,
    even one after its write, gives the same part and no second decision. Null ids are left out, an id that comes
    twice in a batch counts once (its smallest row)."""
    spark = batch.sparkSession
    done = ledger(spark, path, schema).where(F.col("batch_id") != batch_id).select(id)
    rows = batch.where(F.col(id).isNotNull())
    once = rows.groupBy(id).agg(F.min(F.struct(*[F.col(c) for c in rows.columns if c != id])).alias("_r")).select(id, "_r.*") if len(rows.columns) > 1 else rows.distinct()
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    decide(once.join(done, id, "left_anti")).select(*struct.names).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def incremental_scan(source: DataFrame, path: str, decide: Callable[[DataFrame], DataFrame], schema: StructType | str, checkpoint: str, id: str = "id", available_now: bool = True) -> StreamingQuery:
    """A stream of rows with an ``id``; ``decide`` gives the rows of ``schema`` for those that are new."""
    writer = source.writeStream.foreachBatch(lambda df, k: process_batch(df, k, path, decide, schema, id)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def on_created(events: DataFrame, path: str, decide: Callable[[DataFrame], DataFrame], schema: StructType | str, checkpoint: str, enabled: bool = False) -> StreamingQuery | None:
    """The hook on new images as a stream of ``id, body`` (JSON payloads): the image that a payload names is decided on.

    Off unless ``enabled``: then nothing is read. Payloads that name no image are passed over, repeated ones change nothing."""
    if not enabled:
        return None
    from reconloom.plans.tasks import hook_image_ids

    def images(batch: DataFrame) -> DataFrame:
        return hook_image_ids(batch).where("image_id is not null").select(F.col("image_id").alias("id")).distinct()

    writer = events.writeStream.foreachBatch(lambda df, k: process_batch(images(df), k, path, decide, schema)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
