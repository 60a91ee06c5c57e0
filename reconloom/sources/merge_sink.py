"""Merging entities in a foreign store in two phases: everything is staged first, then moved by chunks that a journal notes.

Folders of a merge, all written by Spark and so either whole or absent: ``plan`` (chunks of ids of the child collections
that move), ``sources`` (entities to delete, and where they went), ``journal/wave=N`` (chunks that are done), ``deleted``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one request.
CHUNK = 250
Assign = Callable[[str, str, str, list[str]], None]


class MergeSink:
    """A merge that can be killed at any time and resumed with the same folder.

    ``assign(token, collection, destination_id, ids)`` moves children and ``delete(token, source_id)`` deletes an entity;
    both run on executors. A chunk that was sent but not noted before a crash is sent again under the same token;
    setting ids to one destination twice changes nothing, and a store that counts can tell by the token."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _whole(self, name: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def stage(self, merges: DataFrame, children: dict[str, tuple[DataFrame, str, str]], chunk: int = CHUNK) -> None:
        """Collect what moves before anything does. ``merges``: ``source_id, destination_id``; ``children``: by collection the
        table, its id column and its foreign key. A stage that is complete is kept, one that is not is written anew.

        Chunks are cut from hash buckets of a destination's ids, so no task holds all children of an entity and few
        chunks are short. Null ids and keys do not move; an entity merged into itself is an error."""
        if self._whole("plan"):
            return
        if not merges.where("source_id = destination_id").isEmpty():
            raise ValueError("an entity is merged into itself")
        moves = None
        for name, (rows, id_, key) in children.items():
            own = rows.select(F.col(id_).cast("string").alias("id"), F.col(key).alias("source_id")).where("id is not null").join(merges, "source_id")
            part = own.select(F.lit(name).alias("collection"), F.col("destination_id").cast("string").alias("destination_id"), "id").distinct()
            moves = part if moves is None else moves.unionByName(part)
        each = moves.groupBy("collection", "destination_id").agg(F.count("*").alias("_n")).withColumn("_b", F.greatest(F.lit(1), F.ceil(F.col("_n") / (64 * chunk))).cast("int"))
        dealt = moves.join(each, ["collection", "destination_id"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
        sets = dealt.groupBy("collection", "destination_id", "bucket").agg(F.array_sort(F.collect_list("id")).alias("_ids"))  # about 64 chunks
        starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / chunk).cast("int")), lambda k: F.struct(k.alias("k"), F.slice("_ids", k * chunk + 1, chunk).alias("ids")))
        cut = sets.select("collection", "destination_id", "bucket", F.explode(starts).alias("_c"))
        token = F.concat_ws("/", "collection", "destination_id", F.col("bucket").cast("string"), F.col("_c.k").cast("string"))
        merges.select(F.col("source_id").cast("string").alias("source_id"), F.col("destination_id").cast("string").alias("destination_id")).distinct().write.mode("overwrite").parquet(f"{self.folder}/sources")
        cut.select(token.alias("token"), "collection", "destination_id", F.col("_c.ids").alias("ids")).write.mode("overwrite").parquet(f"{self.folder}/plan")

    def plan(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/plan")

    def done(self) -> DataFrame:
        """Tokens of the chunks that are noted."""
        waves = self._waves()
        return self.spark.read.parquet(*[f"{self.folder}/journal/wave={k}" for k in range(waves)]) if waves else self.spark.createDataFrame([], "token string")

    def _waves(self) -> int:
        k = 0
        while self._whole(f"journal/wave={k}"):
            k += 1
        return k

    def run(self, assign: Assign, delete: Callable[[str, str], None], wave: int = 10_000) -> None:
        """Send what is not noted yet, ``wave`` chunks between two notes, and delete the sources when nothing is left."""
        if not self._whole("plan"):
            raise RuntimeError("the merge is not staged")
        while True:
            left = self.plan().join(self.done(), "token", "left_anti").limit(wave)
            if left.isEmpty():
                break

            def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        assign(row["token"], row["collection"], row["destination_id"], row["ids"])
                        yield pa.RecordBatch.from_pydict({"token": [row["token"]]})

            left.repartition(max(1, min(64, wave // 16))).mapInArrow(send, "token string").write.mode("overwrite").parquet(f"{self.folder}/journal/wave={self._waves()}")
        if not self._whole("deleted"):

            def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for source in batch.column(0).to_pylist():
                        delete(f"delete/{source}", source)
                    yield batch

            self.spark.read.parquet(f"{self.folder}/sources").select("source_id").mapInArrow(remove, "source_id string").write.mode("overwrite").parquet(f"{self.folder}/deleted")
