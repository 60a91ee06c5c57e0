"""Reading an export: a folder or ZIP of JSON objects, one in each file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reconloom.functions.normalize import fingerprint_type, posix_path
from reconloom.operators.names import ranked
from reconloom.operators.winner import first_of


def json_folder(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row for each file that holds a JSON object, with ``source_path`` and ``ordinal`` in path order.

    Unreadable and other files are left out; a missing folder is an empty table.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    empty = spark.createDataFrame([], StructType([*struct.fields, *StructType.fromDDL("source_path string, ordinal long").fields]))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return empty
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select("value", F.col("_metadata.file_path").alias("source_path"))
    return _objects(files, schema)


def _objects(files: DataFrame, schema: StructType | str) -> DataFrame:
    """The texts (``value, source_path``) that are JSON objects, parsed and numbered by path."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = files.where(F.trim(F.regexp_replace("value", r"^\s+", "")).startswith("{") & F.is_valid_utf8("value")).withColumn("_v", F.try_parse_json("value")).where("_v is not null").withColumn("_r", F.from_json("value", struct))
    return ranked(parsed.where("_r is not null").select("_r", "source_path"), F.col("source_path"), name="ordinal").select("_r.*", "source_path", "ordinal")


def first_non_empty(*frames: DataFrame) -> DataFrame:
    """The first table that has a row, else the last."""
    for df in frames[:-1]:
        if not df.isEmpty():
            return df
    return frames[-1]


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip")


def zip_members(spark: SparkSession, path: str, inside: str = "", suffix: str = ".json", values: bool = True) -> DataFrame:
    """``archive, member, value`` of the text members of the ZIP files at ``path`` whose names start and end so, read by the executors.

    Nothing is unpacked: a task gets an archive through Spark's own reader (so it may lie in any store, up to the 2 GB
    that Spark reads as one value), looks up the central directory and inflates member after member. A member whose
    name would leave the archive is an error, whether it is asked for or not; folders and members that are not UTF-8
    are left out. Without ``values`` the members are only listed."""
    whole = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(memoryview(content.as_buffer()))) as z:
                    listed = z.infolist()
                    for m in listed:
                        if m.filename.startswith(("/", "\\")) or ".." in m.filename.replace("\\", "/").split("/"):
                            raise ValueError(f"member outside of the archive: {m.filename}")
                    for m in listed:
                        if not m.is_dir() and m.filename.startswith(inside) and m.filename.lower().endswith(suffix):
                            try:
                                text = z.read(m).decode("utf-8") if values else None
                            except UnicodeDecodeError:
                                continue
                            yield pa.RecordBatch.from_pydict({"archive": [archive.as_py()], "member": [m.filename], "value": pa.array([text], pa.string())})

    return whole.mapInArrow(read, "archive string, member string, value string")


def zip_root(spark: SparkSession, path: str) -> str:
    """The folder of a ZIP that holds ``files`` and ``scenes`` or ``images``: its top, or the only one below it."""
    member = F.col("member")
    parts = F.split(member, "/")
    below = F.explode(F.array(F.struct(F.lit("").alias("root"), F.get(parts, F.lit(0)).alias("kind")), F.struct(F.concat(F.get(parts, F.lit(0)), F.lit("/")).alias("root"), F.get(parts, F.lit(1)).alias("kind"))))
    kinds = zip_members(spark, path, suffix="", values=False).select(below.alias("_b")).select("_b.*").where(F.col("kind").isin("files", "scenes", "images")).distinct()
    found = sorted(r["root"] for r in kinds.groupBy("root").agg(F.collect_set("kind").alias("k")).where(F.array_contains("k", "files") & (F.size("k") > 1)).limit(100).collect())
    if "" in found:
        return ""
    if len(found) != 1:
        raise ValueError(f"{len(found)} export roots in {path}")
    return found[0]


def export_rows(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """The objects of one kind (``files``, ``scenes``, ...) of an export, a folder or a ZIP, as ``json_folder`` gives them."""
    if not is_zip(path):
        return json_folder(spark, f"{folder_root(spark, path)}/{kind}", schema)
    root = zip_root(spark, path)
    inside = f"{root}{kind}/"
    members = zip_members(spark, path, inside).where(~F.contains(F.substr("member", F.lit(len(inside) + 1)), F.lit("/")))
    return _objects(members.select("value", F.col("member").alias("source_path")), schema)


def folder_root(spark: SparkSession, path: str) -> str:
    """The root of an export folder: itself if it has ``files`` and ``scenes`` or ``images``, or the only child that is one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    here = jvm.Path(path)
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda p, name: files.isDirectory(jvm.Path(p, name))
    is_root = lambda p: has(p, "files") and (has(p, "scenes") or has(p, "images"))
    if is_root(here):
        return path
    found = sorted(s.getPath().toString() for s in files.listStatus(here) if s.isDirectory() and is_root(s.getPath()))
    if len(found) != 1:
        raise ValueError(f"{len(found)} export roots below {path}")
    return found[0]


def file_index(files: DataFrame) -> DataFrame:
    """``path, size, fingerprints``: the last row of each path, its last value of each fingerprint type; folders and blank paths left out.

    ``files``: ``ordinal, type, path, size, fingerprints[{type, fingerprint}]``."""
    real = files.where((F.lower(F.coalesce("type", F.lit(""))) != "folder") & F.col("path").isNotNull() & (F.trim("path") != ""))
    last = first_of(real, ["path"], F.col("ordinal").desc())
    flat = last.select("path", F.posexplode("fingerprints").alias("_p", "_f")).select("path", "_p", fingerprint_type(F.col("_f.type")).alias("t"), F.lower(F.trim("_f.fingerprint")).alias("v")).where("v <> ''")
    kept = first_of(flat, ["path", "t"], F.col("_p").desc()).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "v")))).alias("_m"))
    return last.select("path", "size").join(kept, "path", "left").select("path", "size", F.coalesce("_m", F.create_map().cast("map<string,string>")).alias("fingerprints"))


def long_fingerprints(files: DataFrame) -> DataFrame:
    """``id, path, size, fp_type, fp_value`` of objects with ``files[{path, size, fingerprints[{type, value}]}]``."""
    each = files.select("id", F.explode_outer("files").alias("f")).select("id", posix_path("f.path").alias("path"), F.col("f.size").alias("size"), F.explode_outer("f.fingerprints").alias("p"))
    return each.select("id", "path", "size", fingerprint_type(F.col("p.type")).alias("fp_type"), F.lower(F.trim("p.value")).alias("fp_value"))
