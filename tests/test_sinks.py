"""The paged source and the two-phase merge."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reconloom.sources import paged
from reconloom.sources.merge_sink import MergeSink


def test_pages_filters_and_limits(spark):
    rows = paged.read_pages(spark, "tests.paged_client:fetch", "id long, kind string, name string", per_page=50, pages_each=3)
    assert rows.rdd.getNumPartitions() == 9 and rows.agg(F.sum("id")).first()[0] == 1234 * 1235 // 2  # 25 pages
    odd = rows.where("kind = 'odd' and id > 1000")
    assert odd.count() == 117
    assert rows.where("kind = 'odd'").rdd.getNumPartitions() == 5  # 617 rows are 13 pages: the filter went to the client
    some = paged.read_pages(spark, "tests.paged_client:fetch", "name string, missing long", limit=120, per_page=50, pages_each=1)
    assert some.rdd.getNumPartitions() == 3 and some.count() == 120 and some.where("missing is not null").count() == 0
    assert rows.where("kind = 'none'").count() == 0
    with pytest.raises(Exception, match="server is gone"):
        paged.read_pages(spark, "tests.paged_client:broken", "id long").count()


def test_a_killed_merge_resumes(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    merges = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", "y")], "source_id string, destination_id string")
    scenes = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "c").otherwise("other").alias("studio"))
    images = spark.createDataFrame([(1, "b"), (2, None), (None, "b")], "id long, studio string")
    sink = MergeSink(spark, f"file://{tmp_path}/merge")
    with pytest.raises(RuntimeError, match="not staged"):
        sink.run(None, None)
    sink.stage(merges, {"scenes": (scenes, "id", "studio"), "images": (images, "id", "studio")}, chunk=100)
    planned = sink.plan().collect()
    assert sum(len(r["ids"]) for r in planned) == 2001 and max(len(r["ids"]) for r in planned) == 100 and len(planned) == 21
    where = str(store)

    def assign(token, collection, destination, ids, fail=False):
        path = Path(where) / token.replace("/", "_")
        if fail and len(list(Path(where).iterdir())) > 8:
            raise OSError("killed")
        with path.open("a") as f:
            f.write(f"{collection} {destination} {len(ids)}\n")

    def delete(token, source):
        (Path(where) / token.replace("/", "_")).write_text(source)

    with pytest.raises(Exception, match="killed"):
        sink.run(lambda *a: assign(*a, fail=True), delete, wave=4)
    noted = sink.done().count()
    assert 0 < noted < 21 and not list(store.glob("delete*"))  # nothing is deleted before all is moved
    again = MergeSink(spark, f"file://{tmp_path}/merge")
    again.stage(merges.limit(0), {}, chunk=100)  # what is staged stays
    again.run(assign, delete, wave=4)
    files = {p.name: p.read_text().splitlines() for p in store.iterdir()}
    assert {n for n in files if n.startswith("delete")} == {"delete_a", "delete_b", "delete_c"}
    chunks = {n: lines for n, lines in files.items() if not n.startswith("delete")}
    assert len(chunks) == 21 and all(len(set(lines)) == 1 for lines in chunks.values())  # a chunk sent twice asks for the same
    assert sum(int(lines[0].split()[2]) for lines in chunks.values()) == 2001 and again.done().count() == 21
    before = {p.name: p.stat().st_mtime_ns for p in store.iterdir()}
    again.run(assign, delete, wave=4)
    assert {p.name: p.stat().st_mtime_ns for p in store.iterdir()} == before
    with pytest.raises(ValueError, match="itself"):
        MergeSink(spark, f"file://{tmp_path}/other").stage(spark.createDataFrame([("a", "a")], "source_id string, destination_id string"), {"scenes": (scenes, "id", "studio")})
