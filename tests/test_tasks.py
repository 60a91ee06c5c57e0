import pytest
from pyspark.sql import functions as F

from reconloom.plans import tasks


def test_cleanup_round(spark):
    rows = [("1", 1, "long hair", ["x"], 9), ("2", 2, "long_hair", [], 9), ("3", 3, "silver ring extraordinair", [], 1), ("4", 4, "silver ring extraordinaix", [], 2), ("5", 5, "workflow done", [], 1), ("6", 6, "workflow-done", [], 1)]
    entities = spark.createDataFrame(rows, "id string, ordinal long, name string, aliases array<string>, usage long").withColumns({"rich": F.lit(False), "signature": F.lit("")})
    safe, review = tasks.cleanup_plan(entities, "tag", protected=["workflow done", "workflow-done"])
    assert [(r["destination_id"], r["source_ids"]) for r in safe.collect()] == [("2", ["1"])]
    found = review.collect()
    assert [(r["destination_id"], r["source_ids"], r["kind"]) for r in found] == [("4", ["3"], "fuzzy")] and found[0]["score"] >= 0.96
    children = tasks.cleanup_apply(safe, {"uses": (spark.createDataFrame([(1, "1"), (2, "3")], "n long, tag string"), "tag")})
    assert {(r["n"], r["tag"], r["moved"]) for r in children["uses"].collect()} == {(1, "2", True), (2, "3", False)}


def test_restore_gate(spark):
    matches = spark.createDataFrame([("a", "x", "fingerprint"), ("b", None, "unmatched")], "old_id string, current_id string, kind string")
    old = spark.createDataFrame([("a", "title"), ("b", "other")], "id string, t string")
    cur = spark.createDataFrame([("x", ""), ("y", "z")], "id string, t string")
    assert [tuple(r) for r in tasks.restore_export(matches, old, cur, {"t": "string"}).collect()] == [("x", "t", "", "title")]
    many = spark.range(200).select(F.col("id").cast("string").alias("old_id"), F.lit(None).cast("string").alias("current_id"), F.lit("unmatched").alias("kind"))
    assert tasks.restore_export(matches.unionByName(many), old, cur, {"t": "string"}).count() == 0


def test_small_tasks(spark):
    rows = spark.createDataFrame([(k, "Review" if k % 2 else "NoMatch") for k in range(6)], "id long, status string")
    assert [r["id"] for r in tasks.preview(rows, "review", 2).collect()] == [1, 3]
    again = tasks.recheck(rows, "Review", spark.createDataFrame([(1, "match"), (3, "error")], "id long, outcome string"))
    assert {tuple(r) for r in again.collect()} == {(1, "Imported"), (3, "Unresolved"), (5, "Review")}
    bodies = spark.createDataFrame([(1, '{"a": [{"image-id": 7}]}'), (2, '{"type": "Image", "id": 9}'), (3, "{broken"), (4, None), (5, '{"x": {"imageId": null}, "y": {"type": "image", "id": "z"}}')], "id long, body string")
    assert {tuple(r) for r in tasks.hook_image_ids(bodies).collect()} == {(1, "7"), (2, "9"), (3, None), (4, None), (5, "z")}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, parent long")
    assert {tuple(r) for r in tasks.parents_first(tree).collect()} == {(1, 0), (2, 1), (3, 2), (4, 0)}
    waits = spark.createDataFrame([("3.5",), ("Thu, 01 Jan 1970 00:01:00 GMT",), ("soon",), (None,)], "h string")
    assert [r[0] for r in waits.select(tasks.retry_after(F.col("h"), F.to_timestamp(F.lit("1970-01-01 00:00:20")))).collect()] == [3.5, 40.0, 0.0, 0.0]


def _side(spark, files, rows, names, external, parents):
    who = "id string, ordinal long, name string, aliases array<string>"
    entities = {k: spark.createDataFrame([(f"{k}{n}", n, x, [], "") for n, x in enumerate(v)], who + ", disambiguation string") for k, v in names.items()}
    entities["groups"] = entities["groups"].withColumn("aliases", F.lit(""))
    return tasks.Side(
        {m: spark.createDataFrame([(i, f"/{i}", 5, "md5", v) for i, v in f], "id string, path string, size long, fp_type string, fp_value string") for m, f in files.items()},
        {m: spark.createDataFrame(r, "id string, title string") for m, r in rows.items()}, entities, external, spark.createDataFrame(parents, "child string, parent string"),
    )


def test_whole_restore(spark, tmp_path):
    names = {"tags": ["long hair", "blue sky"], "performers": ["Ann Example"], "studios": ["Big House"], "groups": ["First Run"]}
    ids = spark.createDataFrame([], "name string, endpoint string, external_id string")
    old = _side(spark, {"scenes": [("a", "1"), ("b", "1"), ("c", "2"), ("d", "9")], "images": [("e", "7")]}, {"scenes": [("a", "from a"), ("b", "from b"), ("c", "from c")], "images": [("e", "from e")]}, names, ids, [("blue sky", "long hair"), ("nowhere", "long hair")])
    names = {"tags": ["long_hair", "Blue Sky", "unrelated thing"], "performers": ["ann example"], "studios": ["wholly different"], "groups": ["first-run"]}
    now = _side(spark, {"scenes": [("x", "1"), ("y", "2")], "images": [("z", "7")]}, {"scenes": [("x", ""), ("y", "kept")], "images": [("z", None)]}, names, ids.withColumnRenamed("name", "id"), [])
    fields = {"scenes": {"title": "string"}, "images": {"title": "string"}}
    out = tasks.restore_run(old, now, fields, f"file://{tmp_path}/saved")
    rows = lambda k, *c: {tuple(r) for r in out[k].select(*c).collect()}
    assert rows("changes_scenes", "id", "field", "new") == {("x", "title", "from a")} and rows("changes_images", "id", "new") == {("z", "from e")}
    assert rows("stats", "medium", "kind", "records") == {("scenes", "fingerprint", 2), ("scenes", "collision", 1), ("scenes", "unmatched", 1), ("images", "fingerprint", 1)}
    assert rows("tags", "name", "id") == {("long hair", "tags0"), ("blue sky", "tags1")} and rows("parents", "child", "parent") == {("tags1", "tags0")}
    assert rows("performers", "id") == {("performers0",)} and rows("groups", "id") == {("groups0",)} and rows("studios", "decision", "id") == {("create", None)}
    assert spark.read.parquet(f"file://{tmp_path}/saved/media_scenes").count() == 2
    with pytest.raises(Exception, match="already exists"):  # a backup that fails stops the run
        tasks.restore_run(old, now, fields, f"file://{tmp_path}/saved")
