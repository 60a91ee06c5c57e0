"""Streams against batches, replays, and the sources and sinks beside them."""

import random

from pyspark.sql import functions as F

from reconloom.streaming import incremental, stateful


def _drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return q


def test_breaker_stream_on_shuffled_input_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"h{k % 3}", round(100 + rng.random() * 900, 1), rng.random() < 0.8) for k in range(150)] + [("h0", 500.0, True)] * 3
    want = {r["host"]: tuple(r)[1:] for r in stateful.circuit_breaker(spark.createDataFrame(rows, "host string, at double, failed boolean"), 3, 40.0).collect()}
    rng.shuffle(rows)
    for k in range(3):
        part = rows[k::3] + ([("flush", 1e6, False), (None, 1.0, True)] if k == 2 else [])
        spark.createDataFrame(part, "host string, at double, failed boolean").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, at double, failed boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    _drain(stateful.circuit_breaker_stream(stream, 3, 40.0, "20 minutes"), "breaker", tmp_path)
    last = {}
    for r in spark.table("breaker").collect():
        if r["host"] not in last or (r["passed"] + r["rejected"]) >= sum(last[r["host"]][1:3]):
            last[r["host"]] = tuple(r)[1:]
    assert {h: v for h, v in last.items() if h != "flush"} == want


def test_status_stream_keeps_to_the_time_of_outcomes(spark, tmp_path):
    parts = [[(1, 5.0, "match"), (2, 5.0, "candidate"), (3, 9.0, "miss")], [(1, 6.0, "miss"), (2, 4.0, "miss"), (3, 10.0, "error"), (None, 1.0, "match")]]
    for p in parts:
        spark.createDataFrame(p, "id long, at double, outcome string").coalesce(1).write.mode("append").json(str(tmp_path / "o"))
    stream = spark.readStream.schema("id long, at double, outcome string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "o"))
    _drain(stateful.status_stream(stream), "status", tmp_path)
    assert {tuple(r) for r in spark.table("status").groupBy("id").agg(F.max("status")).collect()} == {(1, "Imported"), (2, "Review"), (3, "Unresolved")}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path, schema = f"file://{tmp_path}/ledger", "id long, outcome string"
    decide = lambda df: df.select("id", F.concat(F.lit("seen "), "what").alias("outcome"))
    make = lambda *rows: spark.createDataFrame(rows, "id long, what string")
    first, second = make((1, "a"), (2, "b"), (2, "a"), (None, "x")), make((2, "c"), (3, "d"))
    read = lambda: {tuple(r) for r in incremental.ledger(spark, path, schema).collect()}
    incremental.process_batch(first, 0, path, decide, schema)
    incremental.process_batch(second, 1, path, decide, schema)
    want = {(1, "seen a", 0), (2, "seen a", 0), (3, "seen d", 1)}
    assert read() == want
    for k, batch in ((1, second), (0, first), (1, second)):
        incremental.process_batch(batch, k, path, decide, schema)
        assert read() == want


def test_incremental_stream_and_hook(spark, tmp_path):
    src, path, schema = str(tmp_path / "images"), f"file://{tmp_path}/seen", "id long, outcome string"
    decide = lambda df: df.select("id", F.lit("seen").alias("outcome"))
    for k in range(2):
        spark.range(k * 5, k * 5 + 7).coalesce(1).write.mode("append").json(src)
        incremental.incremental_scan(spark.readStream.schema("id long").json(src), path, decide, schema, str(tmp_path / "c")).awaitTermination(240)
    got = incremental.ledger(spark, path, schema)
    assert got.count() == 12 and {tuple(r) for r in got.groupBy("batch_id").count().collect()} == {(0, 7), (1, 5)}
    bodies = str(tmp_path / "bodies")
    spark.createDataFrame([(1, '{"imageId": "i7"}'), (2, "{}"), (3, '{"image_id": "i7"}')], "id long, body string").write.json(bodies)
    events = spark.readStream.schema("id long, body string").json(bodies)
    hooked, schema = f"file://{tmp_path}/hooked", "id string, outcome string"
    assert incremental.on_created(events, hooked, decide, schema, str(tmp_path / "h")) is None and incremental.ledger(spark, hooked, schema).count() == 0
    incremental.on_created(events, hooked, decide, schema, str(tmp_path / "h"), enabled=True).awaitTermination(240)
    assert [tuple(r) for r in incremental.ledger(spark, hooked, schema).collect()] == [("i7", "seen", 0)]
