"""The packed exchange, its joins by size, and texts whose 64-bit names clash."""

import numpy as np
import pyarrow as pa
import pytest

from reconloom.llm import jaccard_join, packed, substring_dedup
from reconloom.llm.common import hashed

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("buckets", [16, 2048, 100_000, 5_000_000])
def test_rows_of_a_message_do_not_grow_with_the_buckets(buckets):
    exchange = packed.Exchange(buckets)
    assert exchange.spans[-1] == 1 and len(exchange.spans) == (1 if buckets <= 2048 else 2 if buckets <= 2048**2 else 3)
    sender = exchange.sender()
    for owner in range(64):
        sender.add(owner, RNG.integers(0, 1 << 63, packed.FLUSH // 64, dtype=np.uint64) * np.uint64(2))
    (message,) = sender.messages()
    assert message.num_rows <= packed.FAN and sum(len(x.as_py()) for x in message.column("keys")) == 8 * packed.FLUSH
    # a cell of the second pass: four buckets' keys of one coarse bucket
    if len(exchange.spans) > 1:
        again = exchange._finer(1)
        rows = list(again([message.slice(0, 1)]))
        assert sum(b.num_rows for b in rows) <= packed.FAN


@pytest.mark.parametrize(("buckets", "fan"), [(5, 8), (40, 4)])
def test_several_passes_give_the_groups_of_one(spark, buckets, fan):
    exchange = packed.Exchange(buckets, fan)
    keys = [RNG.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) for _ in range(12)]
    keys[3], keys[4] = np.full(200, keys[0][0]), keys[0]

    def send(batches):
        plain, dealt = exchange.sender(), exchange.sender(dealt=True)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                plain.add(i - 6, keys[i], np.arange(200), keys[i] + np.uint64(1))
                dealt.add(i - 6, keys[i], np.arange(200))
        yield from plain.messages()
        yield from dealt.messages()

    def read(table: pa.Table) -> pa.Table:
        got = packed.opened(table)
        b = table.column("bucket")[0].as_py()
        two = got["seconds"] if len(got["seconds"]) else got["keys"] + np.uint64(1)
        return pa.table({"bucket": pa.array([b] * len(got["keys"]), pa.int32()), "key": got["keys"].view(np.int64), "owner": got["owners"], "place": got["places"].astype(np.int64), "fits": pa.array(two == got["keys"] + np.uint64(1))})

    sent = spark.range(12, numPartitions=3).mapInArrow(send, packed.MESSAGE)
    out = exchange.grouped(sent, dealt=True).applyInArrow(read, "bucket int, key long, owner long, place long, fits boolean").collect()
    expected = set()
    for i, k in enumerate(keys):
        owner = np.uint64((i - 6) & (1 << 64) - 1)
        for shift, at in ((0, packed.bucket_of(k, buckets)), (buckets, packed.bucket_of(packed.mixed(k ^ owner), buckets))):
            expected |= set(zip((shift + at).tolist(), k.view(np.int64).tolist(), [i - 6] * 200, range(200), strict=True))
    assert all(r["fits"] for r in out)
    assert sorted((r["bucket"], r["key"], r["owner"], r["place"]) for r in out) == sorted(expected)


def _texts():
    word = lambda: "w" + str(RNG.integers(1 << 40))
    shared = [word() for _ in range(40)]
    long, short = [word() for _ in range(61)], [word() for _ in range(33)]
    return [
        (1, " ".join(shared)), (2, " ".join(long + shared[5:35])), (3, " ".join(short + shared[:25])), (4, " ".join(long)), (5, " ".join(shared[:36] + ["z"])),
        (6, " ".join(short)), (7, " ".join([*short[:31], "x"])), (8, " ".join([*long[:59], "x"])), (9, ""), (10, None),
    ]


def _both(df):
    removed = sorted(tuple(r) for r in substring_dedup.removal(df).collect())
    links = sorted(tuple(r) for r in jaccard_join.similar_classes(df).collect())
    return removed, links


def test_several_passes_and_clashing_names_change_no_result(spark, monkeypatch):
    df = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(3)
    plain = _both(df)
    assert any(r[2] for r in plain[0]) and any(r[3] for r in plain[1])
    for module in (substring_dedup, jaccard_join):
        monkeypatch.setattr(module, "Exchange", lambda buckets: packed.Exchange(buckets, 4))
    real = packed.digest

    def clashing(ids):  # documents 4 and 6, and 7 and 8, of which each has a partner, get one 64-bit name
        return (11 if len(ids) in (61, 33, 57, 29) else 12 if len(ids) in (32, 60, 28, 56) else real(ids)[0]), real(ids)[1]

    for module in (substring_dedup, jaccard_join):
        monkeypatch.setattr(module, "digest", clashing)
    assert _both(df) == plain


def test_joins_by_size(spark):
    a = spark.range(500).selectExpr("id % 50 as k", "id as v")
    b = spark.range(40).selectExpr("id as k", "id * 2 as w")
    for size in (0, 1 << 31):
        for how, n in (("inner", 400), ("left", 500)):
            got = hashed(a, b, ["k"], size, how)
            assert got.columns == ["k", "v", "w"] and got.count() == n
