"""Keys of many documents dealt to buckets as packed arrays instead of rows.

A message holds, for one bucket, the 64-bit keys of some documents, the
documents as run lengths and a 32-bit place for each key. Documents are named by
a 64-bit owner. One Arrow row stands for thousands of keys, so a shuffle of all
n-grams of a corpus costs a few bytes a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import words

MESSAGE = "bucket int, keys binary, seconds binary, owners binary, runs binary, places binary"
#: Keys that a task holds before it sends them.
FLUSH = 1 << 19
#: Buckets that one pass of an exchange deals to.
FAN = 2048
#: Most tasks that the buckets of one exchange are dealt to.
TASKS = 20_000


def word_ids(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def digest(ids: np.ndarray) -> tuple[int, int]:
    """128 bits of an array as two signed numbers."""
    v = xxhash.xxh3_128_intdigest(ids.tobytes())
    return _signed(v >> 64), _signed(v & (1 << 64) - 1)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def lowered_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.lower`` touches nothing else."""
    return words(text.lower() if text and text.isascii() else text) if not text or text.isascii() else text.encode("utf-8", "surrogatepass").lower().split()


class Exchange:
    """Deals keys to ``buckets`` buckets by their top bits, in as many passes as keep rows long.

    A pass deals to ``fan`` buckets at most, so a full message has FLUSH / ``fan`` keys a row whatever the number of
    buckets. More of them take another pass, which deals each coarse bucket, in cells of a few buckets' keys, to finer
    ones: a second pass from 2,048 buckets on, a third from 4 million on.
    """

    def __init__(self, buckets: int, fan: int = FAN):
        self.buckets = buckets
        self.spans = [-(-buckets // fan)]
        while self.spans[-1] > 1:
            self.spans.append(-(-self.spans[-1] // fan))

    def sender(self, dealt: bool = False, step: int = 0) -> Sender:
        return Sender(self.buckets, self.spans[step], dealt)

    def grouped(self, sent: DataFrame, dealt: bool = False):
        """Messages grouped by bucket; ``dealt`` if some were dealt by owner, to as many buckets of their own."""
        kinds = 2 if dealt else 1
        for step in range(1, len(self.spans)):
            salts = max(1, self.spans[step - 1] // (4 * self.spans[step]))
            cells = sent.withColumn("cell", F.pmod(F.xxhash64("keys"), F.lit(salts)))
            tasks = min(TASKS, kinds * salts * -(-self.buckets // self.spans[step - 1]))
            sent = cells.repartition(tasks, "bucket", "cell").sortWithinPartitions("bucket").drop("cell").mapInArrow(self._finer(step), MESSAGE)
        return sent.repartition(min(TASKS, kinds * self.buckets), "bucket").groupBy("bucket")

    def _finer(self, step: int):
        coarse = -(-self.buckets // self.spans[step - 1])

        def finer(batches):
            now, out = None, self.sender()
            for batch in batches:
                for bucket, keys, seconds, owners, runs, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket != now:
                        yield from out.messages()
                        now, out = bucket, self.sender(bucket >= coarse, step)
                    out.extend(np.frombuffer(owners, np.int64), np.frombuffer(runs, np.uint32), np.frombuffer(keys, np.uint64), np.frombuffer(places, np.uint32), np.frombuffer(seconds, np.uint64))
                    if out.full():
                        yield from out.messages()
            yield from out.messages()

        return finer


class Sender:
    """Collects keys by owner and cuts them into messages, one for each ``span`` of ``buckets`` buckets.

    ``dealt``: the owner, too, decides on the bucket, so that a key is spread over all of them; such buckets are
    numbered after the others."""

    def __init__(self, buckets: int, span: int = 1, dealt: bool = False):
        self.buckets, self.span, self.dealt = buckets, span, dealt
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.seconds: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.held = 0

    def add(self, owner: int, keys: np.ndarray, places: np.ndarray | None = None, seconds: np.ndarray | None = None) -> None:
        if len(keys):
            self.extend(np.array([owner], np.int64), np.array([len(keys)]), keys, places, seconds)

    def extend(self, owners: np.ndarray, runs: np.ndarray, keys: np.ndarray, places: np.ndarray | None = None, seconds: np.ndarray | None = None) -> None:
        """``runs``: how many of the keys each owner has, one owner after the other."""
        self.owners.append(owners)
        self.runs.append(runs.astype(np.int64))
        self.keys.append(keys)
        self.places.append(np.zeros(0, np.uint32) if places is None else places.astype(np.uint32))
        self.seconds.append(np.zeros(0, np.uint64) if seconds is None else seconds)
        self.held += len(keys)

    def full(self) -> bool:
        return self.held >= FLUSH

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All keys, the seconds, places and owners that belong to them; nothing is held any longer."""
        out = np.concatenate(self.keys), np.concatenate(self.seconds), np.concatenate(self.places), np.repeat(np.concatenate(self.owners), np.concatenate(self.runs))
        self.clear()
        return out

    def messages(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, seconds, places, owners = self.taken()
        bucket = bucket_of(mixed(keys ^ owners.view(np.uint64)) if self.dealt else keys, self.buckets) // self.span
        order = np.argsort(bucket, kind="stable")  # within a bucket still by owner
        bucket, owners = bucket[order], owners[order]
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        first = -(-self.buckets // self.span) if self.dealt else 0
        out: dict[str, list] = {c: [] for c in ("bucket", "keys", "seconds", "owners", "runs", "places")}
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True):
            at, who = order[i:j], owners[i:j]
            run = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            out["bucket"].append(first + int(bucket[i]))
            out["keys"].append(keys[at].tobytes())
            out["seconds"].append(seconds[at].tobytes() if len(seconds) else b"")
            out["owners"].append(who[run].tobytes())
            out["runs"].append(np.diff(np.append(run, len(who))).astype(np.uint32).tobytes())
            out["places"].append(places[at].tobytes() if len(places) else b"")
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "seconds", "owners", "runs", "places")]]))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def opened(table: pa.Table) -> dict[str, np.ndarray]:
    """The keys of all messages of a bucket, with an owner for each."""
    get = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()]) if table.num_rows else np.zeros(0, t)
    return {"keys": get("keys", np.uint64), "seconds": get("seconds", np.uint64), "owners": np.repeat(get("owners", np.int64), get("runs", np.uint32)), "places": get("places", np.uint32)}


#: Places of a filter, as powers of two: eight for each id within these bounds, so the broadcast is 32 MB at most.
FEWEST, MOST = 18, 28


def id_filter(ids: DataFrame, column: str) -> Broadcast:
    """A bitmap with the places of all ids set: a bounded broadcast, whatever the number of ids.

    Ids that are not there may pass (beyond 2**MOST / 8 ids the more, the fuller it
    is), ids that are there always do; so it only saves shuffling rows that an
    exact join drops.
    """
    own = ids.select(F.col(column).cast("long").alias("id")).where("id is not null")
    bits = min(MOST, max(FEWEST, (8 * own.count()).bit_length()))
    parts = 32
    width = (1 << bits) // 8 // parts

    def mark(batches):
        held = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            place = _place(batch.column(0), bits)
            np.bitwise_or.at(held, place >> 3, np.uint8(128) >> (place & 7).astype(np.uint8))
        cut = held.reshape(parts, -1)
        some = [p for p in range(parts) if cut[p].any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "marks": [cut[p].tobytes() for p in some]}, schema=pa.schema([("part", pa.int32()), ("marks", pa.binary())]))

    def join(table: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint8)
        for x in table.column("marks").to_pylist():
            total |= np.frombuffer(x, dtype=np.uint8)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "marks": [total.tobytes()]})

    total = np.zeros((parts, width), dtype=np.uint8)
    for r in own.mapInArrow(mark, "part int, marks binary").groupBy("part").applyInArrow(join, "part int, marks binary").toLocalIterator():
        total[r["part"]] = np.frombuffer(bytes(r["marks"]), dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(total.reshape(-1))


def _place(column: pa.Array, bits: int) -> np.ndarray:
    return (mixed(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def inside(marks: Broadcast, ids: pa.Array) -> np.ndarray:
    """Which ids may be in the filter; null ids are not."""
    place = _place(pc.fill_null(ids, 0), (8 * len(marks.value)).bit_length() - 1)
    found = (marks.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
    return found & ids.is_valid().to_numpy(zero_copy_only=False)


def maybe(rows: DataFrame, column: str, marks: Broadcast, within: bool = True) -> DataFrame:
    """Rows whose id may be in the filter; with ``within`` False the others, those with a null id among them."""
    at = rows.columns.index(column)

    def keep(batches):
        for batch in batches:
            found = inside(marks, batch.column(at))
            yield batch.filter(pa.array(found if within else ~found))

    return rows.mapInArrow(keep, rows.schema)
