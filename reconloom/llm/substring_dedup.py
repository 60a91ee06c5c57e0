"""Substring dedup by recompression.

Rounds name runs of one symbol and then pairs of symbols, a left one before a
right one, sides being a bit of the name. A name is a hash of what it stands for,
so every task gives a run or a pair the name that all others give it, and equal
stretches are made of equal symbols but for a few at either end, where a
neighbour outside may have joined. What these few are depends on the stretch
alone: its first and last run, then a right symbol in front and a left symbol at
the back. Taken off round by round (popped), they and the symbols that remain
spell the stretch: two spans are equal if and only if they pop equal symbols. So
a span's name is made of the symbols it pops, the last of which are the highest
that lie wholly inside it.

The first Spark round sends, for a few places of each document, the name of the
stretch of 2 * CONTEXT words around them: shared names reveal repeats. The places
are phrase borders of the first rounds, restricted to short phrases so that a
border depends on CONTEXT words on either side; each window takes the one with
the smallest name among those at least CONTEXT words inside it, and equal windows
take the same one. (A window inside one long run has no such border and takes its
own middle.) The second Spark round sends the names of the windows around the
revealed places, with a hash of their plain words to verify them, and marks all
but the first occurrence of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reconloom.llm.common import fresh, hashed, text_slices, words
from reconloom.llm.packed import MESSAGE, Exchange, Sender, digest, id_filter, maybe, mixed, opened, word_ids
from reconloom.sources.durable import durable, scratch

#: Rounds that place the borders: what joins, and the longest phrase in words that takes part. CONTEXT is the sum of these lengths.
ROUNDS = (("run", 1), ("pair", 1), ("pair", 2), ("pair", 2))
CONTEXT = sum(length for _, length in ROUNDS)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD1B54A32D192ED03)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Spans that are named at once: bounds the scratch space of a very long text.
_SPANS = 1 << 18


def _is_left(sym: np.ndarray, turn: int) -> np.ndarray:
    """The side of each symbol in a round of pairs."""
    return (mixed(sym + np.uint64(turn)) >> np.uint64(33) & np.uint64(1)) == 0


def _run_name(sym: np.ndarray, count: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.where(count > 1, mixed(sym ^ count.astype(np.uint64) * _BASE), sym)


def _pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a * _BASE ^ b)


def borders(ids: np.ndarray) -> np.ndarray:
    """Places where a phrase begins after all ROUNDS, as a mask over the words."""
    sym, at, length = ids, np.arange(len(ids)), np.ones(len(ids), dtype=np.int64)
    for r, (kind, most) in enumerate(ROUNDS):
        if len(sym) < 2:
            break
        small = length <= most
        if kind == "run":
            join = (sym[1:] == sym[:-1]) & small[1:] & small[:-1]
        else:
            left = _is_left(sym, r)
            join = left[:-1] & ~left[1:] & small[1:] & small[:-1]
        first = np.flatnonzero(np.r_[True, ~join])
        count = np.diff(np.r_[first, len(sym)])
        whole = np.add.reduceat(length, first)
        named = _run_name(sym[first], count) if kind == "run" else np.where(count > 1, _pair_name(sym[first], sym[first + count - 1]), sym[first])
        sym, at, length = named, at[first], whole
    out = np.zeros(len(ids), dtype=bool)
    out[at] = True
    return out


class Grammar:
    """All rounds over one sequence of words: runs, then pairs, until one symbol is left or ``rounds`` are done.

    ``levels`` hold, for each round, the symbols, where each begins among the symbols of the round before, and the number
    of the symbol that each symbol of the round before has become a part of."""

    def __init__(self, ids: np.ndarray, rounds: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        sym = ids
        for turn in range(rounds):
            if not len(sym):
                break
            first = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            into = np.repeat(np.arange(len(first)), count)
            runs = _run_name(sym[first], count)
            left = _is_left(runs, turn + len(ROUNDS))
            join = left[:-1] & ~left[1:]
            start = np.flatnonzero(np.r_[True, ~join])
            more = np.diff(np.r_[start, len(runs)]) > 1
            pairs = np.where(more, _pair_name(runs[start], runs[np.minimum(start + 1, len(runs) - 1)]), runs[start])
            pair_of = np.repeat(np.arange(len(start)), np.where(more, 2, 1))
            self.levels.append((sym, first, into, runs, left, pair_of))
            sym = pairs
        self.top = sym

    def names(self, start: np.ndarray, width: int) -> np.ndarray:
        """A name for each of the spans of ``width`` words from ``start`` on: equal if and only if the words are."""
        if len(start) > _SPANS:
            return np.concatenate([self.names(start[k : k + _SPANS], width) for k in range(0, len(start), _SPANS)])
        lo, hi = start.astype(np.int64), start.astype(np.int64) + width  # the symbols of the round that are left of each span
        front, back = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.uint64)
        live = np.arange(len(start))

        def pop(end: np.ndarray, at: np.ndarray, sym: np.ndarray, tag: int) -> None:
            with np.errstate(over="ignore"):
                end[at] = mixed(end[at] * _SECOND + sym + np.uint64(tag))

        for turn, (sym, first, into, runs, left, pair_of) in enumerate(self.levels):
            if not len(live):
                break
            a, b = lo[live], hi[live]
            # the first run, and the last if it is another one, may go on outside
            ra, rb = into[a], into[b - 1]
            ends = np.r_[first, len(sym)]
            one = ra == rb
            pop(front, live, _run_name(sym[a], np.where(one, b - a, ends[ra + 1] - a)), 4 * turn + 1)
            two = live[~one]
            pop(back, two, _run_name(sym[b[~one] - 1], (b - first[rb])[~one]), 4 * turn + 2)
            live, x, y = two, ra[~one] + 1, rb[~one]  # runs x to y - 1 are whole
            some = x < y
            live, x, y = live[some], x[some], y[some]
            # a right symbol in front and a left one at the back may have joined outside
            off = ~left[x]
            pop(front, live[off], runs[x[off]], 4 * turn + 3)
            x = x + off
            some = x < y
            live, x, y = live[some], x[some], y[some]
            off = left[y - 1]
            pop(back, live[off], runs[y[off] - 1], 4 * turn + 4)
            y = y - off
            some = x < y
            live, x, y = live[some], x[some], y[some]
            lo[live], hi[live] = pair_of[x], pair_of[y - 1] + 1
        # what is left after the last round: high symbols that all are whole
        while len(live):
            pop(front, live, self.top[lo[live]], 0)
            lo[live] += 1
            live = live[lo[live] < hi[live]]
        return _pair_name(front, back)


def word_hashes(ids: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the plain words of spans, by which equal names are verified."""
    x = mixed(ids + _SECOND)
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), dtype=np.uint64)
        for j in range(width):
            h = h * _SECOND + x[start + j]
    return mixed(h)


#: Rounds of the grammar: enough to use up a span of 20 words or so; longer ones end in high symbols.
LEVELS = 6


#: Words of a text that are looked at together.
CHUNK = 1 << 18


def anchors(ids: np.ndarray, window: int, grammar: Grammar) -> np.ndarray:
    """For each window the place of its anchor."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    reach = window - 2 * CONTEXT + 1
    inside = np.flatnonzero(borders(ids)[CONTEXT : len(ids) - CONTEXT + 1])
    # borders in order of the name of the words around them; of equal ones the first
    rank = np.empty(len(inside), dtype=np.int64)
    rank[np.lexsort((inside, grammar.names(inside, 2 * CONTEXT)))] = np.arange(len(inside))
    best = np.full(len(ids) - 2 * CONTEXT + 1, len(inside), dtype=np.int64)
    best[inside] = rank
    by_rank = np.zeros(len(inside) + 1, dtype=np.int64)
    by_rank[rank] = inside
    # smallest over the ``reach`` places of each window, by doubling
    span = 1
    while span * 2 <= reach:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < reach:
        best = np.minimum(best[: len(best) - (reach - span)], best[reach - span :])
    place = by_rank[best]
    forced = best == len(inside)
    place[forced] = np.flatnonzero(forced) + (reach - 1) // 2
    return place + CONTEXT


class Slice:
    """The word sequences of some documents, one behind the other, gone through in chunks: whatever a window gives
    depends on its words alone, so it doesn't matter what stands around them, and a long text needs no more memory."""

    def __init__(self, sequences: list[np.ndarray], window: int):
        self.ids = np.concatenate(sequences)
        self.begin = np.cumsum([0, *map(len, sequences)])
        self.window = window
        doc = np.repeat(np.arange(len(sequences), dtype=np.int32), np.diff(self.begin))
        self.whole = doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :]  # windows within one document

    def chunks(self):
        """``low, ids, grammar, starts, places``: the windows that begin in each chunk, and the place of each one's anchor."""
        for low in range(0, len(self.whole), CHUNK):
            ids = self.ids[low : low + CHUNK + self.window - 1]
            grammar = Grammar(ids, LEVELS)
            start = np.flatnonzero(self.whole[low : low + CHUNK])
            yield low, ids, grammar, start, anchors(ids, self.window, grammar)[start]

    def revealing(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document the places of its anchors and their names."""
        at, names = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for low, _, grammar, _, place in self.chunks():
            used = np.unique(place)
            at.append(low + used)
            names.append(grammar.names(used - CONTEXT, 2 * CONTEXT))
        at, first = np.unique(np.concatenate(at), return_index=True)
        names = np.concatenate(names)[first]
        cut = np.searchsorted(at, self.begin)
        return [(at[i:j] - b, names[i:j]) for i, j, b in zip(cut[:-1], cut[1:], self.begin[:-1], strict=True)]

    def named(self, known: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each document the starts of the windows with an anchor at one of its ``known`` places, their names and the hashes of their words."""
        mark = np.zeros(len(self.ids) + 1, dtype=bool)
        for b, k in zip(self.begin[:-1].tolist(), known, strict=True):
            mark[b + k.astype(np.int64)] = True
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))]
        for low, ids, grammar, start, place in self.chunks():
            start = start[mark[low + place]]
            out.append((low + start, grammar.names(start, self.window), word_hashes(ids, start, self.window)))
        at, names, plain = (np.concatenate(x) for x in zip(*out, strict=True))
        cut = np.searchsorted(at, self.begin)
        return [(at[i:j] - b, names[i:j], plain[i:j]) for i, j, b in zip(cut[:-1], cut[1:], self.begin[:-1], strict=True)]


def marks(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Which words go.

    First: ``doc_id, n_words, d1, whole, kept`` for each row: the name of its word
    sequence, whether all of it goes as a copy of a smaller id's, and the sha256
    of its words joined by one space. Second: ``doc_id, d1, starts`` (packed
    32-bit places) for the other documents with windows that also start earlier.
    """
    if window <= 2 * CONTEXT:
        raise ValueError(f"windows of more than {2 * CONTEXT} words only")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def survey(batches):
        for batch, texts in text_slices(batches):
            n, one, two, kept = [], [], [], []
            for t in texts:
                own = words(t)
                d = digest(word_ids(own))
                n.append(len(own))
                one.append(d[0])
                two.append(d[1])
                kept.append(hashlib.sha256(b" ".join(own)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "d1", "d2", "kept"])

    surveyed = durable(rows.mapInArrow(survey, "doc_id long, n_words long, d1 long, d2 long, kept binary"), "sub-survey")
    total = surveyed.agg(F.sum("n_words")).first()[0] or 0
    exchange = Exchange(int(max(16, -(-total // 4_000_000))))
    first = durable(surveyed.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "sub-first")

    def send(batches):
        out, seen = exchange.sender(), set()
        for _, texts in text_slices(batches):
            own, names = [], []
            for t in texts:
                ids = word_ids(words(t))
                name = digest(ids)
                if len(ids) >= window and name not in seen:
                    seen.add(name)
                    own.append(ids)
                    names.append(name[0])
            if own:
                for name, (place, key) in zip(names, Slice(own, window).revealing(), strict=True):
                    out.add(name, key, place)
                    if out.full():
                        yield from _revealed(out, exchange.sender(), exchange.sender(dealt=True))
        yield from _revealed(out, exchange.sender(), exchange.sender(dealt=True))

    sent = rows.where("doc_id is not null and text is not null").select("text").mapInArrow(send, MESSAGE)
    found = exchange.grouped(sent, dealt=True).applyInArrow(_repeated(exchange.buckets), "d1 long, places binary")
    hits = durable(found.join(first.select("d1", "rep"), "d1").groupBy("rep").agg(F.collect_list(F.struct("d1", "places")).alias("hits")), "sub-hits")

    def open_windows(batches):
        out = exchange.sender()
        for batch, texts in text_slices(batches, "text"):
            own, reps, known = [], [], []
            for rep, hit, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                ids = word_ids(words(t))
                if len(ids) < window:
                    continue
                name = digest(ids)[0]
                places = [np.frombuffer(x["places"], dtype=np.uint32) for x in hit if x["d1"] == name]
                if places:
                    own.append(ids)
                    reps.append(rep)
                    place = np.concatenate(places)
                    known.append(place[place < len(ids)])  # another text of this name may be longer
            if own:
                for rep, (start, key, plain) in zip(reps, Slice(own, window).named(known), strict=True):
                    out.add(rep, key, start, plain)
                    if out.full():
                        yield from _certain(out, exchange.sender())
        yield from _certain(out, exchange.sender())

    texts = maybe(rows, "doc_id", id_filter(hits, "rep")).withColumnRenamed("doc_id", "rep")
    texts = hashed(texts, hits, ["rep"], _size(hits, F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + F.length(x["places"]) + 64))).select("rep", "hits", "text")
    named = durable(texts.mapInArrow(open_windows, MESSAGE + ", later boolean"), "sub-windows")
    later = exchange.grouped(named.where("not later").drop("later")).applyInArrow(_not_first, "doc_id long, starts binary")
    certain = named.where("later").select("owners", "runs", "places").mapInArrow(_split, "doc_id long, starts binary")
    starts = durable(later.unionByName(certain).groupBy("doc_id").agg(F.collect_list("starts").alias("starts")), "sub-starts")
    known = first.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "rep")
    each = surveyed.join(known, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left").select("doc_id", "n_words", "d1", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)).alias("whole"), "kept")
    return each, starts


def _revealed(out: Sender, once: Sender, often: Sender):
    """One occurrence of each name among these; and, dealt by owner, all occurrences of those that come up twice here
    already. So a name that a third of all documents have sends one entry a message to the bucket of its name."""
    if not out.held:
        return
    keys, _, places, owners = out.taken()
    order = np.argsort(keys, kind="stable")
    first = np.r_[True, keys[order][1:] != keys[order][:-1]]
    times = np.diff(np.r_[np.flatnonzero(first), len(order)])
    for part, at in ((once, order[first]), (often, order[np.repeat(times > 1, times)])):
        if len(at):
            at = at[np.argsort(owners[at], kind="stable")]
            part.extend(*_runs(owners[at]), keys[at], places[at])
            yield from part.messages()


def _runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    return owners[begin], np.diff(np.append(begin, len(owners)))


def _repeated(buckets: int):
    """Places of anchors that occur twice at least, by owner."""

    def repeated(table: pa.Table) -> pa.Table:
        got = opened(table)
        if table.num_rows and table.column("bucket")[0].as_py() >= buckets:
            return _by_owner(got["owners"], got["places"], "d1", "places")
        order = np.lexsort((got["places"], got["owners"], got["keys"]))
        k, o, p = got["keys"][order], got["owners"][order], got["places"][order]
        new = np.ones(len(k), dtype=bool)  # copies of a document that several tasks have sent
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1])
        k, o, p = k[new], o[new], p[new]
        same = k[1:] == k[:-1]
        keep = np.zeros(len(k), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        return _by_owner(o[keep], p[keep], "d1", "places")

    return repeated


def _by_owner(owners: np.ndarray, places: np.ndarray, a: str, b: str) -> pa.Table:
    order = np.argsort(owners, kind="stable")
    o, p = owners[order], places[order].astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, dtype=np.int64)
    ends = np.append(cut[1:], len(o)) if len(o) else cut
    return pa.table({a: pa.array(o[cut], pa.int64()), b: pa.array([p[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())})


def _firsts(k1: np.ndarray, k2: np.ndarray, owners: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, then document and place; which of these are the first of their window."""
    order = np.lexsort((places, owners, k2, k1))
    a, b = k1[order], k2[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


def _certain(out: Sender, part: Sender):
    """Messages of what is first among these; the rest is known to come later and needs no comparing."""
    if not out.held:
        return
    keys, seconds, places, owners = out.taken()
    order, first = _firsts(keys, seconds, owners, places)
    # equal rows (a repeated id with the same text) are the same occurrence
    again = np.zeros(len(order), dtype=bool)
    o, p = owners[order], places[order]
    again[1:] = ~first[1:] & (o[1:] == o[:-1]) & (p[1:] == p[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    same = (o == o[lead]) & (p == p[lead])
    for later, at in ((False, order[first]), (True, order[~first & ~again & ~same])):
        if not len(at):
            continue
        at = np.sort(at)
        at = at[np.argsort(owners[at], kind="stable")]
        part.extend(*_runs(owners[at]), keys[at], places[at], seconds[at])
        for m in part.messages():
            yield pa.RecordBatch.from_arrays([*m.columns, pa.array([later] * m.num_rows)], names=[*m.schema.names, "later"])


def _not_first(table: pa.Table) -> pa.Table:
    got = opened(table)
    order, first = _firsts(got["keys"], got["seconds"], got["owners"], got["places"])
    o, p = got["owners"][order], got["places"][order]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, dtype=np.int64)
    drop = ~first & ~((o == o[lead]) & (p == p[lead]))
    return _by_owner(o[drop], p[drop], "doc_id", "starts")


def _split(batches):
    for batch in batches:
        if batch.num_rows:
            get = lambda c, t, b=batch: np.concatenate([np.frombuffer(x, dtype=t) for x in b.column(b.schema.get_field_index(c)).to_pylist()])
            yield from _by_owner(np.repeat(get("owners", np.int64), get("runs", np.uint32)), get("places", np.uint32), "doc_id", "starts").to_batches()


def covered(n: int, starts: list[bytes], window: int) -> np.ndarray:
    """Words that the windows at these places cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    at = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in starts])).astype(np.int64) if starts else np.zeros(0, dtype=np.int64)
    at = at[at + window <= n]
    step[at] += 1
    step[at + window] -= 1
    return np.cumsum(step[:n]) > 0


def removal(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: one row for each row of ``docs``.

    Words are split at white space and compared unchanged. Removed is each word
    that a window of ``window`` words covers which also starts earlier: in a row
    with a smaller id, or before in the same text. Windows are judged on the
    input. Null and empty texts have no words; rows with a null id are left as
    they are and serve as nobody's earlier copy; rows with equal ids don't count
    as earlier than each other where they are equal. An empty table gives an empty
    one; further columns, whatever their names, are not read.
    """
    with scratch() as made:
        return made.keep(_removal(docs, window, doc_id, text), "sub-result")


def _packed(column: str) -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 16)


def _size(df: DataFrame, more: Column) -> int:
    """Bytes of all rows: ``more`` and 64 for each."""
    return int(df.agg(F.sum(more + 64)).first()[0] or 0)


def _removal(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    each, starts = marks(docs, window, doc_id, text)
    empty = hashlib.sha256(b"").hexdigest()
    schema = "doc_id long, d1 long, n_removed long, sha string"

    def apply(batches):
        for batch, texts in text_slices(batches, "text"):
            out: dict[str, list] = {"doc_id": [], "d1": [], "n_removed": [], "sha": []}
            for i, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                own = words(t)
                gone = covered(len(own), s, window)
                out["doc_id"].append(i)
                out["d1"].append(digest(word_ids(own))[0])
                out["n_removed"].append(int(gone.sum()))
                out["sha"].append(hashlib.sha256(b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = hashed(maybe(rows, "doc_id", id_filter(starts, "doc_id")), starts, ["doc_id"], _size(starts, _packed("starts"))).select("doc_id", "starts", "text").mapInArrow(apply, schema).dropDuplicates(["doc_id", "d1"])
    both = each.join(cut.withColumnRenamed("d1", "_1").withColumnRenamed("doc_id", "_i"), (F.col("doc_id") == F.col("_i")) & (F.col("d1") == F.col("_1")) & ~F.col("whole"), "left")
    return both.select(
        "doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(empty)).otherwise(F.coalesce("sha", F.lower(F.hex("kept")))).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, window: int = 20, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the removed words cut out of ``text``: words that stay are joined by one space.

    Texts that lose nothing stay as they are; a text that loses all becomes
    empty. ``length``, if ``docs`` has it, is set to the new number of code points.
    """
    own, at, whole_copy = (fresh(docs, c) for c in ("sub_id", "sub_starts", "sub_whole"))
    with scratch() as made:
        each, starts = marks(docs, window, "doc_id", text)
        copies = each.where("whole").select("doc_id").distinct().withColumn("whole", F.lit(True))
        decided = starts.join(copies, "doc_id", "full").select(F.col("doc_id").alias(own), F.col("starts").alias(at), F.coalesce("whole", F.lit(False)).alias(whole_copy))
        decided = made.keep(decided, "sub-decided")
    touched = id_filter(decided, own)
    both = hashed(maybe(docs, "doc_id", touched).withColumn(own, F.col("doc_id").cast("long")), decided, [own], _size(decided, F.coalesce(_packed(at), F.lit(0))), "left").drop(own)
    names, schema = docs.columns, StructType(docs.schema.fields)
    at_text = names.index(text)
    at_length = names.index(length) if length in names else None

    def apply(batches):
        for batch, texts in text_slices(batches, text):
            new, size = [], []
            for s, whole, t in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), texts, strict=True):
                if whole:
                    t = "" if len(words(t)) >= window else t
                elif s:
                    own = words(t)
                    gone = covered(len(own), s, window).tolist()
                    t = b" ".join([w for w, g in zip(own, gone, strict=True) if not g]).decode("utf-8", "surrogatepass")
                new.append(t)
                size.append(len(t) if t else 0)
            cols = list(batch.columns[: len(names)])
            cols[at_text] = pa.array(new, cols[at_text].type)
            if at_length is not None:
                cols[at_length] = pa.array(size, cols[at_length].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return maybe(docs, "doc_id", touched, within=False).unionByName(both.mapInArrow(apply, schema))
