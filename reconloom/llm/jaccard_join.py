"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word shingles; equal sets are one class.
All shingles get one global order, rare first. Two sets with Jaccard similarity
of at least t share a shingle among the first |A| - ceil(t |A|) + 1 of each, the
prefix. Classes are partitioned into groups of similar ones by the most common
shingle of their prefixes. The token-group matrix says which groups hold a token in the
prefixes of their members: its row for a group is the union over the group. A
group none of whose tokens is in a query's prefix cannot reach the overlap that
t asks for, so only pairs of groups with a common token, and with sizes that
allow it, are opened.

An opened pair of groups first compares parity bitmaps of its members, one bit a
shingle: the number of bits in which two of them differ is at most the size of
the symmetric difference of the sets, so no link is lost. Only members that some
other one of the block may reach send their whole set, which decides.

The order comes from a counter array of a fixed size over all shingles, so it is
bounded; any order gives the same links, a rare-first one fewer openings. A token
whose counter is far above the mean is dealt to all buckets by its owners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import fresh, hashed, text_slices
from reconloom.llm.packed import MESSAGE, Exchange, digest, id_filter, inside, lowered_words, maybe, mixed, opened, word_ids
from reconloom.operators.components import connected_components
from reconloom.sources.durable import durable, scratch

#: Counters of the order: fixed, so what is broadcast is bounded.
COUNTERS = 1 << 22
_PARTS = 64
#: Most classes of a group and most shingles of its sets, on average.
GROUP, WEIGHT = 512, 1 << 21
#: Owners above which a token is compared in blocks of groups, and count above the mean counter from which it is dealt by owner.
HOT, FLOOD = 4096, 200_000
#: Longest parity bitmap, as a power of two of bits.
LONGEST = 16
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles of a whole text; of the whole word sequence if it is shorter."""
    ids = word_ids(lowered_words(text))
    n = len(ids)
    if not n:
        return ids
    k = min(width, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            h = (h ^ ids[j : n - k + 1 + j]) * _MULTIPLY
            h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def prefix(shingles: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as any partner at ``percent`` must share one of."""
    n = len(shingles)
    keep = n - -(-percent * n // 100) + 1
    order = np.lexsort((shingles, rank[(shingles >> np.uint64(42)).astype(np.int64)]))
    return shingles[order[:keep]]


def parity(shingles: np.ndarray) -> bytes:
    """Bitmap of 64 bits at least, and as many as the set has elements up to 2**LONGEST: how often, modulo 2, each place is hit."""
    level = min(LONGEST, max(6, int(len(shingles) - 1).bit_length()))
    hits = np.bincount((shingles & np.uint64((1 << level) - 1)).astype(np.int64), minlength=1 << level)
    return np.packbits((hits & 1).astype(np.uint8)).tobytes()


def similar_classes(docs: DataFrame, percent: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: one row for each row of ``docs``.

    Documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets. ``component_id`` is the smallest id reachable by links, the
    document itself included; ``n_links`` counts the rows it links with, equal
    sets included. Documents without a word (null, empty or blank text) link with
    nothing, nor do rows with a null id. Rows with one id and different texts
    are compared one by one and meet in their id, so they are of one component.
    An empty table gives an empty one; further columns of ``docs``, whatever
    their names, are not read. No text, set, group or link is capped or sampled.
    """
    with scratch() as made:
        return made.keep(_similar_classes(docs, percent, width, doc_id, text), "jac-result")


def _similar_classes(docs: DataFrame, percent: int, width: int, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def survey(batches):
        counts = np.zeros(COUNTERS, dtype=np.uint32)
        for batch, texts in text_slices(batches):
            sets = [shingle_set(t, width) for t in texts]
            for s in sets:
                np.add.at(counts, (s >> np.uint64(42)).astype(np.int64), np.uint32(1))
            yield _survey_rows(batch.column(0), sets, [digest(s) if len(s) else (None, None) for s in sets])
        parts = counts.reshape(_PARTS, -1)
        some = [p for p in range(_PARTS) if parts[p].any()]
        none = [None] * len(some)
        yield pa.RecordBatch.from_pydict({"doc_id": none, "n": [0] * len(some), "d1": none, "d2": none, "bits": none, "part": some, "counts": [parts[p].tobytes() for p in some]}, schema=_SURVEY)

    surveyed = durable(rows.mapInArrow(survey, "doc_id long, n long, d1 long, d2 long, bits binary, part int, counts binary"), "jac-survey")
    each = surveyed.where("part is null").select("doc_id", "n", "d1", "d2")
    order = _order(surveyed)
    rank = docs.sparkSession.sparkContext.broadcast(order)
    total = each.agg(F.sum("n")).first()[0] or 0
    flood = np.uint16(min(65535, _scaled(total / COUNTERS + FLOOD)))
    classes = durable(surveyed.where("part is null and n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits")), "jac-classes")
    buckets = int(max(16, -(-total * (100 - percent) // 100 // 1_000_000)))
    exchange = Exchange(buckets)

    def send(batches):
        out, flooded, seen = exchange.sender(), exchange.sender(dealt=True), set()
        for _, texts in text_slices(batches):
            for t in texts:
                s = shingle_set(t, width)
                both = digest(s) if len(s) else None
                if both and both not in seen:
                    seen.add(both)
                    name = both[0]
                    rare = prefix(s, rank.value, percent)
                    left = len(s) - np.arange(len(rare))
                    many = rank.value[(rare >> np.uint64(42)).astype(np.int64)] >= flood
                    if many.any():
                        flooded.add(name, rare[many], left[many])
                        rare, left = rare[~many], left[~many]
                    out.add(name, rare, left)
                if out.full():
                    yield from out.messages()
                if flooded.full():
                    yield from flooded.messages()
        yield from out.messages()
        yield from flooded.messages()

    sent = rows.where("doc_id is not null and text is not null").select("text").mapInArrow(send, MESSAGE)
    hits = durable(exchange.grouped(sent, dealt=True).applyInArrow(_repeated(buckets), "token long, d1 long, reach int, owners int"), "jac-hits")
    # near copies agree on the token of their prefixes that most classes have: that is their group
    leading = durable(hits.groupBy("d1").agg(F.max_by("token", F.struct("owners", "token")).alias("lead")), "jac-lead")
    taking = leading.join(classes.select("d1", "rep", "n", "copies", "bits"), "d1")
    crowd = leading.join(classes.select("d1", "n"), "d1").groupBy("lead").agg(F.greatest(F.count("*") / GROUP, F.sum("n") / WEIGHT).alias("_of"))
    members = durable(taking.join(crowd, "lead").select("d1", "rep", F.col("n").cast("int").alias("n"), "copies", "bits", F.xxhash64("lead", F.pmod(F.xxhash64("rep"), F.ceil("_of"))).alias("group")), "jac-members")
    # the matrix: tokens by group, with the sizes of the members that have the token and what their order leaves from it on
    matrix = hits.join(members.select("d1", "group", "n"), "d1").groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"), F.count("*").cast("int").alias("held"), F.max("owners").alias("owners"))
    matrix = durable(matrix, "jac-matrix")
    columns = ["token", "group", "low", "high", "reach", "held"]
    parts = max(16, buckets)
    few = matrix.where(F.col("owners") <= HOT).select(*columns).repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_pairs(percent), "g long, h long")
    # a common token: its groups in slices, each two slices a block of their own
    slices = F.ceil(F.col("owners") / F.lit(HOT // 4)).cast("int")
    many = matrix.where(F.col("owners") > HOT).join(matrix.where(F.col("owners") > HOT).groupBy(F.col("token").alias("_t")).agg(F.max(slices).alias("of")), F.col("token") == F.col("_t"))
    many = many.withColumn("slice", F.pmod(F.xxhash64("group"), "of").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    blocks = many.select(*columns, "slice", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j")).groupBy("token", "i", "j").applyInArrow(_block_pairs(percent), "g long, h long")
    pairs = durable(few.unionByName(blocks).distinct(), "jac-pairs")
    both = pairs.select("g", "h", F.explode(F.when(F.col("g") == F.col("h"), F.array("g")).otherwise(F.array("g", "h"))).alias("group"))
    tasks = max(16, 2 * buckets)
    opened_ = both.join(members.select("group", "d1", "rep", "n", "copies", "bits"), "group").select("g", "h", "group", "d1", "rep", "n", "copies", "bits")
    close = opened_.repartition(tasks, "g", "h").sortWithinPartitions("g", "h").mapInArrow(_by_pair(_may_link(percent)), "g long, h long, group long, d1 long, rep long, copies long")
    close = durable(close, "jac-close")

    marks = id_filter(close, "rep")

    def sets(batches):
        named = (b.filter(pa.array(inside(marks, b.column(0)))) for b in batches)
        for batch, texts in text_slices(named):
            own = [shingle_set(t, width) for t in texts]
            names = [digest(s)[0] if len(s) else None for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["rep", "d1", "set"])

    whole = hashed(rows.mapInArrow(sets, "rep long, d1 long, set binary"), close, ["rep", "d1"], 64 * close.count())
    verified = whole.repartition(tasks, "g", "h").sortWithinPartitions("g", "h", "d1").select("g", "h", "group", "d1", "rep", "copies", "set").mapInArrow(_by_pair(_verify(percent)), "d1 long, rep long, links long, root long")
    links = durable(verified, "jac-links")
    components = connected_components(links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    around = links.groupBy("d1", "rep").agg(F.sum("links").alias("links"))
    known = classes.select("d1", "d2", "rep", "copies").join(around, ["d1", "rep"], "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    # rows with one id meet in it: the class of each takes the smallest component that any of them has
    shared = each.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("d1", "d2").alias("k")).where("k > 1").select(F.col("doc_id").alias("_s"))
    known = known.select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), "rep", "copies", "links", F.coalesce("component", "rep").alias("component"))
    result = each.join(known, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & F.col("doc_id").isNotNull(), "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"))
    if shared.isEmpty():
        return result
    result = durable(result, "jac-labels")
    meeting = result.join(shared, F.col("doc_id") == F.col("_s")).where("n_shingles > 0").select("doc_id", F.col("component_id").alias("a"))
    meeting = meeting.join(meeting.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b")
    merged = connected_components(meeting)
    return result.join(merged.withColumnRenamed("id", "component_id"), "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"), "n_links")


_SURVEY = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def _survey_rows(ids: pa.Array, sets: list[np.ndarray], names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
            pa.array([parity(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
        ],
        schema=_SURVEY,
    )


def _scaled(count):
    """Counts as 16-bit numbers, 1,000 steps a doubling."""
    return np.minimum(65535, np.round(1000 * np.log2(1.0 + count)))


def _order(surveyed: DataFrame) -> np.ndarray:
    """Counters of all parts added up, scaled to 16 bits."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // _PARTS, dtype=np.uint64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, dtype=np.uint64)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "total": [_scaled(total).astype(np.uint16).tobytes()]})

    # sums of some tasks first, so no task reads the counters of all
    def partly(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(x, dtype=np.uint32)
                held[p] = held[p] + got if p in held else got.astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"part": list(held), "counts": [v.tobytes() for v in held.values()]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    parts = surveyed.where("part is not null").select("part", "counts").mapInArrow(partly, "part int, counts binary")
    counts = np.zeros((_PARTS, COUNTERS // _PARTS), dtype=np.uint16)
    for r in parts.groupBy("part").applyInArrow(add, "part int, total binary").toLocalIterator():
        counts[r["part"]] = np.frombuffer(bytes(r["total"]), dtype=np.uint16)
    return counts.reshape(-1)


def _repeated(buckets: int):
    """Tokens with two owners at least, once for each owner; of a flooded token's part all owners, as they are in every part."""

    def repeated(table: pa.Table) -> pa.Table:
        flooded = table.num_rows > 0 and table.column("bucket")[0].as_py() >= buckets
        got = opened(table)
        order = np.lexsort((~got["places"], got["owners"], got["keys"]))  # of two texts of one name the larger reach
        k, o, left = got["keys"][order], got["owners"][order], got["places"][order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o, left = k[new], o[new], left[new]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.r_[first, len(k)])
        owners = np.repeat(times, times)
        keep = owners > (0 if flooded else 1)
        number = np.maximum(owners[keep], FLOOD) if flooded else owners[keep]
        return pa.table({"token": k[keep].view(np.int64), "d1": o[keep], "reach": left[keep].astype(np.int32), "owners": number.astype(np.int32)})

    return repeated


def _meet(percent: int, a: list[np.ndarray], b: list[np.ndarray] | None):
    """Pairs (g, h) of the groups of ``a`` with those of ``b`` (or among themselves) that may still reach the overlap if
    this is the first token they share: percent / (100 + percent) of both sizes. Columns: group, low, high, reach, held."""
    g, lo, hi, most, n = a
    if b is None:
        own = (n > 1) & ((100 + percent) * most >= 2 * percent * lo)
        yield g[own], g[own]
    og, olo, ohi, omost = (a if b is None else b)[:4]
    for at in range(0, len(g), 256):
        i = slice(at, at + 256)
        j = slice(at, None) if b is None else slice(None)
        ok = (100 + percent) * np.minimum(most[i, None], omost[None, j]) >= percent * (lo[i, None] + olo[None, j])
        ok &= (100 * ohi[None, j] >= percent * lo[i, None]) & (100 * hi[i, None] >= percent * olo[None, j])
        if b is None:
            ok &= np.arange(at, min(at + 256, len(g)))[:, None] < np.arange(at, len(g))[None, :]
        x, y = np.nonzero(ok)
        x, y = g[i][x], og[j][y]
        yield np.minimum(x, y), np.maximum(x, y)


def _distinct(g: list[np.ndarray], h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([np.concatenate(g), np.concatenate(h)], axis=1), axis=0) if g else np.zeros((0, 2), dtype=np.int64)
    return both[:, 0], both[:, 1]


def _pairs(percent: int):
    def pairs(batches):
        g: list[np.ndarray] = []
        h: list[np.ndarray] = []
        size = 0

        def flush():
            x, y = _distinct(g, h)
            g.clear()
            h.clear()
            return pa.RecordBatch.from_pydict({"g": pa.array(x, pa.int64()), "h": pa.array(y, pa.int64())})

        last: list[np.ndarray] | None = None
        for batch in [*_with_end(batches)]:
            cols = [c.to_numpy().astype(np.int64) for c in batch.columns] if batch is not None else [np.zeros(0, dtype=np.int64)] * 6
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            cut = np.append(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]), len(cols[0])) if len(cols[0]) else np.zeros(1, dtype=np.int64)
            if batch is not None:
                last = [c[cut[-2] :] for c in cols] if len(cut) > 1 else None  # the last token may go on
                cut = cut[:-1]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for x, y in _meet(percent, [c[a:b] for c in cols[1:]], None):
                    if len(x):
                        g.append(x)
                        h.append(y)
                        size += len(x)
                    if size > 500_000:
                        yield flush()
                        size = 0
        if g:
            yield flush()

    return pairs


def _with_end(batches):
    yield from batches
    yield None


def _block_pairs(percent: int):
    def block(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_numpy().astype(np.int64) for c in ("group", "low", "high", "reach", "held")]
        i, j, at = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("slice").to_numpy()
        left, right = [c[at == i] for c in cols], None if i == j else [c[at == j] for c in cols]
        found = [*_meet(percent, left, right)]
        x, y = _distinct([a for a, _ in found], [b for _, b in found])
        return pa.table({"g": pa.array(x, pa.int64()), "h": pa.array(y, pa.int64())})

    return block


def _by_pair(task):
    """Calls ``task`` with the rows of each (g, h), which come one after the other."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            g, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]) if len(g) else np.zeros(0, dtype=np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(g)], strict=True):
                if held and name != (g[a], h[a]):
                    if (got := task(pa.Table.from_batches(held))) is not None:
                        yield got
                    held = []
                name = (g[a], h[a])
                held.append(batch.slice(a, b - a))
        if held and (got := task(pa.Table.from_batches(held))) is not None:
            yield got

    return run


def _folded(bits: np.ndarray, level: int) -> np.ndarray:
    """Rows of +1 and -1 with 2**level places from rows of 0 and 1 with more."""
    while bits.shape[1] > 1 << level:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return 1 - 2 * bits.astype(np.float32)


def _may_link(percent: int):
    """The members of a block that the bitmaps allow a link with one of the other group."""

    def task(table: pa.Table) -> pa.RecordBatch | None:
        g, h = table.column("g")[0].as_py(), table.column("h")[0].as_py()
        group, n = table.column("group").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        raw = table.column("bits").to_pylist()
        size = np.array([len(x) for x in raw])
        rows = {int(v): np.flatnonzero(size == v) for v in np.unique(size)}
        bits = {v: np.unpackbits(np.frombuffer(b"".join([raw[k] for k in at]), dtype=np.uint8).reshape(len(at), v), axis=1) for v, at in rows.items()}
        keep = np.zeros(len(n), dtype=bool)
        for v, at in rows.items():
            for w, to in rows.items():
                if w < v or (w > 2 * v and v >= 64):  # sets of such different sizes cannot link
                    continue
                level = 8 * v
                depth = level.bit_length() - 1
                for k in range(0, len(at), 128):
                    x = _folded(bits[v][k : k + 128], depth)
                    for m in range(0, len(to), max(128, (1 << 24) // (8 * w))):
                        some = slice(m, m + max(128, (1 << 24) // (8 * w)))
                        differ = (level - x @ _folded(bits[w][some], depth).T) / 2
                        p, q = at[k : k + 128], to[some]
                        ok = differ * (100 + percent) <= (100 - percent) * (n[p][:, None] + n[q][None, :]) + 1e-3
                        ok &= (100 * n[p][:, None] >= percent * n[q][None, :]) & (100 * n[q][None, :] >= percent * n[p][:, None])
                        ok &= p[:, None] != q[None, :]
                        if g != h:
                            ok &= group[p][:, None] != group[q][None, :]
                        keep[p[ok.any(axis=1)]] = True
                        keep[q[ok.any(axis=0)]] = True
        if not keep.any():
            return None
        return table.select(["g", "h", "group", "d1", "rep", "copies"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    return task


def _verify(percent: int):
    def links(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
        """Intersection sizes of all of ``a`` with all of ``b`` (or with each other)."""
        other = a if b is None else b
        if len(a) * len(other) <= 64:
            return np.array([[np.isin(x, y, assume_unique=True).sum() for y in other] for x in a], dtype=np.float64)
        sets = a if b is None else a + b
        tokens, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        common = times > 1
        number = np.cumsum(common) - 1
        keep = common[at]
        col, doc = number[at[keep]], doc[keep]
        out = np.zeros((len(a), len(other)))
        order = np.argsort(col, kind="stable")
        col, doc = col[order], doc[order]
        for lo in range(0, int(common.sum()), 4096):
            i, j = np.searchsorted(col, (lo, lo + 4096))
            x = np.zeros((len(sets), 4096), dtype=np.float32)
            x[doc[i:j], col[i:j] - lo] = 1
            out += x[: len(a)] @ (x if b is None else x[len(a) :]).T
        return out

    def task(table: pa.Table) -> pa.RecordBatch | None:
        g, h = table.column("g")[0].as_py(), table.column("h")[0].as_py()
        first = {}
        for group, d1, rep, copies, s in zip(*[table.column(c).to_pylist() for c in ("group", "d1", "rep", "copies", "set")], strict=True):
            first.setdefault((d1, rep), (group, rep, copies, np.frombuffer(s, dtype=np.uint64)))  # a repeated row comes twice
        left = [d for d, v in first.items() if v[0] == g]
        right = [d for d, v in first.items() if v[0] == h] if g != h else None
        if not left or (right is not None and not right):
            return None
        a, b = [first[d][3] for d in left], None if right is None else [first[d][3] for d in right]
        inter = links(a, b)
        n1, n2 = np.array([len(x) for x in a]), np.array([len(x) for x in (a if b is None else b)])
        hit = 100 * inter >= percent * (n1[:, None] + n2[None, :] - inter)
        if right is None:
            hit &= np.arange(len(left))[:, None] < np.arange(len(left))[None, :]
        names = left + ([] if right is None else right)
        copies = np.array([first[d][2] for d in names])
        i, j = np.nonzero(hit)
        if right is not None:
            j = j + len(left)
        count, root = np.zeros(len(names), dtype=np.int64), list(range(len(names)))
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[y] = x
        at = np.flatnonzero(count).tolist()
        if not at:
            return None
        rep = lambda k: first[names[k]][1]
        return pa.RecordBatch.from_pydict({"d1": pa.array([names[k][0] for k in at], pa.int64()), "rep": pa.array([rep(k) for k in at], pa.int64()), "links": pa.array(count[at]), "root": pa.array([rep(find(k)) for k in at], pa.int64())})

    return task


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it. Rows with a null id stay.

    Of rows with the same id and text one stays, that whose further columns come first as JSON. Rows with the same
    id and different texts are one document, and all of them stay if it does."""
    with scratch() as made:
        found = similar_classes(docs, percent, width).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
        found = made.keep(found, "jac-copies")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    marks = id_filter(found.unionByName(repeated), "doc_id")
    rest, one = [c for c in docs.columns if c != "text"], fresh(docs, "one")
    checked = maybe(docs, "doc_id", marks).join(found, "doc_id", "left_anti")
    checked = checked.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias(one))
    checked = checked.select(*[F.col("text") if c == "text" else F.col(f"{one}.{c}").alias(c) for c in docs.columns])
    return maybe(docs, "doc_id", marks, within=False).unionByName(checked)
