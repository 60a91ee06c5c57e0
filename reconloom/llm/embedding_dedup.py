"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook; pairs of code
words form a grid of cells. Each vector is stored in its own cell and visits
cells in the order of the summed half distances (the multi-sequence order) until
the number of visits that a target recall needs; what meets there is compared in
double precision. The number of visits is fitted on vectors that the codebooks
have not seen, moved to lie exactly at the threshold, so it doesn't depend on
how common near copies are, and it has no upper limit but the number of cells.
The number of cells is the one for which visits and comparisons cost least.

A visitor only goes to cells with a larger number than its own, so each pair of
vectors meets at most once: in the cell of both, or in the higher of their cells.
Visitors travel as 8-bit codes with the norm of what the code leaves out, which
bounds the error of every product; only vectors with a partner that the bound
allows travel whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from reconloom.llm.packed import id_filter, inside
from reconloom.operators.components import connected_components
from reconloom.sources.durable import durable, scratch

#: Vectors of one width up to which one cell holds them all.
FEW = 2048
#: Stored vectors of a block, and visitors of a block.
STORED, GUESTS = 4096, 65536
#: Hot cells up to which their list is broadcast.
MOST_HOT = 100_000
#: What sending a visitor costs, in comparisons.
SENDING = 400
#: Most words of a codebook.
WORDS = 4096


@dataclass
class MultiIndex:
    """Two codebooks of at most WORDS words, and the number of cells that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def words(self) -> int:
        return len(self.second)

    def nearest_cells(self, x: np.ndarray, count: int | None = None) -> np.ndarray:
        """The ``count`` cells of each row in multi-sequence order.

        The cell made of a row's i-th and j-th nearest words comes after i * j - 1
        others at least, so only pairs with i * j <= count can be among the first."""
        count = min(count or self.visits, len(self.first) * self.words)
        k1, k2 = min(count, len(self.first)), min(count, self.words)
        pairs = np.array([(i, j) for i in range(k1) for j in range(min(k2, count // (i + 1)))])
        i, j = pairs[:, 0], pairs[:, 1]
        half = self.first.shape[1]
        out = []
        for at in range(0, len(x), max(1, (1 << 21) // len(pairs))):
            some = x[at : at + max(1, (1 << 21) // len(pairs))]
            d1, d2 = _squared(some[:, :half], self.first), _squared(some[:, half:], self.second)
            o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :k1], np.argsort(d2, axis=1, kind="stable")[:, :k2]
            total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
            order = np.argsort(total, axis=1, kind="stable")[:, :count]
            out.append(np.take_along_axis(o1[:, i] * self.words + o2[:, j], order, 1))
        return np.concatenate(out) if out else np.zeros((0, count), dtype=np.int64)

    def place_of(self, near: np.ndarray, seen_from: np.ndarray) -> np.ndarray:
        """How many cells each row of ``seen_from`` visits before the cell of the same row of ``near``."""
        half = self.first.shape[1]
        d1, d2 = _squared(seen_from[:, :half], self.first), _squared(seen_from[:, half:], self.second)
        a, b = _squared(near[:, :half], self.first).argmin(axis=1), _squared(near[:, half:], self.second).argmin(axis=1)
        rows = np.arange(len(near))
        limit = d1[rows, a] + d2[rows, b]
        d2 = np.sort(d2, axis=1)
        return np.array([np.searchsorted(d2[r], limit[r] - d1[r]).sum() for r in rows])


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1), 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _squared(x, words).argmin(axis=1)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        sums = np.add.reduceat(x[order], first, axis=0)
        words[at[order][first]] = sums / np.diff(np.r_[first, len(x)])[:, None]
        empty = np.setdiff1d(np.arange(k), at)
        words[empty] = x[rng.integers(len(x), size=len(empty))]
    return words


def moved(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors with a cosine of exactly ``threshold`` to those of ``x``: a third moved in all components, a third each in one half."""
    noise = rng.normal(size=x.shape)
    half = x.shape[1] // 2
    noise[1::3, :half] = 0
    noise[2::3, half:] = 0
    noise -= (noise * x).sum(axis=1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    return threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * noise


def fit(sample: np.ndarray, total: int, threshold: float, recall: float = 0.99, words: int | None = None, seed: int = 7) -> MultiIndex:
    """Codebooks and number of visits for ``total`` unit vectors, from a bounded sample of them.

    A fifth of the sample, 1,024 rows at most, is held out of the codebooks and
    sets the visits. A pair meets in one visited direction only, so the recall of
    one direction is what is fitted."""
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))]
    held = sample[: min(1024, max(1, len(sample) // 5))]
    seen = sample[len(held) :] if len(sample) > 8 else sample
    half = sample.shape[1] // 2
    near = moved(held, threshold, rng)
    middle = 2 ** int(np.floor(np.log2(max(1.0, np.sqrt(total / SENDING)))))
    best, least = None, np.inf
    for k in [words] if words else [middle // 4, middle // 2, middle, 2 * middle]:
        k = min(k, WORDS, len(seen))
        if k < 1:
            continue
        index = MultiIndex(_means(seen[:, :half], k, rng), _means(seen[:, half:], k, rng), 1)
        index.visits = int(min(k * k, np.quantile(index.place_of(near, held), recall) + 1))
        cost = index.visits * (SENDING + total / (k * k))
        if cost < least:
            best, least = index, cost
    return best


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, recall: float = 0.99, sample_rows: int = 8192) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each different id.

    Vectors link where their cosine, in double precision, is at least
    ``threshold``; vectors of different widths do not link, those of any one
    width (1 included) are compared. Equal vectors are one class with a count,
    compared once; their links to each other count. Vectors that are null, empty
    or zero, or hold a null or non-finite component, link with nothing. Equal rows
    are one vector; an id with several different vectors has the links of all of
    them, those among its own included. Rows with a null id have no links. An
    empty table gives an empty one; further columns, whatever their names, are
    not read. ``sample_rows`` bounds the rows of each width that the codebooks and
    the number of visits are fitted on; every row is indexed.
    """
    with scratch() as made:
        return made.keep(_near_duplicates(vectors, vec_id, embedding, threshold, recall, sample_rows), "emb-result")


def _near_duplicates(vectors: DataFrame, vec_id: str, embedding: str, threshold: float, recall: float, sample_rows: int) -> DataFrame:
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    array = f"array<{'float' if single else 'double'}>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(array).alias("x"))
    good = "x is not null and size(x) > 0 and id is not null and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)"
    # of one component only the sign counts
    x = F.when(F.size("x") == 1, F.transform("x", lambda v: F.signum(v))).otherwise(F.col("x")).cast(array)
    usable = rows.where(good).select("id", x.alias("x")).withColumns(_names("x"))
    ids = rows.select("id").distinct()
    members = durable(usable.select("id", "k1", "k2").distinct(), "emb-members")
    copies = members.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("x").alias("x")).join(copies, ["k1", "k2"])
    classes = durable(classes.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "rep", "copies", "x", F.size("x").alias("w")), "emb-classes")
    sizes = {r["w"]: r["n"] for r in classes.groupBy("w").agg(F.count("*").alias("n")).collect()}
    models = {}
    for w, total in sizes.items():
        if total > FEW:
            share = int(1_000_000 * min(1.0, sample_rows / total))
            taken = classes.where((F.col("w") == w) & (F.pmod(F.xxhash64("c"), F.lit(1_000_000)) <= F.lit(share))).select("x").limit(2 * sample_rows).toPandas()["x"]
            models[w] = fit(_unit(np.stack(taken.to_numpy())), total, threshold, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def place(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                width = batch.column(3).to_numpy()
                for w in np.unique(width).tolist():
                    some = batch.filter(pa.array(width == w))
                    u = _unit(_matrix(some.column(2)))
                    scale = (np.abs(u).max(axis=1) / 127).astype(np.float32)
                    code = np.round(u / scale[:, None]).astype(np.int8)
                    left = np.linalg.norm(u - code * scale[:, None].astype(np.float64), axis=1) * 1.001 + 1e-6
                    model = shared.value.get(w)
                    if model is None:
                        cells = [[0]] * len(u)
                    else:
                        own = model.nearest_cells(u, 1)[:, 0]
                        visited = model.nearest_cells(u)
                        cells = [[int(o), *row[row > o].tolist()] for o, row in zip(own, visited, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1), some.column(3), pa.array(scale), pa.array(left.astype(np.float32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
                        names=["c", "copies", "w", "scale", "left", "code", "cells"],
                    )

    placed = durable(classes.select("c", "copies", "x", "w").mapInArrow(place, "c long, copies long, w int, scale float, left float, code binary, cells array<long>"), "emb-cells")
    # cells where somebody is stored: nobody visits the others
    marks = id_filter(placed.select((F.element_at("cells", 1) * 8192 + F.col("w")).alias("at")), "at")

    def visit(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lists = batch.column(6)
                row = pc.list_parent_indices(lists)
                cell = pc.list_flatten(lists)
                width = batch.column(2).take(row)
                key = pc.add(pc.multiply(cell, 8192), pc.cast(width, pa.int64()))
                n = row.to_numpy()
                guest = np.r_[False, n[1:] == n[:-1]] if len(n) else np.zeros(0, dtype=bool)
                keep = pa.array(~guest | inside(marks, key))
                row, cell, guest = row.filter(keep), cell.filter(keep), pa.array(guest).filter(keep)
                for lo in range(0, len(row), 16384):
                    k = row.slice(lo, 16384)
                    part = batch.take(k)
                    yield pa.RecordBatch.from_arrays([*part.columns[:6], cell.slice(lo, 16384), guest.slice(lo, 16384)], names=["c", "copies", "w", "scale", "left", "code", "cell", "guest"])

    each = placed.mapInArrow(visit, "c long, copies long, w int, scale float, left float, code binary, cell long, guest boolean")
    crowd = placed.select("w", F.posexplode("cells").alias("visit", "cell")).groupBy("w", "cell").agg(F.count_if(F.col("visit") == 0).alias("stored"), F.count("*").alias("n"))
    hot = durable(crowd.where((F.col("stored") > STORED) | ((F.col("stored") > 0) & (F.col("n") > GUESTS))).select("w", "cell", F.ceil(F.col("stored") / STORED).cast("int").alias("chunks"), F.ceil(F.col("n") / GUESTS).cast("int").alias("slices")), "emb-hot")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    blocks = each.join(hot, ["w", "cell"], "left").select("*", *_blocks("c")).withColumn("block", F.explode("blocks"))
    tasks = max(16, -(-sum(sizes.values()) // 20_000))
    order = ["w", "cell", "chunk", "slice"]
    dealt = blocks.select("w", "cell", "block.chunk", "block.slice", "block.as_guest", "c", "copies", "scale", "left", "code")
    sorted_ = dealt.repartition(tasks, *order).sortWithinPartitions(*order, "as_guest")
    close = durable(sorted_.mapInArrow(_streamed(_may_link(threshold)), "w int, cell long, chunk int, slice int, as_guest boolean, c long, copies long"), "emb-close")
    whole = classes.select("c", "rep", "x").join(close, "c").select(*order, "as_guest", "c", "rep", "copies", "x")
    links = durable(whole.repartition(tasks, *order).sortWithinPartitions(*order, "as_guest").mapInArrow(_streamed(_links(threshold)), "c long, rep long, links long, root long"), "emb-links")
    around = links.groupBy("c").agg(F.sum("links").alias("links"))
    components = connected_components(links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("c", "k1", "k2", "rep", "copies").join(around, "c", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
    each_id = members.join(named.select("k1", "k2", "copies", "links", F.coalesce("component", "rep").alias("component")), ["k1", "k2"])
    own = each_id.groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.min("component").alias("component"), F.max("component").alias("other"))
    apart = own.where("component <> other").select("id")
    if not apart.isEmpty():  # an id with several vectors ties their components
        tied = each_id.join(apart, "id").join(own.select("id", F.col("component").alias("to")), "id").select(F.col("component").alias("a"), F.col("to").alias("b"))
        merged = connected_components(tied).select(F.col("id").alias("component"), F.col("component").alias("to"))
        own = own.join(merged, "component", "left").select("id", "links", F.coalesce("to", "component").alias("component"))
    out = ids.join(own, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _names(x: str) -> dict[str, Column]:
    """128 bits that stand for an array."""
    return {"k1": F.xxhash64(F.lit(1), x), "k2": F.xxhash64(F.lit(2), F.reverse(x))}


def _blocks(c: str) -> list[Column]:
    """The blocks that a row goes to. Each chunk of a cell's stored vectors is compared with itself, with the stored
    vectors of later chunks and with all visitors, in slices of guests."""
    chunks, slices = F.coalesce("chunks", F.lit(1)), F.coalesce("slices", F.lit(1))
    chunk, slice_ = F.pmod(F.xxhash64(c), chunks).cast("int"), F.pmod(F.xxhash64(c, F.lit(3)), slices).cast("int")
    block = lambda k, s, g: F.struct(k.alias("chunk"), s.alias("slice"), F.lit(g).alias("as_guest"))
    base = F.transform(F.sequence(F.lit(0), slices - 1), lambda s: block(chunk, s, False))
    earlier = F.when(chunk > 0, F.transform(F.sequence(F.lit(0), F.greatest(chunk - 1, F.lit(0))), lambda k: block(k, slice_, True))).otherwise(F.slice(base, 1, 0))
    visits = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: block(k, slice_, True))
    return [F.when(F.col("guest"), visits).otherwise(F.concat(base, earlier)).alias("blocks")]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _streamed(task):
    """Runs ``task`` over rows sorted by block (four columns) and guest flag: it is made for each block, is fed batches, and ends."""

    def run(batches):
        name, now = None, None
        for whole in batches:
            keys = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new = np.zeros(whole.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cut = [0, *np.flatnonzero(new).tolist(), whole.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                this = tuple(int(k[a]) for k in keys)
                if this != name:
                    if now is not None:
                        yield from now.end()
                    name, now = this, task(this)
                for lo in range(a, b, 1024):
                    yield from now.feed(whole.slice(lo, min(1024, b - lo)))
        if now is not None:
            yield from now.end()

    return run


class _Block:
    """Stored vectors first, then guests, each batch of which meets all stored ones."""

    def __init__(self, name: tuple):
        self.name = name
        self.parts: list = []
        self.base = None

    def feed(self, batch: pa.RecordBatch):
        guest = batch.column(4).to_numpy(zero_copy_only=False)
        first = int((~guest).sum())
        if first:
            self.parts.append(self.read(batch.slice(0, first)))
        if first < batch.num_rows:
            if self.base is None:
                yield from self.close()
            if self.base is not None:
                yield from self.meet(self.read(batch.slice(first)))

    def close(self):
        if self.parts:
            self.base = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts = []
            self.begin()
            if self.name[3] == 0:  # the stored ones meet each other in one slice only
                self.among()
        return iter(())

    def end(self):
        if self.base is None:
            yield from self.close()
        if self.base is not None:
            yield from self.finish()


def _may_link(threshold: float):
    class Codes(_Block):
        def read(self, b):
            code = np.frombuffer(b"".join(b.column(9).to_pylist()), dtype=np.int8).reshape(b.num_rows, -1).astype(np.float32)
            return [b.column(k).to_numpy() for k in (5, 6)] + [code * b.column(7).to_numpy()[:, None], b.column(8).to_numpy()]

        def begin(self):
            self.keep = np.zeros(len(self.base[0]), dtype=bool)

        def near(self, x, e):
            """Which products of the codes ``x`` with those of the stored vectors may stand for a link."""
            error = e[:, None] + self.base[3][None, :]
            return x @ self.base[2].T >= threshold - 1e-4 - error - error * error

        def among(self):
            for lo in range(0, len(self.keep), 512):
                hit = self.near(self.base[2][lo : lo + 512], self.base[3][lo : lo + 512])
                hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
                self.keep[lo : lo + 512] |= hit.any(axis=1)

        def meet(self, rows):
            hit = self.near(rows[2], rows[3])
            self.keep |= hit.any(axis=0)
            at = hit.any(axis=1)
            if at.any():
                yield self.rows(rows, at, True)

        def finish(self):
            if self.keep.any():
                yield self.rows(self.base, self.keep, False)

        def rows(self, rows, at, guest):
            n = int(at.sum())
            w, cell, chunk, slice_ = self.name
            return pa.RecordBatch.from_arrays(
                [pa.array([w] * n, pa.int32()), pa.array([cell] * n, pa.int64()), pa.array([chunk] * n, pa.int32()), pa.array([slice_] * n, pa.int32()), pa.array([guest] * n), pa.array(rows[0][at]), pa.array(rows[1][at])],
                names=["w", "cell", "chunk", "slice", "as_guest", "c", "copies"],
            )

    return Codes


def _links(threshold: float):
    class Whole(_Block):
        def read(self, b):
            return [b.column(k).to_numpy() for k in (5, 6, 7)] + [_unit(_matrix(b.column(8)))]

        def begin(self):
            self.links = np.zeros(len(self.base[0]), dtype=np.int64)
            self.root = list(range(len(self.links)))

        def find(self, a: int) -> int:
            while self.root[a] != a:
                self.root[a] = self.root[self.root[a]]
                a = self.root[a]
            return a

        def join(self, a: int, b: int) -> None:
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)

        def among(self):
            u, copies = self.base[3], self.base[2]
            for lo in range(0, len(u), 512):
                hit = u[lo : lo + 512] @ u.T >= threshold
                hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
                self.links[lo : lo + 512] += hit @ copies
                a, b = np.nonzero(np.triu(hit, lo + 1))
                for p, q in zip((a + lo).tolist(), b.tolist(), strict=True):
                    self.join(p, q)

        def meet(self, rows):
            hit = rows[3] @ self.base[3].T >= threshold
            self.links += hit.T @ rows[2]
            count = hit @ self.base[2]
            at = np.flatnonzero(count)
            if not len(at):
                return
            first = hit.argmax(axis=1)
            for g, b in zip(*np.nonzero(hit), strict=True):
                self.join(int(first[g]), int(b))
            yield pa.RecordBatch.from_pydict({"c": rows[0][at], "rep": rows[1][at], "links": count[at].astype(np.int64), "root": self.base[1][first[at]]})

        def finish(self):
            at = np.flatnonzero(self.links)
            if len(at):
                yield pa.RecordBatch.from_pydict({"c": self.base[0][at], "rep": self.base[1][at], "links": self.links[at], "root": self.base[1][[self.find(int(k)) for k in at]]})

    return Whole
