"""Source divergence audit: term counts by source in mergeable radix tries, compared in byte order.

Each task counts its documents in byte tries with a counter for each source at the
leaves, cuts them at prefixes and sends the parts; Spark deals prefix ranges to
tasks, which merge what comes and drop rare terms. A second pass goes through the
merged tries in UTF-8 order and streams what each term adds to each pair of sources,
and the terms that each source has more often than its language, ties in that order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reconloom.llm.common import text_slices
from reconloom.llm.tries import COLUMNS, NAMES, Trie
from reconloom.sources.durable import durable, scratch

#: Bytes outside terms become spaces, A-Z lower case: a term is a run of ASCII letters and bytes of other characters.
_SEPARATES = {*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_FOLD = bytes(0x20 if b in _SEPARATES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: A text is counted in pieces of so many bytes, a task sends its tries when they have so many leaf counters.
PIECE, FLUSH = 1 << 22, 400_000
#: Bytes of the first cut; a prefix with more leaves over all tasks than WIDE is cut twice as deep, and again.
DEPTH, WIDE = 3, 4_000_000
#: Leaves of a merged block, and cells (sources x terms, or sources x sources) of a matrix.
BLOCK, CELLS = 8192, 1 << 20
#: Most tasks that blocks are dealt to.
TASKS = 20_000
SCALE = 1_000_000_000
_TRIE = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int64()), *[(c, pa.binary()) for c in NAMES]])


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(data):
        stop = len(data) if len(data) - start <= PIECE else data.find(b" ", start + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def source_hash(source: str) -> int:
    v = xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >> 63 else v


def count_tries(docs: DataFrame, depth: int = DEPTH, flush: int = FLUSH) -> DataFrame:
    """``lang, prefix, leaves`` and a packed trie, for each prefix a task has seen; reads ``lang, source, text``, none null.

    A document counts once for each of its terms in ``docs`` of the leaf. Holds ``flush`` counters and a piece of text."""

    def go(batches):
        documents: dict[str, Counter] = defaultdict(Counter)
        counts: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
        hashes: dict[str, int] = {}

        def sent():
            for lang, own in documents.items():
                yield from as_rows(lang, Trie.counted(own, counts[lang]), depth)

        for batch, texts in text_slices(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if source not in hashes:
                    hashes[source] = source_hash(source)
                known = None
                for piece in terms_of(text):
                    counts[lang][hashes[source]].update(piece)
                    known = set(piece) if known is None else known.union(piece)
                if known:
                    documents[lang].update(known)
            if sum(len(c) for by in counts.values() for c in by.values()) >= flush:
                yield from sent()
                documents.clear()
                counts.clear()
                hashes.clear()
        yield from sent()

    return docs.select("lang", "source", "text").mapInArrow(go, f"lang string, prefix binary, leaves long, {COLUMNS}")


def as_rows(lang: str, trie: Trie, depth: int) -> Iterator[pa.RecordBatch]:
    """The parts of a trie as rows, some at a time."""
    rows: dict[str, list] = {c: [] for c in _TRIE.names}
    for prefix, part in trie.cut(depth):
        for c, v in ({"lang": lang, "prefix": prefix, "leaves": len(part.terms)} | part.packed()).items():
            rows[c].append(v)
        if len(rows["lang"]) >= 2048:
            yield pa.RecordBatch.from_pydict(rows, schema=_TRIE)
            rows = {c: [] for c in _TRIE.names}
    if rows["lang"]:
        yield pa.RecordBatch.from_pydict(rows, schema=_TRIE)


def cut_deeper(parts: DataFrame, depth: int = DEPTH, wide: int = WIDE) -> DataFrame:
    """Cut the prefixes that have more than ``wide`` leaves over all tasks until none is left that can be cut."""
    while True:
        sums = parts.groupBy("lang", "prefix").agg(F.sum("leaves").alias("_sum")).where((F.col("_sum") > wide) & (F.octet_length("prefix") == depth))
        hot = durable(sums.select(F.col("lang").alias("_l"), F.col("prefix").alias("_p"), F.lit(True).alias("_wide")), "audit-wide")
        if hot.isEmpty():
            return parts
        depth *= 2
        both = parts.join(hot, (F.col("lang") == F.col("_l")) & (F.col("prefix") == F.col("_p")), "left")

        def deeper(batches, depth=depth):
            for batch in batches:
                for row in batch.to_pylist():
                    yield from as_rows(row["lang"], Trie.opened(row), depth)

        parts = durable(both.where("_wide is null").select(*parts.columns).unionByName(both.where("_wide").select(*parts.columns).mapInArrow(deeper, parts.schema)), "audit-parts")


def merge_ranges(parts: DataFrame, least_docs: int, block: int = BLOCK) -> DataFrame:
    """Blocks of merged leaves with at least ``least_docs`` documents: ``lang, leaves``, a trie, and ``sums``: (source, count) of the block.

    Spark sorts the parts by prefix range; a task merges the parts of one prefix at a time, in byte order."""
    schema = StructType.fromDDL(f"lang string, leaves long, {COLUMNS}, sums array<struct<source: long, n: long>>")

    def go(batches):
        now, held, fresh, waiting, size = None, [], 0, [], 0
        arrow = pa.schema([("lang", pa.string()), ("leaves", pa.int64()), *[(c, pa.binary()) for c in NAMES], ("sums", pa.list_(pa.struct([("source", pa.int64()), ("n", pa.int64())])))])

        def closed():
            nonlocal waiting, size
            whole = Trie.merged(waiting)
            for k in range(0, len(whole.terms), block):
                part = whole.part(k, min(k + block, len(whole.terms)))
                own, at = np.unique(part.sources, return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, at, part.counts)
                sums = [{"source": s, "n": n} for s, n in zip(own.tolist(), total.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in ({"lang": now[0], "leaves": len(part.terms)} | part.packed() | {"sums": sums}).items()}, schema=arrow)
            waiting, size = [], 0

        def merged():
            nonlocal held, fresh, size
            trie = Trie.merged(held)
            trie = trie.keep(trie.docs >= least_docs)
            held, fresh = [], 0
            if trie.terms:
                waiting.append(trie)
                size += len(trie.terms)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["lang"], row["prefix"])
                if now is not None and key != now:
                    merged()
                    if waiting and (size >= block or key[0] != now[0]):
                        yield from closed()
                now = key
                held.append(Trie.opened(row))
                fresh += row["leaves"]
                if fresh > max(1 << 17, len(held[0].terms)):  # as many again as the sum so far has
                    held, fresh = [Trie.merged(held)], 0
        if now is not None:
            merged()
            if waiting:
                yield from closed()

    return parts.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(go, schema)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)``, exact: three digits of the quotient at a time, so totals up to 9e15 fit."""
    rest, out = counts + 1, np.zeros_like(counts)
    whole, rest = rest // total, rest % total
    out = whole * SCALE
    for unit in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out += rest // total * unit
        rest = rest % total
    return out + 1


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top: int = 200, depth: int = DEPTH, flush: int = FLUSH, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """How far the sources of a language differ in their terms: ``lang, source, part, item, value, rank``.

    Terms are runs of ASCII letters and of all characters above 127, with A-Z lower-cased; a language keeps those in at
    least ``least_docs`` of its rows. With N the occurrences of kept terms and V their number, a source's share of a term
    is p = 1 + floor(1e9 (count + 1) / (N + V)), and so is the language's. Part "pair": for each other source, the sum
    over kept terms of floor((p - q)^2 / q), q being its share. Part "term": that of the ``top`` terms which the source
    has and more often than its language, whose share is q then. Ranks go by value, ties by item in UTF-8 order.

    Null lang, source and text are empty; sources without terms count as sources; a row is a document, repeated rows are
    several; very long texts are counted in pieces; an empty table gives an empty one; further columns are not read. The
    pairs are the square of a language's sources, as is the work for a term. Sources are known by 64-bit hashes on
    the way; two with one hash are an error.
    """
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with scratch() as made:
        parts = cut_deeper(durable(count_tries(named, depth, flush), "audit-parts"), depth, wide)
        blocks = durable(merge_ranges(parts, least_docs, block), "audit-blocks")
        groups = durable(_groups(named, blocks), "audit-groups")
        compared = durable(_compared(blocks, groups, top), "audit-compared")
        a, b = groups.select("lang", "source"), groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"))
        sums = compared.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        every = a.join(b, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))).drop("_l")
        pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        terms = compared.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return made.keep(pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.select(*pairs.columns, "rank")), "audit")


def _groups(named: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lang, source, hash, n, leaves``: every group, its occurrences of kept terms and the language's number of them."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([source_hash(s) for s in batch.column(1).to_pylist()], pa.int64())], names=["lang", "source", "hash"])

    known = named.select("lang", "source").distinct().mapInArrow(hashed, "lang string, source string, hash long")
    total = blocks.select(F.col("lang").alias("_l"), F.explode("sums").alias("_s")).groupBy("_l", F.col("_s.source").alias("_h")).agg(F.sum("_s.n").alias("n"))
    size = blocks.groupBy(F.col("lang").alias("_v")).agg(F.sum("leaves").alias("leaves"))
    full = known.join(total, (F.col("lang") == F.col("_l")) & (F.col("hash") == F.col("_h")), "left").join(size, F.col("lang") == F.col("_v"), "left")
    twins = F.count("*").over(Window.partitionBy("lang", "hash"))
    sure = F.when(twins > 1, F.raise_error(F.lit("two sources have one hash")).cast("long")).otherwise(F.coalesce("n", F.lit(0)))
    return full.select("lang", "source", "hash", sure.alias("n"), F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"))


def _compared(blocks: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``lang, source, part, item, value``: sums of blocks for each pair, and the best terms of blocks for each source."""
    sources = groups.groupBy(F.col("lang").alias("_l")).agg(F.array_sort(F.collect_list(F.struct("hash", "source", "n"))).alias("members"), F.first("leaves").alias("v"))
    work = blocks.drop("sums", "leaves").join(sources, F.col("lang") == F.col("_l")).drop("_l")
    # bands of sources keep the matrix of pairs within bounds
    band = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.size("members")).cast("int"))
    work = work.withColumn("band", band).withColumn("first", F.explode(F.expr("sequence(0, size(members) - 1, band)")))
    work = work.repartition(max(1, min(TASKS, blocks.count())))  # a block is much work for its bytes
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def go(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        names: dict[str, list[str]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["lang"], row["first"])
                names[row["lang"]] = [s["source"] for s in row["members"]]
                if key not in sums and len(sums) >= 4:
                    yield from as_pairs(sums, names)
                    sums.clear()
                total, best = block_sums(row, top)
                sums[key] = total if key not in sums else sums[key] + total
                yield from best
        yield from as_pairs(sums, names)

    def as_pairs(sums, names):
        for (lang, first), total in sums.items():
            own = names[lang]
            for k in range(len(total)):
                others = [j for j in range(len(own)) if j != first + k]
                if others:
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(others), "source": [own[first + k]] * len(others), "part": ["pair"] * len(others), "item": [own[j] for j in others], "value": total[k, others]}, schema=out)

    def block_sums(row, top):
        trie = Trie.opened(row)
        own, first, stop = row["members"], row["first"], min(row["first"] + row["band"], len(row["members"]))
        hashes, n = np.array([s["hash"] for s in own], np.int64), np.array([s["n"] for s in own], np.int64)
        place = np.searchsorted(hashes, trie.sources)
        leaf = np.repeat(np.arange(len(trie.terms)), np.diff(trie.ends, prepend=0))
        total, best = np.zeros((stop - first, len(own)), np.int64), []
        step = max(1, CELLS // len(own))
        held: list[list[tuple[int, bytes]]] = [[] for _ in range(stop - first)]
        for a in range(0, len(trie.terms), step):
            b = min(a + step, len(trie.terms))
            some = slice(*np.searchsorted(leaf, [a, b]))
            c = np.zeros((len(own), b - a), np.int64)
            c[place[some], leaf[some] - a] = trie.counts[some]
            p = shares(c, (n + row["v"])[:, None])
            q = shares(c.sum(axis=0), np.int64(n.sum() + row["v"]))
            for k in range(first, stop):
                d = p[k] - p
                total[k - first] += (d * d // p).sum(axis=1)
                more = np.flatnonzero((c[k] > 0) & (p[k] > q))
                value = (p[k][more] - q[more]) ** 2 // q[more]
                # a stable sort keeps the byte order of terms with one value
                chosen = np.argsort(-value, kind="stable")[:top]
                held[k - first] = sorted(held[k - first] + [(-int(value[j]), trie.terms[a + more[j]]) for j in chosen])[:top]
        for k, found in enumerate(held):
            if found:
                best.append(pa.RecordBatch.from_pydict({"lang": [row["lang"]] * len(found), "source": [own[first + k]["source"]] * len(found), "part": ["term"] * len(found), "item": pc.cast(pa.array([t for _, t in found], pa.binary()), pa.string()), "value": [-v for v, _ in found]}, schema=out))
        return total, best

    return work.mapInArrow(go, "lang string, source string, part string, item string, value long")
