"""Best-fit packing of token sequences by the linear grouping scheme.

Piece lengths are integers up to the sequence length, so their histogram has a
fixed size however many documents there are. The plan is made on it: lengths
above a threshold are cut, longest first, into groups of equal count and rounded
up to the longest of their group; the few sizes that remain are combined into
configurations by a linear program with generated columns; the slots of each
configuration take the actual pieces of their group; what the actual lengths
leave over, and further sequences, take the pieces that no whole configuration
holds and the small ones by best fit, longest first. This is done for several
thresholds and numbers of groups, and the plan with the fewest sequences is taken.
The plan says for each length which ranks go to which sequences and places; a
distributed rank within each length does the rest.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reconloom.llm.common import fresh, text_slices, words
from reconloom.llm.ranks import MARK, piece_encoder
from reconloom.sources.durable import durable

#: Most entries of a worker's memo of word tokens.
MEMO = 300_000
#: Fixed value: the split pattern of the tokenizer file.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters on whose case, class and composition all libraries agree.
_COVERED = regex.compile("[\x21-\x7e\u00a1-\u024f\u2010-\u2027\u20a0-\u20bf]*")
#: Parts that the pieces of one length are ranked in.
RANK_PARTS = 1024


class WordTokens:
    """Ids of a tokenizer that drops white space, so that each word's tokens stand alone; remembered by word.

    New words go through the same merges by a faster route: a rank encoder to
    which the end-of-word mark is one more byte, 0xff, that UTF-8 never has. Every
    byte with the mark ranks before all merges, so the mark joins its byte first,
    as in the tokenizer file. Words with characters whose Unicode data may differ
    between libraries, or with a special token, are encoded by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.merge = piece_encoder(spec["model"]) if spec["model"].get("end_of_word_suffix") else None
        self.parts: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def encode(self, word: bytes) -> bytes:
        if self.merge is not None:
            if word.isalpha():  # ASCII letters
                return self.part(word.lower())
            last = word[-1:]
            if word[:-1].isalpha() and last.isascii() and not last.isalnum() and last > b" " and last != b"\x7f":
                return self.part(word[:-1].lower()) + self.part(last)
        text = word.decode("utf-8", "surrogatepass")
        if self.merge is None or not _COVERED.fullmatch(text) or any(x in text for x in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        lowered = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return b"".join([self.part(p.encode("utf-8")) for p in _PRETOKEN.findall(lowered)])

    def part(self, piece: bytes) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            got = array("I", self.merge(piece + MARK)).tobytes()
            if len(self.parts) >= MEMO:
                self.parts.clear()
            self.parts[piece] = got
        return got

    def ids(self, own: list[bytes]) -> bytes:
        """Little-endian unsigned 32-bit ids of the words."""
        known = self.known
        missing = {w for w in own if w not in known}
        if len(known) + len(missing) > MEMO:
            known.clear()
            missing = set(own)
        for w in missing:
            known[w] = self.encode(w)
        return b"".join([known[w] for w in own])


_tokens: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and its end id, cut only where longer than ``limit``.

    A null text counts as empty: its one piece is the end id. A repeated row gives repeated pieces.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])
    end = int(end_id).to_bytes(4, "little")

    def apply(batches):
        if path not in _tokens:
            _tokens[path] = WordTokens(path)
        tokens = _tokens[path]
        for batch, texts in text_slices(batches):
            at, n, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts):
                packed = tokens.ids(words(t)) + end
                for k, lo in enumerate(range(0, len(packed), 4 * limit)):
                    part = packed[lo : lo + 4 * limit]
                    at.append(i)
                    n.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=schema.names)

    return rows.mapInArrow(apply, schema)


@dataclass
class Plan:
    """Segments by (length, first rank): ``per`` consecutive ranks to each sequence from ``bin`` on, the first at ``offset``."""

    limit: int
    bins: int = 0
    grouped: int = 0  # pieces that a configuration placed
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def put(self, length: int, rank: int, count: int, first: int, per: int, offset: int) -> None:
        for name, v in zip(("length", "rank", "count", "bin", "per", "offset"), (length, rank, count, first, per, offset), strict=True):
            getattr(self, name).append(int(v))

    def arrays(self) -> dict[str, np.ndarray]:
        got = {k: np.array(getattr(self, k), dtype=np.int64) for k in ("length", "rank", "count", "bin", "per", "offset")}
        order = np.lexsort((got["rank"], got["length"]))
        return {k: v[order] for k, v in got.items()}


def fullest(worth: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The counts by size that fit ``limit`` and are worth most, sizes repeated at will."""
    best = np.zeros(limit + 1)
    used = np.full(limit + 1, -1, dtype=np.int64)
    for g in np.flatnonzero(worth > 1e-12):
        s = int(sizes[g])
        for lo in range(s, limit + 1, s):  # one more of g at a time, a block of s sums at once
            hi = min(lo + s, limit + 1)
            more = best[lo - s : hi - s] + worth[g]
            at = np.flatnonzero(more > best[lo:hi] + 1e-12) + lo
            best[at], used[at] = more[at - lo], g
    take = np.zeros(len(sizes), dtype=np.int64)
    x = int(best.argmax())
    value = float(best[x])
    while used[x] >= 0:
        take[used[x]] += 1
        x -= int(sizes[used[x]])
    return value, take


def configurations(sizes: np.ndarray, counts: np.ndarray, limit: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations (counts by size) and how often each is used: whole parts of the linear program's solution.

    Least number of sequences that hold ``counts`` pieces of ``sizes``, fractions
    allowed, by the simplex method: a basis of as many configurations as there are
    sizes, and each round the configuration that the dual prices make worth most.
    Any round's basis can be used, so stopping early costs sequences only. What
    the whole parts leave out is for the best fit.
    """
    basis = np.diag(limit // sizes).astype(np.float64)  # a column is a configuration
    x = counts / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, take = fullest(prices, sizes, limit)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, take.astype(np.float64))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = take
    left, found = counts.copy(), []
    for j in np.argsort(-x):
        take = np.round(basis[:, j]).astype(np.int64)
        times = int(min(np.floor(x[j] + 1e-6), (left[take > 0] // take[take > 0]).min()))
        if times > 0:
            found.append((take, times))
            left -= take * times
    return found


#: What is tried in turn: number of groups, and the share of the limit above which a piece counts as large. Best fit alone is last.
TRIES = ((48, 1 / 8), (48, 1 / 5), (48, 1 / 4), (48, 1 / 3), (128, 1 / 3), (0, 1.0))


def plan(histogram: np.ndarray, limit: int, tries: tuple = TRIES) -> Plan:
    """Plan sequences for ``histogram[l]`` pieces of each length l (1 to ``limit``).

    ``tries`` are gone through until a plan needs no more sequences than the tokens fill; the fewest sequences win,
    of equal ones the first, which has the most pieces in configurations."""
    hist = np.asarray(histogram, dtype=np.int64)
    least = -(-int((hist * np.arange(limit + 1)).sum()) // limit)
    best = None
    for groups, large in tries:
        made = _plan(hist, limit, groups, large)
        if best is None or made.bins < best.bins:
            best = made
        if best.bins <= least:
            break
    return best


def _plan(hist: np.ndarray, limit: int, groups: int, large: float) -> Plan:
    out = Plan(limit)
    used = np.zeros(limit + 1, dtype=np.int64)  # ranks given out by length
    open_: dict[int, list[tuple[int, int]]] = {}  # residual: sequences (first, count)
    rooms: list[int] = []

    def leave(residual: int, first: int, count: int) -> None:
        if residual and count:
            if residual not in open_:
                open_[residual] = []
                insort(rooms, residual)
            open_[residual].append((first, count))

    border = max(1, int(limit * large))
    lengths = [l for l in range(limit, border, -1) if hist[l]]  # noqa: E741
    rest = hist.copy()  # for best fit
    total = int(sum(hist[l] for l in lengths))
    if total and groups:
        each = -(-total // min(groups, total))
        runs: list[list[list[int]]] = []  # by group: [length, count]
        room = 0
        for l in lengths:  # noqa: E741
            n = int(hist[l])
            while n:
                if not room:
                    runs.append([])
                    room = each
                k = min(n, room)
                runs[-1].append([l, k])
                n, room = n - k, room - k
        # groups that a common length fills are one size
        sizes = np.array(sorted({r[0][0] for r in runs}, reverse=True), dtype=np.int64)
        merged = {int(s): [x for r in runs if r[0][0] == s for x in r] for s in sizes}
        runs = [merged[int(s)] for s in sizes]
        counts = np.array([sum(c for _, c in r) for r in runs], dtype=np.int64)
        for take, times in configurations(sizes, counts, limit):
            slots = np.repeat(np.arange(len(sizes)), take)
            out.grouped += times * len(slots)
            while times:
                # the longest stretch over which no slot changes its actual length
                need: dict[int, int] = {}
                for g in slots:
                    need[g] = need.get(g, 0) + 1
                n = min(times, *[max(1, runs[g][0][1] // k) for g, k in need.items()])
                offset = 0
                for g in slots:
                    run = runs[g][0]
                    if run[1] < n:  # only when n is 1 and the run has just ended
                        runs[g].pop(0)
                        run = runs[g][0]
                    out.put(run[0], used[run[0]], n, out.bins, 1, offset)
                    used[run[0]] += n
                    rest[run[0]] -= n
                    run[1] -= n
                    offset += run[0]
                    if not run[1]:
                        runs[g].pop(0)
                leave(limit - offset, out.bins, n)
                out.bins += n
                times -= n
    for l in range(limit, 0, -1):  # noqa: E741
        n = int(rest[l])
        while n:
            k = bisect_left(rooms, l)
            if k == len(rooms):
                fresh = -(-n // (limit // l))
                leave(limit, out.bins, fresh)
                out.bins += fresh
                continue
            r = rooms[k]
            first, count = open_[r].pop()
            if not open_[r]:
                del open_[r]
                rooms.pop(k)
            per = min(r // l, n)
            m = min(count, n // per)
            out.put(l, used[l], m * per, first, per, limit - r)
            used[l] += m * per
            n -= m * per
            leave(r - per * l, first, m)
            leave(r, first + m, count - m)
    return out


def pack(cut: DataFrame, limit: int = 4096) -> DataFrame:
    """All columns of ``cut`` (which has ``length``, 1 to ``limit``) plus ``sequence_id`` and ``offset``.

    Pieces of one length are ranked by hash parts whose counts are added up
    first, so a length with a third of all pieces is spread. The plan that is
    sent to the workers is bounded by ``limit``. Pieces may repeat; an empty
    table gives an empty one.
    """
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    part, place, size, before = (fresh(cut, c) for c in ("part", "place", "size", "before"))
    rows = cut.select(*names).withColumn(part, F.pmod(F.xxhash64(*names), F.lit(RANK_PARTS)).cast("int"))
    counts = durable(rows.groupBy("length", part).agg(F.count("*").alias(size)), "pack-counts")
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum(size).alias("n")).collect():
        histogram[r["length"]] = r["n"]
    segments = cut.sparkSession.sparkContext.broadcast(plan(histogram, limit).arrays())
    earlier = counts.select("length", part, (F.sum(size).over(Window.partitionBy("length").orderBy(part)) - F.col(size)).alias(before))
    ranked = rows.join(earlier, ["length", part]).withColumn(place, F.col(before) + F.row_number().over(Window.partitionBy("length", part).orderBy(*names)) - 1)
    schema = StructType([*[cut.schema[c] for c in names], *StructType.fromDDL("sequence_id long, offset long").fields])

    def apply(batches):
        s = segments.value
        keys = (s["length"] << 44) + s["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", place))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            step = rank - s["rank"][at]
            seq, off = s["bin"][at] + step // s["per"][at], s["offset"][at] + step % s["per"][at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(apply, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents; see ``pieces`` and ``pack``."""
    return pack(durable(pieces(docs, path, limit, end_id, doc_id, text), "pack-pieces"), limit)
