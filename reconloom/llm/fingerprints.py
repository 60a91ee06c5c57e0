"""Document fingerprints from prefix polynomial hashes.

For code points c0, c1, ... the prefix array holds, modulo two primes,
S[i] = c0 + c1*B + ... + c(i-1)*B^(i-1). The hash of the span [i, j) shifted to
the origin is (S[j] - S[i]) * B^-i, so any two spans compare in constant time
and the longest common extension of two places is found by binary search.

The fingerprint keeps the length, the whole hash, at places on a geometric grid
the hash of the prefix and of the suffix there, and the KEPT smallest hashes of
all spans of SPAN code points, wherever they stand. Prefixes and suffixes show
what two texts have in common at either end, the spans what they have in common
anywhere, so an insertion in front or edits in several places do not hide it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from reconloom.llm.common import codepoints
from reconloom.llm.packed import mixed

#: Two primes under 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245 % 2147483647, 69069 * 7919 % 2147483629)
#: Step of the kept prefixes, as powers of two of the place, and places for each octave.
OCTAVE = 8
#: Most id ranges: bounds the table of range heads, which is broadcast.
MOST_RANGES = 20_000
_BLOCK = 1024
#: Length of the kept spans, and how many are kept.
SPAN, KEPT = 24, 64
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_inverses: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(k: int, n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^(n-1), or B^0 .. B^(1-n), modulo the k-th prime; grown by doubling."""
    p, held = np.uint64(PRIMES[k]), _inverses if inverse else _powers
    while len(held[k]) < n:
        old = held[k]
        held[k] = np.concatenate([old, old * np.uint64(pow(BASES[k], -len(old) if inverse else len(old), PRIMES[k])) % p])
    return held[k][:n]


def prefixes(codes: np.ndarray) -> np.ndarray:
    """The two prefix arrays, each with n + 1 entries."""
    n = len(codes)
    out = np.zeros((2, n + 1), dtype=np.uint64)
    c = codes.astype(np.uint64)
    for k in (0, 1):
        p = np.uint64(PRIMES[k])
        terms = c * _power(k, n) % p
        pad = -n % _BLOCK
        blocks = np.concatenate([terms, np.zeros(pad, dtype=np.uint64)]).reshape(-1, _BLOCK).cumsum(axis=1)
        ends = blocks[:, -1] % p
        before = np.concatenate([[np.uint64(0)], ends.cumsum()[:-1] if len(ends) else ends]) if len(ends) else ends
        out[k, 1:] = ((blocks + before[:, None]) % p).reshape(-1)[:n]
    return out


def span(s: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Hash of the span [i, j), the same wherever it stands."""
    return tuple((int(s[k, j]) - int(s[k, i])) * int(_power(k, i + 1, True)[i]) % PRIMES[k] for k in (0, 1))


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the longest common extension to the right of place i of one text and j of the other."""
    low, high = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        if span(a, i, i + mid) == span(b, j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def common_end(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common end of two texts."""
    n, m = a.shape[1] - 1, b.shape[1] - 1
    low, high = 0, min(n, m)
    while low < high:
        mid = (low + high + 1) // 2
        if span(a, n - mid, n) == span(b, m - mid, m):
            low = mid
        else:
            high = mid - 1
    return low


def kept_spans(s: np.ndarray) -> np.ndarray:
    """The KEPT smallest different hashes, 32 bits of each, of all spans of SPAN code points."""
    n = s.shape[1] - SPAN
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    p = np.uint64(PRIMES[0])
    h = (s[0, SPAN:] + p - s[0, :n]) % p * _power(0, n, True) % p
    h = mixed(h + np.uint64(1)) >> np.uint64(32)
    if n > 8 * KEPT:  # most spans differ: the smallest are among these but for texts that repeat themselves
        some = np.unique(np.partition(h, 2 * KEPT)[: 2 * KEPT])
        if len(some) >= KEPT:
            return some[:KEPT].astype(np.uint32)
    return np.unique(h)[:KEPT].astype(np.uint32)


def grid(n: int) -> list[int]:
    """Kept lengths up to n: every one up to 2 * OCTAVE, then OCTAVE for each doubling. The same for all texts."""
    out, x = [], 1
    while x <= n:
        out.append(x)
        x += max(1, (1 << (x.bit_length() - 1)) // OCTAVE)
    return out


def encode(s: np.ndarray) -> str:
    """Fingerprint of the text with prefix arrays ``s``: hex of its length and whole hash, then of its grid."""
    n = s.shape[1] - 1
    ends = np.array(grid(n), dtype=np.int64)
    whole = span(s, 0, n)
    head = s[:, ends]
    tail = np.empty_like(head)
    for k in (0, 1):
        p = PRIMES[k]
        # inverse powers of the suffix starts, from the one of n
        inverse = pow(BASES[k], -n, p)
        raised = _power(k, int(ends[-1]) + 1 if len(ends) else 1)[ends] * np.uint64(inverse) % np.uint64(p)
        tail[k] = (s[k, n] + np.uint64(p) - s[k, n - ends]) % np.uint64(p) * raised % np.uint64(p)
    fold = lambda x: ((x[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1] * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(40)  # noqa: E731  24 bits of each place
    with np.errstate(over="ignore"):
        places = np.concatenate([fold(head), fold(tail)]).astype(">u4")
    return struct.pack(">QII", n, *whole).hex() + places.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex() + kept_spans(s).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of the longer text that two fingerprints show as common, 0 to 1: start and end together, or spans anywhere,
    whichever shows more. The share of spans is estimated from those kept, to about 0.06."""
    if a == b:
        return 1.0
    n, m = int(a[:16], 16), int(b[:16], 16)
    shorter, longer = min(n, m), max(n, m)
    if not shorter:
        return 0.0
    return max(_ends(a, b, n, m, shorter) / longer, _anywhere(a, b, n, m))


def _anywhere(a: str, b: str, n: int, m: int) -> float:
    x, y = (set(int(t[k : k + 8], 16) for k in range(32 + 12 * len(grid(size)), len(t), 8)) for t, size in ((a, n), (b, m)))
    if not x or not y:
        return 0.0
    lowest = sorted(x | y)[: max(1, min(KEPT, len(x | y)))]
    jaccard = sum(h in x and h in y for h in lowest) / len(lowest)
    one, two = max(n - SPAN + 1, 1), max(m - SPAN + 1, 1)
    return min(1.0, jaccard * (one + two) / (1 + jaccard) / max(one, two))


def _ends(a: str, b: str, n: int, m: int, shorter: int) -> int:
    """Common start and end as the kept prefixes and suffixes show them."""
    lengths = grid(shorter)
    at = [(32 + 6 * len(grid(n)) * side, 32 + 6 * len(grid(m)) * side) for side in (0, 1)]
    found = 0
    for x, y in at:
        low, high = 0, len(lengths)
        while low < high:  # prefixes agree up to some length and differ beyond it
            mid = (low + high + 1) // 2
            if a[x + 6 * (mid - 1) : x + 6 * mid] == b[y + 6 * (mid - 1) : y + 6 * mid]:
                low = mid
            else:
                high = mid - 1
        found += lengths[low - 1] if low else 0
    return min(found, shorter)


def _edit(text: str, after: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` plus the fingerprint of each whole text (null: empty)."""
    made = arrow_udf(lambda s: pa.array([encode(prefixes(codepoints(t or ""))) for t in s.to_pylist()], pa.string()), "string")
    return docs.withColumn(name, made(F.col(text)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_each: int = 4000) -> DataFrame:
    """``(dest, own, doc_id, text)``: rows dealt to ranges of ids, each range closed by a copy of the row that follows it.

    Range borders come from approximate quantiles of the ids (about ``rows_each``
    rows a range), range heads from a count by range; both hold a number or two
    for each range. Only the head rows are sent twice. Ids that are null come
    first, as one range of their own.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    total = ids.count()
    parts = min(MOST_RANGES, max(1, -(-total // rows_each)))
    borders = np.unique(np.array(ids.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else [], dtype=np.float64).astype(np.int64))

    @arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(borders, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right") + 1
        return pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), at, 0).astype(np.int32))

    dealt = ids.select(place("id").alias("dest"), "id")
    heads = {r["dest"]: r["id"] for r in dealt.groupBy("dest").agg(F.min("id").alias("id")).collect()}
    order = sorted(heads)
    before = {order[k]: order[k - 1] for k in range(len(order))}  # the first range closes the last
    spread = docs.sparkSession.createDataFrame([(d, heads[d], before[d]) for d in order], "dest int, head long, back int")
    rows = docs.select(place(F.col(doc_id).cast("long")).alias("dest"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    marked = rows.join(F.broadcast(spread), "dest", "left")
    return marked.select(
        F.explode(F.expr("if(doc_id <=> head, array(struct(dest, 1 as own), struct(back as dest, 0 as own)), array(struct(dest, 1 as own)))")).alias("to"), "doc_id", "text"
    ).select("to.dest", "to.own", "doc_id", "text")


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_each: int = 4000) -> DataFrame:
    """Fingerprint every whole text and its edited text: the last half of its code points replaced by as many of the next row's.

    The next row is by ascending id (equal ids: by text; null ids first); the
    first row follows the last. Null texts are empty. A single row follows
    itself. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, same_start, same_end``: the
    likeness of the text's fingerprint to that of the edited text and of the next
    row's text, and the code points that text and edited text have in common at
    either end, found by binary search in their prefix arrays. An empty table
    gives an empty one; further columns, whatever their names, are not read.
    """
    schema = StructType.fromDDL("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start long, same_end long")
    dealt = with_next(docs, doc_id, text, rows_each)
    ranges = sorted(r["dest"] for r in dealt.select("dest").distinct().collect())  # MOST_RANGES numbers at most
    parts = max(1, len(ranges))
    # numbers that hash to each of the tasks in turn, so that each task gets one range
    spread = dict(docs.sparkSession.range(20 * parts + 100).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("task"), F.col("id").cast("int").alias("id")).groupBy("task").agg(F.min("id")).collect())
    turn = {d: spread.get(k) for k, d in enumerate(ranges)}
    deal = arrow_udf(lambda d: pa.array([turn[x] if turn[x] is not None else -1 - x for x in d.to_pylist()], pa.int32()), "int")
    sorted_rows = dealt.withColumn("task", deal("dest")).repartition(parts, "task").drop("task").sortWithinPartitions("dest", F.desc("own"), F.col("doc_id").asc_nulls_first(), "text")

    def apply(batches):
        held: list = []
        last = None  # (dest, id, text, prefix arrays, fingerprint)
        closed = None

        def row(a, b):
            edited = _edit(a[2], b[2])
            s = prefixes(codepoints(edited))
            e = encode(s)
            start = common_extension(a[3], 0, s, 0)
            end = min(common_end(a[3], s), min(a[3].shape[1], s.shape[1]) - 1 - start) if a[2] != edited else 0
            return (a[1], len(a[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a[4], e, likeness(a[4], e), likeness(a[4], b[4]), start, end)

        def flush():
            cols = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=schema.names)

        for batch in batches:
            cols = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                dest, own, i, t = (c[k].as_py() for c in cols)
                if not own and closed == dest:
                    continue  # further rows with the head's id
                s = prefixes(codepoints(t))
                this = (dest, i, t, s, encode(s))
                if last is not None and last[0] == dest:
                    held.append(row(last, this))
                if own:
                    last = this
                else:
                    closed, last = dest, None
                if len(held) >= 500:
                    yield flush()
        if held:
            yield flush()

    return sorted_rows.mapInArrow(apply, schema)
