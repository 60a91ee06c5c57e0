"""Radix tries of byte strings, flat: leaves in byte order, each with what it shares with the leaf before.

A leaf that shares k bytes with the one before branches off an inner node at depth
k, so the lengths alone give the tree; the bytes below that node are stored once.
Every leaf has a document count and a counter for each source that has the term.
Tries of equal prefixes merge leaf by leaf, and a trie can be cut at any prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Arrow columns of a trie: leaf lengths of shared and added bytes, added bytes, documents, sources a leaf, sources, counts.
COLUMNS = "shared binary, added binary, rest binary, docs binary, runs binary, sources binary, counts binary"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


@dataclass
class Trie:
    """Terms in byte order with ``docs``; ``sources`` and ``counts`` of term i lie between ``ends[i - 1]`` and ``ends[i]``."""

    terms: list[bytes]
    docs: np.ndarray
    ends: np.ndarray
    sources: np.ndarray
    counts: np.ndarray

    def part(self, start: int, stop: int) -> Trie:
        a, b = int(self.ends[start - 1]) if start else 0, int(self.ends[stop - 1]) if stop else 0
        return Trie(self.terms[start:stop], self.docs[start:stop], self.ends[start:stop] - a, self.sources[a:b], self.counts[a:b])

    def keep(self, mask: np.ndarray) -> Trie:
        runs = np.diff(self.ends, prepend=0)
        of = np.repeat(mask, runs)
        return Trie([t for t, k in zip(self.terms, mask.tolist(), strict=True) if k], self.docs[mask], np.cumsum(runs[mask]), self.sources[of], self.counts[of])

    def cut(self, depth: int) -> Iterator[tuple[bytes, Trie]]:
        """The sub-tries below each prefix of ``depth`` bytes (or shorter whole term), in byte order."""
        start = 0
        for i in range(1, len(self.terms) + 1):
            if i == len(self.terms) or self.terms[i][:depth] != self.terms[start][:depth]:
                yield self.terms[start][:depth], self.part(start, i)
                start = i

    def packed(self) -> dict[str, bytes]:
        shared = shared_lengths(self.terms)
        lengths = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        return {
            "shared": shared.astype(np.uint32).tobytes(), "added": (lengths - shared).astype(np.uint32).tobytes(), "rest": b"".join([t[k:] for t, k in zip(self.terms, shared.tolist(), strict=True)]),
            "docs": self.docs.astype(np.int64).tobytes(), "runs": np.diff(self.ends, prepend=0).astype(np.uint32).tobytes(), "sources": self.sources.astype(np.int64).tobytes(), "counts": self.counts.astype(np.int64).tobytes(),
        }

    @classmethod
    def opened(cls, row: dict[str, bytes]) -> Trie:
        """The leaves of a packed trie, in byte order."""
        rest, terms, at, last = row["rest"], [], 0, b""
        for k, n in zip(np.frombuffer(row["shared"], np.uint32).tolist(), np.frombuffer(row["added"], np.uint32).tolist(), strict=True):
            last = last[:k] + rest[at : at + n]
            terms.append(last)
            at += n
        ends = np.cumsum(np.frombuffer(row["runs"], np.uint32).astype(np.int64))
        return cls(terms, np.frombuffer(row["docs"], np.int64), ends, np.frombuffer(row["sources"], np.int64), np.frombuffer(row["counts"], np.int64))

    @classmethod
    def counted(cls, docs: dict[bytes, int], by_source: dict[int, dict[bytes, int]]) -> Trie:
        """From counters of a task: documents of each term, and occurrences by source."""
        terms = sorted(docs)
        place = {t: i for i, t in enumerate(terms)}
        total = sum(map(len, by_source.values()))
        at = np.fromiter((place[t] for own in by_source.values() for t in own), np.int64, total)
        source = np.repeat(np.fromiter(by_source, np.int64, len(by_source)), [len(own) for own in by_source.values()])
        count = np.fromiter((n for own in by_source.values() for n in own.values()), np.int64, total)
        return cls(terms, np.fromiter((docs[t] for t in terms), np.int64, len(terms)), *_by_leaf(len(terms), at, source, count))

    @classmethod
    def merged(cls, parts: list[Trie]) -> Trie:
        """One trie with the sums of all."""
        if len(parts) == 1:
            return parts[0]
        place: dict[bytes, int] = {}
        at = [np.fromiter((place.setdefault(t, len(place)) for t in p.terms), np.int64, len(p.terms)) for p in parts]
        terms = sorted(place)
        rank = np.empty(len(terms), np.int64)
        rank[np.fromiter((place[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms))
        docs = np.zeros(len(terms), np.int64)
        for p, own in zip(parts, at, strict=True):
            docs[rank[own]] += p.docs  # a trie has a term once
        leaf = np.concatenate([np.repeat(rank[own], np.diff(p.ends, prepend=0)) for p, own in zip(parts, at, strict=True)])
        return cls(terms, docs, *_by_leaf(len(terms), leaf, np.concatenate([p.sources for p in parts]), np.concatenate([p.counts for p in parts])))


def _by_leaf(n: int, leaf: np.ndarray, source: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ends, sources, counts`` with one counter for each source of a leaf."""
    order = np.lexsort((source, leaf))
    leaf, source, count = leaf[order], source[order], count[order]
    if not len(leaf):
        return np.zeros(n, np.int64), source, count
    starts = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1])))
    return np.cumsum(np.bincount(leaf[starts], minlength=n)), source[starts], np.add.reduceat(count, starts)


def shared_lengths(terms: list[bytes], width: int = 24) -> np.ndarray:
    """Bytes that each term shares with the one before."""
    out = np.zeros(len(terms), np.int64)
    if len(terms) < 2:
        return out
    lengths = np.fromiter(map(len, terms), np.int64, len(terms))
    head = np.array(terms, dtype=f"S{width}").view(np.uint8).reshape(len(terms), width)
    other = head[1:] != head[:-1]
    k = np.where(other.any(axis=1), other.argmax(axis=1), width)
    out[1:] = np.minimum(k, np.minimum(lengths[1:], lengths[:-1]))
    for i in np.flatnonzero(k == width) + 1:
        a, b, n = terms[i - 1], terms[i], int(min(lengths[i - 1], lengths[i]))
        low, high = min(n, width), n  # the longest common start, by halving
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
        out[i] = low
    return out
