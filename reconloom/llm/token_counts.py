"""Token counts by the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each on its own. Most
pre-tokens are vocabulary entries that the merges rebuild as one token; which
entries are, is proved once before the job by encoding every entry alone. Then a
pre-token in that set counts 1 and only the rest is merged.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reconloom.llm.common import carry, text_slices, with_fields
from reconloom.llm.ranks import piece_encoder

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters go to the library whole: its Unicode tables may be of another version.
_COVERED = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞₠-₿Α-ΡΣ-ωЀ-џ]*")
_SPLIT = regex.compile(PATTERN)
#: Most entries of a worker's memo.
MEMO = 400_000


def whole_tokens(path: str) -> set[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        special = {x["content"] for x in json.load(f)["added_tokens"]}
    decoded = tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=False)
    names = [s for s in decoded if s and "�" not in s and s not in special and _COVERED.fullmatch(s) and _SPLIT.fullmatch(s)]
    return {s for s, e in zip(names, tok.encode_batch(names, add_special_tokens=False), strict=True) if len(e.ids) == 1}


class _Chunks(dict):
    """Tokens of a chunk that starts at a pre-token boundary, remembered."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        n = self.counter.split_count(chunk)
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = n
        return n


class Counter:
    """Counts as the library would; ``special`` strings in a text are its special tokens."""

    def __init__(self, path: str, whole: set[str]):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole = whole
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.merge = piece_encoder(spec["model"])
        self.chunks = _Chunks(self)
        self.merged = 0

    def library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def split_count(self, chunk: str) -> int:
        n, rest, whole = 0, [], self.whole
        for piece in _SPLIT.findall(chunk):
            if piece in whole:
                n += 1
            else:
                rest.append(piece)
        if rest:
            self.merged += len(rest)
            n += sum([len(self.merge(p.encode("utf-8"))) for p in rest])
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or not _COVERED.fullmatch(text):
            return self.library(text)
        # a single space between two other characters always starts a pre-token
        parts = text.split(" ")
        if "" in parts or "\n " in text or " \n" in text or "\t " in text or " \t" in text or "\r " in text or " \r" in text:
            return self.split_count(text)
        chunks = self.chunks
        return self.split_count(parts[0]) + sum([chunks[" " + p] for p in parts[1:]])


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` is a tokenizer file in the ``tokenizers`` format with a byte-level
    BPE, present on every worker. A null text counts as empty; columns with the
    names of the results are replaced.
    """
    base = docs.drop("n_bytes", "n_tokens", "over_limit")
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def apply(batches):
        if path not in _counters:
            _counters[path] = Counter(path, proved.value)
        counter = _counters[path]
        for batch, texts in text_slices(batches, text):
            n = [counter.count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield carry(batch, n_bytes=pa.array(size, pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n]))

    return base.mapInArrow(apply, with_fields(base, "n_bytes long, n_tokens long, over_limit boolean"))
