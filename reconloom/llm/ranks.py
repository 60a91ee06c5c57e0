"""A fast encoder of single pre-tokens for byte-level BPE files."""

from __future__ import annotations

from collections.abc import Callable

#: Stands for the end-of-word mark: a byte that UTF-8 never has.
MARK = b"\xff"


def byte_names() -> dict[str, int]:
    """The characters by which such files name bytes: printable ones themselves, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}


def piece_encoder(model: dict) -> Callable[[bytes], list[int]]:
    """Ids of one pre-token's bytes by the merges of a ``tokenizers`` model, in the order of its list of merges.

    Where the model has an end-of-word mark, MARK ends the bytes; every byte with
    the mark ranks before all merges, so the mark joins its byte first. A merge of
    tokens that come later than their product is an error: ranks cannot express it.
    """
    import tiktoken

    names, mark = byte_names(), model.get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        ended = bool(mark) and token.endswith(mark)
        return bytes(names[c] for c in (token.removesuffix(mark) if ended else token)) + (MARK if ended else b"")

    alphabet = [c + m for m in (["", mark] if mark else [""]) for c in names]
    ids = [model["vocab"][t] for t in alphabet if t in model["vocab"]]
    ranks = {raw(t): k for k, t in enumerate(t for t in alphabet if t in model["vocab"])}
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        left, right = raw(a), raw(b)
        if left not in ranks or right not in ranks:
            raise ValueError(f"the merge of {a} and {b} stands before one of them")
        if left + right not in ranks:
            ranks[left + right] = len(ids)
            ids.append(model["vocab"][a + b])
    encode = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: [ids[k] for k in encode(piece)]
