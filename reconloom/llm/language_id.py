"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import carry, codepoints, text_slices, with_fields
from reconloom.sources.durable import durable, scratch

#: Predicted for a null text and for a text without letters.
UNDETERMINED = "und"
_SPACE = 32
#: Characters of a slice.
_BYTES = 1 << 18
_table: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters; everything else becomes a space."""
    global _table
    if _table is None:
        _table = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else _SPACE for c in range(0x10000)], dtype=np.uint32)
    high = codes > 0xFFFF
    out = _table[np.where(high, 0, codes)]
    if high.any():
        uniq, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else _SPACE for c in uniq], dtype=np.uint32)[at]
    return out


def _grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams of all texts, the text each starts in, and whether a text has letters."""
    sizes = np.array([len(t) + 2 for t in texts])
    c = _letters(codepoints("".join(f" {t} " for t in texts)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    lettered = np.zeros(len(texts), dtype=bool)
    lettered[owner[c != _SPACE]] = True
    mix, shift = np.uint32(2654435761), np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = (two[:-1] ^ (c[2:] * np.uint32(0xC2B2AE3D))) * mix >> shift
        pair = (two ^ (two >> np.uint32(15))) * mix >> shift
    same2, same3 = (owner[:-1] == owner[1:]) & ((c[:-1] != _SPACE) | (c[1:] != _SPACE)), (owner[:-2] == owner[2:]) & (c[1:-1] != _SPACE)
    return np.concatenate([pair[same2], three[same3]]), np.concatenate([owner[:-1][same2], owner[:-2][same3]]), lettered


@dataclass
class LanguageModel:
    """Log-probabilities, a row of 2**bits for each language: the broadcast is bounded by the languages learned."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int


@dataclass
class Usual:
    """What the mean log-likelihood a gram of texts in the learned languages is, and how far it spreads."""

    centre: float
    gram_spread: float
    text_spread: float

    def below(self, mean: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """How many spreads ``mean`` lies below the centre; a mean over few grams spreads wider.

        Grams overlap, so about one in four counts as independent: one odd word doesn't make a short text strange."""
        return (self.centre - mean) / np.sqrt(self.text_spread**2 + 4 * self.gram_spread**2 / np.maximum(grams, 1))


#: Texts with fewer grams do not set the usual, and the least spread of texts as a share of that of grams.
USUAL_GRAMS, LEAST_SPREAD = 200, 0.1


#: Values that the driver takes to pick a median from; of more it counts buckets first, this many a pass.
_TAKEN = 4096


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))


def median(values: DataFrame, column: str) -> float | None:
    """The exact median of a written column of doubles without nulls and NaN; None without rows.

    Each pass counts the values in buckets of equal width between the least and the largest that may be the median, and
    goes on with the bucket that holds it: some five passes for doubles of any number. The driver gets the buckets only."""
    v = F.col(column)
    n, low, high = values.agg(F.count(v), F.min(v), F.max(v)).first()
    first, then, held = (n - 1) // 2, n // 2, n
    while n and low < high:
        some = values.where(v.between(low, high))
        if held <= _TAKEN:
            own = sorted(r[0] for r in some.select(v).collect())
            return (own[first] + own[then]) / 2
        at = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * _TAKEN), F.lit(_TAKEN - 1))
        buckets = sorted(some.groupBy(at.alias("at")).agg(F.count("*"), F.min(v), F.max(v)).collect())
        for k, (_, held, low, high) in enumerate(buckets):
            if first < held:
                break
            first, then = first - held, then - held
        if then >= held:  # the two in the middle lie in two buckets
            return (high + buckets[k + 1][2]) / 2
    return low


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = 15, alpha: float = 0.5) -> LanguageModel:
    """Fit on all rows with a language and a text.

    Counts are summed by Spark; the driver receives at most 2**bits rows a language.
    """
    rows = _labelled(docs, text, lang)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch, texts in text_slices(batches, size=_BYTES):
            langs = batch.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                h, _, _ = _grams(own, bits)
                held.setdefault(name, np.zeros(1 << bits, dtype=np.int64))
                held[name] += np.bincount(h, minlength=1 << bits)
                seen[name] = seen.get(name, 0) + len(own)
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(at) + 1), "bin": np.append(at, -1), "n": np.append(counts[at], seen[name])})

    got = rows.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    counts, prior = np.zeros((1 << bits, len(names))), np.zeros(len(names))
    for k, name in enumerate(names):
        own = got[got["lang"] == name]
        real = own["bin"] >= 0
        counts[own["bin"][real].to_numpy(), k] = own["n"][real].to_numpy()
        prior[k] = own["n"][~real].sum()
    counts += alpha
    log_prob = np.log(counts) - np.log(counts.sum(axis=0))
    return LanguageModel(names, np.log(prior / prior.sum()) if names else prior, np.ascontiguousarray(log_prob.T, dtype=np.float32), bits)


def usual(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang") -> Usual | None:
    """The usual likelihood, from all rows of ``docs`` with a language of ``model``, which it was not fitted on; None without such rows.

    Each gram counts as in the language that likes it best, so texts of mixed languages are usual. Medians are
    taken, so that some texts in no learned language do not shift it: exact ones, of a written table of three
    numbers a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        m = shared.value
        best = m.log_prob.max(axis=0)
        for _, texts in text_slices(batches, size=_BYTES):
            h, owner, lettered = _grams(texts, m.bits)
            grams, mean = _best_mean(best, h, owner, len(texts))
            square = np.bincount(owner, weights=(best * best)[h], minlength=len(texts)) / np.maximum(grams, 1)
            spread = np.sqrt(np.maximum(square - mean**2, 0))
            yield pa.RecordBatch.from_pydict({"grams": grams[lettered], "mean": mean[lettered], "spread": spread[lettered]})

    if not model.languages:
        return None
    with scratch():
        found = _labelled(docs, text, lang).where(F.col("lang").isin(model.languages)).mapInArrow(measure, "grams long, mean double, spread double")
        got = durable(found, "lid-usual")
        if not (long := got.where(F.col("grams") >= USUAL_GRAMS)).isEmpty():
            got = long
        centre, gram_spread = median(got, "mean"), median(got, "spread")
        if centre is None:
            return None
        text_spread = median(got.select(F.abs(F.col("mean") - centre).alias("off")), "off")
    return Usual(centre, gram_spread, max(1.4826 * text_spread, LEAST_SPREAD * gram_spread))


def _best_mean(best: np.ndarray, h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of grams of each text, and their mean log-likelihood in the language that likes each best."""
    grams = np.bincount(owner, minlength=n)
    return grams, np.bincount(owner, weights=best[h], minlength=n) / np.maximum(grams, 1)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "", against: Usual | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``<prefix>lang_pred`` and ``<prefix>score``, and ``<prefix>strange`` if ``against`` is given.

    A column of ``docs`` with such a name is replaced. ``score`` is the posterior
    of the predicted language under a per-gram temperature: 0 for ``und``. Equal
    posteriors go to the first language by code point. Whole texts are scored,
    in slices that bound a task's memory. ``strange`` is how many spreads the text's
    mean log-likelihood a gram lies below the usual; it does not compare the learned
    languages, as ``score`` does, so it is high for foreign texts and noise.
    """
    pred, score, strange = f"{prefix}lang_pred", f"{prefix}score", f"{prefix}strange"
    base = docs.drop(pred, score) if against is None else docs.drop(pred, score, strange)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        top = m.log_prob.max(axis=0) if against is not None else None
        for batch, texts in text_slices(batches, text, _BYTES):
            n = len(texts)
            sums = np.zeros((n, len(m.languages)))
            h, owner, lettered = _grams([t or "" for t in texts], m.bits)
            for k in range(len(m.languages)):
                sums[:, k] = np.bincount(owner, weights=m.log_prob[k][h], minlength=n)
            grams = np.bincount(owner, minlength=n)
            if m.languages:
                # evidence of overlapping grams is not independent: count a text's as at most its square root
                joint = m.log_prior + sums / np.sqrt(np.maximum(grams, 1))[:, None]
                joint -= joint.max(axis=1, keepdims=True)
                post = np.exp(joint)
                post /= post.sum(axis=1, keepdims=True)
                best = (m.log_prior + sums).argmax(axis=1)
                value = post[np.arange(n), best]
            else:
                best, value, lettered = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n, dtype=bool)
            value = np.where(lettered, value, 0.0)
            names = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
            more = {pred: pa.array(names, pa.string()), score: pa.array(value, pa.float64())}
            if against is not None:
                count, mean = _best_mean(top, h, owner, n)
                more[strange] = pa.array(np.where(lettered, against.below(mean, count), 0.0), pa.float64())
            yield carry(batch, **more)

    return base.mapInArrow(apply, with_fields(base, f"`{pred}` string, `{score}` double" + (f", `{strange}` double" if against is not None else "")))
