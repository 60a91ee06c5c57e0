"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import carry, sampled, text_slices, with_fields

#: ASCII byte values counted one by one.
_BYTES = np.array([b for b in range(256) if b < 128 and not chr(b).isalnum()])
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of dense shape statistics for each whole text; zeros for null or empty."""
    out = np.zeros((len(texts), len(_BYTES) + 14), dtype=np.float64)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        own = raw.split()
        lines = [x for x in raw.split(b"\n") if x]
        upper, lower, digit, wide = hist[_UPPER].sum(), hist[_LOWER].sum(), hist[_DIGIT].sum(), hist[128:].sum()
        distinct = len(set(own))
        lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) if own else np.zeros(1)
        letters = max(upper + lower, 1)
        out[i, : len(_BYTES)] = np.log1p(1000.0 * hist[_BYTES] / n)
        out[i, len(_BYTES) :] = (
            np.log1p(n), upper / letters, lower / n, digit / n, wide / n, distinct / max(len(own), 1), len(set(lines)) / max(len(lines), 1),
            lengths.mean(), lengths.std(), np.log1p(len(own)), len(own) / max(len(lines), 1) / 50, (lengths == 1).mean(), (lengths > 15).mean(), 1.0,
        )
    return out


@dataclass
class QualityModel:
    """A linear scorer of about 80 weights, and the line that turns its margin into a probability."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss.

    Where the estimated negative risk falls below ``-beta`` the step goes up its
    gradient instead of down, as the non-negative estimator prescribes."""
    d = positive.shape[1]
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, un = sig(zu) / len(zu), sig(zp) / len(zp)
        gn = np.append(unlabelled.T @ up - prior * (positive.T @ un), up.sum() - prior * un.sum())
        if negative_risk < -beta:
            g = -gn
        else:
            pp = -sig(-zp) / len(zp)
            g = gn + prior * np.append(positive.T @ pp, pp.sum())
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from the scores of both by a scorer that has seen neither.

    Above any score the unlabelled rows hold at least prior * (share of the positives there), so the smallest ratio of
    the two shares bounds the prior, and meets it where only positives score as high. Scores that fewer than ``least``
    of the positives reach are left out, and both shares are widened by their spread."""
    cut = np.unique(np.quantile(positive, np.linspace(0, 1 - least, 101)))
    p = np.array([(positive >= c).mean() for c in cut])
    u = np.array([(unlabelled >= c).mean() for c in cut])
    wide = np.sqrt(np.maximum(u * (1 - u), 1 / len(unlabelled)) / len(unlabelled)) + np.sqrt(np.maximum(p * (1 - p), 1 / len(positive)) / len(positive))
    best = int(((u + wide) / p).argmin())
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, guess: float) -> float:
    """Class prior of the unlabelled rows: a scorer of one half of both estimates it on the other half, and the other way round."""
    if min(len(positive), len(unlabelled)) < 40:
        return guess
    found = []
    for k in (0, 1):
        w, b = nn_pu(positive[k::2], unlabelled[k::2], guess, steps=200)
        found.append(class_prior(positive[1 - k :: 2] @ w + b, unlabelled[1 - k :: 2] @ w + b))
    return float(np.mean(found))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 12_000) -> QualityModel | None:
    """Fit on the given rows; ``docs`` and ``labels`` must already be the learning fold.

    ``max_rows`` is about the size, to a few percent, of each of the two samples
    (labelled rows; unlabelled text, drawn from all documents): above it rows are
    taken by a hash of the id. The class prior of the unlabelled text is estimated
    from it and the positives alone (``estimated_prior``; with fewer than 40 rows
    of either it is the share of positives among labelled rows). The labelled rows
    set the probability scale, nothing else. Labels with a null id or value are left out; a repeated id counts
    once, by its smallest label. Without a positive label there is no model.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    total, labelled = rows.count(), known.count()
    marked = sampled(known, labelled, max_rows, "_id", F.lit(8)).join(rows, "_id").select(F.col("_y").cast("int").alias("y"), "text")
    free = sampled(rows, total, max_rows, "_id", F.lit(8)).select(F.lit(-1).alias("y"), "text")

    def extract(batches):
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(texts)))], names=["y", "x"])

    got = marked.unionByName(free).mapInArrow(extract, "y int, x array<double>").toPandas()
    if not (got["y"] == 1).any():
        return None
    if not (got["y"] == -1).any():
        raise ValueError("the sample of the unlabelled text is empty: it has too few different ids for max_rows")
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    mean, scale = x[y == -1].mean(axis=0), x[y == -1].std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    prior = estimated_prior(z[y == 1], z[y == -1], ((y == 1).sum() + 1) / ((y >= 0).sum() + 2))
    w, b = nn_pu(z[y == 1], z[y == -1], prior)
    slope, offset = _calibrate(z[y >= 0] @ w + b, y[y >= 0])
    return QualityModel(mean, scale, w, b, slope, offset, prior)


def _calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton steps with smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    design = np.stack([margin / (np.abs(margin).mean() + 1e-9), np.ones_like(margin)], axis=1)
    c = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -40, 40)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        c += np.clip(np.linalg.solve(h, design.T @ (target - p)), -2, 2)
    slope = max(c[0], 1e-3) / (np.abs(margin).mean() + 1e-9)
    return float(slope), float(c[1])


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (columns of those names are replaced).

    Every whole text gets a score; a null text counts as empty, and an empty one
    scores by its zero features. Without a model every score is 0.5.
    """
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        for batch, texts in text_slices(batches, text):
            s = m.score(features(texts)) if m else np.full(len(texts), 0.5)
            yield carry(batch, score=pa.array(s, pa.float64()), predicted=pa.array((s >= threshold).astype(np.int32)))

    return base.mapInArrow(apply, with_fields(base, "score double, predicted int"))
