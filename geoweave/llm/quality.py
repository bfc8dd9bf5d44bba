"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows labelled 1) and unlabelled web text train a logistic score by minimising the non-negative unbiased
risk  pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)).  With logistic loss it is convex where the second
part is not negative: Newton steps, each one pass of Spark over the features of all texts, cut back until that part is not.

The class prior pi comes from positives and unlabelled texts alone. A first score tells the two apart; where it is high,
unlabelled texts are positives nearly all, so the least ratio of the share of unlabelled texts above a threshold to that of
positives above it is the share of positives among the unlabelled.

Features are shares of what is counted in a whole text; labels, languages, sources and ids are none of them. Nothing is
sampled: sums over all rows are what comes to the driver, a few thousand numbers for each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from geoweave.llm import text as tx
from geoweave.llm.hostrules import measures
from geoweave.shared import written

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_BAR = np.zeros(256, bool)
_BAR[list(b"|")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text; an empty text has zeros."""
    m = {k: v.astype(float) for k, v in measures(data, offsets).items()}
    words = tx.Words(data, offsets)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    n, chars, lines = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)
    count = lambda mask: tx.per_text(mask[data], offsets).astype(float)
    shares = [
        m["n_symbols"] / n, m["n_marks"] / n, m["n_upper"] / chars, m["n_dup_lines"] / lines, m["n_repeat_words"] / n,
        m["n_distinct"] / n, count(_DIGIT) / chars, count(_STOP) / n, count(_BAR) / n, tx.per_text(echo, words.first) / n,
    ]
    shares = np.minimum(np.stack(shares, axis=1), 4)
    sizes = np.stack([np.log1p(m["n_words"]) / 8, chars / n / 8, np.log1p(n / lines) / 6, (m["n_words"] < 10).astype(float)], axis=1)
    return np.concatenate((shares, np.sqrt(shares), np.tanh(20 * shares), sizes, sizes**2), axis=1)


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Rows that hold the sums of all tasks on their way to the driver.
SLOTS = 32
#: Bins of the score for the prior, in steps of 0.02 around 0, and the least share of positives above a threshold.
BINS, LEAST = 1000, 0.25


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of docs (doc_id, text): features packed as 32-bit floats, a table in the shared folder. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.slices(batch.column(1)):
                x = [r.tobytes() for r in features(data, offsets).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(x, pa.binary())], names=["doc_id", "x"])

    rows = tx.in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, x binary"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(float)


def summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of of(x, positive) over batches of rows (x, positive); tasks, then slots, add up what they have. None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([total.tobytes()])], names=["slot", "sums"])

    def merged(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(1, "sums", [[np.sum([np.frombuffer(r) for r in table.column("sums").to_pylist()], axis=0).tobytes()]])

    shape = "slot int, sums binary"
    got = rows.select("x", "positive").mapInArrow(part, shape).groupBy("slot").applyInArrow(merged, shape).collect()
    return np.sum([np.frombuffer(r["sums"]) for r in sorted(got)], axis=0) if got else None


def parts(model: Classifier, x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """What risk, gradient and curvature are made of, for unlabelled (all) and positive rows: their number, the sums of
    log(1 + e^z), of z, of s x, of x, and of s (1 - s) x x', with s = 1 / (1 + e^-z)."""
    x = np.append(np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1)), axis=1)
    z = x @ np.append(model.weight, model.bias)
    s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    out = []
    for w in (np.ones(len(x)), positive.astype(float)):
        out += [[w.sum()], [w @ np.logaddexp(0, z)], [w @ z], (w * s) @ x, w @ x, ((x * (w * s * (1 - s))[:, None]).T @ x).ravel()]
    return np.concatenate(out)


@dataclass(frozen=True)
class Sums:
    """Means over unlabelled (u) or positive (p) rows of what parts() adds up."""

    n: float
    soft: float
    z: float
    sx: np.ndarray
    x: np.ndarray
    curve: np.ndarray

    @classmethod
    def both(cls, sums: np.ndarray, d: int) -> tuple[Sums, Sums]:
        out = []
        for one in np.split(sums, 2):
            n = max(one[0], 1.0)
            out.append(cls(one[0], one[1] / n, one[2] / n, one[3 : 3 + d] / n, one[3 + d : 3 + 2 * d] / n, one[3 + 2 * d :].reshape(d, d) / n))
        return out[0], out[1]


def pu_risk(u: Sums, p: Sums, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk, its negative part, gradient and curvature where that part is not negative."""
    negative = u.soft - prior * p.soft
    return prior * (p.soft - p.z) + max(negative, 0.0), negative, u.sx - prior * p.x, u.curve


def apart_risk(u: Sums, p: Sums) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The same for telling positives from unlabelled rows, both halves of equal weight."""
    return (u.soft + p.soft - p.z) / 2, 1.0, (u.sx + p.sx - p.x) / 2, (u.curve + p.curve) / 2


def minimised(rows: DataFrame, model: Classifier, risk: Callable, steps: int, decay: float = 1e-4) -> Classifier:
    """Newton steps from model; a step that raises the risk or makes the negative part negative is halved."""
    d = len(model.weight) + 1
    hold = np.append(np.full(d - 1, decay), 0.0)

    def at(w: np.ndarray) -> tuple:
        here = Classifier(model.mean, model.scale, w[:-1], float(w[-1]))
        value, negative, gradient, curve = risk(*Sums.both(summed(rows, partial(parts, here)), d))
        return value + (hold * w * w).sum() / 2, negative, gradient + hold * w, curve

    w = np.append(model.weight, model.bias)
    value, negative, gradient, curve = at(w)
    for _ in range(steps):
        step = np.linalg.solve(curve + np.diag(hold + 1e-9), gradient)
        size = 1.0
        while size > 1e-3:
            tried = at(w - size * step)
            if tried[0] <= value + 1e-12 and tried[1] >= min(0.0, negative):
                break
            size /= 2
        else:
            break
        gain, w = value - tried[0], w - size * step
        value, negative, gradient, curve = tried
        if gain < 1e-7:
            break
    return Classifier(model.mean, model.scale, w[:-1], float(w[-1]))


def histogram(model: Classifier, x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Numbers of all rows, then of positive ones, by score."""
    z = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weight + model.bias
    bin_ = np.clip(np.floor(z * 50) + BINS // 2, 0, BINS - 1).astype(int)
    return np.concatenate([np.bincount(bin_, minlength=BINS), np.bincount(bin_[positive], minlength=BINS)]).astype(float)


def prior_of(counts: np.ndarray) -> float:
    """The class prior from a histogram: the least ratio of shares above a threshold, with two standard errors on top."""
    u, p = (np.cumsum(c[::-1])[::-1] for c in np.split(counts, 2))
    some = p >= LEAST * p[0]
    above_u, above_p = u[some] / u[0], p[some] / p[0]
    error = np.sqrt(above_u * (1 - above_u) / u[0]) + above_u / above_p * np.sqrt(above_p * (1 - above_p) / p[0])
    return float(np.clip(((above_u + 2 * error) / above_p).min(), 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, steps: int = 25) -> Classifier | None:
    """From docs (doc_id, text, or doc_id, x as featured gives it) and labels (doc_id, label): those that may be learned from.

    Every text is unlabelled text, those with label 1 are positives too. An id with several labels counts as its greatest;
    rows that share an id are positives all. None without texts or positives.
    """
    table = docs if "x" in docs.columns else featured(docs)
    known = labels.where("doc_id is not null and label = 1").select("doc_id").distinct().withColumn("positive", F.lit(True))
    rows = written(table.join(known, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "learned-from")
    sums = summed(rows, lambda x, positive: np.concatenate(([len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0))))
    if sums is None or not sums[1]:
        return None
    mean, square = np.split(sums[2:] / sums[0], 2)
    start = Classifier(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3, np.zeros(len(mean)), 0.0)
    first = minimised(rows, start, apart_risk, steps)
    prior = prior_of(summed(rows, partial(histogram, first)))
    even = Classifier(start.mean, start.scale, start.weight, float(np.log(prior / (1 - prior))))
    return minimised(rows, even, partial(pu_risk, prior=prior), steps)


def score_quality(docs: DataFrame, model: Classifier | None, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text, or doc_id, x) as (doc_id, score, predicted). Without a model every score is 0.5.

    Null texts count as empty and are scored too; texts are taken whole. Repeated rows come out as often. Other columns
    are not looked at. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = model.score(_matrix(batch.column(1))) if model and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    table = docs if "x" in docs.columns else featured(docs)
    return table.select(F.col("doc_id").cast("long"), "x").mapInArrow(run, "doc_id long, score double, predicted int")
