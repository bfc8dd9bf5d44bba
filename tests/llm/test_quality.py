"""The quality query against a plain fit over all rows at once."""

import binascii

import numpy as np
import pyarrow.parquet as pq

from geoweave.llm import quality, text as tx
from geoweave.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def fitted(x, positive, w, risk, hold):
    """Newton steps over whole arrays, halved while the risk grows or its negative part becomes negative."""
    def at(w):
        s = 1 / (1 + np.exp(-x @ w))
        soft = np.logaddexp(0, x @ w)
        value, negative, pull = risk(soft, x @ w, positive)
        gradient = pull(s) + hold * w
        curve = (x * (s * (1 - s) * risk.weights(positive))[:, None]).T @ x
        return value + (hold * w * w).sum() / 2, negative, gradient, curve

    value, negative, gradient, curve = at(w)
    for _ in range(25):
        step, size = np.linalg.solve(curve + np.diag(hold + 1e-9), gradient), 1.0
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
    return w


class Apart:
    """Positives against all texts, half and half."""

    def __init__(self, x):
        self.x = x

    def weights(self, positive):
        return 0.5 / len(positive) + 0.5 * positive / positive.sum()

    def __call__(self, soft, z, positive):
        x, p = self.x, positive
        return (soft.mean() + soft[p].mean() - z[p].mean()) / 2, 1.0, lambda s: ((s[:, None] * x).mean(axis=0) + (s[p, None] * x[p]).mean(axis=0) - x[p].mean(axis=0)) / 2


class NonNegative:
    """Positives at their prior, and all texts as negatives less the positives among them, but never less than nothing."""

    def __init__(self, x, prior):
        self.x, self.prior = x, prior

    def weights(self, positive):
        return np.full(len(positive), 1 / len(positive))

    def __call__(self, soft, z, positive):
        x, p = self.x, positive
        negative = soft.mean() - self.prior * soft[p].mean()
        return self.prior * (soft[p] - z[p]).mean() + max(negative, 0.0), negative, lambda s: (s[:, None] * x).mean(axis=0) - self.prior * x[p].mean(axis=0)


def test_scores_are_those_of_a_plain_fit(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    labels = pq.read_table(f"{FOLDER}/labels.parquet").to_pandas()
    held = np.array([binascii.crc32(str(i).encode()) % 4 == 2 for i in docs["doc_id"].to_pylist()])
    raw = np.concatenate([quality.features(data, offsets).astype(np.float32) for _, _, data, offsets in tx.slices(docs["text"].combine_chunks())]).astype(float)
    good = set(labels[labels.quality == 1].doc_id)
    positive = np.array([i in good for i in docs["doc_id"].to_pylist()])[~held]
    learn = raw[~held]
    mean, scale = learn.mean(axis=0), np.sqrt(np.maximum((learn * learn).mean(axis=0) - learn.mean(axis=0) ** 2, 0)) + 1e-3
    whole = np.append(np.clip((raw - mean) / scale, -8, 8), np.ones((len(raw), 1)), axis=1)
    x, hold = whole[~held], np.append(np.full(raw.shape[1], 1e-4), 0.0)
    first = fitted(x, positive, np.zeros(x.shape[1]), Apart(x), hold)
    counts = quality.histogram(quality.Classifier(mean, scale, first[:-1], float(first[-1])), learn, positive)
    prior = quality.prior_of(counts)
    start = np.append(np.zeros(raw.shape[1]), np.log(prior / (1 - prior)))
    w = fitted(x, positive, start, NonNegative(x, prior), hold)
    want = 1 / (1 + np.exp(-np.clip(whole @ w, -30, 30)))
    got = QUERIES["op5_pu_quality"](spark, FOLDER).toPandas().set_index("doc_id").loc[docs["doc_id"].to_pylist()]
    assert (got.held_out.to_numpy() == held).all()
    assert np.abs(got.score.to_numpy() - want).max() < 1e-3
    assert (got.predicted.to_numpy() == (got.score.to_numpy() >= 0.7)).all()
