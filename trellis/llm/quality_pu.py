"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled as good; unlabelled web text is
a sample of the corpus. A small network is trained in numpy on the
non-negative unbiased risk ``pi R_P(+) + max(0, R_U(-) - pi R_P(-))`` with the
sigmoid loss; where the bracket goes below 0 its gradient is reversed. The class
prior ``pi`` is the share of good labels in the training sample; if the labels
hold positives only, it is estimated from positives and unlabelled text as the
least ratio of their tails above a threshold of a first fit.

Inputs are measures of the text alone (repetition, case, symbols, word and line
shapes), never labels, language, source or id.

Scale: scoring is one map over the documents with a model of a few thousand
numbers in its closure. Training reads at most about ``TRAIN_POSITIVES`` labelled
and ``TRAIN_UNLABELLED`` other documents, picked by hash; their measures (not the
texts) reach the driver.

Edge cases: null and empty texts are measured as no words and get a score;
repeated rows are scored alike; labels without id or class are left out; without
a positive every score is 1 (nothing can be told apart, so nothing is rejected);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import hash_sample, label_sample

TRAIN_POSITIVES = 12_000
TRAIN_UNLABELLED = 12_000
HIDDEN = 24
N_FEATURES = 22


def measures(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256).astype(float)
    total = max(1.0, raw.sum())
    p = raw[raw > 0] / total
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    doubled = sum(map(str.__eq__, words, words[1:]))
    far = sum(c - 1 for c in counts.values() if c > 1)
    trigrams = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    lines = text.split("\n")
    ends = Counter(w[-1] for w in words)
    letters = raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()
    symbols = raw[[33, 35, 36, 37, 38, 42, 64, 94, 124, 126]].sum()
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    return [len(counts) / n, top / n, doubled / n, far / n, trigrams, raw[65:91].sum() / total,
            raw[48:58].sum() / total, symbols / total, raw[33] / total, raw[124] / total,
            (raw[46] + raw[44]) / n, raw[10] / n, letters / total, raw[32] / total,
            float(lengths.mean()) / 10, float(lengths.std()) / 10, float(lengths.max()) / 50, np.log1p(n) / 10,
            len(set(lines)) / len(lines), float(-(p * np.log(p)).sum()) / 4,
            (ends["!"] + ends["*"] + ends["#"] + ends["%"] + ends["&"] + ends["$"] + ends["|"]) / n,
            float(not words)]


class Network:
    """Standardised measures -> tanh layer -> score."""

    def __init__(self, mean, std, w1, b1, w2, b2):
        self.mean, self.std, self.w1, self.b1, self.w2, self.b2 = mean, std, w1, b1, w2, b2

    def margin(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.std, -8, 8) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1500, batch: int = 1024, rate: float = 0.01,
          l2: float = 1e-4, seed: int = 3) -> Network:
    """Minimise the non-negative unbiased risk by Adam."""
    rng = np.random.default_rng(seed)
    mean, std = unl.mean(0), unl.std(0) + 1e-3
    d = pos.shape[1]
    net = Network(mean, std, rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN),
                  np.zeros(1))
    zp, zu = (np.clip((x - mean) / std, -8, 8) for x in (pos, unl))
    params = [net.w1, net.b1, net.w2, net.b2]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        xp, xu = zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ net.w1 + net.b1)
        g = _sigmoid(h @ net.w2 + net.b2)  # sigmoid loss: 1 - g as positive, g as negative
        slope = g * (1 - g) / batch
        gp, gu = slope[:batch], slope[batch:]
        negative = g[batch:].mean() - prior * g[:batch].mean()
        if negative >= 0:
            dz = np.concatenate([-prior * gp - prior * gp, gu])
        else:  # step back: ascend on the bracket alone
            dz = np.concatenate([prior * gp, -gu])
        dh = np.outer(dz, net.w2) * (1 - h * h)
        grads = [x.T @ dh + l2 * net.w1, dh.sum(0), h.T @ dz + l2 * net.w2, dz.sum(keepdims=True)]
        for p, gr, (a, b) in zip(params, grads, state):
            a += 0.1 * (gr - a)
            b += 0.001 * (gr * gr - b)
            p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return net


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Least ratio of tails: share of unlabelled over share of positives above a
    threshold of a positive-against-unlabelled fit, over thresholds that keep a tenth of the positives."""
    net = nn_pu(pos, unl, 0.5)
    sp, su = np.sort(net.margin(pos)), np.sort(net.margin(unl))
    cuts = np.quantile(sp, np.linspace(0.0, 0.9, 46))
    tp = 1.0 - np.searchsorted(sp, cuts) / len(sp)
    tu = 1.0 - np.searchsorted(su, cuts) / len(su)
    return float(np.clip((tu / np.maximum(tp, 1e-9)).min(), 0.05, 0.98))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text",
          label: str = "quality", positives: int = TRAIN_POSITIVES, unlabelled: int = TRAIN_UNLABELLED) -> Network | None:
    """Fit on training rows (a condition on ``_id``); None without a positive."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    ids = label_sample(labels, label, id_col, train_rows, positives).withColumn("_y", (F.col("_y") > 0).cast("int"))
    known = d.join(F.broadcast(ids), "_id").select("text", "_y")  # at most about ``positives`` rows
    free = hash_sample(d.where(train_rows), F.col("_id"), unlabelled).select("text", F.lit(-1).alias("_y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [measures(t) for t in pdf["text"]], "y": pdf["_y"]})

    rows = known.unionByName(free).mapInPandas(run, "x array<double>, y int").toPandas()
    rows = rows.sort_values("x", key=lambda s: s.map(str), kind="stable")
    if not len(rows):
        return None
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy()
    pos, unl = x[y == 1], x[y == -1]
    if not len(pos) or not len(unl):
        return None
    n_neg = int((y == 0).sum())
    prior = len(pos) / (len(pos) + n_neg) if n_neg else estimate_prior(pos, unl)
    return nn_pu(pos, unl, prior)


def score_column(model: Network | None, text_col: str = "text") -> Column:
    """The score of each row's text. Only the text goes to Python."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([measures(t) for t in texts]).reshape(-1, N_FEATURES)
        return pd.Series(model.score(x) if model else np.ones(len(texts)))

    return run(F.col(text_col))


def score(docs: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every row."""
    return docs.select(F.col(id_col), score_column(model, text_col).alias("score"))


def keep_good(docs: DataFrame, model: Network | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model takes for good (score of 0.5 or more)."""
    return docs.where(score_column(model, text_col) >= 0.5)
