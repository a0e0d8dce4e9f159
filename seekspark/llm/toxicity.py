"""Toxicity by non-negative positive-unlabelled learning in numpy.

A text's features are its distinct words (runs of letters and digits, A-Z in lower case) and their beginnings of 4, 5 and 6 bytes,
hashed into BUCKETS; a linear classifier sums their weights, each scaled by the feature's evidence. It learns from confirmed toxic texts and unlabelled text (a draw from all
texts, so that the prior holds in it): with class
prior p, the risk is p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)); where the second term turns negative its gradient is
reversed, as non-negative PU learning prescribes. The prior is a parameter, by default the toxic share of labelled training rows.

Fitting takes at most POSITIVES toxic and UNLABELLED other texts (bounds, not fractions, drawn by a hash of the id); scoring reads
whole texts of all rows. Features of the sample are computed on executors; a text sends at most BUCKETS distinct numbers.
Defined results: null, empty and wordless texts get the score of no feature at all. Null labels and null ids teach nothing. With no toxic
row at all every score is 0. Repeated rows get equal scores. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common
from seekspark.llm.hashing import WORDY, Words, joined, mix

BUCKETS, STEMS = 1 << 18, (4, 5, 6)
POSITIVES, UNLABELLED, EPOCHS, RATE, DECAY, ERRORS = 2000, 5000, 20, 0.5, 1e-4, 3


def bags(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct features of each text as one array, and where each text's begin, with the end last."""
    buf, ends = joined(texts)
    words = Words(buf, WORDY[buf])
    doc = np.searchsorted(ends, words.starts, "right") - 1
    # distinct words first, by their hash; then distinct features
    full = words.hashes()
    _, pick = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (full >> np.uint64(20)), return_index=True)
    keys = []
    for k in (None, *STEMS):
        long = pick if k is None else pick[words.sizes[pick] > k]
        h = full if k is None else words.hashes(k) * np.uint64(3 + 2 * k)
        keys.append((doc[long] << 18) | (h[long] >> np.uint64(46)).astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return (keys & (BUCKETS - 1)).astype(np.int32), np.searchsorted(keys >> 18, np.arange(len(texts) + 1))


def sums(weights: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[flat], dtype=np.float64)])
    return total[cuts[1:]] - total[cuts[:-1]]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, texts: list) -> np.ndarray:
        if not np.isfinite(self.bias):
            return np.zeros(len(texts))
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            out[at : at + 256] = sums(self.weights, *bags(texts[at : at + 256])) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def evidence(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Log-ratio of each feature's share of what toxic texts hold to its class-prior-corrected share in others, less ERRORS
    standard errors and never below zero. Shares rather than document rates: a text's length is no evidence."""
    p, u = (np.bincount(np.concatenate(x), minlength=BUCKETS).astype(float) for x in (positive, unlabelled))
    rest = np.maximum(u - prior * p * len(unlabelled) / len(positive), 0)  # unlabelled texts are a mixture of both classes
    a, b = (p + 0.5) / (p.sum() + 1), (rest + 0.5) / (rest.sum() + 1)
    error = np.sqrt(1 / (p + 0.5) + 1 / (rest + 0.5))
    return np.maximum(0, np.log(a / b) - ERRORS * error) * (p > 0)


def apart(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of near copies among the texts one stays: copies would pass for independent evidence of all their words."""
    ids, seen, out = np.arange(BUCKETS, dtype=np.uint64), set(), []
    orders = [mix(ids * np.uint64(2 * k + 3) + np.uint64(k)) for k in range(6)]
    for r in rows:
        low = [int(o[r].min()) if len(r) else 0 for o in orders]
        bands = [(k, low[k], low[k + 1]) for k in (0, 2, 4)]
        if not any(b in seen for b in bands):
            out.append(r)
        seen.update(bands)
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 9) -> ToxicityModel:
    """nnPU with the logistic loss and Adagrad, over bags of features scaled by their evidence."""
    if not sum(map(len, positive)):
        return ToxicityModel(np.zeros(BUCKETS), -np.inf)
    unlabelled = unlabelled if sum(map(len, unlabelled)) else positive
    # every fifth text of each sort sets the threshold and teaches nothing else, if there are enough
    held_p, held_u = (x[::5] if min(len(positive), len(unlabelled)) >= 25 else [] for x in (positive, unlabelled))
    positive, unlabelled = ([t for i, t in enumerate(x) if i % 5 or not held_p] for x in (positive, unlabelled))
    positive, unlabelled = apart(positive), apart(unlabelled)
    scale = evidence(positive, unlabelled, prior)
    rng, w, seen, b, bseen = np.random.default_rng(seed), np.full(BUCKETS, 0.5), np.full(BUCKETS, 1e-4), -2.0, 1e-4
    steps = max(20, -(-len(unlabelled) // 128))
    np_, nu = min(len(positive), 48), min(len(unlabelled), 128)
    kept = lambda x: x[scale[x] != 0]
    positive, unlabelled = [kept(x) for x in positive], [kept(x) for x in unlabelled]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for _ in range(steps):
            rows = [positive[i] for i in rng.integers(0, len(positive), np_)] + [unlabelled[i] for i in rng.integers(0, len(unlabelled), nu)]
            sizes = np.array([len(r) for r in rows])
            flat = np.concatenate(rows)
            z = np.clip(sums(w * scale, flat, np.concatenate([[0], np.cumsum(sizes)])) + b, -30, 30)
            s = 1 / (1 + np.exp(-z))
            lost = np.log1p(np.exp(z))  # the loss of label -1; its slope is s, that of label +1 has slope s - 1
            g = np.zeros(len(rows))
            if lost[np_:].mean() - prior * lost[:np_].mean() >= 0:
                g[:np_] = prior * ((s[:np_] - 1) - s[:np_]) / np_
                g[np_:] = s[np_:] / nu
            else:  # the corrected risk of negatives fell below zero: step back from it
                g[:np_] = prior * s[:np_] / np_
                g[np_:] = -s[np_:] / nu
            grad = np.bincount(flat, weights=np.repeat(g, sizes), minlength=BUCKETS) * scale
            at = np.flatnonzero(grad)
            seen[at] += grad[at] ** 2
            w[at] = np.maximum(0, w[at] - rate * (grad[at] / np.sqrt(seen[at]) + DECAY * w[at]))  # the sign stays that of the evidence
            bseen += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(bseen)
    w *= scale
    return ToxicityModel(w, threshold(w, held_p or positive, held_u or unlabelled, prior))


def threshold(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> float:
    """The bias of least class-prior-corrected error, p miss + (flagged unlabelled - p found), mid-way between scores."""
    zp, zu = (np.sort(np.round(sums(w, np.concatenate(x), np.cumsum([0, *map(len, x)])), 6)) for x in (positive, unlabelled))
    ends = np.unique(np.concatenate([zp, zu]))
    if len(ends) < 2:
        return -float(ends[0]) - 1
    cuts, gaps = (ends[1:] + ends[:-1]) / 2, ends[1:] - ends[:-1]
    missed = np.searchsorted(zp, cuts) / len(zp)
    flagged = 1 - np.searchsorted(zu, cuts) / len(zu)
    risk = prior * missed + np.maximum(flagged - prior * (1 - missed), 0)
    return -float(cuts[np.lexsort((-gaps, np.round(risk, 9)))[0]])  # of equal risks the widest gap


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None) -> ToxicityModel:
    """labels: id_col and label. Only rows of labels for which `allowed` (a condition on id_col) holds are read."""
    marked = labels.select(id_col, label).where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & allowed)
    toxic, rest = marked.where(F.col(label) == 1).select(id_col).distinct(), docs.where(F.col(id_col).isNotNull() & allowed).select(id_col)
    if prior is None:
        share = marked.select(F.avg(F.col(label).cast("double"))).first()[0]
        prior = min(0.5, max(0.001, share or 0.001))

    def features(ids: DataFrame) -> list[np.ndarray]:
        rows = docs.select(id_col, text).join(ids, id_col, "left_semi").select(F.coalesce(text, F.lit("")).alias("t"))

        @F.pandas_udf("array<int>")
        def of(texts: pd.Series) -> pd.Series:
            flat, cuts = bags(texts.tolist())
            return pd.Series([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])])

        return [np.asarray(x, np.int32) for x in rows.select(of("t").alias("x")).toPandas()["x"]]

    model = fit(features(common.bounded_sample(toxic, id_col, POSITIVES)), features(common.bounded_sample(rest, id_col, UNLABELLED)), prior)
    common.tidy(docs.sparkSession)
    return model


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score; a column of that name is replaced."""
    weights = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # BUCKETS floats, whatever the data

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = ToxicityModel(*weights.value)
        for texts in batches:
            yield pd.Series(held.score(texts.tolist()))

    return docs.withColumn("score", score(F.col(text)))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    held = common.fold(F.col("doc_id"), 5) == 0
    model = train(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held)
    return scored(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
