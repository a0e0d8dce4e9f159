"""Language identification: averaged hashed subword embeddings under a softmax, learned by counting over all rows.

A text's features are the byte n-grams (2 to 4, A-Z in lower case, white space runs kept as they are) hashed into BUCKETS rows; the text is
the average of its features' embeddings. An embedding has a dimension for each language, the logarithm of the bucket's share in that
language's texts over its mean share, and one for a background in which all buckets are alike; features of no language speak for it.
The score is the best language's probability in a softmax of a fitted temperature, the background taking part.

Every allowed row is read whole, and each text weighs the same. Temperature and rejection threshold (a small quantile of scores, to a bin of
1 / BINS below) come from all of these rows too: they are dealt into PARTS by a hash of the text, and each is scored by the counts of the
other parts, so no row meets its own or its copies' counts. A row of a language that no other part has is scored by all counts.
All sums are of integers, so the model depends neither on the order of rows nor on partitions. The driver gets sums only, PARTS x languages x
BUCKETS of them at most; tasks hand over theirs once they hold HELD rows of BUCKETS.
Defined results: null texts and texts without a letter are `und` with score 0 (rejected). Null langs teach nothing; with no labelled row
at all everything is `und`. Ties go to the first language in order. Repeated rows get equal results, whatever
else is in their batch. Empty tables and very long texts work. Other columns pass through, but for those of the added names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm import common
from seekspark.llm.hashing import LOWER, joined

BUCKETS, ORDERS = 1 << 15, (2, 3, 4)
PARTS, HELD, SMALL = 5, 512, 0.1 / BUCKETS
SNIPPET, SNIPPETS = 400, 4
REJECT_QUANTILE, BINS = 0.001, 1 << 16
TEMPERATURES = np.exp(np.linspace(-4, 3, 71))
#: Features of one text share TEXT, so that sums of a batch stay exact in doubles and those of 100 million texts in 64 bits.
SLICE, ONE, TEXT = 1 << 20, 1 << 20, 1 << 36


def grams(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that begins at each byte, one array for each n."""
    x = LOWER[buf].astype(np.uint32)
    h = x.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int32)


def spans(buf: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of bounded size: which texts, the buckets of the n-grams that begin there, and each text's first and last + 1 of them."""
    reach = max(ORDERS) - 1
    for at in range(0, len(buf), SLICE):
        part = buf[at : at + SLICE + reach]
        lo, hi = np.searchsorted(ends, at, "right") - 1, min(len(ends) - 1, np.searchsorted(ends, at + SLICE, "left"))
        begin = np.maximum(ends[lo:hi] - at, 0)
        for n, g in zip(ORDERS, grams(part)):
            g = g[:SLICE]
            # n-grams that reach beyond their text are left out
            stop = np.clip(ends[lo + 1 : hi + 1] - n - at, begin, np.maximum(begin, len(g)))
            yield slice(lo, hi), g, np.minimum(begin, len(g)), np.minimum(stop, len(g))


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text))


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x (langs and the background)
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        self.fixed = np.rint(self.table * ONE).astype(np.int32)

    def logits(self, texts: list) -> np.ndarray:
        """Average table row of each text, whole texts. Sums are of integers, so the batch changes nothing."""
        buf, ends = joined(texts)
        total, count = np.zeros((len(texts), self.fixed.shape[1]), np.int64), np.zeros(len(texts))
        for here, g, first, stop in spans(buf, ends):
            sums = np.concatenate([np.zeros((1, self.fixed.shape[1]), np.int64), np.cumsum(self.fixed[g], 0, dtype=np.int64)])
            total[here] += sums[stop] - sums[first]
            count[here] += stop - first
        return total / ONE / np.maximum(count, 1)[:, None]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """Of the languages; the background has the rest."""
        return np.exp(log_softmax(logits / self.temperature))[:, :-1]

    def predict(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if not self.langs or not len(texts):
            return np.full(len(texts), "und", object), np.zeros(len(texts))
        p = self.probabilities(self.logits(texts))
        letters = np.array([has_letter(t) for t in texts])
        lang = np.array(self.langs, object)[p.argmax(1)]
        return np.where(letters, lang, "und"), np.where(letters, p.max(1), 0.0)


def snippets(text: str | None) -> list[str]:
    """Parts of a text from random positions, the same at each call. Learning reads whole texts and does not call this."""
    text = text or ""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    starts = {int(a) for a in rng.integers(0, max(1, len(text) - SNIPPET + 1), SNIPPETS)}
    return [text[a : a + SNIPPET] for a in sorted(starts)]


def tally(texts: list) -> np.ndarray:
    """Sums of the shares of TEXT that each bucket has in each text."""
    buf, ends = joined(texts)
    weight = np.rint(TEXT / np.maximum(sum(np.maximum(np.diff(ends) - n, 0) for n in ORDERS), 1))
    out = np.zeros(BUCKETS, np.int64)
    for here, g, first, stop in spans(buf, ends):
        n = stop - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        out += np.bincount(g[at], np.repeat(weight[here], n), BUCKETS).astype(np.int64)
    return out


def fit(langs: list[str], counts: np.ndarray) -> LanguageModel:
    """A model without calibration, from the tally of each language."""
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    share = counts / np.maximum(counts.sum(1, dtype=float), 1)[:, None]
    table = np.log(np.concatenate([share, np.full((1, BUCKETS), 1 / BUCKETS)]) + SMALL) - np.log(share.mean(0) + SMALL)
    return LanguageModel(langs, table.T.astype(np.float32))


def summed(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], size: int) -> np.ndarray:
    """The sums of n by k, of the rows of k and n that run makes, for each k below size. They come as Arrow columns: toPandas would make an
    object of every row first, unless a session setting is on."""
    got = rows.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def train(docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows that `allowed` marks and their whole texts."""
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(text)), F.lit(PARTS)).cast("int")
    rows = docs.where(allowed & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), part.alias("part"))
    langs = sorted(r.l for r in rows.select("l").distinct().collect())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, sums = {x: i for i, x in enumerate(langs)}, {}
        for b in batches:
            for k, t in b["t"].groupby(b["part"] * len(langs) + b["l"].map(code)):
                sums[k] = sums.get(k, 0) + tally(t.tolist())
            if len(sums) >= HELD:
                yield from handed(sums)
        yield from handed(sums)

    def handed(sums: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        for k in [*sums]:
            n = sums.pop(k)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"k": k * BUCKETS + at, "n": n[at]})

    counts = summed(rows, count, PARTS * len(langs) * BUCKETS).reshape(PARTS, len(langs), BUCKETS)
    learned = counts.any((0, 2))  # languages without any feature are not learned
    langs, counts = [x for x, ok in zip(langs, learned) if ok], counts[:, learned]
    whole = counts.sum(0)
    model = fit(langs, whole)
    if not langs:
        return model
    others = [fit(langs, whole - c) for c in counts] + [model]
    known = np.array([(whole - c).any(1) for c in counts])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = {x: i for i, x in enumerate(langs)}
        for b in batches:
            b = b[[has_letter(t) and x in code for t, x in zip(b["t"], b["l"])]]
            y, p = b["l"].map(code).to_numpy(int), b["part"].to_numpy(int)
            by, z = np.where(known[p, y], p, PARTS), np.zeros((len(b), len(langs) + 1))
            for k in np.unique(by):
                z[by == k] = others[k].logits(b["t"][by == k].tolist())
            yield pd.DataFrame({"y": y, "z": [*z]})

    return calibrated(model, common.saved(rows.mapInPandas(score, "y int, z array<double>"), "language_scores"))


def calibrated(model: LanguageModel, scored: DataFrame) -> LanguageModel:
    """The model with temperature and threshold from the logits z of all of scored and their languages y. The loss keeps a little for other
    languages, the less the more rows there are, so few rows without a mistake do not make it certain."""
    grid, width = len(TEMPERATURES), len(model.langs) + 1

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z, y = np.array(b["z"].tolist(), float).reshape(len(b), width), b["y"].to_numpy(int)
            logs = [log_softmax(z / t) for t in TEMPERATURES]
            sums = [x[np.arange(len(y)), y] for x in logs] + [x.mean(1) for x in logs]
            yield pd.DataFrame({"k": np.arange(2 * grid + 1), "n": [*(int(np.rint(-x * ONE).sum()) for x in sums), len(b)]})

    found = summed(scored, losses, 2 * grid + 1)
    total = int(found[-1])
    if total:
        rest = 1 / (total / len(model.langs) + 2)
        model.temperature = float(TEMPERATURES[np.argmin((1 - rest) * found[:grid] + rest * found[grid:-1])])

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                best = model.probabilities(np.array(b["z"].tolist(), float).reshape(len(b), width)).max(1, initial=0)
                k, n = np.unique((best * BINS).astype(int), return_counts=True)
                yield pd.DataFrame({"k": k, "n": n})

        below = np.cumsum(summed(scored, bins, BINS + 1))
        model.threshold = float(np.searchsorted(below, REJECT_QUANTILE * total, "right") / BINS)
    common.discard(scored)
    common.tidy(scored.sparkSession)
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = model.predict(b[text].tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score.astype(float), "rejected": (lang == "und") | (score < model.threshold)})

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(pd.DataFrame({text: s}) for s in batches)

    added, tmp = ("lang_pred", "score", "rejected"), common.unused(docs, "found")
    out = docs.withColumn(tmp, udf(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[F.col(f"{tmp}.{c}") for c in added])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = common.fold(F.col("doc_id"), 3) == 1
    model = train(docs, ~held)
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
