"""Quality classifier: a generalised additive model with pairwise interactions (lookup tables learned by cyclic boosting)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_at, fold, map_rows, smallest_hashes, table

#: The most labelled rows that a model is fitted on: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "symbols", "upper", "exclaim", "pipes", "stops", "digits", "lines",
    "distinct", "top_word", "same_next", "capitals", "repeated_lines", "longest",
)
SYMBOLS = "#*$%&<>@{}[]=~^_\\"


def text_features(text: str | None) -> list[float]:
    """Figures of a whole text that do not depend on its language. Null and empty texts give zeros."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars, counts = len(text), Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log(n)), sum(map(len, words)) / n, sum(map(text.count, SYMBOLS)) / n, sum(map(str.isupper, words)) / n,
        text.count("!") / n, text.count("|") / n, text.count(".") / n, sum(map(text.count, "0123456789")) / chars, len(lines) / n,
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, sum(map(str.istitle, words)) / n,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log(max(map(len, words)))),
    ]


@dataclass
class PairwiseGam:
    """Logit = bias + sum of a table entry for each feature + sum of one for each chosen pair of features."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by adding up the entries of each row's bins."""
        fine = [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)]
        logit = np.full(len(x), self.bias)
        for t, b in zip(self.tables, fine, strict=True):
            logit += t[b]
        if self.pairs:
            rough = [np.searchsorted(e, x[:, k]) for k, e in enumerate(self.coarse)]
            for (i, j), t in self.pairs.items():
                logit += t[rough[i], rough[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 5.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 5.0)


def _stump(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best tree of one cut over a feature's bins, as an entry for each bin."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return np.zeros(len(g))
    cut = int(np.argmax(_gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl))) + 1
    out = np.empty(len(g))
    out[:cut], out[cut:] = _leaf(g[:cut].sum(), h[:cut].sum()), _leaf(g[cut:].sum(), h[cut:].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and an entry for each pair of bins."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, ah = G[:-1, :-1], H[:-1, :-1]
    b, bh = G[:-1, -1:] - a, H[:-1, -1:] - ah
    c, ch = G[-1:, :-1] - a, H[-1:, :-1] - ah
    d, dh = G[-1, -1] - a - b - c, H[-1, -1] - ah - bh - ch
    gains = _gain(a, ah) + _gain(b, bh) + _gain(c, ch) + _gain(d, dh)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty_like(g)
    for rows, cols, x, w in ((slice(0, i + 1), slice(0, j + 1), a, ah), (slice(0, i + 1), slice(j + 1, None), b, bh), (slice(i + 1, None), slice(0, j + 1), c, ch), (slice(i + 1, None), slice(j + 1, None), d, dh)):
        out[rows, cols] = _leaf(x[i, j], w[i, j])
    return float(gains[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rough_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15) -> PairwiseGam:
    """Cycles over the features, each time adding a shallow tree on the gradients to that feature's table; then over the pairs with the largest gain.

    Without rows the model gives 0.5, with one label only that label's smoothed share.
    """
    n, k = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    edges, coarse = [_edges(x[:, j], bins) for j in range(k)] if n else [np.zeros(0)] * k, [_edges(x[:, j], rough_bins) for j in range(k)] if n else [np.zeros(0)] * k
    gam = PairwiseGam(edges, coarse, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges])
    if not n or y.min() == y.max():
        return gam
    fine = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, j]) for j, e in enumerate(coarse)]
    logit = np.full(n, gam.bias)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = gradients()
            size = len(edges[j]) + 1
            tree = rate * _stump(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size))
            gam.tables[j] += tree
            logit += tree[fine[j]]

    def cross(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = gradients()
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        return _cross(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))

    chosen = sorted(combinations(range(k), 2), key=lambda p: (-cross(*p)[0], p))[:n_pairs]
    gam.pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            tree = rate * cross(i, j)[1]
            gam.pairs[i, j] += tree
            logit += tree[rough[i], rough[j]]
    return gam


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> PairwiseGam:
    """Fits on labelled rows whose crc32(doc_id) mod 3 is not 1, at most sample_rows of them, chosen by the hash of their doc_id.

    Only their features reach the driver. Labels other than 0 and 1 and labels without a document are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    sample = smallest_hashes(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def kernel(batch: pa.RecordBatch) -> dict:
        x = [text_features(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array(x, pa.list_(pa.float64()))}

    got = map_rows(rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text"), kernel, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["doc_id"].to_numpy())) if len(x) else []
    return fit_gam(x[order], got["quality"].to_numpy(dtype=float)[order]) if len(x) else fit_gam(x, np.zeros(0))


def score_quality(docs: DataFrame, model: PairwiseGam, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of docs (default: doc_id) with `score`, the probability of label 1, and `predicted` (1 from 0.5 on).

    Every row gets a score from its whole text, however long; null and empty texts that of a text without words. Rows that repeat a doc_id
    are scored each by their own text, equal texts alike; an empty table gives an empty result. `text` may be a field of a kept struct
    ('document.text'), so that the text goes to Python once; the kept columns may have any names but `score` and `predicted`.
    """
    keep = keep or ["doc_id"]
    inside = text.split(".")[0] in keep
    rows = docs.select(*keep) if inside else docs.select(*keep, F.col(text).alias("_text"))
    place = text if inside else "_text"

    def kernel(batch: pa.RecordBatch) -> dict:
        x = np.array([text_features(t) for t in column_at(batch, place).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        score = model.score(x)
        return {c: batch.column(c) for c in keep} | {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    schema = rows.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return map_rows(rows, kernel, schema)


def op2_pairwise_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
