"""Quality rules: fixed limits on counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, mix, per_row, prefix_hash, smallest_hashes, span_hash, table, word_spans

#: The most labelled rows that the model is fitted on: those with the smallest hash of doc_id.
SAMPLE_ROWS = 2048
#: Buckets of word n-grams (1 and 2 words), and as many of character n-grams (3 characters).
BUCKETS = 4096
#: A text stays from this calibrated probability of label 1 on.
KEEP_FROM = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


@dataclass
class Texts:
    """The texts of a batch as code points, with their words."""

    points: np.ndarray
    offsets: np.ndarray
    space: np.ndarray
    words: np.ndarray  # a hash for each word
    codes: np.ndarray  # a number for each word, equal for equal words only
    word_at: np.ndarray  # words before each row

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        texts = [t or "" for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
        starts, ends, word_at = word_spans(space, offsets)
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string())).flatten()
        codes = split.filter(pc.not_equal(split, "")).dictionary_encode().indices.to_numpy().astype(np.int64)
        return cls(points, offsets, space, span_hash(prefix_hash(points), starts, ends), codes, word_at)

    def windows(self, n: int, items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive items that don't cross a row's end, and how many come before each row."""
        size = max(0, len(items) - n + 1)
        h = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ mix(items[k : k + size].astype(np.uint64) + np.uint64(k))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        fits = row[:size] == row[n - 1 :] if size else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(fits)])
        return mix(h[fits]), before[np.minimum(at, size)]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of word and of character n-grams, each with how many come before each row."""
        one, (two, two_at) = self.words, self.windows(2, self.words, self.word_at)
        bucket = np.concatenate([one, two]) % np.uint64(BUCKETS)
        # rows of both kinds stand apart, so they are put in the order of rows
        row = np.concatenate([np.repeat(np.arange(len(a) - 1), np.diff(a)) for a in (self.word_at, two_at)])
        order = np.argsort(row, kind="stable")
        size = max(0, len(self.points) - 2)
        p = self.points.astype(np.uint64)
        chars = (mix(p[:size] | (p[1 : size + 1] << np.uint64(21)) | (p[2:] << np.uint64(42))) % np.uint64(BUCKETS)).astype(np.int64)
        row_of = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        fits = row_of[:size] == row_of[2:] if size else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(fits)])
        return bucket[order].astype(np.int64), self.word_at + two_at, chars[fits], before[np.minimum(self.offsets, size)]

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """For each row the words that lie in an n-word window found at least twice in it. Windows are numbered exactly, not hashed."""
        size = max(0, len(self.codes) - n + 1)
        row = np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))
        different, window = int(self.codes.max(initial=0)) + 1, self.codes[:size]
        for k in range(1, n):
            window = np.unique(window * different + self.codes[k : k + size], return_inverse=True)[1]
        h = window * len(self.word_at) + row[:size]
        fits = row[:size] == row[n - 1 :] if size else np.zeros(0, bool)
        places = np.flatnonzero(fits)
        order = np.argsort(h[places])
        sorted_h = h[places][order]
        same = sorted_h[1:] == sorted_h[:-1]
        twice = np.zeros(len(places), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        marks = np.zeros(len(self.words) + 1, dtype=np.int64)
        at = places[order[twice]]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + n, -1)
        return per_row((np.cumsum(marks)[:-1] > 0).astype(np.int64), self.word_at)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


@dataclass
class NgramModel:
    """Means of n-gram weights, through a logistic curve fitted on rows that the weights were not."""

    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, texts: Texts) -> np.ndarray:
        w, w_at, c, c_at = texts.grams()
        each = lambda table, b, at: per_row(table[b], at) / np.maximum(1, np.diff(at))
        return self.bias + each(self.words, w, w_at) + each(self.chars, c, c_at)

    def score(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(texts) + self.shift, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on the penalised log loss."""
    n, d = x.shape
    v = np.ones(d, dtype=np.float32)
    for _ in range(8):
        v = x.T @ (x @ v)
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-12)
    step = 1 / (0.25 * (norm / n + 1) + penalty)
    w, b, ow, ob = np.zeros(d, np.float32), 0.0, np.zeros(d, np.float32), 0.0
    for t in range(steps):
        m = t / (t + 3)
        aw, ab = w + m * (w - ow), b + m * (b - ob)
        r = (y - 1 / (1 + np.exp(-np.clip(x @ aw + ab, -30, 30)))) / n
        ow, ob = w, b
        w, b = (aw + step * (x.T @ r.astype(np.float32) - penalty * aw)).astype(np.float32), ab + step * float(r.sum())
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate margins: the log loss of smoothed labels, by Newton steps that are halved until they lower it."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    unit = max(float(margin.std()), 1e-9)
    x = np.stack([margin / unit, np.ones(len(y))], 1)
    w = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-4 * (w @ w))

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 2e-4 * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2e-4 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return max(float(w[0]), 1e-3) / unit, float(w[1])


SCALE = 40.0


def fit_ngrams(counts: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 200) -> NgramModel:
    """counts: for each row the shares of word and of character buckets. Every fifth row calibrates, the others are fitted.

    Without rows, or with one label only, every text gets that label's smoothed share.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    flat = NgramModel(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    if len(y) < 10 or y.min() == y.max():
        return flat if len(y) and y.min() == y.max() else NgramModel(flat.words, flat.chars, 0.0)
    hold = np.arange(len(y)) % 5 == 0
    if y[hold].min() == y[hold].max() or y[~hold].min() == y[~hold].max():
        return flat
    w, b = _logistic(counts[~hold] * np.float32(SCALE), y[~hold], penalty, steps)
    w = w.astype(np.float64) * SCALE
    slope, shift = _platt(counts[hold] @ w + b, y[hold])
    return NgramModel(w[:BUCKETS], w[BUCKETS:], b, slope, shift)


def train_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> NgramModel:
    """Fits on at most sample_rows labelled rows, chosen by the hash of doc_id. Bucket counts of their whole texts reach the driver, texts don't."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = smallest_hashes(known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def kernel(batch: pa.RecordBatch) -> dict:
        w, w_at, c, c_at = Texts.of(batch.column("text").to_pylist()).grams()
        found = []
        for k in range(batch.num_rows):
            for b, at in ((w, w_at), (c, c_at)):
                found.append(np.bincount(b[at[k] : at[k + 1]], minlength=BUCKETS).astype(np.uint32))
        used = [np.flatnonzero(x).astype(np.uint16) for x in found]
        return {"doc_id": batch.column("doc_id"), "quality": batch.column("quality")} | {
            name: pa.array([f(x, u) for x, u in zip(found[k::2], used[k::2], strict=True)], pa.binary())
            for k, side in enumerate("wc")
            for name, f in ((f"{side}_at", lambda x, u: u.tobytes()), (f"{side}_n", lambda x, u: x[u].tobytes()))
        }

    got = sorted(map_rows(rows, kernel, "doc_id long, quality int, w_at binary, w_n binary, c_at binary, c_n binary").collect(), key=lambda r: (r["doc_id"], r["w_at"], r["w_n"]))
    x = np.zeros((len(got), 2 * BUCKETS), dtype=np.float32)
    for k, r in enumerate(got):
        for at, n, shift in ((r["w_at"], r["w_n"], 0), (r["c_at"], r["c_n"], BUCKETS)):
            n = np.frombuffer(n, np.uint32).astype(np.float32)
            x[k, np.frombuffer(at, np.uint16).astype(np.int64) + shift] = n / max(1.0, n.sum())
    return fit_ngrams(x, np.array([r["quality"] for r in got], dtype=float))


def apply_rules(docs: DataFrame, model: NgramModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row for each document (null text: empty) with its counts, base_failed, the calibrated `score` and `kept`.

    Words are runs of characters other than ASCII white space. base_failed: fewer than 50 words, or over half of them in repeated
    3-word windows. Everything is computed on whole texts. Rows that repeat a doc_id are judged each by their own text, equal texts alike; a
    score of exactly keep_from is kept; other columns of docs don't matter; an empty table gives an empty result.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        raw = batch.column("text").to_pylist()
        texts = Texts.of(raw)
        n_words = np.diff(texts.word_at)
        repeat, score = texts.repeated_words(), model.score(texts)
        failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
        return {
            "doc_id": batch.column("doc_id"), "n_words": n_words, "word_chars": per_row((~texts.space).astype(np.int64), texts.offsets),
            "n_symbols": np.array([sum(map((t or "").count, SYMBOLS)) for t in raw], dtype=np.int64),
            "n_dup_lines": np.array([repeated_lines(t) for t in raw], dtype=np.int64), "n_repeat_words": repeat,
            "base_failed": failed, "kept": ~failed & (score >= keep_from), "score": score,
        }

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def op5_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the base rules and a model of all labelled quality rows (bounded by SAMPLE_ROWS)."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train_rules(docs, table(spark, sf_dir, "labels")))
