"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import under_share, fold, map_rows, table, text_bytes

#: The network reads windows of so many bytes with its state at zero before each; windows tile the whole text.
STEPS = 64
HIDDEN = 8
#: Documents that the network is fitted on at most, dealt evenly to all languages (those with the smallest hash of doc_id), and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 6
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Direction:
    """One gated layer. table: for each byte the input part (with biases) of update, reset and candidate; u: the recurrent part."""

    table: np.ndarray  # 256 x 3H
    u: np.ndarray  # 3H x H

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step, (steps, H, windows), for bytes x of (steps, windows)."""
        steps, n = x.shape
        size = self.u.shape[1]
        h, out, trace = np.zeros((size, n), np.float32), np.empty((steps, size, n), np.float32), []
        for t in range(steps):
            a = np.take(self.table, x[t], axis=0).T
            rec = self.u @ h
            pre = a[: 2 * size] + rec[: 2 * size]
            gates = np.clip(pre, 0, 1)
            z, r = gates[:size], gates[size:]
            c = r * rec[2 * size :]
            c += a[2 * size :]
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep:
                trace.append((h, pre, z, r, c, rec[2 * size :]))
            h = new
        return out, trace

    def back(self, x: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u, by backpropagation through time, for gradients of every state."""
        steps, n = x.shape
        size = self.u.shape[1]
        du, da = np.zeros_like(self.u), np.empty((steps, 3 * size, n), np.float32)
        later = np.zeros((size, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, pre, z, r, c, rec = trace[t]
            d = grad[t] + later
            dc = d * (1 - z) * (1 - c * c)
            da[t, 2 * size :] = dc
            da[t, :size] = d * (h - c)
            da[t, size : 2 * size] = dc * rec
            da[t, : 2 * size] *= (pre > 0) & (pre < 1)
            drec = np.concatenate([da[t, : 2 * size], dc * r])
            du += drec @ h.T
            later = d * z + self.u.T @ drec
        rows = da.transpose(0, 2, 1).reshape(-1, 3 * size)
        flat = x.reshape(-1)
        return np.stack([np.bincount(flat, rows[:, k], 256) for k in range(3 * size)], 1).astype(np.float32), du


@dataclass
class LanguageNet:
    """Both directions, and the layer that labels every position from their states."""

    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # K x 2H
    bias: np.ndarray  # K

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of each position, (steps, K, windows)."""
        f, _ = self.forward.run(x)
        b, _ = self.backward.run(x[::-1])
        size = f.shape[1]
        logit = np.matmul(self.out[:, :size], f)
        logit += np.matmul(self.out[:, size:], b[::-1])
        logit += self.bias[:, None]
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit


def windows_of(body: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that tile each row, (windows, steps) with zeros at ends; their valid lengths; windows before each row."""
    length = np.diff(offsets)
    count = -(-length // steps)
    before = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(length)), count)
    start = offsets[row] + (np.arange(before[-1]) - before[row]) * steps
    valid = np.minimum(steps, offsets[row + 1] - start)
    at = start[:, None] + np.arange(steps)
    x = np.concatenate([body, np.zeros(steps, np.uint8)])[at]
    x[np.arange(steps) >= valid[:, None]] = 0
    return x, valid, before


def document_probabilities(net: LanguageNet, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of the probabilities of all positions of each row; zeros for rows without bytes."""
    x, valid, before = windows_of(body, offsets)
    sums = np.zeros((len(x), len(net.bias)))
    for a in range(0, len(x), 4096):
        p = net.positions(np.ascontiguousarray(x[a : a + 4096].T))
        inside = np.arange(STEPS)[:, None] < valid[a : a + 4096]
        sums[a : a + 4096] = (p * inside[:, None, :]).sum(0).T
    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])
    return (total[before[1:]] - total[before[:-1]]) / np.maximum(1, np.diff(offsets))[:, None]


def fit_language_net(windows: np.ndarray, target: np.ndarray, languages: list[str], updates: int = 240, batch: int = 384, rate: float = 0.02, seed: int = 7) -> LanguageNet:
    """Adam on the mean log loss of all positions, with gradients by backpropagation through time. windows: bytes, (windows, steps)."""
    rng = np.random.default_rng(seed)
    size, k = HIDDEN, max(1, len(languages))
    init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)

    def direction() -> Direction:
        table = init(256, 3 * size)
        table[:, : 2 * size] += 0.5
        return Direction(table, init(3 * size, size))

    net = LanguageNet(languages, direction(), direction(), init(k, 2 * size), np.zeros(k, np.float32))
    if len(languages) < 2 or not len(windows):
        return net
    params = [net.forward.table, net.forward.u, net.backward.table, net.backward.u, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # every language is drawn as often as the others
    share = 1 / np.bincount(target, minlength=k)[target]
    share /= share.sum()
    for step in range(1, updates + 1):
        pick = rng.choice(len(windows), batch, p=share)
        x = np.ascontiguousarray(windows[pick].T)
        f, ft = net.forward.run(x, keep=True)
        b, bt = net.backward.run(x[::-1], keep=True)
        states = np.concatenate([f, b[::-1]], 1)
        logit = np.matmul(net.out, states) + net.bias[:, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p
        g[:, target[pick], np.arange(batch)] -= 1
        g /= x.size
        back = np.matmul(net.out.T, g)
        grads = [*net.forward.back(x, ft, back[:, :size]), *net.backward.back(np.ascontiguousarray(x[::-1]), bt, back[::-1, size:])]
        grads += [np.einsum("tkn,tsn->ks", g, states, optimize=True), g.sum((0, 2))]
        now = rate * (1 - step / (updates + 1))
        for q, d, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sampled_ids(known: DataFrame, sample_docs: int) -> DataFrame:
    """(lang, doc_id): for each language the documents with the smallest hashes of doc_id, sample_docs over the number of languages (one at least).

    So a language of few documents is learned too. A threshold from each language's number of documents comes before the ranking.
    """
    ids = known.where("doc_id IS NOT NULL").select("lang", "doc_id")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("size"))
    each = -(-sample_docs // max(1, sizes.count()))
    near = under_share(ids.join(sizes, "lang"), F.lit(1.2 * each) / F.col("size"), each).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "doc_id")


def train_language(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> LanguageNet:
    """Fits on up to sample_windows windows, spread over the text, of at most sample_docs documents (or one of each language) outside the held-out fold.

    Documents without a language, a doc_id or a text are left out. Every language that is left is learned.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    rows = known.join(F.broadcast(sampled_ids(known, sample_docs)), ["lang", "doc_id"])

    def kernel(batch: pa.RecordBatch) -> dict:
        x, valid, before = windows_of(*text_bytes(batch.column("text")))
        out: dict[str, list] = {"doc_id": [], "lang": [], "x": []}
        for k, (doc, lang) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
            mine = np.arange(before[k], before[k + 1])
            for w in np.unique(mine[np.linspace(0, len(mine) - 1, min(sample_windows, len(mine))).astype(int)]):
                out["doc_id"].append(doc)
                out["lang"].append(lang)
                out["x"].append(x[w].tobytes())
        return {"doc_id": pa.array(out["doc_id"], pa.int64()), "lang": pa.array(out["lang"], pa.string()), "x": pa.array(out["x"], pa.binary())}

    got = sorted(map_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), kernel, "doc_id long, lang string, x binary").collect())
    languages = sorted({r["lang"] for r in got})
    windows = np.frombuffer(b"".join(r["x"] for r in got), np.uint8).reshape(-1, STEPS)
    target = np.array([languages.index(r["lang"]) for r in got], dtype=np.int64)
    return fit_language_net(windows, target, languages)


def predict_language(docs: DataFrame, net: LanguageNet) -> DataFrame:
    """One row for each document: `lang_pred`, the language with the largest mean probability over all bytes of the text, and that mean as `score`.

    Null and empty texts and texts without a letter get 'und' and 0.0, as do all where nothing could be learned. Ties go to the first language
    in order. Texts may be of any length. Rows that repeat a doc_id are predicted each by their own text, equal texts alike; other columns of
    docs don't matter; an empty table gives an empty result.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        body, offsets = text_bytes(batch.column("text"))
        known = np.array([bool(t and _LETTER.search(t)) for t in texts], dtype=bool) & bool(net.languages)
        p = document_probabilities(net, body, offsets)
        best = p.argmax(1)
        return {
            "doc_id": batch.column("doc_id"),
            "lang_pred": pa.array([net.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
            "score": np.where(known, np.minimum(1.0, p[np.arange(len(p)), best]), 0.0),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, kernel, "doc_id long, lang_pred string, score double")


def op9_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a network of the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, train_language(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
