"""Language ID with a byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over fixed-length windows and classified by softmax.
The network is fitted on a bounded sample of labelled rows (SAMPLE_DOCS) and then scores every window of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for the fit, in about equal shares of all languages, whatever the table's size.
SAMPLE_DOCS = 4000
WINDOW = 256
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 10, 8
STEPS, BATCH, RATE = 400, 128, 0.01


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last one padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteCNN:
    labels: list[str]
    embed: np.ndarray  # 256 x DEPTH
    kernels: list[np.ndarray]  # for each width: width * DEPTH x FILTERS
    bias: np.ndarray  # all filters
    weight: np.ndarray  # filters x labels
    offset: np.ndarray  # labels

    @classmethod
    def fit(cls, windows: np.ndarray, labels: list[str], y: np.ndarray, seed: int = 7) -> ByteCNN:
        """Adam on the cross-entropy, classes weighted equally; gradients flow through each filter's best position."""
        rng, n = np.random.default_rng(seed), len(labels)
        total = FILTERS * len(WIDTHS)
        p = [rng.normal(0, 0.5, (256, DEPTH)), *[rng.normal(0, (1 / (w * DEPTH)) ** 0.5, (w * DEPTH, FILTERS)) for w in WIDTHS], np.zeros(total), rng.normal(0, 0.1, (total, n)), np.zeros(n)]
        p = [x.astype(np.float32) for x in p]
        mean, var = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        share = np.bincount(y, minlength=n)
        odds = (1 / np.maximum(share, 1))[y]
        odds /= odds.sum()
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(y), BATCH, p=odds)
            x, t = windows[pick].astype(np.int64), y[pick]
            e = p[0][x]
            pooled, at = [], []
            for w, k in zip(WIDTHS, p[1 : 1 + len(WIDTHS)]):
                cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                out = cols @ k
                best = out.argmax(axis=1)
                at.append(best)
                pooled.append(np.take_along_axis(out, best[:, None], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + p[-3]
            hidden = np.maximum(z, 0)
            score = hidden @ p[-2] + p[-1]
            score -= score.max(axis=1, keepdims=True)
            prob = np.exp(score)
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob
            d[np.arange(BATCH), t] -= 1
            d /= BATCH
            dz = (d @ p[-2].T) * (z > 0)
            g = [np.zeros_like(p[0]), *[None] * len(WIDTHS), dz.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            for i, (w, best) in enumerate(zip(WIDTHS, at)):
                k, part = p[1 + i], dz[:, i * FILTERS : (i + 1) * FILTERS]
                spots = best[:, :, None] + np.arange(w)  # batch x filters x width
                codes = np.take_along_axis(x[:, None, :], spots, axis=2)
                patch = p[0][codes].reshape(BATCH, FILTERS, w * DEPTH)
                g[1 + i] = np.einsum("bfd,bf->df", patch, part)
                back = (part[:, :, None] * k.T[None]).reshape(-1, DEPTH)
                np.add.at(g[0], codes.reshape(-1), back)
            for q, dq, m, v in zip(p, g, mean, var):
                m += 0.1 * (dq - m)
                v += 0.001 * (dq * dq - v)
                q -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(labels, p[0], p[1:-3], p[-3], p[-2], p[-1])

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities of the labels for each window."""
        # filters of all widths as one product: shorter ones have zeros for the bytes they don't see, and places to the window's end
        wide, spare = max(WIDTHS), max(WIDTHS) - min(WIDTHS)
        kernel = np.zeros((wide * DEPTH, FILTERS * len(WIDTHS)), np.float32)
        for i, (w, k) in enumerate(zip(WIDTHS, self.kernels)):
            kernel[: w * DEPTH, i * FILTERS : (i + 1) * FILTERS] = k
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), 256):
            part = windows[at : at + 256]
            e = np.zeros((len(part), (WINDOW + spare) * DEPTH), np.float32)
            e[:, : WINDOW * DEPTH] = self.embed[part].reshape(len(part), -1)
            cols = np.lib.stride_tricks.sliding_window_view(e, wide * DEPTH, axis=1)[:, ::DEPTH]
            found = (cols.reshape(-1, wide * DEPTH) @ kernel).reshape(len(part), WINDOW - min(WIDTHS) + 1, -1)
            # each width at all its places, as it was fitted
            pooled = np.concatenate([found[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS].max(axis=1) for i, w in enumerate(WIDTHS)], axis=1)
            score = np.maximum(pooled + self.bias, 0) @ self.weight + self.offset
            score -= score.max(axis=1, keepdims=True)
            out[at : at + 256] = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(label, probability) of each whole text: the windows' log-probabilities, weighted by their bytes, are averaged."""
        blocks = [windows_of(t) for t in texts]
        logs = self.log_probs(np.concatenate(blocks)) if blocks else np.zeros((0, len(self.labels)))
        found, at = [], 0
        for text, block in zip(texts, blocks):
            weight = np.full(len(block), WINDOW, np.float64)
            weight[-1] = max(1, len(text) - WINDOW * (len(block) - 1))
            mean = (logs[at : at + len(block)] * weight[:, None]).sum(axis=0) / weight.sum()
            prob = np.exp(mean - mean.max())
            best = int(mean.argmax())
            found.append((self.labels[best], float(prob[best] / prob.sum())))
            at += len(block)
        return found


def held_out() -> object:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit_sample(docs: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """lang, piece: one stretch of text from each of at most ``limit`` labelled rows outside the held-out quarter.

    Rows go by a random priority times their language's count, so the least priorities hold about equally many rows of
    each language.  A cut on the priority leaves about three times ``limit`` rows in all before the top-k, however many tasks
    there are; a language with few rows gives all of them.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~F.coalesce(held_out(), F.lit(False)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("spot")), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int")
    slim = rows.select("lang", h.alias("h"), F.substring(F.col("text"), spot + 1, F.lit(WINDOW)).alias("piece"))
    # about limit / languages rows of each language have a priority under this, so three times that many hold the top ones
    near = 3 * limit * (1 << 30) // max(1, counts.count())
    ranked = slim.join(counts, "lang").withColumn("priority", F.col("h") * F.col("n")).where(F.col("priority") <= near)
    return ranked.orderBy("priority", "h", "lang").limit(limit).select("lang", "piece")


def train(docs: DataFrame, limit: int = SAMPLE_DOCS) -> ByteCNN | None:
    """The network fitted on :func:`fit_sample`; None without labelled rows."""
    got = fit_sample(docs, limit).toPandas()  # limit rows of WINDOW characters
    if got.empty:
        return None
    got = got.sort_values(["lang", "piece"], kind="stable")
    labels = sorted(got["lang"].unique())
    windows = np.concatenate([windows_of(t.encode())[:1] for t in got["piece"]])
    return ByteCNN.fit(windows, labels, np.searchsorted(labels, got["lang"].to_numpy()))


def _predict(batches: Iterable, model: ByteCNN | None):
    import pyarrow as pa

    for batch in batches:
        texts, letters = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("has_letter").to_pylist()
        out = [("und", 0.0)] * len(texts)
        known = [i for i, x in enumerate(letters) if x and model]
        at = 0
        while at < len(known):  # some MB of text at a time
            stop, size = at, 0
            while stop < len(known) and size < 1 << 20:
                size += len(texts[known[stop]])
                stop += 1
            for i, x in zip(known[at:stop], model.predict([texts[i] for i in known[at:stop]])):
                out[i] = x
            at = stop
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def predict_language(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; ``und`` with score 0 where text is null or has no letter.

    The model sees a text's bytes only: the same text gets the same answer in every row, repeated ones too.  Texts of any length are
    read whole, window by window.  A null doc_id is not held out; a model of None (nothing to learn from) predicts ``und``; no
    documents give no rows; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(lambda b: _predict(b, model), "doc_id long, held_out boolean, lang_pred string, score double")
