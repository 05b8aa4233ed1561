"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all its bytes. Filters over byte windows, learned by
gradient descent, are max-pooled over each chunk; a small dense layer turns what a chunk shows into one
number, and the largest and the mean of a text's chunks are combined into one probability. Only a
bounded sample of labelled rows trains the network; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow
from graphloom.llm.words import groups

#: Bytes of a chunk and from one chunk to the next: neighbours share more than a filter's width.
CHUNK, STEP = 512, 480
FILTERS, WIDTH, HIDDEN = 24, 6, 12
#: Bytes of texts that are scored together.
GROUP = 1 << 19
#: The training sample's bounds: labelled rows of each class at most, and bytes of them all. Its texts are trained on whole.
TRAIN_ROWS, TRAIN_BYTES = 1200, 16 << 20
#: Bytes of the short pieces of texts that are trained on besides: at least, and fewer than.
PIECE = (16, 200)
EPOCHS, BATCH, RATE, DECAY = 9, 64, 0.006, 1e-5
#: Remainders of crc32 of the id by FOLDS that are held out are 0.
FOLDS = 5
THRESHOLD = 0.3


@dataclass
class Model:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    #: Weights of largest and mean chunk, and the constant.
    pool: np.ndarray

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk, and its position."""
        span = CHUNK - WIDTH + 1
        out = np.take(self.table[0], chunks[:, :span], axis=0)
        for k in range(1, WIDTH):
            out += np.take(self.table[k], chunks[:, k : k + span], axis=0)
        at = out.argmax(axis=1)
        return np.take_along_axis(out, at[:, None, :], axis=1)[:, 0, :] + self.bias, at

    def junk(self, chunks: np.ndarray) -> np.ndarray:
        """How much each chunk speaks against the text."""
        out = np.zeros(len(chunks), np.float32)
        span = CHUNK - WIDTH + 1
        for a in range(0, len(chunks), BATCH):
            part = chunks[a : a + BATCH]
            seen = np.take(self.table[0], part[:, :span], axis=0)
            for k in range(1, WIDTH):
                seen += np.take(self.table[k], part[:, k : k + span], axis=0)
            h = np.maximum(seen.max(axis=1) + self.bias, 0)
            out[a : a + BATCH] = np.maximum(h @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]
        return out

    def probability(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = self.pool[0] * most.astype(np.float64) + self.pool[1] * mean.astype(np.float64) + self.pool[2]
        return 1 / (1 + np.exp(np.clip(z, -40, 40)))


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of all rows, zero-padded, and where each row's chunks begin (one more than rows)."""
    length = np.diff(offsets)
    many = np.maximum(0, -(-(length - CHUNK) // STEP)) + 1
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(length)), many)
    begin = (np.arange(first[-1]) - first[row]) * STEP + offsets[:-1][row]
    at = begin[:, None] + np.arange(CHUNK)[None, :]
    inside = at < offsets[1:][row][:, None]
    if not len(data):
        return np.zeros((len(row), CHUNK), np.uint8), first
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), first


def train(texts: list[bytes], good: np.ndarray, seed: int = 1) -> Model:
    """Fits the network. Chunks carry the label of their text; once the filters know something, the
    chunks of a bad text that look good count less, save the worst, since a bad text may have good parts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    data = np.frombuffer(b"".join(texts), np.uint8)
    chunks, first = chunked(data, np.cumsum([0, *map(len, texts)]))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    # A short piece from the middle of each text besides, so that few bytes alone speak neither for nor against.
    pieces = [t[len(t) // 2 :][: int(n)] for t, n in zip(texts, rng.integers(*PIECE, len(texts)), strict=True)]
    short, _ = chunked(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)]))
    x, d = np.concatenate([chunks, short]), np.concatenate([doc, np.arange(len(texts))])
    bad = (1 - good)[d].astype(np.float32)
    share = 1 / np.bincount(d, minlength=len(texts))[d]
    share = (share / share.mean()).clip(0.2, 5).astype(np.float32)
    normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    m = Model(normal(WIDTH, 256, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=(2 / HIDDEN) ** 0.5), np.zeros(1, np.float32), np.array([1.0, 0.0, 0.0]))
    slots = [m.table, m.bias, m.w1, m.b1, m.w2, m.b2]
    mean, square, t = [np.zeros_like(p) for p in slots], [np.zeros_like(p) for p in slots], 0
    weight = share.copy()
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        z_all = np.zeros(len(x), np.float32)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            part = x[own]
            top, at = m.pooled(part)
            h = np.maximum(top, 0)
            u = h @ m.w1 + m.b1
            g = np.maximum(u, 0)
            z = g @ m.w2 + m.b2[0]
            z_all[own] = z
            dz = (weight[own] * (1 / (1 + np.exp(-z)) - bad[own]) / len(own)).astype(np.float32)
            du = dz[:, None] * m.w2 * (u > 0)
            dh = (du @ m.w1.T) * (top > 0)
            d_table = np.zeros_like(m.table)
            for k in range(WIDTH):
                np.add.at(d_table[k], (np.take_along_axis(part, at + k, axis=1), np.arange(FILTERS)[None, :]), dh)
            grads = [d_table + DECAY * m.table, dh.sum(axis=0), h.T @ du, du.sum(axis=0), g.T @ dz, dz.sum(keepdims=True)]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) * min(1, t / 50)
            for p, q, s, dp in zip(slots, mean, square, grads, strict=True):
                q += 0.1 * (dp - q)
                s += 0.01 * (dp * dp - s)
                p -= rate * (q / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
        if epoch >= 2:
            worst = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(worst, d, z_all)
            weight = np.where((bad > 0) & (z_all < 0) & (z_all < worst[d]), 0.05 * share, share)
    z = m.junk(chunks)
    most, avg = np.maximum.reduceat(z, first[:-1]), np.add.reduceat(z, first[:-1]) / np.diff(first)
    m.pool = _logistic(np.stack([most, avg, np.ones_like(avg)], axis=1).astype(np.float64), 1.0 - good)
    return m


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, classes weighed alike, with a little shrinkage."""
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        shrink = np.array([0.05, 0.05, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-6), x.T @ (weight * (p - y)) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The bounded training sample: texts and labels of rows that are not held out.

    Rows are taken in order of a digest of their id until ``TRAIN_ROWS`` of a class or ``TRAIN_BYTES`` in all
    are reached; only a text that is larger than all of that bound can't be in it.
    """
    spare = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0, F.lit(False))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(spare & F.col("quality").isin(0, 1))
    picked = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for q in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where(F.octet_length("text") <= TRAIN_BYTES)
    order = (F.xxhash64("doc_id"), "doc_id", F.md5("text"), "quality")
    rows = rows.select("doc_id", "text", "quality").orderBy(*order).limit(2 * TRAIN_ROWS)
    # One task sums the sizes: there are no more rows than the bound.
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_bytes", so_far).where(F.col("_bytes") <= TRAIN_BYTES).select("doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["quality"]))
    return [r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.float64)


def _pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the mean of each row's chunks. A text longer than a group stands alone in it and is worked off in pieces."""
    if len(data) <= GROUP:
        chunks, first = chunked(data, offsets)
        z = model.junk(chunks)
        return np.maximum.reduceat(z, first[:-1]), np.add.reduceat(z, first[:-1]) / np.diff(first)
    many, span = -(-(len(data) - CHUNK) // STEP) + 1, GROUP // STEP
    most, total = -np.inf, 0.0
    for a in range(0, many, span):
        part = data[a * STEP : (min(a + span, many) - 1) * STEP + CHUNK]
        z = model.junk(chunked(part, np.array([0, len(part)]))[0])
        most, total = max(most, float(z.max())), total + float(z.sum(dtype=np.float64))
    return np.array([most]), np.array([total / many])


def _score(batches: Iterator[pa.RecordBatch], model: Model | float) -> Iterator[pa.RecordBatch]:
    at_column = "text"
    for batch in batches:
        scores = []
        for _, data, offsets in groups(batch.column(at_column), GROUP):
            if isinstance(model, float):
                scores.append(np.full(len(offsets) - 1, model))
                continue
            scores.append(model.probability(*_pooled(model, data, offsets)))
        scores = np.concatenate(scores) if scores else np.zeros(0)
        names = [n for n in batch.schema.names if n != "_scored"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores)], names=[*names, "_score"])


def fitted(docs: DataFrame, labels: DataFrame) -> Model | float:
    texts, good = sample(docs, labels)
    if len(set(good.tolist())) < 2:
        return float((good.sum() + 1) / (len(good) + 2))
    return train(texts, good)


def scored(docs: DataFrame, labels: DataFrame, model: Model | float | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``; by ``model`` where one is given.

    Reads ``doc_id`` and ``text`` of ``docs`` and ``doc_id`` and ``quality`` of ``labels``; of these only
    the text is an input of a score. Null texts are empty, and an empty text is one chunk of zeros. A
    row without ``doc_id`` is not held out and never trains. Repeated rows score alike. Labels other
    than 0 and 1 are skipped; where only one class or none is labelled, each score is that class's
    smoothed share. Repeated or contradictory labels all train. A text of any length is scored whole, a group of
    its chunks at a time. An empty table gives no rows.
    """
    model = fitted(docs, labels) if model is None else model
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = in_arrow(slim, lambda it, m=model: (b.select(["doc_id", "_score"]) for b in _score(it, m)), "doc_id long, _score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = fitted(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string())], names=["text"])
            (out,) = _score(iter([own]), model)
            yield batch.filter(pa.array(out.column("_score").to_numpy() >= THRESHOLD))

    return in_arrow(docs, keep, docs.schema)
