"""Quality classifier by supervised subword embeddings.

Hashed word, word-pair and byte n-gram features get learned vectors; a document is the average of its
features' vectors, and a softmax over the two labels reads it. Training is numpy stochastic gradient
descent on the driver over a bounded, class-balanced sample of labelled rows (`rows_per_label`, the
lowest hashes of their ids). Executors turn those texts into counts of at most 2**18 feature ids, so
no text reaches the driver. As the read-out of an average is the average of the read-outs, scoring
folds vectors and softmax into one number per feature: same function, one table look-up per feature.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm import kernels as K
from quantloom.llm.common import extended, fresh

BITS = 16  # buckets of each kind of feature
KINDS = 4
CLIP = 30.0


def _features(data: np.ndarray, offs: np.ndarray):
    """For each kind of feature: bucket ids in text order, and each row's first and end index into them."""
    shift = K.U64(64 - BITS)
    starts, ends, at = K.words(data, offs, K.WORD_BYTES)
    h = K.word_hashes(data, starts, ends, fold=True)
    yield (h >> shift).astype(np.int32), at[:-1], at[1:]
    pair = K.mix(h[:-1] * K.U64(3) + h[1:]) if len(h) > 1 else h[:0]
    pair[h[:-1] == h[1:]] = 0  # a word said again is one feature, whichever word it is
    yield (pair >> shift).astype(np.int32), np.minimum(at[:-1], len(pair)), np.maximum(at[1:] - 1, np.minimum(at[:-1], len(pair)))
    wide = data.astype(K.U64)
    for n in (3, 5):
        m = max(len(wide) - n + 1, 0)
        g = np.zeros(m, K.U64)
        for i in range(n):
            g |= wide[i : i + m] << K.U64(8 * i)
        g *= K.U64(K.BASE)
        first = np.minimum(offs[:-1], m)
        yield (g >> shift).astype(np.int32), first, np.maximum(offs[1:] - n + 1, first)


def _counted(batches):
    for b in batches:
        ids, counts, labels = [], [], b.column("label").to_pylist()
        for _, data, offs in K.pieces(b.column("text")):
            parts = list(_features(data, offs))
            for d in range(len(offs) - 1):
                own = np.concatenate([x[a[d] : e[d]] + (k << BITS) for k, (x, a, e) in enumerate(parts)])
                u, c = np.unique(own, return_counts=True)
                ids.append(u.astype(np.int32).tobytes())
                counts.append(c.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["label", "ids", "counts"])


@dataclass
class QualityModel:
    """weight: each feature's share of the log-odds of label 1; bias: those of a text without features."""

    weight: np.ndarray
    bias: float

    def score(self, docs: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        """Adds `into`, the probability of label 1, for whole texts (null: as empty). Other columns stay."""
        weight, bias, schema = docs.sparkSession.sparkContext.broadcast(self.weight), self.bias, extended(docs.schema, **{into: "double"})

        def run(batches):
            w = weight.value
            for b in batches:
                out = np.zeros(b.num_rows)
                for row, data, offs in K.pieces(b.column(text)):
                    total, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
                    for k, (x, a, e) in enumerate(_features(data, offs)):
                        c = np.zeros(len(x) + 1)
                        np.cumsum(w[k << BITS : (k + 1) << BITS][x], out=c[1:])
                        total += c[e] - c[a]
                        n += e - a
                    z = bias + total / np.maximum(n, 1)
                    out[row : row + len(z)] = 1 / (1 + np.exp(-np.clip(z, -CLIP, CLIP)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, into])

        return docs.mapInArrow(run, schema)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, epochs: int = 4, rate: float = 4.0, least_steps: int = 6000, seed: int = 7) -> QualityModel:
    """Softmax over averaged feature vectors, by stochastic gradient descent with a falling rate.

    Labels weigh alike, however many rows each has; few rows are gone through more often.
    One label or none to learn from gives a model that always answers that label's prior.
    """
    rng = np.random.default_rng(seed)
    labels = [y for y, *_ in rows]
    if len(set(labels)) < 2:
        prior = (sum(labels) + 0.5) / (len(labels) + 1)
        return QualityModel(np.zeros(KINDS << BITS, np.float32), float(np.log(prior / (1 - prior))))
    vectors = rng.uniform(-1 / dim, 1 / dim, (KINDS << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-least_steps // len(rows)))
    weigh = {y: len(rows) / (2 * labels.count(y)) for y in set(labels)}
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, ids, counts = rows[i]
            lr = rate * (1 - step / steps) * weigh[y]
            step += 1
            share = counts.astype(np.float32) / max(counts.sum(), 1)
            mean = share @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = g @ out
            out -= lr * np.outer(g, mean)
            bias -= 0.02 * lr * g
            if len(ids):
                vectors[ids] -= (lr * share)[:, None] * back[None]
    read = out[1] - out[0]
    return QualityModel((vectors @ read).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_label: int = 1200, **how) -> QualityModel:
    """Learns `labels.quality` (0 or 1; other values and nulls are left out) from the texts of `docs`.

    learn: a condition on `doc_id` for rows that may be learnt from. At most `rows_per_label` rows of
    each label are used. Ids that have several labels count with the least; of repeated documents
    of a chosen id the least text counts. Very long texts count whole. Empty tables give the prior model.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id"))
    picked = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(rows_per_label) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * rows_per_label rows at most
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    got = texts.mapInArrow(_counted, "label int, ids binary, counts binary").toArrow().combine_chunks()
    rows = list(zip(got.column("label").to_pylist(), K.views(got.column("ids"), np.int32), K.views(got.column("counts"), np.uint32), strict=True))
    rows.sort(key=lambda r: (r[0], len(r[1]), crc32(r[1]), crc32(r[2])))  # not as tasks happened to end
    return train(rows, **how)


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Adds `score` and `predicted` (1 if score >= threshold). Null and empty texts get the model's prior.

    Texts of any length are read whole. Columns of `docs` by those names are replaced. Repeated rows get equal
    answers, and an empty table gives no rows.
    """
    plain = docs.drop("score", "predicted")
    return model.score(plain).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rejected_removed(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Documents that the model does not reject, with the columns of `docs`."""
    (score,) = fresh(docs, "score")
    return model.score(docs, into=score).where(F.col(score) >= threshold).drop(score)
