"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Features.  A text's tokens are its words and its runs of other characters; every token is hashed
once (and remembered), a word also under its shape, so that habits of case and punctuation count
beside vocabulary.  Token n-grams combine those hashes arithmetically in numpy.  A text is a sparse
vector of n-gram frequencies over ``2**bits`` buckets; its score is the logistic of the dot product
with the weights, a gather and a sum, over the whole text.

Training.  Labelled rows are chosen by a hash of their id, ``max_rows`` in expectation at most (a
documented bound: what is learned from does not grow with the corpus).  They are dealt into
``shards``; each shard runs FTRL-Proximal over its rows in a fixed order, and the shards' weights
are averaged by their row counts on the driver, where one model is ``2**bits`` numbers.

Defined results: null and empty texts have no features and get the score of the intercept alone;
null labels are ignored; several labels of one id count as their mean, rounded up at one half; a
repeated doc_id is scored each time it occurs, and its different texts may each be learned from; extra columns (``labels`` or ``lang`` of clashing
names included) are never inputs; without labels of both kinds every score is the smoothed share
of label 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, staged, text_or_empty, unstage

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: tokens whose hashes a worker remembers; tokens taken at a time, so a long text takes bounded memory
_REMEMBERED, _BLOCK = 250_000, 1 << 18
#: scale of a frequency, so that weights of order one decide a text
_SCALE = 32.0


class _Known(dict):
    """token -> number of a row of ``table``, which has the token's hash and the hash of its shape."""

    def __init__(self):
        self.table = np.zeros((2, 1 << 12), np.uint64)

    def __missing__(self, token: str) -> int:
        k = len(self)
        if k == self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
        if token[0].isalnum() or token[0] == "_":
            case = "A" if token.isupper() and len(token) > 1 else "Aa" if token[:1].isupper() else "a" if token.islower() else "9" if token.isdigit() else "x"
            shape = case + "-" * min(4, len(token) // 4)
        else:
            shape = token[:8]
        self.table[0, k] = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass"))
        self.table[1, k] = xxhash.xxh64_intdigest("\0" + shape)
        self[token] = k
        return k


class Features:
    """Bucket numbers of all n-grams of a text, repeats included, block by block."""

    def __init__(self, bits: int = 18, orders: tuple[int, ...] = (1, 2)):
        self.bits, self.orders = bits, orders
        self.known = _Known()

    def __call__(self, text: str):
        tokens = _TOKEN.findall(text or "")
        most = max(self.orders)
        for k in range(0, len(tokens), _BLOCK):
            part = tokens[k : k + _BLOCK + most - 1]
            if len(self.known) > _REMEMBERED:
                self.known = _Known()
            rows = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            for h in self.known.table:
                h = h[rows]
                for n in self.orders:
                    count = min(len(h) - n + 1, _BLOCK)
                    if count > 0:
                        g = h[:count] * _M1
                        for j in range(1, n):
                            g = (g ^ (g >> np.uint64(29))) * _M2 + h[j : j + count] * _M3
                        yield (g * _M1 >> np.uint64(64 - self.bits)).astype(np.int64)

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their scaled frequencies."""
        parts = list(self(text))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0)
        idx, n = np.unique(np.concatenate(parts), return_counts=True)
        return idx, n * (_SCALE / n.sum())


class Ftrl:
    """FTRL-Proximal for the logistic loss; the intercept is updated by the same rule without shrinkage."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, idx: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> float:
        idx, x = np.append(idx, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(idx)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] += g * g
        return float(p)


def label_rows(labels: DataFrame, label: str, id_col: str = "doc_id", where: Column | None = None) -> DataFrame:
    """``(doc_id, y)``: one row per id, for rows that may be learned from."""
    rows = labels if where is None else labels.filter(where)
    return rows.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, where: Column | None, max_rows: int, salt: str, text_col: str = "text") -> DataFrame:
    """``(doc_id, text, y)``: at most ``max_rows`` labelled texts in expectation, chosen by hashes, as a staged table.

    Ids are sampled first; where ids repeat with different texts, the texts are sampled again, so the
    bound holds whatever the tables hold.  A text that repeats under one id counts once.
    """
    rows = label_rows(labels, label, where=where)
    share = min(1.0, max_rows / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # max_rows bounds this side: some 200 kB whatever the corpus is
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(rows), "doc_id")
    out = staged(chosen.distinct(), salt)
    n = out.count()
    if n > 2 * max_rows:
        share = max_rows / n
        fewer = staged(out.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20))), salt)
        unstage(out)
        return fewer
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, max_rows: int = 8_000, bits: int = 18, orders: tuple[int, ...] = (1, 2), epochs: int = 2, shards: int = 6, text_col: str = "text") -> np.ndarray:
    """Weights of ``2**bits`` buckets and, last, the intercept."""
    chosen = labelled(docs, labels, label, where, max_rows, "train", text_col)
    bounded_batches(docs.sparkSession)

    def hashed(batches):
        features = Features(bits, orders)
        for pdf in batches:
            pairs = [features.sparse(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "idx": [p[0].astype(np.int32) for p in pairs], "x": [p[1].astype(np.float32) for p in pairs]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=[xxhash.xxh64_intdigest(str(d)) for d in pdf["doc_id"]], i=pdf["idx"].map(bytes)).sort_values(["o", "i"], kind="stable")
        model, share = Ftrl(1 << bits), pdf["y"].mean()
        # both labels weigh alike in the gradient, half-way to their shares
        up = {1: (0.5 / max(share, 0.02)) ** 0.5, 0: (0.5 / max(1 - share, 0.02)) ** 0.5}
        for _ in range(epochs):
            for i, x, y in zip(pdf["idx"], pdf["x"], pdf["y"].tolist(), strict=True):
                model.update(np.asarray(i, np.int64), np.asarray(x, float), y, up[y])
        w = model.weights()
        keep = np.flatnonzero(w)
        return pd.DataFrame({"rows": [len(pdf)], "ones": [int(pdf["y"].sum())], "idx": [keep.astype(np.int32)], "w": [w[keep]]})

    parts = (
        chosen.mapInPandas(hashed, "doc_id long, y int, idx array<int>, x array<float>")
        .groupBy(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"))
        .applyInPandas(fit, "rows long, ones long, idx array<int>, w array<double>")
        .collect()  # ``shards`` models of 2**bits weights at most
    )
    unstage(chosen)
    out, total, ones = np.zeros((1 << bits) + 1), sum(p["rows"] for p in parts), sum(p["ones"] for p in parts)
    if not 0 < ones < total:
        out[-1] = np.log((ones + 1) / (total - ones + 1))
        return out
    for p in parts:
        out[np.array(p["idx"], dtype=np.int64)] += np.array(p["w"]) * (p["rows"] / total)
    return out


def score(docs: DataFrame, weights: np.ndarray, orders: tuple[int, ...] = (1, 2), id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of label 1, for every row's whole text.

    A column of ``docs`` that is called like ``out`` is replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = (len(weights) - 1).bit_length() - 1
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**bits numbers: 1 MB at 18 bits

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, w = Features(bits, orders), shared.value
        bias = float(w[-1])
        for texts in batches:
            scores = np.empty(len(texts))
            for k, text in enumerate(texts):
                total, n = 0.0, 0
                for idx in features(text):
                    total += float(w[idx].sum(dtype=np.float64))
                    n += len(idx)
                scores[k] = bias + (_SCALE * total / n if n else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(scores, -30, 30))))

    return docs.withColumn(out, scored(text_or_empty(text_col)))
