"""Approximate nearest neighbours by an inverted multi-index, reranked with exact cosines.

Method.  Normalised vectors are cut into two halves; each half is quantised against its own
codebook, and a pair of centroid numbers is a cell.  A query walks the cells in order of the summed
distance of its halves to the two centroids, with a heap, until the cells hold enough vectors; all
vectors of those cells are reranked by cosine in double precision on the original components.

Codebooks are trained on at most ``max_sample`` vectors (a documented bound; every vector is
indexed).  How large a share of the index a query visits is calibrated on that same sample: the
smallest of ``shares`` whose recall against brute force there reaches ``target``.  Clustered
vectors need a few hundredths, vectors without any structure a third or more.

Equal vectors are one index entry with the ``k + 1`` smallest ids: no more can ever be returned for
one query, so this is exact and a vector that a third of all rows repeat costs one entry.  Runs of
neighbouring cells make the deals of the index, bounded in vectors and in the work that the sample
foresees; a larger cell is divided.  A deal's vectors reach its task once and the queries that visit it stream
past them, each with the distance its walk reached instead of a list of cells, and leave ``k + 1``
entries.  With n vectors of d components, q queries and v deals that a query visits on average,
n * d + q * v * (d + k) numbers are shuffled; v is the visited share of the index at least, which
clustered vectors keep small.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null
or non-finite components take no part; ties go to the smaller id; of rows with one id the least
vector counts, once, as candidate and as query; fewer candidates than ``k`` are all returned; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import staged, unstage
from lectern.session import ship

#: bytes that the vectors of one deal take as doubles (what a task holds of the index), and the least number of them
_BLOCK_BYTES, _BLOCK_LEAST = 32 << 20, 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of the rows that take part."""
    exact = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as such
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(exact).alias("vec")).filter("vec_id IS NOT NULL AND size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (most["d"] if most else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first to a scale that squares can't leave
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def _codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centres = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class MultiIndex:
    """Two codebooks, the number of vectors in each cell, and the share of the index that a query visits."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.first, self.second = _codebook(sample[:, : self.half], k), _codebook(sample[:, self.half :], k)
        self.k = len(self.second)
        self.counts = np.zeros(len(self.first) * self.k, np.int64)
        self.share = 1.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the first and of the second halves to their centroids."""
        return _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.halves(x)
        return one.argmin(1) * self.k + two.argmin(1)

    def visit(self, q: np.ndarray, wanted: float) -> tuple[list[int], float]:
        """Non-empty cells by summed distance until they hold ``wanted`` vectors (the multi-sequence walk), and
        the summed distance within which they lie."""
        a, b = (d[0] for d in self.halves(q[None]))
        i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, i_of, j_of = a[i_of].tolist(), b[j_of].tolist(), i_of.tolist(), j_of.tolist()
        heap, seen, out, held, counts, reach = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0, self.counts, 0.0
        while heap and held < wanted:
            reach, i, j = heapq.heappop(heap)
            cell = i_of[i] * self.k + j_of[j]
            if n := int(counts[cell]):
                out.append(cell)
                held += n
            for u, v in ((i + 1, j), (i, j + 1)):
                if u < len(a) and v < len(b) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (a[u] + b[v], u, v))
        return out, reach + 1e-9  # so that rounding elsewhere leaves no cell out

    def deal(self, wanted: float, sample: np.ndarray, block: int, probes: int = 256) -> None:
        """Numbers the deals: runs of neighbouring cells with at most ``block`` vectors, and no more than twice the mean
        work, as far as ``probes`` of the sample show which cells queries visit.  A cell that exceeds that alone is
        spread over ``parts`` deals of its own."""
        seen = np.zeros(len(self.counts))
        asked = sample[:: max(1, len(sample) // probes)][:probes]
        for q in asked:
            seen[self.visit(q, wanted)[0]] += 1 / len(asked)
        work = self.counts * np.maximum(seen, 0.5 / len(asked))
        most = max(2 * work.sum() / max(1, -(-int(self.counts.sum()) // block)), 1e-9)
        # centroids along their main direction, so that cells of one run are near each other
        order = np.lexsort((self._rank(self.second)[np.arange(len(self.counts)) % self.k], self._rank(self.first)[np.arange(len(self.counts)) // self.k]))
        self.first_deal, self.parts, self.deals = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64), 0
        held = paid = 0.0
        for c in order[self.counts[order] > 0].tolist():
            n, w = int(self.counts[c]), float(work[c])
            if held and (held + n > block or paid + w > most):
                self.deals, held, paid = self.deals + 1, 0.0, 0.0
            self.first_deal[c] = self.deals
            self.parts[c] = max(1, -(-n // block), int(-(-w // most)))
            if self.parts[c] > 1:
                self.deals += int(self.parts[c])
            else:
                held, paid = held + n, paid + w
        self.deals += held > 0

    @staticmethod
    def _rank(centres: np.ndarray) -> np.ndarray:
        spread = centres - centres.mean(0)
        return np.argsort(np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable"), kind="stable")

    def calibrate(self, sample: np.ndarray, k: int, target: float, shares, queries: int = 256) -> None:
        cell = self.cells(sample)
        counts, self.counts = self.counts, np.bincount(cell, minlength=len(self.counts))
        probes = sample[:: max(1, len(sample) // queries)][:queries]
        best = np.argsort(-(probes @ sample.T), axis=1, kind="stable")[:, : k + 1]
        for share in shares:
            self.share = share
            hit = sum(np.isin(cell[row], self.visit(q, share * len(sample))[0]).sum() for q, row in zip(probes, best, strict=True))
            if hit >= target * best.size:
                break
        self.counts = counts


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each summed in one fixed order whatever block it stands in."""
    return np.array([float((v * q).sum()) / (float(np.sqrt((v * v).sum())) * float(np.sqrt((q * q).sum()))) for v in vectors])


def _top(least: np.ndarray, raw: np.ndarray, scores: np.ndarray, q: np.ndarray, k: int):
    """Of rows with approximate ``scores``, the k nearest by exact score, then smaller id."""
    near = np.flatnonzero(scores > -2)
    if len(near) > 4 * k:
        bound = np.partition(scores[near], len(near) - k)[len(near) - k]
        near = near[scores[near] >= bound - 1e-9]  # rounding can't hide a nearer one
    s = exact(raw[near].astype(float), q)
    order = np.lexsort((least[near], -s))[:k]
    return near[order], s[order]


def _few_ids(vectors: DataFrame, k: int) -> DataFrame:
    """``(vec, ids)``: each different vector once, with its ``k + 1`` smallest ids."""
    alone = vectors.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    first = Window.partitionBy("vec").orderBy("vec_id")
    return alone.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, max_sample: int = 16_384, target: float = 0.96, shares=(0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: both sides have (vec_id, vec) as :func:`usable` gives them."""
    spark = vectors.sparkSession
    ship(spark)
    entries = staged(_few_ids(vectors, k), "entries")
    asked = staged(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "asked")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = min(1.0, max_sample / n)
    picked = entries.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy(F.xxhash64("vec"), "ids").limit(max_sample)
    sample = _unit(np.array([r["vec"] for r in picked.select("vec").collect()] or [entries.first()["vec"]], dtype=float))  # max_sample rows at most
    # about 64 vectors a cell, and 2 ** 16 cells at most, so that the counts stay small
    size = int(min(256, max(2, 2 ** round(np.log2(max(1, n / 64)) / 2))))
    index = MultiIndex(sample, size)
    index.calibrate(sample, k, target, shares)
    coarse = spark.sparkContext.broadcast(index)
    kind = entries.schema["vec"].dataType.simpleString()

    def place(batches):
        own = coarse.value
        for pdf in batches:
            cells = own.cells(_unit(np.array(pdf["vec"].tolist(), dtype=float))) if len(pdf) else np.zeros(0)
            yield pdf.assign(cell=cells.astype(np.int32))

    placed = staged(entries.mapInPandas(place, f"vec {kind}, ids array<long>, cell int"), "cells")
    unstage(entries)
    for r in placed.groupBy("cell").count().collect():  # as many rows as cells
        index.counts[r["cell"]] = r["count"]
    wanted = max(index.share * n, 40.0 * (k + 1))  # a small index is searched whole
    several = -(-n // (2 * spark.sparkContext.defaultParallelism))  # a small index still occupies every core
    index.deal(wanted, sample, max(1, min(_BLOCK_BYTES // (8 * sample.shape[1]), max(_BLOCK_LEAST, several))))
    full = spark.sparkContext.broadcast(index)

    def deal_entries(batches):
        own = full.value
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            spread = np.array([i[0] for i in pdf["ids"]], np.int64) if len(pdf) else np.zeros(0, np.int64)
            yield pd.DataFrame({"deal": own.first_deal[cell] + np.abs(spread) % own.parts[cell], "kind": np.zeros(len(pdf), np.int32), "ids": pdf["ids"], "vec": pdf["vec"], "reach": 0.0, "cell": cell})

    def deal_queries(batches):
        own = full.value
        for pdf in batches:
            out = []
            for qid, vec in zip(pdf["query_id"], pdf["vec"], strict=True):
                cells, reach = own.visit(_unit(np.asarray(vec, float)[None])[0], wanted)
                first, parts = own.first_deal[cells], own.parts[cells]
                spread = [np.arange(d, d + p) for d, p in zip(first[parts > 1], parts[parts > 1], strict=True)]
                out += [(d, 1, [qid], vec, reach, -1) for d in np.unique(np.concatenate([first[parts == 1], *spread])).tolist()]
            yield pd.DataFrame(out, columns=["deal", "kind", "ids", "vec", "reach", "cell"])

    both = f"deal long, kind int, ids array<long>, vec {kind}, reach double, cell int"
    dealt = placed.mapInPandas(deal_entries, both).unionByName(asked.mapInPandas(deal_queries, both))
    # A deal's block of the index comes before the queries that visit it, which then stream through.
    dealt = dealt.repartition(max(1, index.deals), "deal").sortWithinPartitions("deal", "kind")

    def rerank(batches):
        block = None
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            edges = np.flatnonzero(np.diff(pdf["deal"].to_numpy()) | np.diff(pdf["kind"].to_numpy())) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pdf)], strict=True):
                rows = pdf.iloc[a:b]
                if not len(rows):
                    continue
                deal = int(rows["deal"].iloc[0])
                if block is None or block.deal != deal:
                    block = _Block(deal, full.value)
                if rows["kind"].iloc[0] == 0:
                    block.add(rows)
                else:
                    yield block.answer(rows, k)

    found = dealt.mapInPandas(rerank, "query_id long, ids array<long>, score double")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """One deal's part of the index, and the answers to queries that visit it."""

    def __init__(self, deal: int, index: MultiIndex):
        self.deal, self.index, self.parts, self.ready = deal, index, [], False

    def add(self, rows: pd.DataFrame) -> None:
        self.parts.append((rows["ids"].tolist(), np.array(rows["vec"].tolist()), rows["cell"].to_numpy()))

    def _close(self) -> None:
        self.ids = [i for part in self.parts for i in part[0]]
        self.raw = np.concatenate([part[1] for part in self.parts]) if self.parts else np.zeros((0, 1))
        self.cell = np.concatenate([part[2] for part in self.parts]).astype(np.int64) if self.parts else np.zeros(0, np.int64)
        self.least = np.array([i[0] for i in self.ids], np.int64)
        self.units = _unit(self.raw.astype(float)) if len(self.ids) else self.raw
        self.parts, self.ready = [], True

    def answer(self, rows: pd.DataFrame, k: int) -> pd.DataFrame:
        if not self.ready:
            self._close()
        out = []
        for first in range(0, len(rows) if len(self.ids) else 0, 64):
            part = rows.iloc[first : first + 64]
            q = np.array(part["vec"].tolist(), dtype=float)
            units = _unit(q)
            scores = units @ self.units.T
            one, two = self.index.halves(units)
            for i, (qid, reach) in enumerate(zip(part["ids"], part["reach"], strict=True)):
                near = one[i][self.cell // self.index.k] + two[i][self.cell % self.index.k] <= reach
                top, sure = _top(self.least, self.raw, np.where(near, scores[i], -9.0), q[i], k + 1)
                out += [(int(qid[0]), self.ids[t], float(x)) for t, x in zip(top.tolist(), sure, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "ids", "score"])
