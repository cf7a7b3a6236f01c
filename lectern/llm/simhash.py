"""SimHash near-duplicate classes by exact, tiled comparison of fingerprints.

Method.  A document's fingerprint takes one bit per position from the XXH64 values of its word
shingles.  Equal fingerprints are first reduced to one row.  Two fingerprints within ``radius`` bits
agree on at least ``keep = bands - radius`` of ``bands`` disjoint bit bands, so rows meet in the
combinations of bands they agree on (exact, nothing is missed).  Inside such a bucket tiles of
fingerprints, sorted by population count, are compared with numpy exclusive-or and bit counts;
a tile pair whose population counts differ by more than the radius is skipped, because
``|popcount(a) - popcount(b)| <= hamming(a, b)``.  A bucket larger than one tile is divided into
salted tiles that are paired across tasks, so no task ever sees an unbounded group.  A tile pair
returns a spanning forest of its links only: no link between different texts is lost for the
components and at most one row per fingerprint leaves it.

Components come from alternating large-star and small-star rounds over the links, each round
written to the shared folder.

Defined results: null text counts as empty; a text without words has fingerprint zero and links
like any other; repeated doc_ids are one node; a null doc_id never wins as representative but gets
its class; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, in_pandas, staged, unstage

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: shingles hashed at a time, which bounds the memory that a very long text takes
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42):
    """The hashes of a text's ``width``-word shingles, block by block; a shorter text is one shingle."""
    # bytes.split() parts words at the space and at x09 to x0D, which is the rule wanted
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    flat = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(flat, seed)], dtype="<u8")
        return
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(flat)]))[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(ends), _BLOCK):
        yield np.array([digest(flat[a:b], seed) for a, b in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=False)], dtype="<u8")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: ``width``-word shingles, a bit where over half the hashes have it."""
    return of_hashes(shingle_hashes(text, width, seed))


def of_hashes(blocks) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long with the same 64 bits."""

    def run(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t, width, seed) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    rows, kind = id_and_text(docs, id_col, text_col)
    return in_pandas(rows, run, f"doc_id {kind}, fp long")


def _bands(bits: int, bands: int) -> list[tuple[int, int]]:
    cuts = [round(i * bits / bands) for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, tile: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``a`` (or between ``a`` and ``b``), tile by tile."""
    nodes = a if b is None else np.concatenate((a, b))
    nodes = np.unique(nodes)
    parent = np.arange(len(nodes))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = np.unique(a)
    right = left if b is None else np.unique(b)
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = right[np.argsort(np.bitwise_count(right), kind="stable")]
    lows = [(right[j : j + tile], int(np.bitwise_count(right[j])), int(np.bitwise_count(right[min(j + tile, len(right)) - 1]))) for j in range(0, len(right), tile)]
    out: list[tuple[int, int]] = []
    for i in range(0, len(left), tile):
        x = left[i : i + tile]
        low, high = int(np.bitwise_count(x[0])), int(np.bitwise_count(x[-1]))
        for j, (y, ylow, yhigh) in enumerate(lows):
            if (b is None and j * tile < i) or ylow - high > radius or low - yhigh > radius:
                continue
            for r in range(0, len(x), 128):
                near = np.bitwise_count(x[r : r + 128, None] ^ y[None, :]) <= radius
                p, q = np.nonzero(near)
                u, v = np.searchsorted(nodes, x[r : r + 128][p]), np.searchsorted(nodes, y[q])
                for m, n in zip(u.tolist(), v.tolist(), strict=False):
                    if m != n and (s := find(m)) != (t := find(n)):
                        parent[max(s, t)] = min(s, t)
                        out.append((int(nodes[m]), int(nodes[n])))
    return out


def links(distinct: DataFrame, n: int, radius: int = 4, bands: int | None = None, tile: int = 4096) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints (column ``fp``) that keep every component whole.

    ``n`` is their number; it only sets how many bands a key joins, so that a bucket of unrelated
    fingerprints stays near one tile at any size (one of 5 bands is 13 bits wide, two of 6 are 21,
    three of 7 are 27, four of 8 are 32).  The links are exact for every choice.
    """
    if bands is None:
        bands = next((b for b in range(radius + 1, radius + 4) if n <= tile * 2 ** (64 * (b - radius) // b)), radius + 4)
    parts = _bands(64, bands)
    cut = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in parts]
    # Two keys with one hash only share a bucket; the comparison is exact all the same.
    keys = [F.xxhash64(F.lit(k), *(cut[i] for i in chosen)) for k, chosen in enumerate(combinations(range(bands), bands - radius))]
    bucketed = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    placed = bucketed.join(sizes.withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).drop("size"), "bucket")

    # Buckets of one tile: a share of them goes to one Python call; its rows are few at any input size.
    shares = max(16, n * len(keys) // (8 * tile))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["bucket"].to_numpy(), kind="stable")
        fps, buckets = pdf["fp"].to_numpy()[order].view(np.uint64), pdf["bucket"].to_numpy()[order]
        return _pairs([x for part in np.split(fps, np.flatnonzero(np.diff(buckets)) + 1) for x in _few(part, radius)])

    near = placed.filter("tiles = 1").groupBy(F.pmod("bucket", F.lit(shares)).alias("share")).applyInPandas(within, _LINKS)

    # Larger ones: a row's own tile meets every tile of its bucket once, each pair of tiles in a task of its own.
    salted = placed.filter("tiles > 1").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int"))
    met = salted.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.select("fp", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, second = pdf["fp"].to_numpy().view(np.uint64), pdf["second"].to_numpy(dtype=bool)
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            return _pairs(tile_links(fps, None, radius))
        return _pairs(tile_links(fps[~second], fps[second], radius) if second.any() and not second.all() else [])

    return near.unionByName(met.groupBy("bucket", "i", "j").applyInPandas(between, _LINKS)).distinct()


_LINKS = "u long, v long"


def _pairs(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])


def _few(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    if len(fps) > 24:
        return tile_links(fps, None, radius)
    p, q = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
    return list(zip(fps[p].tolist(), fps[q].tolist(), strict=False))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (u, v): the root is the smallest node of its component.

    Alternates large-star and small-star until nothing changes; the rounds needed grow with the
    logarithm of the longest chain.  A round is written to the shared folder and the one before it
    is deleted; :func:`unstage` deletes the last, once the result has been used.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before, stable = None, False
    while not stable:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        after = staged(small.filter("u <> v").distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now, stable, before = after, mark == before, mark
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._staged_at = now._staged_at
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)`` per document; ``component_id`` is the smallest doc_id reachable.

    With a ``similarity`` two documents are linked if the Jaccard similarity of their whole shingle
    sets reaches it, whatever their fingerprints; the result is then ``(doc_id, component_id)``.
    """
    if similarity is not None:
        from lectern.llm import shingle_sets  # which builds on this module

        return shingle_sets.near_duplicates(docs, id_col, text_col, similarity, width, radius, seed)
    fps = staged(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), distinct.count(), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    unstage(distinct, roots)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
