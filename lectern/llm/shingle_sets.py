"""Classes of texts whose word shingles have a given Jaccard similarity: the exact form of the SimHash operator.

:func:`lectern.llm.simhash.near_duplicates` comes here when it is given a ``similarity``.  A radius of
SimHash bits is no filter for that: at similarity 0.8 fingerprints differ in about 10 of 64 bits and
often in 18, a distance at which unrelated ones are met by the thousand.  So fingerprints within the
radius give the first candidates, by the same tiles as ever, and the rest come from the sets:

1. A text becomes the set of the XXH64 values of its word shingles and a fingerprint; equal sets are
   reduced to one.
2. Sets with equal or linked fingerprints are compared; what is similar is joined.
3. Sets of similarity ``threshold`` or more share a value among the first ``n - ceil(threshold * n) + 1``
   of each, in any order that is the same for all (prefix filter), so sets meet in the values of their
   prefixes and no pair is missed.  The order has values that a sample finds common last; the sample
   sets the work, not the result.  Each set is compared with the least one that it meets.
4. Buckets that still hold sets of different components are compared: those of a few sets pair by
   pair, larger ones in tiles, as fingerprints are, where a task sees two tiles of bit maps, in which
   a set marks the classes of its values, and counts the bits that two share.  That bounds what the
   sets can share from above, so a pair whose bound is too low is not similar; the others are
   compared.  Some rounds compare a spanning forest of these pairs, over a part of the buckets each,
   which joins most of what is similar; then all pairs of what is still apart are compared.  A tile
   pair with more of those than rows allow gets the whole sets and returns a spanning forest of its
   links.  Of buckets with the same members one is compared, and sizes that can't be similar never meet.

Every link comes from the intersection of two whole sets.

Defined results: null text counts as empty; texts without words are alike; a text shorter than a
shingle is one shingle; repeated ids are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, in_pandas, staged, text_or_empty, unstage
from lectern.llm.simhash import components, links, of_hashes, shingle_hashes

#: the order of the values is sampled from one document in so many, from so many documents at least; the common values it keeps
_SHARE, _SAMPLE, _COMMON = 16, 4_000, 500_000
#: sets in a bucket whose pairs are few, sets in a tile, classes of values in a bit map, and pairs a row that a tile may hand on
_FEW, _TILE, _CLASSES, _HANDED = 16, 512, 4096, 8
#: rounds that compare a spanning forest of what bit maps leave open
_TURNS = 3
#: values of a sample that are counted at a time: 16 MB
_BLOCK = 2_000_000
#: keys that may be broadcast: 8 MB
_SENT = 1_000_000


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted different hashes of a text's shingles, as signed longs; never empty."""
    blocks = list(shingle_hashes(text, width, seed))
    return np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(1, np.int64)


def prefix(values: np.ndarray, threshold: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The part of a set that it shares with every similar one: rare values first."""
    often = np.zeros(len(values), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        often = np.where(common[at] == values, counts[at], 0)
    most = len(values) - ceil(threshold * len(values) - 1e-9) + 1
    return values[np.lexsort((values, often))[:most]]


def bit_map(values: np.ndarray, classes: int = _CLASSES) -> np.ndarray:
    """A bit for each class that some value is in."""
    marked = np.zeros(classes, np.uint8)
    marked[values.view(np.uint64) % np.uint64(classes)] = 1
    return np.packbits(marked)


def wide_map(values: np.ndarray) -> np.ndarray:
    """A bit map with eight classes or more for each value, as one of a fixed width rules nothing out for long sets."""
    return bit_map(values, max(_CLASSES, 1 << (8 * len(values) - 1).bit_length()))


def most_shared(a: bytes, b: bytes, n: int, m: int) -> int:
    """What sets of ``n`` and ``m`` values with these wide maps share at most; the wider map is folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    own, other = (n, m) if len(a) <= len(b) else (m, n)
    besides = min(own - int(np.bitwise_count(x).sum()), other - int(np.bitwise_count(y).sum()))
    return min(int(np.bitwise_count(x & y).sum()) + besides, n, m)


def candidates(keys: np.ndarray, roots: np.ndarray, sizes: np.ndarray, maps: np.ndarray, threshold: float, second: np.ndarray | None = None, seed: int | None = None) -> list[tuple[int, int]]:
    """Pairs of different roots (and sides) whose bit maps don't rule out that the sets are similar.

    What two sets share lies in classes that both mark, one value each, and of values that share a
    class within a set no more than the smaller number of them can count besides.  With a ``seed``
    only a random spanning forest of these pairs, which would do if all were similar.
    """
    order = np.argsort(sizes, kind="stable")
    keys, sizes, maps = keys[order], sizes[order], maps[order].view(np.uint64)
    group = np.unique(roots[order], return_inverse=True)[1]
    side = None if second is None else second[order]
    besides = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    rng = None if seed is None else np.random.default_rng(seed)
    out = []
    for k in range(len(keys) - 1) if rng is None else rng.permutation(len(keys) - 1).tolist():
        last = int(np.searchsorted(sizes, sizes[k] / threshold + 1e-9, side="right"))
        rest = slice(k + 1, last)
        if last <= k + 1:
            continue
        most = np.bitwise_count(maps[rest] & maps[k]).sum(axis=1, dtype=np.int64) + np.minimum(besides[rest], besides[k])
        may = similar(np.minimum(most, sizes[k]), sizes[k], sizes[rest], threshold) & (group[rest] != group[k])
        if side is not None:
            may &= side[rest] != side[k]
        hits = np.flatnonzero(may) + k + 1
        for j in (hits if rng is None else rng.permutation(hits)).tolist():
            if rng is None or group[j] != group[k]:
                out.append((int(keys[k]), int(keys[j])))
            if rng is not None:
                group[group == group[j]] = group[k]
    return out


def similar(both, n, m, threshold: float):
    """Whether sets of ``n`` and ``m`` values with ``both`` in common reach the threshold."""
    return both >= threshold * (n + m - both) - 1e-9


def _common_values(docs: DataFrame, text_col: str, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that several sampled texts have, sorted, with their counts.

    The sample grows with the table: with a sample of one size, values of some hundred documents would go unseen in a
    large table and stay in prefixes, and the buckets would grow with it.
    """
    share = min(1.0, max(1 / _SHARE, _SAMPLE / max(1, docs.count())))
    sample = docs.select(text_or_empty(text_col).alias("text")).filter(F.rand(seed) < share)

    def run(batches):
        values, n = (np.zeros(0, np.int64),) * 2
        sets, held = [], 0
        for pdf in batches:
            sets += [shingle_set(text, width, seed) for text in pdf["text"]]
            held += sum(map(len, sets[len(sets) - len(pdf) :]))
            if held > _BLOCK:
                yield pd.DataFrame(dict(zip(("value", "n"), np.unique(np.concatenate(sets), return_counts=True), strict=True)))
                sets, held = [], 0
        if sets:
            values, n = np.unique(np.concatenate(sets), return_counts=True)
        yield pd.DataFrame({"value": values, "n": n})

    counted = staged(in_pandas(sample, run, "value long, n long", ()).groupBy("value").agg(F.sum("n").alias("n")).filter("n > 1"), "common")
    least, kept = None, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("values")).orderBy(F.desc("n")).collect():
        kept += r["values"]
        if kept > _COMMON:
            break
        least = r["n"]
    rows = counted.filter(F.col("n") >= least).toArrow() if least is not None else None
    unstage(counted)
    if rows is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, n = rows["value"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


class _Sets:
    """The sets of all documents, by key: equal sets have one.

    ``rows`` (rid, doc_id, key, fp, n, prefix, text) and ``distinct`` (key, least, rid, n, fp) are staged.
    The values themselves, several times as long as the texts, are not: they are made again for the
    sets that are asked for, from the text of one row each.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, seed: int):
        self.width, self.seed = width, seed
        shared = docs.sparkSession.sparkContext.broadcast(_common_values(docs, text_col, width, seed))
        rows, kind = id_and_text(docs, id_col, text_col)

        def run(batches):
            common, counts = shared.value
            for pdf in batches:
                fps, keys, prefixes, n = [], [], [], []
                for text in pdf["text"]:
                    blocks = list(shingle_hashes(text, width, seed))
                    values = np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(1, np.int64)
                    fps.append(of_hashes(blocks))
                    keys.append(xxhash.xxh64_intdigest(values.tobytes(), seed))
                    prefixes.append(prefix(values, threshold, common, counts))
                    n.append(len(values))
                fps, keys = (np.array(x, dtype=np.uint64).view(np.int64) for x in (fps, keys))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": keys, "fp": fps, "n": n, "prefix": prefixes, "text": pdf["text"]})

        made = in_pandas(rows, run, f"doc_id {kind}, key long, fp long, n long, prefix array<long>, text string")
        self.rows = staged(made.withColumn("rid", F.monotonically_increasing_id()), "sets", codec="zstd")
        self.distinct = staged(self.rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("fp").alias("fp")), "distinct")

    def of(self, keys: DataFrame, made=None) -> DataFrame:
        """``(key, members)`` of the keys that are asked for, staged; ``made`` turns the values into other bytes.

        The rows of up to ``_SENT`` keys go to every executor (their number is counted first), so that
        only the texts asked for are moved; more are joined by a shuffle.
        """
        width, seed = self.width, self.seed
        wanted = staged(self.distinct.join(keys.distinct(), "key", "left_semi").select("key", "rid"), "keys")
        few = wanted.count() <= _SENT

        def run(batches):
            for pdf in batches:
                sets = (shingle_set(text, width, seed) for text in pdf["text"])
                yield pd.DataFrame({"key": pdf["key"], "members": [(made(x) if made else x).tobytes() for x in sets]})

        met = self.rows.select("rid", "text").join(F.broadcast(wanted) if few else wanted, "rid").select("key", "text")
        out = staged(in_pandas(met, run, "key long, members binary", ()), "members")
        unstage(wanted)
        return out

    def unstage(self) -> None:
        unstage(self.rows, self.distinct)


def _confirmed(pairs: DataFrame, sets: _Sets, threshold: float) -> DataFrame:
    """The ``pairs`` (u, v) whose whole sets are similar, as a staged table."""
    pairs = staged(pairs.distinct(), "pairs")
    whole = sets.of(pairs.select(F.explode(F.array("u", "v")).alias("key")))

    def run(batches):
        for pdf in batches:
            near = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                near.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)))
            yield pdf.loc[near, ["u", "v"]]

    met = pairs.join(whole.toDF("u", "a"), "u").join(whole.toDF("v", "b"), "v")
    out = staged(in_pandas(met.select("u", "v", "a", "b"), run, "u long, v long", ()), "similar")
    unstage(pairs, whole)
    return out


def _merged(rooted: DataFrame, found: DataFrame) -> DataFrame:
    """``rooted`` (key, root) once the links ``found`` (u, v) between keys count too; both are deleted."""
    u, v = rooted.select(F.col("key").alias("u"), F.col("root").alias("a")), rooted.select(F.col("key").alias("v"), F.col("root").alias("b"))
    moved = components(found.join(u, "u").join(v, "v").select(F.col("a").alias("u"), F.col("b").alias("v")))
    out = staged(rooted.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root")), "rooted")
    unstage(moved, rooted, found)
    return out


def forest(keys: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], threshold: float, second: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between similar sets of different roots (of different sides, if ``second`` marks one), as a spanning forest."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    keys, roots, sets = keys[order], roots[order], [sets[k] for k in order]
    side = None if second is None else second[order]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    _, group = np.unique(roots, return_inverse=True)
    out = []
    for k, own in enumerate(sets[:-1]):
        last = int(np.searchsorted(sizes, len(own) / threshold + 1e-9, side="right"))  # longer ones can't be similar
        if last <= k + 1 or (group[k + 1 : last] == group[k]).all():
            continue
        hits = np.concatenate(([0], np.cumsum(np.isin(values[ends[k] : ends[last - 1]], own))))
        both = np.diff(hits[ends[k:last] - ends[k]])
        near = similar(both, len(own), sizes[k + 1 : last], threshold)
        if side is not None:
            near &= side[k + 1 : last] != side[k]
        for j in (np.flatnonzero(near) + k + 1).tolist():
            if group[j] != group[k]:
                out.append((int(keys[k]), int(keys[j])))
                group[group == group[j]] = group[k]
    return out


def _not_ruled_out(pairs: DataFrame, sets: _Sets, threshold: float) -> DataFrame:
    """The ``pairs`` (u, nu, v, nv) whose bit maps leave it open that they are similar."""
    marks = sets.of(pairs.select(F.explode(F.array("u", "v")).alias("key")), wide_map)

    def run(batches):
        for pdf in batches:
            near = [bool(similar(most_shared(a, b, n, m), n, m, threshold)) for a, b, n, m in zip(pdf["a"], pdf["b"], pdf["nu"].tolist(), pdf["nv"].tolist(), strict=True)]
            yield pdf.loc[near, ["u", "v"]]

    met = pairs.join(marks.toDF("u", "a"), "u").join(marks.toDF("v", "b"), "v").select("u", "v", "nu", "nv", "a", "b")
    out = staged(in_pandas(met, run, "u long, v long", ()), "open")
    unstage(marks)
    return out


def _looked_through(pairs: DataFrame, sets: _Sets, threshold: float) -> DataFrame:
    """The ``pairs`` (u, v) whose whole sets are similar, where many are expected not to be: by wide bit maps first."""
    n = sets.distinct.select("key", "n")
    pairs = staged(pairs.distinct().join(n.toDF("u", "nu"), "u").join(n.toDF("v", "nv"), "v").select("u", "nu", "v", "nv"), "looked")
    light = _not_ruled_out(pairs, sets, threshold)
    out = _confirmed(light, sets, threshold)
    unstage(pairs, light)
    return out


def _mixed(placed: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``placed`` (value, key, …) in buckets that hold several roots, with the roots."""
    met = placed.join(rooted, "key")
    several = met.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return met.join(several.select("value"), "value", "left_semi")


def _dealt(rows: DataFrame, calls: int) -> DataFrame:
    """``rows`` in the tile pairs (value, i, j) that they are in, under the call that sees them.

    Many small buckets go to one call; a large bucket's tile pairs are calls of their own, as their hashes differ.
    """
    own = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("tiles")).cast("int"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "second": F.col("own") > F.col("other")}).drop("own", "other")
    share = F.pmod(F.xxhash64("value", "i", "j"), F.lit(max(16, calls)))
    return dealt.withColumn("share", F.when(F.col("tiles") > 1, F.xxhash64("value", "i", "j")).otherwise(share))


def _tiled(buckets: DataFrame, rooted: DataFrame, sets: _Sets, threshold: float) -> DataFrame:
    """``rooted`` with what is linked within the ``buckets`` (value, key)."""
    met = buckets.join(rooted, "key")
    sizes = met.groupBy("value").agg(F.count("*").alias("size"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = sizes.filter("low < high").groupBy("size", "who").agg(F.min("value").alias("value"))  # of buckets with the same members one
    sizes = staged(sizes.select("value", "size", F.ceil(F.col("size") / _TILE).cast("int").alias("tiles")), "mixed")
    placed = staged(buckets.join(sizes, "value").join(sets.distinct.select("key", "n"), "key"), "placed")
    unstage(sizes)

    # buckets of a few sets: their pairs by key alone, each once however many buckets it is in
    few = placed.filter(F.col("size") <= _FEW).join(rooted, "key")
    one, two = (few.select("value", F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("root").alias(f"r{k}")) for k in "uv")
    fits = F.least("nu", "nv") >= threshold * F.greatest("nu", "nv") - 1e-9
    pairs = staged(one.join(two, "value").filter((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & fits).select("u", "nu", "v", "nv").distinct(), "few")
    light = _not_ruled_out(pairs, sets, threshold)
    rooted = _merged(rooted, _confirmed(light, sets, threshold))
    unstage(pairs, light)

    # larger ones, in tiles: first what a spanning forest finds, a part of the buckets at a time
    many = placed.filter(F.col("size") > _FEW)
    if not many.limit(1).count():
        unstage(placed)
        return rooted
    marks = sets.of(many.select("key"), bit_map)
    bits = marks.toDF("key", "bits")
    calls = int(many.agg(F.sum(1 / F.col("size"))).first()[0]) // 16  # of 16 buckets

    def met_tiles(seed):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            """Pairs (u, v) to compare, or the tile pair (value, i, j) if there are too many."""
            out = []
            for (value, i, j), part in pdf.groupby(["value", "i", "j"]):
                maps = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)
                found = candidates(part["key"].to_numpy(), part["root"].to_numpy(), part["n"].to_numpy(), maps, threshold, part["second"].to_numpy(dtype=bool) if i != j else None, seed)
                heavy = seed is None and len(found) > _HANDED * len(part)
                out += [(0, 0, value, i, j)] if heavy else [(u, v, 0, -1, -1) for u, v in found]
            return pd.DataFrame(out, columns=["u", "v", "value", "i", "j"]).astype("int64")

        return run

    schema = "u long, v long, value long, i long, j long"
    for turn in range(_TURNS):
        part = _mixed(many.filter(F.pmod(F.xxhash64("value"), F.lit(_TURNS)) == turn), rooted)
        found = _dealt(part.join(bits, "key"), calls // _TURNS).groupBy("share").applyInPandas(met_tiles(turn), schema)
        rooted = _merged(rooted, _looked_through(found.select("u", "v"), sets, threshold))

    # then all that is left, in all of them
    dealt = _dealt(_mixed(many, rooted).join(bits, "key"), calls)
    found = staged(dealt.groupBy("share").applyInPandas(met_tiles(None), schema), "met")
    confirmed = _looked_through(found.filter("i < 0").select("u", "v"), sets, threshold)
    heavy = found.filter("i >= 0").select("value", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    if not heavy.limit(1).count():
        unstage(found, placed, marks)
        return _merged(rooted, confirmed)
    big = staged(dealt.select("value", "key", "root", "i", "j", "second").join(heavy, ["value", "i", "j"]), "heavy")
    whole = sets.of(big.select("key"))

    def whole_sets(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["second"].to_numpy(dtype=bool) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else None
        return pd.DataFrame(forest(pdf["key"].to_numpy(), pdf["root"].to_numpy(), [np.frombuffer(m, np.int64) for m in pdf["members"]], threshold, side), columns=["u", "v"], dtype="int64")

    linked = big.join(whole, "key").groupBy("value", "i", "j").applyInPandas(whole_sets, "u long, v long")
    out = staged(confirmed.unionByName(linked), "rest")
    unstage(found, placed, marks, big, whole, confirmed)
    return _merged(rooted, out)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, radius: int, seed: int) -> DataFrame:
    """``(doc_id, component_id)`` per document; ``component_id`` is the smallest doc_id reachable."""
    sets = _Sets(docs, id_col, text_col, width, threshold, seed)
    distinct = sets.distinct

    def fits(n, m):
        return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9

    # 2: by fingerprint
    heads = staged(distinct.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("head")), "heads")
    of_equal = distinct.join(heads, "fp").filter((F.col("key") != F.col("head.key")) & fits(F.col("n"), F.col("head.n"))).select(F.col("head.key").alias("u"), F.col("key").alias("v"))
    linked = links(heads.select("fp"), heads.count(), radius)
    a, b = heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), heads.select(F.col("fp").alias("v"), F.col("head").alias("b"))
    of_linked = linked.join(a, "u").join(b, "v").filter(fits(F.col("a.n"), F.col("b.n"))).select(F.col("a.key").alias("u"), F.col("b.key").alias("v"))
    rooted = staged(distinct.select("key", F.col("key").alias("root")), "rooted")
    rooted = _merged(rooted, _confirmed(of_equal.unionByName(of_linked), sets, threshold))
    unstage(heads)

    # 3: by the values of the prefixes, against the least set of a bucket
    met = sets.rows.select("key", F.explode("prefix").alias("value"))  # equal sets meet their like in every value
    shared = met.groupBy("value").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").select("value", "first")
    buckets = staged(met.join(shared, "value").select("value", "key", "first").distinct(), "buckets")
    stars = buckets.groupBy(F.col("key").alias("v")).agg(F.min("first").alias("u")).filter("u < v")
    sized = rooted.join(distinct.select("key", "n"), "key")
    one, two = sized.toDF("u", "a", "na"), sized.toDF("v", "b", "nb")
    stars = stars.join(one, "u").join(two, "v").filter((F.col("a") != F.col("b")) & fits(F.col("na"), F.col("nb")))
    stars = staged(stars.select("u", F.col("na").alias("nu"), "v", F.col("nb").alias("nv")), "stars")
    light = _not_ruled_out(stars, sets, threshold)
    rooted = _merged(rooted, _confirmed(light, sets, threshold))
    unstage(stars, light)

    # 4: what is left, in tiles
    rooted = _tiled(buckets.select("value", "key"), rooted, sets, threshold)
    unstage(buckets)

    named = distinct.join(rooted, "key").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(rooted.join(named, "root").select("key", "component_id"), "classes")
    out = staged(sets.rows.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id"), "classes")
    unstage(rooted, classes)
    sets.unstage()
    return out
