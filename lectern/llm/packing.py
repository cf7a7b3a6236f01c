"""Hierarchical multi-length packing of tokenised documents into training sequences.

Method.  A document's ids (with a closing separator) are routed by length: whole windows of the
longest context are cut off a long document at once, and what remains of it, like every shorter
document, goes to the tier of the smallest context it fits (``tiers``, for instance 128, 256, 512,
1024).  When enough pieces wait, each tier is packed into windows of its own size, the longest tier
first: a window starts with the longest piece of its tier and its gap is filled best-fit, which
takes pieces of shorter tiers; only what no waiting piece fits is closed by cutting one, whose rest
is routed anew.  So a short document trains in a short context, or fills a long one.  Windows are
full, and tiers that are powers of two need no padding; at the end of a partition the few ids that
are left fill sequences whose lengths are powers of two as well.  Windows of all sizes are dealt
into step groups of near-equal tokens and attention cost (sum of squared piece lengths).

Everything happens where a document is read: no shuffle, and a partition holds one batch, the
waiting pieces (at most ``waiting`` tokens and one document) and the open windows.  A sequence's id
joins the partition's number with a running count, so a partition that is run again after a lost
executor gives the same rows, given the same input rows in the same order (a scan keeps it).

Defined results: null text counts as empty and becomes the separator alone; repeated doc_ids are
packed as often as they occur; ties keep input order; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lectern.llm.common import in_pandas, text_or_empty

#: Characters on whose classes the two libraries' pattern engines surely agree.
_COMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20c0]")
#: Where a run of white space goes on across a space: cutting the text at its spaces would cut a pretoken.
_RUN = re.compile(r"  |\s \s")
#: chunks whose ids a worker remembers
_REMEMBERED = 1_000_000


class ByteTokens:
    """Ids of texts under a byte-level vocabulary of the ``tokenizers`` library, as packed unsigned 32-bit integers.

    A pretoken of this vocabulary takes a space only as its first character, so texts cut before
    each space can be encoded chunk by chunk: Arrow numbers the distinct chunks of a batch, each is
    encoded once, and numpy lays their ids out in the order of the texts.  Chunks of common
    characters go to ``tiktoken`` with ranks made from the same file, whose ids are the same and
    which is four times as fast; all others, and texts with :data:`_RUN`, go to ``tokenizers`` whole.
    """

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        special = set(self.tok.get_added_tokens_decoder())
        ranks = {bytes(shown[c] for c in piece): i for piece, i in vocab.items() if i not in special}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = _Chunks(self, own._core_bpe)

    def encode(self, text: str) -> bytes:
        """By the ``tokenizers`` library alone."""
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [self.encode(t) if _runs(t) else b"" for t in texts]
        plain = [i for i, t in enumerate(texts) if t and not out[i]]
        if not plain:
            return out
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        ids = list(map(self.known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), np.uint32)
        each = sizes[which]
        each[ends[:-1]] = 0  # the first chunk of a text has no space before it
        after = np.cumsum(each)
        stream = flat[np.repeat(starts[which] - after + each, each) + np.arange(after[-1])].tobytes()
        bounds = np.concatenate(([0], after))[ends].tolist()
        for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
            out[i] = self.encode(texts[i].split(" ", 1)[0]) + stream[4 * a : 4 * b]
        return out


def _runs(text: str) -> bool:
    return "  " in text or ("\n " in text or " \n" in text or not text.isascii() or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text) and _RUN.search(text) is not None


class _Chunks(dict):
    """The ids of a chunk, which stands after a space, made when they are first asked for."""

    def __init__(self, tokens: ByteTokens, core):
        self.encode, self.core = tokens.encode, core
        self.marks = {m: tokens.encode(m) for m in ",."}

    def __missing__(self, chunk: str) -> bytes:
        common = chunk.isascii() or not _COMMON.search(chunk)
        if common and chunk.isalpha():
            ids = array("I", self.core.encode_single_piece((" " + chunk).encode())).tobytes()
        elif common and chunk[-1:] in self.marks and (stem := chunk[:-1]).isalpha():  # a mark after letters is a pretoken
            ids = self[stem] + self.marks[chunk[-1]]
        elif not common:
            ids = self.encode(" " + chunk)
        else:
            ids = array("I", self.core.encode_ordinary(" " + chunk)).tobytes()
        self[chunk] = ids
        return ids


def vocabulary(name: str = "byte_bpe_50k.json", path: str | None = None) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    """A maker of the tokenizer, called once in each worker; ``path`` overrides where the file lies."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        return ByteTokens(path or public_tokenizers.path(name), public_tokenizers.PATTERN)

    return make


class Packer:
    """Packs pieces of one partition.  A piece is (doc, start, ids, tokens of the document, tier it was routed to).

    ``add`` and ``end`` yield windows as (size, pieces); all windows but the last few have the size of a tier.
    """

    def __init__(self, tiers: tuple[int, ...] = (128, 256, 512, 1024), waiting: int = 1 << 20):
        self.tiers, self.longest, self.waiting = tuple(sorted(set(tiers))), max(tiers), waiting
        self.pools: dict[int, deque] = {}  # by exact length, first come first served
        self.lengths: list[int] = []  # of the pools, ascending: a tier is a run of this list
        self.held = 0

    def tier(self, n: int) -> int:
        """The smallest context that holds ``n`` tokens."""
        return self.tiers[min(bisect_left(self.tiers, n), len(self.tiers) - 1)]

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list]]:
        n, w = len(ids) // 4, self.longest
        whole = n - n % w
        for k in range(0, whole, w):
            yield w, [(doc, k, ids[4 * k : 4 * (k + w)], n, w)]
        if n > whole:
            self._route((doc, whole, ids[4 * whole :], n))
        if self.held >= self.waiting:
            yield from self.drain(0.75)

    def _route(self, piece: tuple) -> None:
        """Puts (doc, start, ids, tokens) in the pool of its length; its tier is the one it fits."""
        n = len(piece[2]) // 4
        pool = self.pools.get(n)
        if pool is None:
            pool = self.pools[n] = deque()
            insort(self.lengths, n)
        pool.append((*piece, self.tier(n)))
        self.held += n

    def _take(self, n: int) -> tuple:
        pool = self.pools[n]
        piece = pool.popleft()
        if not pool:
            del self.pools[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.held -= n
        return piece

    def _window(self, size: int) -> list:
        """A full window of ``size``: the longest piece of its tier, then what fits best from there down,
        which comes from shorter tiers; what no piece fits is closed by a cut of the shortest one."""
        window, gap = [], size
        while gap:
            k = bisect_right(self.lengths, gap)
            if k:
                piece = self._take(self.lengths[k - 1])
                gap -= len(piece[2]) // 4
            else:
                doc, start, ids, total, tier = self._take(self.lengths[0])
                piece = (doc, start, ids[: 4 * gap], total, tier)
                self._route((doc, start + gap, ids[4 * gap :], total))
                gap = 0
            window.append(piece)
        return window

    def drain(self, share: float = 1.0) -> Iterator[tuple[int, list]]:
        """Packs ``share`` of what waits in each tier, from the longest down: long windows take their
        gaps' worth from the shorter tiers first, then those fill windows of their own."""
        for low, size in reversed(list(zip((0, *self.tiers), self.tiers, strict=False))):
            waiting = sum(len(self.pools[n]) for n in self.lengths if low < n <= size)
            least = (1 - share) * waiting
            while self.held >= size and (share == 1 or waiting > least):
                k = bisect_right(self.lengths, size)
                if not k or self.lengths[k - 1] <= low:
                    break
                window = self._window(size)
                waiting -= sum(p[4] == size for p in window)
                yield size, window

    def end(self) -> Iterator[tuple[int, list]]:
        """What is left: windows of the tiers while there are ids for them, then sequences whose lengths are powers of two."""
        yield from self.drain()
        rest = deque(self._take(n) for n in self.lengths[::-1] for _ in range(len(self.pools[n])))
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = gap = min(1 << (left.bit_length() - 1), self.longest)
            window = []
            while gap:
                doc, start, ids, total, tier = rest.popleft()
                n = min(gap, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total, tier))
                if 4 * n < len(ids):
                    rest.appendleft((doc, start + n, ids[4 * n :], total, tier))
                gap -= n
            left -= size
            yield size, window


def step_groups(windows: list[tuple[int, list]], tokens: int) -> list[int]:
    """A group number per window, for groups of about ``tokens``: windows of all sizes are dealt out, longest and
    costliest first, each to the group with the fewest tokens and of those the least attention cost (sum of
    squared piece lengths), so that steps weigh alike whatever contexts they mix."""
    cost = [sum((len(p[2]) // 4) ** 2 for p in pieces) for _, pieces in windows]
    n = max(1, round(sum(size for size, _ in windows) / tokens))
    heap = [(0, 0, g) for g in range(n)]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][0], -cost[k])):
        used, paid, g = heap[0]
        heapreplace(heap, (used + windows[k][0], paid + cost[k], g))
        out[k] = g
    return out


def _encoded(pdf: pd.DataFrame, tokens, chars: int = 1 << 23):
    """(doc_id, ids), encoded some million characters at a time."""
    docs, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= chars or k + 1 == len(texts):
            yield from zip(docs[first : k + 1], tokens(texts[first : k + 1]), strict=True)
            first, size = k + 1, 0


#: Tokens of windows that are dealt into step groups together.
_DEALT = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier long, step_group long"


def pack(
    docs: DataFrame,
    make_tokens: Callable[[], Callable[[list[str]], list[bytes]]] | None = None,
    separator: int = 0,
    tiers: tuple[int, ...] = (128, 256, 512, 1024),
    group: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where its ids come from (``doc_id, start, length``), the ids as packed
    little-endian unsigned 32-bit integers, and where they go (``sequence_id, offset``).

    ``tier`` is the context that the piece was routed to by its length, ``sequence_tokens`` the size of the
    window it went to (larger where it fills a gap), ``step_group`` the sequences that train in one
    step: some ``group`` times the longest context in tokens.
    """
    make = make_tokens or vocabulary()
    close = array("I", [separator]).tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        tokens, packer = make(), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        count, held, size_held = 0, [], 0

        def rows():
            nonlocal count, held, size_held
            out = []
            for (size, pieces), g in zip(held, step_groups(held, group * packer.longest), strict=True):
                at = 0
                for doc, start, ids, total, tier in pieces:
                    n = len(ids) // 4
                    out.append((doc, start, n, ids, total, base + count, at, size, tier, g))
                    at += n
                count += 1
            first = base + count - len(held)  # a group's number is that of the first sequence it could have
            held, size_held = [], 0
            return pd.DataFrame(out, columns=names).assign(step_group=lambda p: p["step_group"] + first)

        for pdf in batches:
            for doc, ids in _encoded(pdf, tokens):
                for window in packer.add(doc, ids + close):
                    held.append(window)
                    size_held += window[0]
                    if size_held >= _DEALT:
                        yield rows()
        for window in packer.end():
            held.append(window)
            size_held += window[0]
            if size_held >= _DEALT:
                yield rows()
        if held:
            yield rows()

    return in_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, SCHEMA)
