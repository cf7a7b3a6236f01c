"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Method.  The pieces' UTF-8 bytes lie in a double-array trie (two integer arrays).  White space
becomes the marker U+2581 and a text starts with one; as no piece has a marker after another
character, the best segmentation of a text is that of its segments (markers, then other
characters).  The distinct segments of a batch are segmented together: numpy walks the trie from
each byte position for all of them at once and keeps the best score and its piece per end position.
A character that is no piece of its own may be taken as its bytes, at the score the library gives
unknown characters (the least score less 10).  Decoding joins the pieces, bytes and markers back.

A unigram model's scores are taken as they are.  A merge model has ranks instead of log
probabilities; its pieces get Zipf's law, ``-log(rank + 1) - log(H)``, a fixed rule, not a training.

Defined results: null counts as empty, an empty text has no ids; of segmentations with equal scores
the one whose last piece starts first wins; texts without any white space are one
long segment, walked position by position; a U+2581 in a text comes back as a space, as in the library; repeated rows are
encoded alike and extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_pandas, text_or_empty

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: segments up to this many bytes go through the batch walk, longer ones through the plain one
_LONG = 64
_REMEMBERED = 400_000


class DoubleArray:
    """``next = base[state] + byte + 1`` is a child of ``state`` where ``check[next] == state``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        value[0], place, floor, todo = ends[0], {0: 0}, 1, [0]
        for node in todo:
            kids = children[node]
            if not kids:
                continue
            codes = sorted(kids)
            first, full = codes[0] + 1, 0
            start = pos = max(floor, first + 1)
            while taken[pos] or any(taken[pos - first + c + 1] for c in codes):
                full += taken[pos]
                pos += 1
            if full >= 0.9 * (pos - start + 1):  # the front is all but full: look no more there
                floor = pos
            at, s = pos - first, place[node]
            base[s] = at
            for c in codes:
                t = at + c + 1
                taken[t], check[t], value[t], place[kids[c]] = 1, s, ends[kids[c]], t
                todo.append(kids[c])
        last = max(place.values()) + 258
        self.base, self.check, self.value = base[:last], check[:last], value[:last]


class Pieces:
    """Pieces with log scores, from a model file of the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes_id = [0] * 256
        for i in range(n):
            if model.is_byte(i):
                self.bytes_id[int(names[i][1:-1], 16)] = i
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.full(n, -np.inf)
        if any(model.get_score(i) > 0 or model.get_score(i) != round(model.get_score(i)) for i in plain):
            scores[plain] = [model.get_score(i) for i in plain]
        else:
            order = sorted(plain, key=lambda i: (-model.get_score(i), i))
            norm = math.log(sum(1 / (k + 1) for k in range(len(order))))
            scores[order] = [-math.log(k + 1) - norm for k in range(len(order))]
        self.scores, self.unknown = scores, float(scores[plain].min()) - 10
        self.trie = DoubleArray({names[i].encode(): i for i in plain})
        self.shown = [b""] * n
        for i in plain:
            self.shown[i] = names[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes_id):
            self.shown[i] = bytes((b,))


class Unigram:
    def __init__(self, pieces: Pieces):
        self.p, self.known = pieces, {}

    def _walk(self, words: list[bytes]) -> list[list[int]]:
        """Best ids of each word (all at most :data:`_LONG` bytes), walked together."""
        p, n = self.p, len(words)
        base, check, value = p.trie.base, p.trie.check, p.trie.value
        size = np.fromiter(map(len, words), np.int64, n)
        longest = int(size.max())
        flat = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(n, longest).astype(np.int32)
        best = np.full((n, longest + 1), -np.inf)
        start, piece = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        best[:, 0] = 0
        width = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
        for i in range(longest):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (size > i))
            if not len(rows):
                continue
            one = i + width[rows, i]
            alone = np.zeros(n, bool)
            act, state = rows, np.zeros(len(rows), np.int32)
            for j in range(i, longest):
                to = base[state] + flat[act, j] + 1
                ok = (check[to] == state) & (size[act] > j)
                act, state = act[ok], to[ok]
                if not len(act):
                    break
                ids = value[state]
                is_piece = ids >= 0
                at, ids = act[is_piece], ids[is_piece]
                alone[at[j + 1 == i + width[at, i]]] = True
                score = best[at, i] + p.scores[ids]
                up = score > best[at, j + 1]
                at = at[up]
                best[at, j + 1], start[at, j + 1], piece[at, j + 1] = score[up], i, ids[up]
            lone = ~alone[rows]
            at, end = rows[lone], np.minimum(one[lone], size[rows[lone]])
            score = best[at, i] + p.unknown
            up = score > best[at, end]
            at, end = at[up], end[up]
            best[at, end], start[at, end], piece[at, end] = score[up], i, -1
        out = []
        for k, (w, m) in enumerate(zip(words, size.tolist(), strict=True)):
            ids: list[int] = []
            s, q = start[k], piece[k]
            while m > 0:
                i = int(s[m])
                ids += [int(q[m])] if q[m] >= 0 else [p.bytes_id[b] for b in reversed(w[i:m])]
                m = i
            out.append(ids[::-1])
        return out

    def _long(self, word: bytes) -> list[int]:
        """A long segment, position by position."""
        p = self.p
        base, check, value, scores = p.trie.base, p.trie.check, p.trie.value, p.scores
        n = len(word)
        best, start, piece = [-math.inf] * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            c = word[i]
            one = min(n, i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4))
            state, alone = 0, False
            for j in range(i, n):
                to = base[state] + word[j] + 1
                if check[to] != state:
                    break
                state = to
                v = value[state]
                if v >= 0:
                    alone |= j + 1 == one
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = here + scores[v], i, v
            if not alone and here + p.unknown > best[one]:
                best[one], start[one], piece[one] = here + p.unknown, i, -1
        ids: list[int] = []
        while n > 0:
            i = start[n]
            ids += [piece[n]] if piece[n] >= 0 else [p.bytes_id[b] for b in reversed(word[i:n])]
            n = i
        return ids[::-1]

    def segments(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment; the new ones are walked together, those of like length at a time."""
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        new = sorted((w for s in dict.fromkeys(segments) if s not in known for w in (s.encode("utf-8", "surrogatepass"),)), key=len)
        short = [w for w in new if len(w) <= _LONG]
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            for w, ids in zip(part, self._walk(part), strict=True):
                known[w.decode("utf-8", "surrogatepass")] = array("I", ids).tobytes()
        once = {w.decode("utf-8", "surrogatepass"): array("I", self._long(w)).tobytes() for w in new[len(short) :]}
        return [known.get(s) or once.get(s, b"") for s in segments]

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts, ends = [], [0]
        for t in texts:
            if t:
                marked = MARK + t.replace(" ", MARK)
                simple = "  " not in t and t[0] != " " and MARK not in t
                parts += [MARK + s for s in t.split(" ")] if simple else _SEGMENT.findall(marked)
            ends.append(len(parts))
        if not parts:
            return [b""] * len(texts)
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        ids = self.segments(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[which]
        after = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        stream = flat[np.repeat(starts[which] - after + each, each) + np.arange(after[-1])].tobytes()
        bounds = np.concatenate(([0], after))[ends].tolist()
        return [stream[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.p.shown.__getitem__, array("I", ids).tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str | None = None, name: str = "piece_bpe_32k.model") -> Pieces:
    import public_tokenizers

    return Pieces(path or public_tokenizers.path(name))


def _parts(texts: list[str], chars: int = 1 << 22):
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars or k + 1 == len(texts):
            yield texts[first : k + 1]
            first, size = k + 1, 0


def encode(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_ids, n_fallback)``: ids packed as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches):
        tokens = Unigram(shared.value)
        single = np.zeros(len(shared.value.scores), bool)
        single[shared.value.bytes_id] = True
        for pdf in batches:
            ids = [x for part in _parts(pdf["text"].tolist()) for x in tokens(part)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "n_ids": [len(x) // 4 for x in ids], "n_fallback": [int(single[np.frombuffer(x, np.uint32)].sum()) for x in ids]})

    return in_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, ids binary, n_ids long, n_fallback long")


def decode(encoded: DataFrame, model: Pieces, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All columns and the text that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        tokens = Unigram(shared.value)
        return pd.Series([tokens.decode(bytes(x)) for x in ids])

    return encoded.withColumn(out, back(F.coalesce(ids_col, F.lit(b""))))
