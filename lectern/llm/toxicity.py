"""Toxicity: a lexicon trie met by Levenshtein automata, and the context of each hit.

Method.  The Levenshtein automata of all lexicon terms are intersected with their trie: a state is
the set of (trie node, edits so far) that a read prefix can stand for.  The product is determinised
lazily, one dictionary step per letter, and dies after two or three letters for most words; each
distinct word is read once.  A term of 5 to 8 letters admits one edit, a longer one two, a shorter
one none; figures and signs that stand for letters are folded first.  The lexicon also holds stems,
prefixes in the same trie that stand for every word that begins with them (within one edit after the
first letter, from six letters on); the automaton remembers the stem a word has gone through.

Each hit is scored in its context: matched quotation marks that enclose it, however far apart, and
verbs of saying within :attr:`Scorer.WINDOW` tokens turn it towards quotation; second-person words
in the window towards abuse.  A logistic
model over a few sums (plain, quoted, disguised and misspelled hits, density, address) gives the
document's score, over its whole text.

Learning takes labelled rows of ``where`` only, ``max_rows`` in expectation at most (a documented
bound): lexicon terms and stems by log odds with greedy cover, the whole words under each stem,
forms near a term that are ordinary words, and the logistic weights.  A base lexicon of common insults is always in.

Defined results: null and empty texts have no hits and get the intercept's score; null labels are
ignored, several labels of one id count as their mean, rounded up at one half; without labels of
both kinds a fixed prior of weights scores; repeated doc_ids are scored each time; extra columns are
never inputs and pass through, but for one named like the result, which it replaces.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, text_or_empty, unstage
from lectern.llm.quality import labelled

#: Common insults, the base of the lexicon.
BASE_TERMS = (
    "idiot", "moron", "stupid", "imbecile", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumbass", "asshole", "bastard", "bitch", "retard",
    "connard", "salaud", "abruti", "crétin", "ordure", "arschloch", "dummkopf", "abschaum", "versager", "schwachkopf", "imbécil", "estúpido", "gilipollas", "cabrón", "basura",
)
#: Verbs of saying and citing, and second-person words, in the four languages of the tables.
SAYING = frozenset("said says say wrote writes quoted quotes cited claims called dit disait écrit cite sagte sagt schrieb zitierte dijo dice escribió citó".split())
ADDRESS = frozenset("you your youre you're u ur tu toi vous votre ton du dich dein deine ihr tú te usted tus".split())
_FOLD = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"[\w@$]+")
_QUOTE = re.compile('["“”„«»‹›‘’]')
_OPENS = frozenset('"“„«‹‘')
#: closing mark -> the opening marks it can close
_CLOSES = {'"': '"', "”": "“„", "“": "„", "»": "«", "›": "‹", "’": "‘"}
#: chunks a worker remembers, and the longest of them
_REMEMBERED, _KEPT = 200_000, 64
#: letters of the word beginnings that may be learned
STEM_SIZES = (4, 5, 6)


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def stem_edits(stem: str) -> int:
    """A stem is met by more words than a term, so it admits fewer edits."""
    return 0 if len(stem) < 6 else 1


class LexiconAutomaton:
    """Trie of terms and stems intersected with their Levenshtein automata, determinised as words are read.

    A state is the (trie node, edits) pairs that the letters so far can stand for, the best stem that
    they have already gone through (whatever follows a stem, the word still meets it), and the first
    letter, which a stem and its word share.
    """

    def __init__(self, terms, stems=()):
        self.next: list[dict[str, int]] = [{}]
        self.most = [0]
        self.ends: dict[int, str] = {}
        self.stems: dict[int, str] = {}
        for found, ends, edits in ((terms, self.ends, allowed_edits), (stems, self.stems, stem_edits)):
            for term in sorted(set(found)):
                ends[self._add(term, edits(term))] = term
        self.start = self._close({0: 0}, None, "")
        self.steps: dict[tuple, dict[str, tuple]] = {}

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for c in term:
            if c not in self.next[node]:
                self.next[node][c] = len(self.next)
                self.next.append({})
                self.most.append(0)
            node = self.next[node][c]
            self.most[node] = max(self.most[node], edits)
        return node

    def _close(self, state: dict[int, int], stem: tuple | None, first: str) -> tuple:
        """With the letters of a term that the word leaves out; only what some term still admits stays."""
        todo = list(state)
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                e = state[node] + 1
                if e <= self.most[child] and e < state.get(child, 99):
                    state[child] = e
                    todo.append(child)
        for node, e in state.items():
            if node in self.stems and e <= stem_edits(self.stems[node]) and self.stems[node][0] == first:
                here = (e, self.stems[node])
                stem = here if stem is None else min(stem, here)
        return tuple(sorted(state.items())), stem, first

    def _step(self, state: tuple, c: str) -> tuple:
        out: dict[int, int] = {}
        for node, e in state[0]:
            if e < self.most[node]:
                out[node] = min(e + 1, out.get(node, 99))
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < out.get(child, 99):
                    out[child] = cost
        return self._close(out, state[1], state[2] or c)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, or stem within its (written with ``*``), and the edits; of equals a term
        before a stem, then the first in order."""
        state = self.start
        for c in word:
            if not state[0]:
                break  # only the stem it went through can count
            row = self.steps.get(state)
            if row is None:
                if len(self.steps) > 50_000:
                    self.steps.clear()
                row = self.steps[state] = {}
            if c not in row:
                row[c] = self._step(state, c)
            state = row[c]
        else:
            found = [(e, 0, self.ends[n]) for n, e in state[0] if n in self.ends and e <= allowed_edits(self.ends[n])]
            if state[1]:
                found.append((state[1][0], 1, state[1][1] + "*"))
            return (min(found)[2], min(found)[0]) if found else None
        return (state[1][1] + "*", state[1][0]) if state[1] else None


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(BASE_TERMS, 1.0))
    #: beginnings of words that stand for the term "beginning*", whatever follows
    stems: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-4.0, 6.0, 1.0, 5.0, 3.5, 1.0, 0.5, 0.5)


class _Words(dict):
    """word -> (term, kind) with kind 0 plain, 1 disguised, 2 misspelled; or None."""

    def __init__(self, model: Model):
        self.auto, self.ordinary, self.terms = LexiconAutomaton(model.terms, model.stems), model.ordinary, model.terms
        self.least = min([len(t) - allowed_edits(t) for t in model.terms] + [len(t) - stem_edits(t) for t in model.stems], default=0)
        self.longest = float("inf") if model.stems else max((len(t) + allowed_edits(t) for t in model.terms), default=0)

    def look(self, word: str) -> tuple[str, int] | None:
        if word in self.terms:
            return word, 0
        plain = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
        folded = plain if plain.isalpha() else plain.translate(_FOLD).replace("_", "")
        tight = re.sub(r"(.)\1{2,}", r"\1", folded) if len(folded) > 4 else folded
        for form in dict.fromkeys((word, folded, tight)):
            if self.least <= len(form) <= self.longest and (found := self.auto.match(form)):
                kind = 2 if found[1] else 0 if form == word else 1
                return (found[0], kind) if kind < 2 or word not in self.ordinary else None
        return None

    def __missing__(self, word: str) -> tuple[str, int] | None:
        value = self.look(word)
        if len(word) <= _KEPT:
            self[word] = value
        return value


class _Chunks(dict):
    """chunk between white space -> the words in it that are hits, or None."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, chunk: str):
        words = self.words
        # a chunk of letters is a word; letters and one mark are the usual rest
        parts = (chunk,) if chunk.isalpha() else (chunk[:-1],) if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?" else _WORD.findall(chunk)
        value = tuple(w for w in parts if words[w] is not None) or None
        if len(chunk) <= _KEPT:
            self[chunk] = value
        return value


def _lower(text: str) -> str:
    """Lower case, letter by letter where the whole would change its length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def quoted(text: str) -> list[tuple[int, int]]:
    """(start, end) of what matched quotation marks enclose, in order, over the whole text.

    A plain mark opens before a character and not after a word, and closes after a character; the
    right single mark between letters is an apostrophe.
    """
    out, opened = [], {}
    for m in _QUOTE.finditer(text):
        c, k = m[0], m.start()
        before, after = text[k - 1 : k], text[k + 1 : k + 2]
        if c == "’" and before.isalnum() and after.isalnum():
            continue
        closes = next((o for o in _CLOSES.get(c, "") if o in opened), None)
        if closes and (c != '"' or before.strip()):
            out.append((opened.pop(closes), k))
        elif c in _OPENS and c not in opened and (c != '"' or after.strip() and not before.isalnum()):
            opened[c] = k
    return sorted(out)


class Scorer:
    #: tokens on each side of a hit that its context is read from
    WINDOW = 8

    def __init__(self, model: Model):
        self.model, self.words = model, _Words(model)
        self.chunks = _Chunks(self.words)

    def hits(self, text: str) -> list[tuple[int, int, str, str, int, float, bool]]:
        """(start, end, word, term, kind, quotation from 0 to 1, addressed) of each hit, in order."""
        low = _lower(text or "")
        if len(self.chunks) > _REMEMBERED:
            self.words.clear()
            self.chunks.clear()
        found = {w for ws in set(map(self.chunks.__getitem__, low.split())) if ws for w in ws}
        if not found:
            return []
        known = {w: self.words[w] for w in found}
        out, tokens, inside, furthest = [], list(_WORD.finditer(low)), quoted(low), -1
        spans = iter(inside)
        ahead = next(spans, None)
        for k, m in enumerate(tokens):
            while ahead and ahead[0] < m.start():
                furthest = max(furthest, ahead[1])
                ahead = next(spans, None)
            if (hit := known.get(m[0])) is not None:
                near = {t[0] for t in tokens[max(0, k - self.WINDOW) : k]} | {t[0] for t in tokens[k + 1 : k + 1 + self.WINDOW]}
                quotation = 0.6 * (furthest >= m.end()) + 0.4 * (not SAYING.isdisjoint(near))
                out.append((m.start(), m.end(), m[0], *hit, quotation, not ADDRESS.isdisjoint(near)))
        return out

    def features(self, text: str) -> list[float]:
        hits = self.hits(text)
        x = [1.0] + [0.0] * 7
        if hits:
            terms = self.model.terms
            for _, _, _, term, kind, quotation, addressed in hits:
                w = terms.get(term, 1.0)
                x[1 + (0, 2, 3)[kind]] += w * (1 - quotation)
                x[2] += w * quotation
                x[6] += addressed
            x[5] = 100 * sum(terms.get(h[3], 1.0) * (1 - h[5]) for h in hits) / (len(text) / 6 + 1)
            x[1:7] = [math.log1p(v) for v in x[1:7]]
            x[7] = max(terms.get(h[3], 1.0) * (1 - h[5]) / (1 + (h[4] == 2)) for h in hits)
        return x

    def score(self, text: str) -> float:
        s = sum(a * b for a, b in zip(self.model.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def _cover(documents: list[list[str]], odds: dict[str, float], least: int) -> list[str]:
    """Terms by log odds times the share of toxic documents they explain that no earlier term does."""
    left, chosen = [set(d) for d in documents], []
    while True:
        counts = Counter(w for d in left for w in d)
        # of terms that explain alike, a whole word before a stem, and a longer one before a shorter
        best = max(((odds[w] * n, not w.endswith("*"), len(w), w) for w, n in counts.items() if n >= least), default=None)
        if best is None:
            return chosen
        chosen.append(best[-1])
        left = [d for d in left if best[-1] not in d]


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -3, 3)
    return w


def _beginnings(words: Column, size: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > size), lambda w: F.concat(F.substring(w, 1, size), F.lit("*")))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, max_rows: int = 8_000, text_col: str = "text") -> Model:
    """What is collected comes from ``max_rows`` texts at most (a documented bound) and of those only from
    words that several toxic ones share, or that lie within the edits of such a word."""
    chosen = labelled(docs, labels, label, where, max_rows, "toxicity", text_col)
    counts = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        unstage(chosen)
        return Model()
    # whole words, and beginnings of words ("begin*"), since insults take endings
    whole = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}@$]+")), lambda w: w != "")
    words = F.array_distinct(F.concat(whole, *(_beginnings(whole, k) for k in STEM_SIZES)))
    least = max(3, pos // 100)
    per_word = chosen.select("y", F.explode(words).alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.count("*").alias("n")).filter(F.col("p") >= least)
    bad, good = F.col("p"), F.col("n") - F.col("p")
    telling = per_word.withColumn("odds", F.log((bad + 0.5) / (pos - bad + 0.5)) - F.log((good + 0.5) / (neg - good + 0.5))).filter("odds > 4")
    odds = {r["w"]: r["odds"] for r in telling.select("w", "odds").collect()}
    terms, stems = dict.fromkeys(BASE_TERMS, 1.0), frozenset()
    if odds:
        shared = chosen.sparkSession.createDataFrame([(w,) for w in odds], "w string")
        toxic = chosen.filter("y = 1").select("doc_id", F.xxhash64("text").alias("t"), F.explode(words).alias("w")).join(F.broadcast(shared), "w")
        documents = [r["k"] for r in toxic.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("w")).alias("k")).collect()]
        learned = _cover(documents, odds, least)
        stems = frozenset(w[:-1] for w in learned if w.endswith("*"))
        # the whole words under a stem are terms too, so that their misspelled forms are met
        terms |= {w: 1.0 for w in odds if not w.endswith("*") and (w in learned or w.startswith(tuple(stems)))}
    first = Model(terms=terms, stems=stems)

    def forms(batches):
        scorer = Scorer(first)
        for pdf in batches:
            got = [(y, w) for y, t in zip(pdf["y"], pdf["text"], strict=True) for w in {h[2] for h in scorer.hits(t) if h[4] == 2}]
            yield pd.DataFrame(got, columns=["y", "w"])

    seen = chosen.mapInPandas(forms, "y int, w string").groupBy("w").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    ordinary = frozenset(r["w"] for r in seen.filter("p * 2 <= n").select("w").collect())
    second = Model(terms=terms, stems=stems, ordinary=ordinary)

    def features(batches):
        scorer = Scorer(second)
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": [scorer.features(t) for t in pdf["text"]]})

    data = sorted((r["y"], *r["x"]) for r in chosen.mapInPandas(features, "y int, x array<double>").collect())
    unstage(chosen)
    # The prior's rows keep the sense of features that the sample never shows.
    prior = np.eye(8)[1:] * 2 + np.eye(8)[0]
    wanted = np.array([1, 0, 1, 0.8, 0.6, 0.6, 0.8])
    x = np.concatenate((np.array([r[1:] for r in data]), prior))
    y = np.concatenate((np.array([r[0] for r in data], dtype=float), wanted))
    return Model(terms=terms, stems=stems, ordinary=ordinary, weights=tuple(map(float, _newton(x, y))))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity", hits_out: str | None = None) -> DataFrame:
    """All columns of ``docs``, the score, and the hits if asked for."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # terms that several of max_rows texts share, and the forms near them

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    @F.pandas_udf("array<struct<start:int,end:int,word:string,term:string,kind:int,quotation:double,addressed:boolean>>")
    def located(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        names = ("start", "end", "word", "term", "kind", "quotation", "addressed")
        for texts in batches:
            yield pd.Series([[dict(zip(names, h, strict=True)) for h in scorer.hits(t)] for t in texts])

    df = docs.withColumn(out, scored(text_or_empty(text_col)))
    return df.withColumn(hits_out, located(text_or_empty(text_col))) if hits_out else df
