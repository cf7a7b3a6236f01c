"""Personal data by seeds and bootstrapped contextual extraction.

Method.  Four base patterns (e-mail, IP address, payment card, phone) find the seeds in every whole
text.  Each seed induces lexical patterns: the chunk of text before it, the chunk after it, and the
key it is glued to (``key=`` or ``key:``).  Every other chunk that holds a figure or an ``@`` is a
candidate with patterns of its own.  Patterns and instances form a graph that Spark scores in
``rounds`` iterations: a pattern's confidence is the belief in its instances, summed over their
occurrences, over all occurrences of its context in the corpus (so an ordinary word never becomes a
pattern, and copies of a row count on both sides), lowered by one part in ``own + 1`` where it has
``own`` different instances; an instance's belief is the noisy-or of its patterns' confidences.  Patterns seen with at least
``min_seeds`` different seeds and a confidence of ``threshold`` discover identifiers that the base
patterns miss; those get the kind ``like_<kind>`` and never touch a base span.

Texts are read once for seeds and candidates (written to the shared folder, without texts) and once
for the counts of context words.  Nothing is collected.

Defined results: null text counts as empty and has no spans; repeated doc_ids are judged row by row;
of two kinds with equal belief the one listed first wins; words of any length count whole (very long
ones by their digest); extra columns are ignored by :func:`find` and kept by :func:`masked`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lectern.llm.common import in_pandas, staged, text_or_empty, unstage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can only begin where a run of figures begins, hence the possessive run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CHUNK = re.compile(r"[^ \t\n\x0b\f\r]+")
_FIGURE = re.compile(r"[0-9@]")
_KEY = re.compile(r"([^=:]+[=:])[\"']?(?=[^/\"'])")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)
#: Words of more characters than this stand in patterns and values by their digest, so that a row stays small.
_PLAIN = 64


def _name(word: str) -> str:
    """A word in patterns: A-Z in lower case, a very long one by its digest."""
    word = word.lower() if word.isascii() else word.translate(_LOWERED)
    return word if len(word) <= _PLAIN else "\0" + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def _named(word: Column) -> Column:
    """:func:`_name` as an expression."""
    low = F.translate(word, _UPPER, _LOWER)
    return F.when(F.length(low) <= _PLAIN, low).otherwise(F.concat(F.lit("\0"), F.sha2(low.cast("binary"), 256)))


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)  # a local part cannot hold the sign
        at = text.find("@", max(at + 1, last))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: leftmost and non-overlapping per kind, invalid ones dropped."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _instances(text: str, spans: list[tuple[int, int, int]]):
    """(kind or -1, start, end, value, patterns) of seeds and candidates."""
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    starts = [a for a, _ in chunks]
    used = set()
    out = []

    def word(k: int) -> str | None:
        return _name(text[chunks[k][0] : chunks[k][1]]) if 0 <= k < len(chunks) else None

    def add(kind, a, b, first, last, key):
        patterns = [side + w for side, w in (("<", word(first - 1)), (">", word(last + 1)), ("=", key and _name(key))) if w]
        out.append((kind, a, b, _name(text[a:b]), patterns))

    for kind, a, b in spans:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        used.update(range(first, last + 1))
        key = text[chunks[first][0] : a] if chunks[first][0] < a and text[a - 1] in "=:" else None
        add(kind, a, b, first, last, key)
    for k, (a, b) in enumerate(chunks):
        if k not in used and _FIGURE.search(text, a, b):
            m = _KEY.match(text, a, b)
            start = m.end() if m else a
            end = b
            while end > start and text[end - 1] in ".,;:!?)]}\"'":
                end -= 1
            if end - start >= 5:
                add(-1, start, end, k, k, m[1] if m else None)
    return out


_SCHEMA = (
    "rid long, doc_id long, base array<struct<kind:int,start:int,end:int>>, "
    "found array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"
)


def _read_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for pdf in batches:
            base, found = [], []
            for text in pdf["text"]:
                spans = base_spans(text) if _FIGURE.search(text) else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                rows = _instances(text, spans) if _FIGURE.search(text) else []
                found.append([dict(zip(("kind", "start", "end", "value", "patterns"), r, strict=True)) for r in rows])
            yield pd.DataFrame({"rid": range(rid, rid + len(pdf)), "doc_id": pdf["doc_id"], "base": base, "found": found})
            rid += len(pdf)

    return in_pandas(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, _SCHEMA)


#: Context words up to this count are sent to every executor (some MB); beyond it they are joined by shuffle.
_WORDS = 100_000


def learn_patterns(docs: DataFrame, found: DataFrame, text_col: str = "text", min_seeds: int = 3, threshold: float = 0.7, rounds: int = 3) -> DataFrame:
    """``(pattern, kind, confidence)`` of the patterns that may discover identifiers, as a staged table.

    ``found`` has rows (kind, value, patterns) of seeds and candidates (kind -1).
    """
    edges = found.select("kind", "value", F.explode("patterns").alias("pattern"))
    seeds = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.countDistinct("value").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    seeds = staged(seeds, "seeds")
    own_word = F.when(~F.col("pattern").startswith("="), F.expr("substring(pattern, 2)"))
    words = seeds.select(own_word.alias("word")).filter("word IS NOT NULL").distinct()
    chunk = docs.select(F.explode(F.split(text_or_empty(text_col), r"[ \t\n\x0B\f\r]+")).alias("word")).select(_named(F.col("word")).alias("word"))
    if words.count() <= _WORDS:
        chunk = chunk.join(F.broadcast(words), "word", "left_semi")
    counts = chunk.groupBy("word").agg(F.count("*").alias("n"))
    near = edges.join(seeds.select("pattern").distinct(), "pattern", "left_semi")
    near = near.withColumnRenamed("kind", "own_kind").groupBy("pattern", "own_kind", "value").agg(F.count("*").alias("times"))
    near = staged(near, "near")
    own = near.groupBy("pattern").agg(F.countDistinct("value").alias("own"), F.sum("times").alias("seen"))
    totals = (
        own.withColumn("word", own_word)
        .join(counts, "word", "left")
        .select("pattern", "own", F.greatest("seen", F.coalesce("n", F.lit(0))).alias("total"))
    )
    # From here on only patterns with seeds are left, and their instances.
    graph = staged(
        near.join(seeds, "pattern").join(totals, "pattern"),
        "graph",
    )
    belief = F.when(F.col("own_kind") == F.col("kind"), 1.0).when(F.col("own_kind") >= 0, 0.0)
    scored = graph.withColumn("belief", F.coalesce(belief, F.lit(0.0)))
    for k in range(rounds):
        share = F.sum(F.col("belief") * F.col("times")) / F.max("total")
        confidence = scored.groupBy("pattern", "kind").agg((share * F.max("own") / (F.max("own") + 1)).alias("confidence"))
        if k + 1 == rounds:
            out = staged(confidence.filter(F.col("confidence") >= threshold), "patterns")
            unstage(seeds, near, graph)
            return out
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        held = graph.join(confidence, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - doubt).alias("noisy"))
        scored = graph.join(held, ["value", "kind"]).withColumn("belief", F.coalesce(belief, F.col("noisy")))
    raise ValueError("rounds must be 1 or more")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """``(doc_id, base, spans)`` per row: arrays of (kind, start, end) in code points, in order of kind
    as listed, then start; ``spans`` also has what the learned patterns discovered."""
    rows = staged(_read_spans(docs, id_col, text_col), "spans")
    found = rows.filter(F.size("found") > 0).select(F.explode("found").alias("f")).select("f.*")
    return _named_spans(rows, learn_patterns(docs, found, text_col, **learning))


def _named_spans(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` for each of ``rows`` (of :func:`_read_spans`), by a join with the patterns."""
    found = rows.filter(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    candidates = found.filter("kind = -1").select("rid", "start", "end", F.explode("patterns").alias("pattern"))
    best = Window.partitionBy("rid", "start", "end").orderBy(F.desc("confidence"), "kind")
    hits = candidates.join(patterns, "pattern").withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    more = hits.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.col("kind"), F.col("start"), F.col("end")))).alias("more"))
    name = F.array(*map(F.lit, KINDS))

    def named(spans, like=""):
        return F.transform(spans, lambda s: F.struct(F.concat(F.lit(like), F.element_at(name, s["kind"] + 1)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = named(F.array_sort("base"))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    return rows.select("rid", "doc_id", "base").join(more, "rid", "left").select("doc_id", base.alias("base"), F.concat(base, named(F.coalesce("more", none), "like_")).alias("spans"))


def mask(text: str, spans) -> str:
    """The text with each span (kind, start, end) replaced by its kind in brackets; overlaps merge."""
    out, at = [], 0
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, text_col: str = "text", most: int = _WORDS, **learning) -> DataFrame:
    """``docs`` with every found identifier in ``text_col`` replaced by its kind; rows and other columns stay.

    Up to ``most`` patterns go to every executor; more are joined by shuffle, with the same result.
    """
    rows = staged(_read_spans(docs, "doc_id", text_col), "spans")
    patterns = learn_patterns(docs, rows.filter(F.size("found") > 0).select(F.explode("found").alias("f")).select("f.*"), text_col, **learning)
    unstage(rows)
    if patterns.count() > most:
        return _masked_by_join(docs, patterns, text_col)
    kept = {r["pattern"]: (r["confidence"], -r["kind"]) for r in patterns.orderBy("confidence", F.desc("kind")).collect()}
    unstage(patterns)
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if _FIGURE.search(text):
                spans = base_spans(text)
                named = [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
                for kind, a, b, _, ps in _instances(text, spans):
                    if kind < 0 and (hits := [shared.value[p] for p in ps if p in shared.value]):
                        named.append({"kind": "like_" + KINDS[-max(hits)[1]], "start": a, "end": b})
                text = mask(text, named)
            out.append(text)
        return pd.Series(out)

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), hide(text_or_empty(text_col))))


def _masked_by_join(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """:func:`masked` for any number of patterns: spans by row, joined back to the texts."""
    numbered = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    spans = _named_spans(staged(_read_spans(numbered, "__row", text_col), "spans"), patterns)

    @F.pandas_udf("string")
    def hide(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([mask(text, found) for text, found in zip(texts, spans, strict=True)])

    joined = numbered.join(spans.select(F.col("doc_id").alias("__row"), F.col("spans").alias("__spans")), "__row")
    return joined.withColumn(text_col, F.when(F.col(text_col).isNotNull(), hide(text_or_empty(text_col), F.col("__spans")))).select(docs.columns)
