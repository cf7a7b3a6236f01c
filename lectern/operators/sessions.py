"""Selecting, ordering and matching questions for a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.sequence import numbered, runs

KEY = ["bank_id", "question_id"]


def of_type(questions: DataFrame, wanted: str) -> DataFrame:
    """``all``, ``abnormal``, ``display:<label>`` or a core type; the last two take normal rows only."""
    if wanted == "all":
        return questions
    if wanted == "abnormal":
        return questions.filter("status <> 'normal'")
    normal = questions.filter("status = 'normal'")
    label = F.coalesce(F.when(F.col("display_label") != "", F.col("display_label")), F.col("type"))
    return normal.filter(label == wanted[8:]) if wanted.startswith("display:") else normal.filter(F.col("type") == wanted)


def candidates(questions: DataFrame, mastered: DataFrame, wanted: str = "all", mode: str = "order", wrong: DataFrame | None = None, favorite: DataFrame | None = None) -> DataFrame:
    """Questions a session may show: no placeholders, none mastered (but in exams and searches), of one type,
    and in the modes ``wrong`` and ``favorite`` only those on record."""
    out = of_type(questions.filter(~F.col("placeholder")), wanted)
    if mode not in ("exam", "search"):
        out = out.join(mastered.select(*KEY), KEY, "left_anti")
    if mode == "wrong" and wrong is not None:
        out = out.join(wrong.join(mastered.select(*KEY), KEY, "left_anti").select(*KEY), KEY, "left_semi")
    if mode == "favorite" and favorite is not None:
        out = out.join(favorite.select(*KEY), KEY, "left_semi")
    return out


def shuffled(rows: DataFrame, seed: str, by: str, id_col: str = "question_id") -> DataFrame:
    """A repeatable shuffle: ``position`` in the order of a hash of the seed and the id."""
    hashed = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))))
    return numbered(hashed, [by], [F.asc("h"), F.asc(id_col)], "position", F.substring("h", 1, 3)).drop("h")


def exam(rows: DataFrame, seed: str, by: str, count: int, id_col: str = "question_id") -> DataFrame:
    """The first ``count`` of each bank's shuffle, numbered by ``place``: Spark keeps no more rows than that of a partition."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    w = Window.partitionBy(by).orderBy("h", id_col)
    return rows.withColumn("h", h).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= count).drop("h")


def batch(rows: DataFrame, count: int, resume_at: Column, by: str = "bank_id", order: str = "ord") -> DataFrame:
    """The batch of ``count`` rows that holds the row to resume at."""
    r = numbered(rows, [by], [F.asc(order)], "position", runs(order), first=0).withColumn("start", F.floor(resume_at / count) * count)
    return r.filter((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + count))


def shuffled_options(rows: DataFrame, seed: str) -> DataFrame:
    """Options in hash order with new keys, and the answer's keys mapped and sorted; short questions and those
    with fewer than two options or with wording that depends on places stay as they are."""
    from lectern.functions.question import order_dependent

    keys = F.array(*map(F.lit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    hashed = F.array_sort(F.transform("options", lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("question_id").cast("string"), o["key"])).alias("h"), o.alias("o"))))
    new = F.transform(hashed, lambda x, i: F.struct(F.element_at(keys, i + 1).alias("key"), x["o"]["text"].alias("text"), x["o"]["images"].alias("images"), x["o"]["key"].alias("old")))
    keep = (F.col("type") == "short") | (F.size("options") < 2) | order_dependent(F.col("options"))
    r = rows.withColumn("__new", new).withColumn("shuffled", ~keep)
    answer = F.array_sort(F.transform("answer", lambda k: F.coalesce(F.get(F.filter("__new", lambda n: n["old"] == k), F.lit(0))["key"], k)))
    plain = F.transform("__new", lambda n: F.struct(n["key"].alias("key"), n["text"].alias("text"), n["images"].alias("images")))
    return r.withColumn("answer", F.when(keep, F.col("answer")).otherwise(answer)).withColumn("options", F.when(keep, F.col("options")).otherwise(plain)).drop("__new")


def nearest_state(states: DataFrame, questions: DataFrame) -> DataFrame:
    """Saved states (state_id, question_id, key, ord) to questions (question_id, key, ord): by id, else by key with
    the nearest order (then the lower; the lowest for a state without order); never by order alone."""
    by_id = states.join(questions.select("question_id"), "question_id").select("state_id", F.col("question_id").alias("matched"), F.lit(0).alias("how"))
    left = states.filter("key <> ''").join(by_id.select("state_id"), "state_id", "left_anti").select("state_id", "key", F.greatest("ord", F.lit(0)).alias("ord"))
    near = neighbours(left.select("key", "ord").distinct(), questions)
    by_key = left.join(near, ["key", "ord"]).select("state_id", "matched", F.lit(1).alias("how"))
    return by_id.unionByName(by_key)


def neighbours(asked: DataFrame, questions: DataFrame, run: int = 4096) -> DataFrame:
    """``(key, ord, matched)``: to each (key, ord) the question of the key with the nearest order, then the lower.

    Both sides are sorted by key and order once and the nearest before and after are carried along,
    within runs of orders and, by one row a run, across them; no state meets all questions of its key.
    """
    q = questions.select("key", F.col("ord").alias("q_ord"), "question_id").groupBy("key", "q_ord").agg(F.min("question_id").alias("id"))
    own = F.struct(F.col("q_ord").alias("ord"), F.col("id").alias("id"))
    q = q.select("key", F.col("q_ord").alias("ord"), own.alias("q"), F.lit(0).alias("asks"))
    rows = q.unionByName(asked.select("key", "ord", F.lit(None).cast(q.schema["q"].dataType).alias("q"), F.lit(1).alias("asks"))).withColumn("run", runs("ord", run))
    inside = Window.partitionBy("key", "run").orderBy("ord", "asks")
    back = F.last("q", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on = F.first("q", ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = rows.withColumns({"back": back, "on": on}).filter("asks = 1").select("key", "run", "ord", "back", "on")
    ends = rows.groupBy("key", "run").agg(F.max("q").alias("last"), F.min("q").alias("first"))
    across = Window.partitionBy("key").orderBy("run")
    ends = ends.select(
        "key", "run", F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    j = found.join(ends, ["key", "run"]).select("key", "ord", F.coalesce("back", "before").alias("a"), F.coalesce("on", "after").alias("b")).filter("a IS NOT NULL OR b IS NOT NULL")
    lower = F.col("b").isNull() | F.coalesce(F.col("ord") - F.col("a.ord") <= F.col("b.ord") - F.col("ord"), F.lit(False))
    low = F.when((F.col("ord") > 0) & lower, F.col("a.id"))
    return j.select("key", "ord", F.coalesce(low, "b.id", "a.id").alias("matched"))


def preserved(previous: DataFrame, covered: DataFrame) -> DataFrame:
    """Earlier states that this session's questions cover neither by id nor by key and order."""
    left = previous.join(covered.select("question_id"), "question_id", "left_anti")
    return left.join(covered.select("key", "ord"), ["key", "ord"], "left_anti")


def interval_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, key: str, first: bool = True) -> DataFrame:
    """Each point with the first span [start, end) of its key that holds it, or with every one: an equi-join on the key,
    then the range.  Equal points stay as many rows as they are."""
    rest = [c for c in spans.columns if c not in (key, start, end)]
    held = points.join(spans.distinct() if first else spans, key).filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end)))
    held = held.select(*points.columns, start, end, *rest)
    if not first:
        return held
    ranked = held.withColumn("__rank", F.rank().over(Window.partitionBy(*points.columns).orderBy(start, end, *rest)))
    return ranked.filter("__rank = 1").drop("__rank")


def answers_by_place(questions: DataFrame, keys: DataFrame, by: str = "bank_id", order: str = "ord", place: str = "event_id") -> DataFrame:
    """The k-th entry of a sequential appendix with the k-th eligible question of its bank."""
    entries = numbered(keys, [by], [F.asc(place)], "pos", runs(place))
    free = numbered(questions, [by], [F.asc(order)], "pos", runs(order))
    return free.join(entries, [by, "pos"])


def saved_sequence(questions: DataFrame, saved: DataFrame, seed: str, by: str = "bank_id") -> DataFrame:
    """Questions (bank, question_id, key, ord) in the order of a saved sequence (bank, pos, question_id, key, ord).

    Entries take a question in turn, each question once: by id, else the nearest order of its key, else its
    order.  Questions that no entry takes follow in hash order.  Taking in turn is sequential, so a bank
    is one task; a bank is a document's size.
    """
    import hashlib

    import pandas as pd

    def match(key, qs: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        free = {r.question_id: r for r in qs.sort_values("ord").itertuples()}
        of_key: dict[str, list] = {}
        for r in free.values():
            of_key.setdefault(r.key, []).append(r)
        of_order = {}
        for r in free.values():
            of_order.setdefault(r.ord, []).append(r)
        out = []
        for e in entries.sort_values("pos").itertuples():
            found = free.get(e.question_id)
            if found is None and e.key:
                found = min((r for r in of_key.get(e.key, ()) if r.question_id in free), key=lambda r: (abs(r.ord - e.ord), r.ord), default=None)
            if found is None and e.ord > 0:
                found = next((r for r in of_order.get(e.ord, ()) if r.question_id in free), None)
            if found is not None:
                out.append(found.question_id)
                del free[found.question_id]
        out += sorted(free, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        return pd.DataFrame({by: [key[0]] * len(out), "question_id": out, "position": range(1, len(out) + 1)})

    kind = questions.schema["question_id"].dataType.simpleString()
    name = questions.schema[by].dataType.simpleString()
    return questions.groupBy(by).cogroup(saved.groupBy(by)).applyInPandas(match, f"{by} {name}, question_id {kind}, position long")


def existing_source(drafts: DataFrame, banks: DataFrame) -> DataFrame:
    """Each draft with the first bank that came from a file of the same name (source_name), the oldest, then by id."""
    first = banks.filter("source_name <> ''").groupBy("source_name").agg(F.min(F.struct("created_at", "bank_id")).alias("b"))
    return drafts.join(first, "source_name").select(*drafts.columns, F.col("b.bank_id").alias("bank_id"))
