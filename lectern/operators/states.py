"""Saved session states: what is kept, how it comes back, and how edits carry selections over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.question import same_answer
from lectern.functions.text import trim


def build(items: DataFrame) -> DataFrame:
    """States of answered or revealed questions, with the texts of the selected options."""
    texts = F.transform(F.filter("options", lambda o: F.array_contains("selected", o["key"])), lambda o: F.coalesce(o["text"], F.lit("")))
    kept = items.filter((F.size("selected") > 0) | F.coalesce(F.col("revealed"), F.lit(False)))
    return kept.withColumn("selected_texts", texts).drop("options")


def restored(selected: Column, selected_texts: Column, options: Column) -> Column:
    """Keys a state selects now: by the options' texts where any is found, else the keys that still exist."""
    keys = F.transform(options, lambda o: o["key"])
    by_text = F.array_distinct(F.array_compact(F.transform(selected_texts, lambda t: F.get(F.filter(options, lambda o: trim(F.lower(o["text"])) == trim(F.lower(t))), F.lit(0))["key"])))
    by_key = F.filter(selected, lambda k: F.array_contains(keys, k))
    return F.when(F.size(by_text) > 0, by_text).otherwise(by_key)


def restore(matched: DataFrame) -> DataFrame:
    """Adds ``now`` (selected keys) and ``regraded`` against the present answer; ``matched`` joins states to questions."""
    m = matched.withColumn("now", restored(F.col("selected"), F.coalesce("selected_texts", F.expr("cast(array() as array<string>)")), F.col("options")))
    return m.withColumn("regraded", F.when((F.col("type") != "short") & (F.size("now") > 0), same_answer(F.col("answer"), F.col("now"))))


def remap_options(selected: Column, before: Column, after: Column) -> Column:
    """Selected keys after an edit: the option with the same text and images, else the one with the same key; each once."""
    def mark(o: Column) -> Column:
        return F.to_json(F.struct(trim(F.coalesce(o["text"], F.lit(""))).alias("text"), F.coalesce(o["images"], F.expr("cast(array() as array<string>)")).alias("images")))

    def step(done: Column, key: Column) -> Column:
        old = F.get(F.filter(before, lambda o: o["key"] == key), F.lit(0))
        free = F.filter(after, lambda o: ~F.array_contains(done, o["key"]))
        same = F.get(F.filter(free, lambda o: mark(o) == mark(old)), F.lit(0))["key"]
        kept = F.get(F.filter(free, lambda o: o["key"] == key), F.lit(0))["key"]
        found = F.when(old.isNotNull(), F.coalesce(same, kept))
        return F.when(found.isNull(), done).otherwise(F.concat(done, F.array(found)))

    return F.aggregate(selected, F.expr("cast(array() as array<string>)"), step)


def edit_signature(kind: Column, question: Column, images: Column, options: Column, answer: Column, answer_text: Column) -> Column:
    """Canonical JSON of what an edit can change about grading."""
    none = F.expr("cast(array() as array<string>)")
    plain = F.transform(options, lambda o: F.struct(F.coalesce(o["key"], F.lit("")).alias("key"), F.coalesce(o["text"], F.lit("")).alias("text"), F.coalesce(o["images"], none).alias("images")))
    return F.to_json(F.struct(F.coalesce(kind, F.lit("")).alias("type"), F.coalesce(question, F.lit("")).alias("question"), F.coalesce(images, none).alias("images"), plain.alias("options"), F.array_sort(F.coalesce(answer, none)).alias("answer"), F.coalesce(answer_text, F.lit("")).alias("answerText")))


def clear_scope(cursors: DataFrame, scope: str) -> DataFrame:
    """Cursors without those of one scope."""
    return cursors.filter(F.col("scope_key") != scope)


def cursor_for(scoped: DataFrame, legacy: DataFrame, scope: str) -> DataFrame:
    """Each bank's cursor of a scope, or its old one without scopes."""
    own = scoped.filter(F.col("scope_key") == scope).select("bank_id", F.col("last_order").alias("own"))
    return legacy.select("bank_id", F.col("last_order").alias("old")).join(own, "bank_id", "full").select("bank_id", F.coalesce("own", "old").alias("last_order"))


def sequence(items: DataFrame) -> DataFrame:
    """A session's order as rows (bank_id, pos, question_id, key, ord), to be saved and taken up again."""
    return items.select("bank_id", F.posexplode("questions").alias("pos", "q")).select("bank_id", F.col("pos").alias("pos"), "q.question_id", "q.key", "q.ord")


def original_options(rows: DataFrame, preferred: Column | None = None) -> DataFrame:
    """Options and answer as they were before a shuffle (kept in ``original_options`` and ``original_answer``).

    With ``preferred`` (whether a shuffled order is wanted) only rows that nobody has touched change.
    """
    back = F.col("original_options").isNotNull() if preferred is None else F.col("original_options").isNotNull() & ~preferred & (F.size("selected") == 0)
    return rows.withColumns({c: F.when(back, F.col(f"original_{c}")).otherwise(F.col(c)) for c in ("options", "answer")})
