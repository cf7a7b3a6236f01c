"""The store, records, states and stored rows (survey sections 2.1, 2.8 and 2.11): banks made of suppliers.

Queries of the store save to a folder of their own, change it, and return what a reader then finds;
a supplier is a question, its nation the bank, whose id looks like a number or holds signs that paths don't.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import question as Q
from lectern.functions import text as T
from lectern.operators import demo, options, records, repair, sessions, states, statistics, tabular
from lectern.operators import validate as V
from lectern.operators.storage import Store, read_json, write_json
from lectern.plans import views as v
from lectern.plans.registry import query
from lectern.session import scratch

_OPTIONS = "array<struct<key:string,text:string,images:array<string>>>"
_BANK = "(['00' || s_nationkey, 'a:' || s_nationkey, 'b/' || s_nationkey || '=x'])[s_nationkey % 3 + 1]"
ROWS = f"s AS (SELECT {_BANK} AS bank_id, 'q' || s_suppkey AS question_id, s_name AS question, CASE WHEN s_suppkey % 2 = 0 THEN '旧' ELSE '新' END AS display_label, s_suppkey, s_nationkey FROM supplier)"


def rows(spark, d) -> DataFrame:
    k = F.col("s_nationkey").cast("string")
    bank = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("00"), k)).when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("a:"), k)).otherwise(F.concat(F.lit("b/"), k, F.lit("=x")))
    return v.table(spark, d, "supplier").select(bank.alias("bank_id"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("question_id"), F.col("s_name").alias("question"), F.when(F.col("s_suppkey") % 2 == 0, "旧").otherwise("新").alias("display_label"))


def saved(spark, d) -> Store:
    """A store that holds the rows, in a folder of its own."""
    store = Store(spark, scratch(spark, "store"))
    store.save(rows(spark, d), at=1)
    return store


_FOUND = f"WITH {ROWS} SELECT bank_id, question_id, question, display_label FROM s"
_ONE = "(SELECT min(bank_id) FROM s)"


def _first_bank(store: Store) -> str:
    return store.index().agg(F.min("bank_id")).first()[0]


@query("sink_bank", _FOUND)
def sink_bank(spark, d):
    return saved(spark, d).load()


@query("src_bank", f"WITH {ROWS} SELECT bank_id, question_id, question FROM s WHERE bank_id = {_ONE}")
def src_bank(spark, d):
    store = saved(spark, d)
    return store.load(_first_bank(store)).select("bank_id", "question_id", "question")


@query("bk_load", f"WITH {ROWS} SELECT bank_id, count(*) AS n, string_agg(question_id, ',' ORDER BY question_id) AS ids FROM s GROUP BY 1")
def bk_load(spark, d):
    """Each bank loaded with its rows."""
    return saved(spark, d).load().groupBy("bank_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("question_id")), ",").alias("ids"))


@query("bk_init", "SELECT 0::BIGINT AS banks, 0::BIGINT AS state")
def bk_init(spark, d):
    """A store that nobody has written to."""
    store = Store(spark, scratch(spark, "store"))
    return store.index().agg(F.count("*").alias("banks")).withColumn("state", F.lit(store.snapshot()).cast("long"))


@query("bk_manifest", f"WITH {ROWS} SELECT bank_id, bank_id AS name, 1::BIGINT AS created_at, count(*) AS question_count FROM s GROUP BY 1")
def bk_manifest(spark, d):
    return saved(spark, d).banks().select("bank_id", "name", "created_at", "question_count")


@query("bk_list", f"WITH {ROWS}, b AS (SELECT bank_id, CASE WHEN bank_id = {_ONE} THEN 5 ELSE 1 END AS changed FROM s GROUP BY 1) SELECT bank_id, row_number() OVER (ORDER BY changed DESC, bank_id)::INT AS place FROM b")
def bk_list(spark, d):
    """Banks, the one that was changed last first."""
    store = saved(spark, d)
    store.rename(_first_bank(store), "renamed", at=5)
    return store.banks().select("bank_id", "place")


@query("bk_rename", f"WITH {ROWS} SELECT DISTINCT bank_id, CASE WHEN bank_id = {_ONE} THEN 'renamed' ELSE bank_id END AS name FROM s")
def bk_rename(spark, d):
    """A new name, and a blank one that keeps the old."""
    store = saved(spark, d)
    first = _first_bank(store)
    store.rename(first, " renamed ", at=2)
    store.rename(first, "   ", at=3)
    return store.index().select("bank_id", "name")


@query("bk_catalog", f"WITH {ROWS} SELECT DISTINCT bank_id, display_label AS label FROM s UNION SELECT {_ONE}, unnest(['画图', '旧'])")
def bk_catalog(spark, d):
    """A bank's own types and all labels in use."""
    store = saved(spark, d)
    store.save_types(_first_bank(store), ["画图", "旧"])
    return store.types()


@query("bk_undo_query", f"WITH {ROWS} SELECT unnest(['before', 'after', 'cleared']) AS moment, unnest([false, true, false]) AS can")
def bk_undo_query(spark, d):
    """Whether an edit can be taken back: not before one, after it, not once it is forgotten."""
    store = saved(spark, d)
    one = store.load().orderBy("question_id").limit(1)
    bank, question = one.first()["bank_id"], one.first()["question_id"]
    found = [("before", store.can_undo(bank, question))]
    store.update(spark.createDataFrame(one.collect(), one.schema).withColumn("question", F.lit("edited")), at=2)
    found.append(("after", store.can_undo(bank, question)))
    store.clear_undo(bank, question)
    found.append(("cleared", store.can_undo(bank, question)))
    return spark.createDataFrame(found, "moment string, can boolean")


@query("bk_snapshot", _FOUND)
def bk_snapshot(spark, d):
    """Back to a former state after a bank was deleted."""
    store = saved(spark, d)
    then = store.snapshot()
    store.delete(_first_bank(store))
    store.rollback(then)
    return store.load()


@query("bk_cleanup_legacy", _FOUND)
def bk_cleanup_legacy(spark, d):
    """The index rebuilt from the data alone."""
    store = saved(spark, d)
    store.files.drop(f"{store.path}/pointer")
    store.files.drop(f"{store.path}/index")
    store.rebuild()
    return store.load()


@query("sink_update", f"WITH {ROWS} SELECT bank_id, question_id, CASE WHEN s_suppkey % 3 = 0 THEN 'edited ' || question ELSE question END AS question FROM s")
def sink_update(spark, d):
    store = saved(spark, d)
    store.update(rows(spark, d).filter(F.substring("question_id", 2, 20).cast("long") % 3 == 0).withColumn("question", F.concat(F.lit("edited "), "question")), at=2)
    return store.load().select("bank_id", "question_id", "question")


@query("sink_undo", f"WITH {ROWS}, f AS (SELECT min(question_id) AS one FROM s) SELECT bank_id, question_id, CASE WHEN s_suppkey % 3 = 0 AND question_id <> (SELECT min(question_id) FROM s WHERE s_suppkey % 3 = 0) THEN 'edited' ELSE question END AS question FROM s")
def sink_undo(spark, d):
    """One of the edits taken back, once."""
    store = saved(spark, d)
    edits = rows(spark, d).filter(F.substring("question_id", 2, 20).cast("long") % 3 == 0).withColumn("question", F.lit("edited"))
    store.update(edits, at=2)
    one = edits.orderBy("question_id").first()
    assert store.undo(one["bank_id"], one["question_id"], at=3) and not store.undo(one["bank_id"], one["question_id"], at=4)
    return store.load().select("bank_id", "question_id", "question")


@query("sink_retype", f"WITH {ROWS} SELECT bank_id, question_id, CASE WHEN bank_id = {_ONE} AND display_label = '旧' THEN '填空题' ELSE display_label END AS label FROM s")
def sink_retype(spark, d):
    store = saved(spark, d)
    store.retype(_first_bank(store), "旧", "填空题", at=2)
    return store.load().select("bank_id", "question_id", F.col("display_label").alias("label"))


@query("sink_delete", f"WITH {ROWS} SELECT bank_id, question_id FROM s WHERE NOT starts_with(bank_id, 'b/')")
def sink_delete(spark, d):
    """Banks whose ids hold signs that folders escape are gone, and no others."""
    store = saved(spark, d)
    for r in store.index().filter(F.col("bank_id").startswith("b/")).select("bank_id").collect():
        store.delete(r["bank_id"])
    return store.load().select("bank_id", "question_id")


@query("sink_vacuum", "SELECT unnest(['live', 'freed', 'left']) AS what, unnest([true, true, true]) AS holds")
def sink_vacuum(spark, d):
    """What former states held is freed and counted; the present one stays whole."""
    store = saved(spark, d)
    store.delete(_first_bank(store))
    store.save(store.load().withColumn("question", F.lit("again")), at=2)
    wanted, count = store.reclaimable(), store.load().count()
    freed = store.vacuum()
    return spark.createDataFrame([("live", store.load().count() == count), ("freed", freed == wanted > 0), ("left", store.reclaimable() == 0)], "what string, holds boolean")


@query("sink_archive", f"WITH {ROWS} SELECT bank_id, question_id, question, display_label FROM s WHERE bank_id = {_ONE}")
def sink_archive(spark, d):
    """A bank packed and read by anyone who reads archives."""
    from lectern.sources import archive

    store = saved(spark, d)
    found = archive.banks(store.export(_first_bank(store)))
    return spark.createDataFrame(found[0]["questions"], "bank_id string, question_id string, question string, display_label string")


@query("sink_restore", _FOUND)
def sink_restore(spark, d):
    """A bank exported, deleted and restored; a damaged archive changes nothing."""
    store = saved(spark, d)
    first = _first_bank(store)
    data = store.export(first)
    store.delete(first)
    try:
        store.restore(data[:-1])
        raise AssertionError("a damaged archive was taken")
    except ValueError:
        store.restore(data, at=2)
    return store.load()


@query("sink_json_atomic", "SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def sink_json_atomic(spark, d):
    """A JSON file replaced by another, read back."""
    path = f"{scratch(spark, 'json')}/settings.json"
    write_json(spark, path, {"old": "state"})
    write_json(spark, path, {str(r["n_nationkey"]): r["n_name"] for r in v.table(spark, d, "nation").collect()})
    return spark.createDataFrame(list(read_json(spark, path).items()), "key string, value string")


@query("sink_records", f"WITH {v.RECORDS} SELECT bank_id, question_id, wrong_count FROM wrong WHERE bank_id <> 'src3'")
def sink_records(spark, d):
    """Records by bank as a keyed table; those of a cleared bank are gone."""
    path = f"{scratch(spark, 'records')}/wrong"
    v.records(spark, d)["wrong"].write.parquet(path)
    return records.cleared(spark.read.parquet(path), ["src3"]).select("bank_id", "question_id", "wrong_count")


@query("src_demo", "SELECT unnest([1, 2, 3, 4])::INT AS ord, unnest(['single', 'multiple', 'judge', 'short']) AS type, 'normal' AS status")
def src_demo(spark, d):
    return demo.bank(spark).select("ord", "type", "status")


# --- records --------------------------------------------------------------------------------------
_SAVED = "p AS (SELECT event_id, ts, 'src' || (user_id % 20) AS bank_id, CASE WHEN event_id % 5 = 0 THEN 'random' ELSE 'sequence' END AS mode, event_id % 4 AS answered, type || '|' || (event_id % 3) AS scope_key FROM (SELECT *, event_type AS type FROM events))"
_LATEST = "row_number() OVER (PARTITION BY %s ORDER BY ts DESC, event_id DESC) AS k"


def _progress(spark, d) -> DataFrame:
    e = v.table(spark, d, "events")
    return e.select("event_id", "ts", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("bank_id"), F.when(F.col("event_id") % 5 == 0, "random").otherwise("sequence").alias("mode"), (F.col("event_id") % 4).alias("answered"), F.concat_ws("|", "event_type", (F.col("event_id") % 3).cast("string")).alias("scope_key"))


@query("rec_progress_get", f"WITH {_SAVED} SELECT bank_id, event_id FROM (SELECT *, {_LATEST % 'bank_id'} FROM p) WHERE k = 1 AND mode = 'sequence' AND answered > 0")
def rec_progress_get(spark, d):
    return records.progress(_progress(spark, d)).select("bank_id", "event_id")


@query("rec_progress_clear", f"WITH {_SAVED} SELECT bank_id, event_id FROM p WHERE bank_id NOT IN ('src1', 'src2')")
def rec_progress_clear(spark, d):
    return records.cleared(_progress(spark, d), ["src1", "src2"]).select("bank_id", "event_id")


@query("rec_memorize_get", f"WITH {_SAVED} SELECT bank_id, scope_key, event_id FROM (SELECT *, {_LATEST % 'bank_id, scope_key'} FROM p) WHERE k = 1")
def rec_memorize_get(spark, d):
    return records.memorized(_progress(spark, d)).select("bank_id", "scope_key", "event_id")


@query("rec_memorize_clear", f"WITH {_SAVED} SELECT bank_id, scope_key, event_id FROM p WHERE bank_id NOT IN (SELECT 'src' || s_nationkey FROM supplier)")
def rec_memorize_clear(spark, d):
    """Cursors without those of the banks in a table."""
    gone = v.table(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("bank_id"))
    return records.cleared(_progress(spark, d), gone).select("bank_id", "scope_key", "event_id")


@query("rec_memorize_clear_scope", f"WITH {_SAVED} SELECT bank_id, scope_key, event_id FROM p WHERE scope_key <> 'click|1'")
def rec_memorize_clear_scope(spark, d):
    return states.clear_scope(_progress(spark, d), "click|1").select("bank_id", "scope_key", "event_id")


@query("rec_settings", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN c_mktsegment ELSE 'AUTOMOBILE' END AS theme, least(greatest(c_nationkey, 5), 20) AS size, 50 AS count FROM customer")
def rec_settings(spark, d):
    """Defaults under stored values; values out of their choices go back, out of their range are clamped."""
    stored = v.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("theme"), F.col("c_nationkey").alias("size"), F.lit(None).cast("int").alias("count"))
    return records.settings(stored, {"c_custkey": -1, "theme": "AUTOMOBILE", "size": 10, "count": 50}, choices={"theme": ["MACHINERY", "BUILDING"]}, ranges={"size": (5, 20)})


@query("rec_clear", f"WITH {v.RECORDS} SELECT 'wrong' AS kind, count(*) AS n FROM wrong WHERE bank_id <> 'src7' UNION ALL SELECT 'favorite', 0 UNION ALL SELECT 'mastered', count(*) FROM mastered")
def rec_clear(spark, d):
    """One bank's wrong questions cleared, all favourites, no mastered ones."""
    rec = v.records(spark, d)
    left = {"wrong": records.cleared(rec["wrong"], ["src7"]), "favorite": records.cleared(rec["favorite"]), "mastered": records.cleared(rec["mastered"], [])}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_PAYLOADS = f"WITH {v.RECORDS} SELECT 'wrong' AS kind, bank_id, question_id, wrong_count FROM wrong UNION ALL SELECT 'mastered', bank_id, question_id, NULL FROM mastered"


def _exported(spark, d) -> DataFrame:
    rec = v.records(spark, d)
    return records.exported({"wrong": rec["wrong"].select("bank_id", "question_id", "wrong_count"), "mastered": rec["mastered"].select("bank_id", "question_id")})


@query("rec_export", _PAYLOADS)
def rec_export(spark, d):
    """All records as one table of JSON payloads, whose fields any reader finds."""
    read = F.from_json("payload", "bank_id string, question_id long, wrong_count long")
    return _exported(spark, d).select("kind", "bank_id", read["question_id"].alias("question_id"), read["wrong_count"].alias("wrong_count"))


@query("rec_import", _PAYLOADS)
def rec_import(spark, d):
    """Records written to one payload and read back by kind."""
    path = f"{scratch(spark, 'records')}/all"
    _exported(spark, d).write.parquet(path)
    back = records.imported(spark.read.parquet(path), {"wrong": "bank_id string, question_id long, wrong_count long", "mastered": "bank_id string, question_id long"})
    return back["wrong"].withColumn("kind", F.lit("wrong")).unionByName(back["mastered"].withColumn("kind", F.lit("mastered")), allowMissingColumns=True).select("kind", "bank_id", "question_id", "wrong_count")


# --- states ---------------------------------------------------------------------------------------
def _items(spark, d) -> DataFrame:
    """Questions of three options whose texts name the supplier, with what a learner chose."""
    none = F.expr("cast(array() as array<string>)")
    made = [F.struct(F.lit(k).alias("key"), F.concat(F.lit(t), F.col("s_name")).alias("text"), none.alias("images")) for k, t in (("A", "x "), ("B", "y "), ("C", "z "))]
    s = v.table(spark, d, "supplier")
    chosen = F.when(F.col("s_suppkey") % 3 == 0, none).when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit("C")))
    return s.select("s_suppkey", F.lit("single").alias("type"), F.array(*made).alias("options"), F.array(F.lit("B")).alias("answer"), chosen.alias("selected"), (F.col("s_suppkey") % 6 == 3).alias("revealed"))


def _after_edit(items: DataFrame) -> DataFrame:
    """The same options in another order with other keys: y first, x second, and a new one in z's place."""
    o, none = F.col("options"), F.expr("cast(array() as array<string>)")
    return items.withColumn("now_options", F.array(F.struct(F.lit("A").alias("key"), o[1]["text"].alias("text"), none.alias("images")), F.struct(F.lit("B").alias("key"), o[0]["text"].alias("text"), none.alias("images")), F.struct(F.lit("C").alias("key"), F.lit("new").alias("text"), none.alias("images"))))


@query("st_build", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'y ' || s_name ELSE 'x ' || s_name || '|z ' || s_name END AS texts FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 6 = 3")
def st_build(spark, d):
    """States of answered or revealed questions, with the texts of what was chosen."""
    return states.build(_items(spark, d)).select("s_suppkey", F.array_join("selected_texts", "|").alias("texts"))


@query("st_restore", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 1 THEN 'A' ELSE 'B' END AS now, s_suppkey % 3 = 1 AS regraded FROM supplier WHERE s_suppkey % 3 <> 0")
def st_restore(spark, d):
    """Choices found by their texts under new keys, graded against the answer of now."""
    kept = states.build(_items(spark, d)).filter(F.size("selected") > 0)
    now = _after_edit(_items(spark, d)).select("s_suppkey", F.col("now_options").alias("options"))
    back = states.restore(kept.join(now, "s_suppkey").withColumn("answer", F.array(F.lit("A"))))
    return back.select("s_suppkey", F.array_join("now", "").alias("now"), "regraded")


@query("join_option_remap", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'BC' END AS now FROM supplier")
def join_option_remap(spark, d):
    """Chosen keys after an edit: by text and pictures, else the same key; each once."""
    e = _after_edit(_items(spark, d))
    return e.select("s_suppkey", F.array_join(states.remap_options(F.col("selected"), F.col("options"), F.col("now_options")), "").alias("now"))


@query("st_cursor", "SELECT s_suppkey::VARCHAR AS bank_id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 100 + s_nationkey END AS last_order FROM supplier")
def st_cursor(spark, d):
    """The cursor of a scope, or the old one without scopes."""
    s = v.table(spark, d, "supplier").withColumn("bank_id", F.col("s_suppkey").cast("string"))
    scoped = s.filter("s_suppkey % 2 = 0").select("bank_id", F.lit("all|0").alias("scope_key"), F.col("s_nationkey").alias("last_order")).unionByName(s.select("bank_id", F.lit("judge|0").alias("scope_key"), F.lit(999).alias("last_order")))
    return states.cursor_for(scoped, s.select("bank_id", (F.col("s_nationkey") + 100).alias("last_order")), "all|0")


@query("st_sequence", "SELECT s_nationkey::VARCHAR AS bank_id, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name DESC) - 1)::INT AS pos, s_suppkey AS question_id, s_name AS key, s_suppkey AS ord FROM supplier")
def st_sequence(spark, d):
    """A bank's order as rows, to be saved."""
    s = v.table(spark, d, "supplier")
    made = s.groupBy(F.col("s_nationkey").cast("string").alias("bank_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("s_name").alias("key"), F.col("s_suppkey").alias("question_id"), F.col("s_suppkey").alias("ord"))), asc=False).alias("questions"))
    return states.sequence(made)


@query("join_saved_sequence", """WITH q AS (SELECT s_nationkey::VARCHAR AS bank_id, s_suppkey AS question_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name DESC) AS pos, s_suppkey % 3 = 0 AS lost FROM supplier)
  SELECT bank_id, question_id, row_number() OVER (PARTITION BY bank_id ORDER BY lost, CASE WHEN lost THEN 0 ELSE pos END, CASE WHEN lost THEN md5('7:' || question_id) ELSE '' END)::BIGINT AS position FROM q""")
def join_saved_sequence(spark, d):
    """Questions in a saved order: by id, or by key where the id has changed; those that no entry takes follow shuffled."""
    s = v.table(spark, d, "supplier").withColumn("bank_id", F.col("s_nationkey").cast("string"))
    qs = s.select("bank_id", F.col("s_suppkey").alias("question_id"), F.col("s_name").alias("key"), F.col("s_suppkey").alias("ord"))
    saved_ = st_sequence(spark, d).filter("question_id % 3 <> 0").withColumn("question_id", F.when(F.col("question_id") % 3 == 1, -1).otherwise(F.col("question_id")))
    return sessions.saved_sequence(qs, saved_, "7")


@query("st_option_restore", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'x ' ELSE 'z ' END || s_name AS first, CASE WHEN s_suppkey % 3 = 0 THEN 'B' ELSE 'A' END AS answer FROM supplier")
def st_option_restore(spark, d):
    """Options in their original order again, for questions that nobody has touched."""
    i = _items(spark, d)
    turned = i.withColumns({"original_options": F.col("options"), "original_answer": F.col("answer")}).withColumns({"options": F.reverse("options"), "answer": F.array(F.lit("A"))})
    back = states.original_options(turned, F.lit(False))
    return back.select("s_suppkey", F.col("options")[0]["text"].alias("first"), F.array_join("answer", "").alias("answer"))


@query("fn_edit_signature", "SELECT s_suppkey, true AS order_alike, false AS text_alike FROM supplier")
def fn_edit_signature(spark, d):
    """The same for an answer in another order, another for another text."""
    i, none = _items(spark, d), F.expr("cast(array() as array<string>)")

    def sign(answer, extra=""):
        return states.edit_signature(F.col("type"), F.concat(F.lit("q" + extra), F.col("s_suppkey").cast("string")), none, F.col("options"), answer, F.lit(None).cast("string"))

    one, other = sign(F.array(F.lit("A"), F.lit("B"))), sign(F.array(F.lit("B"), F.lit("A")))
    return i.select("s_suppkey", (one == other).alias("order_alike"), (one == sign(F.array(F.lit("A"), F.lit("B")), "x")).alias("text_alike"))


# --- stored rows and options ----------------------------------------------------------------------
def _rows(spark, d, cases: list[dict]) -> DataFrame:
    """Each case once for each supplier; ``{n}`` in its texts is the supplier's name."""
    from lectern.plans.parsing import spark_text, suppliers

    made = []
    for k, c in enumerate(cases):
        opts = [F.struct(F.lit(key).alias("key"), spark_text(text).alias("text"), F.array(*map(F.lit, images)).cast("array<string>").alias("images")) for key, text, images in c.get("options", [])]
        made.append(F.struct(
            F.lit(k).alias("case"), F.lit(c.get("type", "single")).alias("type"), spark_text(c.get("question", "{n}")).alias("question"), (F.array(*opts) if opts else F.array()).cast(_OPTIONS).alias("options"),
            F.array(*map(F.lit, c.get("answer", []))).cast("array<string>").alias("answer"), spark_text(c.get("answer_text", "")).alias("answer_text"), F.array(*map(spark_text, c.get("raw", []))).cast("array<string>").alias("raw_texts"), F.lit(bool(c.get("placeholder"))).alias("placeholder"),
            F.array(*map(F.lit, c.get("images", []))).cast("array<string>").alias("images"),
        ))
    return suppliers(spark, d).select("path", F.explode(F.array(*made)).alias("r")).select("path", "r.*")


def _expect(columns: dict[str, list[str]]) -> str:
    """SQL: for each supplier the cases' values (templates) of each column."""
    from lectern.plans.parsing import sql_text

    n = len(next(iter(columns.values())))
    fields = ", ".join(f'unnest([{", ".join(sql_text(x) for x in values)}]) AS "{name}"' for name, values in columns.items())
    return f'SELECT s_suppkey::VARCHAR AS path, unnest(range({n}))::INT AS "case", {fields} FROM supplier'


def _shown(df: DataFrame, *more) -> DataFrame:
    return df.select("path", "case", F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["key"], o["text"])), "|").alias("options"), *more)


_AB = [("A", "{n}", []), ("B", "other", [])]


@query("fn_repair_short", _expect({"question": ["什么是{n}？", "什么是{n}？还是那个呢？", "{n}", "什么是{n}？"], "text": ["因为它在这里很久了", "", "", "已有的答案"]}))
def fn_repair_short(spark, d):
    cases = [{"type": "short", "question": "什么是{n}？因为它在这里很久了"}, {"type": "short", "question": "什么是{n}？还是那个呢？"}, {"type": "short", "question": "{n}"}, {"type": "short", "question": "什么是{n}？", "answer_text": "已有的答案"}]
    return repair.short_answers(_rows(spark, d, cases)).select("path", "case", "question", F.col("answer_text").alias("text"))


@query("fn_repair_choice", _expect({
    "type": ["judge", "multiple", "judge", "single", "single", "single", "short"], "question": ["{n}", "{n}", "{n}", "选{n}（）", "{n}", "{n}", "{n}"],
    "options": ["A:正确|B:错误", "A:{n}|B:other", "A:对|B:错", "A:x|B:y z|C:w", "A:|B:other", "A:{n}|B:other", ""], "answer": ["B", "AB", "A", "C", "A", "A", ""],
}))
def fn_repair_choice(spark, d):
    """Judgements get both options, types follow answers and options, options come out of the question, figure words go."""
    cases = [
        {"type": "judge", "options": [("A", "错误", [])]}, {"type": "choice_error", "options": _AB, "answer": ["A", "B"]}, {"type": "multiple", "options": [("A", "对", []), ("B", "错", [])], "answer": ["A"]},
        {"type": "single", "question": "选{n}（） A. x B. y z C. w", "answer": ["C"]}, {"type": "single", "options": [("A", "图形", ["p.png"]), ("B", "other", [])], "answer": ["A"]},
        {"type": "judge", "options": _AB, "answer": ["A"]}, {"type": "short", "placeholder": True},
    ]
    return _shown(repair.choices(_rows(spark, d, cases)), "type", "question", F.array_join("answer", "").alias("answer"))


@query("fn_repair_options", _expect({"options": ["A:{n} whole text|B:other", "A:{n}|B:own text", "A:{n} goes on further|B:other", "A:正确|B:错误", "A:{n}|B:y"]}))
def fn_repair_options(spark, d):
    """Cut and doubled options have their own line's text again; what goes on beyond a line, and judgements, stay."""
    cases = [
        {"options": [("A", "{n} wh", []), ("B", "other", [])], "raw": ["A. {n} whole text\nB. other"]}, {"options": [("A", "{n}", []), ("B", "{n}", [])], "raw": ["A. {n}", "B. own text"]},
        {"options": [("A", "{n} goes on further", []), ("B", "other", [])], "raw": ["A. {n}", "goes on further", "B. other"]}, {"type": "judge", "options": [("A", "正确", []), ("B", "错误", [])], "raw": ["A.正确B.错误"]},
        {"options": [("A", "{n}", []), ("B", "y", [])], "raw": ["A. {n}B. y"]},
    ]
    return _shown(options.repaired(_rows(spark, d, cases)))


@query("fn_repair_known_docx", _expect({"options": ["A:{n}|B:other|C:same|D:known text", "A:{n}|B:other|C:same|D:apart"]}))
def fn_repair_known_docx(spark, d):
    """A table of known repairs, brought by the caller: where the question fits and an option repeats another's text."""
    rules = [("known question", "D", "C", "known text")]
    cases = [{"question": "a known question of {n}", "options": [*_AB, ("C", "same", []), ("D", "same", [])]}, {"question": "a known question of {n}", "options": [*_AB, ("C", "same", []), ("D", "apart", [])]}]
    return _shown(options.repaired(_rows(spark, d, cases), rules))


@query("fn_missing_visual", _expect({"issues": ["图片选项缺少图像", "", ""], "status": ["warning", "normal", "normal"]}))
def fn_missing_visual(spark, d):
    cases = [{"question": "哪个图是{n}", "options": [("A", "图形", []), ("B", "图", [])], "answer": ["A"]}, {"question": "哪个图是{n}", "options": [("A", "图形", ["a"]), ("B", "图", [])], "answer": ["A"], "images": ["q"]}, {"question": "哪个图是{n}", "options": [("A", "图", []), ("B", "{n}", [])], "answer": ["A"]}]
    return V.validate(_rows(spark, d, cases)).select("path", "case", F.array_join("issues", ";").alias("issues"), "status")


@query("val_visual", "SELECT s_suppkey, unnest(['图形', '（图）。', '见图', '图纸', s_name]) AS text, unnest([true, true, true, false, false]) AS figure FROM supplier")
def val_visual(spark, d):
    rows_ = v.table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.lit("图形"), F.lit("（图）。"), F.lit("见图"), F.lit("图纸"), F.col("s_name"))).alias("text"))
    return rows_.select("s_suppkey", "text", V.figure(T.one_line(F.col("text"))).alias("figure"))


_RAW = [{"raw": ["A. {n}\nB、short", "(B) a longer one", "C plain {n}", "no option"]}]


@query("fn_raw_option_map", "SELECT s_suppkey::VARCHAR AS path, unnest(['A', 'B', 'B', 'C']) AS key, unnest([lower(s_name), 'short', 'alongerone', 'plain' || lower(s_name)]) AS sig FROM supplier")
def fn_raw_option_map(spark, d):
    """What each line gives for a key."""
    return _rows(spark, d, _RAW).select("path", F.explode(V.read_raw(F.col("raw_texts"))).alias("r")).select("path", "r.key", "r.sig")


@query("val_best_raw", "SELECT s_suppkey::VARCHAR AS path, unnest(['A', 'B', 'C', 'D']) AS key, unnest([lower(s_name), 'alongerone', 'plain' || lower(s_name), '']) AS sig FROM supplier")
def val_best_raw(spark, d):
    """The longest text that lines give for a key."""
    r = _rows(spark, d, _RAW).select("path", V.read_raw(F.col("raw_texts")).alias("raw"), F.explode(F.array(*map(F.lit, "ABCD"))).alias("key"))
    return r.select("path", "key", V.best_raw(F.col("raw"), F.col("key")).alias("sig"))


@query("fn_option_signature", "SELECT s_suppkey, lower(s_name) || 'a-b' AS sig FROM supplier")
def fn_option_signature(spark, d):
    return v.table(spark, d, "supplier").select("s_suppkey", T.option_signature(F.concat(F.lit("（"), "s_name", F.lit("）：Ａ　– b。"))).alias("sig"))


@query("fn_order_dependent", _expect({"fixed": ["true", "false", "true"]}))
def fn_order_dependent(spark, d):
    cases = [{"options": [*_AB, ("C", "以上都是", [])]}, {"options": _AB}, {"options": [("A", "{n}全部正确", [])]}]
    return _rows(spark, d, cases).select("path", "case", Q.order_dependent(F.col("options")).cast("string").alias("fixed"))


# --- tables' functions ----------------------------------------------------------------------------
def _values(spark, d, values: list[str], f, name: str = "out") -> DataFrame:
    """A function of each of some texts; ``{n}`` is the supplier's name."""
    from lectern.plans.parsing import spark_text, suppliers

    rows_ = suppliers(spark, d).select("path", F.posexplode(F.array(*map(spark_text, values))).alias("case", "t"))
    return rows_.select("path", F.col("case").cast("int").alias("case"), f(F.col("t")).alias(name))


@query("fn_header_class", _expect({"out": ["option:A", "option:B", "question", "answer", "analysis", "type", "difficulty", "category", "combined_options", "number", None]}))
def fn_header_class(spark, d):
    return _values(spark, d, ["备选项A", "B选项", "题 干", "标准答案：", "（解析）", "试题类型", "难易度", "知识点", "选项", "题号", "{n}"], Q.header_class)


@query("fn_difficulty", _expect({"out": ["简单", "中等", "困难", "L{k}", ""]}))
def fn_difficulty(spark, d):
    return _values(spark, d, [" 容易 ", "一般", "高级", "L{k}", "{n} is no level at all"], Q.difficulty)


@query("fn_type_info", _expect({"out": ["multiple/多选题", "judge/判断题", "single/单选题", "short/填空题", "short/画图题", "short/计算题", "short/问答题", ""]}))
def fn_type_info(spark, d):
    return _values(spark, d, ["多项选择", "对错题", "单选", "填空", "作图题", "计算题", "问答题（10分）", "{n}"], lambda t: F.concat_ws("/", *Q.type_of_label(t)))


@query("fn_truth", _expect({"out": ["true", "false", "true", "false", None, "true", "false"]}))
def fn_truth(spark, d):
    return _values(spark, d, [" √ ", "错误", "true", "F", "{n}", "是", "❌"], lambda t: Q.truth(t).cast("string"))


@query("fn_answer_keys", _expect({"out": ["AC", "B", "ABC", "A", "B", ""]}))
def fn_answer_keys(spark, d):
    """Letters among the options, all of them, or the option that says the truth value."""
    keys, truths = F.array(*map(F.lit, "ABC")), F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))

    def named(t):
        kind = F.when(t.isin("对", "错"), "judge").otherwise("multiple")
        return F.array_join(tabular.answer_keys(t, keys, truths, kind), "")

    return _values(spark, d, ["A、C", "b z", "全选", "对", "错", "X"], named)


@query("fn_combined_options", _expect({"out": ["A:{n}|B:y|C:z", "A:x B y", "A:甲|B:乙；"]}))
def fn_combined_options(spark, d):
    return _values(spark, d, ["A. {n} B、y C)z", "A. x B y", "D. no A. 甲 B、乙；"], lambda t: F.array_join(F.transform(Q.combined_options(t), lambda o: F.concat_ws(":", o["key"], o["text"])), "|"))


@query("fn_category", "SELECT s_suppkey, unnest([s_name || ' · 章', s_name, '单选题', '章']) AS out FROM supplier")
def fn_category(spark, d):
    forms = F.array(*(F.struct(F.lit(own).alias("own"), F.lit(several).alias("several")) for own, several in (("章", True), ("", True), ("", False), ("章", False))))
    s = v.table(spark, d, "supplier").select("s_suppkey", "s_name", F.explode(forms).alias("f"))
    return s.select("s_suppkey", tabular.category(F.col("s_name"), F.col("f.own"), F.col("f.several"), F.lit("单选题")).alias("out"))


@query("fn_issue_kinds", _expect({"out": ["missingAnswer|answerMismatch", "sourceOptionDuplicate|possibleOptionDuplicate", "other"]}))
def fn_issue_kinds(spark, d):
    return _values(spark, d, ["无答案;答案不符（C）;缺少答案", "导入片段重复（A、B）;疑似重复（C、D）", "{n}"], lambda t: F.array_join(Q.issue_kinds(F.split(t, ";")), "|"))


@query("fn_normalize_issues", _expect({"out": ["导入片段重复（A、B）", "答案不符（C、D）", "无答案", "选项不足（答案 C 无对应选项）", "判断选项异常", "选项不足", "{n}|题干过长", "答案不符"]}))
def fn_normalize_issues(spark, d):
    """Issues that others make superfluous are merged or left out."""
    given = ["选项内容重复;导入片段重复（A、B）", "答案不符（C）;答案不符（d）", "无答案;缺少答案;答案不符（C）", "选项不足;答案不符（C）", "选项不足;判断选项异常", "选项少于两个;选项不足", "• {n};{n};题干过长", "答案不符;答案 x 不在选项中"]
    return _values(spark, d, given, lambda t: F.array_join(Q.normalize_issues(F.split(t, ";")), "|"))


@query("fn_fnv1a", _expect({"out": ["2166136261", "3826002220", "3214735720"]}))
def fn_fnv1a(spark, d):
    """Published values of the 32-bit hash: of nothing, of "a" and of "foobar"."""
    return _values(spark, d, ["", "a", "foobar"], lambda t: Q.fnv1a(t).cast("string"))


@query("fn_ids", "SELECT s_suppkey, 'q_' || substr(sha256(s_suppkey || chr(31) || s_name), 1, 24) AS id FROM supplier")
def fn_ids(spark, d):
    return v.table(spark, d, "supplier").select("s_suppkey", Q.stable_id("q", F.col("s_suppkey"), F.col("s_name")).alias("id"))


# --- imports --------------------------------------------------------------------------------------
@query("imp_counts", f"WITH {v.QUESTIONS} SELECT count(*) AS total, count(*) FILTER (status = 'normal') AS normal, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'error') AS error, count(*) FILTER (NOT placeholder AND status <> 'error') AS usable, count(*) FILTER (placeholder) AS missing FROM q")
def imp_counts(spark, d):
    return statistics.status_counts(v.questions(spark, d))


@query("imp_diag", "SELECT s_suppkey, 'a' AS key, 2::BIGINT AS n FROM supplier UNION ALL SELECT s_suppkey, 'b', s_nationkey::BIGINT FROM supplier UNION ALL SELECT s_suppkey, 'c', 3 FROM supplier")
def imp_diag(spark, d):
    """Diagnostics of several steps as one; what a later one says counts, a missing one says nothing."""
    one = F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.col("s_nationkey").cast("long"))
    two = F.create_map(F.lit("a"), F.lit(2).cast("long"), F.lit("c"), F.lit(3).cast("long"))
    return v.table(spark, d, "supplier").select("s_suppkey", F.explode(statistics.merged(one, two, F.lit(None).cast("map<string,bigint>"))).alias("key", "n"))


@query("imp_labels", _expect({"name": ["DOCX", "TXT", "文件"], "piece": ["原始 DOCX 文本片段", "原始 XLSX 行", "原始文件片段"]}))
def imp_labels(spark, d):
    names = _values(spark, d, ["{n}.docx", "a.b.txt", "{n}"], Q.extension_label, "name")
    return names.join(_values(spark, d, ["docx", "xlsx", ""], Q.fragment_label, "piece"), ["path", "case"])


@query("imp_simple", "SELECT n_name || '.txt' AS file, 'judge' AS type, n_name || '是对的。' AS question, 'A' AS answer FROM nation")
def imp_simple(spark, d):
    """Files in a folder to validated questions in one call."""
    from lectern.operators import imports

    folder = scratch(spark, "files")

    def write(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [f"一、判断题\n1. {n}是对的。（√）\n" for n in pdf["n_name"]], "n_name": pdf["n_name"]})

    files = v.table(spark, d, "nation").select("n_name").mapInPandas(write, "value string, n_name string").collect()
    store = Store(spark, folder)
    for r in files:
        store.files.write(f"{folder}/{r['n_name']}.txt", r["value"].encode())
    q = imports.questions(spark, folder)
    return q.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "type", "question", F.array_join("answer", "").alias("answer"))


@query("bk_images", "SELECT s_suppkey::VARCHAR AS path, 'new/q.png' AS images, 'new/a.png' AS options FROM supplier")
def bk_images(spark, d):
    """Every path of a picture rewritten: of the question and of its options."""
    r = _rows(spark, d, [{"options": [("A", "图", ["a.png"])], "images": ["q.png"]}])
    moved = repair.images(r, lambda p: F.concat(F.lit("new/"), p))
    return moved.select("path", F.array_join("images", ";").alias("images"), F.array_join(F.flatten(F.transform("options", lambda o: o["images"])), ";").alias("options"))


@query("bk_refs", "SELECT s_suppkey::VARCHAR AS bank_id, unnest(['a.png', 'q.png']) AS image FROM supplier")
def bk_refs(spark, d):
    r = _rows(spark, d, [{"options": [("A", "图", ["a.png"]), ("B", "图", ["a.png"])], "images": ["q.png"]}])
    return repair.referenced_images(r.withColumn("bank_id", F.col("path")))
