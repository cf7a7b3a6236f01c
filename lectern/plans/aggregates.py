"""Aggregations, rankings and statistics (survey sections 2.4 and 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import question as Q
from lectern.operators import records as R
from lectern.operators import search as find
from lectern.operators import statistics as S
from lectern.operators import validate as V
from lectern.plans import views as v
from lectern.plans.registry import micros, query

ACC = "CASE WHEN answered > 0 THEN floor(100.0 * correct / answered + 0.5) ELSE 0 END::BIGINT AS accuracy"
DAYS = "strftime(day, '%Y-%m-%d')"


@query("agg_metric", f"SELECT category, answered, correct, {ACC} FROM (SELECT lang AS category, count(*) AS answered, sum(quality)::BIGINT AS correct FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def agg_metric(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", F.col("lang").alias("category")).join(v.table(spark, d, "labels"), "doc_id")
    return S.metric(rows, "category", F.col("quality"))


@query("agg_type_counts", f"WITH {v.QUESTIONS} SELECT t AS type, count(q.type)::BIGINT AS n FROM (SELECT unnest(['single','multiple','judge','short','choice_error']) AS t) s LEFT JOIN (SELECT * FROM q WHERE NOT placeholder) q ON q.type = s.t GROUP BY 1")
def agg_type_counts(spark, d):
    return S.seeded_counts(v.questions(spark, d).filter(~F.col("placeholder")), F.col("type"), tuple(Q.TYPE_LABELS), "type")


@query("agg_status_counts", f"WITH {v.QUESTIONS} SELECT t AS status, count(q.status)::BIGINT AS n FROM (SELECT unnest(['normal','warning','error']) AS t) s LEFT JOIN q ON q.status = s.t GROUP BY 1")
def agg_status_counts(spark, d):
    return S.seeded_counts(v.questions(spark, d), F.col("status"), ("normal", "warning", "error"), "status")


@query("agg_label_counts", f"WITH {v.QUESTIONS} SELECT CASE WHEN display_label <> '' THEN display_label ELSE type END AS label, count(*) AS n FROM q GROUP BY 1")
def agg_label_counts(spark, d):
    return v.questions(spark, d).groupBy(Q.display_label(F.col("display_label"), F.col("type")).alias("label")).agg(F.count("*").alias("n"))


@query("agg_difficulty_counts", f"WITH {v.QUESTIONS} SELECT difficulty, count(*) AS n FROM q WHERE difficulty <> '' GROUP BY 1")
def agg_difficulty_counts(spark, d):
    return v.questions(spark, d).filter("difficulty <> ''").groupBy("difficulty").agg(F.count("*").alias("n"))


@query("agg_category_counts", f"WITH {v.QUESTIONS} SELECT category, count(*) AS n FROM q WHERE category <> '' GROUP BY 1")
def agg_category_counts(spark, d):
    return v.questions(spark, d).filter("category <> ''").groupBy("category").agg(F.count("*").alias("n"))


@query("agg_manifest", f"WITH {v.QUESTIONS} SELECT bank_id, count(*) AS question_count, count(*) FILTER (NOT placeholder AND status <> 'error') AS usable_count, count(*) FILTER (NOT placeholder) AS content_count, count(*) FILTER (placeholder) AS missing_count FROM q GROUP BY 1")
def agg_manifest(spark, d):
    return S.manifest(v.questions(spark, d))


_BUCKETS = f"""WITH {v.ANSWERS} SELECT dimension, key, count(*) AS answered, count(*) FILTER (correct) AS correct FROM (
  SELECT 'day' AS dimension, {DAYS} AS key, correct FROM a UNION ALL SELECT 'bank_id', bank_id, correct FROM a UNION ALL SELECT 'type_label', type_label, correct FROM a
  UNION ALL SELECT 'difficulty', difficulty, correct FROM a UNION ALL SELECT 'category', category, correct FROM a) WHERE key <> '' GROUP BY 1, 2"""


@query("agg_bucket", _BUCKETS)
def agg_bucket(spark, d):
    return R.buckets(v.answers(spark, d))


@query("agg_summary", f"""WITH {v.QUESTIONS}, {v.RECORDS} SELECT (SELECT count(DISTINCT bank_id) FROM q) AS bank_count, (SELECT count(*) FROM q) AS question_count,
  (SELECT count(*) FROM a) AS answered, (SELECT count(*) FROM a WHERE correct) AS correct, (SELECT count(DISTINCT day) FROM a) AS study_days,
  (SELECT count(*) FROM wrong) AS wrong_count, (SELECT count(*) FROM favorite) AS favorite_count, (SELECT count(*) FROM mastered) AS mastered_count,
  (SELECT floor(100.0 * count(*) FILTER (correct) / count(*) + 0.5)::BIGINT FROM a) AS accuracy""")
def agg_summary(spark, d):
    rec, a, q = v.records(spark, d), v.answers(spark, d), v.questions(spark, d)
    one = [
        q.agg(F.countDistinct("bank_id").alias("bank_count"), F.count("*").alias("question_count")),
        a.agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"), F.countDistinct("day").alias("study_days")),
        *(rec[k].agg(F.count("*").alias(f"{k}_count")) for k in ("wrong", "favorite", "mastered")),
    ]
    out = one[0].withColumn("one", F.lit(1))
    for x in one[1:]:  # one row each
        out = out.join(x.withColumn("one", F.lit(1)), "one")
    return out.drop("one").withColumn("accuracy", S.accuracy(F.col("correct"), F.col("answered")))


@query("agg_study_days", f"WITH {v.ANSWERS} SELECT {DAYS} AS day, count(*) AS n FROM a GROUP BY 1")
def agg_study_days(spark, d):
    return v.answers(spark, d).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("agg_wrong", f"WITH {v.RECORDS} SELECT bank_id, question_id, wrong_count, epoch_us(last_wrong_at) AS last_wrong_us FROM wrong")
def agg_wrong(spark, d):
    return v.records(spark, d)["wrong"].select("bank_id", "question_id", "wrong_count", micros(F.col("last_wrong_at")).alias("last_wrong_us"))


@query("agg_wrong_groups", f"WITH {v.RECORDS} SELECT bank_id, count(*) AS n FROM wrong ANTI JOIN mastered USING (bank_id, question_id) GROUP BY 1")
def agg_wrong_groups(spark, d):
    rec = v.records(spark, d)
    return R.remove(rec["wrong"], rec["mastered"]).groupBy("bank_id").agg(F.count("*").alias("n"))


for _name in ("favorite", "mastered"):

    @query(f"agg_{_name}_groups", f"WITH {v.RECORDS} SELECT bank_id, count(*) AS n FROM {_name} GROUP BY 1")
    def _groups(spark, d, _name=_name):
        return v.records(spark, d)[_name].groupBy("bank_id").agg(F.count("*").alias("n"))


_ITEMS = f"{v.ANSWERS}, {v.QUESTIONS}, items AS (SELECT learner_id AS session_id, q.type, CASE WHEN a.value > 100 THEN NULL ELSE a.correct END AS correct FROM a JOIN q ON a.question_id = q.question_id)"


def _items(spark, d):
    a = v.answers(spark, d).select(F.col("learner_id").alias("session_id"), "question_id", F.when(F.col("value") <= 100, F.col("correct")).alias("correct"))
    return a.join(v.questions(spark, d).select("question_id", "type"), "question_id")


@query("agg_exam_score", f"""WITH {_ITEMS} SELECT *, CASE WHEN objective_total > 0 THEN floor(100.0 * correct / objective_total + 0.5) ELSE 0 END::BIGINT AS accuracy FROM (
  SELECT session_id, count(*) FILTER (type <> 'short') AS objective_total, count(*) FILTER (type <> 'short' AND correct IS NOT NULL) AS answered,
  count(*) FILTER (type <> 'short' AND correct) AS correct, count(*) FILTER (type = 'short') AS short_count FROM items GROUP BY 1)""")
def agg_exam_score(spark, d):
    return S.exam_score(_items(spark, d))


@query("agg_practice_score", f"WITH {_ITEMS} SELECT session_id, answered, correct, {ACC} FROM (SELECT session_id, count(correct) AS answered, count(*) FILTER (correct) AS correct FROM items GROUP BY 1)")
def agg_practice_score(spark, d):
    return S.with_accuracy(_items(spark, d).groupBy("session_id").agg(F.count("correct").alias("answered"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct")))


@query("agg_furthest", f"WITH {v.ANSWERS} SELECT bank_id, max(question_id + 1) FILTER (correct) AS furthest FROM a GROUP BY 1")
def agg_furthest(spark, d):
    return v.answers(spark, d).groupBy("bank_id").agg(F.max(F.when(F.col("correct"), F.col("question_id") + 1)).alias("furthest"))


@query("agg_type_options", f"WITH {v.QUESTIONS} SELECT CASE WHEN display_label <> '' THEN display_label ELSE type END AS label, count(*) AS n FROM q WHERE status = 'normal' GROUP BY 1 UNION ALL SELECT 'abnormal', count(*) FROM q WHERE status <> 'normal'")
def agg_type_options(spark, d):
    q = v.questions(spark, d)
    normal = q.filter("status = 'normal'").groupBy(Q.display_label(F.col("display_label"), F.col("type")).alias("label")).agg(F.count("*").alias("n"))
    return normal.unionByName(q.filter("status <> 'normal'").agg(F.count("*").alias("n")).select(F.lit("abnormal").alias("label"), "n"))


@query("agg_size", "SELECT source, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def agg_size(spark, d):
    return v.table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))


_SIGN = r"""translate(lower(regexp_replace(%s, '[\s\x{00A0}\x{3000}\x{FEFF}，,。；;：:''"“”‘’（）()【】\[\]［］]', '', 'g')), '−–—', '---')"""
_GROUPS = f"""e AS (SELECT question_id, i, {_SIGN % 'opts[i]'} AS sig FROM o, LATERAL (SELECT unnest(range(1, len(opts) + 1)) AS i)),
  g AS (SELECT question_id, sig, string_agg((['A','B','C','D'])[i], '、' ORDER BY i) AS keys, min(i) AS first FROM e WHERE sig <> '' GROUP BY 1, 2 HAVING count(*) > 1)"""


@query("agg_dup_options", f"WITH {v.QUESTIONS}, {v.OPTIONS}, {_GROUPS} SELECT question_id, string_agg(keys, ';' ORDER BY first) AS keys FROM g GROUP BY 1")
def agg_dup_options(spark, d):
    o = v.options(v.questions(spark, d)).withColumn("read", V.read_options(F.col("options")))
    keys = F.array_join(F.transform(V.duplicate_keys(F.col("read")), lambda g: F.array_join(g["keys"], "、")), ";")
    return o.select("question_id", keys.alias("keys")).filter("keys <> ''")


_KINDS = "CASE WHEN status = 'error' THEN ['missingAnswer'] ELSE [] END || CASE WHEN status <> 'normal' AND n_chars > 1000 THEN ['boundary'] ELSE [] END"
_BUCKET = "CASE WHEN confidence_x100 < 45 THEN 'low' WHEN confidence_x100 < 75 THEN 'medium' ELSE 'high' END"
_LABEL = "CASE WHEN display_label <> '' THEN display_label ELSE type END"


def reviewed(spark, d):
    q = v.questions(spark, d)
    issues = F.array_compact(F.array(F.when(F.col("status") == "error", "无答案"), F.when((F.col("status") != "normal") & (F.col("n_chars") > 1000), "题干过长")))
    return q.withColumn("issues", issues).withColumn("kinds", Q.issue_kinds(issues)).withColumn("bucket", Q.confidence_bucket(F.col("confidence_x100"))).withColumn("type_label", Q.display_label(F.col("display_label"), F.col("type")))


_REVIEWED = f"{v.QUESTIONS}, r AS (SELECT *, {_KINDS} AS kinds, {_BUCKET} AS bucket, {_LABEL} AS type_label FROM q), b AS (SELECT * FROM r WHERE status <> 'normal')"


@query("agg_facets", f"""WITH {_REVIEWED} SELECT 'confidence' AS facet, bucket AS key, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'issue', k, count(*) FROM (SELECT unnest(kinds) AS k FROM b WHERE bucket = 'low') GROUP BY 2
  UNION ALL SELECT 'type', type_label, count(*) FROM b WHERE bucket = 'low' AND list_contains(kinds, 'boundary') GROUP BY 2""")
def agg_facets(spark, d):
    return find.facets(reviewed(spark, d), "abnormal", "low", "boundary")


@query("agg_issue_labels", f"WITH {_REVIEWED}, i AS (SELECT bank_id, k, CASE WHEN k = 'boundary' THEN '题干过长' ELSE '无答案' END AS label FROM (SELECT bank_id, unnest(kinds) AS k FROM b)) SELECT k AS kind, count(DISTINCT label) AS labels, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE k END AS caption FROM i GROUP BY 1")
def agg_issue_labels(spark, d):
    i = reviewed(spark, d).filter("status <> 'normal'").select(F.explode("issues").alias("label")).withColumn("kind", Q.issue_kind(F.col("label")))
    return i.groupBy("kind").agg(F.countDistinct("label").alias("labels"), F.min("label").alias("m")).select("kind", "labels", F.when(F.col("labels") == 1, F.col("m")).otherwise(F.col("kind")).alias("caption"))


# --- top-k ----------------------------------------------------------------------------------------
_RANKED = f"{v.ANSWERS}, c AS (SELECT category AS key, count(*) AS answered, count(*) FILTER (correct) AS correct FROM a WHERE category <> '' GROUP BY 1), r AS (SELECT *, {ACC} FROM c)"
_ORDER = "answered DESC, accuracy, key"


def _ranked(spark, d):
    return S.ranked(R.bucket(v.answers(spark, d), "category"))


@query("top_bucket_rows", f"WITH {_RANKED} SELECT *, row_number() OVER (ORDER BY {_ORDER})::INT AS rank FROM r")
def top_bucket_rows(spark, d):
    return S.ranking(R.bucket(v.answers(spark, d), "category"))


@query("top_categories", f"WITH {_RANKED} SELECT *, row_number() OVER (ORDER BY {_ORDER})::INT AS rank FROM r QUALIFY rank <= 12")
def top_categories(spark, d):
    return S.top(_ranked(spark, d), 12, F.desc("answered"), F.asc("accuracy"), F.asc("key"))


@query("top_weak", f"WITH {_RANKED}, t AS (SELECT * FROM r ORDER BY {_ORDER} LIMIT 12) SELECT *, row_number() OVER (ORDER BY accuracy, answered DESC, key)::INT AS rank FROM t QUALIFY rank <= 8")
def top_weak(spark, d):
    twelve = S.top(_ranked(spark, d), 12, F.desc("answered"), F.asc("accuracy"), F.asc("key")).drop("rank")
    return S.top(twelve, 8, F.asc("accuracy"), F.desc("answered"), F.asc("key"))


_DAILY = f"{v.ANSWERS}, s AS (SELECT {DAYS} AS key, count(*) AS answered, count(*) FILTER (correct) AS correct FROM a GROUP BY 1), r AS (SELECT *, {ACC} FROM s)"
for _n in (30, 7):

    @query(f"top_recent{_n}", f"WITH {_DAILY} SELECT * FROM r ORDER BY key DESC LIMIT {_n}")
    def _recent(spark, d, _n=_n):
        return S.with_accuracy(R.bucket(v.answers(spark, d), "day")).orderBy(F.desc("key")).limit(_n)


@query("top_review", f"WITH {v.QUESTIONS} SELECT question_id, status, confidence_x100, row_number() OVER (ORDER BY confidence_x100, ord)::INT AS rank FROM q WHERE status <> 'normal'")
def top_review(spark, d):
    from lectern.operators.sequence import numbered, runs

    q = v.questions(spark, d).filter("status <> 'normal'").select("question_id", "status", "confidence_x100", "ord")
    return numbered(q, [], [F.asc("confidence_x100"), F.asc("ord")], "rank", F.struct("confidence_x100", runs("ord"))).drop("ord")


@query("top_mastered", f"WITH {v.RECORDS} SELECT bank_id, question_id, row_number() OVER (PARTITION BY bank_id ORDER BY since DESC, question_id)::INT AS rank FROM mastered")
def top_mastered(spark, d):
    from lectern.operators.sequence import numbered

    return numbered(v.records(spark, d)["mastered"], ["bank_id"], [F.desc("since"), F.asc("question_id")], "rank", -F.unix_date(F.to_date("since"))).select("bank_id", "question_id", "rank")


@query("top_page", f"WITH {v.QUESTIONS} SELECT question_id FROM q WHERE status <> 'normal' ORDER BY confidence_x100, ord LIMIT 50 OFFSET 50")
def top_page(spark, d):
    return v.questions(spark, d).filter("status <> 'normal'").orderBy("confidence_x100", "ord").offset(50).limit(50).select("question_id")


@query("top_recent_banks", f"WITH {v.ANSWERS} SELECT bank_id, epoch_us(max(ts)) AS last_us FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_recent_banks(spark, d):
    return v.answers(spark, d).groupBy("bank_id").agg(micros(F.max("ts")).alias("last_us")).orderBy(F.desc("last_us"), "bank_id").limit(3)


@query("top_cursor", f"WITH {v.ANSWERS} SELECT bank_id, arg_max(question_id, struct_pack(t := ts, e := event_id)) AS question_id, max(event_id) AS event_id FROM a GROUP BY 1")
def top_cursor(spark, d):
    c = R.cursor(v.answers(spark, d).select("bank_id", "question_id", "ts", "event_id"))
    return c.select("bank_id", "question_id", "event_id")


@query("fn_metric_by_learner", f"WITH {v.ANSWERS} SELECT learner_id, answered, correct, {ACC} FROM (SELECT learner_id, count(*) AS answered, count(*) FILTER (correct) AS correct FROM a GROUP BY 1)")
def fn_metric_by_learner(spark, d):
    return S.metric(v.answers(spark, d), "learner_id", F.col("correct").cast("int"))
