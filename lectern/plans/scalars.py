"""Scalar functions, projections and text sources over the test tables (survey sections 2.1, 2.2 and 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import question as Q
from lectern.functions import text as T
from lectern.operators import validate as V
from lectern.plans import views as v
from lectern.plans.registry import query

_PUNCT = r"""[\s\x{00A0}\x{3000}\x{FEFF}，。；：！？、,.!?;:''"“”‘’（）()【】\[\]［］_-]"""
_D = "documents"
_QO = f"WITH {v.QUESTIONS}, {v.OPTIONS}"


@query("fn_half_width", "SELECT doc_id, translate(text, 'ＡＢＣａｂｃ０１２', 'ABCabc012') AS out FROM documents")
def fn_half_width(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.half_width(F.col("text")).alias("out"))


@query("fn_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS out FROM pages")
def fn_strip_tags(spark, d):
    return v.table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("out"))


@query("fn_subsequence", "SELECT doc_id, regexp_matches(text, 'q.*z.*k', 's') AS hit FROM documents")
def fn_subsequence(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.subsequence(F.col("text"), "qzk").alias("hit"))


@query("fn_compact", f"SELECT doc_id, lower(regexp_replace(text, '{_PUNCT}', '', 'g')) AS out FROM documents")
def fn_compact(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.compact(F.col("text")).alias("out"))


@query("fn_signature", f"SELECT doc_id, substr(lower(regexp_replace(text, '{_PUNCT}', '', 'g')), 1, 300) AS out FROM documents")
def fn_signature(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.signature(F.col("text")).alias("out"))


_ENTITIES = """replace(replace(replace(replace(replace(%s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')"""


@query("fn_xml_entities", f"SELECT page_id, {_ENTITIES % 'html'} || '<A中中😀&#0;&nope;&#xD800;' AS out FROM pages")
def fn_xml_entities(spark, d):
    """Named entities, then numeric ones, which an ``&amp;`` may have hidden; what stands for no character stays."""
    return v.table(spark, d, "pages").select("page_id", T.xml_entities(F.concat("html", F.lit("&lt;&amp;#65;&#x4E2D;&#20013;&#x1F600;&#0;&nope;&#xD800;"))).alias("out"))


_TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(%s, chr(160), ' '), '[ \t\f\v]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '[\s\x{3000}]+([，。；：！？、])', '\1', 'g'), '([（(【\[])[ \t]+', '\1', 'g'), '[ \t]+([）)】\]])', '\1', 'g'), chr(32) || chr(10))"""
#: what documents write, and what normalising makes of it
_LABELS = [("【 答案 】 A、C", "答案：A、C"), ("（参考答案）：", " 参考答案："), ("[解析]", " 解析："), ("答案（B）", "答案：B"), ("正确 答 案 为 ：", " 答案："), ("Ａ１ｂ", " A1b"), ("中\u200b文", " 中文"), ("中文题目".encode().decode("latin-1"), " 中文题目")]


@query("fn_normalize_text", f"SELECT doc_id, {_TIDY % 'text'} AS out FROM documents UNION ALL SELECT -1 - s_suppkey * {len(_LABELS)} - i, s_name || ([{', '.join(repr(b) for _, b in _LABELS)}])[i + 1] FROM supplier, range({len(_LABELS)}) t(i)")
def fn_normalize_text(spark, d):
    """The documents' texts, and labels, widths, invisible and broken characters after each supplier's name."""
    forms = F.array(*(F.lit(a) for a, _ in _LABELS))
    made = v.table(spark, d, "supplier").select("s_suppkey", "s_name", F.posexplode(forms).alias("i", "form")).select((-1 - F.col("s_suppkey") * len(_LABELS) - F.col("i")).alias("doc_id"), F.concat("s_name", F.lit(" "), "form").alias("text"))
    return v.table(spark, d, _D).select("doc_id", "text").unionByName(made).select("doc_id", T.normalize(F.col("text")).alias("out"))


@query("fn_one_line", rf"SELECT doc_id, trim(regexp_replace(regexp_replace({_TIDY % 'text'}, '\n+', ' ', 'g'), '[\s\x{{3000}}]{{2,}}', ' ', 'g'), ' ') AS out FROM documents")
def fn_one_line(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.one_line(F.col("text")).alias("out"))


@query("fn_mojibake", r"SELECT doc_id, text AS out FROM documents WHERE NOT regexp_matches(text, '[^\x{00}-\x{FF}]')")
def fn_mojibake(spark, d):
    """Texts whose UTF-8 was read as a single-byte code come back; texts without such characters stay."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return v.table(spark, d, _D).filter(~F.col("text").rlike(r"[^\x{00}-\x{FF}]")).select("doc_id", T.repair_mojibake(broken).alias("out"))


@query("fn_known_notation", "SELECT s_suppkey, unnest(['whole', 'clean', 'other']) AS form, unnest(['see ' || s_name || ' reads well.', 'see AB is well.', s_name]) AS out FROM supplier")
def fn_known_notation(spark, d):
    """A table of known sentences: one that carries marks of damage is written out, others stay."""
    s, rules = v.table(spark, d, "supplier"), [(r"AB[^.]*\.", "%s")]
    forms = F.array(F.struct(F.lit("whole").alias("form"), F.lit("see AB�ö±²� damaged.").alias("t")), F.struct(F.lit("clean").alias("form"), F.lit("see AB is well.").alias("t")), F.struct(F.lit("other").alias("form"), F.col("s_name").alias("t")))
    rows = s.select("s_suppkey", "s_name", F.explode(forms).alias("f")).select("s_suppkey", "s_name", "f.*")
    return rows.select("s_suppkey", "form", F.replace(T.known_sentence(F.col("t"), rules), F.lit("%s"), F.concat("s_name", F.lit(" reads well."))).alias("out"))


@query("fn_bracket_label", "SELECT s_suppkey, unnest(['参考答案：', '解析：', '答案：', '答案：', s_name]) || s_name AS out FROM supplier")
def fn_bracket_label(spark, d):
    forms = F.array(F.lit("【参考答案】："), F.lit("(答案解析)"), F.lit("［标准答案］"), F.lit("（ 答 ）:"), F.col("s_name"))
    return v.table(spark, d, "supplier").select("s_suppkey", F.explode(forms).alias("f"), "s_name").select("s_suppkey", T.bracket_label(F.concat("f", "s_name")).alias("out"))


_NORM = r"""lower(regexp_replace(regexp_replace(%s, '[\s\x{00A0}\x{3000}\x{FEFF}]+', '', 'g'), '[，。；：、“”‘’（）()《》【】\[\]·,.!?！？;:''"`~\-—_]', '', 'g'))"""


@query("fn_progress_key", f"WITH {v.QUESTIONS} SELECT question_id, type || '|' || {_NORM % 'category'} || '|' || substr({_NORM % 'question'}, 1, 180) AS key FROM q")
def fn_progress_key(spark, d):
    return v.questions(spark, d).select("question_id", T.progress_key(F.col("type"), F.col("category"), F.col("question")).alias("key"))


@query("fn_safe_name", r"""SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN trim(url, ' ') = '' THEN '题库' ELSE substr(regexp_replace(trim(url, ' '), '[\\/:*?"<>|]', '_', 'g'), 1, 60) END AS out FROM pages""")
def fn_safe_name(spark, d):
    return v.table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("out"))


@query("fn_list_start", f"WITH {v.PARAGRAPHS} SELECT doc_id, idx, regexp_matches(trim(text, ' '), '^([0-9]{{1,3}}[.、．)）]|[（(][0-9]{{1,3}}[）)]|[-—•·])') AS item FROM p")
def fn_list_start(spark, d):
    return v.paragraphs(spark, d).select("doc_id", "idx", T.list_start(F.col("text")).alias("item"))


_LINES = rf"list_filter(list_transform(string_split({_TIDY % 'text'}, chr(10)), lambda l: trim(regexp_replace(l, '[\s\x{{3000}}]{{2,}}', ' ', 'g'), ' ')), lambda l: l <> '')"
_ITEM = r"regexp_matches(b, '^([0-9]{1,3}[.、．)）]|[（(][0-9]{1,3}[）)]|[①-⑩]|[一二三四五六七八九十]+[、.．]|[-—•·])')"
_SPACED = "regexp_matches(a, '[A-Za-z0-9%℃°)]$') AND regexp_matches(b, '^[A-Za-z0-9(]')"


def _joined(gap: str) -> str:
    """SQL of a text's lines joined one by one: a is what there is, b the next line."""
    return f"SELECT doc_id, list_reduce({_LINES}, lambda a, b: a || {gap} || b) AS out FROM documents WHERE len({_LINES}) > 0"


_RUN_ON = f"CASE WHEN {_SPACED} THEN ' ' ELSE '' END"


@query("fn_smart_join", _joined(_RUN_ON))
def fn_smart_join(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.smart_join(F.split("text", "\n")).alias("out")).filter("out <> ''")


@query("fn_clean_question", _joined(_RUN_ON))
def fn_clean_question(spark, d):
    """Lines run on, without the label before them."""
    lines = F.split(F.concat(F.lit("题目：\n"), "text"), "\n")
    return v.table(spark, d, _D).select("doc_id", T.clean_question(lines).alias("out")).filter("out <> ''")


@query("fn_clean_answer", _joined("CASE WHEN regexp_matches(a, '[，,：:]$') THEN '' ELSE chr(10) END"))
def fn_clean_answer(spark, d):
    """A point a line, but where the line before ends in a comma."""
    lines = F.split(F.concat(F.lit("答案："), "text"), "\n")
    return v.table(spark, d, _D).select("doc_id", T.clean_answer(lines).alias("out")).filter("out <> ''")


@query("fn_clean_analysis", _joined(f"CASE WHEN {_ITEM} THEN chr(10) WHEN {_SPACED} THEN ' ' ELSE '' END"))
def fn_clean_analysis(spark, d):
    """Lines run on, items of lists keep theirs."""
    lines = F.split(F.concat(F.lit("解析："), "text"), "\n")
    return v.table(spark, d, _D).select("doc_id", T.clean_analysis(lines).alias("out")).filter("out <> ''")


_ANOMALY = "regexp_matches(%s, '[�-]|(Ã.|Â.|â€|ä¸|å[\x80-\xbf]|æ[\x80-\xbf]|ç[\x80-\xbf]|ï¿½)|煾{2,}|[A-Za-z0-9.]ö[±²³A-Za-z0-9.]?|[±²³]ö|ö{2,}')"


@query("fn_encoding_anomaly", f"SELECT doc_id, {_ANOMALY % 'text'} AS bad FROM documents")
def fn_encoding_anomaly(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.encoding_anomaly(F.col("text")).alias("bad"))


@query("fn_format_date", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def fn_format_date(spark, d):
    return v.table(spark, d, "events").select("event_id", T.format_date(F.col("ts")).alias("shown"))


@query("fn_format_bytes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 10240 THEN printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) || ' KB' WHEN n < 1048576 THEN printf('%.0f', floor(n / 1024.0 + 0.5)) || ' KB' ELSE printf('%.1f', floor(n / 1048576.0 * 10 + 0.5) / 10) || ' MB' END AS shown FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def fn_format_bytes(spark, d):
    return v.table(spark, d, _D).select("doc_id", T.format_bytes(F.octet_length("text")).alias("shown"))


@query("fn_scope_key", f"WITH {v.QUESTIONS} SELECT question_id, type || '|' || n_chars AS key, 'order|' || type || '|' || n_chars AS ordered FROM q")
def fn_scope_key(spark, d):
    q = v.questions(spark, d)
    return q.select("question_id", Q.scope_key(F.col("type"), F.col("n_chars")).alias("key"), Q.scope_key(F.col("type"), F.col("n_chars"), True).alias("ordered"))


def _picked():
    return F.array(F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("question_id") % 3 + 1).cast("int")))


_PICKED = "[(['A','B','C','D'])[(question_id % 3 + 1)::INT]]"


@query("fn_same_answer", f"{_QO} SELECT question_id, list_sort(answer) = list_sort({_PICKED}) AS same FROM o")
def fn_same_answer(spark, d):
    return v.options(v.questions(spark, d)).select("question_id", Q.same_answer(F.col("answer"), _picked()).alias("same"))


_SELF = "CASE WHEN question_id % 8 = 3 THEN 'mastered' WHEN question_id % 8 = 7 THEN 'again' END"


def _self():
    return F.when(F.col("question_id") % 8 == 3, "mastered").when(F.col("question_id") % 8 == 7, "again")


@query("fn_judge", f"{_QO} SELECT question_id, CASE WHEN type = 'short' THEN coalesce({_SELF} = 'mastered', false) ELSE list_sort(answer) = list_sort({_PICKED}) END AS correct FROM o")
def fn_judge(spark, d):
    return v.options(v.questions(spark, d)).select("question_id", Q.judge(F.col("type"), F.col("answer"), _picked(), _self()).alias("correct"))


@query("fn_status", f"WITH {v.QUESTIONS}, s AS (SELECT question_id, type, CASE WHEN question_id % 5 = 0 THEN NULL ELSE question_id % 2 = 0 END AS c, question_id % 11 = 0 AS r, {_SELF} AS self FROM q) SELECT question_id, CASE WHEN NOT (CASE WHEN type = 'short' THEN coalesce(self, '') <> '' ELSE c IS NOT NULL AND NOT r END) THEN 'unanswered' WHEN coalesce(c, false) THEN 'correct' ELSE 'wrong' END AS st FROM s")
def fn_status(spark, d):
    c = F.when(F.col("question_id") % 5 != 0, F.col("question_id") % 2 == 0)
    return v.questions(spark, d).select("question_id", Q.answer_status(F.col("type"), c, F.col("question_id") % 11 == 0, _self()).alias("st"))


@query("fn_conf_bucket", f"WITH {v.QUESTIONS} SELECT question_id, CASE WHEN confidence_x100 < 45 THEN 'low' WHEN confidence_x100 < 75 THEN 'medium' ELSE 'high' END AS bucket FROM q")
def fn_conf_bucket(spark, d):
    return v.questions(spark, d).select("question_id", Q.confidence_bucket(F.col("confidence_x100")).alias("bucket"))


@query("fn_name_class", "SELECT c_custkey, CASE WHEN length(c_name) > 19 THEN 'bank-name-compact' WHEN length(c_name) > 18 THEN 'bank-name-medium' ELSE 'bank-name-normal' END AS cls FROM customer")
def fn_name_class(spark, d):
    return v.table(spark, d, "customer").select("c_custkey", Q.name_class(F.col("c_name")).alias("cls"))


@query("fn_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def fn_content_hash(spark, d):
    return v.table(spark, d, _D).select("doc_id", Q.content_hash(F.col("text")).alias("hash"))


@query("prj_display", f"WITH {v.QUESTIONS} SELECT question_id, CASE WHEN display_label <> '' THEN display_label WHEN type = 'single' THEN '单选题' WHEN type = 'multiple' THEN '多选题' WHEN type = 'judge' THEN '判断题' ELSE '简答题' END AS label FROM q")
def prj_display(spark, d):
    return v.questions(spark, d).select("question_id", Q.display_label(F.col("display_label"), Q.type_label(F.col("type")), F.col("type")).alias("label"))


@query("prj_answer_display", f"{_QO} SELECT question_id, CASE WHEN answer_text <> '' THEN answer_text ELSE array_to_string(answer, '、') END AS shown FROM o")
def prj_answer_display(spark, d):
    return v.options(v.questions(spark, d)).select("question_id", Q.answer_display(F.col("answer_text"), F.col("answer")).alias("shown"))


@query("prj_source_format", "SELECT page_id, CASE WHEN regexp_matches(lower(split_part(url, '?', 1)), '[.]html?$') THEN 'text' ELSE 'other' END AS family FROM pages")
def prj_source_format(spark, d):
    name = F.regexp_extract(F.split("url", r"\?")[0], r"([^/]*)\z", 1)
    return v.table(spark, d, "pages").select("page_id", Q.source_format(name, F.lit("")).alias("family"))


@query("prj_option_state", f"{_QO}, e AS (SELECT question_id, i, (['A','B','C','D'])[i] AS k, answer, {_PICKED} AS picked FROM o, LATERAL (SELECT unnest(range(1, len(opts) + 1)) AS i)) SELECT question_id, k AS key, CASE WHEN list_contains(answer, k) AND list_contains(picked, k) THEN 'chosen-correct' WHEN list_contains(answer, k) THEN 'correct' WHEN list_contains(picked, k) THEN 'chosen-wrong' ELSE '' END AS state FROM e")
def prj_option_state(spark, d):
    o = v.options(v.questions(spark, d))
    return o.select("question_id", F.explode(Q.option_state(F.col("options"), F.col("answer"), _picked())).alias("s")).select("question_id", "s.key", "s.state")


@query("prj_search_text", f"WITH {v.QUESTIONS} SELECT question_id, lower(regexp_replace(concat_ws(' ', ord::VARCHAR, category, type, CASE WHEN display_label <> '' THEN display_label END, CASE WHEN difficulty <> '' THEN difficulty END, question), '{_PUNCT}', '', 'g')) AS out FROM q")
def prj_search_text(spark, d):
    cols = (F.col("ord").cast("string"), F.col("category"), F.col("type"), F.col("display_label"), F.col("difficulty"), F.col("question"))
    return v.questions(spark, d).select("question_id", T.search_text(*cols).alias("out"))


@query("prj_compact", f"WITH {v.QUESTIONS} SELECT question_id, CASE WHEN status = 'normal' THEN 0 ELSE least(8, len(string_split(question, chr(10)))) END::INT AS kept FROM q")
def prj_compact(spark, d):
    raw = F.split("question", "\n")
    kept = F.when(F.col("status") == "normal", F.slice(raw, 1, 0)).otherwise(F.slice(raw, 1, 8))
    return v.questions(spark, d).select("question_id", F.size(kept).alias("kept"))


_SIGN = r"""translate(lower(regexp_replace(t, '[\s\x{00A0}\x{3000}\x{FEFF}，,。；;：:''"“”‘’（）()【】\[\]［］]', '', 'g')), '−–—', '---')"""
_VALID = rf"""{_QO}, k AS (SELECT *, list_transform(range(1, len(opts) + 1), lambda i: (['A','B','C','D'])[i]) AS keys, list_transform(opts, lambda t: {_SIGN}) AS sigs, type = 'short' AS short FROM o),
  b AS (SELECT *, list_filter(answer, lambda a: NOT list_contains(keys, a)) AS bad,
    list_transform(list_filter(range(1, len(sigs) + 1), lambda i: sigs[i] <> '' AND list_position(sigs, sigs[i]) = i AND len(list_filter(sigs, lambda x: x = sigs[i])) > 1), lambda i: sigs[i]) AS twice FROM k),
  i AS (SELECT *, [
    CASE WHEN length(question) < 4 THEN '题干缺失或过短|45' END, CASE WHEN regexp_matches(question, '(答案|参考答案|解析)\s*[:：]') THEN '题干中仍残留答案或解析标记|18' END,
    CASE WHEN short AND regexp_replace(answer_text, '\s', '', 'g') = '' THEN '无答案|35' END, CASE WHEN NOT short AND len(bad) > 0 THEN '答案不符（' || array_to_string(bad, '、') || '）|40' END,
    CASE WHEN list_contains(opts, '') THEN '空白选项|15' END]
    || list_transform(twice, lambda s: '疑似重复（' || array_to_string(list_filter(keys, lambda x, n: sigs[n] = s), '、') || '）|' || CASE WHEN s = twice[1] THEN '18' ELSE '0' END) || [
    CASE WHEN length(question) > 1000 THEN '题干过长|25' END, CASE WHEN length(answer_text) > 3000 THEN '答案过长|20' END, CASE WHEN {_ANOMALY % "question || ' ' || array_to_string(opts, ' ') || ' ' || answer_text"} THEN '字符映射异常|22' END,
    CASE WHEN type = 'multiple' AND len(answer) < 2 THEN '多选仅一项|15' END, CASE WHEN type = 'judge' THEN '判断选项异常|15' END] AS found FROM b),
  s AS (SELECT question_id, type, list_transform(list_filter(found, lambda x: x IS NOT NULL), lambda x: string_split(x, '|')) AS parts FROM i),
  z AS (SELECT question_id, array_to_string(list_transform(parts, lambda x: x[1]), ';') AS issues, greatest(0, 100 - coalesce(list_sum(list_transform(parts, lambda x: x[2]::INT)), 0))::INT AS confidence_x100 FROM s)
  SELECT *, CASE WHEN confidence_x100 < 45 THEN 'error' WHEN issues <> '' THEN 'warning' ELSE 'normal' END AS status FROM z"""


@query("fn_validate", _VALID)
def fn_validate(spark, d):
    q = v.options(v.questions(spark, d).drop("status", "confidence_x100"))
    return V.validate(q).select("question_id", F.array_join("issues", ";").alias("issues"), "confidence_x100", "status")


@query("src_txt", f"WITH {v.PARAGRAPHS} SELECT doc_id, idx, trim(text, ' ') AS text FROM p WHERE trim(text, ' ') <> ''")
def src_txt(spark, d):
    return v.paragraphs(spark, d).select("doc_id", "idx", F.trim("text").alias("text")).filter("text <> ''")
