"""Chat preferences, URL templates, nearest neighbours, the registered queries and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, chat_preference
from lectern.llm import url_templates as urls

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


# --- chat -----------------------------------------------------------------------------------------
def pair(spark, chosen, rejected):
    rows = [(1, "shared", s, t, r, x) for s, side in (("chosen", chosen), ("rejected", rejected)) for t, (r, x) in enumerate(side)]
    return chat_preference.format_pairs(spark.createDataFrame(rows, "pair_id long, kind string, side string, turn long, role string, text string"))


def test_common_prefix(spark):
    u, a = ("user", "q"), ("assistant", "a")
    got = chat_preference.assemble(pair(spark, [u, a, u, ("assistant", "good")], [u, a, u, ("assistant", "bad"), u])).first()
    assert got["prompt"] == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nq<|end|>\n"
    assert got["chosen"] == "<|assistant|>\ngood<|end|>\n" and got["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\nq<|end|>\n"
    assert [m["loss"] for m in got["rejected_mask"]] == [1, 0]
    same = chat_preference.assemble(pair(spark, [u, a], [u, a])).first()
    assert same["chosen"] == same["rejected"] == "" and same["prompt"]
    differ = chat_preference.assemble(pair(spark, [u, a], [("user", "other"), a])).first()
    assert differ["prompt"] == "" and differ["chosen"].endswith("a<|end|>\n")


def test_preferences_cover_every_conversation(spark):
    rows = [(i, t, "assistant" if t % 2 else "user", f"common {t}" if i < 40 and t < 3 else f"{i} {t}") for i in range(60) for t in range(1 + i % 5)]
    rows += [(1, 0, "user", "common 0"), (70, None, None, None), (None, 0, "user", "lost")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    turns = chat_preference.turns_of(c)
    pairs = chat_preference.pair_up(turns).collect()
    used = [p["chosen"] for p in pairs] + [p["rejected"] for p in pairs if p["kind"] == "shared"]
    assert sorted(used) == [*range(60), 70]
    out = chat_preference.preferences(c).collect()
    assert {r["pair_id"] for r in out} == {p["chosen"] for p in pairs}
    assert all(r["loss"] == 0 for r in out if r["segment"] == "prompt")
    assert chat_preference.preferences(c.limit(0)).count() == 0


# --- urls -----------------------------------------------------------------------------------------
RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([k for k in (tail.find(c) for c in "?#") if k >= 0] or [len(tail)])]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_rules_and_purity(spark):
    given = ["http://A.Example.NET/en/1?x=/", "https://x.net/", "https://x.net", "http://example.com/de/a#b", "http://notexample.com/de/a", "x.org/fr/", "http://u.org/fr/?q", None, "", "a://b://c/d", "http://h?x/y", "http://İ.org/fr/"]
    rows = [(i, u, None) for i, u in enumerate(given)]
    rows += [(100 + i, f"http://site.info/bad/{i}", 1) for i in range(30)] + [(200 + i, f"http://site.info/good/{i}", 0) for i in range(30)] + [(300, "http://site.info/bad/x9", None), (301, "http://site.info/good/77", None)]
    rows += [(400 + i, f"http://many.info/w{chr(97 + i % 26)}{chr(97 + i // 26)}/p", 0) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad int").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.judge(pages, RULES, F.col("bad")).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(given):
        host, path, rule, verdict = slow(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert verdict is None or got[i]["verdict"] == verdict
    assert got[100]["verdict"] == got[300]["verdict"] == "block" and got[200]["verdict"] == got[301]["verdict"] == "allow"
    assert len({got[400 + i]["template"] for i in range(60)}) == 1
    assert urls.judge(pages.limit(0), RULES, F.col("bad")).count() == 0


# --- neighbours -----------------------------------------------------------------------------------
def brute(rows, k=5):
    out = {}
    for i, q in rows:
        if i % 50 == 0:
            q = np.array(q, float)
            near = sorted((-float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for j, v in ((j, np.array(v, float)) for j, v in rows) if j != i)
            out[i] = near[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1100] = x[3]  # a very common vector
    x[1200:1300] = x[5] * 2
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2050, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, None] * 8), (2100, [1.0] * 3), (2005, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    vectors = ann.usable(df)
    assert vectors.count() == 1500
    got = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 50 = 0"), max_sample=600).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = brute(good)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    assert got[700] == want[700]  # copies: ties go to the smaller id
    few = vectors.filter("vec_id < 3")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 2
    none = vectors.limit(0)
    assert ann.search(none, none).count() == 0


# --- the queries and the pipeline -----------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_queries_run(spark):
    from lectern.llm.queries import QUERIES

    docs = spark.read.parquet(f"{DIR}/documents.parquet").count()
    for name, f in QUERIES.items():
        rows = f(spark, DIR).count()
        assert rows
        if name in ("op3_pii", "op4_unigram", "op5_quality", "op6_toxicity", "op7_media", "op8_simhash"):
            assert rows == docs


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    now, kept = docs, {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, now, LARGER)
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept[name] <= {r["doc_id"] for r in now.select("doc_id").collect()}
        now = spark.createDataFrame(out.collect(), docs.schema)
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.filter("toxic = 0 AND quality = 1").collect()}
    assert len(toxic & kept["toxicity"]) <= 0.3 * len(toxic)
    assert len(clean & kept["quality"]) >= 0.9 * len(clean)
    pieces = p.STAGES[-1][1](spark, now, LARGER)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == kept["pii"]
