"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table, and derives the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, chat_preference, media, oracles, packing, pii, quality, simhash, toxicity, unigram
from lectern.llm import url_templates as urls
from lectern.llm.common import crc32_id, read


def op1_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_preference.preferences(read(spark, sf_dir, "conversations"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = unigram.pieces()
    encoded = unigram.encode(read(spark, sf_dir, "documents"), model)
    decoded = unigram.decode(encoded, model)
    return decoded.select("doc_id", "n_ids", "n_fallback", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("decoded_chars"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = crc32_id(F.col("doc_id")) % 4 == 2
    model = quality.train(docs, labels, where=~held_out)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = crc32_id(F.col("doc_id")) % 5 == 0
    model = toxicity.train(docs, labels, where=~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    sniffed = media.sniff(media.store(read(spark, sf_dir, "documents")))
    carved = F.array_join(F.transform("carved", lambda c: F.concat(c["type"], F.lit("@"), c["offset"].cast("string"), F.lit("+"), c["length"].cast("string"))), ";")
    size = F.length("samples").cast("long")
    return sniffed.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", "declared", "type", carved).alias("feature"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


URL_RULES = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow")]
#: Runs of marks and shouted words, which give a page away as junk.
_JUNK = r"[%$#*]{3}|&amp;&amp;&amp;|[A-Z]!!"
_JUNK_MARKS = 8


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    junk = F.when(F.col("html").isNotNull(), (F.regexp_count("html", F.lit(_JUNK)) >= _JUNK_MARKS).cast("int"))
    return urls.judge(pages, URL_RULES, junk)


QUERIES = {
    "op1_chat_preference": op1_chat_preference,
    "op3_pii": op3_pii,
    "op4_unigram": op4_unigram,
    "op7_media": op7_media,
    "op9_ann": op9_ann,
    "op10_url_templates": op10_url_templates,
    "op2_packing": op2_packing,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op8_simhash": op8_simhash,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_preference": oracles.CHAT,
    "op10_url_templates": oracles.url_templates(URL_RULES, _JUNK, _JUNK_MARKS),
}
