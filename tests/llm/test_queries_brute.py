"""The registered queries without SQL against brute force, on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def result(spark, name):
    from lectern.llm.queries import QUERIES

    return QUERIES[name](spark, DIR).collect()


def test_op2_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for d, t in texts.items()}
    pieces, sequences = {d: [] for d in ids}, {}
    for r in result(spark, "op2_packing"):
        pieces[r["doc_id"]].append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    for d, own in pieces.items():  # each id in exactly one piece
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[d])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert len({r["tier"] for own in sequences.values() for r in own}) > 1
    groups = {}
    for s, own in sequences.items():
        groups.setdefault(own[0]["step_group"], []).append(sum(r["length"] for r in own))
        assert len({r["step_group"] for r in own}) == 1
    assert max(map(sum, groups.values())) <= 2 * 8 * 1024


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(x := re.sub("[ -]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(x))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def test_op3_pii(spark, texts):
    for r in result(spark, "op3_pii"):
        found = [(kind, *m.span()) for kind, p, ok in BASE for m in re.finditer(p, texts[r["doc_id"]] or "") if ok(m[0])]
        assert [sum(k == kind for k, *_ in found) for kind, *_ in BASE] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if not k.startswith("like_")] == found  # base spans stay


def test_op4_unigram(spark, texts):
    from lectern.llm import unigram

    own = unigram.Unigram(unigram.pieces())
    for r in result(spark, "op4_unigram"):
        text = texts[r["doc_id"]] or ""
        ids = own([text])[0]
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids) // 4, zlib.crc32(ids))
        assert (r["decoded_chars"], r["decoded_crc32"]) == (len(text), zlib.crc32(text.encode()))


def crc(d):
    return zlib.crc32(str(d).encode())


def test_op5_quality(spark, texts):
    from lectern.llm import quality
    from lectern.llm.common import crc32_id
    from tests.llm.test_cases import slow_features

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    weights = quality.train(docs, labels, where=crc32_id(F.col("doc_id")) % 4 != 2).astype(np.float32).astype(float)
    for r in result(spark, "op5_quality"):
        found = slow_features(texts[r["doc_id"]], 18)
        s = weights[-1] + (32.0 * sum(weights[k] for k in found) / len(found) if found else 0.0)
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, s))))) < 1e-4 and r["predicted"] == int(r["score"] >= 0.7)


def test_op6_toxicity(spark, texts):
    from lectern.llm import toxicity
    from lectern.llm.common import crc32_id
    from tests.llm.test_documents import nearest

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.train(docs, labels, where=crc32_id(F.col("doc_id")) % 5 != 0)
    scorer, checked = toxicity.Scorer(model), 0
    for r in result(spark, "op6_toxicity"):
        text = texts[r["doc_id"]] or ""
        assert r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
        hits = scorer.hits(text)
        x = [1.0] + [0.0] * 7
        for _, _, _, _, kind, quotation, addressed in hits:
            x[(1, 3, 4)[kind]] += 1 - quotation
            x[2] += quotation
            x[6] += addressed
        x[5] = 100 * sum(1 - h[5] for h in hits) / (len(text) / 6 + 1) if hits else 0.0
        x[1:7] = [math.log1p(v) for v in x[1:7]]
        x[7] = max(((1 - h[5]) / (1 + (h[4] == 2)) for h in hits), default=0.0)
        s = sum(a * b for a, b in zip(model.weights, x, strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, s))))) < 1e-9
        if checked < 6:  # hits of whole texts by the plain distance
            checked += 1
            low = text.lower()
            words = {w for w in re.findall(r"[\w@$]+", low) if w.isalpha() and w.isascii()}
            met = {h[2] for h in hits}
            for w in words:
                found = nearest(w, model.terms, model.stems)
                assert (w in met) == bool(found and not (found[1] and w in model.ordinary)), w


def test_op7_media(spark, texts):
    from lectern.llm import media

    for r in result(spark, "op7_media"):
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.encode(payload, r["feature"].split("|")[1])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op8_simhash(spark, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    own = {d: fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in own}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(own), 2):
        if (own[a] ^ own[b]).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = result(spark, "op8_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{f:016x}", find(d)) for d, f in own.items()}


def test_op9_ann(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect() if r["embedding"]]
    hit = total = 0
    by = {}
    for r in result(spark, "op9_ann"):
        by.setdefault(r["query_id"], []).append(r)
    vectors = dict(rows)

    def cosine(a, b):
        return float((a * b).sum()) / (float(np.sqrt((a * a).sum())) * float(np.sqrt((b * b).sum())))

    assert set(by) == {i for i, _ in rows if i % 50 == 0}
    for q, found in by.items():
        near = sorted((-cosine(v, vectors[q]), i) for i, v in rows if i != q)[:5]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(near) + 1))
        assert all(r["score"] == cosine(vectors[r["vec_id"]], vectors[q]) for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        hit += len({r["vec_id"] for r in found} & {i for _, i in near})
        total += len(near)
    assert hit >= 0.9 * total


def test_pipeline(spark):
    """Each stage's decisions by the plain functions, on what the stage before kept."""
    import corpus_pipeline as p
    from lectern.llm import pii, quality, toxicity
    from lectern.llm.common import crc32_id
    from tests.llm.test_cases import slow_features

    larger = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else DIR
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    stages = dict(p.STAGES)

    def kept(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    model = toxicity.Scorer(toxicity.train(docs, labels, where=crc32_id(F.col("doc_id")) % 5 != 0))
    out = stages["toxicity"](spark, docs, larger)
    now = kept(out)
    assert now == {d: t for d, t in kept(docs).items() if model.score(t) < 0.5}
    out = spark.createDataFrame(out.collect(), docs.schema)
    weights = quality.train(out, labels, where=crc32_id(F.col("doc_id")) % 4 != 2).astype(np.float32).astype(float)

    def good(text):
        found = slow_features(text, 18)
        return weights[-1] + (32.0 * sum(weights[k] for k in found) / len(found) if found else 0.0)

    after = kept(nxt := stages["quality"](spark, out, larger))
    sure = {d: good(t) for d, t in now.items()}
    assert all((d in after) == (s >= 0) for d, s in sure.items() if abs(s) > 1e-4)
    out, now = spark.createDataFrame(nxt.collect(), docs.schema), after
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) for d, t in now.items())}
    by_shingle, root = {}, {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    for a, b in {tuple(sorted(x)) for ds in by_shingle.values() for x in combinations(ds[:400], 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            root[max(find(a), find(b))] = min(find(a), find(b))
    after = kept(nxt := stages["simhash_dedup"](spark, out, larger))
    assert set(after) == {find(d) for d in sets}
    out, now = spark.createDataFrame(nxt.collect(), docs.schema), after
    spans = {r["doc_id"]: r["spans"] for r in pii.find(out).collect()}
    after = kept(stages["pii"](spark, out, larger))
    for d, text in now.items():
        assert after[d] == pii.mask(text, [s.asDict() for s in spans[d]])
        assert not any(re.search(pattern, after[d]) and any(ok(m[0]) for m in re.finditer(pattern, after[d])) for kind, pattern, ok in BASE[:2])
