"""Ids beside nulls, clashing columns, values beyond any bound, and generated tables against SQL and brute force."""

import math
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, chat_preference, media, oracles, packing, pii, quality, simhash, toxicity, unigram
from lectern.llm import url_templates as urls
from lectern.llm.common import shared_dir, staged, unstage

BIG = 2**53 + 1


# --- ids and columns ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def big(spark):
    rows = [(None, "some text of a row without id"), (BIG, "one two three four five"), (BIG + 2, "a b c d e f 1.2.3.4"), (-BIG, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name in ("spans", "base", "found", "rid", "media", "declared", "n_bytes", "type", "fp", "component_id", "root", "key", "n", "prefix", "members", "ids", "start", "score", "toxicity", "y", "__id", "__toxicity", "__quality", "__row", "__spans"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_ids_stay_exact_beside_nulls(big):
    want = sorted([None, BIG, BIG + 2, -BIG], key=str)
    model = unigram.pieces()
    for out in (packing.pack(big), pii.find(big), unigram.encode(big, model), media.store(big), media.sniff(media.store(big)), simhash.fingerprints(big), simhash.near_duplicates(big), simhash.near_duplicates(big, similarity=0.8), toxicity.score(big, toxicity.Model()), quality.score(big, np.zeros(1025))):
        assert sorted({r["doc_id"] for r in out.select("doc_id").collect()}, key=str) == want
    assert pii.masked(big).filter(f"doc_id = {BIG + 2}").first()["text"] == "a b c d e f [IP]"


def test_pipeline_stages_keep_clashing_columns(spark, big):
    import corpus_pipeline as p

    docs = big.withColumn("n_chars", F.length("text"))
    for stage in (p.drop_near_duplicates, p.mask_personal_data):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert out.filter("__id = 'clash' AND root = 'clash' AND spans = 'clash'").count() == 4


def test_one_id_with_several_texts(spark):
    import corpus_pipeline as p

    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, a, "x"), (5, b, "x"), (5, b, "x"), (5, b, "w"), (7, a, "x"), (-3, None, "x"), (2, "", "x"), (None, a, "x"), (None, a, "x")]
    kept = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(5, a, "x"), (5, b, "w"), (-3, None, "x"), (None, a, "x"), (None, a, "x")]))


def test_staged_tables_go(spark):
    import glob

    df = staged(spark.range(3), "gone")
    folder = shared_dir(spark).removeprefix("file:")
    assert glob.glob(f"{folder}/gone-*")
    unstage(df, spark.range(1))
    assert not glob.glob(f"{folder}/gone-*")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(50)], "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and all(roots[1000 + i] == 1000 for i in range(1, 50))


# --- similar sets ---------------------------------------------------------------------------------
@pytest.mark.parametrize("tile", [512, 16])
def test_similar_classes_by_brute_force(spark, monkeypatch, tile):
    from lectern.llm import shingle_sets

    monkeypatch.setattr(shingle_sets, "_TILE", tile)
    rnd = random.Random(tile)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    passage = [rnd.choice(words) for _ in range(60)]  # short texts that consist of it for the most part share their prefixes
    texts = [" ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(6, 16))]) for _ in range(70)]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 200))]
        for _ in range(4):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), rnd.randint(0, max(1, len(copy) // 40))):
                copy[at] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += ["", "  ", "one", "One", "x " * 50, "x " * 80]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), width=5, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


# --- PII ------------------------------------------------------------------------------------------
def slow_pii(texts, rounds=3, least=3, threshold=0.7):
    """Spans that contexts discover, by dictionaries over the whole corpus."""
    base = [
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    instances, words = [], {}  # (text, kind, start, end, value, patterns)
    for t, text in enumerate(texts):
        chunks = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
        name = [text[a:b].lower() for a, b in chunks]
        for w in name:
            words[w] = words.get(w, 0) + 1
        used = set()

        def add(kind, a, b, first, last, key, t=t, text=text, name=name):
            near = [("<" + name[first - 1]) if first else None, (">" + name[last + 1]) if last + 1 < len(name) else None, key and "=" + key.lower()]
            instances.append((t, kind, a, b, text[a:b].lower(), [p for p in near if p]))

        for kind, pattern, ok in base:
            for m in re.finditer(pattern, text):
                if ok(m[0]):
                    own = [k for k, (a, b) in enumerate(chunks) if a < m.end() and m.start() < b]
                    used.update(own)
                    head = text[chunks[own[0]][0] : m.start()]
                    add(kind, *m.span(), own[0], own[-1], head if head[-1:] in ("=", ":") else None)
        for k, (a, b) in enumerate(chunks):
            if k not in used and re.search("[0-9@]", text[a:b]):
                m = re.match(r"([^=:]+[=:])[\"']?(?=[^/\"'])", text[a:b])
                start, end = a + (m.end() if m else 0), a + len(text[a:b].rstrip(".,;:!?)]}\"'"))
                if end - start >= 5:
                    add(-1, start, end, k, k, m[1] if m else None)
    edges = {}
    for _, kind, _, _, value, patterns in instances:
        for p in patterns:
            edges[p, kind, value] = edges.get((p, kind, value), 0) + 1
    seeds = {}
    for p, kind, value in edges:
        if kind >= 0:
            seeds.setdefault((p, kind), set()).add(value)
    seeds = {k for k, v in seeds.items() if len(v) >= least}
    confidence, noisy = {}, {}
    for k in range(rounds):
        for p, kind in seeds:
            rows = [(own, v, n) for (q, own, v), n in edges.items() if q == p]
            total = max(sum(n for *_, n in rows), 0 if p[0] == "=" else words.get(p[1:], 0))
            different = len({v for _, v, _ in rows})
            belief = sum(n * (1.0 if own == kind else 0.0 if own >= 0 else noisy.get((v, kind), 0.0)) for own, v, n in rows)
            confidence[p, kind] = belief / total * different / (different + 1)
        doubt = {}
        for (p, _own, v), _n in edges.items():
            for q, kind in seeds:
                if q == p:
                    doubt.setdefault((v, kind), {})[p, _own] = math.log1p(-min(confidence[p, kind], 0.999))
        noisy = {k: 1 - math.exp(sum(d.values())) for k, d in doubt.items()}
    sure = {k: c for k, c in confidence.items() if c >= threshold}
    out = [[] for _ in texts]
    for t, kind, a, b, _, patterns in instances:
        hits = sorted((-c, k) for (p, k), c in sure.items() if kind < 0 and p in patterns)
        if hits:
            out[t].append(("like_" + pii.KINDS[hits[0][1]], a, b))
    return [sorted(o) for o in out]


def corpus(rnd):
    keys = ["contact:", "host", "tel", "addr=", "x" * 70 + "a", "x" * 70 + "b", "id="]
    makers = [lambda: f"u{rnd.randrange(999)}@m{rnd.randrange(9)}.org", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), lambda: f"+{rnd.randrange(10**9, 10**11)}", lambda: f"v{rnd.randrange(10**6, 10**7)}", lambda: f"n{rnd.randrange(99)}(at)h{rnd.randrange(99)}"]
    use = [(0, (0, 4)), (1, (1, 3)), (2, (2, 3)), (3, (1, 3)), (4, (0, 4)), (5, (3,)), (6, (3, 1))]
    texts = []
    for _ in range(160):
        out = []
        for _ in range(rnd.randint(0, 4)):
            key, kinds = rnd.choice(use)
            gap = "" if keys[key][-1] == "=" else " "
            out += ["some", "plain", keys[key] + gap + makers[rnd.choice(kinds + kinds[:1] * 4)]() + rnd.choice(("", ".", " end"))]
        texts.append(" ".join(out))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_spans_by_brute_force(spark, seed):
    texts = corpus(random.Random(seed))
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    found = {r["doc_id"]: sorted((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"].startswith("like_")) for r in got}
    want = slow_pii(texts)
    assert [found[i] for i in range(len(texts))] == want
    assert sum(map(len, want)) > 10
    long = [k for k, t in enumerate(texts) if re.search("xa [nu]", t)]
    assert any(want[k] for k in long)  # a context of 71 characters is a pattern, and not the one of its neighbour


# --- neighbours -----------------------------------------------------------------------------------
def test_repeated_rows_change_no_neighbour(spark):
    x = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]

    def nearest(rows):
        vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
        return sorted(map(tuple, ann.search(vectors, vectors.filter("vec_id % 50 = 0")).collect()))

    once = nearest(rows)
    assert len(once) == 12 * 5 and nearest(rows * 2) == once
    other = rows + [(50, [9.0] * 8), (7, [9.0] * 8)]  # one id with two vectors: the least counts
    least = [(i, min(v, [9.0] * 8) if i in (50, 7) else v) for i, v in rows]
    assert nearest(other) == nearest(least)


def test_deals_are_bounded():
    rng = np.random.default_rng(6)
    x = ann._unit(np.concatenate([rng.normal(size=(3000, 8)) * 0.05 + c for c in rng.normal(size=(10, 8))]))
    index = ann.MultiIndex(x, 16)
    cells = index.cells(x)
    index.counts = np.bincount(cells, minlength=len(index.counts))
    index.deal(0.1 * len(x), x[::7], 500)
    assert (index.first_deal + index.parts <= index.deals).all()
    size = np.zeros(index.deals)
    for c in np.flatnonzero(index.counts):
        size[index.first_deal[c] : index.first_deal[c] + index.parts[c]] += index.counts[c] / index.parts[c]
    assert size.max() <= 500 and len(size) >= len(x) / 500 and (size > 0).all()
    q = x[5]
    visited, reach = index.visit(q, 0.1 * len(x))
    one, two = index.halves(q[None])
    assert set(visited) <= {c for c in np.flatnonzero(index.counts) if one[0][c // index.k] + two[0][c % index.k] <= reach}


# --- pairs and urls against SQL -------------------------------------------------------------------
def both(spark, name, table, df, sql):
    con = duckdb.connect()
    con.register(name, table.toArrow())
    want = con.sql(sql)
    order = sorted(want.columns)
    found = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    return found, sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in order)) for r in want.fetchall())


@pytest.mark.parametrize("spread", [1, 5000, 2**50])
def test_pairs_of_sparse_ids(spark, spread):
    rnd = random.Random(4)
    rows = []
    for i in range(700):
        opening = f"common {rnd.choice((0, 0, 0, 1, 2))}" if i % 3 else f"own {i}"
        rows += [(i * spread, t, "assistant" if t % 2 else "user", opening if t == 0 else f"{i} {t}") for t in range(rnd.randint(1, 4))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = chat_preference.pair_up(chat_preference.turns_of(table)).collect()
    shared = [p for p in pairs if p["kind"] == "shared"]
    openings = {}
    for i, t, _, text in rows:
        if t == 0:
            openings.setdefault(text, []).append(i)
    assert len(shared) == sum(len(v) // 2 for v in openings.values())  # all that can pair do, whatever the ids
    assert not any(p["kind"] == "single" and p["cut"] for p in pairs)
    found, want = both(spark, "conversations", table, chat_preference.preferences(table), oracles.CHAT)
    assert found == want


def test_url_tree_against_sql(spark):
    rnd = random.Random(9)
    rules = [urls.Rule("net", "/", "block"), urls.Rule("a.info", "/ok/", "allow")]
    rows = []
    for i in range(1500):
        host = rnd.choice(("a.info", "b.info", "c.net"))
        depth = rnd.choice((0, 1, 2, 3, 6, 9))
        path = "/".join(rnd.choice(("ok", "news", "x", f"s{chr(97 + rnd.randrange(26))}", str(rnd.randrange(99)), "y" * 60)) for _ in range(depth))
        bad = "news/x" in path or rnd.random() < 0.1
        rows.append((i, f"http://{host}/{path}", None if rnd.random() < 0.3 else "###" * 9 if bad else "fine"))
    rows += [(2000, None, None), (2001, "no url", "###" * 9), (2002, "http://d.info/" + "/".join("z" * 40), None), (2003, "http://d.info/" + "q/" * 3000, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    junk = F.when(F.col("html").isNotNull(), (F.regexp_count("html", F.lit("[#]{3}")) >= 8).cast("int"))
    found, want = both(spark, "pages", table, urls.judge(table, rules, junk), oracles.url_templates(rules, "[#]{3}", 8))
    assert found == want


def test_divergent_sections_stay_apart(spark):
    def rejected(sections):
        rows = [(k * 1000 + i, f"http://one.info/s{chr(97 + k // 26)}{chr(97 + k % 26)}/p{chr(97 + i % 26)}", int(k == 0) if i else None) for k in range(sections) for i in range(40)]
        pages = spark.createDataFrame(rows, "page_id long, url string, bad int")
        return {r["page_id"] // 1000 for r in urls.judge(pages, [], F.col("bad")).filter("verdict = 'block'").collect()}

    assert rejected(6) == rejected(40) == {0}
    rows = [(i, f"http://deep.info/a/b/c/d/e/{'bad' if i % 2 else 'good'}/f/{i}", i % 2 if i < 80 else None) for i in range(100)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), [], F.col("bad")).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(1, 100, 2))  # paths part at the sixth segment


# --- quality --------------------------------------------------------------------------------------
def slow_features(text, bits, orders=(1, 2)):
    """Bucket numbers by arithmetic on Python's integers."""
    import xxhash

    mask, m1, m2, m3 = 2**64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")

    def shape(t):
        if not (t[0].isalnum() or t[0] == "_"):
            return t[:8]
        case = "A" if t.isupper() and len(t) > 1 else "Aa" if t[0].isupper() else "a" if t.islower() else "9" if t.isdigit() else "x"
        return case + "-" * min(4, len(t) // 4)

    out = []
    for row in ([xxhash.xxh64_intdigest(t.lower().encode()) for t in tokens], [xxhash.xxh64_intdigest("\0" + shape(t)) for t in tokens]):
        for n in orders:
            for i in range(len(row) - n + 1):
                g = row[i] * m1 & mask
                for j in range(1, n):
                    g = ((g ^ g >> 29) * m2 + row[i + j] * m3) & mask
                out.append((g * m1 & mask) >> (64 - bits))
    return out


def test_quality_by_brute_force(spark):
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choice(("One", "two", "THREE", "4", "five,", "!!!", "sixsix", "é")) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("!!!" in t)) for i, t in rows if i < 50], "doc_id long, quality int")
    bits = 10
    weights = quality.train(docs, labels, bits=bits, shards=1, epochs=2)
    import xxhash

    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.5

    def weight(k):
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    chosen = sorted(((xxhash.xxh64_intdigest(str(i)), t, int("!!!" in t)) for i, t in rows if i < 50), key=lambda r: r[0])
    share = sum(y for *_, y in chosen) / len(chosen)
    for _ in range(2):
        for _, text, y in chosen:
            found = slow_features(text, bits)
            x = {k: 32.0 * found.count(k) / len(found) for k in set(found)} | {1 << bits: 1.0}
            x = {k: float(np.float32(v)) for k, v in x.items()}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * x[k] for k in x)))))
            up = (0.5 / max(share if y else 1 - share, 0.02)) ** 0.5
            for k in x:
                g = up * (p - y) * x[k]
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / alpha * w[k]
    assert np.allclose(weights, [weight(k) for k in range((1 << bits) + 1)], atol=1e-6)
    for r in quality.score(docs, weights).collect():
        found = slow_features(r["text"], bits)
        s = weights[-1] + (32.0 * sum(weights[k] for k in found) / len(found) if found else 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-s))) < 1e-5


def test_learning_is_bounded_by_texts(spark):
    rows = [(i % 4, f"text {i} " + "good " * (i % 7)) for i in range(900)]  # four ids with many texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    chosen = quality.labelled(docs, labels, "quality", None, 100, "train")
    assert 20 < chosen.count() <= 200
    assert quality.labelled(docs.limit(0), labels, "quality", None, 100, "train").count() == 0
    assert toxicity.train(docs.limit(0), labels).weights == toxicity.Model().weights


def test_foreign_media_files():
    import struct
    import zlib

    rows = bytes(range(60))

    def png(depth, kind, filters):
        stride, lines, above = 15, b"", bytes(15)
        for k, f in enumerate(filters):
            line = rows[15 * k : 15 * k + 15]
            made = bytearray()
            for i in range(stride):
                a, b, c = line[i - 3] if i >= 3 else 0, above[i], above[i - 3] if i >= 3 else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                made.append(line[i] - (0, a, b, (a + b) // 2, near)[f] & 255)
            lines, above = lines + bytes([f]) + bytes(made), line
        return b"\x89PNG\r\n\x1a\n" + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, len(filters), depth, kind, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines)) + media._chunk(b"IEND", b"")

    data = png(8, 2, (0, 1, 4, 3))
    assert media.decode(data, "image/png", 0, len(data)) == rows
    data = png(8, 2, (2, 2))
    assert media.decode(data, "image/png", 0, len(data)) == rows[:30]
    data = png(16, 2, (0,))
    assert media.decode(data, "image/png", 0, len(data)) is None
    wav = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 40, b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", 4) + b"abcd"
    assert media.decode(wav, "audio/wav", 0, len(wav)) is None
    grey = b"".join(bytes((v, v, v, 0)) for v in range(256))
    bmp = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + 8, 0, 1078, 40, 3, 2, 1, 8, 0, 8, 0, 0, 256, 0) + grey + b"abc\0def\0"
    assert media.decode(bmp, "image/bmp", 0, len(bmp)) == b"defabc"  # the bottom row comes first in the file
    assert media.decode(bmp.replace(grey, bytes(1024)), "image/bmp", 0, len(bmp)) is None


@pytest.mark.parametrize("handed", [0, 8])
def test_tiles_lose_no_link(spark, monkeypatch, handed):
    """Texts that share a passage and little else: many buckets, many pairs that are nearly similar."""
    from lectern.llm import shingle_sets

    monkeypatch.setattr(shingle_sets, "_HANDED", handed)
    monkeypatch.setattr(shingle_sets, "_TILE", 32)
    monkeypatch.setattr(shingle_sets, "_FEW", 4)
    rnd = random.Random(handed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = [" ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(4, 16))]) for _ in range(90)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert 1 < len(set(root)) < len(root)
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), width=5, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_bit_maps_bound_what_sets_share():
    rng = np.random.default_rng(3)
    from lectern.llm import shingle_sets as S

    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 6000)))
        for share in (1.0, 0.95, 0.9, 0.5):
            sets.append(np.unique(np.concatenate((base[: max(1, int(len(base) * share))], rng.integers(-(2**62), 2**62, int(len(base) * (1 - share)))))))
    n = np.array([len(x) for x in sets])
    found = {tuple(sorted(p)) for p in S.candidates(np.arange(len(sets)), np.arange(len(sets)), n, np.array([S.bit_map(x) for x in sets]), 0.8)}
    near = {(i, j) for i, j in combinations(range(len(sets)), 2) if S.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 0.8)}
    assert near <= found and len(found) < 4 * len(near)


def test_wide_maps_bound_what_long_sets_share():
    from lectern.llm import shingle_sets as S

    rng = np.random.default_rng(1)
    for n, m, both in ((5, 6, 5), (600, 700, 550), (9000, 8200, 8000), (9000, 8100, 10)):
        values = rng.permutation(np.unique(rng.integers(-(2**63), 2**63 - 1, n + m, dtype=np.int64)))
        x, y = values[:n], np.concatenate((values[:both], values[n : n + m - both]))
        found = S.most_shared(S.wide_map(x).tobytes(), S.wide_map(y).tobytes(), n, m)
        assert both <= found <= both + 0.2 * min(n, m)  # a map of 4,096 bits bounds the last pair by some 7,000


def test_order_of_values_knows_lines_of_few_documents(spark, monkeypatch):
    from lectern.llm import shingle_sets as S

    monkeypatch.setattr(S, "_SAMPLE", 40)
    line = "one line that many have"
    docs = spark.createDataFrame([(k, f"{line} w{k} x{k}" if k % 50 == 0 else f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(8000)], "doc_id long, text string")
    values, counts = S._common_values(docs, "text", 5, 42)  # of some 500 documents, 10 have the line
    assert int(S.shingle_set(line)[0]) in values.tolist() and counts.min() > 1
