"""Packing, SimHash, PII, quality, toxicity, media and unigram against brute force on small tables."""

import hashlib
import random
import re
import struct
import zlib
from array import array
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import media, packing, pii, quality, simhash, toxicity, unigram

#: nulls, empty and very long texts, repeated rows, ties; ``text`` of a clash in an extra column
ROWS = [
    (1, "the cat sat on the mat and then it ran away", "en", "a"),
    (2, "the cat sat on the mat and then it ran away", "en", "a"),
    (3, "THE cat sat on the mat and then it ran away", "en", "a"),
    (4, "", "en", "b"),
    (5, None, None, None),
    (6, "word " * 30000, "en", "b"),
    (7, "x" * 70000, "en", "b"),
    (8, "mail me: jo.doe@mail.example.com or +1 (555) 123-4567, host 10.20.30.40", "en", "b"),
    (8, "mail me: jo.doe@mail.example.com or +1 (555) 123-4567, host 10.20.30.40", "en", "b"),
    (None, "no id here", "en", "b"),
    (9, "  two  spaces \n\n and\ttabs 中文 😀 <|endoftext|> ", "zh", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit(0.5)).withColumn("ids", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing --------------------------------------------------------------------------------------
def test_packing_round_trip(docs, empty):
    tok = packing.vocabulary()()
    pieces = packing.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for doc_id, text, *_ in ROWS:
        want = tok.encode(text or "") + b"\0\0\0\0"
        n = sum(1 for r in ROWS if r[0] == doc_id)
        parts = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert sum(p["length"] for p in parts) == n * len(want) // 4
        assert all(bytes(p["ids"]) == want[4 * p["start"] : 4 * (p["start"] + p["length"])] and p["doc_tokens"] == len(want) // 4 for p in parts)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_tokens_equal_the_library():
    tok, rnd = packing.vocabulary()(), random.Random(3)
    signs = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "1", "²", "!", "　", "\xa0", "中", "😀", "\r\n", " \n", "_", "<|endoftext|>", "\x1c"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 10))) for _ in range(3000)]
    assert tok(texts) == [tok.encode(t) for t in texts]


def packed(lengths, **kind):
    """Windows of documents with the given lengths, whose ids are all zero."""
    packer = packing.Packer(**kind)
    out = [w for k, n in enumerate(lengths) for w in packer.add(k, b"\0" * 4 * n)]
    return out + list(packer.end())


def test_tiers_are_packed():
    rnd = random.Random(2)
    lengths = [rnd.choice((rnd.randint(1, 128), rnd.randint(1, 600), rnd.randint(1, 3000))) for _ in range(3000)]
    four, one = packed(lengths), packed(lengths, tiers=(1024,))
    for windows in (four, one):
        assert sum(len(p[2]) // 4 for _, pieces in windows for p in pieces) == sum(lengths)
        assert all(sum(len(p[2]) // 4 for p in pieces) == size and size & (size - 1) == 0 for size, pieces in windows)
        left = [size for size, _ in windows if size not in (128, 256, 512, 1024)]
        assert sum(left) < 256  # all but a few ids are in windows of a tier: no padding anywhere
    sizes = {s: sum(size == s for size, _ in four) for s in (128, 256, 512, 1024)}
    assert all(sizes.values()) and len({size for size, _ in one}) < len({size for size, _ in four}) + 8
    assert sum(size == 1024 for size, _ in one) >= sum(lengths) // 1024  # one tier: all goes to the longest context
    for size, pieces in four:
        lead = pieces[0]
        assert all(p[4] == next(t for t in (128, 256, 512, 1024) if len(p[2]) // 4 <= t) or p is pieces[-1] for p in pieces)  # routed by length, but for cuts
        if size in (256, 512, 1024) and lead[4] == size:
            assert all(p[4] < size for p in pieces[1:-1])  # gaps are filled from shorter tiers
    short = packed([40] * 64)
    assert {size for size, _ in short} == {128}  # nothing long waits, so short documents train in a short context
    mixed = packed([700] * 40 + [60] * 400)
    assert all(any(p[4] == 128 for p in pieces) for size, pieces in mixed if pieces[0][4] == 1024)


def test_step_groups_balance():
    rnd = random.Random(3)
    windows = [(size, [(0, 0, b"\0" * 4 * n, n, size), (1, 0, b"\0" * 4 * (size - n), size - n, 128)]) for size in (128, 256, 512, 1024) for n in (rnd.randint(1, size) for _ in range(64))]
    groups = packing.step_groups(windows, 8 * 1024)
    tokens, cost = {}, {}
    for (size, pieces), g in zip(windows, groups, strict=True):
        tokens[g] = tokens.get(g, 0) + size
        cost[g] = cost.get(g, 0) + sum((len(p[2]) // 4) ** 2 for p in pieces)
    assert len(tokens) == 15 and max(tokens.values()) - min(tokens.values()) <= 1024
    assert max(cost.values()) < 1.3 * min(cost.values())


# --- SimHash --------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, text, *_ in ROWS:
        if len(text or "") < 1000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)


def classes_of(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


@pytest.mark.parametrize(("bands", "tile"), [(5, 4096), (6, 4096), (5, 16), (7, 8)])
def test_links_keep_components(spark, bands, tile):
    rnd = random.Random(bands * tile)
    fps = []
    for _ in range(25):
        f = rnd.getrandbits(64)
        fps.append(f)
        for _ in range(rnd.randint(0, 12)):  # chains and stars near the radius
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
            fps.append(f)
    fps = sorted(set(fps))
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), len(fps), bands=bands, tile=tile)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = classes_of(fps)
    groups, found = {}, {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(want[f], set()).add(s)
        found.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and by[4]["fp"] == 0
    assert simhash.near_duplicates(empty).count() == 0


def five_words(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_drops_planted_copies(spark):
    import corpus_pipeline

    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    passage = [rnd.choice(words) for _ in range(40)]  # many texts share it, and are no copies for that
    texts = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 900))] + (passage if k % 2 else [])
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 7, 11):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), max(1, edits * len(copy) // 500)):
                copy[at] = rnd.choice(words)
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    sets = [five_words(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.95 * len(sets[i] | sets[j]) for i, j in near) > 100
    root = list(range(len(texts)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    rows = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, texts[0], "en", "a")], SCHEMA).repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(root))
    assert kept.count(None) == 1


# --- PII ------------------------------------------------------------------------------------------
PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    signs = ["a", "b.", "@", "x.y", "12", "4", "255", "256", ".", "-", " ", "+1", "(2)", "4111 1111 1111 1111", "\n", "é", "%", "a@b.c", "1.2.3.4"]
    for _ in range(6000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12)))
        want = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0])]
        assert sorted(pii.base_spans(text)) == sorted(want), text


def test_patterns_discover_unseen_identifiers(spark, docs, empty):
    rows = [(i, f"some text {i} contact: user{i}@mail.example.com and the rest") for i in range(40)] + [(100 + i, f"write to contact: user{i}(at)host{i}.example now") for i in range(5)]
    rows += [(200 + i, f"the value the number {i}{i}{i}{i}5 of the list") for i in range(20)]
    found = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i]["spans"][0]["kind"] == "email" for i in range(40))
    assert all([s["kind"] for s in found[100 + i]["spans"]] == ["like_email"] for i in range(5))
    assert all(not found[200 + i]["spans"] for i in range(20))
    got = pii.find(docs).collect()
    assert len(got) == len(ROWS) and sum(len(r["base"]) for r in got) == 6
    assert pii.find(empty).count() == 0
    hidden = pii.masked(docs)
    assert hidden.columns == docs.columns and hidden.count() == len(ROWS)
    assert hidden.filter("doc_id = 8").first()["text"] == "mail me: [EMAIL] or [PHONE], host [IP]"
    assert hidden.filter("doc_id = 5").first()["text"] is None


def test_copies_of_rows_leave_the_spans(spark):
    rows = [(i, f"some text {i} contact: user{i}@mail.example.com and the rest") for i in range(40)] + [(100 + i, f"write to contact: user{i}(at)host{i}.example now") for i in range(5)]
    rows += [(200 + i, f"the value the number {i}{i}{i}{i}5 of the list") for i in range(20)]
    rows += [(300 + i, f"call desk +1 (555) 100-200{i} or desk {i}xyz{i}") for i in range(4)]  # half of the word's instances

    def spans(copies):
        found = pii.find(spark.createDataFrame(rows * copies, "doc_id long, text string")).collect()
        return {(r["doc_id"], str(r["spans"])) for r in found}

    once = spans(1)
    assert sum("like_email" in s for _, s in once) == 5
    assert spans(2) == once
    assert spans(50) == once


def test_masking_with_more_patterns_than_the_bound(spark, docs):
    rows = [(i, f"some text {i} contact: user{i}@mail.example.com and the rest", "en", "a") for i in range(40)]
    rows += [(100 + i, f"write to contact: user{i}(at)host{i}.example now", "en", "a") for i in range(5)]
    table = docs.unionByName(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0.5D AS score", "'clash' AS ids"))
    here, joined = pii.masked(table), pii.masked(table, most=0)
    assert joined.columns == here.columns == table.columns
    want = sorted(map(repr, here.collect()))
    assert sum("[LIKE_EMAIL]" in r for r in want) == 5
    assert sorted(map(repr, joined.collect())) == want


# --- classifiers ----------------------------------------------------------------------------------
def labelled(spark, bad, label, n=240):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        y = i % 3 == 0
        rows.append((i, bad(text, rnd) if y else " ".join(text)))
        marks.append((i, int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(marks, f"doc_id long, {label} int")


def test_quality(spark, docs, empty):
    train, labels = labelled(spark, lambda t, r: " ".join(w + "$$$" for w in t), "quality")
    held = F.col("doc_id") % 4 == 2
    model = quality.train(train, labels, where=~held, bits=14)
    assert (model == quality.train(train, labels, where=~held, bits=14)).all()
    scored = quality.score(train.filter(held), model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in scored]) > 0.97
    again = quality.score(docs, model, out="q").collect()
    assert len(again) == len(ROWS) and all(0 <= r["q"] <= 1 for r in again)
    assert quality.score(empty, model).count() == 0
    flat = quality.train(train, labels.withColumn("quality", F.lit(1)), bits=10)
    assert np.count_nonzero(flat) == 1


def test_sparse_dot_equals_gather():
    features, text = quality.Features(12), "One two, three!! one two"
    idx, x = features.sparse(text)
    flat = np.concatenate(list(features(text)))
    w = np.random.default_rng(0).normal(size=1 << 12)
    assert np.isclose(w[idx] @ x, 32.0 * w[flat].sum() / len(flat))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, old = [i], row
        for j, e in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != e)))
    return row[-1]


def nearest(word, terms, stems):
    """By brute force: the nearest term, or stem of some beginning of the word."""
    found = [(d, 0, t) for t in terms if (d := distance(word, t)) <= toxicity.allowed_edits(t)]
    for s in stems:
        d = min(distance(word[:k], s) for k in range(len(word) + 1))
        if d <= toxicity.stem_edits(s) and word[:1] == s[0]:
            found.append((d, 1, s + "*"))
    return (min(found)[2], min(found)[0]) if found else None


def test_automaton_equals_levenshtein():
    rnd, terms, stems = random.Random(7), ["abba", "abbacd", "bacada", "dadabacaba", "cab"], ["caca", "dbdbdb", "abcdab"]
    auto, plain = toxicity.LexiconAutomaton(terms, stems), toxicity.LexiconAutomaton(terms)
    met = 0
    for _ in range(6000):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
        if rnd.random() < 0.5:
            word = rnd.choice(terms + stems) + word[:3]
            at = rnd.randrange(len(word))
            word = word[:at] + rnd.choice(("", "a", "d")) + word[at + rnd.randint(0, 1) :]
        assert plain.match(word) == nearest(word, terms, ()), word
        assert auto.match(word) == nearest(word, terms, stems), word
        met += nearest(word, terms, stems) is not None
    assert met > 800


def test_hits_by_brute_force():
    rnd = random.Random(8)
    model = toxicity.Model(stems=frozenset({"zorkan", "vequ"}), ordinary=frozenset({"stupit"}))
    scorer = toxicity.Scorer(model)
    words = ["idiot", "idoit", "idi0t", "Zorkanei", "zorkbnei", "vequa", "veku", "stupit", "m0r0n", "good", "house", "wortless", "worthles", "a" * 90, "i" * 60 + "d" + "i" * 30 + "o" * 40 + "t"]
    for _ in range(300):
        text = " ".join(rnd.choice(words) + rnd.choice(("", ",", "!")) for _ in range(rnd.randint(0, 30)))
        want = []
        for m in re.finditer(r"[\w@$]+", text.lower()):
            folded = m[0].translate(str.maketrans("013457@$", "oieastas"))
            tight = re.sub(r"(.)\1{2,}", r"\1", folded)
            found = next(((n, f) for f in (m[0], folded, tight) if (n := nearest(f, model.terms, model.stems))), None)
            if found and not (found[0][1] and m[0] in model.ordinary):
                (term, edits), form = found
                want.append((m.start(), m.end(), term, 2 if edits else int(form != m[0])))
        assert [(a, b, t, k) for a, b, _, t, k, _, _ in scorer.hits(text)] == want


def test_context_reaches_as_far_as_it_says():
    scorer = toxicity.Scorer(toxicity.Model())
    far = "he wrote: “" + "very long words of a quotation " * 40 + "idiot" + " and so on" * 40 + "” yesterday"
    near = "he wrote: “ idiot ” yesterday"
    assert scorer.hits(far)[0][5] == 0.6 and scorer.hits(near)[0][5] == 1.0
    assert scorer.hits(far.replace("”", ""))[0][5] == 0  # never closed
    assert scorer.hits('a 5" idiot and a 6" nail')[0][5] == 0  # inch marks quote nothing
    assert scorer.hits("it’s an idiot isn’t it")[0][5] == 0
    eight = "you " + "uncommonlylongword " * 7 + "idiot"
    assert scorer.hits(eight)[0][6] and not scorer.hits("you " + "w " * 8 + "idiot")[0][6]
    assert toxicity.quoted("« a „b“ c » d") == [(0, 10), (4, 6)]
    long = "i" * 60 + "d" + "i" * 30 + "o" * 40 + "t"
    assert scorer.score("you " + long) > 0.5 and scorer.hits("İ " + "idiot")[0][:2] == (2, 7)


def test_toxicity(spark, docs, empty):
    def bad(text, rnd):
        for _ in range(2):
            text.insert(rnd.randrange(len(text)), rnd.choice(["zorkan", "zorkans", "idiot", "schnuffling", "schnuffler", *["a" * 20 + "bcdefghij"] * 3]))
        return " ".join(text)

    train, labels = labelled(spark, bad, "toxic", 400)
    held = F.col("doc_id") % 5 == 0
    model = toxicity.train(train, labels, where=~held)
    scored = toxicity.score(train.filter(held), model).join(labels, "doc_id").collect()
    assert np.mean([(r["toxicity"] >= 0.5) == r["toxic"] for r in scored]) > 0.97
    learned = toxicity.Scorer(model)
    assert {t for t in model.terms if len(t) > 24} == {"a" * 20 + "bcdefghij"}  # terms of any length
    misspelled = {w: learned.hits(w) for w in ("schnuflfing", "5chnuffling", "schnufling", "schnuffeler")}
    assert all(h and h[0][3].startswith("schnuf") for h in misspelled.values()), misspelled
    score = toxicity.Scorer(toxicity.Model()).score
    assert score("you are an idi0t and a m0ron") > 0.5 > score('he said "idiot" in the quoted article')
    assert score(None) == score("") < 0.5
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    assert toxicity.train(train, labels.withColumn("toxic", F.lit(0))).weights == toxicity.Model().weights


# --- media ----------------------------------------------------------------------------------------
def test_media_round_trip(docs, empty):
    for r in media.sniff(media.store(docs)).collect():
        text = next((t for i, t, *_ in ROWS if i == r["doc_id"]), None) or ""
        raw = text.encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r["n_bytes"] == len(raw) and hashlib.sha256(r["samples"]).digest() == hashlib.sha256(payload).digest()
        assert r["carved"][0]["offset"] == 0 and r["carved"][0]["length"] == len(r["media"])
    assert media.sniff(media.store(empty)).count() == 0


def test_sniffer_carves_and_rejects():
    payload = bytes(range(256)) * 2
    sniff = media.Sniffer()
    kinds = ("audio/wav", "image/bmp", "image/png", "audio/basic", "image/x-portable-graymap")
    files = [media.encode(payload, k) for k in kinds]
    junk = b"BM and RIFF and P5 are only letters here "
    blob = junk + junk.join(files) + junk
    found = sniff(blob)
    assert [k for k, _, _ in found] == list(kinds)
    assert all(media.decode(blob, *f) == payload for f in found)
    broken = bytearray(files[2])
    broken[40] ^= 1  # a checksum fails
    assert sniff(bytes(broken)) == [] and sniff(b"") == []
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    gz = zlib.compress(b"x" * 99, wbits=31)
    assert [(k, n) for k, _, n in sniff(b"--" + gif + b"--" + gz + b"--")] == [("image/gif", len(gif)), ("application/gzip", len(gz))]


# --- unigram --------------------------------------------------------------------------------------
def test_unigram(docs, empty):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = unigram.pieces()
    # the library's own unigram encoder on the same pieces and scores
    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):
        p.score = float(model.scores[k]) if np.isfinite(model.scores[k]) else 0.0
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own, rnd = unigram.Unigram(model), random.Random(9)
    signs = ["the ", "a", "  ", "ing", "\n", "é", "中", "😀", " house", "1", "\t", "qz"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + ["long中" * 60]

    def total(ids, n):
        return sum(model.scores[i] for i in ids if np.isfinite(model.scores[i]))

    for text, ids in zip(texts, own(texts), strict=True):
        mine, theirs = array("I", ids).tolist(), lib.encode(text)
        assert mine == theirs or (len(mine) == len(theirs) and abs(total(mine, 0) - total(theirs, 0)) < 1e-3), text  # a tie
        assert own.decode(ids) == text
    back = unigram.decode(unigram.encode(docs, model), model).collect()
    for r in back:
        assert r["text"] == (next((t for i, t, *_ in ROWS if i == r["doc_id"]), None) or "")
    assert unigram.encode(empty, model).count() == 0
