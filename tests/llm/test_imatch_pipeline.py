import collections
import hashlib
import importlib.util
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import imatch

rng = random.Random(6)
WORDS = ["".join(rng.choice("aeiourstné😀") for _ in range(rng.randint(2, 7))) for _ in range(900)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def own_terms(text):
    found = {w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w}
    return {signed(xxhash.xxh64(w.encode(), seed=42).intdigest() | 1) for w in found}


def in_band(texts):
    """The lexicon by brute force: terms of a share of the distinct texts within the band."""
    texts = set(texts)
    counts = collections.Counter(t for text in texts for t in own_terms(text))
    return {t for t, c in counts.items() if imatch.LOW * len(texts) <= c <= max(1.0, imatch.HIGH * len(texts))}


def brute_fingerprint(text, lexicon):
    out = []
    for e in imatch.RATES:
        subsets = [[] for _ in range(1 << imatch.DRAW_BITS)]
        for t in sorted(own_terms(text) & lexicon):
            bits = (t % (1 << 64)) >> (64 - e)
            if bits % (1 << (e - imatch.DRAW_BITS)) == 0:
                # Signed order: negative hashes come first.
                subsets[(bits >> (e - imatch.DRAW_BITS)) ^ (1 << (imatch.DRAW_BITS - 1))].append(t)
        out.append([f"{xxhash.xxh64(''.join(f'{t % (1 << 64):X},' for t in own).encode(), seed=42).intdigest():x}" if own else "-" for own in subsets])
    return out


def brute_likeness(x, y, equal):
    shares = []
    for r, (a, b) in enumerate(zip(x, y, strict=True)):
        seen = [(p, q) for p, q in zip(a, b, strict=True) if (p, q) != ("-", "-")]
        if len(seen) >= (imatch.SEEN if r else 1):
            shares.append(sum(p == q for p, q in seen) / len(seen))
    return max(shares) if shares else float(equal)


def printed(x):
    return "/".join(".".join(rate) for rate in x)


def check(spark, docs):
    """Every column of every row against brute force; ``docs`` in order."""
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in imatch.fingerprints(df).collect()}
    lexicon = in_band(t for _, t in docs)
    assert len(rows) == len(docs)
    for k, (d, text) in enumerate(docs):
        half, following = len(text) // 2, docs[(k + 1) % len(docs)][1]
        edited = text[: len(text) - half] + following[:half]
        own, other, after = (brute_fingerprint(t, lexicon) for t in (text, edited, following))
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(other), brute_likeness(own, other, text == edited), brute_likeness(own, after, text == following))
        assert tuple(rows[d])[1:] == want
    return rows


def test_fingerprints(spark):
    docs = [(i * 3, " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 90)))) for i in range(60)]
    docs[7] = (21, docs[6][1])
    docs += [(500, ""), (501, "lone"), (502, " ".join(rng.choice(WORDS) for _ in range(4000))), (503, "ÄÖ ﬁ \ud83d\ude00 naïve!".encode("utf-16", "surrogatepass").decode("utf-16"))]
    rows = check(spark, docs)
    assert rows[18]["fingerprint"] == rows[21]["fingerprint"] and rows[18]["near_next"] == 1.0
    near, other = (np.array([r[c] for d, r in rows.items() if d < 500 and d != 18]) for c in ("near_edited", "near_next"))
    assert near.mean() > 4 * other.mean() + 0.02


def test_one_document_and_many_blocks(spark, monkeypatch):
    check(spark, [(7, "one text of its own")])
    monkeypatch.setattr(imatch, "BLOCKS", 40)
    check(spark, [(i - 20, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.randint(0, 9)))) for i in range(37)])


def kept(df):
    lexicon = imatch.Lexicon(imatch.band(df))
    return {r["doc_id"]: set(r["own"]) for r in df.select("doc_id", lexicon.known(F.col("text")).alias("own")).collect()}


def test_band(spark):
    """Only terms within the band count, whatever their order and number."""
    docs = [(i, f"common word{i} pair{i // 2} again again") for i in range(18)]
    docs += [(100, "again pair3 common PAIR3, nowhere"), (101, "pair3 again unseen common")]
    found, want = kept(spark.createDataFrame(docs, "doc_id long, text string")), in_band(t for _, t in docs)
    # Of 20 texts two are the most that a term may be in: pair3 is in four.
    assert found == {d: own_terms(t) & want for d, t in docs}
    assert [len(found[d]) for d in (5, 6, 100, 101)] == [2, 1, 1, 1]


def test_large_lexicon(spark):
    """Thousands of terms of the lexicon, and as many outside of it, are told apart."""
    docs = [(i, " ".join([f"own{i}x{j}" for j in range(40)] + [f"all{j}" for j in range(40)])) for i in range(100)]
    found = kept(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found == {d: {t for t in own_terms(x) if t in own_terms(" ".join(f"own{d}x{j}" for j in range(40)))} for d, x in docs}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_band_counts_distinct_texts(spark, monkeypatch, most):
    """Texts that are a third of all rows each keep their terms, whichever way copies are joined."""
    monkeypatch.setattr(imatch, "BROADCAST_ROWS", most)
    many = [" ".join(f"{c}{i}" for i in range(60)) for c in "pq"]
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(26)]
    docs += [(100 + i, many[i % 2]) for i in range(80)] + [(200, many[0] + " tail"), (201, " ".join(many[0].split()[:57]))]
    found = kept(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    # Of 30 distinct texts a term may be in three: those of many[0] and two near copies are.
    assert len(found[100]) == len(found[101]) == 60
    check(spark, docs)


def test_band_of_few_rows(spark):
    assert {len(x) for x in kept(spark.createDataFrame([(i, f"common own{i} self{i}") for i in range(5)], "doc_id long, text string")).values()} == {2}


def test_repeated_rows(spark):
    """Equal rows are one document, and each has its result; rows of one id follow by a hash of the text."""
    docs = [(i, f"word{i} next{i} some{i % 3}") for i in range(12)]
    plain = {r["doc_id"]: tuple(r) for r in imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    twice = imatch.fingerprints(spark.createDataFrame([*docs, docs[4], docs[4], docs[0]], "doc_id long, text string")).collect()
    assert collections.Counter(tuple(r) for r in twice) == collections.Counter([*plain.values(), plain[4], plain[4], plain[0]])


def test_odd_rows(odd, nothing):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_chars"] == 0 and by[4]["fingerprint"] == by[5]["fingerprint"]
    assert imatch.fingerprints(nothing).count() == 0
    assert imatch.fingerprints(odd.where("doc_id = 4")).first()["near_next"] == 1.0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark, tmp_path):
    """Stage by stage against what each is to do, and the whole against the stages."""
    import corpus_pipeline
    from test_neardup import brute

    root = f"{tmp_path}/data"
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs, labels = [], []
    for i in range(150):
        good = i % 4 > 0
        body = text(60) if good else " ".join(w + "***" for w in text(60).split())
        docs.append((i, body, "en", f"s{i % 3}", len(body)))
        labels.append((i, int(good), 0))
    docs += [(200 + i, docs[1][1] + f" {i}", "en", "s1", 1) for i in range(3)]
    item = text(25)
    docs.append((300, text(30) + " " + item + " " + text(30), "en", "s2", 1))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, schema in (("documents", docs, kinds), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{root}/{name}.parquet")
    now = spark.read.parquet(f"{root}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, root).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(now)
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in seen]
    assert all(s.columns == kinds.replace(" long", "").replace(" string", "").split(", ") for s in seen[:-1])
    judged = set(ids[0])
    assert np.mean([(i in judged) == (i % 4 > 0) for i in range(150)]) > 0.95 and {200, 201, 202, 300} <= judged
    by_id = {d: t for d, t, *_ in docs}
    assert ids[1] == sorted(d for d, (_, _, kept) in brute([(d, by_id[d]) for d in ids[0]]).items() if kept)
    assert ids[2] == sorted(set(ids[1]) - {300})
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(d) for d in ids[3]) <= 3
    assert ids[4] == ids[3] and {r["shard"] for r in seen[4].collect()} == set(range(24))
    whole = corpus_pipeline.run(spark, root)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, seen[4].collect()), key=repr)
    assert os.path.isdir(root)
