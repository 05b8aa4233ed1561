import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import neardup
from graphloom.llm.components import components
from graphloom.llm.words import groups, row_sets, words


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(40)]
    docs, k = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 1, 3, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own + common[: rng.randint(5, 40)]
            docs.append((k, rng.choice([" ", "\n", "  "]).join(own)))
            k += 1
    docs += [(k + i, " ".join(common) + f" {word()} {word()}" + " tail" * i) for i in range(20)]
    return docs


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert result(got) == brute(docs)


def test_crowded_regions_are_exact(spark, monkeypatch):
    """With hardly any neighbours in the forest, what is left over is found by the exact join."""
    monkeypatch.setattr(neardup, "REACH", 1)
    monkeypatch.setattr(neardup, "NEAR", 1)
    docs = corpus(9)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert result(got) == brute(docs)


def test_exact_join_alone(spark):
    docs = corpus(11)
    sets = spark.createDataFrame(docs, "node long, text string").mapInArrow(neardup._sets, "node long, h1 long, shingles binary")
    none = spark.createDataFrame([], "node long, component long")
    sets = sets.where(F.length("shingles") > 0)
    linked = neardup._linked(neardup.crowded_pairs(sets, none), sets)
    got = {(r["a"], r["b"]) for r in linked.collect()}
    own = {d: shingles(t) for d, t in docs}
    want = {(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])}
    assert got == want


def test_odd_rows(spark, odd, nothing):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"] and by[2]["kept"]
    assert by[4]["component_id"] == by[5]["component_id"] == 4 and not by[5]["kept"] and by[8]["n_shingles"] == 2
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(nothing).count() == 0


def test_words_of_a_batch():
    column = pa.array(["Ab  cd\x0bEF", None, "", "ab cd ef g h i", "\n"])
    (first, data, offsets), *more = list(groups(column))
    hashes, begin, end, rows = words(data, offsets)
    assert rows.tolist() == [0, 3, 3, 3, 9, 9] and not more and first == 0
    assert hashes[:3].tolist() == hashes[3:6].tolist()
    assert [len(s) for s in row_sets(hashes, rows, 5)] == [1, 0, 0, 2, 0]
    assert [bytes(data[a:b]) for a, b in zip(begin[:3], end[:3], strict=True)] == [b"Ab", b"cd", b"EF"]
    assert [g[0] for g in groups(pa.array(["abc"] * 4), 5)] == [0, 1, 2, 3]


def test_components_of_a_long_path(spark):
    order = np.random.Generator(np.random.PCG64(1)).permutation(200).tolist()
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)) + [(500, 501)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert set(found.values()) <= {0, 500} and len(found) >= 200
