import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import mixing, prefix, sharding


def many(spark, n=400):
    rng = np.random.Generator(np.random.PCG64(4))
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{'0' if i % 3 else i % 7}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def test_prefix_sums(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(int(g), int(k), int(v)) for g, k, v in zip(rng.integers(0, 4, 300), rng.permutation(300), rng.integers(0, 99, 300), strict=True)]
    df = spark.createDataFrame(rows, "g int, k int, v long").repartition(5)
    got = {(r["g"], r["k"]): r["before_v"] for r in prefix.prefix_sums(df, ["k"], ["v"], group="g").collect()}
    ahead = defaultdict(int)
    for g, k, v in sorted(rows):
        assert got[g, k] == ahead[g]
        ahead[g] += v


def test_shards(spark):
    rows, df = many(spark)
    out = sorted((r.asDict() for r in sharding.balanced_shards(df).collect()), key=lambda r: r["doc_id"])
    assert [r["size"] for r in out] == [len(t.encode()) + 8 for _, t, _ in rows]
    assert [r["text_crc32"] for r in out] == [zlib.crc32(t.encode()) for _, t, _ in rows]
    assert [r["shard"] for r in out] == sorted(r["shard"] for r in out)  # contiguous
    total, done, slots, bytes_in = sum(r["size"] for r in out), 0, defaultdict(int), defaultdict(int)
    for r in out:
        assert r["shard"] == min(23, (2 * done + r["size"]) * 24 // (2 * total)) and r["slot"] == slots[r["shard"]]
        slots[r["shard"]] += 1
        bytes_in[r["shard"]] += r["size"]
        done += r["size"]
    largest = max(r["size"] for r in out)
    assert len(bytes_in) == 24 and max(bytes_in.values()) - min(bytes_in.values()) <= 2 * largest
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}


def test_shards_of_odd_rows(odd, nothing):
    out = sharding.balanced_shards(odd, 3).collect()
    assert len(out) == odd.count() and {r["size"] for r in out if r["doc_id"] in (1, 2)} == {8}
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.balanced_shards(nothing).count() == 0


def shared(sizes, most=3):
    """Targets by sharing the excess again and again."""
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sizes)}
    total, open_, done = sum(sizes.values()), list(sizes), {}
    while open_:
        left = total - sum(done.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return done | share
        done |= {s: most * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return done


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 70}, {"a": 5}, {"a": 1, "b": 1, "c": 100000}, {"a": 0, "b": 9}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        want = shared(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (sizes, got, want)


def test_mix(spark):
    rows, df = many(spark)
    out = mixing.mix(df).collect()
    assert sorted(tuple(r) for r in out) == sorted(tuple(r) for r in mixing.mix(df.repartition(3)).collect())
    source = {d: s for d, _, s in rows}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        target[s], largest[s] = r["target"], max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    whole = mixing.mixed(df)
    assert whole.columns == df.columns and whole.count() == sum(r["copies"] for r in out)


def expected(sizes, target, most=3):
    """How often each document is to come, by length class: the rate found by bisection."""
    classes = [len(f"{n:b}") for n in sizes]
    low, high = 0.0, float(most)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(most, mid * c) for n, c in zip(sizes, classes, strict=True)) < target else (low, mid)
    return [min(most, high * c) for c in classes]


def test_expected_copies(spark):
    rows, df = many(spark)
    rows += [(9000, "w " * 3000, "a"), (9001, "", "a"), (9002, None, None), (9003, "one", None)]
    df = spark.createDataFrame(rows, df.schema)
    out = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    by = defaultdict(list)
    for d, _, s in rows:
        by[s].append(out[d])
    for own in by.values():
        if own[0]["target"] < 3 * own[0]["source_size"]:
            for r, each in zip(own, expected([r["size"] for r in own], own[0]["target"]), strict=True):
                assert abs(r["p"] - each % 1) < 1e-6 or abs(abs(r["p"] - each % 1) - 1) < 1e-6
                assert int(each + 1e-9) <= r["copies"] <= int(each + 1e-9) + 1


def test_inclusion_follows_probability(spark):
    """Over many seeds documents of one source come as often as their own, different probabilities say."""
    rows = [(i, " ".join("ab" for _ in range((1, 6, 40)[i % 3])), "x" if i < 240 else "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    seen, p = defaultdict(list), {}
    for seed in range(6):
        for r in mixing.mix(df, seed).collect():
            kind = (rows[r["doc_id"]][2], r["size"])
            p[kind] = r["p"]
            seen[kind].append(r["copies"])
    for kind, found in seen.items():
        whole = min(found)
        assert max(found) <= whole + 1
        assert abs(np.mean(found) - whole - p[kind]) < 0.08, (kind, np.mean(found), p[kind])
    assert len({round(v, 3) for k, v in p.items() if k[0] == "x"}) == 3


def test_mix_of_odd_rows(odd, nothing):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and {r["taken"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(odd.where(F.col("doc_id") == 2)).first()["target"] == 0.0
