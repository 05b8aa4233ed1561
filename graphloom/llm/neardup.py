"""MinHash near-duplicate detection with an LSH forest.

Every class of equal shingle sets has one signature. The forest keeps it in several sorted orders;
in each order a class meets its neighbours with the longest common prefix, at a depth of at least
``DEPTH`` values. Where few classes share such a prefix all of them meet; where many do, the sorted
order takes them to as many further values as leave ``NEAR`` neighbours on either side, so that the
depth adapts to the region. Candidates are confirmed on the full shingle sets, links are closed to
components, and classes of crowded regions that are still apart meet by an exact prefix-filter join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, cut, in_arrow, parallelism
from graphloom.llm.components import components
from graphloom.llm.words import column_bytes, groups, mix, row_sets, words

SHINGLE = 5
#: Linked: PERCENT times the union is at most 100 times the intersection.
PERCENT = 75
#: Orders of the forest, and values of a signature: each order begins at its own four values.
TREES, DEPTH = 32, 4
VALUES = TREES * DEPTH
#: Neighbours in a sorted order that a class meets at either side: in a region of at most one more
#: class than ``REACH`` that is every other; in a crowded one, the ``NEAR`` with the longest prefixes.
REACH, NEAR = 8, 2

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray) -> np.ndarray:
    """``VALUES`` MinHash values of 16 bits of a set of 64-bit hashes."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        least = np.minimum(least, np.multiply.outer(_MULTIPLY, values[at : at + 2048]).min(axis=1))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in groups(batch.column("text")):
            hashes, _, _, rows = words(data, offsets)
            n, one, two, signs = [], [], [], []
            for s in row_sets(hashes, rows, SHINGLE):
                n.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                two.append(int(mix(s + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(n)), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sign"],
            )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and order: its first eight values there, as two longs that sort alike."""
    take = (np.arange(TREES)[:, None] * DEPTH + np.arange(2 * DEPTH)[None, :]) % VALUES
    for batch in batches:
        m = batch.num_rows
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint16).reshape(m, VALUES)
        keys = signs[:, take].astype(">u2").reshape(m * TREES, 2 * DEPTH).view(">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(np.repeat(batch.column("node").to_numpy(), TREES))],
            names=["tree", "hi", "lo", "node"],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in a sorted partition that share tree and first long, their region.

    ``kind`` 0: a pair (a, b), no more than ``REACH`` apart in a small region, ``NEAR`` in a crowded
    one. 1: a row at a partition's edge, to be paired over the edge (b: its second long). 2: a class of a
    crowded region, not all of which have met; a region over an edge has its rows named on one side or the other.
    """
    held, ahead, head_left = None, 0, REACH + 1

    def settle(now: list[np.ndarray], ahead: int, done: int) -> tuple[list[pa.RecordBatch], np.ndarray]:
        """What the first ``done`` rows give; ``ahead``: rows of the first row's region before it."""
        tree, hi, _, node = now
        n = len(node)
        fresh = np.ones(n + 1, dtype=bool)
        fresh[1:-1] = (tree[1:] != tree[:-1]) | (hi[1:] != hi[:-1])
        starts = np.flatnonzero(fresh)
        region = np.cumsum(fresh[:-1]) - 1
        before = np.arange(n) - starts[region]
        before[region == 0] += ahead
        after = starts[region + 1] - 1 - np.arange(n)
        crowded = before + after > REACH
        out = []
        for d in range(1, REACH + 1):
            at = np.flatnonzero((after[:done] >= d) & (~crowded[:done] | (d <= NEAR)))
            a, b = node[at], node[at + d]
            out.append(_rows(0, np.minimum(a, b), np.maximum(a, b)))
        some = np.flatnonzero(crowded[:done])
        out.append(_rows(2, node[some], node[some], tree[some], hi[some]))
        return out, before

    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("tree", "hi", "lo", "node")]
        if not len(now[0]):
            continue
        if head_left > 0:
            yield _edge_rows([x[:head_left] for x in now])
            head_left -= len(now[0])
        if held is not None:
            now = [np.concatenate([t, x]) for t, x in zip(held, now, strict=True)]
        done = len(now[0]) - (REACH + 1)
        if done > 0:
            out, before = settle(now, ahead, done)
            yield from out
            ahead = int(before[done])
            now = [x[done:] for x in now]
        held = now
    if held is not None:
        yield from settle(held, ahead, len(held[0]))[0]
        yield _edge_rows(held)


def _rows(kind: int, a: np.ndarray, b: np.ndarray, tree=None, hi=None) -> pa.RecordBatch:
    n = len(a)
    none = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.array(none.astype(np.int32) if tree is None else tree), pa.array(none if hi is None else hi)], names=["kind", "a", "b", "tree", "hi"]
    )


def _edge_rows(now: list[np.ndarray]) -> pa.RecordBatch:
    return _rows(1, now[3], now[2], now[0], now[1])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x, np.uint16).astype(np.uint8).tobytes() for x in batch.column("sign").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "sign"])


_PAIRS = "kind int, a long, b long, tree int, hi long"


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs with the number of equal signature values: the likest are confirmed first, all in the end."""
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(m, VALUES) for c in ("sa", "sb"))
        equal = (x == y).sum(axis=1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal)], names=["a", "b", "equal"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in groups(batch.column("text")):
            hashes, _, _, rows = words(data, offsets)
            sets = list(row_sets(hashes, rows, SHINGLE))
            one = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(sets)), pa.array(one, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "h1", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, xs), (y, ys) = (column_bytes(batch.column(c)) for c in ("xa", "xb"))
        keep = []
        for k, (xa, xb, ya, yb) in enumerate(zip(xs[:-1].tolist(), xs[1:].tolist(), ys[:-1].tolist(), ys[1:].tolist(), strict=True)):
            # Of the smaller set's shingles, those that the larger one has; both are sorted.
            own, other = sorted((np.frombuffer(x[xa:xb], np.uint64), np.frombuffer(y[ya:yb], np.uint64)), key=len)
            at = np.minimum(np.searchsorted(other, own), max(len(other) - 1, 0))
            both = int(np.count_nonzero(other[at] == own)) if len(own) else 0
            if 100 * both >= PERCENT * (len(own) + len(other) - both):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[keep]) for c in ("a", "b")], names=["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough: ``a``, ``b``."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
    return in_arrow(with_b.select("a", "b", "xa", "xb"), _confirm, "a long, b long")


def _with_components(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs with the components of their ends, ``ca`` and ``cb``; a class without links is its own."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    out = pairs.join(a, "a", "left").join(b, "b", "left")
    return out.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))


def _best(pairs: DataFrame) -> DataFrame:
    """For each class its most similar candidate, so few pairs join most of a group."""
    ends = pairs.select("a", "b", "equal", F.explode(F.array("a", "b")).alias("c"))
    best = F.max_by(F.struct("a", "b"), F.struct("equal", F.xxhash64("a", "b"))).alias("p")
    return ends.groupBy("c").agg(best).select("p.a", "p.b").distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` (``a``, ``b``) too, found among the components that those connect."""
    bridges = cut(_with_components(links, found).where("ca <> cb").select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct())
    if bridges.isEmpty():
        return found
    over = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("further"))
    alone = bridges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = found.unionByName(alone).join(over, "component", "left")
    return cut(every.select("node", F.coalesce("further", "component").alias("component")))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, own in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            own = np.frombuffer(own, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own), pa.array(np.full(len(own), len(own), np.int64))], names=["node", "shingle", "n"])


def crowded_pairs(sets: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs of classes in different components that may be linked, by an exact prefix-filter join.

    With shingles in one order of rarity (counted over these sets), two linked sets of m and n meet in
    one of the first ``n - ceil(0.75 n) + 1`` of each. Where they first meet, the r that each has left
    from there on bounds their overlap, which is to be 3/7 (m + n) at least: so m is at most 7/3 r - n.
    Sets of one shingle are dealt by size in steps of a twentieth and looked up only in the steps that
    this leaves: sets that share a frequent passage and no more don't all meet.
    """
    rows = in_arrow(sets, _prefixes, "node long, shingle long, n long")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(counts, "shingle", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("own"))
    length = F.col("n") - F.ceil(F.col("n") * PERCENT / 100.0) + 1
    heads = ranked.select("node", "n", F.posexplode(F.slice("own", F.lit(1), length.cast("int"))).alias("i", "s")).where("s.df > 1")
    heads = heads.join(found, "node", "left").select("node", "n", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("i")).alias("left"), F.coalesce("component", "node").alias("c"))
    share = PERCENT / (100 + PERCENT)
    step = lambda x: F.floor(F.log(x) / math.log(1.05)).cast("int")
    # The larger (or equal) set looks up the smaller.
    most = F.least(F.col("n").cast("double"), F.col("left") / share - F.col("n") + 1e-6)
    least = F.ceil(F.col("n") * PERCENT / 100.0 - 1e-6)
    x = heads.where(most >= least).withColumn("step", F.explode(F.sequence(step(least), step(most)))).alias("x")
    y = heads.withColumn("step", step(F.col("n"))).alias("y")
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.c") != F.col("y.c"))
    larger = (F.col("x.n") > F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))
    enough = F.least("x.left", "y.left") >= share * (F.col("x.n") + F.col("y.n")) - 1e-6
    pair = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return x.join(y, met & larger & enough).select(*pair).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Null, empty and wordless texts have no shingles and are linked with nothing. ``doc_id`` is the
    identity of a document: rows that repeat it are linked with each other whatever their texts,
    and where such an id is the least of several classes its links are those of its text of least hash. Rows without a ``doc_id`` can't be named by others: they are kept and have no component.
    Other columns are not read. Links of equal sets need no pair: a class of equal sets is one node.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.table(in_arrow(docs, _sign, "doc_id long, n_shingles long, h1 long, h2 long, sign binary"), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min_by("sign", "doc_id").alias("sign")), "classes")

    orders = in_arrow(classes.select("node", "sign"), _orders, "tree int, hi long, lo long, node long")
    keys = ["tree", "hi", "lo", "node"]
    met = in_arrow(orders.repartitionByRange(parallelism(spark), *keys).sortWithinPartitions(*keys), _neighbours, _PAIRS)
    met = scratch.table(met, "met")
    edge = met.where("kind = 1").select("tree", "hi", F.col("b").alias("lo"), F.col("a").alias("node")).distinct()
    over = in_arrow(edge.coalesce(1).sortWithinPartitions(*keys), _neighbours, _PAIRS)  # a few rows of each partition
    met = scratch.table(met.where("kind <> 1").unionByName(over.where("kind <> 1")), "all")
    # A document with several texts: its classes are linked by its id alone.
    same = named.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("doc_id")
    same = named.join(same, "doc_id").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    same = cut(same.where("u <> v").distinct())

    pairs = met.where("kind = 0 and a <> b").select("a", "b").distinct()
    # Of each value one byte is enough to compare pairs.
    signs = in_arrow(classes.groupBy("node").agg(F.min_by("sign", "h1").alias("sign")), _short, "node long, sign binary")
    pairs = pairs.join(signs.select(F.col("node").alias("a"), F.col("sign").alias("sa")), "a").join(signs.select(F.col("node").alias("b"), F.col("sign").alias("sb")), "b")
    pairs = scratch.table(in_arrow(pairs.select("a", "b", "sa", "sb"), _equal, "a long, b long, equal int"), "pairs")

    # The full sets of all that may have to be confirmed, from the text of one document of each class:
    # the texts meet the names of those classes once, and only their sets are kept.
    crowd = met.where("kind = 2").select("tree", "hi", F.col("a").alias("node")).distinct()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct()
    asked = asked.hint("merge")  # by a shuffle at every size: its number grows with the corpus
    own = docs.join(asked, docs.doc_id == asked.node, "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = in_arrow(own, _sets, "node long, h1 long, shingles binary").groupBy("node").agg(F.min_by("shingles", "h1").alias("shingles"))
    sets = scratch.table(sets, "sets")

    tried = scratch.table(_best(pairs), "tried")
    links = _linked(tried, sets).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = cut(components(links.unionByName(same)))
    left = _with_components(pairs.join(tried, ["a", "b"], "left_anti"), found).where("ca <> cb")
    found = _joined(found, _linked(left, sets))

    members = scratch.table(crowd.join(found, "node", "left").select("tree", "hi", "node", F.coalesce("component", "node").alias("c")), "members")
    open_regions = members.groupBy("tree", "hi").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y")
    rest = scratch.table(members.join(open_regions, ["tree", "hi"], "left_semi").select("node").distinct(), "rest")
    if not rest.isEmpty():
        rest_sets = scratch.table(sets.join(rest, "node", "left_semi"), "rest_sets")
        found = _joined(found, _linked(crowded_pairs(rest_sets, found), rest_sets))

    named_classes = classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), F.when(F.col("n_shingles") > 0, F.col("h2")).alias("h2"))
    out = out.join(named_classes, ["h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = cut(out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id").isNull() | (own == F.col("doc_id"))).alias("kept")))
    scratch.drop()
    return out
