"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

The benchmark is worked off in blocks of bounded size, each held by every task; the corpus is read
once for each block, where it lies, and never shuffled. All n-grams of an item are its seeds: which of
them an edited or partial copy still has can't be known from counts over the corpus. The item is
aligned with the words around each run of seed hits, unless it has too few words in common with them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, in_arrow
from graphloom.llm.words import groups, shingles, words

#: Words of a seed.
SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of an item's best possible alignment score from which a passage counts as a copy.
LEAST_SCORE = 0.5
#: UTF-8 bytes of benchmark text in a block, which every task holds.
BLOCK_BYTES = 4 << 20

_SEPARATES = np.ones(256, dtype=bool)
_SEPARATES[128:] = False
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_words = functools.partial(words, space=_SEPARATES)


@dataclass
class Block:
    """Items of the benchmark, ready to be looked up: word hashes of each, and its n-grams, the seeds."""

    ids: list
    items: list[np.ndarray]
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # where each gram's places begin in the two below; one more than grams
    item: np.ndarray
    place: np.ndarray

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that hold one of the grams, and which."""
        if not len(self.grams) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        at = np.flatnonzero(self.grams[near] == hashes)
        return at, near[at]


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def make_block(rows: list) -> Block:
    """From ``item_id``, ``text`` rows."""
    column = _lowered(pa.array([r["text"] or "" for r in rows], pa.string()))
    items, keys, item, place = [], [], [], []
    for _, data, offsets in groups(column):
        hashes, _, _, at = _words(data, offsets)
        values, whole = shingles(hashes, at, SEED_WORDS)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            k = len(items)
            items.append(hashes[a:b])
            own = np.flatnonzero(whole[a:b])
            keys.append(values[a:b][own])
            item.append(np.full(len(own), k))
            place.append(own)
    keys, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, item, place))
    order = np.argsort(keys, kind="stable")
    grams, first = np.unique(keys[order], return_index=True)
    return Block([r["item_id"] for r in rows], items, grams.astype(np.uint64), np.append(first, len(keys)), item[order], place[order])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in ``passage`` it ends (exclusive)."""
    step = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item.tolist():
        fresh = np.maximum(row + GAP, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(fresh + step) - step
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _passages(at: np.ndarray, reach: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of hits less than ``reach`` apart: first and last hit, and the words around them to align."""
    breaks = np.flatnonzero(np.diff(at) > reach) + 1
    for run in np.split(np.arange(len(at)), breaks):
        a, b = int(at[run[0]]), int(at[run[-1]])
        yield int(run[0]), int(run[-1]) + 1, max(0, a - reach), min(n, b + SEED_WORDS + reach)


def _search(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for first, data, offsets in groups(_lowered(batch.column("text"))):
            hashes, begin, end, rows = _words(data, offsets)
            values, whole = shingles(hashes, rows, SEED_WORDS)
            at, gram = block.found(values)
            at, gram = at[whole[at]], gram[whole[at]]
            if not len(at):
                continue
            many = block.first[gram + 1] - block.first[gram]
            spot = np.repeat(block.first[gram] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            item, at = block.item[spot], np.repeat(at, many)
            doc = np.searchsorted(rows, at, side="right") - 1
            order = np.lexsort((at, item, doc))
            doc, item, at, spot = doc[order], item[order], at[order], spot[order]
            cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
            for own in np.split(np.arange(len(at)), cuts):
                d, k = int(doc[own[0]]), int(item[own[0]])
                low, high = int(rows[d]), int(rows[d + 1])
                text, best = hashes[low:high], (0, 0, 0, 0)
                goal = block.items[k]
                reach = len(goal) + SEED_WORDS
                for x, y, a, b in _passages(at[own] - low, reach, high - low):
                    # A word of the item that the passage lacks can't match, so this many bound the score.
                    if MATCH * np.count_nonzero(np.isin(goal, text[a:b])) < max(LEAST_SCORE * MATCH * len(goal), best[0]):
                        continue
                    score, stop = align(goal, text[a:b])
                    if score > best[0]:
                        best = (score, a, a + stop, len(np.unique(spot[own[x:y]])))
                score, a, stop, seeds = best
                if score >= LEAST_SCORE * MATCH * len(goal):
                    back, length = align(goal[::-1], text[a:stop][::-1])
                    lead = lambda p, o=int(offsets[d]): int(np.count_nonzero((data[o:p] & 0xC0) != 0x80))
                    found.append((first + d, block.ids[k], score / (MATCH * len(goal)), seeds, lead(int(begin[low + stop - length])), lead(int(end[low + stop - 1]))))
        if found:
            row, ids, scores, seeds, starts, ends = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(seeds, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["doc_id", "item_id", "score", "seeds", "start", "stop"],
            )


_FOUND = "doc_id long, item_id long, score double, seeds long, start long, stop long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold copies of benchmark items, exact or edited, one row for each such pair.

    ``docs``: ``doc_id``, ``text``; ``benchmark``: ``item_id``, ``text``; other columns are not read.
    Returns ``doc_id``, ``item_id``, ``score`` (alignment score of the best passage by that of a full
    copy, at least ``LEAST_SCORE``), ``seeds`` (distinct seeds in it), ``start`` and ``stop`` (its code
    points). Words are runs of ASCII letters, digits and other non-ASCII characters, lower-cased. Null
    and empty texts, and items of fewer words than a seed, match nothing; repeated items and documents
    match each on its own; an empty table on either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for k in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        seeds = make_block(rows)
        found = in_arrow(docs, lambda it, b=seeds: _search(it, b), _FOUND)
        out = found if k == 0 else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without a ``doc_id`` are kept."""
    hit = Scratch(docs.sparkSession).table(contaminated(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    return docs.join(hit, docs["doc_id"].cast("long") == hit["_hit"], "left_anti")
