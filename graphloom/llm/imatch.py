"""I-Match fingerprints, by DataFrame functions alone.

Terms outside a band of inverse document frequency are set aside. Of the rest, each of several randomised
subsets of the lexicon keeps its own, and the sorted distinct terms that a document has in a subset are
hashed. A subset is an interval of the terms' 64-bit hashes, so a document's sorted terms fall into
subsets by being cut at their borders. ``2 ** DRAW_BITS`` subsets are drawn at each of several rates: of
a long text the sparse ones, of a short text the dense ones hold so few terms that a partial edit leaves
many of them whole. Two documents are alike to the degree that their hashes agree.

Document frequencies are exact and taken over distinct texts, so that copies don't push a text's own
terms out of the band. A term of the lexicon is in a share ``LOW`` of the texts at least, so the lexicon
has at most (mean distinct terms of a text) / ``LOW`` terms, however large the corpus: it is one value of
that bounded size (about ten bytes for each term), in which each row looks its terms up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, parallelism

#: Share of distinct texts that a term of the lexicon is in, at least and at most.
LOW, HIGH = 0.002, 0.1
#: Subsets keep one term of 2 ** e; 2 ** DRAW_BITS are drawn at each rate, each within the one before.
RATES, DRAW_BITS = (5, 8, 11), 5
#: Subsets of a sparser rate that either document must have terms in for the rate to count.
SEEN = 10
#: Hashes of texts with copies that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Blocks of successive documents for each shuffle partition.
BLOCKS = 8

_FIRST = -(1 << 63)
_TAG = 10  # hexadecimal digits of a term's tag in the table below


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: runs of ASCII letters and digits and all other characters, lower-cased.

    The last bit is always set, which leaves even numbers for the borders between subsets.
    """
    found = F.array_distinct(F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7f]+"))
    return F.transform(F.array_remove(found, ""), lambda w: F.xxhash64(w).bitwiseOR(F.lit(1).cast("long")))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct ``text`` of ``docs`` once, and their number. Only texts that have copies are shuffled."""
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    copies = cut(hashed.groupBy("h").agg(F.count("*").alias("rows")))
    repeated = copies.where("rows > 1").select("h")
    n, many = copies.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    repeated = F.broadcast(repeated) if many <= BROADCAST_ROWS else repeated
    first = hashed.join(repeated, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    return hashed.join(repeated, "h", "left_anti").select("text").unionByName(first.select("text")), n


def band(docs: DataFrame) -> DataFrame:
    """The lexicon: ``term`` hashes whose document frequency, over distinct texts, lies in the band.

    A term of a single text is below its upper end however few the texts are.
    """
    texts, n = distinct_texts(docs)
    counts = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").count()
    return cut(counts.where((F.col("count") >= LOW * n) & (F.col("count") <= max(1.0, HIGH * n))).select("term"))


class Lexicon:
    """The lexicon as one binary: buckets by the terms' leading bits, each with the tags (last bits) of its terms."""

    def __init__(self, band: DataFrame):
        n = band.count()
        self.bits = max(1, (n // 16).bit_length())
        tags = band.select(self._bucket(F.col("term")).alias("id"), self._tag(F.col("term")).alias("tag")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("tag")), "").alias("tags"))
        self.width = (tags.agg(F.max(F.length("tags"))).first()[0] or _TAG) // 2
        rows = band.sparkSession.range(1 << self.bits).join(tags, "id", "left").select("id", F.rpad(F.coalesce("tags", F.lit("")), 2 * self.width, "0").alias("tags"))
        whole = F.transform(F.array_sort(F.collect_list(F.struct("id", "tags"))), lambda x: x["tags"])
        self.table = F.lit(bytes(rows.agg(F.unhex(F.array_join(whole, ""))).first()[0]))

    def _bucket(self, term: Column) -> Column:
        return F.shiftrightunsigned(term, 64 - self.bits)

    def _tag(self, term: Column) -> Column:
        return F.lpad(F.hex(term.bitwiseAND(F.lit((1 << 4 * _TAG) - 1).cast("long"))), _TAG, "0")

    def known(self, text: Column) -> Column:
        """Sorted distinct terms of a text that the lexicon has."""

        def inside(term: Column) -> Column:
            own = F.substring(self.table, (self._bucket(term) * self.width + 1).cast("int"), F.lit(self.width))
            return F.contains(own, F.unhex(self._tag(term)))

        return F.sort_array(F.array_distinct(F.filter(terms(text), inside)))


def fingerprint(own: Column) -> Column:
    """One array for each rate, with a hash for each subset of the sorted ``own`` terms; null where it keeps none."""
    borders = F.expr("array(" + ",".join(f"shiftleft({j}L, {64 - DRAW_BITS})" for j in range(1 << DRAW_BITS)) + ")")
    bit = lambda e: (lambda t: F.shiftrightunsigned(t, 64 - e).bitwiseAND(F.lit((1 << (e - DRAW_BITS)) - 1).cast("long")) == 0)
    out = []
    for e in RATES:
        # Of the bits behind those that number the subset, a term has as many unset as make the rate.
        kept = F.filter(own, bit(e)) if e > DRAW_BITS else own
        line = F.transform(F.sort_array(F.concat(kept, borders)), lambda t: F.when(t.bitwiseAND(F.lit(1).cast("long")) == 0, "|").otherwise(F.concat(F.hex(t), F.lit(","))))
        subsets = F.slice(F.split(F.array_join(line, ""), r"\|"), 2, 1 << DRAW_BITS)
        out.append(F.transform(subsets, lambda s: F.when(s != "", F.xxhash64(s))))
    return F.array(*out)


def likeness(x: Column, y: Column, equal: Column) -> Column:
    """The largest share of agreeing hashes, of those that either has, at a rate; a sparser rate needs ``SEEN`` of them.

    Where neither has a term of the lexicon it is whether the texts are equal.
    """

    def share(r: int) -> Column:
        both = F.zip_with(F.get(x, F.lit(r)), F.get(y, F.lit(r)), lambda a, b: F.when(a == b, 1).when(F.coalesce(a, b).isNotNull(), 0))
        seen = F.filter(both, lambda v: v.isNotNull())
        agree = F.size(F.filter(seen, lambda v: v == 1))
        return F.when(F.size(seen) >= (SEEN if r else 1), agree / F.size(seen))

    return F.coalesce(F.greatest(*(share(r) for r in range(len(RATES)))), equal.cast("double"))


def written(x: Column) -> Column:
    """Hashes in hexadecimal, subsets divided by a point, ``-`` where empty, rates by a slash."""
    return F.array_join(F.transform(x, lambda rate: F.array_join(F.transform(rate, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")), "/")


def starts(keys: DataFrame) -> list[tuple[int, int]]:
    """The first ``k``, ``h`` of each of several runs of like size, in order: a few for each shuffle partition."""
    runs = keys.repartitionByRange(BLOCKS * parallelism(keys.sparkSession), "k", "h").groupBy(F.spark_partition_id().alias("run")).agg(F.min(F.struct("k", "h")).alias("first"))
    return sorted(tuple(r["first"]) for r in runs.collect())  # a row for each run


def blocks(first: list[tuple[int, int]], k: Column, h: Column) -> Column:
    """The blocks of a row: its own, and if it is the first of one, as a guest the one before."""
    longs = lambda i: F.expr("array(" + ",".join("bigint(%d)" % x[i] if x[i] > _FIRST else "shiftleft(1L, 63)" for x in first) + ")")
    ks, hs = longs(0), longs(1)

    def search(at: Column, step: Column) -> Column:
        x, y = F.get(ks, at + step), F.get(hs, at + step)
        return F.when((k > x) | (k == x) & (h >= y), at + step).otherwise(at)

    at = F.aggregate(F.array(*(F.lit(1 << j) for j in reversed(range(len(first).bit_length())))), F.lit(0), search)
    return F.transform(F.array(at), lambda b: F.when((k == F.get(ks, b)) & (h == F.get(hs, b)), F.array(b, F.pmod(b - 1, F.lit(len(first))))).otherwise(F.array(b)))[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (``doc_id``, ``text``) and of its edited text.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of
    the next document's text, in ascending order of ``doc_id``, after the last the first. Returns
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next``. Null texts are empty; rows without a ``doc_id`` (or with the
    least long there is, which stands for none) come first; rows of one ``doc_id``
    follow by a hash of the text, and equal rows count as one document of which each row has the result.
    A single document is its own next. An empty table gives no rows. Very long texts are taken whole, by one
    task each. Other columns are not read.

    Documents are dealt once into blocks that follow each other by ``doc_id``; the first of a block is also
    a guest in the block before, so that each block holds what comes next to each of its documents.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("k"), F.xxhash64("text").alias("h"), "text")
    keys = cut(keyed.select("k", "h").groupBy("k", "h").agg(F.count("*").alias("rows")))
    repeats = not keys.where("rows > 1").isEmpty()
    first = starts(keys)
    if not first:
        first = [(_FIRST, _FIRST)]
    if repeats:
        keyed = keyed.groupBy("k", "h").agg(F.first("text").alias("text"), F.count("*").cast("int").alias("rows"))
    lexicon = Lexicon(band(docs))

    dealt = keyed.select("*", F.posexplode(blocks(first, F.col("k"), F.col("h"))).alias("guest", "block"))
    # The guest of the last block is the first document of all.
    in_order = Window.partitionBy("block").orderBy("last", "k", "h")
    dealt = dealt.withColumn("last", (F.col("guest") == 1).cast("int"))
    step = dealt.withColumns({"next_h": F.lead("h").over(in_order), "next_text": F.lead("text").over(in_order)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    step = step.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # In steps: an expression that is used more than once is a column of its own.
    step = step.select(
        "k", "h", "block", "last", "next_h", *(["rows"] if repeats else []), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), (F.col("text") == F.col("edited")).alias("same"),
        lexicon.known(F.col("text")).alias("own"), F.when(F.col("last") == 0, lexicon.known(F.col("edited"))).alias("other"),
    )
    step = step.withColumns({"own": fingerprint(F.col("own")), "other": F.when(F.col("last") == 0, fingerprint(F.col("other")))})
    step = step.withColumn("next_own", F.lead("own").over(in_order)).where("last = 0")
    if repeats:
        step = step.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    near_edited = likeness(F.col("own"), F.col("other"), F.col("same"))
    near_next = likeness(F.col("own"), F.col("next_own"), F.col("h") == F.col("next_h"))
    return step.select(
        F.nullif(F.col("k"), F.lit(_FIRST)).alias("doc_id"), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        near_edited.alias("near_edited"), near_next.alias("near_next"),
    )
