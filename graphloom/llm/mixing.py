"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, cut, text_or_empty
from graphloom.llm.prefix import prefix_sums

#: Weights of the sources, by rank, repeating; copies of a document at most.
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240607
#: Sources whose plan is broadcast at most: some hundred bytes each. With more, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000

_FIRST = -(1 << 63)


def words_in(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def length_class(size: Column) -> Column:
    """How many binary digits a number of words has (0 has one): the longer, the likelier to be taken."""
    return F.length(F.bin(size)).cast("int")


def draw(seed: int = SEED) -> Column:
    """A number in (0, 1) for each row, from a digest of the seed, its id and its text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """The words that each source is to give. ``sizes``: a row for each source, ``source``, ``source_size``.

    Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share the sum of all
    sizes by weight; none gives more than ``MOST`` times its size, and what is cut off is shared out
    again. The fixed point is found at once: in order of size by weight, the sources that are cut come
    first, and the level of the others is what remains by their weight. The order is over sources, not
    over documents: one task has a few numbers for each.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("no", rank.cast("int")).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "no")
    ahead, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    found = F.coalesce(F.min(F.when(F.col("open"), F.struct(F.col("cap").cast("double") / F.col("weight"), "no", "level"))).over(every).getField("level"), F.lit(0.0))
    return s.select("source", "no", "source_size", F.least(F.col("cap").cast("double"), found * F.col("weight")).alias("target"))


def expected(slim: DataFrame) -> DataFrame:
    """For each source its ``target`` and, by length class, how often a document is to come: ``each``.

    A document of class c is to come ``least(MOST, rate * c)`` times. The rate of a source is such that the
    words of all its documents, taken so often, make its target: the classes that reach ``MOST`` are the
    longest, and the rate of the others is what remains by their words times class.
    """
    classes = slim.groupBy("source", "class").agg(F.sum("size").alias("words"))
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "_source")
    rows = classes.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    longest = Window.partitionBy("no").orderBy(F.col("class").desc())
    longer, every = longest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("no")
    weighed = F.col("class").cast("long") * F.col("words")
    left = F.col("target") - (MOST * F.coalesce(F.sum("words").over(longer), F.lit(0))).cast("double")
    rate = left / (F.sum(weighed).over(every) - F.coalesce(F.sum(weighed).over(longer), F.lit(0))).cast("double")
    rows = rows.withColumn("rate", F.when(F.sum(weighed).over(longest.rowsBetween(Window.currentRow, Window.unboundedFollowing)) > 0, rate).otherwise(0.0))
    # The first class, from the longest, that stays below MOST gives the rate; where none does all come that often.
    rate = F.max(F.when(F.col("rate") * F.col("class") <= MOST, F.struct("class", "rate"))).over(every).getField("rate")
    each = F.when(F.col("target") >= F.col("source_size") * MOST, float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.coalesce(rate, F.lit(float(MOST))) * F.col("class")))
    rows = rows.withColumn("each", each).withColumn("whole", F.floor("each")).withColumn("p", F.col("each") - F.floor("each"))
    own = F.map_from_entries(F.collect_list(F.struct("class", F.struct("whole", "p")))).alias("each")
    lacking = (F.col("target") - F.sum(F.col("whole") * F.col("words"))).alias("lacking")
    return rows.groupBy("source", "no", "source_size", "target").agg(own, lacking)


def plan(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Slim rows of ``docs`` and, for each source, what it takes: whole copies by length class, and the last drawn row.

    The whole part of how often a document is to come is certain; the rest is its inclusion probability p
    for one more copy. The documents of a source are ranked by their random odds u / (1 - u) over their
    inclusion odds p / (1 - p), and those of least rank are taken up to the words that the source still
    lacks: the sample's size is fixed, in words, to within one document.
    """
    size = words_in()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), draw(seed).alias("u"))
    slim = cut(slim.withColumn("class", length_class(F.col("size"))))
    goal = cut(expected(slim))
    ranked = with_plan(slim, goal).where("p > 0").select("no", "rank", "doc_id", "size", "lacking")
    drawn = prefix_sums(ranked, ["rank", "doc_id", "size"], ["size"], group="no").where("2 * before_size + size <= 2 * lacking")
    last = drawn.groupBy("no").agg(F.max(F.struct("rank", F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), "size")).alias("last"))
    return slim, cut(goal.join(last, "no", "left"))


def with_plan(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with what ``goal`` has of their source, and ``whole``, ``p`` and ``rank`` of each row.

    The plan is small where sources are: then the rows, which may hold texts, are not moved.
    """
    found = goal.withColumnRenamed("source", "_source")
    found = F.broadcast(found) if goal.count() <= BROADCAST_SOURCES else found
    out = rows.join(found, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = F.col("each")[F.col("class")]
    out = out.withColumn("whole", own["whole"]).withColumn("p", own["p"]).drop("each")
    return out.withColumn("rank", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))))


def copies(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (``doc_id``, ``source``, ``size``, ``u``, ``class`` and any more) with what ``plan`` found and ``copies``."""
    one = F.struct("rank", F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), "size") <= F.col("last")
    return with_plan(rows, goal).withColumn("copies", (F.col("whole") + F.when(F.coalesce(one & (F.col("p") > 0), F.lit(False)), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What each row of ``docs`` (``doc_id``, ``text``, ``source``) gives to the mix.

    Returns ``doc_id``, ``size`` (its words), ``source_size``, ``target`` (of its source), ``taken``
    (its words in the mix, repeats counted), ``copies`` and ``p`` (its inclusion probability beyond whole
    copies). Null, empty and wordless texts have no words; null is a source of its own, the last. A very long
    text counts as any other: its source misses its target by half of it at most. Equal rows draw the
    same number and count one after the other, and of those at the boundary all are taken or none. An empty
    table gives no rows. Other columns, of whatever name, are not read.
    """
    slim, goal = plan(docs, seed)
    return copies(slim, goal).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "p")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``. Cases as for ``mix``."""
    _, goal = plan(docs, seed)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in().alias("size"), draw(seed).alias("u"))
    rows = copies(rows.withColumn("class", length_class(F.col("size"))), goal).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
