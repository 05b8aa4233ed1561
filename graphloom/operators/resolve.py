"""Entity resolution and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text, vectors

TRIGRAM_THRESHOLD, COSINE_THRESHOLD = 0.4, 0.9


def trigram_pairs(left: DataFrame, right: DataFrame, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """Names of ``left`` and ``right`` (``name``) that are similar enough: ``name``, ``other``, ``similarity``.

    With trigrams in one order of rarity, two sets that share enough meet in one of the first
    ``n - ceil(threshold n) + 1`` of each. Only those are joined: a trigram that very many names have is
    among the first of few. Sets whose sizes differ by more than the threshold allows don't meet.
    """
    cut = lambda df: df.select("name").distinct().withColumn("t", text.trigrams(F.col("name"))).select("name", F.size("t").alias("n"), F.explode("t").alias("t"))
    x, y = cut(left), cut(right)
    counts = x.select("t").unionByName(y.select("t")).groupBy("t").agg(F.count("*").alias("df"))

    def heads(rows: DataFrame) -> DataFrame:
        ranked = rows.join(counts, "t").groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("own"))
        length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
        return ranked.select("name", "n", F.explode(F.slice("own", F.lit(1), length.cast("int"))["t"]).alias("t"))

    a, b = heads(x).alias("x"), heads(y).alias("y")
    sized = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9
    met = a.join(b, (F.col("x.t") == F.col("y.t")) & sized).select(F.col("x.name").alias("name"), F.col("y.name").alias("other")).distinct()
    one, two = text.trigrams(F.col("name")), text.trigrams(F.col("other"))
    both = F.size(F.array_intersect(one, two))
    out = met.withColumn("similarity", both / (F.size(one) + F.size(two) - both))
    return out.where(F.col("similarity") >= threshold).select("name", "other", "similarity")


def best_matches(wanted: DataFrame, known: DataFrame, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """For each ``name`` of ``wanted`` the most similar of ``known``; names with a digit match nothing but themselves."""
    plain = wanted.where(~F.col("name").rlike("[0-9]"))
    own = Window.partitionBy("name").orderBy(F.desc("similarity"), "other")
    return trigram_pairs(plain, known, threshold).withColumn("rank", F.row_number().over(own)).where("rank = 1").drop("rank")


def fields(x: Column) -> Column:
    """The fields of a JSON object as text, each of its own type; null counts as empty."""
    kind = "map<string,variant>"
    return F.coalesce(F.from_json(x, kind), F.from_json(F.lit("{}"), kind))


def merged_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects as text, right wins; numbers, booleans, lists and objects stay what they are."""
    a, b = fields(old), fields(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def history(metadata: Column, source: str) -> Column:
    """``metadata`` with ``source`` added to the list ``_merged_from``; a single name from before counts as a list of one."""
    before = fields(metadata)["_merged_from"]
    listed = F.coalesce(F.try_variant_get(before, "$", "array<string>"), F.when(before.isNotNull(), F.array(F.try_variant_get(before, "$", "string"))), F.array().cast("array<string>"))
    return merged_json(metadata, F.to_json(F.struct(F.array_append(listed, F.lit(source)).alias("_merged_from"))))


def resolve(entities: DataFrame, nodes: DataFrame, fuzzy: bool = True, trigram_threshold: float = TRIGRAM_THRESHOLD, cosine_threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """The node of every entity: ``name`` (as given), ``content`` (of the node), ``how`` and ``similarity``.

    ``entities``: ``name``, ``embedding``, ``at`` (order; of one normal form the last counts); ``nodes``:
    ``content``, ``embedding``, as they were before. Exact by normal form; else fuzzy, where the single
    most similar known name must pass both thresholds (if it fails by cosine, no second is tried); else
    a new node of that normal form.
    """
    given = entities.withColumn("key", text.normalize(F.col("name")))
    last = given.groupBy("key").agg(F.max_by("embedding", "at").alias("embedding"))
    known = nodes.select(F.col("content").alias("other"), F.col("embedding").alias("other_embedding"))
    exact = last.join(known, last["key"] == known["other"], "left_semi").select("key", F.col("key").alias("content"), F.lit("exact").alias("how"), F.lit(1.0).alias("similarity"))
    rest = last.join(exact.select("key"), "key", "left_anti")
    out = exact
    if fuzzy:
        best = best_matches(rest.select(F.col("key").alias("name")), nodes.select(F.col("content").alias("name")), trigram_threshold)
        tried = rest.join(best.withColumnRenamed("name", "key"), "key").join(known, "other")
        close = tried.where(vectors.cosine(F.col("embedding"), F.col("other_embedding")) >= cosine_threshold)
        close = close.select("key", F.col("other").alias("content"), F.lit("fuzzy").alias("how"), "similarity")
        out = out.unionByName(close)
        rest = rest.join(close.select("key"), "key", "left_anti")
    out = out.unionByName(rest.select("key", F.col("key").alias("content"), F.lit("new").alias("how"), F.lit(None).cast("double").alias("similarity")))
    return given.select("name", "key").distinct().join(out, "key").select("name", "content", "how", "similarity")


def folded(edges: DataFrame) -> DataFrame:
    """Edges with one row for each ``src``, ``dst``, ``relation``: manual weights summed, the last metadata's fields win."""
    grouped = edges.groupBy("src", "dst", "relation").agg(F.sum("manual").alias("manual"), F.sort_array(F.collect_list(F.struct("edge_id", "metadata"))).alias("all"))
    merged = F.aggregate("all", F.lit("{}"), lambda a, e: merged_json(a, e["metadata"]))
    return grouped.select(F.element_at("all", 1)["edge_id"].alias("edge_id"), "src", "dst", "relation", "manual", merged.alias("metadata"), F.transform("all", lambda e: e["edge_id"]).alias("was"))


def merge(nodes: DataFrame, edges: DataFrame, edge_mentions: DataFrame, entity_mentions: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and mentions after ``source`` has become ``target``.

    Edges of the source go to the target, those that become equal are folded, those that would become
    self-loops are dropped; mentions follow without repeats; the target's metadata lists its sources, the
    latest last, under ``_merged_from``. An unknown node is an error, merging a node with itself changes nothing.
    """
    if source == target:
        return nodes, edges, edge_mentions, entity_mentions
    if nodes.where(F.col("node_id").isin(source, target)).select("node_id").distinct().count() < 2:
        raise ValueError("both nodes must exist")
    to = lambda c: F.when(F.col(c) == source, target).otherwise(F.col(c))
    # Only edges of the two nodes can change or become equal.
    touched = F.col("src").isin(source, target) | F.col("dst").isin(source, target)
    moved = edges.where(touched).withColumn("src", to("src")).withColumn("dst", to("dst"))
    moved = folded(moved.where((F.col("src") != F.col("dst")) | (F.col("src") != target)))
    renamed = moved.select("edge_id", F.explode("was").alias("old"))
    gone = edges.where(touched).select("edge_id")
    mentions = edge_mentions.join(renamed, edge_mentions["edge_id"] == renamed["old"]).select(renamed["edge_id"], "chunk_id")
    mentions = edge_mentions.join(gone, "edge_id", "left_anti").select("edge_id", "chunk_id").unionByName(mentions).distinct()
    moved = edges.where(~touched).select(*moved.drop("was").columns).unionByName(moved.drop("was"))
    entities = entity_mentions.withColumn("node_id", to("node_id")).distinct()
    left = nodes.where(F.col("node_id") != source).withColumn("metadata", F.when(F.col("node_id") == target, history(F.col("metadata"), source)).otherwise(F.col("metadata")))
    return left, moved, mentions, entities
