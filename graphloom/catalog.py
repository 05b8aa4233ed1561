"""The engine's own queries over the supplied tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import relations as rel
from graphloom.functions import text, vectors
from graphloom.functions.filters import compiled
from graphloom.operators import communities, evaluation, graph, grounding, resolve, search
from graphloom.plans import ingest, retrieve
from graphloom.session import table
from graphloom.sources import readers, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = "which license applies: the Apache License, version 2.0, or the MIT License"
SPOKEN = "the of and thing there heer tion er"


def query(sql: str | None = None, uses: str = "") -> Callable:
    """Registers a query under its name with its SQL; ``uses`` names shared relations in the order they build up."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            shared = [f"{n} AS ({rel.SQL[n]})" for n in uses.split()]
            body = sql.strip()
            if shared and body.upper().startswith("WITH RECURSIVE"):
                body = "WITH RECURSIVE " + ", ".join(shared) + ", " + body[len("WITH RECURSIVE") :]
            elif shared and body.upper().startswith("WITH"):
                body = "WITH " + ", ".join(shared) + ", " + body[len("WITH") :]
            elif shared:
                body = "WITH " + ", ".join(shared) + " " + body
            ORACLES[f.__name__] = body
        return f

    return add


# Scans and filters


@query("SELECT lang AS tenant_id, source AS namespace, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY ALL")
def tenant_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    bound = rel.documents(spark, d).where(F.col("tenant_id") == F.lit("en"))
    return bound.groupBy("tenant_id", "namespace").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE false GROUP BY lang")
def tenant_unbound(spark: SparkSession, d: str) -> DataFrame:
    return rel.documents(spark, d).where(F.col("tenant_id") == F.lit(None)).groupBy("lang").agg(F.count("*").alias("n"))


def _filtered(wanted: dict | list) -> Callable:
    return lambda spark, d: table(spark, d, "events").where(compiled(F.col("props"), wanted)).select("event_id", "event_type", "props")


@query("SELECT event_id, event_type, props FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) >= 50")
def meta_filter_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _filtered([{"field": "k", "op": "gte", "value": 50}])(spark, d)


@query("SELECT event_id, event_type, props FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) <> 7 AND CAST(props ->> '$.k' AS DOUBLE) < 30")
def meta_filter_compare(spark: SparkSession, d: str) -> DataFrame:
    return _filtered([{"field": "k", "op": "neq", "value": 7}, {"field": "k", "op": "lt", "value": 30}])(spark, d)


@query("SELECT event_id, event_type, props FROM events WHERE (props ->> '$.k') IN ('3', '5', '8')")
def meta_filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _filtered([{"field": "k", "op": "in", "value": [3, 5, 8]}])(spark, d)


@query("SELECT event_id, event_type, props FROM events WHERE CAST(props ->> '$.k' AS DOUBLE) = 4")
def meta_contains(spark: SparkSession, d: str) -> DataFrame:
    return _filtered({"k": 4})(spark, d)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice > 1000")
def meta_filter_range_ts(spark: SparkSession, d: str) -> DataFrame:
    meta = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("o_totalprice").alias("total")))
    wanted = [{"field": "at", "op": "gte", "value": "1995-01-01"}, {"field": "at", "op": "lt", "value": "1996-01-01"}, {"field": "total", "op": "gt", "value": 1000}]
    return table(spark, d, "orders").where(compiled(meta, wanted)).select("o_orderkey", "o_custkey")


# Texts


@query("SELECT doc_id, ordinal, content, sha256(content) AS content_hash FROM chunks", uses="chunks")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return rel.chunks(spark, d).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content", text.content_hash(F.col("content")).alias("content_hash"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hash FROM documents")
def normalize_hash(spark: SparkSession, d: str) -> DataFrame:
    normal = text.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", normal.alias("normal"), text.content_hash(normal).alias("hash"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')) AS w FROM documents)
    SELECT doc_id, CAST(CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 64 AS INTEGER) AS slot,
    sum(CASE WHEN CAST('0x' || substr(sha256(w), 9, 2) AS BIGINT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS total FROM t GROUP BY ALL"""
)
def token_feature_hash(spark: SparkSession, d: str) -> DataFrame:
    # Each distinct token of a document is hashed once, as often as it may stand there.
    tokens = table(spark, d, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("token")).groupBy("doc_id", "token").count()
    slots = tokens.select("doc_id", "count", text.feature_slot(F.col("token"), 64).alias("s"))
    return slots.groupBy("doc_id", F.col("s.slot").alias("slot")).agg(F.sum(F.col("s.sign") * F.col("count")).alias("total"))


@query(
    r"""WITH a AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\b[A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)+\b'), lambda x: lower(x))) AS found FROM documents)
    SELECT doc_id, anchor, regexp_replace(anchor, '[-_.]+', ' ', 'g') AS loosened FROM (SELECT doc_id, unnest(found) AS anchor FROM a)"""
)
def identifier_anchors(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(text.anchors(F.col("text"))).alias("anchor"))
    return found.withColumn("loosened", text.loosened(F.col("anchor")))


_FACTS = [f"Service{k} {p} Team{k % 3}. Then Alpha {p} Beta Gamma{k} quickly." for k, p in enumerate(text.PREDICATES)]


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"('Service{k}', '{p}', 'Team{k % 3}'), ('Then Alpha', '{p}', 'Beta Gamma{k}')" for k, p in enumerate(text.PREDICATES))
    + ") AS t(subject, predicate, object)"
)
def offline_triplets(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _FACTS], "text string")
    return rows.select(F.explode(text.triplets(F.col("text"))).alias("t")).select("t.*")


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS tokens, '[' || source || '#' || doc_id || ']' AS citation FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.citation(F.col("source"), F.col("doc_id")).alias("citation"))


@query("SELECT 'supplier: s_suppkey=' || s_suppkey || ', s_name=' || s_name || ', s_nationkey=' || s_nationkey AS text, s_name AS entity FROM supplier")
def record_texts(spark: SparkSession, d: str) -> DataFrame:
    return readers.records(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier", "s_name").select("text", "entity")


# Vectors and search


@query(
    """SELECT v.vec_id, v.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, vec_id LIMIT 10"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    best = vectors.nearest(table(spark, d, "embeddings"), vectors.literal(rel.query_vector(spark, d)), 10, "vec_id")
    return best.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    """SELECT v.vec_id, v.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE v.label IN (1, 4) ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, vec_id LIMIT 10"""
)
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    meta = F.to_json(F.struct("label"))
    rows = table(spark, d, "embeddings").where(compiled(meta, [{"field": "label", "op": "in", "value": [1, 4]}]))
    return vectors.nearest(rows, vectors.literal(rel.query_vector(spark, d, 3)), 10, "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    """SELECT n.node_id, n.content, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
    FROM nodes n JOIN embeddings v ON v.vec_id = n.key, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE n.kind = 'S'
    ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, n.node_id LIMIT 5""",
    uses="nodes",
)
def node_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vecs = table(spark, d, "embeddings").select(F.concat(F.lit("S:"), F.col("vec_id").cast("string")).alias("node_id"), "embedding")
    rows = rel.nodes(spark, d).join(vecs, "node_id")
    return vectors.nearest(rows, vectors.literal(rel.query_vector(spark, d, 5)), 5, "node_id").select("node_id", "content", F.round("similarity", 6).alias("similarity"))


def _terms(question: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.query_terms(question)) + "]"


_LEX = f"""lex AS (SELECT chunk_id, 0.1 * hits AS lex_score, row_number() OVER (ORDER BY hits DESC, chunk_id) AS lex_rank FROM (
    SELECT chunk_id, len(list_filter(list_transform(regexp_extract_all(content, '[A-Za-z0-9][A-Za-z0-9\\-_.]*'), lambda x: lower(x)), lambda x: list_contains({_terms(QUESTION)}, x))) AS hits FROM chunks) WHERE hits > 0 QUALIFY lex_rank <= 40)"""
_SEM = """sem AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS sem_rank FROM (
    SELECT chunk_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embedded e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY sem_rank <= 40)"""
_RRF = """fused AS (SELECT chunk_id, coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + sem_rank), 0) AS rrf, lex_rank, sem_rank FROM lex FULL JOIN sem USING (chunk_id) ORDER BY rrf DESC, chunk_id LIMIT 10)"""


@query(f"WITH {_LEX} SELECT chunk_id, round(lex_score, 6) AS lex_score, lex_rank FROM lex", uses="chunks")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical(rel.chunks(spark, d), QUESTION).select("chunk_id", F.round("lex_score", 6).alias("lex_score"), "lex_rank")


@query(f"WITH {_SEM} SELECT * FROM sem", uses="chunks embedded")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic(rel.embedded_chunks(spark, d), vectors.literal(rel.query_vector(spark, d))).select("chunk_id", "sem_rank")


@query(
    f"WITH {_LEX}, {_SEM}, {_RRF} SELECT chunk_id, doc_id, tenant_id, namespace, content, lex_rank, sem_rank, round(rrf, 9) AS rrf_score FROM fused JOIN chunks USING (chunk_id)",
    uses="chunks embedded",
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    found = search.hybrid(rel.embedded_chunks(spark, d), QUESTION, vectors.literal(rel.query_vector(spark, d)))
    return found.select("chunk_id", "doc_id", "tenant_id", "namespace", "content", "lex_rank", "sem_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(
    """WITH o AS (SELECT o_orderkey AS chunk_id, CAST(o_totalprice AS DOUBLE) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
    m AS (SELECT DISTINCT l_orderkey AS chunk_id, 'P:' || l_partkey AS node_id FROM lineitem), b AS (SELECT node_id, max(score) AS raw FROM m JOIN o USING (chunk_id) GROUP BY node_id)
    SELECT node_id, round(raw / (SELECT max(raw) FROM b), 9) AS score FROM b"""
)
def seed_scores(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"))
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("node_id")).distinct()
    return search.seed_scores(mentions, top).select("node_id", F.round("score", 9).alias("score"))


@query("SELECT DISTINCT 'P:' || l_partkey AS node_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def mentioned_nodes(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    mentions = line.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("node_id"))
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk_id"))
    return search.mentioned_nodes(mentions, urgent)


# Resolution

_TRIGRAMS = r"""names AS (SELECT DISTINCT p_name AS name FROM part),
    w AS (SELECT name, unnest(list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM names),
    t AS (SELECT DISTINCT name, substr('  ' || w || ' ', i, 3) AS t FROM (SELECT name, w, unnest(range(1, length(w) + 2)) AS i FROM w)),
    n AS (SELECT name, count(*) AS n FROM t GROUP BY name),
    pairs AS (SELECT x.name, y.name AS other, count(*) / (max(a.n) + max(b.n) - count(*)) AS similarity FROM t x JOIN t y USING (t) JOIN n a ON a.name = x.name JOIN n b ON b.name = y.name GROUP BY x.name, y.name)"""


@query(f"WITH {_TRIGRAMS} SELECT name, other, round(similarity, 9) AS similarity FROM pairs WHERE similarity >= 0.4 AND name < other")
def trigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return resolve.trigram_pairs(names, names).where("name < other").select("name", "other", F.round("similarity", 9).alias("similarity"))


@query(
    f"""WITH {_TRIGRAMS} SELECT name, other, round(similarity, 9) AS similarity FROM pairs WHERE similarity >= 0.4 AND name <> other AND NOT regexp_matches(name, '[0-9]')
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, other) = 1"""
)
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = resolve.trigram_pairs(names.where(~F.col("name").rlike("[0-9]")), names).where("name <> other")
    own = Window.partitionBy("name").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("r", F.row_number().over(own)).where("r = 1").select("name", "other", F.round("similarity", 9).alias("similarity"))


@query(
    """WITH k AS (SELECT DISTINCT p_name FROM part) SELECT DISTINCT name, content, how FROM (
    SELECT '  ' || p_name || ' ' AS name, p_name AS content, 'exact' AS how FROM k
    UNION ALL SELECT p_name || ' 99x', p_name || ' 99x', 'new' FROM k)"""
)
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    vector = F.array(F.lit(1.0)).cast("array<float>").alias("embedding")
    given = names.select(F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"), vector, F.lit(1).alias("at")).unionByName(names.select(F.concat("name", F.lit(" 99x")).alias("name"), vector, F.lit(1).alias("at")))
    return resolve.resolve(given, names.select(F.col("name").alias("content"), vector)).select("name", "content", "how")


# Graph


@query("SELECT src, dst, relation, support, weight FROM edges WHERE relation = 'supplies'", uses="edges")
def edge_support(spark: SparkSession, d: str) -> DataFrame:
    bare = rel.edges(spark, d).where("relation = 'supplies'").drop("support", "weight")
    return graph.supported(bare, rel.edge_mentions(spark, d)).select("src", "dst", "relation", "support", "weight")


@query("SELECT relation, count(*) AS n, sum(support) AS support, sum(weight) AS weight FROM edges GROUP BY relation", uses="edges")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return rel.edges(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.sum("support").alias("support"), F.sum("weight").alias("weight"))


def _neighbours(walk: graph.Walk) -> str:
    kept = f"weight >= {walk.min_weight}"
    if walk.relations:
        kept += " AND relation IN (" + ", ".join(f"'{r}'" for r in walk.relations) + ")"
    if walk.without:
        kept += " AND relation NOT IN (" + ", ".join(f"'{r}'" for r in walk.without) + ")"
    back = "" if walk.directed else f" UNION ALL SELECT edge_id, dst, src, relation, weight FROM edges WHERE src <> dst AND {kept}"
    return f"""ends AS (SELECT edge_id, src AS a, dst AS b, relation, weight FROM edges WHERE {kept}{back}),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, edge_id) AS rk FROM ends) WHERE rk <= {walk.fan_out})"""


def _walked(walk: graph.Walk, seeds: str) -> str:
    return f"""WITH RECURSIVE {_neighbours(walk)}, seeds(node_id, score) AS (VALUES {seeds}),
    walk AS (SELECT node_id, 0 AS depth, CAST(score AS DOUBLE) AS score, [node_id] AS seen FROM seeds
    UNION ALL SELECT nb.b, depth + 1, score * {walk.decay}::DOUBLE * (1 - exp(-weight)), list_append(seen, nb.b) FROM walk JOIN nb ON nb.a = walk.node_id WHERE depth < {walk.hops} AND NOT list_contains(seen, nb.b)),
    reached AS (SELECT node_id, min(depth) AS hops, max(score) AS score FROM walk GROUP BY node_id)"""


_SEEDS = "('S:1', 1.0), ('C:1', 0.5)"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("S:1", 1.0), ("C:1", 0.5)], "node_id string, score double")


def _traversal(name: str, walk: graph.Walk) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return graph.traverse(rel.nodes(spark, d), rel.edges(spark, d), _seeds(spark), walk).select("node_id", "hops", F.round("score", 9).alias("score"))

    run.__name__ = name
    query(_walked(walk, _SEEDS) + " SELECT node_id, hops, round(score, 9) AS score FROM reached", uses="edges")(run)


_traversal("traverse_1hop", graph.Walk(hops=1))
_traversal("traverse_2hop", graph.Walk(hops=2))
_traversal("traverse_3hop", graph.Walk(hops=3, fan_out=10))
_traversal("traverse_directed", graph.Walk(hops=3, directed=True))
_traversal("traverse_filtered", graph.Walk(hops=3, relations=("supplies", "located_in"), without=("part_of",), min_weight=1.0, decay=0.5, fan_out=8))


@query(f"WITH {_neighbours(graph.Walk(fan_out=5, without=('part_of',)))} SELECT a AS at, b AS \"to\", relation, weight, rk AS rank FROM nb", uses="edges")
def neighbors_topk(spark: SparkSession, d: str) -> DataFrame:
    out = graph.neighbours(rel.edges(spark, d), graph.Walk(fan_out=5, without=("part_of",)))
    return out.select("at", "to", "relation", "weight", F.col("rank").cast("long").alias("rank"))


@query(_walked(graph.Walk(hops=1), _SEEDS) + " SELECT src, dst, relation, weight FROM edges WHERE src IN (SELECT node_id FROM reached) AND dst IN (SELECT node_id FROM reached)", uses="edges")
def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = rel.edges(spark, d)
    reached = graph.traverse(rel.nodes(spark, d), edges, _seeds(spark), graph.Walk(hops=1))
    return graph.induced(edges, reached).select("src", "dst", "relation", "weight")


def _path_sql(walk: graph.Walk, sources: str, targets: str, k: int) -> str:
    return f"""WITH RECURSIVE {_neighbours(walk)}, walk AS (SELECT s AS source_id, s AS spot, 0 AS depth, 1.0::DOUBLE AS score, [s] AS seen, s AS path FROM (VALUES {sources}) x(s)
    UNION ALL SELECT source_id, nb.b, depth + 1, score * (1 - exp(-weight)), list_append(seen, nb.b), path || ' -' || relation || '- ' || nb.b FROM walk JOIN nb ON nb.a = walk.spot WHERE depth < {walk.hops} AND NOT list_contains(seen, nb.b))
    SELECT source_id, spot AS target_id, depth, round(score, 9) AS score, path FROM walk WHERE spot IN ({targets}) ORDER BY walk.score DESC, depth, source_id, path LIMIT {k}"""


def _path_text(paths: DataFrame) -> DataFrame:
    shown = F.aggregate(F.slice("path", 2, 9), F.element_at("path", 1)["node_id"], lambda a, p: F.concat(a, F.lit(" -"), p["relation"], F.lit("- "), p["node_id"]))
    return paths.select("source_id", "target_id", "depth", F.round("score", 9).alias("score"), shown.alias("path"))


_PATH = graph.Walk(hops=3, directed=True)


@query(_path_sql(_PATH, "('C:1')", "SELECT 'R:' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1", 1), uses="edges")
def best_path(spark: SparkSession, d: str) -> DataFrame:
    to = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return _path_text(graph.best_path(rel.nodes(spark, d), rel.edges(spark, d), "C:1", f"R:{to}", _PATH))


@query(_path_sql(_PATH, "('S:1'), ('S:2'), ('C:7')", "'R:0', 'R:1', 'R:2', 'R:3', 'R:4'", 5), uses="edges")
def topk_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = rel.nodes(spark, d)
    pick = lambda *ids: nodes.where(F.col("node_id").isin(*ids)).select("node_id")
    return _path_text(graph.top_paths(nodes, rel.edges(spark, d), pick("S:1", "S:2", "C:7"), pick("R:0", "R:1", "R:2", "R:3", "R:4"), _PATH, 5))


@query(
    """SELECT DISTINCT 'S:' || l_suppkey || '>supplies>P:' || l_partkey AS edge_id, o_orderkey AS chunk_id, o_custkey AS document_id, c_name AS source_id, o_orderpriority AS content
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
)
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    mentions = rel.edge_mentions(spark, d)
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.lit(0).alias("ordinal"), F.col("o_orderpriority").alias("content"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("source_id"))
    return graph.evidence(mentions, chunks, docs, "edge_id").drop("ordinal")


@query("SELECT DISTINCT 'P:' || l_partkey AS node_id, o_custkey AS document_id, c_name AS source_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def mentioning_documents(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "lineitem").select(F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("node_id"), F.col("l_orderkey").alias("chunk_id"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("").alias("content"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("source_id"))
    return graph.evidence(mentions, chunks, docs, "node_id").select("node_id", "document_id", "source_id").distinct()


@query(
    _walked(graph.Walk(hops=1), _SEEDS)
    + """ SELECT src, dst, relation, round((a.score + b.score) / 2 * (1 - pow(2.718281828, -weight)), 9) AS score FROM edges JOIN reached a ON a.node_id = src JOIN reached b ON b.node_id = dst
    ORDER BY (a.score + b.score) / 2 * (1 - pow(2.718281828, -weight)) DESC, weight DESC, relation, src, dst LIMIT 50""",
    uses="edges",
)
def shown_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = rel.edges(spark, d)
    reached = graph.traverse(rel.nodes(spark, d), edges, _seeds(spark), graph.Walk(hops=1))
    side = lambda p: reached.select(F.col("node_id").alias(p), F.col("score").alias(f"{p}_score"))
    out = graph.induced(edges, reached).join(side("src"), "src").join(side("dst"), "dst").withColumn("score", graph.shown_score(F.col("src_score"), F.col("dst_score"), F.col("weight")))
    return out.orderBy(F.desc("score"), F.desc("weight"), "relation", "src", "dst").limit(50).select("src", "dst", "relation", F.round("score", 9).alias("score"))


# State changes


@query(
    """WITH o AS (SELECT doc_id, sha256(text) AS h, source FROM documents WHERE doc_id % 3 <> 0),
    n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 1)
    SELECT doc_id, coalesce(n.h, o.h) AS content_hash, n.doc_id IS NOT NULL AND o.h IS DISTINCT FROM n.h AS content_changed,
    CASE WHEN n.doc_id IS NOT NULL AND o.h IS DISTINCT FROM n.h THEN 'pending' ELSE 'ready' END AS extraction_status, o.source AS source, CASE WHEN n.doc_id IS NOT NULL THEN '2' ELSE '1' END AS rev FROM o FULL JOIN n USING (doc_id)"""
)
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 3 <> 0").select("document_id", F.col("source").alias("source_id"), text.content_hash(F.col("text")).alias("content_hash"), F.to_json(F.struct("source", F.lit("1").alias("rev"))).alias("metadata"))
    old = old.withColumns({"status": F.lit("active"), "extraction_status": F.lit("ready"), "extraction_error": F.lit(None).cast("string"), "extraction_attempts": F.lit(1), "updated_at": F.lit("2026-01-01").cast("timestamp")})
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 3 <> 1").select("document_id", F.col("source").alias("source_id"), text.content_hash(changed).alias("content_hash"), F.lit('{"rev":"2"}').alias("metadata"))
    out = store.upsert_documents(old, new)
    return out.select(F.col("document_id").cast("long").alias("doc_id"), "content_hash", "content_changed", "extraction_status", F.get_json_object("metadata", "$.source").alias("source"), F.get_json_object("metadata", "$.rev").alias("rev"))


@query(
    """SELECT doc_id, ordinal, content FROM chunks WHERE doc_id % 4 <> 0
    UNION ALL SELECT doc_id, k, substr(text, k * 450 + 1, 500) FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 450.0) AS BIGINT))) AS k FROM documents WHERE doc_id % 4 = 0)""",
    uses="chunks",
)
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    old = rel.chunks(spark, d).select(F.col("doc_id").alias("document_id"), F.col("ordinal").cast("long").alias("ordinal"), "content")
    docs = table(spark, d, "documents").where("doc_id % 4 = 0")
    new = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(text.chunks(F.col("text"), 500, 50)).alias("ordinal", "content")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return store.replace_chunks(old, new).select(F.col("document_id").alias("doc_id"), "ordinal", "content")


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 1)
    SELECT 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst, count(*) AS support FROM m GROUP BY ALL"""
)
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("document_id"))
    none = spark.createDataFrame([], "chunk_id long, node_id string")
    tables = {"documents": orders.select("document_id"), "chunks": orders, "entity_mentions": none, "edge_mentions": rel.edge_mentions(spark, d)}
    left = store.delete_documents(tables, orders.where("document_id % 2 = 0").select("document_id"))
    bare = rel.edges(spark, d).where("relation = 'supplies'").drop("support", "weight")
    return graph.supported(bare, left["edge_mentions"]).select("src", "dst", "support")


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, CASE WHEN l_suppkey = 2 THEN 1 ELSE l_suppkey END AS s, l_partkey AS p FROM lineitem)
    SELECT 'S:' || s AS src, 'P:' || p AS dst, 'supplies' AS relation, count(*) AS support, 0.0::DOUBLE AS manual FROM m GROUP BY ALL
    UNION ALL SELECT 'S:' || s, 'N:' || n, 'located_in', 0, sum(1.0::DOUBLE) FROM (SELECT CASE WHEN s_suppkey = 2 THEN 1 ELSE s_suppkey END AS s, s_nationkey AS n FROM supplier) GROUP BY s, n"""
)
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    bare = rel.edges(spark, d).where("src LIKE 'S:%'").drop("support", "weight").withColumn("metadata", F.lit("{}"))
    none = spark.createDataFrame([], "chunk_id long, node_id string")
    _, edges, mentions, _ = resolve.merge(rel.nodes(spark, d), bare, rel.edge_mentions(spark, d), none, "S:2", "S:1")
    return graph.supported(edges, mentions).select("src", "dst", "relation", "support", "manual")


@query(
    """SELECT src, dst, relation, sum(w) AS manual FROM (SELECT 'C:' || c_custkey AS src, 'N:' || c_nationkey AS dst, 'located_in' AS relation, 1.0::DOUBLE AS w FROM customer
    UNION ALL SELECT 'C:' || o_custkey, 'N:' || c_nationkey, 'located_in', 0.5 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0) GROUP BY ALL"""
)
def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    old = rel.edges(spark, d).where("src LIKE 'C:%'").select("edge_id", "src", "dst", "relation", "manual", F.lit("{}").alias("metadata"))
    orders = table(spark, d, "orders").where("o_orderkey % 10 = 0").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    new = orders.select(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("located_in").alias("relation"), F.lit(0.5).alias("weight"), F.lit("{}").alias("metadata"))
    return ingest.upsert_edges(old, new).select("src", "dst", "relation", "manual")


@query("SELECT c.doc_id, ordinal FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id)", uses="chunks")
def unfinished_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = rel.chunks(spark, d).select(F.col("doc_id").cast("string").alias("content_hash"), F.col("doc_id").alias("document_id"), F.col("ordinal").cast("long").alias("ordinal"))
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("content_hash"), F.lit("done").alias("status"))
    return store.unfinished(chunks, done).select(F.col("document_id").alias("doc_id"), "ordinal")


# Communities


@query(
    """WITH e AS (SELECT src, dst, weight FROM edges WHERE relation = 'supplies'), s AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
    v AS (SELECT node, other AS label, round(sum(1 - exp(-weight)), 9) AS score FROM s GROUP BY node, other) SELECT node, label, score FROM v QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, label) = 1""",
    uses="edges",
)
def lpa_vote_step(spark: SparkSession, d: str) -> DataFrame:
    edges = rel.edges(spark, d).where("relation = 'supplies'")
    labels = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("label", F.col("node_id"))
    return communities.votes(edges, labels).select("node", "label", "score")


def _by_nation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    located = rel.edges(spark, d).where("relation = 'located_in'").select(F.col("dst").alias("namespace"), "src", "dst", "weight")
    return located.select("namespace", F.explode(F.array("src", "dst")).alias("node_id")).distinct(), located


@query()
def lpa_communities(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _by_nation(spark, d)
    return communities.communities(nodes, edges, ["namespace"])


@query("SELECT 'N:' || n AS namespace, CASE WHEN count(*) > 0 THEN 'c' END AS community_id, list_sort(list(m)) AS members, count(*) AS member_count FROM (SELECT c_nationkey AS n, 'C:' || c_custkey AS m FROM customer) GROUP BY n")
def community_members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("namespace"), F.lit("c").alias("community_id"), F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("node_id"))
    return communities.members(rows, ["namespace"]).select("namespace", "community_id", "members", "member_count")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return communities.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    rf"""WITH q AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower('{SPOKEN}'), '\s+'), lambda x: x <> '')) AS q),
    s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations)
    SELECT conv_id || ':' || turn AS id, len(list_intersect(w, q)) AS overlap FROM s, q WHERE len(list_intersect(w, q)) > 0 ORDER BY overlap DESC, id LIMIT 5"""
)
def global_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("summary"))
    return communities.overlap(rows, SPOKEN, key="id").select("id", "overlap")


# Grounding and evaluation


_LOOSE = "regexp_replace(lower({0}), '[-_.]+', ' ', 'g')"


@query(
    f"""WITH i AS (SELECT item_id, trim(regexp_replace(text, '\\.+$', '')) AS bare FROM benchmark)
    SELECT item_id, doc_id FROM i JOIN documents d ON bare <> '' AND (contains(d.text, bare) OR contains({_LOOSE.format("d.text")}, {_LOOSE.format("bare")}))"""
)
def quote_location(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    return grounding.located(items, table(spark, d, "documents").select("doc_id", "text")).select("item_id", "doc_id").distinct()


@query(r"SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text || ' ' || turn || ' and ' || conv_id, '\d+'))) AS numbers FROM conversations")
def claim_numbers(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat("text", F.lit(" "), F.col("turn").cast("string"), F.lit(" and "), F.col("conv_id").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(grounding.numbers(shown)).cast("long").alias("numbers"))


@query("SELECT conv_id, turn, turn % 3 <> 1 AND NOT turn % 3 = 2 AS grounded FROM conversations WHERE role = 'assistant'")
def citation_only(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " [doc#1]").when(F.col("turn") % 3 == 1, " [doc#9]").otherwise(""))
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", grounding.citation_only(said, F.array(F.lit("[doc#1]"), F.lit("[doc#2]"))).alias("grounded"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Claims about orders in six kinds, each with the evidence of its order."""
    kind = F.col("o_orderkey") % 6
    key = F.col("o_orderkey").cast("string")
    fact = F.concat(F.lit("order-"), key, F.lit(" costs "), F.floor("o_totalprice").cast("string"), F.lit(" coins"))
    denied = F.concat(F.lit("order-"), key, F.lit(" is not paid"))
    claim = F.when(kind == 2, F.concat(F.lit("order-"), key, F.lit(" costs 1 coins"))).when(kind == 3, F.lit("order-x-y costs coins")).when(kind == 4, F.concat(F.lit("order-"), key, F.lit(" is cheap"))).otherwise(fact)
    marker = F.concat(F.lit("[o#"), key, F.lit("]"))
    citations = F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(F.lit("[z#0]"))).otherwise(F.array(marker))
    own = F.array(F.struct(marker.alias("marker"), F.concat(fact, F.lit(".")).alias("content")))
    evidence = F.when(F.col("o_orderkey") % 4 == 1, F.array_append(own, F.struct(F.lit("[n#1]").alias("marker"), denied.alias("content")))).otherwise(own)
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("at"), F.concat(claim, F.lit(".")).alias("claim"), citations.alias("citations"), evidence.alias("evidence"))


_VERDICTS = """k AS (SELECT o_orderkey, o_custkey AS answer_id, o_orderkey % 6 AS kind, o_orderkey % 4 = 1 AS denied, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
    v AS (SELECT *, CASE kind WHEN 0 THEN 'citation_missing' WHEN 1 THEN 'citation_outside_retrieved_evidence'
    WHEN 2 THEN CASE WHEN o_orderkey = 1 OR price = 1 THEN 'evidence_insufficient' ELSE 'numeric_or_date_mismatch' END WHEN 3 THEN 'evidence_irrelevant' WHEN 4 THEN 'evidence_insufficient'
    ELSE CASE WHEN denied THEN 'evidence_conflicting' ELSE 'explicit_relation_confirmed' END END AS reason FROM k),
    w AS (SELECT *, CASE reason WHEN 'explicit_relation_confirmed' THEN 'supported' WHEN 'numeric_or_date_mismatch' THEN 'contradicted' ELSE 'insufficient' END AS verdict FROM v)"""


@query(f"WITH {_VERDICTS} SELECT o_orderkey, verdict, reason FROM w")
def verifier_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return grounding.verdicts(_cases(spark, d)).select("o_orderkey", "verdict", "reason")


@query(
    f"""WITH {_VERDICTS}, a AS (SELECT answer_id, count(*) AS n, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'contradicted') AS contradicted FROM w GROUP BY answer_id)
    SELECT answer_id, CASE WHEN contradicted > 0 THEN 'contradicted' WHEN supported = n THEN 'verified' WHEN supported = 0 THEN 'insufficient' ELSE 'partially_verified' END AS status FROM a"""
)
def policy_status(spark: SparkSession, d: str) -> DataFrame:
    return grounding.policy(grounding.verdicts(_cases(spark, d)), "verified").select("answer_id", "status")


@query(
    f"""WITH {_VERDICTS}, a AS (SELECT answer_id, CASE WHEN count(*) FILTER (verdict = 'contradicted') > 0 THEN 'contradicted' WHEN count(*) FILTER (verdict = 'supported') = count(*) THEN 'verified' WHEN count(*) FILTER (verdict = 'supported') = 0 THEN 'insufficient' ELSE 'partially_verified' END AS status FROM w GROUP BY answer_id),
    r AS (SELECT answer_id, string_agg('order-' || o_orderkey || ' costs ' || price || ' coins. [o#' || o_orderkey || ']', ' ' ORDER BY o_orderkey) AS said FROM w WHERE verdict = 'supported' GROUP BY answer_id)
    SELECT answer_id, status, CASE WHEN status IN ('verified', 'partially_verified') THEN said ELSE 'Insufficient evidence to answer from the indexed sources.' END AS text FROM a LEFT JOIN r USING (answer_id)"""
)
def rendered_answers(spark: SparkSession, d: str) -> DataFrame:
    checked = grounding.verdicts(_cases(spark, d))
    return grounding.rendered(checked, grounding.policy(checked, "verified"))


@query(
    """SELECT conv_id, turn, "at", claim, citations FROM (SELECT conv_id, turn, 0 AS "at", 'First fact ' || turn || '.' AS claim, ['[a#' || conv_id || ']', '[b#2]'] AS citations FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'Second fact!', ['[c#3]'] FROM conversations)"""
)
def claim_split(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("First fact "), F.col("turn").cast("string"), F.lit(". [a#"), F.col("conv_id").cast("string"), F.lit("][b#2] Second fact! [c#3] And a rest without marks"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(grounding.claims(said)).alias("at", "c"))
    return rows.select("conv_id", "turn", "at", F.col("c.text").alias("claim"), F.col("c.citations").alias("citations"))


@query(
    """SELECT event_type AS mode, count(*) AS n, round(median(value), 6) AS p50, round(max(value) FILTER (rn = greatest(1, CAST(floor(c * 0.95 + 1e-9) AS BIGINT))), 6) AS p95, round(max(value) FILTER (rn = greatest(1, CAST(floor(c * 0.99 + 1e-9) AS BIGINT))), 6) AS p99
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.percentiles(table(spark, d, "events").withColumnRenamed("event_type", "mode"), ["mode"], "value")
    return out.select("mode", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


@query(
    """SELECT toxic, count(*) AS cases, round(avg(CASE WHEN quality = 0 THEN CAST(doc_id % 4 = 0 AS INTEGER) END), 9) AS unsupported_claim_escape_rate,
    round(avg(CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN CAST(doc_id % 4 = 0 AS INTEGER) END), 9) AS contradicted_claim_escape_rate,
    round(avg(CASE WHEN quality = 1 THEN CAST(doc_id % 4 = 0 AS INTEGER) END), 9) AS supported_claim_retention, round(avg(CASE WHEN quality = 1 THEN CAST(doc_id % 4 <> 0 AS INTEGER) END), 9) AS incorrect_abstention_rate FROM labels GROUP BY toxic"""
)
def grounding_rates(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "supported").when(F.col("doc_id") % 3 == 0, "contradicted").otherwise("insufficient")
    out = evaluation.grounding_rates(table(spark, d, "labels").withColumns({"label": label, "accepted": F.col("doc_id") % 4 == 0}), ["toxic"])
    return out.select("toxic", "cases", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query(
    """WITH c AS (SELECT 'c' || o_orderkey AS case_id, o_orderstatus AS category, o_orderkey % 5 AS r FROM orders)
    SELECT category, count(*) AS cases, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_5, round(avg(CASE WHEN r > 0 THEN 0.25::DOUBLE ELSE 0 END), 9) AS precision_at_5,
    round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END), 9) AS reciprocal_rank, round(avg(CASE WHEN r % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS path_match, round(avg(CASE WHEN r = 1 THEN 0.5::DOUBLE ELSE 1 END), 9) AS source_recall FROM c GROUP BY category"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = (F.col("o_orderkey") % 5).cast("int")
    listed = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i == r, F.lit("has Answer-7 inside")).otherwise(F.lit("nothing")))
    one = lambda *x: F.array(*(F.lit(v) for v in x))
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderstatus").alias("category"), one("ANSWER-7").alias("expected"), one("uses").alias("relations"),
        one("s1", "s2").alias("sources"), one("forbidden").alias("forbidden"), listed.alias("chunks"), F.array().cast("array<string>").alias("entities"),
        F.when(r % 2 == 0, one("uses", "owned_by")).otherwise(one("owned_by")).alias("found_relations"), F.when(r == 1, one("s1")).otherwise(one("s2", "s1")).alias("found_sources"), F.lit(10).alias("context_tokens"),
    )
    out = evaluation.summary(evaluation.scored_cases(rows), ["category"])
    return out.select("category", "cases", *(F.round(c, 9).alias(c) for c in ("recall_at_5", "precision_at_5", "reciprocal_rank", "path_match", "source_recall")))


@query("SELECT 't' AS tenant_id, event_type AS namespace, CAST(user_id % 3 AS VARCHAR) AS kind, count(*) AS events, sum(CAST(props ->> '$.k' AS BIGINT)) AS tokens FROM events GROUP BY ALL")
def usage_by_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.lit("t").alias("tenant_id"), F.col("event_type").alias("namespace"), (F.col("user_id") % 3).cast("string").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return evaluation.usage(rows)


@query("SELECT count(*) AS compared, count(*) FILTER (quality = toxic) AS alike, round(avg(CAST(quality = toxic AS INTEGER)), 9) AS rate FROM labels")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    side = lambda c: labels.select(F.col("doc_id").alias("id"), F.col(c).cast("string").alias("label"))
    return evaluation.agreement(side("quality"), side("toxic")).select("compared", "alike", F.round("rate", 9).alias("rate"))


@query(
    """WITH RECURSIVE b AS (SELECT doc_id, ordinal, greatest(1, (length(content) + 3) // 4) AS cost FROM chunks),
    f AS (SELECT doc_id, CAST(-1 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS used, false AS kept FROM (SELECT DISTINCT doc_id FROM b)
    UNION ALL SELECT b.doc_id, b.ordinal, CASE WHEN used + cost <= 600 THEN used + cost ELSE used END, used + cost <= 600 FROM f JOIN b ON b.doc_id = f.doc_id AND b.ordinal = f.ordinal + 1)
    SELECT doc_id, ordinal FROM f WHERE kept""",
    uses="chunks",
)
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = rel.chunks(spark, d).select("doc_id", F.struct(F.col("ordinal").cast("long").alias("ordinal"), text.estimated_tokens(F.col("content")).alias("cost")).alias("x"))
    fits = rows.groupBy("doc_id").agg(retrieve.within_budget(F.array_sort(F.collect_list("x")), lambda x: x["cost"], 600).alias("kept"))
    return fits.select("doc_id", F.explode("kept").alias("x")).select("doc_id", "x.ordinal")


@query(
    "SELECT 'incident-' || printf('%03d', k) || s AS source_id, length(t) AS n FROM (SELECT k, '-deploy' AS s, 'deploy-000 deployed checkout-service-000. checkout-service-000 depends_on auth-service-000.' AS t FROM range(1, 31) r(k)"
    " UNION ALL SELECT k, '-ownership', 'auth-service-000 owned_by Identity Team 000. Identity Team 000 has_runbook auth-rollback-000.' FROM range(1, 31) r(k))"
)
def incident_corpus(spark: SparkSession, d: str) -> DataFrame:
    return readers.incidents(spark).select("source_id", F.length("text").cast("long").alias("n"))


@query("SELECT 'semantic_single_hop' AS category, 30 AS n UNION ALL SELECT 'identifier_lexical', 30 UNION ALL SELECT 'multi_hop', 40 UNION ALL SELECT 'negative', 20")
def incident_questions(spark: SparkSession, d: str) -> DataFrame:
    return readers.incident_cases(spark).groupBy("category").agg(F.count("*").cast("int").alias("n"))


# Merging, leases and lookups by name


@query("SELECT p_partkey, p_brand AS brand, p_size AS size, p_size > 25 AS large, 'x' AS kind FROM part")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fields keep their types: they are read back as numbers and booleans, and so is one of a nested object."""
    part = table(spark, d, "part")
    old = F.to_json(F.struct(F.col("p_size").alias("size"), F.lit("old").alias("brand"), F.lit("x").alias("kind")))
    new = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.struct((F.col("p_size") > 25).alias("large")).alias("more")))
    merged = F.parse_json(resolve.merged_json(old, new))
    got = lambda path, kind: F.variant_get(merged, path, kind)
    return part.select("p_partkey", got("$.brand", "string").alias("brand"), got("$.size", "int").alias("size"), got("$.more.large", "boolean").alias("large"), got("$.kind", "string").alias("kind"))


@query("SELECT 'S:' || s_suppkey AS node_id, CASE WHEN s_suppkey = 1 THEN 'S:2,S:3,S:4' ELSE '' END AS merged FROM supplier WHERE s_suppkey NOT IN (2, 3, 4)")
def chained_merge(spark: SparkSession, d: str) -> DataFrame:
    nodes = rel.nodes(spark, d).where("node_id LIKE 'S:%'")
    edges = rel.edges(spark, d).where("relation = 'located_in'").drop("support", "weight").withColumn("metadata", F.lit("{}"))
    mentions, entities = spark.createDataFrame([], "edge_id string, chunk_id long"), spark.createDataFrame([], "chunk_id long, node_id string")
    for source in ("S:2", "S:3", "S:4"):
        nodes, edges, mentions, entities = resolve.merge(nodes, edges, mentions, entities, source, "S:1")
    merged = F.variant_get(F.parse_json("metadata"), "$._merged_from", "array<string>")
    return nodes.select("node_id", F.coalesce(F.array_join(merged, ","), F.lit("")).alias("merged"))


@query("SELECT 'C:' || o_custkey AS src, 'P:' || o_orderpriority AS dst, 'orders' AS relation, CAST(count(*) AS DOUBLE) AS manual, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey, o_orderpriority")
def triplets_twice(spark: SparkSession, d: str) -> DataFrame:
    """What is stated again in one batch is summed, and the metadata of the last statement wins."""
    stated = table(spark, d, "orders").select(F.concat(F.lit("C:"), F.col("o_custkey")).alias("src"), F.concat(F.lit("P:"), F.col("o_orderpriority")).alias("dst"), F.lit("orders").alias("relation"), F.lit(1.0).alias("weight"), F.to_json(F.struct(F.col("o_orderkey").alias("order"))).alias("metadata"), F.col("o_orderkey").alias("at"))
    none = spark.createDataFrame([], "edge_id string, src string, dst string, relation string, manual double, metadata string")
    return ingest.upsert_edges(none, stated).select("src", "dst", "relation", "manual", F.variant_get(F.parse_json("metadata"), "$.order", "bigint").alias("last_order"))


@query(
    """WITH s AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS status, o_orderdate AS expires FROM orders WHERE o_orderkey % 3 > 0),
    w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0)
    SELECT k, CASE WHEN status = 'done' THEN 'done' WHEN status = 'in_progress' AND expires >= TIMESTAMP '1996-01-01' THEN 'in_progress' ELSE 'claimed' END AS outcome FROM w LEFT JOIN s USING (k)"""
)
def lease_claims(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("content_hash", F.col("o_orderkey").cast("string"))
    key = {"provider": F.lit("p"), "model": F.lit("m"), "prompt_version": F.lit("1")}
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("pending")
    state = orders.where("o_orderkey % 3 > 0").select("content_hash", *(v.alias(k) for k, v in key.items()), status.alias("status"), F.lit(None).cast(readers.TRIPLETS).alias("result"), F.lit("other").alias("lease_owner"), F.col("o_orderdate").cast("timestamp").alias("lease_expires_at"))
    _, outcome = store.claim_extractions(state, orders.where("o_orderkey % 2 = 0").withColumns(key), "me", F.lit("1996-01-01").cast("timestamp"))
    return outcome.select(F.col("content_hash").cast("long").alias("k"), "outcome")


@query("SELECT chunk_id, content FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", uses="chunks")
def active_only(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("status", F.lit("active"))
    rows = rel.chunks(spark, d).join(good, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("retired")))
    return store.active(rows).select("chunk_id", "content")


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, Callable[[str], list[float]]]:
    """Nodes, of which suppliers and regions have vectors, and the vector of a name: that of its node."""
    vecs = table(spark, d, "embeddings").select("vec_id", "embedding")
    n, key = vecs.count(), F.substring("node_id", 3, 20).cast("long")
    at = F.when(F.col("node_id").startswith("S:"), key).when(F.col("node_id").startswith("R:"), n - 1 - key)
    nodes = rel.nodes(spark, d).withColumn("vec_id", at).join(vecs, "vec_id", "left").drop("vec_id")
    return nodes, lambda name: [float(v) for v in nodes.where((F.col("content") == name) & F.col("embedding").isNotNull()).orderBy("node_id").first()["embedding"]]


def _contents(nodes: DataFrame, *ids: str) -> list[str]:
    found = {r["node_id"]: r["content"] for r in nodes.where(F.col("node_id").isin(*ids)).collect()}
    return [found[i] for i in ids]


_ROUTE = graph.Walk(hops=3, directed=True, without=("supplies",))


@query(_path_sql(_ROUTE, "('S:1'), ('S:2')", "SELECT 'R:' || r_regionkey FROM region", 5), uses="edges")
def named_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, embed = _named(spark, d)
    regions = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # of a fixed number
    return _path_text(retrieve.find_paths(nodes, rel.edges(spark, d), _contents(nodes, "S:1", "S:2"), regions, embed, _ROUTE, 5))


@query(_walked(graph.Walk(hops=1), "('S:3', 1.0), ('S:2', 1.0)") + " SELECT node_id, hops, round(score, 9) AS score FROM reached", uses="edges")
def named_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    nodes, embed = _named(spark, d)
    out = retrieve.neighbourhood(nodes, rel.edges(spark, d), _contents(nodes, "S:3", "S:2"), embed, graph.Walk(hops=1))
    return out.select("node_id", "hops", F.round("score", 9).alias("score"))


@query(
    """SELECT DISTINCT 'S:' || s_suppkey AS node_id, s_name AS content, o_custkey AS document_id, c_name AS source_id
    FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_suppkey = 3"""
)
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    nodes, embed = _named(spark, d)
    mentions = table(spark, d, "lineitem").select(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("node_id"), F.col("l_orderkey").alias("chunk_id"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("").alias("content"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("source_id"))
    return retrieve.entity(nodes, mentions, chunks, docs, _contents(nodes, "S:3")[0], embed)


@query("SELECT 'N:' || c_nationkey AS run_id, count(*) AS node_count, count(DISTINCT c_mktsegment) AS community_count FROM customer GROUP BY c_nationkey")
def community_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("run_id"), F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("community_id"))
    return communities.report(rows, ["run_id"])
