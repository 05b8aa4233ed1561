"""Relations over the supplied tables that the engine's queries share, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.session import table


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with tenant (language), namespace (source) and metadata."""
    meta = F.to_json(F.struct("lang", "source", "n_chars"))
    return table(spark, d, "documents").withColumns({"tenant_id": F.col("lang"), "namespace": F.col("source"), "metadata": meta})


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents: ``chunk_id``, ``doc_id``, ``ordinal``, ``content``, ``tenant_id``, ``namespace``."""
    out = table(spark, d, "documents").select("doc_id", F.col("lang").alias("tenant_id"), F.col("source").alias("namespace"), F.posexplode(text.chunks(F.col("text"))).alias("ordinal", "content"))
    return out.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the vectors of their documents; where there are more documents than vectors, these repeat in turn."""
    vecs = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vecs.count()
    out = chunks(spark, d).withColumn("vec_id", F.expr(f"doc_id % nullif({n}, 0)"))
    return out.join(vecs, "vec_id")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return [float(v) for v in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [("R:", "region", "r_regionkey", "r_name"), ("N:", "nation", "n_nationkey", "n_name"), ("C:", "customer", "c_custkey", "c_name"), ("S:", "supplier", "s_suppkey", "s_name"), ("P:", "part", "p_partkey", "p_name")]
    out = None
    for prefix, name, key, content in parts:
        own = table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.col(content).alias("content"), F.to_json(F.struct(F.lit(prefix[0]).alias("kind"), F.col(key).alias("key"))).alias("metadata"))
        out = own if out is None else out.unionByName(own)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers supply parts, supported by orders; customers and suppliers are located in nations, nations part of regions."""
    supplies = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_orderkey").alias("support"))
    supplies = supplies.select(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("supplies").alias("relation"), "support", F.lit(0.0).alias("manual"))
    out = supplies
    for prefix, name, key, to, target, relation in (("C:", "customer", "c_custkey", "N:", "c_nationkey", "located_in"), ("S:", "supplier", "s_suppkey", "N:", "s_nationkey", "located_in"), ("N:", "nation", "n_nationkey", "R:", "n_regionkey", "part_of")):
        own = table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("src"), F.concat(F.lit(to), F.col(target).cast("string")).alias("dst"), F.lit(relation).alias("relation"), F.lit(0).cast("long").alias("support"), F.lit(1.0).alias("manual"))
        out = out.unionByName(own)
    return out.withColumn("weight", F.col("manual") + F.col("support")).withColumn("edge_id", F.concat_ws(">", "src", "relation", "dst"))


def edge_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Orders assert which supplier supplied which part."""
    line = table(spark, d, "lineitem")
    return line.select(F.concat(F.lit("S:"), F.col("l_suppkey"), F.lit(">supplies>P:"), F.col("l_partkey")).alias("edge_id"), F.col("l_orderkey").alias("chunk_id")).distinct()


SQL = {
    "chunks": """
        SELECT doc_id, lang AS tenant_id, source AS namespace, k AS ordinal, substr(text, k * 900 + 1, 1000) AS content, doc_id || ':' || k AS chunk_id
        FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 900.0) AS BIGINT))) AS k FROM documents)""",
    "embedded": """
        SELECT c.*, v.embedding FROM chunks c JOIN embeddings v ON v.vec_id = c.doc_id % (SELECT count(*) FROM embeddings)""",
    "nodes": """
        SELECT 'R:' || r_regionkey AS node_id, r_name AS content, 'R' AS kind, r_regionkey AS key FROM region
        UNION ALL SELECT 'N:' || n_nationkey, n_name, 'N', n_nationkey FROM nation
        UNION ALL SELECT 'C:' || c_custkey, c_name, 'C', c_custkey FROM customer
        UNION ALL SELECT 'S:' || s_suppkey, s_name, 'S', s_suppkey FROM supplier
        UNION ALL SELECT 'P:' || p_partkey, p_name, 'P', p_partkey FROM part""",
    "edges": """
        SELECT *, manual + support AS weight, src || '>' || relation || '>' || dst AS edge_id FROM (
        SELECT 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst, 'supplies' AS relation, count(DISTINCT l_orderkey) AS support, 0.0::DOUBLE AS manual FROM lineitem GROUP BY l_suppkey, l_partkey
        UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'located_in', 0, 1.0 FROM customer
        UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'located_in', 0, 1.0 FROM supplier
        UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'part_of', 0, 1.0 FROM nation)""",
}
