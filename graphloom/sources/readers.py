"""Sources: texts, triplets, records, legacy graphs, case sets and generated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.store import make_id

#: Characters of one document at most, and of its name.
MOST_TEXT, MOST_NAME = 2_000_000, 512
TRIPLETS = "array<struct<subject:string,predicate:string,object:string>>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One document for each text or Markdown file: ``source_id`` (its path), ``text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), F.col("value").alias("text"))


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """Triplets of JSON files of the form ``{"triplets": [{subject, predicate, object}]}``."""
    return spark.read.schema(f"triplets {TRIPLETS}").json(path, multiLine=True).select(F.explode("triplets").alias("t")).select("t.*")


def triplets_inline(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.explode(F.from_json(column, f"triplets {TRIPLETS}")["triplets"]).alias("t")).select("t.*")


def records(rows: DataFrame, entity_type: str, name: str) -> DataFrame:
    """Rows as documents: ``entity`` (the column ``name``), ``text`` (``type: column=value, ...``), ``metadata``."""
    fields = [c for c in rows.columns]
    shown = F.concat_ws(", ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in fields))
    return rows.select(F.col(name).cast("string").alias("entity"), F.concat(F.lit(f"{entity_type}: "), shown).alias("text"), F.to_json(F.struct(*fields)).alias("metadata"))


def legacy(nodes: DataFrame, edges: DataFrame, known_nodes: DataFrame, known_edges: DataFrame, tenant_id: str) -> tuple[DataFrame, DataFrame]:
    """Old nodes and edges (``id`` and so on) under a fixed tenant, ids kept, weights as manual ones, known ids skipped."""
    n = nodes.select(F.col("id").alias("node_id"), "content", "embedding", "metadata", F.lit(tenant_id).alias("tenant_id"), "namespace")
    e = edges.select(F.col("id").alias("edge_id"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), "relation", F.col("weight").alias("manual"), "metadata", F.lit(tenant_id).alias("tenant_id"), "namespace")
    return known_nodes.unionByName(n.join(known_nodes, "node_id", "left_anti"), allowMissingColumns=True), known_edges.unionByName(e.join(known_edges, "edge_id", "left_anti"), allowMissingColumns=True)


def cases(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """A JSON case set, of one split if asked for."""
    out = spark.read.schema(schema).json(path, multiLine=True)
    return out if split is None else out.where(F.col("split") == split)


def incidents(spark: SparkSession, n: int = 30) -> DataFrame:
    """A generated corpus: two documents for each incident with their triplets: ``source_id``, ``text``, ``triplets``."""
    rows = spark.range(1, n + 1).select(F.format_string("%03d", F.col("id").cast("int")).alias("k"))
    named = lambda p: F.concat(F.lit(p), F.col("k"))
    deploy, checkout, auth, team, runbook = named("deploy-"), named("checkout-service-"), named("auth-service-"), named("Identity Team "), named("auth-rollback-")
    fact = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    first = F.struct(F.concat(F.lit("incident-"), F.col("k"), F.lit("-deploy")).alias("source_id"), F.array(fact(deploy, "deployed", checkout), fact(checkout, "depends_on", auth)).alias("triplets"))
    second = F.struct(F.concat(F.lit("incident-"), F.col("k"), F.lit("-ownership")).alias("source_id"), F.array(fact(auth, "owned_by", team), fact(team, "has_runbook", runbook)).alias("triplets"))
    out = rows.select(F.explode(F.array(first, second)).alias("d")).select("d.*")
    return out.withColumn("text", F.array_join(F.transform("triplets", lambda t: F.concat_ws(" ", t["subject"], t["predicate"], F.concat(t["object"], F.lit(".")))), " "))


def incident_cases(spark: SparkSession, n: int = 30, deep: int = 20) -> DataFrame:
    """Questions about ``incidents``: single hop, identifier, multi-hop and unanswerable ones."""
    rows = spark.range(1, n + 1).select(F.col("id"), F.format_string("%03d", F.col("id").cast("int")).alias("k"))
    word = lambda *parts: F.concat(*(F.col("k") if p is None else F.lit(p) for p in parts))
    none = F.array().cast("array<string>")
    deployed, owned = word("incident-", None, "-deploy"), word("incident-", None, "-ownership")

    def case(kind: str, category: str, question, expected, relations, sources, forbidden, abstain: bool, hops: int):
        listed = lambda x: F.array(*x).cast("array<string>") if x else none
        return F.struct(word(kind, None).alias("case_id"), F.lit(category).alias("category"), question.alias("question"), listed(expected).alias("expected"), listed([F.lit(r) for r in relations]).alias("relations"), listed(sources).alias("sources"), listed(forbidden).alias("forbidden"), F.lit(abstain).alias("abstain"), F.lit(hops).alias("max_hops"))

    every = [
        case("semantic-", "semantic_single_hop", word("Which service was released by deploy-", None, "?"), [word("checkout-service-", None)], ["deployed"], [deployed], [], False, 1),
        case("lexical-", "identifier_lexical", word("What runbook identifier is assigned to Identity Team ", None, "?"), [word("auth-rollback-", None)], ["has_runbook"], [owned], [], False, 1),
    ]
    some = [
        case("multihop-owner-", "multi_hop", word("Which team owns the dependency used by checkout-service-", None, "?"), [word("Identity Team ", None)], ["depends_on", "owned_by"], [deployed, owned], [], False, 2),
        case("multihop-runbook-", "multi_hop", word("Which runbook is connected to deploy-", None, " through its service dependency owner?"), [word("auth-rollback-", None)], ["deployed", "depends_on", "owned_by", "has_runbook"], [deployed, owned], [], False, 4),
        case("negative-", "negative", word("Which team owns database-", None, " used by checkout-service-", None, "?"), [], [], [], [word("Identity Team ", None)], True, 2),
    ]
    out = rows.select(F.explode(F.array(*every)).alias("c")).unionByName(rows.where(F.col("id") <= deep).select(F.explode(F.array(*some)).alias("c")))
    return out.select("c.*")


def synthetic_graph(spark: SparkSession, n: int, degree: int = 3, dimension: int = 128, seed: int = 1729) -> tuple[DataFrame, DataFrame]:
    """Random unit vectors as nodes and ``degree`` random edges each, of five relations."""
    raw = F.array(*(F.randn(seed + i) for i in range(dimension)))
    nodes = spark.range(n).select(F.concat(F.lit("n"), F.col("id")).alias("node_id"), F.concat(F.lit("entity "), F.col("id")).alias("content"), raw.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    nodes = nodes.select("node_id", "content", F.transform("v", lambda x: (x / length).cast("float")).alias("embedding"), F.lit("{}").alias("metadata"))
    relations = F.array(*(F.lit(r) for r in ("depends_on", "owned_by", "deployed", "uses", "runs_on")))
    edges = spark.range(n * degree).select(
        F.concat(F.lit("e"), F.col("id")).alias("edge_id"), F.concat(F.lit("n"), F.floor(F.col("id") / degree)).alias("src"), F.concat(F.lit("n"), F.floor(F.rand(seed) * n)).alias("dst"),
        F.get(relations, F.floor(F.rand(seed + 1) * 5).cast("int")).alias("relation"), (0.1 + F.rand(seed + 2) * 5).alias("manual"), F.lit(0).cast("long").alias("support"),
    )
    return nodes, edges.where("src <> dst").withColumn("weight", F.col("manual"))


def checked(documents: DataFrame) -> DataFrame:
    """Documents within the limits of text and name; raises at run time on any other."""
    bad = (F.length("text") > MOST_TEXT) | (F.length("source_id") > MOST_NAME) | F.col("source_id").isNull()
    return documents.withColumn("text", F.when(bad, F.raise_error(F.lit("a document exceeds the limits of text or name"))).otherwise(F.col("text")))


def document_ids(documents: DataFrame, tenant_id: str, namespace: str) -> DataFrame:
    return documents.withColumn("document_id", make_id(F.lit(tenant_id), F.lit(namespace), F.col("source_id")))
