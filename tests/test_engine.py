"""Behaviour of the engine's operators on small hand-made inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text, vectors
from graphloom.functions.filters import compiled
from graphloom.operators import communities, evaluation, graph, grounding, resolve, search
from graphloom.plans import retrieve
from graphloom.plans.ingest import Provider, add_documents, add_triplets, retry
from graphloom.sources import readers
from graphloom.sources.store import Store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def make(spark, names, links):
    nodes = spark.createDataFrame([(n, n, "{}") for n in names], "node_id string, content string, metadata string")
    rows = [(f"e{i}", a, b, r, 0, float(w), float(w)) for i, (a, b, r, w) in enumerate(links)]
    return nodes, spark.createDataFrame(rows, "edge_id string, src string, dst string, relation string, support long, manual double, weight double")


def seeds(spark, **scores):
    return spark.createDataFrame(list(scores.items()), "node_id string, score double")


def reached(df):
    return {r["node_id"]: (r["hops"], round(r["score"], 9)) for r in df.collect()}


def test_text_forms(spark):
    assert one(spark, text.normalize(F.lit("  a\t b c\n"))) == "a b c"
    assert one(spark, text.chunks(F.lit("x" * 1900))) == ["x" * 1000, "x" * 1000, "x" * 100]
    assert one(spark, text.chunks(F.lit(""))) is None
    with pytest.raises(ValueError):
        text.chunks(F.lit("x"), 10, 10)
    assert text.query_terms("What is the status of CVE-2026-1188?") == ["status", "cve-2026-1188"]
    assert text.query_terms("what is the") == ["what", "is", "the"]
    assert one(spark, text.anchors(F.lit("A-1 uses b_2 and A-1 or plain."))) == ["a-1", "b_2"]
    assert one(spark, text.estimated_tokens(F.lit(""))) == 1
    assert one(spark, text.similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("words")))) == pytest.approx(4 / 7)
    vector = one(spark, text.embedding(F.lit("alpha beta"), 16))
    assert math.isclose(sum(v * v for v in vector), 1.0)
    assert one(spark, text.embedding(F.lit(""), 4)) == [0.0] * 4


def test_filters(spark):
    rows = spark.createDataFrame([(1, '{"k": 5, "s": "a", "d": "2026-01-02", "o": {"p": true}, "t": ["x", "y"]}'), (2, '{"k": 9, "s": "b", "d": "2020-05-01"}'), (3, "{}")], "id int, m string")
    ids = lambda wanted: [r["id"] for r in rows.where(compiled(F.col("m"), wanted)).orderBy("id").collect()]
    assert ids(None) == ids({}) == ids([]) == [1, 2, 3]
    assert ids([{"field": "k", "op": "gte", "value": 6}]) == [2]
    assert ids([{"field": "k", "op": "neq", "value": 5}]) == [2]  # a missing field fails
    assert ids([{"field": "s", "op": "in", "value": ["a", "z"]}]) == [1]
    assert ids([{"field": "d", "op": "gt", "value": "2025-01-01"}, {"field": "k", "value": 5}]) == [1]
    assert ids({"o": {"p": True}}) == ids({"t": ["y"]}) == [1]
    for bad in ([{"field": "k", "op": "like", "value": 1}], [{"field": "k", "op": "in", "value": []}], [{"field": "k", "value": None}]):
        with pytest.raises(ValueError):
            compiled(F.col("m"), bad)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rows.where(compiled(F.col("m"), [{"field": "s", "op": "gt", "value": 1}])).collect()
    assert rows.where(compiled(F.col("m"), [{"field": "s", "op": "gt", "value": 1}], strict=False)).count() == 0


def test_search(spark):
    rows = [("a", "alpha beta alpha", [1.0, 0.0]), ("b", "beta", [0.0, 1.0]), ("c", "nothing", [0.6, 0.8])]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, embedding array<float>")
    assert [(r["chunk_id"], r["lex_rank"]) for r in search.lexical(chunks, "alpha or beta").orderBy("lex_rank").collect()] == [("a", 1), ("b", 2)]
    near = vectors.nearest(chunks, vectors.literal([0.0, 1.0]), 2, "chunk_id").collect()
    assert [r["chunk_id"] for r in near] == ["b", "c"]
    fused = search.hybrid(chunks, "alpha", vectors.literal([1.0, 0.0]), 3).orderBy(F.desc("rrf_score")).collect()
    assert fused[0]["chunk_id"] == "a" and fused[0]["rrf_score"] == pytest.approx(2 / 61)
    with pytest.raises(ValueError):
        vectors.nearest(chunks, vectors.literal([1.0]), 101, "chunk_id")
    assert one(spark, vectors.cosine(vectors.literal([0.0, 0.0]), vectors.literal([1.0, 0.0]))) == 0.0
    mentions = spark.createDataFrame([("a", "n1"), ("b", "n1"), ("b", "n2")], "chunk_id string, node_id string")
    got = search.seed_scores(mentions, spark.createDataFrame([("a", 4.0), ("b", 2.0)], "chunk_id string, score double"))
    assert {r["node_id"]: r["score"] for r in got.collect()} == {"n1": 1.0, "n2": 0.5}


def test_traversal(spark):
    nodes, edges = make(spark, "hub l1 l2 l3 l4 l5 l6".split(), [("hub", f"l{k}", "to", k) for k in range(1, 7)])
    start = seeds(spark, hub=1.0)
    assert set(reached(graph.traverse(nodes, edges, start, graph.Walk(hops=1, fan_out=3)))) == {"hub", "l4", "l5", "l6"}
    assert len(reached(graph.traverse(nodes, edges, start, graph.Walk(hops=1)))) == 7
    assert set(reached(graph.traverse(nodes, edges, start, graph.Walk(hops=1, min_weight=5)))) == {"hub", "l5", "l6"}
    assert set(reached(graph.traverse(nodes, edges, seeds(spark, l1=1.0), graph.Walk(hops=1, directed=True)))) == {"l1"}
    with pytest.raises(ValueError):
        graph.Walk(hops=6)
    nodes, edges = make(spark, "a b c".split(), [("a", "b", "depends_on", 1), ("a", "c", "owned_by", 1), ("a", "a", "self", 9)])
    assert set(reached(graph.traverse(nodes, edges, seeds(spark, a=1.0), graph.Walk(relations=("owned_by",))))) == {"a", "c"}
    assert set(reached(graph.traverse(nodes, edges, seeds(spark, a=1.0), graph.Walk(without=("owned_by",))))) == {"a", "b"}
    chain_nodes, chain = make(spark, "a b c".split(), [("a", "b", "r", 1), ("b", "c", "r", 1)])
    got = reached(graph.traverse(chain_nodes, chain, seeds(spark, a=1.0)))
    step = 0.7 * (1 - math.exp(-1))
    assert got == {"a": (0, 1.0), "b": (1, round(step, 9)), "c": (2, round(step**2, 9))}
    assert reached(graph.traverse(chain_nodes, chain, seeds(spark, nobody=1.0))) == {}


def test_layers_equal_enumeration(spark):
    """The layered search finds what enumerating all simple paths finds."""
    import random

    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(14)]
    links = [(rng.choice(names), rng.choice(names), rng.choice("xyz"), rng.choice([0.3, 1, 2, 5])) for _ in range(45)]
    nodes, edges = make(spark, names, links)
    walk = graph.Walk(hops=4, fan_out=4)
    ends: dict = {n: [] for n in names}
    for i, (a, b, _, w) in enumerate(links):
        ends[a].append((-w, f"e{i}", b))
        if a != b:
            ends[b].append((-w, f"e{i}", a))
    want: dict = {}

    def go(node, depth, score, seen):
        hops, best = want.get(node, (99, -1.0))
        want[node] = (min(hops, depth), max(best, score))
        if depth < walk.hops:
            for w, _, to in sorted(ends[node])[: walk.fan_out]:
                if to not in seen:
                    go(to, depth + 1, score * walk.decay * (1 - math.exp(w)), seen | {to})

    go("n00", 0, 1.0, {"n00"})
    assert reached(graph.traverse(nodes, edges, seeds(spark, n00=1.0), walk)) == {n: (h, round(s, 9)) for n, (h, s) in want.items()}


def test_paths(spark):
    nodes, edges = make(spark, "a b c d x".split(), [("a", "b", "r1", 2), ("b", "c", "r2", 2), ("c", "d", "r3", 2), ("b", "x", "side", 9)])
    row = graph.best_path(nodes, edges, "a", "d").first()
    assert [(p["node_id"], p["relation"]) for p in row["path"]] == [("a", None), ("b", "r1"), ("c", "r2"), ("d", "r3")]
    assert graph.best_path(nodes, edges, "a", "a").count() == 0
    assert graph.best_path(nodes, edges, "a", "d", graph.Walk(hops=2)).count() == 0
    pick = lambda *x: nodes.where(F.col("node_id").isin(*x)).select("node_id")
    top = graph.top_paths(nodes, edges, pick("a", "b"), pick("b", "c"), k=3).collect()
    assert (top[0]["source_id"], top[0]["target_id"], top[0]["depth"]) == ("b", "b", 0)
    proof = spark.createDataFrame([("e0", "s", 1, "c1")], "edge_id string, source_id string, ordinal int, chunk_id string")
    shown = graph.decorated(graph.best_path(nodes, edges, "a", "b"), proof).first()
    assert [e["chunk_id"] for e in shown["evidence"]] == ["c1"]


def test_support_and_merge(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "r", 0.0, "{}"), ("e2", "c", "b", "r", 2.0, '{"x":"1"}'), ("e3", "a", "c", "r", 1.0, "{}"), ("e4", "b", "d", "r", 0.0, "{}")], "edge_id string, src string, dst string, relation string, manual double, metadata string")
    mentions = spark.createDataFrame([("e1", "k1"), ("e1", "k2"), ("e1", "k1"), ("e2", "k1")], "edge_id string, chunk_id string")
    assert {r["edge_id"]: r["weight"] for r in graph.supported(edges, mentions).collect()} == {"e1": 2.0, "e2": 3.0, "e3": 1.0}
    nodes = spark.createDataFrame([(n, n, "{}") for n in "abcd"], "node_id string, content string, metadata string")
    entities = spark.createDataFrame([("k1", "a"), ("k1", "c")], "chunk_id string, node_id string")
    n, e, m, em = resolve.merge(nodes, edges, mentions, entities, "c", "a")
    assert {(r["src"], r["dst"], r["manual"]) for r in e.collect()} == {("a", "b", 2.0), ("b", "d", 0.0)}
    assert m.count() == 2 and em.count() == 1 and "c" in n.where("node_id = 'a'").first()["metadata"]
    with pytest.raises(ValueError):
        resolve.merge(nodes, edges, mentions, entities, "zz", "a")
    assert resolve.merge(nodes, edges, mentions, entities, "a", "a")[1] is edges


def test_resolution(spark):
    kind = "name string, embedding array<float>, at int"
    nodes = spark.createDataFrame([("Acme Widgets", [1.0, 0.0]), ("Server 1", [1.0, 0.0]), ("Jon Smith", [1.0, 0.0])], "content string, embedding array<float>")
    given = spark.createDataFrame([("Acme  Widget", [1.0, 0.0], 1), ("Server 2", [1.0, 0.0], 2), ("Jon Smyth", [0.0, 1.0], 3), (" Acme Widgets ", [0.5, 0.5], 4)], kind)
    got = {r["name"]: (r["content"], r["how"]) for r in resolve.resolve(given, nodes).collect()}
    assert got == {"Acme  Widget": ("Acme Widgets", "fuzzy"), "Server 2": ("Server 2", "new"), "Jon Smyth": ("Jon Smyth", "new"), " Acme Widgets ": ("Acme Widgets", "exact")}


def test_communities(spark):
    labels, settled, _ = communities.propagate(["a", "b"], [("a", "b", 0.6)])
    assert settled and len(set(labels.values())) == 1
    assert not communities.propagate(list("abcd"), [("a", "b", 0.6), ("b", "c", 0.6), ("c", "d", 0.6), ("d", "a", 0.6)], passes=1)[1]
    strong, weak = 1 - math.exp(-5), 1 - math.exp(-0.2)
    cliques = [(x, y, strong) for g in ("abc", "def") for i, x in enumerate(g) for y in g[i + 1 :]]
    labels, _, _ = communities.propagate(list("abcdef"), [*cliques, ("c", "d", weak)])
    assert len(set(labels.values())) == 2
    nodes = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "c")], "namespace string, node_id string")
    edges = spark.createDataFrame([("n1", "a", "b", 1.0)], "namespace string, src string, dst string, weight double")
    out = communities.communities(nodes, edges, ["namespace"])
    assert [(r["namespace"], r["members"]) for r in communities.members(out, ["namespace"]).collect()] == [("n1", ["a", "b"]), ("n2", ["c"])]
    mentions = spark.createDataFrame([("a", "k1"), ("b", "k2")], "node_id string, chunk_id string")
    chunks = spark.createDataFrame([("k1", "text one"), ("k2", "text two")], "chunk_id string, content string")
    none = spark.createDataFrame([], "community_id string, evidence_hash string, summary string")
    first = communities.summarise(out, mentions, chunks, none, lambda e: f"sum of {e}")
    again = communities.summarise(out, mentions, chunks, first, lambda e: "must not run")
    assert [r["reused"] for r in again.collect()] == [True] and "text one" in again.first()["summary"]
    assert communities.overlap(first, "TWO words").first()["overlap"] == 1


def test_verifier(spark):
    pool = [("[a#0]", "checkout-service depends on auth-service. The outage took 12 minutes."), ("[b#0]", "auth-service does not depend on db-7.")]

    def check(claim, citations):
        row = spark.createDataFrame([(claim, citations, pool)], "claim string, citations array<string>, evidence array<struct<marker:string,content:string>>")
        r = grounding.verdicts(row).first()
        return r["verdict"], r["reason"]

    assert check("anything.", []) == ("insufficient", "citation_missing")
    assert check("anything.", ["[z#1]"]) == ("insufficient", "citation_outside_retrieved_evidence")
    assert check("The outage took 45 minutes.", ["[a#0]"]) == ("contradicted", "numeric_or_date_mismatch")
    assert check("cart-service is down.", ["[a#0]"]) == ("insufficient", "evidence_irrelevant")
    assert check("checkout-service is slow.", ["[a#0]"]) == ("insufficient", "evidence_insufficient")
    assert check("checkout-service depends on auth-service.", ["[a#0]"]) == ("supported", "explicit_relation_confirmed")
    assert check("auth-service does not depend on db-7.", ["[b#0]"]) == ("insufficient", "evidence_conflicting")
    split = one(spark, grounding.claims(F.lit("One. [a#0] Two! [b#0][a#0] rest")))
    assert [(c["text"], c["citations"]) for c in split] == [("One.", ["[a#0]"]), ("Two!", ["[b#0]", "[a#0]"])]
    assert one(spark, grounding.claims(F.lit("no marks"))) == []
    assert one(spark, grounding.claims(F.lit("loose [a#0] text")))[0]["text"] == "loose [a#0] text"


@pytest.mark.parametrize(("verdicts", "mode", "status"), [(["supported"] * 2, "verified", "verified"), (["supported", "insufficient"], "verified", "partially_verified"), (["supported", "insufficient"], "verified_strict", "insufficient"), (["supported", "contradicted"], "verified", "contradicted"), (["insufficient"], "verified", "insufficient"), (["insufficient"], "citation_only", "citation_valid_only"), ([None], "verified", "abstained")])
def test_policy(spark, verdicts, mode, status):
    rows = spark.createDataFrame([("x", v) for v in verdicts], "answer_id string, verdict string")
    assert grounding.policy(rows, mode).first()["status"] == status


def test_gates(spark):
    measures = spark.createDataFrame([("supported_claim_retention", 0.9), ("human_agreement_rate", None)], "metric string, value double")
    out = evaluation.gated(measures)
    assert {r["metric"]: r["outcome"] for r in out.collect()}["supported_claim_retention"] == "pass"
    assert evaluation.gates_hold(out) and not evaluation.gates_hold(out, strict=True)
    pairs = spark.createDataFrame([("a b c", "b x"), ("a b c", "b c")], "passage string, fabricated string")
    assert evaluation.fabricated_rejected(pairs).first()[0] == 0.5


def test_budget_skips_what_does_not_fit(spark):
    kept = one(spark, retrieve.within_budget(F.array(F.lit(5), F.lit(9), F.lit(4)), lambda x: x, 10))
    assert kept == [5, 4]


def test_store_ingest_retrieve(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store").create(16)
    with pytest.raises(ValueError):
        store.create(8)
    assert store.status()["ready"]
    session, provider = store.tenant("t1"), Provider(16)
    docs = spark.createDataFrame([("d1", "Alpha depends_on Beta. It is fine."), ("d2", "Beta owned_by Team. Rest.")], "source_id string, text string")
    status = add_documents(session, "ns", docs, provider)
    assert {r["source_id"]: r["extraction_status"] for r in status.collect()} == {"d1": "ready", "d2": "ready"}
    assert store.tenant("t2").scan("documents").count() == store.tenant(None).scan("documents").count() == 0
    with pytest.raises(PermissionError):
        store.tenant(None).write({"documents": status}, "ns")

    def edges():
        return graph.supported(session.scan("edges", "ns"), session.scan("edge_mentions", "ns"))

    assert edges().count() == 2 and session.scan("nodes", "ns").count() == 3
    add_documents(session, "ns", spark.createDataFrame([("d2", "Beta uses Cache. New.")], "source_id string, text string"), provider)
    assert {r["relation"] for r in edges().collect()} == {"depends_on", "uses"}
    add_triplets(session, "ns", spark.createDataFrame([("Alpha", "caused", "Outage"), ("Alpha", "caused", "Alpha")], "subject string, predicate string, object string"), provider)
    assert {r["relation"]: r["weight"] for r in edges().collect()}["caused"] == 1.0
    chunks = session.scan("chunks", "ns").join(session.scan("documents", "ns").select("document_id", "source_id"), "document_id")
    tables = {"chunks": chunks, "nodes": session.scan("nodes", "ns"), "edges": edges(), "entity_mentions": session.scan("entity_mentions", "ns"), "edge_mentions": session.scan("edge_mentions", "ns")}
    vector = one(spark, text.embedding(F.lit("Alpha depends_on"), 16))
    found = retrieve.retrieve(tables, "what does Alpha depend on", vector)
    assert found.chunks[0]["source_id"] == "d1" and {n["content"] for n in found.nodes} >= {"Alpha", "Beta", "Cache"}
    said = retrieve.answer(tables, "what does Alpha use", vector, lambda p, n: "Alpha depends_on Beta. [d1#0] Made up. [d1#0]")
    assert said["status"] == "partially_verified" and said["text"] == "Alpha depends_on Beta. [d1#0]"
    assert retrieve.answer(tables, "what about gone-1", vector, lambda p, n: "x")["status"] == "abstained"
    assert retry(session, "ns", provider).where("extraction_status <> 'ready'").count() == 0


def test_failing_provider(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store").create(4)

    def broken(content):
        raise RuntimeError("down")

    docs = spark.createDataFrame([("d", "text")], "source_id string, text string")
    session = store.tenant("t")
    assert add_documents(session, "ns", docs, Provider(4, extract=broken, retries=0)).first()["extraction_status"] == "failed"
    assert retry(session, "ns", Provider(4, extract=lambda c: [("A", "uses", "B")])).first()["extraction_status"] == "ready"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert readers.texts(spark, f"file://{tmp_path}/a.txt").first()["text"] == "one\ntwo"
    (tmp_path / "t.json").write_text('{"triplets": [{"subject": "A", "predicate": "p", "object": "B"}]}')
    assert tuple(readers.triplets(spark, f"file://{tmp_path}/t.json").first()) == ("A", "p", "B")
    assert readers.incident_cases(spark).count() == 120
    nodes, edges = readers.synthetic_graph(spark, 20)
    assert nodes.count() == 20 and edges.where("weight <= 0").count() == 0


def test_streaming(spark, tmp_path):
    from graphloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Alpha depends_on Beta.")
    store = Store(spark, f"file://{tmp_path}/store").create(4)
    run = ingest.ingest(ingest.documents(spark, f"file://{tmp_path}/in"), store.tenant("t"), "ns", Provider(4), f"file://{tmp_path}/cp")
    run.awaitTermination(120)
    assert store.tenant("t").scan("nodes", "ns").count() == 2


def test_vectors_of_all_nodes_and_chunks(spark, tmp_path):
    """Every vector there is takes part, however many: suppliers and documents from 500 on too."""
    from graphloom import catalog

    vec = lambda i: [1.0, 0.0] if i in (0, 5) else [1.0, 0.001] if i >= 697 else [1.0, 1.0 + i]
    tables = {
        "embeddings": ([(i, vec(i)) for i in range(700)], "vec_id long, embedding array<float>"),
        "supplier": ([(i, f"s{i}") for i in range(700)], "s_suppkey long, s_name string"),
        "documents": ([(i, f"text {i}", "en", "s") for i in range(1400)], "doc_id long, text string, lang string, source string"),
    } | {name: ([], f"{k}_{name}key long, {k}_name string") for k, name in (("r", "region"), ("n", "nation"))}
    tables |= {"customer": ([], "c_custkey long, c_name string"), "part": ([], "p_partkey long, p_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r["node_id"] for r in catalog.QUERIES["node_vector_topk"](spark, str(tmp_path)).collect()} == {"S:0", "S:5", "S:697", "S:698", "S:699"}
    near = {f"{i}:0" for i in (0, 5, 697, 698, 699, 700, 705, 1397, 1398, 1399)}
    assert {r["chunk_id"] for r in catalog.QUERIES["semantic_chunks"](spark, str(tmp_path)).collect() if r["sem_rank"] <= 10} == near
    assert {r["chunk_id"] for r in catalog.QUERIES["hybrid_rrf"](spark, str(tmp_path)).collect()} == near


def test_merged_metadata(spark):
    """Types survive a merge, and a node remembers all that were merged into it, in order."""
    rows = spark.createDataFrame([('{"a":{"b":1},"n":5,"t":true,"x":[1,"2"]}', '{"n":"6"}'), (None, '{"q":1.5}'), ("{}", None)], "a string, b string")
    assert [json.loads(r[0]) for r in rows.select(resolve.merged_json(F.col("a"), F.col("b"))).collect()] == [{"a": {"b": 1}, "n": "6", "t": True, "x": [1, "2"]}, {"q": 1.5}, {}]
    old = spark.createDataFrame([("{}",), ('{"_merged_from":"E","k":1}',), ('{"_merged_from":["E","F"]}',)], "m string")
    got = [json.loads(r[0]) for r in old.select(resolve.history(F.col("m"), "G")).collect()]
    assert got == [{"_merged_from": ["G"]}, {"k": 1, "_merged_from": ["E", "G"]}, {"_merged_from": ["E", "F", "G"]}]


def test_triplets_stated_again(spark, tmp_path):
    session, provider = Store(spark, f"file://{tmp_path}/store").create(4).tenant("t"), Provider(4)
    rows = [("A", "uses", "B", 1.0, '{"x":1,"y":1}'), ("A", "uses", "B", 2.0, '{"y":2}')]
    add_triplets(session, "ns", spark.createDataFrame(rows, "subject string, predicate string, object string, weight double, metadata string").coalesce(1), provider)
    add_triplets(session, "ns", spark.createDataFrame([("A", "uses", "B")], "subject string, predicate string, object string"), provider)
    (edge,) = session.scan("edges", "ns").collect()
    assert edge["manual"] == 4.0 and json.loads(edge["metadata"]) == {"x": 1, "y": 2}


def test_writers_and_crashes(spark, tmp_path):
    """Two writers don't lose each other's change, a dead writer's lock runs out, a crash leaves the store as it was."""
    root = f"file://{tmp_path}/store"
    store = Store(spark, root).create(4)
    node = lambda i: spark.createDataFrame([(i, i, [0.0] * 4, "{}")], "node_id string, content string, embedding array<float>, metadata string")
    store.tenant("a").write({"nodes": node("1")}, "ns")
    before = {str(p) for p in (tmp_path / "store" / "nodes").iterdir()}
    Store(spark, root).tenant("b").write({"nodes": node("2")}, "ns")
    assert len({str(p) for p in (tmp_path / "store" / "nodes").iterdir()} - before) == 1  # only the own partition is written
    assert store.read("nodes").count() == 2 and [r["node_id"] for r in store.tenant("a").scan("nodes").collect()] == ["1"]
    assert store._lock("dead")
    with pytest.raises(RuntimeError):
        Store(spark, root).tenant("a").write({"nodes": node("3")}, "ns")
    assert store.tenant("a").scan("nodes").first()["node_id"] == "1"
    store._fs.delete(store._path("writer.lock"), False)
    store.lease_seconds = -1
    assert store._lock("dead")
    Store(spark, root).tenant("a").write({"nodes": node("3")}, "ns")
    assert store.tenant("a").scan("nodes").first()["node_id"] == "3"
    with pytest.raises(ZeroDivisionError):
        store.locked(lambda: 1 / 0)
    (tmp_path / "store" / "manifests" / "half.new").write_text("{")
    assert store.status()["ready"] and Store(spark, root).create(4).read("nodes").count() == 2
    with pytest.raises(RuntimeError):
        store._put(2, {})


def test_leases(spark):
    """Claimed once, taken over after expiry, given back on failure; who lost a lease writes nothing."""
    from graphloom.sources.store import EXTRACTION, claim_extractions, finish_extractions

    at = lambda s: F.lit(f"2026-01-01 00:{s:02d}:00").cast("timestamp")
    kind = "content_hash string, provider string, model string, prompt_version string, status string, result array<struct<subject:string,predicate:string,object:string>>, lease_owner string, lease_expires_at timestamp"
    wanted = spark.createDataFrame([(h, "p", "m", "1") for h in "xyy"], ", ".join(f"{c} string" for c in EXTRACTION))
    outcome = lambda df: {r["content_hash"]: r["outcome"] for r in df.collect()}
    state, got = claim_extractions(spark.createDataFrame([], kind), wanted, "one", at(0))
    assert outcome(got) == {"x": "claimed", "y": "claimed"}
    state, got = claim_extractions(state, wanted, "two", at(4))
    assert outcome(got) == {"x": "in_progress", "y": "in_progress"}
    results = spark.createDataFrame([("x", "p", "m", "1", True, [("A", "p", "B")]), ("y", "p", "m", "1", False, [])], "content_hash string, provider string, model string, prompt_version string, ok boolean, result array<struct<subject:string,predicate:string,object:string>>")
    late, _ = claim_extractions(state, wanted, "two", at(6))
    assert {r["status"] for r in finish_extractions(late, results, "one").collect()} == {"in_progress"}
    state = finish_extractions(state, results, "one")
    _, got = claim_extractions(state, wanted, "two", at(4))
    assert outcome(got) == {"x": "done", "y": "claimed"}


def test_model_verifier(spark):
    """Only open claims are sent; a quote must be in a cited passage; a failing call leaves claims insufficient."""
    evidence = [("[a#0]", "Alpha began in spring and ended in May."), ("[b#0]", "Nothing here.")]
    rows = [("x", k, evidence, claim, ["[a#0]"]) for k, claim in enumerate(["Alpha began in spring and ended in May", "Alpha started before summer", "Alpha never ended"])]
    checked = grounding.verdicts(spark.createDataFrame(rows, "answer_id string, at int, evidence array<struct<marker:string,content:string>>, claim string, citations array<string>"))

    def verify(asked):
        assert all(a["passages"] == ["Alpha began in spring and ended in May."] for a in asked)
        return [{"verdict": "supported", "reason": "implied", "quote": "began in spring" if "summer" in a["claim"] else "not there"} for a in asked]

    got = {r["at"]: (r["verdict"], r["reason"], r["quote"]) for r in grounding.model_verdicts(checked, verify).collect()}
    assert got[0][0] == "supported" and got[1] == ("supported", "implied", "began in spring") and got[2] == ("insufficient", "quote_not_in_evidence", None)
    failed = {r["at"]: (r["verdict"], r["reason"]) for r in grounding.model_verdicts(checked, lambda asked: []).collect()}
    assert failed[1] == ("insufficient", "verifier_failed") and failed[0][0] == "supported"
    said = spark.createDataFrame([('[{"text":" A  b ","citations":["[a#0]"]}]',), ('[{"text":"A"}]',), ("no",)], "s string").select(grounding.parsed_claims(F.col("s")).alias("c")).collect()
    assert [tuple(x) for x in said[0]["c"]] == [("A b", ["[a#0]"])] and said[1]["c"] is None and said[2]["c"] is None


def test_community_runs_and_modes(spark, tmp_path):
    """A run only where the graph has changed; summaries kept while their evidence is; modes side by side; lookups by name."""
    from graphloom.plans import community, evaluate

    store = Store(spark, f"file://{tmp_path}/store").create(16)
    session, provider = store.tenant("t"), Provider(16)
    docs = spark.createDataFrame([("d1", "Alpha depends_on Beta. It is fine."), ("d2", "Beta owned_by Team. Rest.")], "source_id string, text string")
    add_documents(session, "ns", docs, provider)
    run = community.detect(session, "ns")
    assert run and community.detect(session, "ns") is None and community.latest_run(session, "ns") == run
    assert session.scan("community_runs", "ns").first()["node_count"] == 3
    said = []
    first = community.summarise(session, "ns", lambda e: e.upper())
    assert not any(r["reused"] for r in first.collect()) and all(r["reused"] for r in community.summarise(session, "ns", said.append).collect()) and not said
    tables = {t: session.scan(t, "ns") for t in ("nodes", "entity_mentions", "edge_mentions", "chunks", "documents")}
    tables["edges"] = graph.supported(session.scan("edges", "ns"), tables["edge_mentions"])
    tables["chunks"] = tables["chunks"].join(tables["documents"].select("document_id", "source_id"), "document_id")
    embed = lambda x: one(spark, text.embedding(F.lit(x), 16))
    cases = spark.createDataFrame([("c1", "single", "what does Alpha depends_on", ["Beta"], ["depends_on"], ["d1"], [], False, 1)], "case_id string, category string, question string, expected array<string>, relations array<string>, sources array<string>, forbidden array<string>, abstain boolean, max_hops int")
    scored = evaluate.modes(tables, cases, embed, which=("vector", "hybrid_graph"))
    out = evaluate.report(scored, f"file://{tmp_path}/report")
    assert {r["mode"]: r["recall_at_5"] for r in out["modes"].collect()} == {"vector": 1.0, "hybrid_graph": 1.0}
    assert spark.read.json(f"file://{tmp_path}/report/latency").count() == 2
    found = retrieve.entity(tables["nodes"], tables["entity_mentions"], tables["chunks"].drop("source_id"), tables["documents"], "Beta", embed)
    assert sorted(r["source_id"] for r in found.collect()) == ["d1", "d2"]
    assert retrieve.find_paths(tables["nodes"], tables["edges"], ["Alpha"], ["Team"], embed).first()["depth"] == 2
    assert retrieve.explain_connection(tables["nodes"], tables["edges"], embed("Alpha"), embed("Team")) == "Alpha --depends_on--> Beta --owned_by--> Team"
    assert retrieve.neighbourhood(tables["nodes"], tables["edges"], ["Alpha"], embed, graph.Walk(hops=1)).count() == 2
    gone = tables | {"chunks": tables["chunks"].withColumn("status", F.lit("retired"))}
    assert not retrieve.retrieve(gone, "what does Alpha depends_on", embed("Alpha")).chunks
    with pytest.raises(ValueError):
        store.preflight(8)


def test_located_quotes(spark):
    """Long claims by their inner words, short ones directly, separators loosened; no others."""
    claims = spark.createDataFrame([(1, "the quick brown fox jumps."), (2, "fox jumps"), (3, "uses-auth_v2 of the big gate now"), (4, "..."), (5, "the quick brown cat jumps")], "k int, claim string")
    texts = spark.createDataFrame([("a", "See the quick brown fox jumps over"), ("b", "It uses auth v2 of the big gate now."), ("c", "nothing"), ("d", None)], "d string, text string")
    assert sorted(tuple(r) for r in grounding.located(claims, texts).select("k", "d").distinct().collect()) == [(1, "a"), (2, "a"), (3, "b")]
