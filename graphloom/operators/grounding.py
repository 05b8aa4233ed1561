"""Claims of answers checked against their evidence: splitting, rules, policy, rendering, all as Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.functions import text

# Markers of denial, statuses and texts that results carry.
NEGATIONS = (" not ", "n't ", "no longer", "does not", "doesn't", "isn't", "is not")
GROUNDED = ("verified", "partially_verified", "citation_valid_only")
ABSTENTION = "Insufficient evidence to answer from the indexed sources."
MODES = ("citation_only", "verified", "verified_strict")

MARKER = r"\[[^\[\]\n]+#\d+\]"
_SENTENCE = r"(?s)(.+?[.!?])((?:\s*\[[^\[\]\n]+#\d+\])+)"


def markers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({MARKER})"), 1)


def claims(answer: Column) -> Column:
    """Sentences with the markers right after them; else the whole answer with all markers in it; none without any."""
    pair = F.arrays_zip(F.regexp_extract_all(answer, F.lit(_SENTENCE), 1).alias("s"), F.regexp_extract_all(answer, F.lit(_SENTENCE), 2).alias("m"))
    split = F.transform(pair, lambda p: F.struct(text.normalize(p["s"]).alias("text"), markers(p["m"]).alias("citations")))
    whole = F.array(F.struct(F.trim(answer).alias("text"), markers(answer).alias("citations")))
    return F.when(F.size(split) > 0, split).when(F.size(markers(answer)) > 0, whole).otherwise(F.slice(whole, 1, 0))


def citation_only(answer: Column, allowed: Column) -> Column:
    """Grounded in the weakest sense: at least one marker, all of them known, and no abstention."""
    found = markers(answer)
    return (F.size(found) > 0) & (F.size(F.array_except(found, allowed)) == 0) & (F.trim(answer) != ABSTENTION)


def numbers(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1))


def missing_anchors(claim: Column, evidence: Column) -> Column:
    """Identifiers of the claim that the evidence doesn't have, separators loosened on both sides."""
    held = text.loosened(evidence)
    return F.filter(text.anchors(claim), lambda a: ~F.contains(held, text.loosened(a)))


def quote(claim: Column, passage: Column) -> Column:
    """The claim as it stands in the passage; the whole passage where it does so but for separators; null else."""
    bare = F.trim(F.regexp_replace(claim, r"\.+$", ""))
    return F.when((bare != "") & F.contains(passage, bare), bare).when((bare != "") & F.contains(text.loosened(passage), text.loosened(bare)), passage)


def located(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs of ``claims`` (``claim`` and more) and ``passages`` (``text`` and more) of which the passage has the claim as a quote.

    A claim that stands in a passage has its inner words there, whole and in turn. So claims and passages
    meet on three of them, the longest, and only those pairs are tested. Claims of fewer than five words
    are tested against all passages.
    """
    split = lambda x: F.filter(F.split(text.loosened(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    threes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    inner = claims.withColumn("_words", split(F.trim(F.regexp_replace("claim", r"\.+$", "")))).withColumn("_words", F.when(F.size("_words") >= 5, F.slice("_words", F.lit(2), F.size("_words") - 2)))
    seeded = inner.where("_words is not null").withColumn("_seed", F.array_max(F.transform(threes(F.col("_words")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]).drop("_words")
    seeds = passages.withColumn("_words", split(F.col("text"))).where(F.size("_words") >= 3)
    seeds = seeds.select(*passages.columns, F.explode(F.array_distinct(threes(F.col("_words")))).alias("_seed"))
    met = seeds.join(seeded, "_seed").drop("_seed")
    short = passages.crossJoin(inner.where("_words is null").drop("_words"))  # short claims only
    return met.unionByName(short.select(*met.columns)).where(quote(F.col("claim"), F.col("text")).isNotNull())


def conflicting(claim: Column, pool: Column) -> Column:
    """Whether a passage of the pool has all identifiers of the claim and denies something."""
    wanted = F.transform(text.anchors(claim), text.loosened)

    def denies(passage: Column) -> Column:
        low = F.concat(F.lit(" "), F.lower(passage), F.lit(" "))
        denied = F.lit(False)
        for marker in NEGATIONS:
            denied = denied | F.contains(low, F.lit(marker))
        return denied & F.forall(wanted, lambda a: F.contains(text.loosened(passage), a))

    return (F.size(wanted) > 0) & F.exists(pool, denies)


def verdicts(cases: DataFrame) -> DataFrame:
    """``cases`` (``claim``, ``citations``, ``evidence``: array of struct ``marker``, ``content``) with ``verdict``, ``reason``, ``quote``.

    The rules are tried in turn; the first that applies decides.
    """
    cited = F.flatten(F.transform("citations", lambda c: F.transform(F.filter("evidence", lambda e: e["marker"] == c), lambda e: e["content"])))
    known = F.transform("evidence", lambda e: e["marker"])
    out = cases.withColumn("_cited", cited).withColumn("_all", F.array_join("_cited", " "))
    claimed, shown = numbers(F.col("claim")), numbers(F.col("_all"))
    first = F.get(F.filter(F.transform("_cited", lambda p: quote(F.col("claim"), p)), lambda q: q.isNotNull()), 0)
    out = out.withColumn("quote", first)
    reason = (
        F.when(F.size("citations") <= 0, "citation_missing")
        .when(F.size(F.array_except("citations", known)) > 0, "citation_outside_retrieved_evidence")
        .when((F.size(claimed) > 0) & (F.size(shown) > 0) & (F.size(F.array_except(claimed, shown)) > 0), "numeric_or_date_mismatch")
        .when(F.size(missing_anchors(F.col("claim"), F.col("_all"))) > 0, "evidence_irrelevant")
        .when(F.col("quote").isNull(), "evidence_insufficient")
        .when(conflicting(F.col("claim"), F.transform("evidence", lambda e: e["content"])), "evidence_conflicting")
        .otherwise("explicit_relation_confirmed")
    )
    out = out.withColumn("reason", reason)
    verdict = F.when(F.col("reason") == "explicit_relation_confirmed", "supported").when(F.col("reason") == "numeric_or_date_mismatch", "contradicted").otherwise("insufficient")
    return out.withColumn("verdict", verdict).withColumn("quote", F.when(F.col("verdict") == "supported", F.col("quote"))).drop("_cited", "_all")


def parsed_claims(said: Column) -> Column:
    """Claims from a model's JSON, a list of objects with a ``text`` and a list of ``citations``; null where it has another shape."""
    out = F.from_json(said, "array<struct<text:string,citations:array<string>>>")
    whole = F.forall(out, lambda c: F.coalesce((F.trim(c["text"]) != "") & c["citations"].isNotNull(), F.lit(False)))
    return F.when(whole, F.transform(out, lambda c: F.struct(text.normalize(c["text"]).alias("text"), F.filter(c["citations"], lambda m: m.isNotNull()).alias("citations"))))


def model_verdicts(checked: DataFrame, verify: Callable[[list[dict]], list[dict]], strict: bool = False) -> DataFrame:
    """``checked`` with a model's word on claims that the rules left as ``evidence_insufficient``.

    ``verify`` gets such claims by batches, each a dict of ``claim`` and ``passages`` (the cited ones), and
    returns as many dicts of ``verdict``, ``reason`` and ``quote``. A claim counts as supported only if the
    quote is found in a cited passage. Where the call fails or answers in another shape its claims stay
    insufficient, for the reason ``verifier_failed``; with ``strict`` it raises.
    """
    names = checked.columns
    cited = F.flatten(F.transform("citations", lambda c: F.transform(F.filter("evidence", lambda e: e["marker"] == c), lambda e: e["content"])))
    is_open = F.col("reason") == "evidence_insufficient"
    rows = checked.where(is_open).withColumn("_passages", cited)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = [{"claim": c, "passages": list(p)} for c, p in zip(pdf["claim"], pdf["_passages"], strict=True)]
            try:
                said = [(str(x["verdict"]), str(x["reason"]), x.get("quote")) for x in verify(asked)] if asked else []
                if len(said) != len(asked):
                    raise ValueError("the verifier left claims out")
            except Exception:  # a provider may fail in any way
                if strict:
                    raise
                said = [("insufficient", "verifier_failed", None)] * len(asked)
            yield pdf.assign(_said=[{"verdict": v, "reason": r, "quote": q} for v, r, q in said])

    kind = StructType([*rows.schema.fields, StructField("_said", StructType([StructField(n, StringType()) for n in ("verdict", "reason", "quote")]))])
    said = rows.mapInPandas(call, kind)
    located = F.filter(F.transform("_passages", lambda p: quote(F.col("_said.quote"), p)), lambda q: q.isNotNull())
    held = (F.col("_said.verdict") == "supported") & (F.size(located) > 0)
    verdict = F.when(held, "supported").when(F.col("_said.verdict") == "contradicted", "contradicted").otherwise("insufficient")
    reason = F.when((F.col("_said.verdict") == "supported") & ~F.coalesce(held, F.lit(False)), "quote_not_in_evidence").otherwise(F.col("_said.reason"))
    said = said.withColumns({"verdict": verdict, "reason": reason, "quote": F.when(held, F.get(located, 0))})
    return checked.where(~is_open).select(*names).unionByName(said.select(*names))


def policy(checked: DataFrame, mode: str, answer: str = "answer_id") -> DataFrame:
    """The status of each answer from its claims' verdicts (rows without ``verdict`` are answers without claims)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = checked.groupBy(answer).agg(F.count("verdict").alias("n"), count(F.col("verdict") == "supported").alias("supported"), count(F.col("verdict") == "contradicted").alias("contradicted"))
    status = F.when(F.col("n") == 0, "abstained")
    if mode == "citation_only":
        status = status.otherwise("citation_valid_only")
    else:
        status = status.when(F.col("contradicted") > 0, "contradicted").when(F.col("supported") == F.col("n"), "verified")
        status = status.otherwise("insufficient") if mode == "verified_strict" else status.when(F.col("supported") == 0, "insufficient").otherwise("partially_verified")
    return out.withColumn("status", status).withColumn("grounded", status.isin(*GROUNDED))


def rendered(checked: DataFrame, statuses: DataFrame, answer: str = "answer_id") -> DataFrame:
    """The answers' texts from the claims that survive, in order of ``at``; the abstention text where none does."""
    rows = checked.join(statuses.select(answer, "status"), answer)
    kept = F.col("status").isin("verified", "partially_verified") & (F.col("verdict") == "supported") | (F.col("status") == "citation_valid_only")
    sentence = F.trim(F.concat(F.col("claim"), F.lit(" "), F.array_join("citations", "")))
    out = rows.groupBy(answer, "status").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("at", sentence.alias("s"))))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["s"]), " ")
    return out.select(answer, "status", F.when(F.size("c") > 0, joined).otherwise(ABSTENTION).alias("text"))
