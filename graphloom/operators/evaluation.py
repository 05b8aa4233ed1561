"""Measures of retrieval and grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Release gates by measure: whether it is to be at most or at least the bound.
GATES = (
    ("unsupported_claim_escape_rate", "<=", 0.05),
    ("contradicted_claim_escape_rate", "<=", 0.02),
    ("supported_claim_retention", ">=", 0.85),
    ("incorrect_abstention_rate", "<=", 0.15),
    ("unknown_citation_rejection_rate", ">=", 1.0),
    ("fabricated_quote_rejection_rate", ">=", 1.0),
    ("failure_safely_shown_rate", ">=", 1.0),
    ("human_agreement_rate", ">=", 0.9),
)


def rate(hit: Column, of: Column) -> Column:
    """Share of the rows ``of`` that ``hit``; null without any."""
    return F.avg(F.when(of, F.when(hit, 1.0).otherwise(0.0)))


def scored_cases(cases: DataFrame) -> DataFrame:
    """Measures of each case.

    ``cases``: ``case_id``, ``category``, ``expected``, ``relations``, ``sources``, ``forbidden`` (arrays, wanted),
    ``chunks``, ``entities`` (contents in rank order), ``found_relations``, ``found_sources``, ``context_tokens``.
    """
    low = lambda c: F.transform(c, F.lower)
    place = lambda within, e: F.array_position(F.transform(F.slice(low(within), 1, 5), lambda t: F.contains(t, e)), True)
    rank = lambda e: F.least(F.nullif(place("chunks", e), F.lit(0)), F.nullif(place("entities", e), F.lit(0)))
    out = cases.withColumn("ranks", F.transform(low("expected"), rank)).withColumn("ranked", F.concat(low("chunks"), low("entities")))
    hits = F.size(F.filter("ranks", lambda r: r.isNotNull()))
    share = lambda have, want: F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(F.array_distinct(want))).otherwise(1.0)
    return out.select(
        "case_id", "category",
        F.when(F.size("expected") > 0, hits / F.size("expected")).otherwise(1.0).alias("recall_at_5"),
        (hits / F.least(F.lit(5), F.greatest(F.lit(1), F.size("ranked")))).alias("precision_at_5"),
        F.when((F.size("expected") > 0) & (hits == F.size("expected")), 1.0 / F.array_min("ranks")).otherwise(0.0).alias("reciprocal_rank"),
        (F.size(F.array_except("relations", "found_relations")) == 0).alias("path_match"),
        share("found_sources", "sources").alias("source_recall"),
        F.exists(low("forbidden"), lambda f: F.exists("ranked", lambda t: F.contains(t, f))).alias("false_connection"),
        "context_tokens",
    )


def summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means of the measures."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    names = ("recall_at_5", "precision_at_5", "reciprocal_rank", "path_match", "source_recall", "false_connection", "context_tokens")
    return scored.groupBy(*by).agg(F.count("*").alias("cases"), *map(mean, names))


def percentiles(values: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """The median, and for each point p the value at place int(n p) - 1 in order, at least the first."""
    own = Window.partitionBy(*by)
    ranked = values.where(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count("*").over(own))
    pick = lambda p: F.max(F.when(F.col("_at") == F.greatest(F.lit(0), F.floor(F.col("_n") * p + 1e-9).cast("int") - 1), F.col(value)))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("p50"), *(pick(p).alias(f"p{round(p * 100)}") for p in points))


def grounding_rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """Escape, retention and abstention rates; ``judged``: ``label`` and ``accepted`` (shown as grounded)."""
    label, accepted = F.col("label"), F.col("accepted")
    return judged.groupBy(*by).agg(
        F.count("*").alias("cases"),
        rate(accepted, label != "supported").alias("unsupported_claim_escape_rate"),
        rate(accepted, label == "contradicted").alias("contradicted_claim_escape_rate"),
        rate(accepted, label == "supported").alias("supported_claim_retention"),
        rate(~accepted, label == "supported").alias("incorrect_abstention_rate"),
    )


def gated(measures: DataFrame) -> DataFrame:
    """``measures`` (``metric``, ``value``) against the gates: ``outcome`` pass, fail, or n/a without a value."""
    rows = [(m, d, b) for m, d, b in GATES]
    gates = measures.sparkSession.createDataFrame(rows, "metric string, direction string, bound double")
    met = F.when(F.col("direction") == "<=", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return gates.join(measures, "metric", "left").withColumn("outcome", F.when(F.col("value").isNull(), "n/a").when(met, "pass").otherwise("fail"))


def gates_hold(outcome: DataFrame, strict: bool = False) -> bool:
    bad = ["fail", "n/a"] if strict else ["fail"]
    return outcome.where(F.col("outcome").isin(bad)).isEmpty()


def fabricated_rejected(pairs: DataFrame) -> DataFrame:
    """Share of fabricated quotes that are not in their passage; ``pairs``: ``passage``, ``fabricated``."""
    from graphloom.operators.grounding import quote

    return pairs.agg(F.avg(F.when(quote(F.col("fabricated"), F.col("passage")).isNull(), 1.0).otherwise(0.0)).alias("fabricated_quote_rejection_rate"))


def blind(cases: DataFrame) -> DataFrame:
    """Cases without the fields that give the label away."""
    return cases.drop("label", "notes", "category", "split")


def agreement(first: DataFrame, second: DataFrame, skip: tuple[str, ...] = ("failed",)) -> DataFrame:
    """Cases both labelled (``id``, ``label``), how many alike, and the share; labels in ``skip`` don't count."""
    both = first.select("id", F.col("label").alias("a")).join(second.select("id", F.col("label").alias("b")), "id")
    both = both.where(~F.col("a").isin(list(skip)) & ~F.col("b").isin(list(skip)))
    return both.agg(F.count("*").alias("compared"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).cast("long").alias("alike"), F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("rate"))


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cases labelled differently or by one side only."""
    out = first.select("id", F.col("label").alias("first")).join(second.select("id", F.col("label").alias("second")), "id", "full_outer")
    return out.where(~F.col("first").eqNullSafe(F.col("second")))


def keyword_recall(answers: DataFrame) -> DataFrame:
    """Share of questions whose context holds all ``expected`` strings, by ``mode``."""
    return answers.groupBy("mode").agg(F.avg(F.forall("expected", lambda e: F.contains(F.lower("context"), F.lower(e))).cast("double")).alias("recall"))


def usage(events: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Events and tokens by tenant, namespace and kind."""
    return events.groupBy("tenant_id", "namespace", "kind").agg(F.count("*").alias("events"), F.sum(tokens).alias("tokens"))
