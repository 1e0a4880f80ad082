"""Contracts of paired comparisons: the protocol that declares one, and its observations; both as rules for ``validate.violations``.

A protocol is a row of declared versions, kinds, digests and development data.
An observation is a row a document: what the review said, and under ``baseline``
and ``protected`` what came of the document in each arm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.operators.validate import unique_by

#: The words of the two contracts.
COMPARISONS = ("gate_only", "system_comparison")
MEASUREMENTS = ("measured", "simulated")
LABEL_BASES = ("known_interventions", "natural_adjudicated")
RELATIONS = ("same_team", "independent_team", "unknown")
DIGESTS = ("dataset_sha256", "baseline_screener_sha256", "protected_screener_sha256", "gate_sha256", "success_predicate_sha256", "environment_sha256")
DECISIONS = ("no_signals_detected", "review_recommended", "insufficient_evidence")
STATUSES = ("complete", "partial", "unscorable", "error")
STATES = {"baseline": ("completed", "error"), "protected": ("completed", "held", "error")}
DIGEST, CODE = "^[0-9a-f]{64}$", "^[a-z][a-z0-9_-]{0,47}$"
MAX_FAMILIES, MAX_LATENCY_MS, MAX_COST = 64, 24 * 60 * 60 * 1000, 10**6


def is_digest(c: Column) -> Column:
    """64 lowercase hex digits; a null is none, and ``$`` takes no line end."""
    return F.coalesce(c.rlike(DIGEST) & (F.length(c) == 64), F.lit(False))


def is_code(c: Column) -> Column:
    return F.coalesce(c.rlike(CODE) & ~c.contains("\n"), F.lit(False))


def bounded(c: Column, most: float) -> Column:
    """Missing, or finite from 0 to ``most``; NaN is beyond any bound."""
    return c.isNull() | c.between(0, most)


def protocol_rules() -> dict[str, Column]:
    """Known words, digests, equal screeners where only the gate differs, bounded and distinct development declarations."""
    families, sources = F.col("development_families"), F.col("development_source_sha256s")
    return {
        "version": F.col("schema_version") == "1.0",
        "comparison": F.col("comparison_kind").isin(*COMPARISONS),
        "measurement": F.col("measurement_kind").isin(*MEASUREMENTS),
        "label_basis": F.col("label_basis").isin(*LABEL_BASES),
        "relation": F.col("adversary_relation").isin(*RELATIONS),
        "digests": F.forall(F.array(*DIGESTS), is_digest),
        "gate_only": (F.col("comparison_kind") != "gate_only") | (F.col("baseline_screener_sha256") == F.col("protected_screener_sha256")),
        "families_bounded": F.size(families) <= MAX_FAMILIES,
        "families_distinct": F.size(F.array_distinct(families)) == F.size(families),
        "families_coded": F.forall(families, lambda x: is_code(x) & (x != "none")),
        "sources_distinct": F.size(F.array_distinct(sources)) == F.size(sources),
        "sources_digests": F.forall(sources, is_digest),
    }


def with_development(rows: DataFrame, development: DataFrame) -> DataFrame:
    """``rows`` and whether their document or source is among the digests of the development data (column ``sha256``)."""
    known = development.select("sha256").where("sha256 is not null").distinct()
    out = rows
    for name in ("document", "source"):
        side = known.select(F.col("sha256").alias(f"{name}_sha256"), F.lit(True).alias(f"_{name}"))
        out = out.join(side, f"{name}_sha256", "left")
    return out.withColumn("in_development", F.coalesce("_document", "_source", F.lit(False))).drop("_document", "_source")


def with_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``references``, the no-attack references of their source: counted first, so that no source meets in one task."""
    counts = rows.groupBy("source_sha256").agg(F.count_if("is_reference").alias("references"))
    return rows.join(counts.withColumnRenamed("source_sha256", "_s"), F.col("source_sha256").eqNullSafe(F.col("_s")), "left").drop("_s")


def arm_rules(arm: str, screener: str) -> dict[str, Column]:
    """One arm of an observation: its document and screener, states it can reach, and outcomes that only finished runs have."""
    a = F.col(arm)
    done = F.coalesce(a["state"] == "completed", F.lit(False))
    graded = done & F.coalesce(F.col("label") == 1, F.lit(False))
    return {
        f"{arm}_document": a["document_sha256"] == F.col("document_sha256"),
        f"{arm}_screener": a["screener_sha256"] == F.lit(screener),
        f"{arm}_state": a["state"].isin(*STATES[arm]),
        f"{arm}_output": F.when(done, is_digest(a["output_sha256"])).otherwise(a["output_sha256"].isNull() & a["ranking_score"].isNull()),
        f"{arm}_success": graded == a["attack_success"].isNotNull(),
        f"{arm}_score": bounded(a["ranking_score"], 1),
        f"{arm}_latency": bounded(a["latency_ms"], MAX_LATENCY_MS),
        f"{arm}_cost": bounded(a["cost_usd"], MAX_COST),
    }


def paired_rules(baseline_screener: str, protected_screener: str) -> dict[str, Column]:
    """Rules of observations that have been through :func:`with_development` and :func:`with_counts`."""
    decision, status, state = F.col("review_decision"), F.col("review_status"), F.col("protected")["state"]
    clean = F.coalesce(decision == "no_signals_detected", F.lit(False))
    passed_on = clean & F.coalesce(status == "complete", F.lit(False))
    return {
        "document_digest": is_digest(F.col("document_sha256")),
        "source_digest": is_digest(F.col("source_sha256")),
        "unique_document": unique_by(["document_sha256"]),
        "not_in_development": ~F.col("in_development"),
        "label": F.col("label").isin(0, 1) & F.col("is_reference").isNotNull(),
        "family": is_code(F.col("family")) & ~((F.col("family") == "none") & (F.col("label") == 1)),
        "reference_clean": ~F.col("is_reference") | (F.col("label") == 0),
        "one_reference": ~F.col("is_reference") | (F.col("references") == 1),
        "decision": decision.isNull() | decision.isin(*DECISIONS),
        "status": status.isin(*STATUSES),
        "error_without_decision": (status == "error") == decision.isNull(),
        "clean_is_complete": ~clean | (status == "complete"),
        "gate": ~((state == "completed") & ~passed_on) & ~((state == "held") & passed_on),
        "error_is_error": (status != "error") | (state == "error"),
        **arm_rules("baseline", baseline_screener),
        **arm_rules("protected", protected_screener),
    }


def too_many_families(rows: DataFrame, most: int = MAX_FAMILIES) -> DataFrame:
    """One row with their number if the attacks have more families than the contract allows; must be empty."""
    return rows.where("label = 1").agg(F.count_distinct("family").alias("n")).where(F.col("n") > most)
