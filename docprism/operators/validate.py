"""Contracts as tables of violations: a rule per row that breaks it; ``enforce`` raises if there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprism.operators.policy import REASONS


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for each row and each rule that does not hold (null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("_broken", broken).select(key, F.explode("_broken").alias("rule"))


def enforce(found: DataFrame, what: str) -> None:
    first = found.limit(5).collect()
    if first:
        raise ValueError(f"{what}: {[tuple(r) for r in first]}")


def unique_by(key: list[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*key)) == 1


def observation_rules() -> dict[str, Column]:
    """Contract of observations: one row an arm, known words, scores and costs in range, states that fit the outcomes."""
    done = F.col("state") == "completed"
    return {
        "unique": unique_by(["doc_id", "arm"]),
        "arm": F.col("arm").isin("baseline", "protected"),
        "state": F.col("state").isin("completed", "held", "error"),
        "label": F.col("label").isin(0, 1),
        "score_range": F.col("ranking_score").isNull() | F.col("ranking_score").between(0, 100),
        "latency": F.col("latency_ms").isNotNull() & (F.col("latency_ms") >= 0),
        "outcome_fits": done == F.col("attack_success").isNotNull(),
        "baseline_not_held": (F.col("arm") != "baseline") | (F.col("state") != "held"),
        "reference_clean": ~F.col("is_reference") | (F.col("label") == 0),
    }


def case_rules() -> dict[str, Column]:
    """Contract of challenge cases: complete cases have known flags; a flag of an incomplete case is true or unknown."""
    return {
        "unique": unique_by(["case_id", "arm"]),
        "status": F.col("status").isin("complete", "partial", "error"),
        "complete_known": (F.col("status") != "complete") | F.col("flagged").isNotNull(),
        "incomplete_unknown": (F.col("status") == "complete") | F.col("flagged").isNull() | F.col("flagged"),
    }


def document_rules(limit: int = 100_000) -> dict[str, Column]:
    return {"has_text": F.coalesce(F.trim("text"), F.lit("")) != "", "not_too_long": F.coalesce(F.length("text"), F.lit(0)) <= limit}


def verdict_rules() -> dict[str, Column]:
    """Contract of results: closed words, and clean verdicts only for complete documents with a score."""
    return {
        "decision": F.col("decision").isin("review_recommended", "no_signals_detected", "insufficient_evidence"),
        "status": F.col("status").isin("complete", "partial", "unscorable"),
        "clean_is_complete": (F.col("decision") != "no_signals_detected") | ((F.col("status") == "complete") & F.col("score").isNotNull()),
        "score_range": F.col("score").isNull() | F.col("score").between(0, 1),
    }


def group_rules(group: str) -> dict[str, Column]:
    """A lineage that can be split by: there, not blank, and no written-out nothing such as a number that is none."""
    said = F.lower(F.trim(F.col(group).cast("string")))
    return {"group_known": F.col(group).isNotNull() & (said != "") & ~said.isin("nan", "none", "null")}


#: Closed words of a projected verdict; a document with a trigger is one to review, and no other is.
TRIGGERS = ("keyword_repetition_signal", "direct_instruction_cue")
CATEGORIES, SEVERITIES = ("direct_instruction", "repetition", "structure", "density"), ("high", "medium", "low")


def projection_rules() -> dict[str, Column]:
    """Consistency of ``decision, status, complete, input_mode, reason_codes, findings``."""
    codes, review = F.col("reason_codes"), F.col("decision") == "review_recommended"
    said = lambda c: F.array_contains(codes, c)
    return {
        "codes_known": F.forall(codes, lambda c: c.isin(*REASONS)), "codes_once": F.size(codes) == F.size(F.array_distinct(codes)), "review_has_trigger": review == F.exists(codes, lambda c: c.isin(*TRIGGERS)),
        "clean_is_whole": (F.col("decision") != "no_signals_detected") | (F.col("complete") & (F.col("status") == "complete")), "incomplete_is_said": (F.col("input_mode") != "pdf") | (~F.col("complete") == said("analysis_incomplete")),
        "findings_known": F.forall("findings", lambda f: f["category"].isin(*CATEGORIES) & f["severity"].isin(*SEVERITIES)), "findings_fit": review == F.exists("findings", lambda f: f["review_trigger"]),
    }


def projected(rows: DataFrame) -> DataFrame:
    """A row a document of :func:`policy.findings`: categories, findings and triggers counted, and the rules it breaks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in projection_rules().items()]), lambda x: x.isNotNull())
    categories = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["category"]))), ",")
    return rows.withColumns({"categories": categories, "n_findings": F.size("findings").cast("long"), "n_triggers": F.size(F.filter("findings", lambda f: f["review_trigger"])).cast("long"), "broken": F.array_join(F.array_sort(broken), ",")})


def shared_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split; must be empty."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1")
