"""Fusion of the three measures into a score, and the review policy that does not depend on it."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.functions import numeric as nm
from docprism.sources.tables import cut

FEATURES = ("a", "b", "c")
#: Reason codes in the order of emission.
REASONS = (
    "keyword_repetition_signal", "direct_instruction_cue", "pdf_structure_advisory", "keyword_density_advisory",
    "experimental_model_advisory", "analysis_incomplete", "text_model_unavailable",
)


@dataclass(frozen=True)
class LinearModel:
    """Scaled logistic model of the three features."""

    coef: tuple[float, float, float]
    intercept: float
    mean: tuple[float, float, float]
    scale: tuple[float, float, float]

    def __post_init__(self):
        values = [*self.coef, self.intercept, *self.mean, *self.scale]
        if any(len(v) != 3 for v in (self.coef, self.mean, self.scale)):
            raise ValueError("three features are needed")
        if any(isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or abs(v) > 1e12 for v in values):
            raise ValueError("parameters must be finite and bounded")
        if any(s < 1e-12 for s in self.scale):
            raise ValueError("scales must be positive")

    @staticmethod
    def from_json(text: str) -> LinearModel:
        held = json.loads(text)
        if set(held) != {"coef", "intercept", "mean", "scale", "classes"} or held.pop("classes") != [0, 1]:
            raise ValueError("unexpected parameters")
        return LinearModel(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})

    def logit(self) -> Column:
        """Null where a feature is missing."""
        z = F.lit(float(self.intercept))
        for name, w, m, s in zip(FEATURES, self.coef, self.mean, self.scale):
            z = z + F.lit(float(w)) * (F.col(name) - F.lit(float(m))) / F.lit(float(s))
        return z

    def score(self) -> Column:
        return nm.sigmoid(self.logit())

    def decision(self) -> Column:
        return self.logit() > 0


def fit_linear(rows: DataFrame, label: str = "label") -> LinearModel:
    """Standard scaling with population deviations, then class-balanced logistic regression (inverse penalty 1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    facts = rows.agg(F.count_if(F.greatest(*[F.col(f).isNull() | F.isnan(f) for f in FEATURES]) | ~F.col(label).isin(0, 1)).alias("bad"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    if facts["bad"] or min(facts["n0"], facts["n1"]) < 2:
        raise ValueError("two complete rows of each class are needed")
    mean, scale = [facts[f"m_{f}"] for f in FEATURES], [facts[f"s_{f}"] or 1.0 for f in FEATURES]
    n = facts["n0"] + facts["n1"]
    scaled = rows.select(F.col(label).cast("double").alias("label"), *[((F.col(f) - m) / s).alias(f) for f, m, s in zip(FEATURES, mean, scale)], F.when(F.col(label) == 1, n / 2 / facts["n1"]).otherwise(n / 2 / facts["n0"]).alias("w"))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scaled)
    model = LogisticRegression(weightCol="w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(data)
    return LinearModel(tuple(float(x) for x in model.coefficients), float(model.intercept), tuple(mean), tuple(scale))


def fit_stack(rows: DataFrame, label: str = "label", trees: int = 50, folds: int = 5):
    """Random forest and logistic regression, stacked by a logistic regression over out-of-fold scores and the features.

    Folds follow the hash of the row's features, so they do not depend on the partitioning.
    Returns a function from rows (with the features) to rows with ``stack_score``.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    base = [RandomForestClassifier(numTrees=trees, maxDepth=6, seed=42, labelCol=label), LogisticRegression(labelCol=label)]
    join = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    meta_join = VectorAssembler(inputCols=[*FEATURES, "p0", "p1"], outputCol="meta")

    def scored(models, data):
        for k, model in enumerate(models):
            data = model.transform(data).withColumn(f"p{k}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        return data

    # every fit reads the rows again and again: they are made once, labels and features alone
    rows = cut(rows.select(F.col(label).cast("double").alias(label), *FEATURES))
    data = join.transform(rows).withColumn("_fold", F.pmod(F.xxhash64(*FEATURES), F.lit(folds)))
    parts = [scored([b.fit(data.where(F.col("_fold") != k)) for b in base], data.where(F.col("_fold") == k)) for k in range(folds)]
    outside = parts[0]
    for part in parts[1:]:
        outside = outside.unionByName(part)
    meta = LogisticRegression(labelCol=label, featuresCol="meta").fit(meta_join.transform(outside))
    models = [b.fit(data) for b in base]

    def apply(new: DataFrame) -> DataFrame:
        out = meta.transform(meta_join.transform(scored(models, join.transform(new))))
        return out.withColumn("stack_score", vector_to_array("probability")[1]).drop("features", "meta", "probability", "rawPrediction", "prediction", "p0", "p1")

    return apply


def research_flag(model_flag: Column, cue_count: Column, b: Column) -> Column:
    """Model, or a cue, or strong traces; the deployed policy keeps traces advisory."""
    return F.coalesce(model_flag, F.lit(False)) | (F.coalesce(cue_count, F.lit(0)) > 0) | (F.coalesce(b, F.lit(0.0)) >= 0.9)


def module_status(supported: Column, failed: Column, applicable: Column) -> Column:
    return F.when(~applicable, "not_applicable").when(failed, "error").when(~supported, "unsupported").otherwise("ok")


def structure_flag(score: Column, flags: Column) -> Column:
    """Whether the traces are flagged: half of the score or more, or any explicit flag."""
    return F.coalesce(score >= 0.5, F.lit(False)) | F.coalesce(flags, F.lit(False))


def fuse_coherence(variance: Column, threshold: Column, cue_count: Column) -> tuple[Column, Column, Column, Column]:
    """``semantic, injection, anomaly, flag`` of the coherence measure; without a valid threshold only cues count."""
    valid = threshold > 0
    semantic = F.when(valid, F.least(F.lit(1.0), F.try_divide(variance, 2 * threshold)))
    injection = F.least(F.lit(1.0), 0.5 * cue_count)
    return semantic, injection, F.greatest(F.coalesce(semantic, F.lit(0.0)), injection), F.coalesce(valid & (variance > threshold), F.lit(False)) | (cue_count > 0)


def decide(rows: DataFrame) -> DataFrame:
    """Add ``complete, reason_codes, decision, status, verdict`` to rows.

    Needs ``input_mode`` (pdf or text), ``repetition``, ``cue_count``, ``score``, ``forced_partial``,
    ``semantic_truncated``, ``a_status``, ``b_status``, ``c_status``, ``a_flagged``, ``b_flagged``, ``model_flag``.
    """
    ok = [F.col(f"{m}_status") == "ok" for m in FEATURES]
    pdf = F.col("input_mode") == "pdf"
    complete = pdf & ~F.col("forced_partial") & ~F.col("semantic_truncated") & ok[0] & ok[1] & ok[2]
    direct = F.col("repetition") | (F.col("cue_count") > 0)
    reasons = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in zip(REASONS, (
        F.col("repetition"), F.col("cue_count") > 0, pdf & F.col("b_flagged"), F.col("a_flagged"), F.col("model_flag"), ~complete & pdf, ~complete & ~pdf,
    ))])
    out = rows.withColumn("complete", complete).withColumn("reason_codes", F.filter(reasons, lambda r: r.isNotNull()))
    decision = F.when(direct, "review_recommended").when(F.col("complete") & F.col("score").isNotNull(), "no_signals_detected").otherwise("insufficient_evidence")
    status = F.when(~pdf, "partial").when(F.col("complete"), "complete").when(ok[0] | ok[1] | ok[2], "partial").otherwise("unscorable")
    out = out.withColumn("decision", decision).withColumn("status", status)
    verdict = F.when(F.col("decision") == "review_recommended", "attack").when(F.col("decision") == "no_signals_detected", "clean").otherwise("insufficient")
    return out.withColumn("verdict", verdict)


def forward(decision: Column, status: Column) -> Column:
    """Whether a gate lets a document pass."""
    return (decision == "no_signals_detected") & (status == "complete")


def findings(rows: DataFrame) -> DataFrame:
    """Findings of each document as an array of (category, severity, review_trigger)."""
    f = lambda test, category, severity, trigger: F.when(test, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(trigger).alias("review_trigger")))
    all_ = F.array(f(F.col("cue_count") > 0, "direct_instruction", "high", True), f(F.col("repetition"), "repetition", "high", True), f(F.col("b_flagged"), "structure", "medium", False), f(F.col("a_flagged"), "density", "low", False))
    return rows.withColumn("findings", F.filter(all_, lambda x: x.isNotNull()))
