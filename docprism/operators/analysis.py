"""One path from pages and text traces to verdicts, and the tally of an attack study over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprism.functions import numeric as nm
from docprism.operators import detect, encode, order, policy
from docprism.operators.encode import Encoder
from docprism.sources.pages import MAX_CHARS, MAX_PAGES, fold_pages

#: Characters up to which a verdict may be complete, a rule of the queries' SQL; every measure reads longer texts whole all the same.
SEMANTIC_CHARS = 20_000


@dataclass(frozen=True)
class Policy:
    """What calibration and training have left: thresholds of density and variance, and the model of the three measures."""

    density: float
    variance: float
    model: policy.LinearModel


def analyse(pages: DataFrame, traces: DataFrame, boxes: DataFrame, layers: DataFrame, encoder: Encoder, held: Policy, limit: int | None = MAX_CHARS, most: int | None = MAX_PAGES, scored: bool = True) -> DataFrame:
    """A row a document: measures, states of the modules, flags, ``decision, status, verdict, reason_codes``.

    ``pages``: doc_id, page, text; ``traces, boxes, layers``: as :func:`detect.trace_flags`
    takes them.  Pages are folded up to their bounds (``None``: whole); keyword density, sustained
    repetition, coherence of encoded windows and cues read the text, the structure
    module the traces.  A document that was cut is partial; one whose traces can't be
    judged has an error there; without a trace there is nothing hidden.  A measure
    that is missing never counts as clean.  All that reads a text does so in the task that
    folded it; no text is joined or written.

    ``scored`` false: without the score and what only the score and advisory codes take,
    density and coherence.  They are never null, so a document has a score where its
    traces can be judged, and decisions, states and the other codes are the same.
    """
    t = F.col("text")
    rows = fold_pages(pages, limit, most)
    if scored:
        rows = encode.text_coherence(detect.keyword_measures(rows), encoder)
    rows = rows.withColumns({"_cues": detect.cues(t), "_run": detect.sustained(t)})
    rows = rows.withColumns({
        "spans": detect.source_spans(F.col("_cues")), "cue_count": detect.cue_count(F.col("_cues")), "repetition": F.col("_run.width").isNotNull(),
        "baseline": F.when(t.isNotNull(), detect.simple_baseline(t)), "semantic_truncated": F.length(t) > SEMANTIC_CHARS,
    }).drop("text", "_cues", "_run")
    structure = detect.trace_summary(detect.trace_flags(traces, boxes, layers))
    structure = structure.select("doc_id", "trace_score", (F.col("n_invisible") + F.col("n_off_page") + F.col("n_hidden_layer") > 0).alias("explicit"))
    errors = detect.trace_errors(traces).select("doc_id", F.lit(True).alias("_error"))
    for part in (structure, errors):
        rows = rows.join(part, "doc_id", "left")
    failed = F.coalesce("_error", F.lit(False))
    ok, structural = policy.module_status(F.lit(True), F.lit(False), F.lit(True)), policy.structure_flag(F.when(~failed, F.col("trace_score")), ~failed & F.col("explicit"))
    rows = rows.withColumns({
        "input_mode": F.lit("pdf"), "b": F.when(~failed, F.coalesce("trace_score", F.lit(0.0))), "b_flagged": structural, "forced_partial": F.col("stopped") != "end",
        "a_status": ok, "b_status": policy.module_status(F.lit(True), failed, F.lit(True)), "c_status": ok,
    })
    keep = ["doc_id", "baseline", "stopped", "pages_without_text", "trace_score", "cue_count", "repetition", "b", "b_flagged", "input_mode", "forced_partial", "semantic_truncated", "a_status", "b_status", "c_status", "spans", "complete", "reason_codes", "decision", "status", "verdict"]
    if not scored:
        return policy.decide(rows.withColumns({"score": F.when(~failed, F.lit(0.0)), "a_flagged": F.lit(False), "model_flag": F.lit(False)})).select(*keep)
    semantic, injection, anomaly, c_flag = policy.fuse_coherence(F.col("variance"), F.lit(held.variance), F.col("cue_count"))
    rows = rows.withColumns({
        "a": detect.anomaly(F.col("keyword_score"), held.density), "c": anomaly, "a_flagged": F.col("keyword_score") > held.density, "c_flagged": c_flag,
    })
    rows = rows.withColumns({"score": held.model.score(), "model_flag": held.model.decision()})
    return policy.decide(rows).select(*keep, "keyword_score", "variance", "a", "c", "score", "model_flag", "a_flagged", "c_flagged")


def disposition(decision: Column, status: Column) -> Column:
    """Outcome of one document in a study; a document without a verdict is a runtime error."""
    review = F.when(status == "complete", "review_complete").otherwise("review_partial")
    return F.when(decision.isNull(), "runtime_error").when(decision == "review_recommended", review).when(decision == "no_signals_detected", "no_signals").otherwise("insufficient")


OUTCOMES = ("review_complete", "review_partial", "no_signals", "insufficient", "runtime_error")


def tallied(cases: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes by keys of all ``cases`` (doc_id and keys), with Wilson bounds of the reviews; cases without a verdict count."""
    rows = cases.join(verdicts.select("doc_id", "decision", "status"), "doc_id", "left").withColumn("_o", disposition(F.col("decision"), F.col("status")))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("_o") == o).alias(o) for o in OUTCOMES])
    low, high = nm.wilson(F.col("review_complete") + F.col("review_partial"), F.col("n"))
    return out.withColumns({"wilson_low": F.round(low, 9), "wilson_high": F.round(high, 9)})


ARMS = ("full_policy", "cue", "repetition", "structure", "model", "regex")
_CODES = {"cue": "direct_instruction_cue", "repetition": "keyword_repetition_signal", "structure": "pdf_structure_advisory"}


def arms(cases: DataFrame, verdicts: DataFrame, names: tuple[str, ...] = ARMS) -> DataFrame:
    """``case_id, arm, source_group, family, added_attack, status, flagged`` of six arms, or those that are named, over the same verdicts.

    ``cases``: doc_id, source_group, family, added_attack.  The full policy flags a
    review and knows nothing of insufficient evidence; three arms are single reason
    codes, one the model, one the fixed phrases.  What an unscorable document says,
    or an incomplete one that is not flagged, is unknown; a document without a
    verdict is an error in every arm.
    """
    both = cases.join(verdicts, "doc_id", "left")
    flags = {
        "full_policy": F.when(F.col("decision") != "insufficient_evidence", F.col("decision") == "review_recommended"), **{arm: F.array_contains("reason_codes", code) for arm, code in _CODES.items()},
        **({"model": F.col("model_flag")} if "model" in names else {}), "regex": F.col("baseline"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), flags[a].alias("flagged")) for a in names])).alias("x")
    rows = both.select(F.col("doc_id").alias("case_id"), "source_group", "family", "added_attack", F.coalesce("status", F.lit("error")).alias("status"), each).select("case_id", "x.arm", "source_group", "family", "added_attack", "status", "x.flagged")
    known = (F.col("status") == "complete") | (~F.col("status").isin("unscorable", "error") & F.col("flagged"))
    return rows.withColumn("flagged", F.when(known, F.col("flagged")))


def arm_intervals(long: DataFrame, draws: int = 200, seed: int = 42) -> DataFrame:
    """``metric, low, high, draws`` of flag rates by arm and stratum, and of net differences from the full policy, by resampling source groups.

    A draw takes whole groups, the same for all arms, as many as there are; a draw
    without trials counts for no metric.  Group sums are made once; draws add them.
    """
    done = (F.col("status") == "complete") & F.col("flagged").isNotNull()
    full = long.where(done & (F.col("arm") == "full_policy")).select("case_id", F.col("flagged").alias("_full"))
    rows = long.join(full, "case_id", "left")
    sums = {}
    for arm in ARMS:
        for stratum, test in (("attack", F.col("added_attack")), ("control", ~F.col("added_attack"))):
            here = (F.col("arm") == arm) & test
            sums[f"{arm}.{stratum}.all"] = (here & F.coalesce("flagged", F.lit(False)), here)
            sums[f"{arm}.{stratum}.complete"] = (here & done & F.col("flagged"), here & done)
            if arm != "full_policy":
                pair = here & done & F.col("_full").isNotNull()
                sums[f"{arm}.{stratum}.net"] = (pair & F.col("_full") & ~F.col("flagged"), pair, pair & ~F.col("_full") & F.col("flagged"))
    columns, parts = [], []
    for metric, tests in sums.items():
        for k, test in enumerate(tests):
            name = f"{metric.replace('.', '_')}_{k}"
            columns.append(F.count_if(test).alias(name))
            parts.append(name)
    drawn = order.resampled_sums(rows.groupBy("source_group").agg(*columns), "source_group", parts, draws, seed)
    rates = []
    for metric, tests in sums.items():
        name = metric.replace(".", "_")
        up = F.col(f"{name}_0") - F.col(f"{name}_2") if len(tests) == 3 else F.col(f"{name}_0")
        rates.append(F.struct(F.lit(metric).alias("metric"), F.try_divide(up, F.col(f"{name}_1")).alias("rate")))
    q = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))  # of the draws
    each = drawn.select(F.explode(F.array(*rates)).alias("x")).select("x.*")
    return each.groupBy("metric").agg(F.round(q[0], 9).alias("low"), F.round(q[1], 9).alias("high"), F.count("rate").alias("draws"))
