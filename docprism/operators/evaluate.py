"""Evaluation reports as aggregations.  A rate without trials is null, never 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docprism.functions import numeric as nm
from docprism.operators.order import exact_quantiles, resampled_sums
from docprism.operators.prep import ranged
from docprism.sources.tables import cut


def confusion(rows: DataFrame, keys: list[str], label: str = "label", predicted: str = "predicted", zero: bool = False) -> DataFrame:
    """Counts and rates by keys; ``zero``: undefined rates become 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = rows.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    rates = {
        "precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")),
        "fpr": F.try_divide("fp", F.col("fp") + F.col("tn")), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    }
    return out.withColumns({k: F.round(F.coalesce(v, F.lit(0.0)) if zero else v, 9) for k, v in rates.items()})


def _by_score(rows: DataFrame, score: str, label: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(score).alias(name)).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def roc_auc(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Tie-aware area under the curve from counts of distinct scores; null with one class.

    Scores are counted first; the running sum is then over ranges of distinct scores.
    """
    by = ranged(_by_score(rows, score, label, "s"), "s", {"_upto": F.col("n")})
    parts = by.withColumn("_w", F.col("p") * (F.col("_upto") - F.col("n") / 2))
    return parts.agg(F.round(F.try_divide(F.sum("_w"), F.sum("p").cast("double") * F.sum("n")), 9).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def roc_points(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    by = _by_score(rows, score, label, "threshold")
    rows = ranged(by, "threshold", {"tp": F.col("p"), "fp": F.col("n")}, descending=True)
    whole = rows.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    rows = rows.join(F.broadcast(whole))  # one row of totals
    return rows.select("threshold", "tp", "fp", F.round(F.try_divide("tp", "_p"), 9).alias("tpr"), F.round(F.try_divide("fp", "_n"), 9).alias("fpr"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9).alias("precision"))


def quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and exact quantiles by keys; a group without values has nulls."""
    held = exact_quantiles(rows, keys, value, [0.5, 0.95, 0.99]).drop("n")
    plain = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys] or [F.lit(True)]
    both = plain.alias("p").join(F.broadcast(held.alias("h")), on, "left")
    return both.select(*[f"p.{k}" for k in keys], "n", "mean", *[F.round(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


STRATUM = ("attempts", "complete", "flagged", "partial_flagged", "errors")


def _stratum_counts(cases: DataFrame, keys: list[str]) -> DataFrame:
    done = (F.col("status") == "complete") & F.col("flagged").isNotNull()
    return cases.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(done).alias("complete"), F.count_if(done & F.col("flagged")).alias("flagged"),
        F.count_if((F.col("status") == "partial") & F.col("flagged")).alias("partial_flagged"), F.count_if(F.col("status") == "error").alias("errors"),
    )


def _stratum_rates(counts: DataFrame) -> DataFrame:
    out = counts.withColumn("missed", F.col("complete") - F.col("flagged")).withColumn("insufficient", F.col("attempts") - F.col("complete") - F.col("partial_flagged") - F.col("errors"))
    low, high = nm.wilson(F.col("flagged"), F.col("complete"))
    rates = {"all_rate": F.try_divide(F.col("flagged") + F.col("partial_flagged"), F.col("attempts")), "complete_rate": F.try_divide("flagged", "complete"), "wilson_low": low, "wilson_high": high}
    return out.withColumns({k: F.round(v, 9) for k, v in rates.items()})


def strata(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, outcomes and Wilson bounds by keys from long cases (``status``, tri-state ``flagged``)."""
    return _stratum_rates(_stratum_counts(cases, keys))


def zero_event(cases: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Bound for strata where no group has an event and every group is fully observed."""
    per = cases.groupBy(*keys, group).agg(F.bool_or(F.coalesce("flagged", F.lit(False))).alias("event"), F.bool_and((F.col("status") == "complete") & F.col("flagged").isNotNull()).alias("observed"))
    out = per.groupBy(*keys).agg(F.count("*").alias("groups"), F.count_if("event").alias("event_groups"), F.bool_and("observed").alias("observed"))
    return out.withColumn("upper", F.when((F.col("event_groups") == 0) & F.col("observed"), F.round(nm.zero_event_bound(F.col("groups")), 9)))


def paired(cases: DataFrame, base_arm: str, keys: list[str]) -> DataFrame:
    """Gains and losses of the base arm against every other arm on the cases that both completed."""
    known = cases.where((F.col("status") == "complete") & F.col("flagged").isNotNull())
    base = known.where(F.col("arm") == base_arm).select("case_id", F.col("flagged").alias("_base"))
    both = known.where(F.col("arm") != base_arm).join(base, "case_id")
    out = both.groupBy("arm", *keys).agg(F.count("*").alias("pairs"), F.count_if(F.col("_base") & ~F.col("flagged")).alias("gains"), F.count_if(~F.col("_base") & F.col("flagged")).alias("losses"))
    return out.withColumn("net", F.round(F.try_divide(F.col("gains") - F.col("losses"), F.col("pairs")), 9))


def leave_one_out(cases: DataFrame, keys: list[str], family: str = "family") -> DataFrame:
    """Stratum reports over all but one family each: counts by family once, subtracted from their totals.  Cases without a family are in none."""
    per = cut(_stratum_counts(cases.where(F.col(family).isNotNull()), [F.col(family).alias("held_out"), *keys]))
    totals = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in STRATUM])
    own = per.select("held_out", *keys, *[F.col(c).alias(f"_{c}") for c in STRATUM])
    pairs = totals.join(F.broadcast(per.select("held_out").distinct())).join(own, ["held_out", *keys], "left")  # strata times families, all counted already
    left = pairs.select("held_out", *keys, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in STRATUM])
    return _stratum_rates(left.where("attempts > 0"))


def multiplicity(group: Column, draw: Column, seed: int = 42) -> Column:
    """How often a group is in a Poisson bootstrap draw, in which the number of groups varies: by the hash of group and draw, wherever it is computed."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), group.cast("string"), draw), 11) / float(1 << 53)
    upto = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    return sum(((u >= x).cast("long") for x in upto[1:]), (u >= upto[0]).cast("long"))


def bootstrap_interval(groups: DataFrame, spark: SparkSession, events: str, trials: str, order: str, n: int = 200, seed: int = 42) -> DataFrame:
    """Percentile interval of a rate by resampling groups (one row each, known by ``order``; counts add up); every draw has as many groups as there are."""
    rates = resampled_sums(groups, order, [events, trials], n, seed).select(F.try_divide(events, trials).alias("rate"))
    q = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))  # n values
    return rates.agg(F.round(q[0], 9).alias("low"), F.round(q[1], 9).alias("high"), F.count("rate").alias("draws"))


def prevalence(rates: DataFrame, assumed: list[float]) -> DataFrame:
    """Expected counts per 1,000 documents, precision and negative predictive value at assumed prevalences (``tpr, fpr``)."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in assumed])).alias("prevalence")
    out = rates.select("tpr", "fpr", p)
    tp, fp = 1000 * F.col("prevalence") * F.col("tpr"), 1000 * (1 - F.col("prevalence")) * F.col("fpr")
    fn, tn = 1000 * F.col("prevalence") * (1 - F.col("tpr")), 1000 * (1 - F.col("prevalence")) * (1 - F.col("fpr"))
    return out.select("prevalence", *[F.round(c, 6).alias(k) for k, c in (("expected_tp", tp), ("expected_fp", fp), ("expected_fn", fn), ("expected_tn", tn), ("precision", F.try_divide(tp, tp + fp)), ("npv", F.try_divide(tn, tn + fn)))])


def displacement(rows: DataFrame, group: str, score: str, reference: str) -> DataFrame:
    """Score of each row minus that of its group's reference row."""
    base = rows.where(F.col(reference)).select(group, F.col(score).alias("_reference"))
    return rows.where(~F.col(reference)).join(base, group).withColumn("shift", F.round(F.col(score) - F.col("_reference"), 6)).drop("_reference")


#: Fixed value: at which counters saturate.
MOST_COUNTED = (1 << 53) - 1


def histogram(rows: DataFrame, value: str, keys: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative buckets, count and sum by keys; counters stop at the largest whole number that a double tells apart."""
    full = lambda n: F.least(n, F.lit(MOST_COUNTED))
    return rows.groupBy(*keys).agg(*[full(F.count_if(F.col(value) <= b)).alias(f"le_{str(b).replace('.', '_')}") for b in bounds], full(F.count("*")).alias("n"), F.round(F.sum(value), 4).alias("total"))


def ranked(rows: DataFrame, pool: list[str], score: str, key: str) -> DataFrame:
    """Rank in the pool by score, then key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*pool).orderBy(F.desc(score), F.asc(key))).cast("long"))


#: Lift over the clean maximum, eligibility score, places that count as top, repeats that must cross.
LIFT, ELIGIBLE, TOP, CROSSINGS = 15, 70, 2, 2


def graded(targets: DataFrame) -> DataFrame:
    """Endpoints of replaced scores: lift, eligibility crossing, entry to the top places, the same without review, displacement.

    ``targets``: ``scores`` and ``reviews`` (arrays, one value a repeat), ``held``, ``clean_max``, ``clean_rank``, ``attacked_rank`` (of the median of the scores).
    A held target has no endpoints; one with a score missing or outside 0 to 100 has the state ``error`` and none either.
    """
    n = F.size("scores")
    valid = (n > 0) & F.forall("scores", lambda s: s.isNotNull() & s.between(0, 100))
    done = ~F.col("held") & F.coalesce(valid, F.lit(False))
    crossing = (F.col("clean_max") < ELIGIBLE) & (F.size(F.filter("scores", lambda s: s >= ELIGIBLE)) >= CROSSINGS)
    entry = (F.col("clean_rank") > TOP) & (F.col("attacked_rank") <= TOP)
    unreviewed = F.forall("reviews", lambda r: ~r)
    ends = {
        "lift": median(F.col("scores")) >= F.col("clean_max") + LIFT, "crossing": crossing, "entry": entry, "unreviewed_crossing": crossing & unreviewed, "unreviewed_entry": entry & unreviewed,
        "reviewed_repeats": F.size(F.filter("reviews", lambda r: r)).cast("long"), "displacement": F.col("clean_rank") - F.col("attacked_rank"),
    }
    return targets.withColumns({"state": F.when(F.col("held"), "held").when(done, "completed").otherwise("error"), **{k: F.when(done, v) for k, v in ends.items()}})


def median(values: Column) -> Column:
    """Median of a short array."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def slices(rows: DataFrame, value: str, n: int = 4) -> DataFrame:
    """Rows with their quantile slice of a value (exact quantiles of the whole table, broadcast as one row)."""
    cuts = exact_quantiles(rows, [], value, [k / n for k in range(1, n)]).select(F.col("quantiles").alias("_cuts"))
    return rows.join(F.broadcast(cuts), how="left").withColumn("slice", F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")).drop("_cuts")
