"""Queries of the evaluation suite and of the operational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docprism.functions import numeric as nm
from docprism.operators import evaluate as ev
from docprism.operators import order, prep, validate
from docprism.plans import fixtures as fx
from docprism.plans.detector_queries import KEYWORDS, keyed
from docprism.plans.prep_queries import CORPUS
from docprism.plans.registry import query
from docprism.sources.tables import cut, table
from docprism.streaming import windows

RATES = "round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS fpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1"
COUNTS = "count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn"
WILSON = """CASE WHEN n > 0 THEN round(greatest((k / n + z * z / 2 / n) / (1 + z * z / n) - z * sqrt(greatest(k / n * (1 - k / n) / n + z * z / 4 / (n::DOUBLE * n), 0)) / (1 + z * z / n), 0), 9) END AS wilson_low,
 CASE WHEN n > 0 THEN round(least((k / n + z * z / 2 / n) / (1 + z * z / n) + z * sqrt(greatest(k / n * (1 - k / n) / n + z * z / 4 / (n::DOUBLE * n), 0)) / (1 + z * z / n), 1), 9) END AS wilson_high"""
Z = "1.959963984540054"


def flagged(spark, sf_dir):
    return keyed(spark, sf_dir).select("source_id", "attack_type", F.col("is_adversarial").alias("label"), (F.col("keyword_score") > 0.02).cast("int").alias("predicted"), "keyword_score")


FLAGGED = f"{CORPUS}, {KEYWORDS}, fl AS (SELECT source_id, attack_type, is_adversarial = 1 AS y, keyword_score > 0.02 AS p, keyword_score FROM keyed)"


@query(f"WITH {FLAGGED} SELECT *, {RATES} FROM (SELECT {COUNTS} FROM fl)")
def confusion_metrics(spark, sf_dir):
    return ev.confusion(flagged(spark, sf_dir), [])


@query(f"WITH {FLAGGED} SELECT attack_type, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM (SELECT attack_type, {COUNTS} FROM fl GROUP BY attack_type)")
def confusion_zero_division(spark, sf_dir):
    return ev.confusion(flagged(spark, sf_dir), ["attack_type"], zero=True)


@query(f"WITH {FLAGGED}, w AS (SELECT attack_type, count(*) AS n, count(*) FILTER (p) AS k, {Z} AS z FROM fl GROUP BY attack_type) SELECT attack_type, n, k AS flagged, {WILSON} FROM w")
def wilson_by_family(spark, sf_dir):
    rows = flagged(spark, sf_dir).groupBy("attack_type").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == 1).alias("flagged"))
    low, high = nm.wilson(F.col("flagged"), F.col("n"))
    return rows.withColumns({"wilson_low": F.round(low, 9), "wilson_high": F.round(high, 9)})


@query(f"""WITH {FLAGGED}, d AS (SELECT round(keyword_score, 9) AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM fl GROUP BY 1), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
SELECT round(sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)), 9) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM w""")
def roc_auc(spark, sf_dir):
    return ev.roc_auc(flagged(spark, sf_dir).withColumn("s9", F.round("keyword_score", 9)), "s9")


@query(f"""WITH {FLAGGED}, d AS (SELECT round(keyword_score, 9) AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM fl GROUP BY 1), c AS (SELECT s, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM d WINDOW o AS (ORDER BY s DESC))
SELECT s AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / ap, 9) AS tpr, round(fp / an, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM c""")
def roc_points(spark, sf_dir):
    return ev.roc_points(flagged(spark, sf_dir).withColumn("s9", F.round("keyword_score", 9)), "s9")


@query(f"WITH {FLAGGED} SELECT attack_type, count(*) AS n, count(*) FILTER (p) AS flagged, attack_type IN ('TYPE_A', 'TYPE_B') AS declared FROM fl GROUP BY attack_type")
def family_counts(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("attack_type").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == 1).alias("flagged")).withColumn("declared", F.col("attack_type").isin("TYPE_A", "TYPE_B"))


@query(f"WITH {FLAGGED}, g AS (SELECT source_id % 50 AS g, bool_or(p AND NOT y) AS fp FROM fl WHERE NOT y GROUP BY 1) SELECT count(*) AS n_groups, count(*) FILTER (fp) AS fp_groups FROM g")
def source_false_positive(spark, sf_dir):
    rows = flagged(spark, sf_dir).where("label = 0").groupBy((F.col("source_id") % 50).alias("g")).agg(F.max("predicted").alias("fp"))
    return rows.agg(F.count("*").alias("n_groups"), F.count_if(F.col("fp") == 1).alias("fp_groups"))


@query()
def source_false_positive_bound(spark, sf_dir):
    """Exact upper bound of the share of groups with a false positive: a bisection on two counts."""
    n, k = source_false_positive(spark, sf_dir).select("n_groups", "fp_groups").first()
    return spark.createDataFrame([(n, k, nm.beta_upper(k, n))], "n_groups long, fp_groups long, upper double")


STRATA = """count(*) AS attempts, count(*) FILTER (status = 'complete' AND flagged IS NOT NULL) AS complete, count(*) FILTER (status = 'complete' AND flagged) AS flagged, count(*) FILTER (status = 'partial' AND flagged) AS partial_flagged, count(*) FILTER (status = 'error') AS errors"""
STRATUM_W = f"SELECT *, flagged AS k, nullif(complete, 0) AS n, {Z} AS z FROM"


def _stratum_sql(keys: str, source: str, prefix: str = "") -> str:
    return f"""WITH {fx.CASES}{prefix} SELECT {keys}, attempts, complete, flagged, partial_flagged, errors, complete - flagged AS missed, attempts - complete - partial_flagged - errors AS insufficient, round((flagged + partial_flagged) / attempts, 9) AS all_rate, round(flagged / nullif(complete, 0), 9) AS complete_rate, {WILSON}
 FROM ({STRATUM_W} (SELECT {keys}, {STRATA} FROM {source} GROUP BY {keys}))"""


@query(_stratum_sql("arm, added_attack", "cases"))
def arm_strata(spark, sf_dir):
    return ev.strata(fx.cases(spark, sf_dir), ["arm", "added_attack"])


@query(_stratum_sql("arm", "cases"))
def arm_overall(spark, sf_dir):
    return ev.strata(fx.cases(spark, sf_dir), ["arm"])


@query(_stratum_sql("held_out, arm", "(SELECT * FROM cases JOIN (SELECT DISTINCT family AS held_out FROM cases) ON family <> held_out)"))
def leave_one_family_out(spark, sf_dir):
    return ev.leave_one_out(fx.cases(spark, sf_dir), ["arm"])


@query(f"""WITH {fx.CASES}, known AS (SELECT * FROM cases WHERE status = 'complete' AND flagged IS NOT NULL), j AS (SELECT o.arm, o.added_attack, o.flagged, b.flagged AS base FROM known o JOIN known b USING (case_id) WHERE o.arm <> 'full_policy' AND b.arm = 'full_policy')
SELECT arm, added_attack, count(*) AS pairs, count(*) FILTER (base AND NOT flagged) AS gains, count(*) FILTER (NOT base AND flagged) AS losses, round((count(*) FILTER (base AND NOT flagged) - count(*) FILTER (NOT base AND flagged)) / count(*), 9) AS net FROM j GROUP BY arm, added_attack""")
def paired_arms(spark, sf_dir):
    return ev.paired(fx.cases(spark, sf_dir), "full_policy", ["added_attack"])


@query(f"""WITH {fx.CASES}, g AS (SELECT arm, added_attack, source_group, bool_or(coalesce(flagged, false)) AS event, bool_and(status = 'complete' AND flagged IS NOT NULL) AS observed FROM cases GROUP BY ALL),
s AS (SELECT arm, added_attack, count(*) AS groups, count(*) FILTER (event) AS event_groups, bool_and(observed) AS observed FROM g GROUP BY ALL) SELECT *, CASE WHEN event_groups = 0 AND observed THEN round(1 - pow(0.05, 1.0 / groups), 9) END AS upper FROM s""")
def zero_event_bound(spark, sf_dir):
    return ev.zero_event(fx.cases(spark, sf_dir), "source_group", ["arm", "added_attack"])


@query(f"""WITH {fx.CASES} SELECT coalesce(family, 'all') AS family, CASE WHEN status = 'error' THEN 'runtime_error' WHEN flagged THEN 'review_' || status WHEN status = 'complete' THEN 'no_signals' ELSE 'insufficient' END AS disposition, count(*) AS n FROM cases WHERE arm = 'full_policy' GROUP BY GROUPING SETS ((family, disposition), (disposition))""")
def disposition_tally(spark, sf_dir):
    kind = F.when(F.col("status") == "error", "runtime_error").when(F.col("flagged"), F.concat(F.lit("review_"), "status")).when(F.col("status") == "complete", "no_signals").otherwise("insufficient")
    rows = fx.cases(spark, sf_dir).where("arm = 'full_policy'").withColumn("disposition", kind)
    tallies = rows.groupingSets([["family", "disposition"], ["disposition"]], "family", "disposition").agg(F.count("*").alias("n"))
    return tallies.select(F.coalesce("family", F.lit("all")).alias("family"), "disposition", "n")


@query(f"""WITH {fx.CASES}, u AS (SELECT arm, added_attack, count(*) AS attempts FROM cases GROUP BY GROUPING SETS ((arm), (arm, added_attack))) SELECT arm, coalesce(added_attack::VARCHAR, 'all') AS stratum, attempts FROM u""")
def arm_rollup(spark, sf_dir):
    rows = fx.cases(spark, sf_dir).rollup("arm", "added_attack").agg(F.count("*").alias("attempts")).where("arm is not null")
    return rows.select("arm", F.coalesce(F.col("added_attack").cast("string"), F.lit("all")).alias("stratum"), "attempts")


@query()
def cluster_bootstrap(spark, sf_dir):
    """Percentile interval of the flag rate by resampling source groups."""
    rows = fx.cases(spark, sf_dir).where("arm = 'full_policy' and added_attack and status = 'complete'")
    groups = rows.groupBy("source_group").agg(F.count_if("flagged").alias("events"), F.count("*").alias("trials"))
    return ev.bootstrap_interval(groups, spark, "events", "trials", "source_group")


DRAWS, DRAW_GROUPS = 40, 40
#: Multiplicities by an integer rule, so that both engines draw alike.
RULE_DRAWS = f"""d AS (SELECT b, (b * 7919 + i * 104729 + i * i * 31) % {DRAW_GROUPS} AS g, count(*) AS mult FROM range({DRAWS}) t(b), range({DRAW_GROUPS}) s(i) GROUP BY ALL)"""


@query(f"""WITH {fx.CASES}, {RULE_DRAWS}, g AS (SELECT source_group AS g, count(*) FILTER (flagged) AS events, count(*) AS trials FROM cases WHERE arm = 'full_policy' AND added_attack AND status = 'complete' GROUP BY 1),
r AS (SELECT b, sum(mult * events) / nullif(sum(mult * trials), 0) AS rate FROM d JOIN g USING (g) GROUP BY b) SELECT round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high, count(rate) AS draws FROM r""")
def rule_bootstrap(spark, sf_dir):
    """Bootstrap with draws that are a table: join draws to groups with multiplicity."""
    b, i = F.col("b"), F.col("i")
    d = spark.range(DRAWS).select(F.col("id").alias("b")).select("b", F.explode(F.sequence(F.lit(0), F.lit(DRAW_GROUPS - 1))).alias("i"))
    d = d.select("b", ((b * 7919 + i * 104729 + i * i * 31) % DRAW_GROUPS).alias("g")).groupBy("b", "g").agg(F.count("*").alias("mult"))
    rows = fx.cases(spark, sf_dir).where("arm = 'full_policy' and added_attack and status = 'complete'")
    groups = rows.groupBy(F.col("source_group").alias("g")).agg(F.count_if("flagged").alias("events"), F.count("*").alias("trials"))
    rates = d.join(groups, "g").groupBy("b").agg(F.try_divide(F.sum(F.col("mult") * F.col("events")), F.sum(F.col("mult") * F.col("trials"))).alias("rate"))
    q = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))
    return rates.agg(F.round(q[0], 9).alias("low"), F.round(q[1], 9).alias("high"), F.count("rate").alias("draws"))


@query(f"""WITH {fx.OBSERVATIONS} SELECT arm, state, count(*) AS n, count(DISTINCT source_id) AS sources, count(*) FILTER (review) AS reviewed FROM obs GROUP BY arm, state""")
def downstream_inventory(spark, sf_dir):
    return fx.observations(spark, sf_dir).groupBy("arm", "state").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count_if("review").alias("reviewed"))


@query(f"""WITH {fx.OBSERVATIONS}, p AS (SELECT doc_id, any_value(attack_success) FILTER (arm = 'baseline') AS b, any_value(attack_success) FILTER (arm = 'protected') AS q FROM obs WHERE label = 1 GROUP BY doc_id)
SELECT count(b) AS baseline_n, count(*) FILTER (b) AS baseline_success, count(q) AS protected_n, count(*) FILTER (q) AS protected_success, count(*) FILTER (b IS NOT NULL AND q IS NOT NULL) AS matched,
 round((count(*) FILTER (q AND b IS NOT NULL) - count(*) FILTER (b AND q IS NOT NULL)) / nullif(count(*) FILTER (b IS NOT NULL AND q IS NOT NULL), 0), 9) AS matched_delta FROM p""")
def attack_outcomes(spark, sf_dir):
    rows = fx.observations(spark, sf_dir).where("label = 1").groupBy("doc_id").pivot("arm", ["baseline", "protected"]).agg(F.any_value("attack_success"))
    b, q = F.col("baseline"), F.col("protected")
    both = b.isNotNull() & q.isNotNull()
    delta = F.try_divide(F.count_if(q & b.isNotNull()) - F.count_if(b & q.isNotNull()), F.count_if(both))
    return rows.agg(F.count(b).alias("baseline_n"), F.count_if(b).alias("baseline_success"), F.count(q).alias("protected_n"), F.count_if(q).alias("protected_success"), F.count_if(both).alias("matched"), F.round(delta, 9).alias("matched_delta"))


@query(f"WITH {fx.OBSERVATIONS} SELECT label, count(*) AS n, count(*) FILTER (review) AS reviewed, round(count(*) FILTER (review) / count(*), 9) AS rate FROM obs WHERE arm = 'baseline' GROUP BY label")
def review_burden(spark, sf_dir):
    return fx.observations(spark, sf_dir).where("arm = 'baseline'").groupBy("label").agg(F.count("*").alias("n"), F.count_if("review").alias("reviewed"), F.round(F.count_if("review") / F.count("*"), 9).alias("rate"))


QUANT = "count({x}) AS n, round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.95), 6) AS p95, round(quantile_cont({x}, 0.99), 6) AS p99"


@query(f"WITH {fx.OBSERVATIONS} SELECT arm, {QUANT.format(x='latency_ms')} FROM obs GROUP BY arm")
def latency_quantiles(spark, sf_dir):
    return ev.quantiles(fx.observations(spark, sf_dir), ["arm"], "latency_ms")


@query(f"WITH {fx.OBSERVATIONS}, d AS (SELECT p.cost - b.cost AS delta, b.state = 'completed' AND p.state = 'completed' AS both_done FROM obs b JOIN obs p USING (doc_id) WHERE b.arm = 'baseline' AND p.arm = 'protected') SELECT both_done, {QUANT.format(x='delta')} FROM d GROUP BY both_done")
def cost_deltas(spark, sf_dir):
    rows = fx.observations(spark, sf_dir)
    b = rows.where("arm = 'baseline'").select("doc_id", F.col("cost").alias("bc"), F.col("state").alias("bs"))
    p = rows.where("arm = 'protected'").select("doc_id", F.col("cost").alias("pc"), F.col("state").alias("ps"))
    d = b.join(p, "doc_id").select((F.col("pc") - F.col("bc")).alias("delta"), ((F.col("bs") == "completed") & (F.col("ps") == "completed")).alias("both_done"))
    return ev.quantiles(d, ["both_done"], "delta")


@query(f"WITH {fx.OBSERVATIONS}, r AS (SELECT source_id, arm, ranking_score AS ref FROM obs WHERE is_reference) SELECT o.doc_id, o.arm, round(o.ranking_score - r.ref, 6) AS shift FROM obs o JOIN r ON o.source_id = r.source_id AND o.arm = r.arm WHERE NOT o.is_reference")
def score_displacement(spark, sf_dir):
    rows = fx.observations(spark, sf_dir).withColumn("g", F.struct("source_id", "arm"))
    return ev.displacement(rows, "g", "ranking_score", "is_reference").select("doc_id", "arm", "shift")


@query("SELECT conv_id, role, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, median(length(text))::DOUBLE AS middle, max(length(text)) - min(length(text)) AS spread FROM conversations GROUP BY conv_id, role")
def replicate_stats(spark, sf_dir):
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.median(size).alias("middle"), (F.max(size) - F.min(size)).alias("spread"))


@query("""WITH m AS (SELECT conv_id, median(length(text)) FILTER (role = 'user') AS u, median(length(text)) FILTER (role = 'assistant') AS a, bool_or(text IS NULL) AS missing FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_filter([CASE WHEN a - u > 700 THEN 'arm_gap' END, CASE WHEN missing THEN 'missing' END, CASE WHEN u IS NULL OR a IS NULL THEN 'one_arm' END], lambda x: x IS NOT NULL)), ',') AS failures FROM m""")
def qualification_failures(spark, sf_dir):
    size = F.length("text").cast("long")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.median(F.when(F.col("role") == "user", size)).alias("u"), F.median(F.when(F.col("role") == "assistant", size)).alias("a"), F.bool_or(F.col("text").isNull()).alias("missing"))
    failed = F.array(F.when(F.col("a") - F.col("u") > 700, "arm_gap"), F.when(F.col("missing"), "missing"), F.when(F.col("u").isNull() | F.col("a").isNull(), "one_arm"))
    return rows.select("conv_id", F.array_join(F.sort_array(F.filter(failed, lambda x: x.isNotNull())), ",").alias("failures"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations")
def pool_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("score", F.length("text"))
    return ev.ranked(rows, ["conv_id"], "score", "turn").select("conv_id", "turn", "rank")


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS s, length(text) + CASE WHEN turn = 0 THEN 900 ELSE 0 END AS t FROM conversations),
r AS (SELECT conv_id, turn, s, t, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS clean_rank, row_number() OVER (PARTITION BY conv_id ORDER BY t DESC, turn) AS attacked_rank, max(s) OVER (PARTITION BY conv_id) AS top FROM c)
SELECT conv_id, clean_rank, attacked_rank, clean_rank - attacked_rank AS displacement, clean_rank > 2 AND attacked_rank <= 2 AS entered, t >= top + 15 AS lifted FROM r WHERE turn = 0""")
def rank_displacement(spark, sf_dir):
    """Rank of one target in the clean pool and in the pool where only its score is replaced."""
    rows = table(spark, sf_dir, "conversations").withColumn("s", F.length("text")).withColumn("t", F.col("s") + F.when(F.col("turn") == 0, 900).otherwise(0))
    rows = rows.withColumn("top", F.max("s").over(Window.partitionBy("conv_id")))
    clean = ev.ranked(rows, ["conv_id"], "s", "turn").withColumnRenamed("rank", "clean_rank")
    both = ev.ranked(clean, ["conv_id"], "t", "turn").withColumnRenamed("rank", "attacked_rank").where("turn = 0")
    return both.select("conv_id", "clean_rank", "attacked_rank", (F.col("clean_rank") - F.col("attacked_rank")).alias("displacement"), ((F.col("clean_rank") > 2) & (F.col("attacked_rank") <= 2)).alias("entered"), (F.col("t") >= F.col("top") + 15).alias("lifted"))


_REPEATS = "list_transform(range(0, 3), lambda r: least(100, 3 * hits + (source_id * 7 + r * 3) % 5)::BIGINT)"


@query(f"""WITH {CORPUS}, {KEYWORDS}, r AS (SELECT source_id, source_id % 20 AS pool, attack_type, is_adversarial, {_REPEATS} AS scores, list_transform(range(0, 3), lambda r: keyword_score > 0.02 * (r + 1)) AS reviews FROM keyed),
c AS (SELECT pool, source_id, list_median(scores) AS s, list_max(scores) AS top FROM r WHERE is_adversarial = 0), k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY s DESC, source_id) AS clean_rank FROM c),
t AS (SELECT r.pool, r.source_id, r.attack_type, r.scores, r.reviews, list_median(r.scores) AS m, k.top, k.clean_rank, r.attack_type = 'TYPE_B' AS held FROM r JOIN k USING (source_id) WHERE r.is_adversarial = 1),
a AS (SELECT t.source_id, 1 + count(c.source_id) AS attacked_rank FROM t LEFT JOIN c ON c.pool = t.pool AND c.source_id <> t.source_id AND (c.s > t.m OR (c.s = t.m AND c.source_id < t.source_id)) GROUP BY t.source_id),
g AS (SELECT t.*, attacked_rank, top < 70 AND len(list_filter(scores, lambda x: x >= 70)) >= 2 AS crossing, clean_rank > 2 AND attacked_rank <= 2 AS entry, len(list_filter(reviews, lambda x: x)) AS n_reviews FROM t JOIN a USING (source_id))
SELECT source_id, CASE WHEN held THEN 'held' ELSE 'completed' END AS state, CASE WHEN NOT held THEN m >= top + 15 END AS lift, CASE WHEN NOT held THEN crossing END AS crossing, CASE WHEN NOT held THEN entry END AS entry, CASE WHEN NOT held THEN crossing AND n_reviews = 0 END AS unreviewed_crossing,
 CASE WHEN NOT held THEN entry AND n_reviews = 0 END AS unreviewed_entry, CASE WHEN NOT held THEN n_reviews END AS reviewed_repeats, CASE WHEN NOT held THEN clean_rank - attacked_rank END AS displacement, clean_rank, attacked_rank FROM g""")
def rank_study(spark, sf_dir):
    """A screener that counts skill words, three repeats: what attacks gain in their pools, with hidden blocks held back."""
    repeats = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.least(F.lit(100), 3 * F.col("hits") + (F.col("source_id") * 7 + r * 3) % 5).cast("long"))
    reviews = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.col("keyword_score") > 0.02 * (r + 1))
    rows = keyed(spark, sf_dir).select("source_id", (F.col("source_id") % 20).alias("pool"), "attack_type", "is_adversarial", repeats.alias("scores"), reviews.alias("reviews"))
    rows = cut(rows)  # texts are scored once; clean rows and targets are read several times
    clean = rows.where("is_adversarial = 0").select("pool", "source_id", ev.median(F.col("scores")).alias("s"), F.array_max("scores").alias("clean_max"))
    targets = rows.where("is_adversarial = 1").select("pool", "source_id", "scores", "reviews", ev.median(F.col("scores")).alias("new"), (F.col("attack_type") == "TYPE_B").alias("held")).join(clean.select("source_id", "clean_max"), "source_id")
    graded = ev.graded(order.replaced_ranks(clean, targets, "pool", "source_id", "s", "new"))
    return graded.select("source_id", "state", "lift", "crossing", "entry", "unreviewed_crossing", "unreviewed_entry", "reviewed_repeats", "displacement", "clean_rank", "attacked_rank")


@query(f"""WITH {FLAGGED}, c AS (SELECT count(*) FILTER (y AND p) / count(*) FILTER (y) AS tpr, count(*) FILTER (NOT y AND p) / count(*) FILTER (NOT y) AS fpr FROM fl), x AS (SELECT round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, unnest([0.01, 0.05, 0.2]::DOUBLE[]) AS q FROM c)
SELECT q AS prevalence, round(1000 * q * tpr, 6) AS expected_tp, round(1000 * (1 - q) * fpr, 6) AS expected_fp, round(1000 * q * (1 - tpr), 6) AS expected_fn, round(1000 * (1 - q) * (1 - fpr), 6) AS expected_tn, round(q * tpr / nullif(q * tpr + (1 - q) * fpr, 0), 6) AS precision, round((1 - q) * (1 - fpr) / nullif((1 - q) * (1 - fpr) + q * (1 - tpr), 0), 6) AS npv FROM x""")
def prevalence_scenarios(spark, sf_dir):
    rates = ev.confusion(flagged(spark, sf_dir), []).select(F.col("recall").alias("tpr"), "fpr")
    return ev.prevalence(rates, [0.01, 0.05, 0.2])


@query(f"""WITH {CORPUS}, m AS (SELECT source_id, is_adversarial, unnest([0, 50]) AS budget, regexp_extract_all(lower(text), '[a-z]+') AS w FROM corpus) SELECT budget, is_adversarial, count(*) AS n, sum(len(w) - floor(len(w) * budget / 100))::BIGINT AS left_words FROM m GROUP BY ALL""")
def mutation_budgets(spark, sf_dir):
    """Words that each budget of mutations leaves."""
    rows = prep.attack_corpus(table(spark, sf_dir, "documents")).select("is_adversarial", F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("n"), F.explode(F.array(F.lit(0), F.lit(50))).alias("budget"))
    return rows.groupBy("budget", "is_adversarial").agg(F.count("*").alias("n"), F.sum(F.col("n") - F.floor(F.col("n") * F.col("budget") / 100)).alias("left_words")).select("budget", "is_adversarial", "n", "left_words")


@query()
def mutation_curve(spark, sf_dir):
    """F1 of the keyword detector when a share of the words is replaced."""
    from docprism.operators import detect

    scored = detect.keyword_budgets(prep.attack_corpus(table(spark, sf_dir, "documents")), "source_id", (0, 25, 50))
    scored = scored.select("budget", F.col("is_adversarial").alias("label"), (F.col("keyword_score") > 0.02).cast("int").alias("predicted"))
    return ev.confusion(scored, ["budget"], zero=True)


@query(f"""WITH {fx.OBSERVATIONS}, u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, arm) AS c FROM obs), r AS (SELECT unnest([CASE WHEN NOT (latency_ms >= 5) THEN 'latency' END, CASE WHEN c <> 1 THEN 'unique' END, CASE WHEN NOT (ranking_score IS NULL OR ranking_score <= 0.9) THEN 'score' END, CASE WHEN (state = 'completed') <> (attack_success IS NOT NULL) AND label = 1 THEN 'outcome' END]) AS rule FROM u)
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY rule""")
def observation_contract(spark, sf_dir):
    """Violations of a contract with deliberately narrow ranges."""
    rules = {"latency": F.col("latency_ms") >= 5, "unique": validate.unique_by(["doc_id", "arm"]), "score": F.col("ranking_score").isNull() | (F.col("ranking_score") <= 0.9), "outcome": ((F.col("state") == "completed") == F.col("attack_success").isNotNull()) | (F.col("label") == 0)}
    return validate.violations(fx.observations(spark, sf_dir), "doc_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.CASES}, w AS (SELECT case_id, arm, CASE WHEN case_id % 60 = 1 THEN 'odd' ELSE status END AS status, CASE WHEN case_id % 60 = 2 THEN NULL WHEN case_id % 60 = 3 THEN false ELSE flagged END AS flagged FROM cases UNION ALL SELECT case_id, arm, status, flagged FROM cases WHERE case_id % 60 = 4),
u AS (SELECT *, count(*) OVER (PARTITION BY case_id, arm) AS c FROM w)
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN c <> 1 THEN 'unique' END, CASE WHEN status NOT IN ('complete', 'partial', 'error') THEN 'status' END, CASE WHEN status = 'complete' AND flagged IS NULL THEN 'complete_known' END, CASE WHEN status <> 'complete' AND flagged IS NOT NULL AND NOT flagged THEN 'incomplete_unknown' END]) AS rule FROM u) WHERE rule IS NOT NULL GROUP BY rule""")
def case_contract(spark, sf_dir):
    """Violations of the contract of challenge cases, in cases of which some are broken on purpose."""
    rows, at = fx.cases(spark, sf_dir).select("case_id", "arm", "status", "flagged"), F.col("case_id") % 60
    broken = rows.withColumns({"status": F.when(at == 1, "odd").otherwise(F.col("status")), "flagged": F.when(at == 2, F.lit(None)).when(at == 3, F.lit(False)).otherwise(F.col("flagged"))}).unionByName(rows.where(at == 4))
    return validate.violations(broken, "case_id", validate.case_rules()).groupBy("rule").agg(F.count("*").alias("n"))


_OBS_RULES = {
    "unique": "c = 1", "arm": "arm IN ('baseline', 'protected')", "state": "state IN ('completed', 'held', 'error')", "label": "label IN (0, 1)", "score_range": "ranking_score IS NULL OR ranking_score BETWEEN 0 AND 100",
    "latency": "latency_ms >= 0", "outcome_fits": "(state = 'completed') = (attack_success IS NOT NULL)", "baseline_not_held": "arm <> 'baseline' OR state <> 'held'", "reference_clean": "NOT is_reference OR label = 0",
}


@query(f"""WITH {fx.OBSERVATIONS}, w AS (SELECT * REPLACE (CASE WHEN doc_id % 70 = 1 THEN 'third' ELSE arm END AS arm, CASE WHEN doc_id % 70 = 2 THEN 'lost' WHEN doc_id % 70 = 3 THEN 'held' ELSE state END AS state, CASE WHEN doc_id % 70 = 4 THEN 2 ELSE label END AS label, CASE WHEN doc_id % 70 = 5 THEN 101.0::DOUBLE ELSE ranking_score END AS ranking_score,
 CASE WHEN doc_id % 70 = 6 THEN -1.0::DOUBLE ELSE latency_ms END AS latency_ms) FROM obs), u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, arm) AS c FROM w)
SELECT rule, count(*) AS n FROM (SELECT unnest([{", ".join(f"CASE WHEN NOT coalesce({test}, false) THEN '{rule}' END" for rule, test in _OBS_RULES.items())}]) AS rule FROM u) WHERE rule IS NOT NULL GROUP BY rule""")
def observation_rules(spark, sf_dir):
    """Violations of the contract of observations, in observations of which some are broken on purpose."""
    at, c = F.col("doc_id") % 70, F.col
    rows = fx.observations(spark, sf_dir).withColumns({
        "arm": F.when(at == 1, "third").otherwise(c("arm")), "state": F.when(at == 2, "lost").when(at == 3, "held").otherwise(c("state")), "label": F.when(at == 4, 2).otherwise(c("label")),
        "ranking_score": F.when(at == 5, 101.0).otherwise(c("ranking_score")), "latency_ms": F.when(at == 6, -1.0).otherwise(c("latency_ms")),
    })
    return validate.violations(rows, "doc_id", validate.observation_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length(text) > 10000 THEN 'not_too_long' ELSE 'has_text' END AS rule, count(*) AS n FROM documents WHERE length(text) > 10000 OR trim(coalesce(text, '')) = '' GROUP BY 1")
def document_contract(spark, sf_dir):
    return validate.violations(table(spark, sf_dir, "documents"), "doc_id", validate.document_rules(10_000)).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def history_latest(spark, sf_dir):
    """The newest rows, a top-k report."""
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).select("event_id", "user_id", "event_type").limit(50)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE lower(event_type) LIKE '%c%' OR lower(props) LIKE '%3%' GROUP BY event_type")
def history_search(spark, sf_dir):
    """Substring search over several columns, whatever the case."""
    hit = F.lower("event_type").contains("c") | F.lower("props").contains("3")
    return table(spark, sf_dir, "events").where(hit).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (value > 50) AS flagged, count(*) FILTER (value <= 50) AS clean FROM events GROUP BY user_id")
def user_submissions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("flagged"), F.count_if(F.col("value") <= 50).alias("clean"))


BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{str(b).replace('.', '_')}" for b in BOUNDS) + ", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def latency_histogram(spark, sf_dir):
    return windows.latency(table(spark, sf_dir, "events"), BOUNDS)


@query("SELECT time_bucket(INTERVAL '60 seconds', ts::TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY 1")
def request_windows(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > DATE '1998-01-01'")
def session_lookup(spark, sf_dir):
    """Rows of live sessions with their owners: an equi-join after the expiry filter."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") > F.lit("1998-01-01").cast("date"))
    c = table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query(f"""WITH {fx.TRACES}, k AS (SELECT *, concat_ws(',', CASE WHEN invisible THEN 'invisible' END, CASE WHEN no_area THEN 'no_area' END, CASE WHEN off_page THEN 'off_page' END, CASE WHEN hidden_layer THEN 'hidden_layer' END, CASE WHEN tiny THEN 'tiny' END, CASE WHEN white THEN 'white' END) AS key FROM flags)
SELECT doc_id, key, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM k WHERE key <> '' GROUP BY doc_id, key""")
def finding_groups(spark, sf_dir):
    """Findings grouped by what they say, with the union of their boxes."""
    from docprism.operators import detect

    flags = detect.trace_flags(*fx.traces(spark, sf_dir))
    key = F.concat_ws(",", *[F.when(F.col(f), F.lit(f)) for f in detect.FLAGS])
    return flags.withColumn("key", key).where("key <> ''").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
