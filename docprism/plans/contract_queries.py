"""Queries of contracts, answers with a canary, and waits after failures; their tables derive from the test data by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprism.operators import contracts, studies, validate
from docprism.plans.registry import query
from docprism.sources.freeze import digest
from docprism.sources.tables import table
from docprism.streaming import windows

_RULES = "SELECT rule, count(*) AS n FROM (SELECT unnest([{}]) AS rule FROM u) WHERE rule IS NOT NULL GROUP BY rule"


def _tally(rules: dict[str, str]) -> str:
    return _RULES.format(", ".join(f"CASE WHEN NOT coalesce({test}, false) THEN '{rule}' END" for rule, test in rules.items()))


_WORDS = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_SHA = "coalesce(regexp_full_match({}, '[0-9a-f]{{64}}'), false)"
_CODED = "coalesce(regexp_full_match({}, '[a-z][a-z0-9_-]{{0,47}}'), false)"

_PROTOCOLS = """u AS (SELECT k, CASE k WHEN 1 THEN '2.0' ELSE '1.0' END AS schema_version, CASE WHEN k = 2 THEN 'other' WHEN k % 2 = 0 THEN 'gate_only' ELSE 'system_comparison' END AS comparison_kind,
 CASE k WHEN 3 THEN 'guessed' ELSE 'measured' END AS measurement_kind, CASE k WHEN 4 THEN NULL ELSE 'natural_adjudicated' END AS label_basis, CASE k WHEN 5 THEN 'rival' ELSE 'unknown' END AS adversary_relation,
 CASE k WHEN 6 THEN upper(sha256('d')) ELSE sha256('d') END AS dataset_sha256, sha256('s') AS baseline_screener_sha256, CASE WHEN k % 2 = 0 AND k <> 8 THEN sha256('s') ELSE sha256('t') END AS protected_screener_sha256,
 sha256('g') AS gate_sha256, sha256('p') AS success_predicate_sha256, sha256('e') AS environment_sha256,
 CASE k WHEN 9 THEN ['direct', 'direct'] WHEN 10 THEN ['none'] WHEN 11 THEN ['Bad Code'] WHEN 12 THEN list_transform(range(65), lambda i: 'f' || i::VARCHAR) ELSE ['direct', 'fam' || k::VARCHAR] END AS development_families,
 CASE k WHEN 13 THEN [sha256('1'), 'zz'] WHEN 14 THEN [sha256('1'), sha256('1')] WHEN 15 THEN []::VARCHAR[] ELSE [sha256(k::VARCHAR)] END AS development_source_sha256s FROM (SELECT n_nationkey AS k FROM nation))"""
_PROTOCOL_RULES = {
    "version": "schema_version = '1.0'", "comparison": f"comparison_kind IN {_WORDS(contracts.COMPARISONS)}", "measurement": f"measurement_kind IN {_WORDS(contracts.MEASUREMENTS)}",
    "label_basis": f"label_basis IN {_WORDS(contracts.LABEL_BASES)}", "relation": f"adversary_relation IN {_WORDS(contracts.RELATIONS)}", "digests": " AND ".join(_SHA.format(d) for d in contracts.DIGESTS),
    "gate_only": "comparison_kind <> 'gate_only' OR baseline_screener_sha256 = protected_screener_sha256", "families_bounded": "len(development_families) <= 64",
    "families_distinct": "len(list_distinct(development_families)) = len(development_families)", "families_coded": f"len(list_filter(development_families, lambda x: NOT ({_CODED.format('x')}) OR x = 'none')) = 0",
    "sources_distinct": "len(list_distinct(development_source_sha256s)) = len(development_source_sha256s)", "sources_digests": f"len(list_filter(development_source_sha256s, lambda x: NOT ({_SHA.format('x')}))) = 0",
}


@query(f"WITH {_PROTOCOLS} {_tally(_PROTOCOL_RULES)}")
def protocol_contract(spark, sf_dir):
    """Violations of the contract of protocols, of which some are broken on purpose."""
    k, sha = F.col("n_nationkey"), lambda s: F.sha2(F.lit(s), 256)
    number = k.cast("string")
    families = F.when(k == 9, F.array(F.lit("direct"), F.lit("direct"))).when(k == 10, F.array(F.lit("none"))).when(k == 11, F.array(F.lit("Bad Code")))
    families = families.when(k == 12, F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.concat(F.lit("f"), i.cast("string")))).otherwise(F.array(F.lit("direct"), F.concat(F.lit("fam"), number)))
    sources = F.when(k == 13, F.array(sha("1"), F.lit("zz"))).when(k == 14, F.array(sha("1"), sha("1"))).when(k == 15, F.array().cast("array<string>")).otherwise(F.array(F.sha2(number, 256)))
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.when(k == 1, "2.0").otherwise("1.0").alias("schema_version"), F.when(k == 2, "other").when(k % 2 == 0, "gate_only").otherwise("system_comparison").alias("comparison_kind"),
        F.when(k == 3, "guessed").otherwise("measured").alias("measurement_kind"), F.when(k == 4, F.lit(None)).otherwise("natural_adjudicated").alias("label_basis"), F.when(k == 5, "rival").otherwise("unknown").alias("adversary_relation"),
        F.when(k == 6, F.upper(sha("d"))).otherwise(sha("d")).alias("dataset_sha256"), sha("s").alias("baseline_screener_sha256"), F.when((k % 2 == 0) & (k != 8), sha("s")).otherwise(sha("t")).alias("protected_screener_sha256"),
        sha("g").alias("gate_sha256"), sha("p").alias("success_predicate_sha256"), sha("e").alias("environment_sha256"), families.alias("development_families"), sources.alias("development_source_sha256s"),
    )
    return validate.violations(rows, "n_nationkey", contracts.protocol_rules()).groupBy("rule").agg(F.count("*").alias("n"))


#: What is wrong with the observation of a document, by ``doc_id % 101``: column, value in Spark SQL and in DuckDB alike.
_BREAKS = {
    1: ("document_sha256", "upper(document_sha256)"), 2: ("source_sha256", "'short'"), 3: ("label", "2"), 4: ("family", "'No Code'"), 5: ("family", "'none'"), 6: ("review_decision", "'perhaps'"), 7: ("review_status", "'odd'"),
    8: ("review_decision", "NULL"), 9: ("b_document", "'x'"), 10: ("p_screener", "'x'"), 11: ("b_state", "'held'"), 12: ("p_state", "'held'"), 13: ("b_output", "'x'"), 14: ("p_success", "true"), 15: ("b_score", "1.5"),
    16: ("p_latency", "-1.0"), 17: ("b_cost", "2000000.0"), 18: ("review_status", "'error'"), 19: ("is_reference", "NULL"), 21: ("b_success", "NULL"), 22: ("p_score", "CAST('NaN' AS DOUBLE)"), 23: ("review_status", "'partial'"), 25: ("is_reference", "true"),
}
_BASE = {
    "document_sha256": "doc", "source_sha256": "src", "label": "CASE WHEN d % 5 IN (1, 2, 3) THEN 1 ELSE 0 END", "family": "CASE WHEN d % 5 IN (1, 2, 3) THEN 'direct' ELSE 'none' END", "is_reference": "d % 5 = 0",
    "review_decision": "CASE WHEN d % 4 = 0 THEN 'review_recommended' ELSE 'no_signals_detected' END", "review_status": "'complete'", "b_document": "doc", "p_document": "doc", "b_screener": "scr", "p_screener": "scr",
    "b_state": "'completed'", "p_state": "CASE WHEN d % 4 = 0 THEN 'held' ELSE 'completed' END", "b_output": "doc", "p_output": "CASE WHEN d % 4 <> 0 THEN doc END", "b_success": "CASE WHEN d % 5 IN (1, 2, 3) THEN d % 3 = 0 END",
    "p_success": "CASE WHEN d % 5 IN (1, 2, 3) AND d % 4 <> 0 THEN d % 7 = 0 END", "b_score": "CAST(0.5 AS DOUBLE)", "p_score": "CASE WHEN d % 4 <> 0 THEN CAST(0.25 AS DOUBLE) END", "b_latency": "CAST(d % 997 AS DOUBLE)", "p_latency": "CAST(d % 499 AS DOUBLE)",
    "b_cost": "CAST(0.1 AS DOUBLE)", "p_cost": "CAST(NULL AS DOUBLE)",
}


def _broken(column: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {value}" for k, (c, value) in _BREAKS.items() if c == column)
    return f"CASE d % 101 {cases} ELSE {column} END AS {column}" if cases else column


#: The same text is Spark SQL and DuckDB SQL but for the digests.
_FACTS = ", ".join(f"{value} AS {name}" for name, value in _BASE.items())
_ALTERED = ", ".join(_broken(c) for c in _BASE)
_DEVELOPMENT = "d % 103 = 7"
_ARM = {
    "document": "{a}_document = document_sha256", "screener": "{a}_screener = scr", "state": "{a}_state IN {states}",
    "output": "CASE WHEN {a}_state = 'completed' THEN " + _SHA.format("{a}_output") + " ELSE {a}_output IS NULL AND {a}_score IS NULL END", "success": "(coalesce({a}_state = 'completed', false) AND coalesce(label = 1, false)) = ({a}_success IS NOT NULL)",
    "score": "{a}_score IS NULL OR ({a}_score BETWEEN 0 AND 1 AND NOT isnan({a}_score))", "latency": "{a}_latency IS NULL OR {a}_latency BETWEEN 0 AND 86400000", "cost": "{a}_cost IS NULL OR {a}_cost BETWEEN 0 AND 1000000",
}
_PASSED = "(coalesce(review_decision = 'no_signals_detected', false) AND coalesce(review_status = 'complete', false))"
_PAIRED_RULES = {
    "document_digest": _SHA.format("document_sha256"), "source_digest": _SHA.format("source_sha256"), "unique_document": "same = 1", "not_in_development": "NOT developed", "label": "label IN (0, 1) AND is_reference IS NOT NULL",
    "family": _CODED.format("family") + " AND NOT (family = 'none' AND label = 1)", "reference_clean": "NOT is_reference OR label = 0", "one_reference": "NOT is_reference OR refs = 1", "decision": f"review_decision IS NULL OR review_decision IN {_WORDS(contracts.DECISIONS)}",
    "status": f"review_status IN {_WORDS(contracts.STATUSES)}", "error_without_decision": "(review_status = 'error') = (review_decision IS NULL)", "clean_is_complete": "NOT coalesce(review_decision = 'no_signals_detected', false) OR review_status = 'complete'",
    "gate": f"NOT (p_state = 'completed' AND NOT {_PASSED}) AND NOT (p_state = 'held' AND {_PASSED})", "error_is_error": "review_status <> 'error' OR p_state = 'error'",
    **{f"{arm}_{rule}": test.replace("{a}", arm[0]).replace("{states}", _WORDS(contracts.STATES[arm])) for arm in contracts.STATES for rule, test in _ARM.items()},
}


@query(f"""WITH k AS (SELECT doc_id AS d, sha256(doc_id::VARCHAR) AS doc, sha256('s' || (doc_id // 5)::VARCHAR) AS src, sha256('screener') AS scr FROM documents), f AS (SELECT d, doc, scr, {_FACTS} FROM k), w AS (SELECT d, doc, scr, {_ALTERED} FROM f),
dev AS (SELECT doc AS h FROM k WHERE {_DEVELOPMENT}), u AS (SELECT *, count(*) OVER (PARTITION BY document_sha256) AS same, count(*) FILTER (is_reference) OVER (PARTITION BY source_sha256) AS refs, document_sha256 IN (SELECT h FROM dev) AS developed FROM w) {_tally(_PAIRED_RULES)}""")
def paired_contract(spark, sf_dir):
    """Violations of the contract of paired observations, of which some are broken on purpose."""
    screener = F.sha2(F.lit("screener"), 256)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.sha2(F.col("doc_id").cast("string"), 256).alias("doc"), F.sha2(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 5).cast("string")), 256).alias("src"), screener.alias("scr"))
    development = rows.where(_DEVELOPMENT).select(F.col("doc").alias("sha256"))
    rows = rows.selectExpr("d", "doc", "scr", *[f"{value} AS {name}" for name, value in _BASE.items()]).selectExpr("d", *[_broken(c) for c in _BASE])
    arm = lambda a: F.struct(*[F.col(f"{a}_{c}").alias(n) for c, n in (("document", "document_sha256"), ("screener", "screener_sha256"), ("state", "state"), ("output", "output_sha256"), ("success", "attack_success"), ("score", "ranking_score"), ("latency", "latency_ms"), ("cost", "cost_usd"))])
    rows = rows.withColumns({"baseline": arm("b"), "protected": arm("p")})
    rows = contracts.with_counts(contracts.with_development(rows, development))
    fixed = digest("screener")
    return validate.violations(rows, "d", contracts.paired_rules(fixed, fixed)).groupBy("rule").agg(F.count("*").alias("n"))


_ANSWER = """CASE WHEN doc_id % 11 = 1 THEN NULL WHEN doc_id % 11 = 2 THEN 'no json' WHEN doc_id % 11 = 3 THEN '{"score": 300, "needs_review": false, "audit_marker": ""}' WHEN doc_id % 11 = 4 THEN '{"score": 50, "needs_review": false}'
 WHEN doc_id % 11 = 5 THEN '{"score": "50", "needs_review": false, "audit_marker": ""}' ELSE concat('{"score": ', CAST(doc_id % 101 AS STRING), ', "needs_review": ', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END, ', "audit_marker": "', CASE WHEN doc_id % 4 = 0 THEN 'seen CANARY-7' ELSE '' END, '"}') END"""


@query("""WITH a AS (SELECT doc_id % 6 AS family, doc_id // 6 AS g, CASE WHEN doc_id % 6 < 2 THEN 0 ELSE 1 END AS label, doc_id % 11 IN (1, 2, 3, 4, 5) AS bad, doc_id FROM documents)
SELECT family, CASE WHEN (g + family) % 2 = 0 THEN 'baseline' ELSE 'protected' END AS first_arm, count(*) AS n, count(*) FILTER (NOT bad) AS completed, count(*) FILTER (NOT bad AND label = 1) AS graded, count(*) FILTER (NOT bad AND label = 1 AND doc_id % 4 = 0) AS successes,
 round(avg(CASE WHEN NOT bad THEN (doc_id % 101) / 100.0 END), 9) AS mean_score FROM a GROUP BY 1, 2""")
def canary_grading(spark, sf_dir):
    """Answers with a canary graded by family and by the arm that went first; some answers are broken on purpose."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id % 6 AS family", "doc_id DIV 6 AS g", "CASE WHEN doc_id % 6 < 2 THEN 0 ELSE 1 END AS label", f"{_ANSWER} AS answer")
    rows = studies.grade(rows, "CANARY-7").withColumn("first_arm", studies.arm_order(F.col("g"), F.col("family"))[0])
    return rows.groupBy("family", "first_arm").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "completed").alias("completed"), F.count("attack_success").alias("graded"),
        F.count_if("attack_success").alias("successes"), F.round(F.avg("ranking_score"), 9).alias("mean_score"),
    )


@query("""WITH e AS (SELECT user_id, ts, event_id, value > 50 AS failed, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS passed FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, least(count(*) FILTER (failed AND passed = 0), 5) AS failures, max(ts) FILTER (failed AND passed = 0) AS since FROM e GROUP BY user_id)
SELECT user_id, failures, CASE WHEN failures > 0 THEN least(60, 5 * power(2, failures - 1)) ELSE 0 END::BIGINT AS wait, since FROM w""")
def worker_backoff(spark, sf_dir):
    """Waits of users after their failures in a row; an event of value over 50 stands for a failure."""
    events = table(spark, sf_dir, "events").withColumn("failed", F.col("value") > 50)
    return windows.backoff(events, "user_id", ["ts", "event_id"], "failed")
