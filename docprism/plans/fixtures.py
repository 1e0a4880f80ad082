"""Tables that the test data lack, derived from it by integer rules; each has the same rule as SQL.

They stand for what other systems would supply: text traces of pages, paired
observations of two arms, and challenge cases with tri-state flags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docprism.sources.tables import table

FAMILIES = ("reference", "direct", "encoded", "look_alike", "benign")


def _pick(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _names(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: doc_id, arm, source_id, family, label, is_reference, review, state, attack_success, ranking_score, latency_ms, cost
OBSERVATIONS = f"""obs AS (SELECT doc_id, arm, floor(doc_id / 5)::BIGINT AS source_id, {_names(FAMILIES)}[(doc_id % 5 + 1)::INT] AS family,
 CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 1 ELSE 0 END AS label, doc_id % 5 = 0 AS is_reference, doc_id * 7 % 4 = 0 AS review, state,
 CASE WHEN doc_id % 5 IN (1, 2, 3) AND state = 'completed' THEN (doc_id * 13 + k * 5) % 3 = 0 END AS attack_success,
 CASE WHEN state = 'completed' THEN (doc_id * 37 + k * 11) % 101 / 100.0::DOUBLE END AS ranking_score, ((doc_id * 53 + k * 17) % 997)::DOUBLE AS latency_ms, ((doc_id * 3 + k) % 50 / 100.0)::DOUBLE AS cost
 FROM (SELECT doc_id, k, ['baseline', 'protected'][k + 1] AS arm, CASE WHEN (doc_id * 7 + k * 3) % 11 = 0 THEN 'error' WHEN k = 1 AND doc_id * 7 % 4 = 0 THEN 'held' ELSE 'completed' END AS state
 FROM (SELECT doc_id, unnest([0, 1]) AS k FROM documents)))"""


def observations(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("k")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    state = F.when((d * 7 + k * 3) % 11 == 0, "error").when((k == 1) & (d * 7 % 4 == 0), "held").otherwise("completed")
    attack = (d % 5).isin(1, 2, 3)
    rows = rows.withColumn("arm", _pick(("baseline", "protected"), k)).withColumn("state", state)
    done = F.col("state") == "completed"
    return rows.select(
        "doc_id", "arm", F.floor(d / 5).cast("long").alias("source_id"), _pick(FAMILIES, d % 5).alias("family"), attack.cast("int").alias("label"), (d % 5 == 0).alias("is_reference"), (d * 7 % 4 == 0).alias("review"), "state",
        F.when(attack & done, (d * 13 + k * 5) % 3 == 0).alias("attack_success"), F.when(done, (d * 37 + k * 11) % 101 / F.lit(100.0)).alias("ranking_score"),
        ((d * 53 + k * 17) % 997).cast("double").alias("latency_ms"), ((d * 3 + k) % 50 / F.lit(100.0)).alias("cost"),
    )


ARMS = ("full_policy", "cue", "repetition", "model")
#: case_id, arm, source_group, family, added_attack, status, flagged
CASES = f"""cases AS (SELECT case_id, arm, source_group, family, added_attack, status, CASE WHEN status = 'error' THEN NULL WHEN status = 'partial' AND NOT f THEN NULL ELSE f END AS flagged FROM (
 SELECT doc_id AS case_id, {_names(ARMS)}[k + 1] AS arm, doc_id % 40 AS source_group, {_names(FAMILIES)}[(doc_id % 5 + 1)::INT] AS family, doc_id % 5 IN (1, 2, 3) AS added_attack,
 CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'partial' ELSE 'complete' END AS status,
 CASE WHEN doc_id % 5 IN (1, 2, 3) THEN (doc_id * 11 + k * 7) % (k + 2) = 0 ELSE k = 3 AND doc_id % 29 = 0 END AS f FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS k FROM documents)))"""


def cases(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("k")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    attack = (d % 5).isin(1, 2, 3)
    status = F.when(d % 17 == 0, "error").when(d % 13 == 0, "partial").otherwise("complete")
    f = F.when(attack, (d * 11 + k * 7) % (k + 2) == 0).otherwise((k == 3) & (d % 29 == 0))
    rows = rows.select(d.alias("case_id"), _pick(ARMS, k).alias("arm"), (d % 40).alias("source_group"), _pick(FAMILIES, d % 5).alias("family"), attack.alias("added_attack"), status.alias("status"), f.alias("f"))
    return rows.withColumn("flagged", F.when(F.col("status") == "error", F.lit(None)).when((F.col("status") == "partial") & ~F.col("f"), F.lit(None)).otherwise(F.col("f"))).drop("f")


#: doc_id, page, trace_idx, x0, y0, x1, y1, size, render_type, opacity, color, layer; six traces a document
TRACES = """traces AS (SELECT doc_id, (k % 2)::INT AS page, k AS trace_idx, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + w)::DOUBLE AS x1, (y0 + 10)::DOUBLE AS y1, CASE WHEN (doc_id + k) % 19 = 0 THEN 1.0 ELSE 9.5 END::DOUBLE AS size,
 CASE WHEN (doc_id * 3 + k) % 23 = 0 THEN 3 ELSE 0 END AS render_type, CASE WHEN (doc_id * 5 + k) % 29 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS opacity,
 CASE WHEN (doc_id + k * 7) % 11 = 0 THEN [1.0, 1.0, 1.0] ELSE [0.1, 0.1, 0.1] END::DOUBLE[] AS color, 'layer' || (k % 3)::VARCHAR AS layer
 FROM (SELECT doc_id, k, (doc_id * 31 + k * 57) % 640 AS x0, (doc_id * 17 + k * 91) % 820 AS y0, CASE WHEN (doc_id + k) % 31 = 0 THEN 0 ELSE 60 END AS w FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5]) AS k FROM documents))),
 off AS (SELECT doc_id, 'layer1' AS layer FROM documents WHERE doc_id % 9 = 0),
 flags AS (SELECT t.doc_id, page, trace_idx, x0, y0, x1, y1,
  (render_type = 3 OR opacity = 0) AND NOT img AS invisible, (x1 - x0) * (y1 - y0) <= 0.01 AS no_area, x1 <= 0 OR x0 >= 600 OR y1 <= 0 OR y0 >= 800 AS off_page, o.layer IS NOT NULL AS hidden_layer, size <= 1.5 AS tiny,
  color[1] > 0.95 AND NOT img AND NOT dark AS white FROM (SELECT *, (100 <= x0 AND 100 <= y0 AND 300 >= x1 AND 300 >= y1) AS img, (0 <= x0 AND 400 <= y0 AND 600 >= x1 AND 500 >= y1) AND doc_id % 2 = 0 AS dark FROM traces) t
  LEFT JOIN off o ON t.doc_id = o.doc_id AND t.layer = o.layer)"""


def traces(spark, sf_dir):
    """Traces, pages and layers."""
    d, k = F.col("doc_id"), F.col("k")
    base = table(spark, sf_dir, "documents").select("doc_id")
    rows = base.select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("k"))
    x0, y0, w = (d * 31 + k * 57) % 640, (d * 17 + k * 91) % 820, F.when((d + k) % 31 == 0, 0).otherwise(60)
    light = F.array(*[F.lit(1.0)] * 3)
    found = rows.select(
        "doc_id", (k % 2).cast("int").alias("page"), k.alias("trace_idx"), *[c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x0 + w), ("y1", y0 + 10))],
        F.when((d + k) % 19 == 0, 1.0).otherwise(9.5).alias("size"), F.when((d * 3 + k) % 23 == 0, 3).otherwise(0).alias("render_type"), F.when((d * 5 + k) % 29 == 0, 0.0).otherwise(1.0).alias("opacity"),
        F.when((d + k * 7) % 11 == 0, light).otherwise(F.array(*[F.lit(0.1)] * 3)).alias("color"), F.concat(F.lit("layer"), (k % 3).cast("string")).alias("layer"),
    )
    box = lambda a, b, c, e: F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"), F.lit(float(c)).alias("x1"), F.lit(float(e)).alias("y1"))
    fill = F.struct(F.lit(0.0).alias("x0"), F.lit(400.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(500.0).alias("y1"), (d % 2 == 0).alias("dark"))
    pages = base.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page")).select("doc_id", "page", F.lit(0.0).alias("px0"), F.lit(0.0).alias("py0"), F.lit(600.0).alias("px1"), F.lit(800.0).alias("py1"), F.array(box(100, 100, 300, 300)).alias("images"), F.array(fill).alias("fills"))
    layers = base.select("doc_id", F.lit("layer1").alias("layer"), (d % 9 != 0).alias("is_on"))
    return found, pages, layers


#: Features and states from which the policy decides.
VERDICT_ROWS = """inputs AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'text' ELSE 'pdf' END AS input_mode, doc_id % 10 = 3 AS repetition, CASE WHEN doc_id % 8 = 5 THEN 2 ELSE 0 END AS cue_count,
 (doc_id % 100) / 100.0::DOUBLE AS a, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS b, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 13) / 13.0::DOUBLE END AS c,
 doc_id % 12 = 1 AS forced_partial, doc_id % 14 = 2 AS semantic_truncated, 'ok' AS a_status, CASE WHEN doc_id % 4 = 0 THEN 'not_applicable' ELSE 'ok' END AS b_status, CASE WHEN doc_id % 7 = 0 THEN 'unsupported' ELSE 'ok' END AS c_status,
 doc_id % 100 > 90 AS a_flagged, coalesce((doc_id % 11) / 10.0 >= 0.5 AND doc_id % 4 <> 0, false) AS b_flagged FROM documents)"""


def verdict_rows(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 4 == 0, "text").otherwise("pdf").alias("input_mode"), (d % 10 == 3).alias("repetition"), F.when(d % 8 == 5, 2).otherwise(0).alias("cue_count"),
        ((d % 100) / F.lit(100.0)).alias("a"), F.when(d % 4 != 0, (d % 11) / F.lit(10.0)).alias("b"), F.when(d % 7 != 0, (d % 13) / F.lit(13.0)).alias("c"),
        (d % 12 == 1).alias("forced_partial"), (d % 14 == 2).alias("semantic_truncated"), F.lit("ok").alias("a_status"), F.when(d % 4 == 0, "not_applicable").otherwise("ok").alias("b_status"), F.when(d % 7 == 0, "unsupported").otherwise("ok").alias("c_status"),
        (d % 100 > 90).alias("a_flagged"), (((d % 11) / F.lit(10.0) >= 0.5) & (d % 4 != 0)).alias("b_flagged"),
    )
