"""Queries of the detectors and of the review policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from docprism.operators import detect, encode, evaluate, policy, prep, validate
from docprism.plans import fixtures as fx
from docprism.plans.prep_queries import CORPUS, KW, corpus
from docprism.plans.registry import query
from docprism.plans.text_queries import docs, toks
from docprism.sources.tables import table

ALIASED = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '(?i)\bstructured[ \t\n\r\f\v]+query[ \t\n\r\f\v]+language\b', 'sql', 'g'), '(?i)\bpy[ \t\n\r\f\v]+spark\b', 'spark', 'g'), '(?i)\bk8s\b', 'kubernetes', 'g')"
PATTERN = r"\b(" + "|".join(sorted(prep.SKILLS)) + r")\b"
KEYWORDS = f"""kw AS (SELECT source_id, attack_type, is_adversarial, len(w) AS n_words, coalesce(len(regexp_extract_all(array_to_string(w, ' '), '{PATTERN}')), 0) AS hits,
  list_filter(list_transform(range(0, len(w)), lambda i: CASE WHEN regexp_matches(w[i + 1], '{PATTERN}') THEN i END), lambda i: i IS NOT NULL) AS hit_at
  FROM (SELECT source_id, attack_type, is_adversarial, {toks(ALIASED)} AS w FROM corpus)),
scored AS (SELECT source_id, attack_type, is_adversarial, n_words, hits, CASE WHEN hits > 3 AND (list_max(hit_at) - list_min(hit_at)) / (hits - 1) < n_words / 20 THEN 1 - (list_max(hit_at) - list_min(hit_at)) / (hits - 1) / (n_words / 20) ELSE 0 END AS concentration FROM kw),
keyed AS (SELECT *, coalesce(hits / nullif(n_words, 0), 0) + 0.05 * concentration AS keyword_score FROM scored)"""


def keyed(spark, sf_dir):
    return detect.keyword_measures(corpus(spark, sf_dir))


@query(f"WITH {CORPUS}, {KEYWORDS} SELECT source_id, attack_type, n_words, hits, round(concentration, 9) AS concentration, round(keyword_score, 9) AS keyword_score FROM keyed")
def keyword_density(spark, sf_dir):
    return keyed(spark, sf_dir).select("source_id", "attack_type", "n_words", "hits", F.round("concentration", 9).alias("concentration"), F.round("keyword_score", 9).alias("keyword_score"))


@query(f"""WITH {CORPUS}, {KEYWORDS} SELECT round(quantile_cont(CASE WHEN is_adversarial = 0 THEN keyword_score END, 0.95), 9) AS threshold,
 count(*) FILTER (is_adversarial NOT IN (0, 1) OR is_adversarial IS NULL) AS bad_labels, count(DISTINCT is_adversarial) AS n_classes FROM keyed""")
def keyword_p95_threshold(spark, sf_dir):
    return detect.p95_of_clean(keyed(spark, sf_dir), "keyword_score").withColumn("threshold", F.round("threshold", 9))


@query(f"WITH {CORPUS}, {KEYWORDS} SELECT attack_type, count(*) AS n, count(*) FILTER (keyword_score > 0.02) AS flagged, round(avg(least(1.0, keyword_score / 0.04)), 6) AS anomaly FROM keyed GROUP BY attack_type")
def keyword_flags(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return rows.groupBy("attack_type").agg(F.count("*").alias("n"), F.count_if(F.col("keyword_score") > 0.02).alias("flagged"), F.round(F.avg(detect.anomaly(F.col("keyword_score"), 0.02)), 6).alias("anomaly"))


def repetition_sql(more: str = "''") -> str:
    """The gate as SQL, over the corpus with ``more`` behind each text."""
    return f"""tok AS (SELECT key, pos, list_contains({KW}, tok) AS s, tok FROM (SELECT source_id || attack_type AS key, unnest(t) AS tok, unnest(range(0, len(t))) AS pos FROM (SELECT *, regexp_extract_all(lower(text || {more}), '[a-z0-9_+#.]*[a-z0-9_+#]') AS t FROM corpus))),
cum AS (SELECT *, sum(s::INT) OVER (PARTITION BY key ORDER BY pos) AS skills FROM tok),
wide AS (SELECT *, {", ".join(f"lag(tok, {w}) OVER o AS t{w}, coalesce(lag(skills, {w}) OVER o, 0) AS s{w}" for w in range(1, 13))} FROM cum WINDOW o AS (PARTITION BY key ORDER BY pos)),
per AS ({" UNION ALL ".join(f"SELECT key, pos, {w} AS width, skills - s{w} AS inside FROM wide WHERE tok = t{w}" for w in range(1, 13))}),
runs AS (SELECT key, width, count(*) AS run, min(pos) AS first, max(inside) AS inside FROM (SELECT *, pos - row_number() OVER (PARTITION BY key, width ORDER BY pos) AS island FROM per) GROUP BY key, width, island),
rep AS (SELECT key, width::BIGINT AS width, first::BIGINT AS position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY width, first) AS rn FROM runs WHERE run + width >= greatest(32, 8 * width) AND 2 * inside >= width) WHERE rn = 1)"""


REPETITION = repetition_sql("CASE WHEN source_id % 10 = 0 THEN repeat(' sql spark', 20) ELSE '' END")


def repeated(spark, sf_dir):
    """The gate over the corpus; every tenth source also gets a long run of two skill words."""
    more = F.when(F.col("source_id") % 10 == 0, F.repeat(F.lit(" sql spark"), F.lit(20))).otherwise("")
    rows = corpus(spark, sf_dir).select(F.concat(F.col("source_id").cast("string"), F.col("attack_type")).alias("key"), F.concat("text", more).alias("text"))
    return detect.repetition(rows, "key")


@query(f"WITH {CORPUS}, {REPETITION} SELECT key, width, position FROM rep")
def repetition_gate(spark, sf_dir):
    return repeated(spark, sf_dir)


@query(f"""WITH {CORPUS} SELECT attack_type, count(*) AS n, count(*) FILTER (contains(text, '{prep.BLOCK_START}')) AS hidden, count(*) FILTER (regexp_matches(text, '(?i)previous guidance|earlier instructions|fit score')) AS baseline FROM corpus GROUP BY attack_type""")
def hidden_marker_and_baseline(spark, sf_dir):
    t = F.col("text")
    return corpus(spark, sf_dir).groupBy("attack_type").agg(F.count("*").alias("n"), F.count_if(detect.hidden_block(t) == 1).alias("hidden"), F.count_if(detect.simple_baseline(t)).alias("baseline"))


NATIVE = " + ".join(f"regexp_matches(lower(text), '{p}')::INT" for p in detect.PATTERNS.values())


@query(f"WITH {CORPUS} SELECT source_id, attack_type, ({NATIVE})::BIGINT AS n_cues FROM corpus WHERE ({NATIVE}) > 0")
def cue_hits_native(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("source_id", "attack_type", F.size(detect.native_cues(F.col("text"))).cast("long").alias("n_cues"))
    return rows.where("n_cues > 0")


@query()
def cue_spans(spark, sf_dir):
    """Actionable cues with their places, after folding, decoding and the context rules."""
    rows = corpus(spark, sf_dir).select("source_id", "attack_type", detect.cues(F.col("text")).alias("m"))
    return rows.select("source_id", "attack_type", detect.cue_count(F.col("m")).alias("n_cues"), F.explode(detect.source_spans(F.col("m"))).alias("s")).select("source_id", "attack_type", "n_cues", "s.start", "s.end")


@query(f"WITH {fx.TRACES} SELECT doc_id, page, trace_idx, invisible, no_area, off_page, hidden_layer, tiny, white FROM flags")
def trace_flags(spark, sf_dir):
    return detect.trace_flags(*fx.traces(spark, sf_dir)).select("doc_id", "page", "trace_idx", *detect.FLAGS)


SUMMARY = "flagged AS (SELECT *, invisible OR no_area OR off_page OR hidden_layer OR tiny OR white AS f FROM flags)"


@query(f"""WITH {fx.TRACES}, {SUMMARY} SELECT doc_id, {", ".join(f"count(*) FILTER ({f}) AS n_{f}" for f in detect.FLAGS)}, count(*) FILTER (f) AS n_flagged, count(*) AS n_traces, least(1.0, count(*) FILTER (f) / 10) AS trace_score FROM flagged GROUP BY doc_id""")
def trace_doc_scores(spark, sf_dir):
    return detect.trace_summary(detect.trace_flags(*fx.traces(spark, sf_dir)))


@query()
def trace_clusters(spark, sf_dir):
    """Clusters of flagged traces, merged in the order of the traces."""
    return detect.cluster_traces(detect.trace_flags(*fx.traces(spark, sf_dir)))


@query("""WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
c AS (SELECT label, CASE WHEN prev IS NOT NULL THEN list_cosine_similarity(embedding::DOUBLE[], prev::DOUBLE[]) END AS cos FROM p)
SELECT label AS doc_id, round(coalesce(var_pop(cos), 0), 6) AS variance, round(coalesce(avg(cos), 1), 6) AS mean_similarity, count(cos) AS n_pairs FROM c GROUP BY label""")
def window_coherence(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("w_idx"), "embedding")
    return detect.coherence(rows).withColumns({"variance": F.round("variance", 6), "mean_similarity": F.round("mean_similarity", 6)})


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(substr(text, 1, 20000), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 10) AS s FROM documents)
SELECT doc_id, (i - 1)::INT AS w_idx, md5(s[i] || ' ' || s[i + 1]) AS window_md5 FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS i FROM s)""")
def sentence_windows(spark, sf_dir):
    return detect.sentence_windows(docs(spark, sf_dir)).select("doc_id", "w_idx", F.md5("window").alias("window_md5"))


SENTENCES = r"list_filter(string_split(regexp_replace(substr(text, 1, 20000), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 10)"
DIGIT_SUMS = ", ".join(f"sum(instr('0123456789abcdef', substr(h, {k}, 1)) - 8.5)::DOUBLE" for k in range(1, 33))


@query(f"""WITH s AS (SELECT doc_id, text, {SENTENCES} AS s FROM documents), win AS (SELECT doc_id, unnest(range(1, len(s))) AS i, s FROM s),
w AS (SELECT doc_id, i, md5(unnest(list_filter(string_split(s[i] || ' ' || s[i + 1], ' '), lambda x: x <> ''))) AS h FROM win), v AS (SELECT doc_id, i, [{DIGIT_SUMS}] AS v FROM w GROUP BY doc_id, i),
p AS (SELECT doc_id, list_cosine_similarity(v, lag(v) OVER (PARTITION BY doc_id ORDER BY i)) AS cos FROM v), m AS (SELECT doc_id, var_pop(cos) AS variance, avg(cos) AS mean, count(cos) AS n FROM p GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(variance, 0) AS variance, coalesce(mean, 1) AS mean, coalesce(n, 0) AS n, ({NATIVE}) AS cues FROM s LEFT JOIN m USING (doc_id))
SELECT doc_id, round(variance, 6) AS variance, round(mean, 6) AS mean_similarity, n AS n_pairs, round(least(1.0, variance / 0.04), 5) AS semantic, round(greatest(least(1.0, variance / 0.04), least(1.0, 0.5 * cues)), 5) AS anomaly, (round(variance, 9) > 0.02 OR cues > 0) AS flag FROM c""")
def encoded_coherence(spark, sf_dir):
    """From texts to the fused coherence measure: windows of sentences, vectors of an encoder, cosines, cues."""
    rows = encode.text_coherence(docs(spark, sf_dir).select("doc_id", "text"), encode.HashedProjection(), limit=20_000)
    rows = rows.withColumns({"_v": F.round("variance", 9), "_cues": F.size(F.coalesce(detect.native_cues(F.col("text")), F.array().cast("array<string>")))})
    semantic, _, anomaly, flag = policy.fuse_coherence(F.col("_v"), F.lit(0.02), F.col("_cues"))
    return rows.select("doc_id", F.round("variance", 6).alias("variance"), F.round("mean_similarity", 6).alias("mean_similarity"), "n_pairs", F.round(semantic, 5).alias("semantic"), F.round(anomaly, 5).alias("anomaly"), flag.alias("flag"))


_MEANS = "list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE) / 2)"


def _left_out(source: str) -> str:
    """The variance of ``source`` (doc_id, o, i, embedding: units in the order i, o: the one left out) by computing all anew."""
    return f"""(SELECT doc_id, o, CASE WHEN count(cos) > 0 THEN var_pop(cos) ELSE 0 END AS v FROM (SELECT doc_id, o, list_cosine_similarity(w, lead(w) OVER (PARTITION BY doc_id, o ORDER BY i)) AS cos
 FROM (SELECT doc_id, o, i, {_MEANS.format(a='embedding', b='lead(embedding) OVER (PARTITION BY doc_id, o ORDER BY i)')} AS w, lead(i) OVER (PARTITION BY doc_id, o ORDER BY i) AS more FROM {source}) WHERE more IS NOT NULL) GROUP BY doc_id, o)"""


@query(f"""WITH u AS (SELECT label AS doc_id, vec_id AS w_idx, embedding, vec_id % 20 = 0 AS cue, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
chosen AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, least(n, 64)), lambda k: (k * (n - 1)) // greatest(least(n, 64) - 1, 1))) AS o FROM u),
base AS {_left_out("(SELECT doc_id, -1 AS o, i, embedding FROM u)")}, rest AS {_left_out("(SELECT u.doc_id, c.o, u.i, u.embedding FROM u JOIN chosen c ON c.doc_id = u.doc_id AND u.i <> c.o)")},
g AS (SELECT c.doc_id, u.w_idx, u.cue, base.v - coalesce(rest.v, 0) AS gain FROM chosen c JOIN base ON base.doc_id = c.doc_id JOIN u ON u.doc_id = c.doc_id AND u.i = c.o LEFT JOIN rest ON rest.doc_id = c.doc_id AND rest.o = c.o),
h AS (SELECT *, max(gain) OVER (PARTITION BY doc_id) AS top FROM g), k AS (SELECT doc_id, w_idx, gain, greatest(CASE WHEN top > 0 AND gain > 0 THEN least(1, gain / top) ELSE 0 END, CASE WHEN cue THEN 0.85 ELSE 0 END) AS heat FROM h)
SELECT doc_id, w_idx, round(gain, 9) AS contribution, round(heat, 5) AS heat, round(heat, 9) >= 0.5 AS suspicious, row_number() OVER (PARTITION BY doc_id ORDER BY round(heat, 9) DESC, w_idx) AS rank FROM k""")
def unit_explanations(spark, sf_dir):
    """Leave-one-out contributions of units to the variance, in closed form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("w_idx"), "embedding", (F.col("vec_id") % 20 == 0).alias("cue"))
    return detect.explain_units(rows).withColumns({"contribution": F.round("contribution", 9), "heat": F.round("heat", 5)})


MODEL = policy.LinearModel((2.0, 1.5, -0.5), -0.25, (0.3, 0.4, 0.5), (0.2, 0.3, 0.25))
LOGIT = "(-0.25 + 2.0::DOUBLE * (a - 0.3) / 0.2 + 1.5::DOUBLE * (b - 0.4) / 0.3 - 0.5::DOUBLE * (c - 0.5) / 0.25)"


@query(f"WITH {fx.VERDICT_ROWS} SELECT doc_id, round(1 / (1 + exp(-{LOGIT})), 9) AS score, {LOGIT} > 0 AS model_flag FROM inputs")
def linear_score(spark, sf_dir):
    return fx.verdict_rows(spark, sf_dir).select("doc_id", F.round(MODEL.score(), 9).alias("score"), MODEL.decision().alias("model_flag"))


def verdicts(spark, sf_dir):
    rows = fx.verdict_rows(spark, sf_dir).withColumn("score", MODEL.score()).withColumn("model_flag", MODEL.decision())
    return policy.decide(rows)


VERDICTS = f"""{fx.VERDICT_ROWS}, s AS (SELECT *, 1 / (1 + exp(-{LOGIT})) AS score, {LOGIT} > 0 AS model_flag, input_mode = 'pdf' AS pdf FROM inputs),
k AS (SELECT *, pdf AND NOT forced_partial AND NOT semantic_truncated AND a_status = 'ok' AND b_status = 'ok' AND c_status = 'ok' AS complete FROM s),
v AS (SELECT *, list_filter([CASE WHEN repetition THEN 'keyword_repetition_signal' END, CASE WHEN cue_count > 0 THEN 'direct_instruction_cue' END, CASE WHEN pdf AND b_flagged THEN 'pdf_structure_advisory' END, CASE WHEN a_flagged THEN 'keyword_density_advisory' END,
 CASE WHEN model_flag THEN 'experimental_model_advisory' END, CASE WHEN pdf AND NOT complete THEN 'analysis_incomplete' END, CASE WHEN NOT pdf AND NOT complete THEN 'text_model_unavailable' END], lambda x: x IS NOT NULL) AS reason_codes,
 CASE WHEN repetition OR cue_count > 0 THEN 'review_recommended' WHEN complete AND score IS NOT NULL THEN 'no_signals_detected' ELSE 'insufficient_evidence' END AS decision,
 CASE WHEN NOT pdf THEN 'partial' WHEN complete THEN 'complete' WHEN a_status = 'ok' OR b_status = 'ok' OR c_status = 'ok' THEN 'partial' ELSE 'unscorable' END AS status FROM k)"""


@query(f"""WITH {VERDICTS} SELECT doc_id, complete, array_to_string(reason_codes, ',') AS reasons, decision, status, CASE decision WHEN 'review_recommended' THEN 'attack' WHEN 'no_signals_detected' THEN 'clean' ELSE 'insufficient' END AS verdict,
 decision = 'no_signals_detected' AND status = 'complete' AS forwarded FROM v""")
def policy_decisions(spark, sf_dir):
    rows = verdicts(spark, sf_dir).withColumn("forwarded", policy.forward(F.col("decision"), F.col("status")))
    return rows.select("doc_id", "complete", F.array_join("reason_codes", ",").alias("reasons"), "decision", "status", "verdict", "forwarded")


@query(f"WITH {VERDICTS} SELECT reason, count(*) AS n FROM (SELECT unnest(reason_codes) AS reason FROM v) GROUP BY reason")
def reason_code_counts(spark, sf_dir):
    return verdicts(spark, sf_dir).select(F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {VERDICTS} SELECT input_mode, count(*) AS n, count(*) FILTER (coalesce(model_flag, false) OR cue_count > 0 OR coalesce(b, 0) >= 0.9) AS flagged FROM v GROUP BY input_mode")
def research_policy(spark, sf_dir):
    flag = policy.research_flag(F.col("model_flag"), F.col("cue_count"), F.col("b"))
    return verdicts(spark, sf_dir).groupBy("input_mode").agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))


@query(f"""WITH {VERDICTS}, f AS (SELECT doc_id, unnest([CASE WHEN cue_count > 0 THEN 'direct_instruction' END, CASE WHEN repetition THEN 'repetition' END, CASE WHEN b_flagged THEN 'structure' END, CASE WHEN a_flagged THEN 'density' END]) AS category FROM v)
SELECT category, count(*) AS n, count(*) FILTER (category IN ('direct_instruction', 'repetition')) AS triggers, count(DISTINCT doc_id) AS documents FROM f WHERE category IS NOT NULL GROUP BY category""")
def review_projection(spark, sf_dir):
    rows = policy.findings(verdicts(spark, sf_dir)).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("review_trigger").alias("triggers"), F.count_distinct("doc_id").alias("documents"))


@query(f"""WITH {VERDICTS}, w AS (SELECT doc_id, input_mode, complete, CASE WHEN doc_id % 60 = 1 THEN 'no_signals_detected' ELSE decision END AS decision, status, cue_count > 0 AS di, repetition AS re, b_flagged AS st, a_flagged AS de,
 CASE WHEN doc_id % 60 = 2 THEN reason_codes || ['unheard_of'] WHEN doc_id % 60 = 3 THEN reason_codes || reason_codes WHEN doc_id % 60 = 4 THEN list_filter(reason_codes, lambda c: c <> 'analysis_incomplete') ELSE reason_codes END AS codes FROM v)
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN di THEN 'direct_instruction' END, CASE WHEN re THEN 'repetition' END, CASE WHEN st THEN 'structure' END, CASE WHEN de THEN 'density' END], lambda x: x IS NOT NULL)), ',') AS categories, (di::INT + re::INT + st::INT + de::INT)::BIGINT AS n_findings, (di::INT + re::INT)::BIGINT AS n_triggers,
 array_to_string(list_sort(list_filter([CASE WHEN list_contains(codes, 'unheard_of') THEN 'codes_known' END, CASE WHEN len(codes) <> len(list_distinct(codes)) THEN 'codes_once' END,
 CASE WHEN (decision = 'review_recommended') <> (list_contains(codes, 'keyword_repetition_signal') OR list_contains(codes, 'direct_instruction_cue')) THEN 'review_has_trigger' END, CASE WHEN decision = 'no_signals_detected' AND NOT (complete AND status = 'complete') THEN 'clean_is_whole' END,
 CASE WHEN input_mode = 'pdf' AND complete = list_contains(codes, 'analysis_incomplete') THEN 'incomplete_is_said' END, CASE WHEN (decision = 'review_recommended') <> (di OR re) THEN 'findings_fit' END], lambda x: x IS NOT NULL)), ',') AS broken FROM w""")
def projected_verdicts(spark, sf_dir):
    """Findings counted by document and the rules of consistency that it breaks, some on purpose."""
    at, codes = F.col("doc_id") % 60, F.col("reason_codes")
    rows = verdicts(spark, sf_dir).withColumns({
        "decision": F.when(at == 1, "no_signals_detected").otherwise(F.col("decision")),
        "reason_codes": F.when(at == 2, F.concat(codes, F.array(F.lit("unheard_of")))).when(at == 3, F.concat(codes, codes)).when(at == 4, F.array_remove(codes, "analysis_incomplete")).otherwise(codes),
    })
    return validate.projected(policy.findings(rows)).select("doc_id", "categories", "n_findings", "n_triggers", "broken")


@query(f"WITH {VERDICTS} SELECT b_status, c_status, count(*) AS n FROM v GROUP BY ALL")
def module_states(spark, sf_dir):
    rows = fx.verdict_rows(spark, sf_dir)
    pdf = F.col("input_mode") == "pdf"
    b = policy.module_status(F.lit(True), F.lit(False), pdf)
    c = policy.module_status(F.col("doc_id") % 7 != 0, F.lit(False), F.lit(True))
    return rows.groupBy(b.alias("b_status"), c.alias("c_status")).agg(F.count("*").alias("n"))


_BROKEN = f"""{VERDICTS}, w AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'maybe' WHEN doc_id % 50 = 4 THEN 'no_signals_detected' ELSE decision END AS decision,
 CASE WHEN doc_id % 50 = 2 THEN 'done' WHEN doc_id % 50 = 4 THEN 'partial' ELSE status END AS status, CASE WHEN doc_id % 50 = 3 THEN 2.0 ELSE score END AS score FROM v)"""


@query(f"""WITH {_BROKEN} SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN decision NOT IN ('review_recommended', 'no_signals_detected', 'insufficient_evidence') THEN 'decision' END, CASE WHEN status NOT IN ('complete', 'partial', 'unscorable') THEN 'status' END,
 CASE WHEN decision = 'no_signals_detected' AND NOT (status = 'complete' AND score IS NOT NULL) THEN 'clean_is_complete' END, CASE WHEN NOT coalesce(score BETWEEN 0 AND 1, true) THEN 'score_range' END]) AS rule FROM w) WHERE rule IS NOT NULL GROUP BY rule""")
def verdict_contract(spark, sf_dir):
    """Violations of the contract of results, in results of which some are broken on purpose."""
    at, rows = F.col("doc_id") % 50, verdicts(spark, sf_dir)
    rows = rows.withColumns({
        "decision": F.when(at == 1, "maybe").when(at == 4, "no_signals_detected").otherwise(F.col("decision")), "status": F.when(at == 2, "done").when(at == 4, "partial").otherwise(F.col("status")),
        "score": F.when(at == 3, 2.0).otherwise(F.col("score")),
    })
    return validate.violations(rows, "doc_id", validate.verdict_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.TRACES}, {SUMMARY}, s AS (SELECT doc_id, least(1.0, count(*) FILTER (f) / 10) AS score, bool_or(invisible OR off_page OR hidden_layer) AS explicit, count(*) FILTER (f) AS n FROM flagged GROUP BY doc_id)
SELECT s.doc_id, coalesce(score >= 0.5, false) OR explicit AS b_flagged, least(n, {detect.MAX_LISTED})::BIGINT AS listed, greatest(n - {detect.MAX_LISTED}, 0) AS omitted, (CASE WHEN o.doc_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS hidden_layers FROM s LEFT JOIN off o ON o.doc_id = s.doc_id""")
def structure_flags(spark, sf_dir):
    """Whether the traces of a document are flagged, its listed findings, and the layers that are off."""
    found, pages, layers = fx.traces(spark, sf_dir)
    flags = detect.trace_flags(found, pages, layers)
    explicit = flags.groupBy("doc_id").agg(F.bool_or(F.col("invisible") | F.col("off_page") | F.col("hidden_layer")).alias("explicit"))
    rows = detect.trace_summary(flags).join(explicit, "doc_id").join(detect.trace_findings(flags, layers), "doc_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", policy.structure_flag(F.col("trace_score"), F.col("explicit")).alias("b_flagged"), F.coalesce(F.size("listed").cast("long"), zero).alias("listed"), F.coalesce("omitted", zero).alias("omitted"), F.coalesce("hidden_layers", zero).alias("hidden_layers"))


@query("""WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
c AS (SELECT label, coalesce(var_pop(CASE WHEN prev IS NOT NULL THEN list_cosine_similarity(embedding::DOUBLE[], prev::DOUBLE[]) END), 0) AS variance, label % 3 AS cues FROM p GROUP BY label)
SELECT label AS doc_id, round(least(1.0, variance / 0.04), 6) AS semantic, least(1.0, 0.5 * cues)::DOUBLE AS injection, round(greatest(least(1.0, variance / 0.04), 0.5 * cues), 6) AS anomaly, variance > 0.02 OR cues > 0 AS flag FROM c""")
def coherence_fusion(spark, sf_dir):
    """The coherence measure fused with a number of cues, at a threshold of 0.02."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("w_idx"), "embedding")
    rows = detect.coherence(rows).withColumn("cues", F.col("doc_id") % 3)
    semantic, injection, anomaly, flag = policy.fuse_coherence(F.col("variance"), F.lit(0.02), F.col("cues"))
    return rows.select("doc_id", F.round(semantic, 6).alias("semantic"), injection.cast("double").alias("injection"), F.round(anomaly, 6).alias("anomaly"), flag.alias("flag"))


@query()
def train_linear(spark, sf_dir):
    """Scaled, balanced logistic regression of three measures of the labelled documents, and its confusion."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    t = F.col("text")
    rows = rows.select("doc_id", F.col("quality").alias("label"), (F.length(t) / F.greatest(F.size(F.split(t, " ")), F.lit(1))).alias("a"), (F.size(F.split(t, "\n")) / F.greatest(F.length(t), F.lit(1))).alias("b"), (F.regexp_count(t, F.lit("[#*$%&|<>]")) / F.greatest(F.length(t), F.lit(1))).alias("c"))
    model = policy.fit_linear(rows)
    return evaluate.confusion(rows.withColumn("predicted", model.decision().cast("int")), [])


@query()
def stacking(spark, sf_dir):
    """Stacked forest and regression: mean score by label."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    t = F.col("text")
    rows = rows.select(F.col("quality").cast("double").alias("label"), (F.length(t) / F.greatest(F.size(F.split(t, " ")), F.lit(1))).alias("a"), (F.size(F.split(t, "\n")) / F.greatest(F.length(t), F.lit(1))).alias("b"), (F.regexp_count(t, F.lit("[#*$%&|<>]")) / F.greatest(F.length(t), F.lit(1))).alias("c"))
    apply = policy.fit_stack(rows, trees=20, folds=3)
    return apply(rows).groupBy("label").agg(F.round(F.avg("stack_score"), 3).alias("mean_score"), F.count("*").alias("n"))
