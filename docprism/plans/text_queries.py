"""Queries over text columns, vectors and plain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docprism.functions import folding
from docprism.functions import numeric as nm
from docprism.functions import text as tx
from docprism.operators import prep
from docprism.plans.registry import query
from docprism.sources import tables as src
from docprism.sources.pages import fold_pages
from docprism.sources.tables import table

SP = r"[ \t\n\r\f\v]+"
TOKENS = f"list_filter(string_split_regex({{t}}, '{SP}'), lambda w: w <> '')"
NORM = r"trim(regexp_replace(regexp_replace(coalesce({t}, ''), '[^\x20-\x7E\x{{C0}}-\x{{24F}}]', ' ', 'g'), ' +', ' ', 'g'))"
toks = lambda t: TOKENS.format(t=t)
norm = lambda t: NORM.format(t=t)


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"""SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g')) AS plain FROM (SELECT page_id,
  replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
   '(?is)<(script|style|template)[^>]*>.*?</(script|style|template)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
   '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages)""")
def strip_html_pages(spark, sf_dir):
    plain = tx.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(plain, tx.SPACE, " ")).alias("plain"))


@query(f"SELECT doc_id, md5({norm('text')}) AS norm_md5, length({norm('text')}) AS n_norm FROM documents")
def text_normalize(spark, sf_dir):
    t = tx.normalize_text(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(t).alias("norm_md5"), F.length(t).cast("long").alias("n_norm"))


@query(f"""SELECT doc_id, len({toks("coalesce(text, '')")}) AS n_words, len(list_distinct({toks("lower(coalesce(text, ''))")})) AS n_unique,
  round(coalesce(len(list_distinct({toks("lower(coalesce(text, ''))")})) / nullif(len({toks("coalesce(text, '')")}), 0), 0), 9) AS diversity, length(text) AS n_length FROM documents""")
def word_metrics(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tx.word_count(t).alias("n_words"), tx.unique_words(t).alias("n_unique"), F.round(tx.lexical_diversity(t), 9).alias("diversity"), F.length(t).cast("long").alias("n_length"))


@query(f"SELECT doc_id, md5(regexp_replace(lower(text), '{SP}', '', 'g')) AS fp FROM documents")
def fingerprint_md5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.fingerprint(F.col("text")).alias("fp"))


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{SP}', ' ', 'g'))) AS collapsed,
  CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9_]+')) > 0 THEN sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) END AS tokens,
  sha256(lower(trim(source))) AS source_key FROM documents""")
def fingerprint_sha_ascii(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tx.collapsed_fingerprint(t).alias("collapsed"), tx.token_fingerprint(t).alias("tokens"), tx.source_key(F.col("source")).alias("source_key"))


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(substr(text, 1, 20000), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 10)) AS n_sentences,
  len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+|\n', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 3)) AS n_units,
  len(list_filter(string_split_regex(text, '[.!?;\n]+'), lambda s: trim(s) <> '')) AS n_clauses FROM documents""")
def sentence_count(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.size(tx.sentences(t)).cast("long").alias("n_sentences"), F.size(tx.display_units(t)).cast("long").alias("n_units"), F.size(tx.clauses(t)).cast("long").alias("n_clauses"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\bof[ \t\n\r\f\v]+the\b', 'ofthe', 'g'), '(?i)\bth\b', 'the', 'g')) AS aliased FROM documents""")
def alias_canonical(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.canonical_aliases(F.col("text"), {"th": "the", "of the": "ofthe"})).alias("aliased"))


@query(r"""SELECT doc_id, len(c) AS n_candidates, coalesce(list_max(list_transform(c, lambda x: length(x))), 0) AS longest
  FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/]{16,}={0,2}') AS c FROM documents)""")
def base64_candidates(spark, sf_dir):
    c = tx.encoded_candidates(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(c).cast("long").alias("n_candidates"), F.coalesce(F.array_max(F.transform(c, F.length)), F.lit(0)).cast("long").alias("longest"))


@query("SELECT doc_id, substr(regexp_replace(text, '[^a-zA-Z ]', ' ', 'g'), 1, 60) AS decoded FROM documents WHERE length(text) >= 60")
def base64_round_trip(spark, sf_dir):
    """Encoded passages of the documents, found again and strictly decoded."""
    said = F.substring(F.regexp_replace("text", "[^a-zA-Z ]", " "), 1, 60)
    coded = docs(spark, sf_dir).where(F.length("text") >= 60).select("doc_id", F.concat(F.lit("see ("), F.regexp_replace(F.base64(said.cast("binary")), "[^A-Za-z0-9+/=]", ""), F.lit(") now")).alias("t"))
    return coded.select("doc_id", tx.strict_decode(F.element_at(tx.encoded_candidates(F.col("t")), 1)).alias("decoded"))


@query("""SELECT doc_id, substr(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')[1], 1, 80) AS snippet FROM documents""")
def snippets(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.first_line(F.col("text")).alias("snippet"))


@query()
def folded_text(spark, sf_dir):
    """Unicode folding and the map back to the original places (no SQL has it)."""
    held = docs(spark, sf_dir).select("doc_id", folding.folded(F.col("text")).alias("f"))
    return held.select("doc_id", F.md5("f.text").alias("folded"), F.size("f.places").alias("n_places"))


@query("""WITH e AS (SELECT vec_id, embedding, label, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm,
 round(list_cosine_similarity(embedding::DOUBLE[], nxt::DOUBLE[]), 4) AS cosine,
 round((embedding[1]::DOUBLE + nxt[1]::DOUBLE) / 2, 6) AS pooled_first FROM e WHERE nxt IS NOT NULL""")
def vector_measures(spark, sf_dir):
    nxt = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, sf_dir, "embeddings").withColumn("nxt", nxt).where("nxt is not null")
    return rows.select("vec_id", F.round(nm.norm(F.col("embedding")), 4).alias("norm"), F.round(nm.cosine(F.col("embedding"), F.col("nxt")), 4).alias("cosine"), F.round(nm.mean_pool(F.col("embedding"), F.col("nxt"))[0], 6).alias("pooled_first"))


@query("""SELECT doc_id, i AS pick FROM (SELECT doc_id, unnest(list_transform(range(0, least(n, 8)), lambda i: (i * (n - 1) // greatest(least(n, 8) - 1, 1))::BIGINT)) AS i
 FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents))""")
def even_units(spark, sf_dir):
    n = F.size(F.split("text", "\n"))
    return docs(spark, sf_dir).select("doc_id", F.explode(nm.even_indices(n, 8)).alias("pick"))


@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 9) AS jaccard
FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def jaccard_neighbours(spark, sf_dir):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), w.alias("wa"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), w.alias("wb"))
    return a.join(b, "a").select("a", "b", F.round(nm.jaccard(F.col("wa"), F.col("wb")), 9).alias("jaccard"))


@query("""SELECT vec_id, round(greatest(0.0, least(1.0, e)), 6) AS clamped, round(1 / (1 + exp(-e)), 9) AS sigmoid FROM (SELECT vec_id, embedding[1]::DOUBLE AS e FROM embeddings)""")
def clamp_sigmoid(spark, sf_dir):
    e = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(nm.clamp(e), 6).alias("clamped"), F.round(nm.sigmoid(e), 9).alias("sigmoid"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') AND n_chars > 1000 THEN 'long' WHEN lang = 'en' THEN 'short' ELSE 'other' END AS disposition FROM documents WHERE source IN ('src0', 'src1', 'src2')")
def filter_case(spark, sf_dir):
    kind = F.when(F.col("lang").isin("en", "de") & (F.col("n_chars") > 1000), "long").when(F.col("lang") == "en", "short").otherwise("other")
    return docs(spark, sf_dir).where(F.col("source").isin("src0", "src1", "src2")).select("doc_id", kind.alias("disposition"))


@query("""SELECT page_group AS doc_id, string_agg(CASE WHEN before >= 1500 THEN '' ELSE substr(text, 1, (1500 - before)::INT) END, chr(10) ORDER BY page) AS text,
 count(*) FILTER (trim(text) = '') AS pages_without_text, sum(length(text)) > 1500 AS truncated FROM (
 SELECT conv_id AS page_group, turn AS page, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM conversations) GROUP BY page_group""")
def bounded_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return src.bounded_pages(pages, 1500)


@query("""WITH p AS (SELECT conv_id AS doc_id, turn AS page, text, row_number() OVER w AS k, sum(length(text)) OVER w AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT * FROM p WHERE k <= 4 AND upto - length(text) <= 900 AND coalesce((SELECT max(x.upto) FROM p x WHERE x.doc_id = p.doc_id AND x.k = p.k - 1), 0) <= 900)
SELECT doc_id, md5(string_agg(CASE WHEN upto <= 900 THEN text ELSE substr(text, 1, (900 - upto + length(text))::INT) END, chr(10) ORDER BY page)) AS text_md5, count(*) AS pages_read, count(*) FILTER (trim(text) = '') AS pages_without_text,
 CASE WHEN max(upto) > 900 THEN 'characters' WHEN count(*) < (SELECT count(*) FROM p y WHERE y.doc_id = r.doc_id) THEN 'pages' ELSE 'end' END AS stopped FROM r GROUP BY doc_id""")
def folded_pages(spark, sf_dir):
    """Turns as pages, folded by a table function that stops at 900 characters or four pages."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return fold_pages(pages, 900, 4).select("doc_id", F.md5("text").alias("text_md5"), "pages_read", "pages_without_text", "stopped")


@query("""SELECT conv_id, bool_and(trim(text) <> '') AND sum(length(text)) BETWEEN 300 AND 15000 AND count(*) BETWEEN 2 AND 20 AS usable FROM conversations GROUP BY conv_id""")
def usable_sources(spark, sf_dir):
    usable = F.bool_and(F.trim("text") != "") & F.sum(F.length("text")).between(300, 15000) & F.count("*").between(2, 20)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(usable.alias("usable"))


@query("""SELECT doc_id, sha256(text) AS sha, doc_id % 7 = 0 AS tampered FROM documents WHERE doc_id % 7 = 0""")
def digest_check(spark, sf_dir):
    """Rows whose recorded digest no longer fits: every seventh is altered on purpose."""
    rows = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    bad = src.digest_mismatches(rows.withColumn("content", F.col("content").cast("binary")), "content", "sha")
    return bad.select("doc_id", "sha", (F.col("doc_id") % 7 == 0).alias("tampered"))


@query("""SELECT row_id, text_md5 FROM (SELECT 'DOC_' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, greatest(5, length((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR))::INT, '0') AS row_id, md5(text) AS text_md5 FROM documents)""")
def sequential_ids(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.md5(src.find_column(docs(spark, sf_dir), src.TEXT_NAMES)).alias("text_md5"))
    return prep.numbered(rows, "doc_id").select("row_id", "text_md5")


@query("""SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS variant, count(*) AS n, count(DISTINCT sha256(html)) AS distinct_bytes FROM pages GROUP BY ALL""")
def corpus_inventory(spark, sf_dir):
    """Inventory of files by what their names say."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("variant"), F.sha2("html", 256).alias("h"))
    return rows.groupBy("host", "variant").agg(F.count("*").alias("n"), F.count_distinct("h").alias("distinct_bytes"))


@query("""SELECT o_orderpriority AS taxonomy, n_name AS nation, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def taxonomy_join(spark, sf_dir):
    """Lookup joins: small dimensions are broadcast by their measured size."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("o_orderpriority").alias("taxonomy"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT 'missing' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
 SELECT 'unexpected', id FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL
 SELECT 'both', id FROM (SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def set_reconciliation(spark, sf_dir):
    """Two-way reconciliation of identifier sets: difference and intersection."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return src.same_set(c, o).select("side", "id").unionByName(c.intersect(o).select(F.lit("both").alias("side"), "id"))
