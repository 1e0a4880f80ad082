"""Steps whose cost must not grow faster than the input: texts are read, ranked and scored once."""

from pyspark.sql import functions as F

from docprism.operators import policy, prep

SF = "/root/testdata/sf0.001"


def test_words_are_ranked_once_for_all_budgets(spark):
    rows = spark.createDataFrame([(1, "a b  c d e f g h"), (2, "x"), (3, " spark\tsql ")], "doc_id long, text string")
    budgets = (0, 10, 25, 50, 100)
    made = prep.replaced_words(rows, "doc_id", budgets)
    got = {(r.doc_id, r.budget): (r.mutated, r.n_replaced) for r in made.collect()}
    each = rows.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    plain = each.select("doc_id", "budget", prep.replace_words(F.col("text"), F.col("doc_id"), F.col("budget")).alias("m")).collect()
    assert {k: v[0] for k, v in got.items()} == {(r.doc_id, r.budget): r.m for r in plain}
    assert got[1, 50][1] == 4 and got[1, 100] == (" ".join(["item"] * 8), 8) and got[2, 50] == ("x", 0)


def test_rank_study_scores_texts_once(spark):
    from docprism.plans import evaluation_queries

    read = evaluation_queries.rank_study(spark, SF).inputFiles()
    assert read and not any("documents.parquet" in f for f in read)


def test_stacking_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measured(x):
        seen.add(1)
        return float(x)

    rows = spark.range(60).select((F.col("id") % 2).alias("label"), measured("id").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 5).cast("double").alias("c"))
    policy.fit_stack(rows, trees=2, folds=2)
    assert seen.value == 60


def test_clusters_stream_by(spark):
    """Groups of traces are no tables of their own, and groups may span batches."""
    from docprism.operators import detect

    rows = [(d, 0, k, 10.0 * (k % 2) * 30, 5.0 * (k // 2), 10.0 * (k % 2) * 30 + 50, 5.0 * (k // 2) + 5, True) for d in range(40) for k in range(8)]
    flags = spark.createDataFrame(rows, "doc_id long, page int, trace_idx int, x0 double, y0 double, x1 double, y1 double, tiny boolean")
    flags = flags.withColumns({f: F.lit(False) for f in detect.FLAGS if f != "tiny"})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        made = detect.cluster_traces(flags)
        got = sorted(made.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == [(d, 0, "tiny", x, 0.0, x + 50, 20.0, 4) for d in range(40) for x in (0.0, 300.0)]
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()


def test_repetition_shuffles_no_tokens(spark):
    """Runs are found within each text: neither windows nor exploded tokens."""
    from docprism.operators import detect

    texts = ["sql spark " * 20, "well then " + "sql " * 32, "sql " * 31, "a sql spark b " * 16, "python sql x y " * 9, "river " * 80 + " sql" * 20, None, ""]
    made = detect.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {tuple(r) for r in made.collect()} == {(0, 2, 2), (1, 1, 3), (3, 4, 4), (4, 4, 4)}
    plan = made._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_rows_among_ids(spark):
    """A map of bits loses no row that has a partner, and lets few others by."""
    rows = spark.range(20000).select((F.col("id") * 7 - 5000).alias("k"), F.lit("x").alias("w"))
    ids = rows.where("k % 10 = 3").select("k")
    got = {r.k for r in prep.among(rows, "k", ids).collect()}
    want = {r.k for r in ids.collect()}
    assert want <= got and len(got) < len(want) + 100
    assert prep.among(rows, "k", ids.limit(0)).count() == 0


def test_corpus_build_writes_texts_once(spark, monkeypatch):
    """Copies are settled by keys: texts and sets are not written again by each step, nor sets without a partner."""
    written, cut = [], prep.cut
    monkeypatch.setattr(prep, "cut", lambda df: written.append(cut(df)) or written[-1])
    words = lambda k, odd="": " ".join(f"w{k}x{i}" for i in range(60)) + odd
    rows = [(k, words(k), "c") for k in range(30)] + [(40, words(3, " odd"), "c"), (41, words(4).upper(), "c")]
    built, _ = prep.build_corpus(spark.createDataFrame(rows, "k long, t string, cat string"), "k", "t", "cat")
    assert sum("clean_text" in df.columns for df in written) == 1
    sets = [df.count() for df in written if "w" in df.columns]
    assert sets == [32, 2]
    assert [r.k for r in built.orderBy("row_id").collect()] == list(range(30))


def test_same_key_twice_keeps_both_rows(spark):
    """Rows of one key stay rows of their own, each with its number."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text(1), "c"), (1, text(2), "c"), (2, text(3), "c")], "k long, t string, cat string")
    built, _ = prep.build_corpus(rows, "k", "t", "cat")
    got = sorted((r.row_id, r.k, r.clean_text) for r in built.collect())
    assert [x[:2] for x in got] == [("DOC_00000", 1), ("DOC_00001", 1), ("DOC_00002", 2)] and {x[2] for x in got[:2]} == {text(1), text(2)}
