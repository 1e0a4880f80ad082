"""The page fold against the windowed fold and the reasons for its stop."""

from docprism.sources import tables as src
from docprism.sources.pages import fold_pages


def test_fold_stops_at_its_bounds(spark):
    made = [(1, 2, "bb"), (1, 1, "aaa"), (2, 1, "x" * 7), (2, 2, "y" * 9), (2, 3, "never read"), (3, 1, None), (3, 2, " \t"), (3, 3, "c"), (4, 1, "z" * 10), (4, 2, ""), (None, 1, "n"), *((5, k, "p") for k in range(6))]
    pages = spark.createDataFrame(made, "doc_id long, page int, text string").repartition(3)
    got = {r.doc_id: (r.text, r.pages_read, r.pages_without_text, r.stopped) for r in fold_pages(pages, 10, 4).collect()}
    assert got == {
        1: ("aaa\nbb", 2, 0, "end"), 2: ("x" * 7 + "\nyyy", 2, 0, "characters"), 3: ("\n \t\nc", 3, 2, "end"), 4: ("z" * 10 + "\n", 2, 1, "end"), None: ("n", 1, 0, "end"), 5: ("p\np\np\np", 4, 0, "pages"),
    }
    whole = {r.doc_id: r.text for r in src.bounded_pages(pages.where("text is not null"), 100).collect()}
    folded = {r.doc_id: r.text for r in fold_pages(pages.where("text is not null"), 100).collect()}
    assert whole == folded
    assert fold_pages(pages.where("false")).count() == 0


def test_names_of_a_folder_that_comes_again_below_itself(spark, tmp_path):
    from docprism.sources import freeze

    root = tmp_path / "a"
    inner = root / str(tmp_path).lstrip("/") / "a"
    inner.mkdir(parents=True)
    (root / "x.txt").write_text("outer")
    (inner / "x.txt").write_text("inner")
    got = {r.name: r.sha256 for r in freeze.tree(spark, str(root)).collect()}
    assert got == {"x.txt": freeze.digest("outer"), f"{str(tmp_path).lstrip('/')}/a/x.txt": freeze.digest("inner")}
    pin = freeze.freeze_tree(spark, f"file://{root}", str(tmp_path / "m.json"), {"v": "1"})
    assert freeze.verify_tree(spark, str(root), str(tmp_path / "m.json"), pin)["identity"] == {"v": "1"}


def test_metrics_escape_labels():
    assert src.metrics_text([("n", {"a": 'x"y\\z\n'}, 2.0), ("m", {}, 1.5)]) == 'n{a="x\\"y\\\\z\\n"} 2\nm 1.5\n'


def test_forgotten_tables_are_gone(spark):
    import os

    kept, gone = src.cut(spark.range(3)), src.cut(spark.range(3))
    src.forget(gone)
    path = lambda df: df._cut_path.removeprefix("file://")
    assert os.path.exists(path(kept)) and not os.path.exists(path(gone)) and kept.count() == 3


def test_lineage_that_says_nothing(spark):
    from docprism.operators import validate

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "NaN"), (5, "none")], "k int, g string")
    assert [r.k for r in rows.where(~validate.group_rules("g")["group_known"]).orderBy("k").collect()] == [2, 3, 4, 5]
    numbers = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k int, g double")
    assert [r.k for r in numbers.where(~validate.group_rules("g")["group_known"]).collect()] == [2]
