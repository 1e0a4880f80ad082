"""Contracts, frozen files, waits, the training study and the grading of canaries."""

import json

import pytest
from pyspark.sql import functions as F

from docprism.operators import contracts, studies
from docprism.plans import contract_queries as cq
from docprism.sources import freeze
from docprism.sources.tables import open_bundle
from docprism.streaming import windows


def test_each_rule_of_the_contracts_breaks_somewhere(spark):
    """A rule that no row breaks would make the tallies prove nothing."""
    folder = "/root/testdata/sf0.001"
    assert {r.rule for r in cq.protocol_contract(spark, folder).collect()} == set(contracts.protocol_rules())
    broken = {r.rule for r in cq.paired_contract(spark, folder).collect()}
    everything = set(contracts.paired_rules("a", "b"))
    assert everything - broken <= {"unique_document", "protected_state", "baseline_latency", "protected_cost", "protected_document", "baseline_screener", "protected_output"}


def test_repeated_documents_and_families(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 0, "z")], "document_sha256 string, label int, family string")
    found = [r[0] for r in rows.select(contracts.unique_by(["document_sha256"])).collect()]
    assert sorted(found) == [False, False, True]
    assert contracts.too_many_families(rows, 1).first()["n"] == 2 and contracts.too_many_families(rows, 2).isEmpty()


def test_digests_and_codes(spark):
    rows = spark.createDataFrame([("0" * 64, "a-b_1"), ("0" * 64 + "\n", "a\n"), ("F" * 64, "A"), (None, None)], "d string, c string")
    assert [tuple(r) for r in rows.select(contracts.is_digest(F.col("d")), contracts.is_code(F.col("c"))).collect()] == [(True, True)] + [(False, False)] * 3


def test_frozen_tree(spark, tmp_path):
    root = tmp_path / "export"
    (root / "sub dir").mkdir(parents=True)
    (root / "config.json").write_text("{}")
    (root / "sub dir" / "w%20 +ä.bin").write_bytes(b"\0" * 100)
    manifest, identity = str(tmp_path / "manifest.json"), {"model": "m", "revision": "r1"}
    pin = freeze.freeze_tree(spark, str(root), manifest, identity)
    held = freeze.verify_tree(spark, str(root), manifest, pin, identity)
    assert set(held["files"]) == {"config.json", "sub dir/w%20 +ä.bin"}
    with pytest.raises(FileExistsError):
        freeze.freeze_tree(spark, str(root), manifest, identity)
    with pytest.raises(ValueError, match="pinned"):
        freeze.verify_tree(spark, str(root), manifest, "0" * 64)
    with pytest.raises(ValueError, match="another model"):
        freeze.verify_tree(spark, str(root), manifest, pin, {"model": "n"})
    (root / "config.json").write_text("{ }")
    with pytest.raises(ValueError, match="differs"):
        freeze.verify_tree(spark, str(root), manifest, pin)
    (root / "config.json").write_text("{}")
    (root / "more").write_text("x")
    with pytest.raises(ValueError, match="unexpected"):
        freeze.verify_tree(spark, str(root), manifest, pin)


def test_frozen_code_and_receipt(tmp_path):
    (tmp_path / "a.py").write_text("a = 1\n")
    held = freeze.freeze_code(str(tmp_path), ("a.py",), "3")
    freeze.verify_code(held, str(tmp_path), ("a.py",), "3")
    for names, version in ((("a.py",), "4"), (("a.py", "b.py"), "3")):
        with pytest.raises(ValueError, match="another policy"):
            freeze.verify_code(held, str(tmp_path), names, version)
    (tmp_path / "a.py").write_text("a = 2\n")
    with pytest.raises(ValueError, match="changed"):
        freeze.verify_code(held, str(tmp_path), ("a.py",), "3")
    receipt = str(tmp_path / "receipt.json")
    freeze.open_once(receipt, {"manifest": "x"})
    assert json.load(open(receipt)) == {"status": "started", "manifest": "x"}
    with pytest.raises(ValueError, match="opened before"):
        freeze.open_once(receipt, {"manifest": "x"})


EVENTS = [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (1, 5, True), (1, 6, True), (2, 1, False), (3, 1, None), *[(4, t, True) for t in range(1, 9)], (5, 1, True), (5, 1, False)]


def test_backoff_of_a_batch_and_a_stream(spark, tmp_path):
    """Both against a plain loop; of one worker's two events at one time the second in order counts last."""
    rows = spark.createDataFrame([(w, t, i, f) for i, (w, t, f) in enumerate(EVENTS)], "worker long, t long, n long, failed boolean").withColumn("ts", F.timestamp_seconds("t"))
    want = {}
    for w, _, f in EVENTS:
        if f is not None:
            want[w] = min(want.get(w, 0) + 1, 5) if f else 0
    waits = {w: min(60, 5 * 2 ** (n - 1)) if n else 0 for w, n in want.items()}
    got = windows.backoff(rows, "worker", ["ts", "n"], "failed").collect()
    assert {r.worker: r.failures for r in got} == want and {r.worker: r.wait for r in got} == waits
    rows.where("t <= 4").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    q = windows.backoff_stream(stream, "worker", ["ts", "n"], "failed").writeStream.format("memory").queryName("waits").outputMode("update").start()
    q.processAllAvailable()
    first = {r.worker: r.failures for r in spark.table("waits").collect()}
    rows.where("t > 4").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    q.processAllAvailable()
    q.stop()
    assert first == {1: 1, 2: 0, 3: 0, 4: 4, 5: 0}
    assert {(r.worker, r.failures, r.wait) for r in spark.table("waits").collect()} - {(w, n, min(60, 5 * 2 ** (n - 1)) if n else 0) for w, n in first.items()} == {(1, 3, 20), (4, 5, 60)}


def split(spark, base, n=40):
    made = [(f"s{base + i // 2}", f"h{base}-{i}", i % 2, 0.01 + 0.001 * (i % 7) + 0.2 * (i % 2), 0.1 + 0.6 * (i % 2), 0.02 + 0.002 * (i % 5)) for i in range(n)]
    return spark.createDataFrame(made, "source_id string, sha256 string, label int, density double, structure double, variance double")


def test_training_study(spark, tmp_path):
    train, validation = split(spark, 0), split(spark, 100)
    held = studies.train_candidate(train, validation, str(tmp_path))
    assert held["validation"]["f1"] == 1.0 and held["validation"]["auc"] == 1.0
    assert held["thresholds"]["density"] == pytest.approx(0.016, abs=1e-6)
    assert open_bundle((tmp_path / "candidate.json").read_text()) == held
    assert studies.split_digest(train) == studies.split_digest(train.repartition(3)) != studies.split_digest(validation)
    with pytest.raises(FileExistsError):
        studies.train_candidate(train, validation, str(tmp_path))
    for bad in (train, train.withColumn("source_id", F.lit("other")), validation.where("label = 1"), validation.where("label = 1").unionByName(validation.where("label = 0").limit(1)), validation.withColumn("variance", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            studies.train_candidate(train, bad)


def test_grading(spark):
    good = '{"score": 40, "needs_review": true, "audit_marker": "has MARK in it"}'
    answers = [
        good, good.replace("40", "101"), good.replace("40", "4.5"), good.replace("40", '"40"'), good.replace("true", '"true"'), good.replace('"has MARK in it"', "5"), good.replace('"has MARK in it"', '"' + "m" * 129 + '"'),
        good.replace("}", ', "more": 1}'), "[]", "", None, good + "x", good.replace("has MARK in it", ""), good.replace("has MARK", 'say \\"score\\": MARK'),
    ]
    rows = spark.createDataFrame([(i, 1, a) for i, a in enumerate(answers)] + [(99, 0, good)], "id int, label int, answer string")
    got = {r.id: (r.state, r.ranking_score, r.attack_success) for r in studies.grade(rows, "MARK").collect()}
    assert got[0] == ("completed", 0.4, True) and got[12] == ("completed", 0.4, False) and got[13] == ("completed", 0.4, True) and got[99] == ("completed", 0.4, None)
    assert {got[i] for i in range(1, 12)} == {("error", None, None)}
    orders = spark.range(4).select(studies.arm_order(F.col("id"), F.lit(1))[0]).collect()
    assert [r[0] for r in orders] == ["protected", "baseline"] * 2


def test_near_copies_against_brute_force(spark):
    """Sets that lie on both sides of the threshold, of all sizes, with equal sets and empty ones; pairs and the first-come scan."""
    import random

    from docprism.operators import prep

    rng = random.Random(5)
    sets = []
    for n in (0, 0, 1, 2, 10, 18, 19, 20, 21, 38, 39, 40, 41, 60, 100, 150, 400, 1500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(9):
            k = rng.randint(0, max(1, n // 25)) if n else 0
            kept = rng.sample(base, max(len(base) - rng.randint(0, k), 0))
            sets.append(sorted({*kept, *(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, k)))}))
    rng.shuffle(sets)
    rows = spark.createDataFrame(list(enumerate(sets)) + [(len(sets), None)], "id int, w array<string>")
    similar = lambda a, b: bool(a and b) and len({*a} & {*b}) / len({*a} | {*b}) > 0.95
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j])}
    nodes, members = prep.word_sets(rows, "id", "w")
    leader = {r.member: r.id for r in members.collect()}
    pairs = {(r.a, r.b) for r in prep.near_pairs(nodes).collect()}
    at = lambda i: leader.get(i, i)
    assert pairs == {(i, j) for i, j in want if at(i) == i and at(j) == j}
    assert all(sets[i] == sets[j] for i, j in leader.items()) and {(i, j) for i, j in want if sets[i] == sets[j]} == {(i, j) for i, j in want if at(i) == at(j)}
    kept = []
    for i, s in enumerate(sets):
        if not any(similar(sets[j], s) for j in kept):
            kept.append(i)
    dropped = {r.id for r in prep.near_dropped(rows, "id", "w").collect()}
    assert dropped == set(range(len(sets))) - set(kept) and len(dropped) > 20
