"""From pages and traces to verdicts: every family, bounds, errors, and what is missing."""

import pytest
from pyspark.sql import functions as F

from docprism.operators import analysis, encode, policy, prep

MODEL = policy.LinearModel((2.0, 1.5, -0.5), -0.25, (0.3, 0.4, 0.5), (0.2, 0.3, 0.25))
POLICY = analysis.Policy(0.02, 0.02, MODEL)
TEXT = "We walked along the quiet river today. The water was cold and very clear. Nobody else came by that morning."


@pytest.fixture(scope="module")
def verdicts(spark):
    made = [(k, TEXT) for k in range(300)] + [(900, None), (901, ""), (902, "word " * 5000)]
    cases = prep.study_cases(spark.createDataFrame(made, "doc_id long, text string"), 0.5)
    pages, traces, boxes, layers = prep.study_pages(cases)
    traces = traces.withColumn("x1", F.when(F.col("doc_id") == 7, float("nan")).otherwise(F.col("x1")))
    out = analysis.analyse(pages, traces, boxes, layers, encode.HashedProjection(), POLICY, limit=24_000)
    return cases.select("doc_id", "family").join(out, "doc_id", "left").collect(), cases, out


def test_every_family_is_reviewed(verdicts):
    rows = [r for r in verdicts[0] if r.doc_id < 300]
    assert {r.family for r in rows} == {*prep.PAYLOADS, "control"}
    for r in rows:
        if r.family == "control":
            assert r.decision == ("no_signals_detected" if r.doc_id != 7 else "insufficient_evidence") and not r.spans
        else:
            assert r.decision == "review_recommended" and (r.repetition if r.family == "repetition" else r.cue_count > 0)
        assert r.b_flagged == (r.family == "off_page" and r.doc_id != 7)
        assert ("pdf_structure_advisory" in r.reason_codes) == r.b_flagged


def test_bounds_and_errors(verdicts):
    of = {r.doc_id: r for r in verdicts[0]}
    assert of[7].b_status == "error" and of[7].b is None and of[7].score is None and of[7].status == "partial"
    assert of[902].stopped == "characters" and of[902].forced_partial and of[902].status == "partial" and of[902].decision != "no_signals_detected"
    assert of[900].pages_without_text >= 1 and of[900].decision is not None and of[901].pages_without_text >= 1


def test_tally_counts_every_case(spark, verdicts):
    _, cases, out = verdicts
    got = {r.family: r for r in analysis.tallied(cases, out.where("doc_id <> 3"), ["family"]).collect()}
    assert sum(r.n for r in got.values()) == 303 and sum(r.runtime_error for r in got.values()) == 1
    for r in got.values():
        assert r.n == sum(r[o] for o in analysis.OUTCOMES)


def test_arms_follow_from_verdicts(spark):
    schema = "doc_id long, decision string, status string, reason_codes array<string>, model_flag boolean, baseline boolean"
    made = [
        (1, "review_recommended", "complete", ["direct_instruction_cue"], True, True), (2, "no_signals_detected", "complete", [], False, False), (3, "insufficient_evidence", "partial", ["pdf_structure_advisory"], None, False),
        (4, "review_recommended", "partial", ["keyword_repetition_signal"], False, None), (5, "insufficient_evidence", "unscorable", ["direct_instruction_cue"], True, True),
    ]
    cases = spark.createDataFrame([(k, k % 2, "f", k % 2 == 1) for k in range(1, 7)], "doc_id long, source_group int, family string, added_attack boolean")
    got: dict = {}
    for r in analysis.arms(cases, spark.createDataFrame(made, schema)).collect():
        got.setdefault(r.case_id, {})[r.arm] = r.flagged
        assert r.status == {6: "error"}.get(r.case_id, dict((m[0], m[2]) for m in made).get(r.case_id))
    order = lambda k: tuple(got[k][a] for a in analysis.ARMS)
    assert order(1) == (True, True, False, False, True, True) and order(2) == (False,) * 6
    assert order(3) == (None, None, None, True, None, None)  # partial: what is not flagged is unknown
    assert order(4) == (True, None, True, None, None, None) and order(5) == order(6) == (None,) * 6


def test_arm_intervals(spark):
    """Against draws of the restated multiplicities."""
    import random

    import numpy as np

    from docprism.operators.order import block_multiplicities

    rng = random.Random(4)
    made = []
    for case in range(120):
        status = rng.choice(["complete", "complete", "partial", "error"])
        flags = {a: rng.choice([True, False, None]) if status == "complete" else rng.choice([True, None]) if status == "partial" else None for a in analysis.ARMS}
        made += [(case, a, case % 12, "f", case % 3 > 0, status, f) for a, f in flags.items()]
    long = spark.createDataFrame(made, "case_id int, arm string, source_group int, family string, added_attack boolean, status string, flagged boolean")
    got = {r.metric: (r.low, r.high, r.draws) for r in analysis.arm_intervals(long, 30, 7).collect()}
    assert len(got) == 2 * (6 * 2 + 5)
    times = block_multiplicities(7, 30, 12, 0)
    full = {c: f for c, a, *_, s, f in made if a == "full_policy" and s == "complete" and f is not None}
    for arm in analysis.ARMS:
        for stratum in ("attack", "control"):
            rows = [r for r in made if r[1] == arm and r[4] == (stratum == "attack")]
            done = [r for r in rows if r[5] == "complete" and r[6] is not None]
            values = {"all": [(r[2], int(bool(r[6]))) for r in rows], "complete": [(r[2], int(r[6])) for r in done]}
            if arm != "full_policy":
                values["net"] = [(r[2], int(full[r[0]]) - int(r[6])) for r in done if r[0] in full]
            for kind, pairs in values.items():
                up, down = np.zeros(12), np.zeros(12)
                for g, v in pairs:
                    up[g] += v
                    down[g] += 1
                rates = (times @ up) / (times @ down)
                low, high, n = got[f"{arm}.{stratum}.{kind}"]
                np.testing.assert_allclose((low, high), np.quantile(rates, [0.025, 0.975]), atol=1e-8)
                assert n == 30


def test_payload_behind_a_long_text(spark, tmp_path):
    """A payload behind more than 100,000 characters is found, as the SQL of the study says; the document stays partial."""
    from docprism.plans import study_queries

    key = 49_680  # its family is direct
    spark.createDataFrame([(key, "river " * 20_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = study_queries.verdict_study(spark, str(tmp_path)).first()
    assert (row.family, row.n, row.review_partial, row.insufficient) == ("direct", 1, 1, 0)
    arms = {r.arm: r for r in study_queries.challenge_strata(spark, str(tmp_path)).collect()}
    assert arms["cue"].partial_flagged == 1 and arms["regex"].partial_flagged == 1


def test_pages_without_bounds(spark):
    from docprism.sources.pages import fold_pages

    rows = [(1, 2, "b"), (1, 0, "a"), (1, 1, None), (2, 0, " \t"), *((3, k, "x" * 9000) for k in range(30))]
    got = {r.doc_id: r for r in fold_pages(spark.createDataFrame(rows, "doc_id long, page int, text string"), None, None).collect()}
    assert (got[1].text, got[1].pages_read, got[1].pages_without_text) == ("a\n\nb", 3, 1) and got[2].pages_without_text == 1
    assert len(got[3].text) == 30 * 9000 + 29 and got[3].pages_read == 30 and {r.stopped for r in got.values()} == {"end"}
    one = fold_pages(spark.createDataFrame(rows, "doc_id long, page int, text string"), None, 40).where("doc_id = 3").first()
    assert one.text == got[3].text and one.stopped == "end"
