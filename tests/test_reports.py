import hashlib
import json

import pytest
from pyspark.sql import functions as F

from noteglass.operators import reports

PAIR = "arm string, condition string, transcript string, sample int, needle string"


def grades(spark, rows):
    return spark.createDataFrame([("observed", "C1", "t", k, "env", located, True, None, round_, rubric) for k, located, round_, rubric in rows], PAIR + ", located boolean, precise boolean, note string, round string, rubric_sha256 string")


def test_records(spark):
    row = spark.createDataFrame([("boom", ["one", "two", None], ["end", None], [" a ", "", " ", "b"])], "m string, turns array<string>, stops array<string>, v array<string>")
    got = row.select(reports.turns_text(F.col("turns"), F.col("stops")).alias("t"), reports.failure_record(F.col("m"), F.col("turns"), F.col("stops")).alias("f"), reports.success_record(F.col("v"), F.col("v")).alias("s"), reports.prompt_hash(F.lit("a"), F.lit("b")).alias("h")).first()
    assert got.t == "## turn 1 (end)\n\none\n\n## turn 2 ()\n\ntwo" and got.h == hashlib.sha256(b"a\n\nb").hexdigest()[:16]
    assert json.loads(got.f)["failed"] == "boom" and json.loads(got.f)["turns_used"] == 3 and "claimed_values" not in got.f
    assert json.loads(got.s) == {"claimed_values": ["a", "b"], "claimed_locations": ["a", "b"]}


def test_empty_and_null_turns(spark):
    rows = spark.createDataFrame([(1, [], ["x"]), (2, ["x"], [])], "k int, turns array<string>, stops array<string>")
    assert {r.t for r in rows.select(reports.turns_text(F.col("turns"), F.col("stops")).alias("t")).collect()} == {""}
    assert json.loads(rows.limit(1).select(reports.failure_record(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")).alias("f")).first().f) == {"failed": "", "stop_reasons": [], "turns_used": 0}


def test_digest_is_of_the_set(spark):
    one, two = grades(spark, [(1, True, "first", "r"), (2, False, "first", "r")]), grades(spark, [(2, False, "x", "q"), (1, True, "y", "q"), (1, True, "y", "q"), (3, None, "y", "q")])
    assert reports.grades_digest(one).first() == reports.grades_digest(two).first() and reports.grades_digest(one).first().n == 2
    assert reports.grades_digest(one).first().digest != reports.grades_digest(grades(spark, [(1, False, "first", "r"), (2, False, "first", "r")])).first().digest
    assert reports.grades_digest(one.limit(0)).first().n == 0


def test_publishing(spark):
    rows = grades(spark, [(2, True, "first", "r"), (1, False, "first", "r"), (1, False, "first", "r"), (3, None, "first", "r"), (4, True, "regrade", "z")])
    assert [r.sample for r in reports.published(rows, "r").collect()] == [1, 2]
    with pytest.raises(ValueError, match="regrade"):
        reports.published(rows, "r", "regrade")
    with pytest.raises(Exception, match="another rubric"):
        reports.published(rows, "other").collect()


def test_report_says_what_is_missing(spark):
    first = grades(spark, [(k, True, "first", "r") for k in range(10)])
    got = reports.grading_report(first, first.limit(0)).first()
    assert (got.first_round_pairs, got.sampled, got.regraded, got.missing) == (10, 2, 0, 2) and got.reason == "2 sampled pairs not graded again"
    assert reports.grading_report(first, first).first().extra == 8
    assert tuple(reports.grading_report(first.limit(0), first).first()[:3]) == (0, 0, 0)


@pytest.mark.parametrize("slope, se, want", [(0.5, 0.1, (0.5, 0.4, 0.6)), (0.95, 0.2, (0.95, 0.75, 1.0)), (-0.3, 0.5, (0.0, 0.0, 0.2)), (None, None, (0.0, 0.0, 0.0))])
def test_candidates_shift_before_they_are_held(spark, slope, se, want):
    got = {r.name: r for r in reports.candidates(spark.createDataFrame([(2, slope, se)], "n int, slope double, se double")).collect()}
    assert tuple(round(got[n].e, 9) for n in ("fit", "low", "high")) == want and got["flat"].e == 0.0 and got["linear"].e == 1.0
    assert got["fit"].measured == (slope is not None)


def test_projection_and_bound(spark):
    fit = spark.createDataFrame([(2, 1.0, 0.0)], "n int, slope double, se double")
    sizes, piloted = spark.createDataFrame([("a", 100), ("b", 300)], "transcript string, n_chars int"), spark.createDataFrame([("a",), ("a",)], "transcript string")
    rows = reports.projected(fit, sizes, piloted, spark.createDataFrame([("s", 10)], "stage string, tokens bigint"))
    assert {(r.name, r.tokens) for r in rows.collect()} == {("fit", 40), ("low", 40), ("high", 40), ("flat", 20), ("linear", 40)}
    assert reports.bound(rows).first().tokens == 40
    span = reports.length_span(sizes, piloted).first()
    assert (span.n, span.n_piloted, span.shortest, span.longest, span["mean"]) == (2, 1, 100, 100, 200.0)
