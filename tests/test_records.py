"""Rates, review, usage, sessions, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from noteglass.operators import rates, review, sessions, usage
from noteglass.sources import records
from noteglass.streaming import runs as stream
from tests.test_scoring import FULL, NEEDLES, SCHEMA

KEY = "condition string, transcript string, sample int"


@pytest.fixture(scope="module")
def needles(spark):
    return spark.createDataFrame(NEEDLES, SCHEMA)


def claim(*values):
    return json.dumps({"claimed_values": list(values), "claimed_locations": ["a.py"]})


@pytest.mark.parametrize("output, want", [('{"failed": null}', True), ('{"failed": "x"}', True), ("null", False), ("[]", False), ('"failed"', False), ("3", False), ("true", False), ("plain note", False), (None, False), (claim(), False)])
def test_failed(spark, output, want):
    assert spark.createDataFrame([(output,)], "o string").select(rates.failed(F.col("o")).alias("f")).first().f is want


@pytest.fixture(scope="module")
def audit(spark, needles):
    notes = spark.createDataFrame([("C1", "t", k, FULL if k == 0 else "clean") for k in range(3)], KEY + ", note string")
    runs = spark.createDataFrame(
        [("attacker", "C1", "t", 0, claim(FULL)), ("attacker", "C1", "t", 0, claim(FULL)), ("attacker", "C1", "t", 1, '{"failed": "x"}'), ("attacker", "C1", "t", 2, claim()), ("control", "C1", "t", 0, claim()), ("control", "C1", "t", 1, claim()), ("defender", "C1", "t", 9, '{"failed": "r"}')],
        "stage string, " + KEY + ", output string",
    )
    exposed = spark.createDataFrame([("t", "env", "full", ["m"])], "transcript string, needle string, form string, markers array<string>")
    grades = spark.createDataFrame([("observed", "C1", "t", 2, "env", False), ("control", "C1", "t", 0, "env", False), ("control", "C1", "t", 1, "env", False), ("control", "C1", "t", 8, "env", True)], "arm string, " + KEY + ", needle string, located boolean")
    units = rates.units(notes, runs)
    return units, rates.pairs(units, exposed, needles, grades).cache(), grades, runs, rates.exposed_pairs(units, exposed)


def test_units_and_rates(audit, needles):
    units, rows, grades, _, asked = audit
    assert {(r.arm, r.sample, r.attacked, r.refused) for r in units.collect()} == {("observed", 0, True, False), ("observed", 1, False, False), ("observed", 2, True, False), ("control", 0, True, False), ("control", 1, True, False), ("observed", 9, False, True), ("control", 9, False, True)}
    out = {(r.arm, r.category, r.metric): r for r in rates.rates(rows, needles, units).collect()}
    t1 = out["observed", "env_secret", "t1"]
    assert (t1.hits, t1.exposures, t1.refused, t1.unattacked) == (1, 3, 1, 0) and t1.rate == pytest.approx(0.333333)
    t3 = out["observed", "env_secret", "t3"]
    assert (t3.hits, t3.exposures, t3.unattacked, t3.ungraded, t3.refused) == (1, 2, 1, 0, 1)
    location = out["observed", "env_secret", "t3_location"]
    assert location.rate is None and location.ungraded == 1
    empty = out["observed", "indiscreet_comment", "t1"]
    assert (empty.hits, empty.exposures, empty.rate, empty.reason) == (0, 0, None, "nothing exposed")
    assert ("control", "env_secret", "t1") not in out
    assert {r.sample for r in rates.stray_grades(asked, grades).collect()} == {8}
    net = {r.category: r for r in rates.nets(rates.rates(rows, needles, units)).collect()}
    assert net["env_secret"].t3_net == pytest.approx(0.5) and net["env_secret"].reason == ""
    assert net["indiscreet_comment"].t3_net is None


def test_resume(spark, audit):
    runs = audit[3]
    wanted = runs.select("stage", *rates.KEY).distinct()
    assert rates.resumable(wanted, runs, False).count() == 0
    assert {(r.stage, r.sample) for r in rates.resumable(wanted, runs, True).collect()} == {("attacker", 1), ("defender", 9)}


def test_queue_is_blind(audit, needles):
    items = review.queue(audit[4], needles)
    assert not {"arm", "condition", "transcript", "sample"} & set(items.columns)
    assert items.count() == 4 and review.collisions(items).count() == 0
    assert items.first().handles == ["PAYMENTS_API_KEY"]


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (5, 1), (6, 2), (48, 10)])
def test_sample_sizes(spark, n, want):
    rows = spark.createDataFrame([("observed", "C1", "t", k, "env") for k in range(n)], "arm string, " + KEY + ", needle string")
    got = {r.sample for r in review.sample(rows.union(rows)).collect()}
    assert len(got) == want
    assert got == {r.sample for r in review.sample(rows.orderBy(F.desc("sample"))).collect()}


@pytest.mark.parametrize("a, b, n, rate, kappa", [("TTFF", "TTFF", 4, 1.0, 1.0), ("TTFF", "TFFF", 4, 0.75, 0.5), ("TT", "TT", 2, 1.0, None), ("TF", "FT", 2, 0.0, -1.0), ("", "", 0, None, None)])
def test_kappa(spark, a, b, n, rate, kappa):
    side = lambda s: spark.createDataFrame([(k, c == "T") for k, c in enumerate(s)], "k int, located boolean")
    r = review.agreement(side(a), side(b), keys=["k"]).first()
    assert (r.n, r.rate, r.kappa) == (n, rate, kappa)


def test_usage(spark):
    use = lambda i, o, r, w: (i, o, r, w)
    rows = spark.createDataFrame([("attacker", "C1", "a", use(10, 1, 30, None), "m", "e", "h"), ("attacker", "C1", "b", use(0, 1, None, None), "m2", "e", "h"), ("defender", "C2", "a", None, "m", "e", "h")], "stage string, condition string, transcript string, usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>, model string, effort string, prompt_hash string")
    total = {r.stage: r for r in usage.totals(rows).collect()}
    assert total[None].calls == 3 and total["attacker"].input_tokens == 10
    cached = {(r.axis, r.name): r.ratio for r in usage.cache(rows).collect()}
    assert cached["transcript", "a"] in (0.75, 0.0) and cached["condition", "C1"] == 0.75 and cached["transcript", "b"] == 0.0
    assert [(r.stage, r.field, r["values"]) for r in usage.mixed(rows).collect()] == [("attacker", "model", "m|m2")]
    points = spark.createDataFrame([(1000, float(v)) for v in (90, 100, 110)] + [(2000, float(v)) for v in (180, 200, 220)], "n int, v double")
    fit = usage.elasticity(points, "n", "v").first()
    assert fit.slope == pytest.approx(1.0) and fit.se == pytest.approx(0.117788, abs=1e-4)
    assert usage.elasticity(points.where("n = 1000"), "n", "v").first().slope is None
    model = usage.prefix_model(spark.createDataFrame([(1000, 300), (2000, 500)], "n_chars int, written int")).first()
    assert (model.base, model.slope) == (100.0, 0.2)
    assert usage.prefix_model(spark.createDataFrame([(300, 900), (500, 300)], "n_chars int, written int")).first().slope is None


def test_references(spark):
    refs = spark.createDataFrame([(1, "a", None, None, None, None), (2, "a", "two", 1, 1, "> "), (3, "a", "e", None, None, None), (4, "../a", None, None, None, None), (5, "b", None, None, None, None), (6, "a", "two", None, None, None)], "ref_id int, file string, match string, before int, after int, prefix string")
    files = spark.createDataFrame([("a", "one\ntwo\nthree\n")], "file string, content string")
    out = {r.ref_id: (r.status, r.text) for r in sessions.resolve(refs, files).collect()}
    assert out == {1: ("ok", "one\ntwo\nthree"), 2: ("ok", "> one\n> two\n> three"), 3: ("2 matching lines", None), 4: ("unsafe path", None), 5: ("no such file", None), 6: ("ok", "two")}


def test_sources(spark, tmp_path):
    (tmp_path / "runs" / "x").mkdir(parents=True)
    (tmp_path / "runs" / "x" / "1.json").write_text(json.dumps({"stage": "attacker", "condition": "C1", "transcript": "t", "sample": 0, "output": "o", "extra": 1}))
    (tmp_path / "runs" / "2.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|failfast|2.json"):
        records.runs(spark, str(tmp_path / "runs")).collect()
    good, bad = records.readable(records.runs(spark, str(tmp_path / "runs"), strict=False).cache())
    assert [r.stage for r in good.collect()] == ["attacker"] and [r.path.endswith("2.json") for r in bad.collect()] == [True]
    (tmp_path / "d.json").write_text(json.dumps([{"item": "a", "located": True}, {"item": "b", "located": "maybe"}, {"item": "c", "located": False}, {"item": "c", "located": False}, {"located": True}]))
    faults = {(r.item, r.fault) for r in records.decisions(spark, str(tmp_path / "d.json")).collect()}
    assert faults == {("a", None), ("b", "located is no boolean"), ("c", "item repeated"), (None, "no item")}
    (tmp_path / "k.json").write_text(json.dumps({"round": "first", "items": {"a": ["observed", "C1", "t", "0", "env"]}}))
    assert tuple(records.key(spark, str(tmp_path / "k.json")).first()) == ("a", "observed", "C1", "t", 0, "env")
    (tmp_path / "m.json").write_text(json.dumps([dict(zip(SCHEMA.replace(" string", "").replace(" array<string>", "").split(", "), n, strict=True)) for n in NEEDLES]))
    assert records.manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "m2.json").write_text('[{"id": "x"}]')
    with pytest.raises(ValueError, match="unknown or missing"):
        records.manifest(spark, str(tmp_path / "m2.json"))
    assert records.sections("intro\n## A\nx\n## B\ny\n") == {"A": "x", "B": "y"}
    assert records.payloads(spark, str(tmp_path / "runs")).count() == 2
    records.write_runs(good, str(tmp_path / "out"))
    records.write_runs(good, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError, match="nothing to write for b"):
        records.write_tables({"a": good, "b": good.limit(0)}, str(tmp_path / "csv"))
    records.write_json(good.select("stage", "sample"), str(tmp_path / "o.json"))
    assert (tmp_path / "o.json").read_text() == '[\n  {\n    "sample": 0,\n    "stage": "attacker"\n  }\n]\n'
    slugs = spark.createDataFrame([("a/b",), ("..",), (None,)], "x string").select(records.slug(F.col("x")).alias("s")).collect()
    assert [r.s for r in slugs] == ["a_b", "_", "_"]


def test_stream_counts_each_key_once(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/runs.parquet")
    got = stream.read(spark, data, rows.schema)
    query = stream.into(stream.once(got), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.select("stage", *rates.KEY).distinct().count()


def test_render_and_grammar(spark, data):
    from noteglass.session import table

    one = sessions.render(sessions.once(table(spark, data, "transcripts"))).first()
    assert one.text.endswith("\n") and one.text.startswith("[")
    empty = table(spark, data, "transcripts").limit(0)
    assert sessions.violations(empty).count() == 0 and sessions.render(empty).count() == 0
