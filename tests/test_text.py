import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteglass.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_entropy(spark):
    for token in ["", "a", "aabb", "0123456789abcdef", "zß漢字zz"]:
        n = len(token)
        want = -sum(k / n * math.log2(k / n) for k in Counter(token).values()) if n else 0
        assert one(spark, T.entropy(F.col("x")), token) == pytest.approx(want, abs=1e-9)
    assert one(spark, T.entropy(F.col("x")), None) is None


def test_lines(spark):
    for text in ["", "a", "a\n", "a\n\nb", "a\r\nb\x1cc\x85d e", "\n"]:
        assert one(spark, T.lines(F.col("x")), text) == text.splitlines()


def test_normalise_and_markers(spark):
    assert one(spark, T.normalise(F.col("x")), "  Hammers The\xa0Read\n   Replica ") == "hammers the read replica"
    fires = lambda note: one(spark, T.fired_markers(F.array(F.lit("PAYMENTS_API_KEY")), T.normalise(F.col("x"))), note) != []
    assert all(fires(x) for x in ["`PAYMENTS_API_KEY`", "payments_api_key.", "PAYMENTS_API_KEY-based", "no PAYMENTS_API_KEY here"])
    assert not any(fires(x) for x in ["LEGACY_PAYMENTS_API_KEY_V1", "PAYMENTS_API_KEYRING", "PAYMENTS_API_KEYS", "éPAYMENTS_API_KEY"])
    odd = one(spark, T.fired_markers(F.array(F.lit("a.b (c) \\E $x")), T.normalise(F.col("x"))), "see A.B (C) \\E $X!")
    assert odd == ["a.b (c) \\E $x"]


def test_spans_and_replacement(spark):
    text = "ab12 cd345, 6"
    found = one(spark, T.spans(F.col("x"), r"\d+"), text)
    assert [(s.start, s.end, s.text) for s in found] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", text)]
    grouped = one(spark, T.spans(F.col("x"), r"([a-z]+)(\d+)", 2), text)
    assert [(s.start, s.end) for s in grouped] == [(2, 4), (7, 10)]
    assert one(spark, T.replaced(F.col("x"), T.spans(F.col("x"), r"\d+"), "#"), text) == "ab# cd#, #"
    assert one(spark, T.spans(F.col("x"), "z"), text) == []


def test_overlaps(spark):
    mixed = F.concat(T.spans(F.col("x"), "bcd", rule="late"), T.spans(F.col("x"), "abc", rule="early"), T.spans(F.col("x"), "abcde", rule="long"))
    assert [s.rule for s in one(spark, T.disjoint(mixed), "abcde")] == ["long"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n é", max_size=20), min_size=1, max_size=6))
def test_spans_tile_the_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.spans(F.col("x"), r"[ab]+\d?").alias("s")).collect()
    for x, s in rows:
        assert [(y.start, y.end, y.text) for y in s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[ab]+\d?", x)]
