"""Needles in texts: verbatim, referential and near matches, exposure forms, coverage.

Texts are read by one multi-pattern pass (``matching``) that keeps of each only what it
holds; pairs of texts and needles are made afterwards, of narrow columns, and only where
the result has a row for each. Needles are a dimension: up to ``MOST`` go into one pass;
more are scanned in blocks of that size, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteglass.functions import matching
from noteglass.functions import text as T

MOST = 20_000


def prepared(needles: DataFrame) -> DataFrame:
    """Needles with planted value and tail; no tail is the empty string."""
    tail = F.coalesce("entropy_tail", F.lit(""))
    return needles.select(F.col("id").alias("needle"), "category", F.col("canary_string").alias("label"), tail.alias("tail"), T.planted_value(F.col("canary_string"), tail).alias("planted"), F.coalesce("referential_markers", F.array().cast("array<string>")).alias("markers"))


def checked(needles: DataFrame, most: int = MOST) -> DataFrame:
    """The needles for broadcast, once their number is known to be bounded."""
    if needles.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} needles: take them in blocks")
    return F.broadcast(needles)


def blocks(needles: DataFrame, most: int = MOST) -> Iterator[tuple[DataFrame, list[matching.Needle]]]:
    """The prepared needles in blocks of about ``most`` at most, as a table and as a list."""
    dim = prepared(needles)
    columns = ["needle", "label", "tail", "planted", "markers"]
    rows = dim.select(*columns).limit(most + 1).collect()
    parts = 1 if len(rows) <= most else -(-2 * dim.count() // most)
    for k in range(parts):
        part = dim if parts == 1 else dim.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k)
        own = rows if parts == 1 else part.select(*columns).collect()
        yield part, [matching.Needle(r.needle, r.label, r.tail, r.planted, tuple(r.markers)) for r in own]


def scores(texts: DataFrame, needles: DataFrame, text: str = "text", also: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """One row for each text and needle: verbatim flags (tail null where there is none), markers, tiers.

    also: columns of the prepared needles to keep. Null texts give no rows.
    """
    keep = [c for c in texts.columns if c != text]
    full = texts.where(F.col(text).isNotNull())

    def one(dim: DataFrame, own: list[matching.Needle]) -> DataFrame:
        rows = matching.scan(full, own, text, "_hits", nearly=False).crossJoin(F.broadcast(dim.select("needle", "category", "tail", *(c for c in also if c != "tail"))))
        hit = F.get(F.filter("_hits", lambda h: h["needle"] == F.col("needle")), F.lit(0))
        flag = lambda name: F.coalesce(hit[name], F.lit(False))
        rows = rows.withColumn("verbatim_value", flag("value")).withColumn("verbatim_tail", F.when(F.col("tail") != "", flag("tail"))).withColumn("matched_markers", F.coalesce(F.array_join(hit["markers"], "|"), F.lit("")))
        t1 = F.col("verbatim_value") | F.coalesce("verbatim_tail", F.lit(False))
        return rows.select(
            *keep, "needle", "category", *also, t1.alias("t1"), "verbatim_value", flag("any_case").alias("value_any_case"), flag("label").alias("verbatim_label"), "verbatim_tail",
            ((F.col("matched_markers") != "") & ~t1).alias("referential"), "matched_markers",
        )

    return reduce(DataFrame.unionByName, (one(dim, own) for dim, own in blocks(needles, most)))


def held(texts: DataFrame, needles: DataFrame, text: str = "text", nearly: bool = False, most: int = MOST) -> DataFrame:
    """(keys, needle, flags, markers) of the needles that a text holds in any way; no rows for the others."""
    keep = [c for c in texts.columns if c != text]
    full = texts.where(F.col(text).isNotNull())
    found = (matching.scan(full, own, text, "_hits", nearly=nearly).select(*keep, F.explode("_hits").alias("_h")) for _, own in blocks(needles, most))
    return reduce(DataFrame.unionByName, found).select(*keep, "_h.*")


def by_category(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of every flag for each category; a tail that can't leak counts as none."""
    flags = ["t1", "verbatim_value", "value_any_case", "verbatim_label", "verbatim_tail", "referential"]
    return rows.groupBy(*keys, "category").agg(F.count_distinct("needle").alias("needles"), *(F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags))


def form(t1: Column, label: Column, markers: Column) -> Column:
    """full, partial, referential or null, in that order."""
    return F.when(t1, "full").when(label, "partial").when(F.size(markers) > 0, "referential")


def exposures(texts: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """(keys, needle, form, markers) of the needles that each text exposes."""
    keep = [c for c in texts.columns if c != text]
    rows = held(texts, needles, text).select(*keep, "needle", form(F.col("value") | F.col("tail"), F.col("label"), F.col("markers")).alias("form"), F.array_join("markers", "|").alias("markers"))
    return rows.where("form is not null")


def coverage(exposed: DataFrame, needles: DataFrame) -> DataFrame:
    """Exposures of every needle, those with none included."""
    counted = exposed.groupBy("needle").agg(F.count("*").alias("exposures"))
    return needles.select(F.col("id").alias("needle")).join(counted, "needle", "left").select("needle", F.coalesce("exposures", F.lit(0)).alias("exposures"))


def unknown_needles(exposed: DataFrame, needles: DataFrame) -> DataFrame:
    """Exposures that name no needle."""
    return exposed.join(needles.select(F.col("id").alias("needle")), "needle", "left_anti")


def differences(declared: DataFrame, derived: DataFrame, *keys: str) -> DataFrame:
    """Where declared and derived exposures disagree: missing, extra, form or markers."""
    a = declared.select(*keys, "needle", F.col("form").alias("declared"), F.col("markers").alias("declared_markers"), F.lit(True).alias("_a"))
    b = derived.select(*keys, "needle", F.col("form").alias("derived"), F.col("markers").alias("derived_markers"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(~F.col("declared").eqNullSafe(F.col("derived")), "form").when(~F.col("declared_markers").eqNullSafe(F.col("derived_markers")), "markers")
    return a.join(b, [*keys, "needle"], "full_outer").select(*keys, "needle", "declared", "derived", kind.alias("difference")).where("difference is not null")


def unknown_tokens(texts: DataFrame, needles: DataFrame, pattern: str = "CANARY-[A-Z0-9_-]+", text: str = "text") -> DataFrame:
    """(keys, token) of needle-shaped tokens that no label and no context declares."""
    known = needles.select(F.explode(F.array_union(F.array("canary_string"), F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit(pattern), F.lit(0)))).alias("token")).union(needles.select(T.planted_value(F.col("canary_string"), F.col("entropy_tail")))).distinct()
    keep = [c for c in texts.columns if c != text]
    found = texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("token"))
    return found.join(known, "token", "left_anti").select(*keep, "token")


def near_misses(texts: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """(keys, needle) of texts that hold a planted value with 1 to ``matching.EDITS`` edits, and not verbatim.

    k edits can't touch all of k + 1 parts, so a part found verbatim anchors every
    candidate; only windows around such places are compared.
    """
    keep = [c for c in texts.columns if c != text]
    return held(texts, needles, text, nearly=True).where("near_value").select(*keep, "needle").distinct()
