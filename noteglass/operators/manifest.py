"""Rules of a needle manifest, as rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteglass.functions import text as T

#: The categories of needles.
CATEGORIES = ["env_secret", "hardcoded_credential", "internal_url", "absolute_path_with_username", "customer_name_in_fixture", "indiscreet_comment"]
TAILED = CATEGORIES[:2]
LABEL = r"CANARY-[0-9A-F]{4}-[A-Z_]+"


def rules() -> dict[str, Column]:
    """What breaks each rule of one needle."""
    tail, markers = F.coalesce("entropy_tail", F.lit("")), F.coalesce("referential_markers", F.array().cast("array<string>"))
    edge = r"(?U)^\W|\W$"
    return {
        "missing field": F.col("id").isNull() | F.col("category").isNull() | F.col("canary_string").isNull() | F.col("target_file").isNull() | F.col("context").isNull(),
        "unknown category": ~F.col("category").isin(CATEGORIES),
        "label has the wrong form": ~T.whole(F.col("canary_string"), LABEL),
        "tail has the wrong form": (tail != "") & ~T.whole(tail, "[0-9a-f]{8,20}"),
        "tail is missing": F.col("category").isin(TAILED) & (tail == ""),
        "no marker": F.size(markers) == 0,
        "blank marker": F.exists(markers, lambda m: F.trim(m) == ""),
        "separator in a marker": F.exists(markers, lambda m: F.contains(m, F.lit("|"))),
        "marker without word edges": F.exists(markers, lambda m: (F.trim(m) != "") & F.trim(m).rlike(edge)),
        "planted value not in the context": ~F.contains(F.col("context"), T.planted_value(F.col("canary_string"), tail)),
        "slot has the wrong form": ~T.whole(F.coalesce("slot", F.lit("file")), "[A-Za-z0-9_.-]+"),
        "file isn't relative": F.col("target_file").startswith("/") | F.col("target_file").rlike(r"(^|/)\.\.(/|$)"),
    }


def violations(needles: DataFrame) -> DataFrame:
    """(id, rule): broken rules of single needles, and values that must be unique."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules().items())))
    single = needles.select("id", F.explode(broken).alias("rule"))
    unique = {"id": F.col("id"), "label": F.col("canary_string"), "tail": F.when(F.col("entropy_tail") != "", F.col("entropy_tail")), "place": F.concat_ws("\x00", "target_file", F.coalesce("slot", F.lit("file")))}
    long = needles.select("id", F.explode(F.array(*(F.struct(F.lit(f"{n} isn't unique").alias("rule"), c.alias("value")) for n, c in unique.items()))).alias("u")).where("u.value is not null")
    twice = long.groupBy("u.rule", "u.value").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).where("n > 1").select(F.explode("ids").alias("id"), "rule")
    return single.unionByName(twice).distinct()
