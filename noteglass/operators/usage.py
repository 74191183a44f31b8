"""Token usage and scaling: totals, mixed provenance, cache shares, elasticities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]


def used(name: str) -> Column:
    """A counter of the usage; a missing one is 0."""
    return F.coalesce(F.col(f"usage.{name}"), F.lit(0))


def totals(runs: DataFrame, *by: str) -> DataFrame:
    """Calls and token sums by stage, with one row for all (null keys)."""
    return runs.rollup(*(by or ("stage",))).agg(F.count("*").alias("calls"), *(F.sum(used(t)).alias(t) for t in TOKENS))


def cache(runs: DataFrame) -> DataFrame:
    """Uncached, read and written prompt tokens by (stage, condition) and by (stage, transcript), in one pass, and the share read."""
    rows = runs.select("stage", "condition", "transcript", *(used(t).alias(t) for t in TOKENS))
    sets = rows.groupingSets([["stage", "condition"], ["stage", "transcript"]], "stage", "condition", "transcript")
    out = sets.agg(F.count("*").alias("records"), F.sum("input_tokens").alias("uncached"), F.sum("cache_read_input_tokens").alias("read"), F.sum("cache_creation_input_tokens").alias("written"), F.grouping("condition").alias("_g"))
    total = F.col("uncached") + F.col("read") + F.col("written")
    return out.select("stage", F.when(F.col("_g") == 0, "condition").otherwise("transcript").alias("axis"), F.when(F.col("_g") == 0, F.col("condition")).otherwise(F.col("transcript")).alias("name"), "records", "uncached", "read", "written", F.round(F.coalesce(F.try_divide(F.col("read"), total), F.lit(0.0)), 9).alias("ratio"))


def cold(cache_rows: DataFrame, floor: float = 0.33) -> DataFrame:
    """Groups of several records whose cache share is under the floor."""
    return cache_rows.where((F.col("ratio") < floor) & (F.col("records") > 1))


def mixed(runs: DataFrame) -> DataFrame:
    """(stage, condition, field, values) of fields with several values where one is expected."""
    stage = runs.where("stage is not null")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("model", "effort", "prompt_hash")))).alias("f")
    long = stage.select("stage", "condition", fields).select("stage", F.when((F.col("stage") == "defender") & (F.col("f.field") == "prompt_hash"), F.col("condition")).alias("condition"), "f.field", "f.value")
    grouped = long.groupBy("stage", "condition", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"), F.count_distinct("value").alias("n"))
    return grouped.where("n > 1").select("stage", "condition", "field", "values")


def mean_sem(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and standard error (sample variance; 0 for one value)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n_values"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("sem"))


def elasticity(rows: DataFrame, size: str, value: str) -> DataFrame:
    """Slope of log mean value on log size and its standard error, by the delta method; null if not determined."""
    means = mean_sem(rows.where(F.col(size) > 0), value, size).where("mean is not null").drop("n_values")
    one = means.agg(F.count("*").alias("_n"), F.min("mean").alias("low"), F.avg(F.log(size)).alias("mx"), F.avg(F.log(F.when(F.col("mean") > 0, F.col("mean")))).alias("my"))
    joined = means.crossJoin(F.broadcast(one))
    dx = F.log(size) - F.col("mx")
    sums = joined.agg(F.first("_n").alias("_n"), F.first("low").alias("low"), F.sum(dx * dx).alias("sxx"), F.sum(dx * (F.log(F.when(F.col("mean") > 0, F.col("mean"))) - F.col("my"))).alias("sxy"), F.sum(F.pow(dx * F.col("sem") / F.col("mean"), 2)).alias("v"))
    good = (F.col("_n") >= 2) & (F.col("low") > 0) & (F.col("sxx") > 0)
    return sums.select(F.coalesce("_n", F.lit(0)).alias("n"), F.when(good, F.round(F.col("sxy") / F.col("sxx"), 6)).alias("slope"), F.when(good, F.round(F.sqrt("v") / F.col("sxx"), 6)).alias("se"))


def power_factor(sizes: DataFrame, piloted: DataFrame, exponents: list[float]) -> DataFrame:
    """For each exponent e: the sum of size**e over the corpus by that over the pilot."""
    marked = sizes.join(piloted.select("transcript", F.lit(True).alias("pilot")).distinct(), "transcript", "left")
    dim = sizes.sparkSession.createDataFrame([(float(e),) for e in exponents], "e double")
    p = F.pow(F.col("n_chars"), F.col("e"))
    return marked.crossJoin(F.broadcast(dim)).groupBy("e").agg(F.round(F.sum(p) / F.sum(F.when(F.col("pilot"), p)), 6).alias("factor"))


def prefix_model(rows: DataFrame) -> DataFrame:
    """Constant and slope through the shortest and the longest (n_chars, written); null if not positive."""
    ends = rows.groupBy("n_chars").agg(F.max("written").alias("w")).agg(F.min(F.struct("n_chars", "w")).alias("a"), F.max(F.struct("n_chars", "w")).alias("b"))
    slope = F.try_divide(F.col("b.w") - F.col("a.w"), F.col("b.n_chars") - F.col("a.n_chars"))
    base = F.col("a.w") - slope * F.col("a.n_chars")
    return ends.select(F.when((slope > 0) & (base >= 0), F.round(base, 6)).alias("base"), F.when((slope > 0) & (base >= 0), F.round(slope, 6)).alias("slope"))
