"""Blind review: opaque ids, queues, hash-ranked samples, agreement of two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteglass.operators.rates import PAIR
from noteglass.operators.scoring import checked


def digest(salt: str) -> Column:
    """SHA-256 of salt and pair, joined by zero bytes."""
    return F.sha2(F.concat_ws("\x00", F.lit(salt), *(F.col(c).cast("string") for c in PAIR)), 256)


def item_id(round_: str) -> Column:
    return F.substring(digest(f"item/{round_}"), 1, 12)


def handles(markers: Column) -> Column:
    """Markers without white space."""
    return F.filter(markers, lambda m: ~m.rlike(r"(?U)[\s\x1c-\x1f]"))


def queue(pairs: DataFrame, needles: DataFrame, round_: str = "first") -> DataFrame:
    """Blind items of exposed and attacked pairs (PAIR, locations): nothing in them names arm, condition, transcript or sample."""
    dim = needles.select(F.col("id").alias("needle"), "category", "target_file", "slot", handles(F.col("referential_markers")).alias("handles"))
    return pairs.join(checked(dim), "needle").select(item_id(round_).alias("item"), "needle", "category", "target_file", "slot", "handles", F.col("locations").alias("claimed_locations"))


def only(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs of a wanted subset (PAIR); a wanted pair that isn't one of them is an error."""
    found = wanted.select(*PAIR).distinct().join(pairs.withColumn("_is", F.lit(True)), PAIR, "left")
    known = F.when(F.col("_is").isNull(), F.raise_error(F.concat(F.lit("no exposed and attacked pair: "), F.concat_ws("/", *(F.col(c).cast("string") for c in PAIR)))).cast("boolean")).otherwise(F.col("_is"))
    return found.where(known).drop("_is")


def collisions(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")


def sample(graded: DataFrame, fraction: float = 0.2, salt: str = "sample") -> DataFrame:
    """The ceil(fraction * n) distinct pairs of least digest; the order of the input doesn't matter.

    The rank is taken in two steps, so no single task sorts all pairs: the digests' first
    two bytes are counted, and only pairs in the one bucket on the edge are ranked.
    """
    keyed = graded.select(*PAIR).distinct().withColumn("digest", digest(salt)).withColumn("bucket", F.substring("digest", 1, 4))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    order = Window.orderBy("bucket")
    edges = counts.select("bucket", "n", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = keyed.join(F.broadcast(edges), "bucket").withColumn("take", F.ceil(F.lit(float(fraction)) * F.col("total"))).where("before < take")
    position = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", *PAIR)) + F.col("before")
    return ranked.withColumn("rank", position).where("rank <= take").select(*PAIR, "rank")


def agreement(first: DataFrame, second: DataFrame, field: str = "located", keys: list[str] | None = None) -> DataFrame:
    """One row: n, agreements, rate, Cohen's kappa (null when undefined), the pairs that disagree."""
    keys = keys or PAIR
    both = first.select(*keys, F.col(field).alias("a")).join(second.select(*keys, F.col(field).alias("b")), keys).where("a is not null and b is not null")
    same = F.col("a") == F.col("b")
    rows = both.agg(F.count("*").alias("n"), F.count_if(same).alias("agreements"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    observed = F.col("agreements") / F.col("n")
    kappa = F.when((F.col("n") > 0) & (chance < 1), F.round((observed - chance) / (1 - chance), 9))
    return rows.select("n", "agreements", F.when(F.col("n") > 0, F.round(observed, 9)).alias("rate"), kappa.alias("kappa"))


def disagreements(first: DataFrame, second: DataFrame, field: str = "located", keys: list[str] | None = None) -> DataFrame:
    keys = keys or PAIR
    both = first.select(*keys, F.col(field).alias("first")).join(second.select(*keys, F.col(field).alias("second")), keys)
    return both.where("first != second")


def unblind(decisions: DataFrame, key: DataFrame) -> DataFrame:
    """Decisions (item, located, ...) with the pair that their item stands for."""
    return decisions.join(key, "item")


def stray(decisions: DataFrame, key: DataFrame) -> DataFrame:
    """Decisions on items that the key doesn't have."""
    return decisions.join(key, "item", "left_anti")
