"""Records and reports: hashes, turn texts, run records, published grades, projections.

Everything is a column expression or an aggregation; nothing is gathered in one place but
sums and digests of bounded buckets.

Defined cases: null texts and arrays count as empty in texts and records; a null call is in
no digest and isn't published; an empty table gives an empty result, or a report of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteglass.operators.rates import PAIR
from noteglass.operators.review import sample
from noteglass.operators.usage import TOKENS

#: Standard errors by which the fitted exponent is shifted; the other candidates are fixed exponents.
SHIFTS = {"fit": 0.0, "low": -1.0, "high": 1.0}
FLAT = {"flat": 0.0, "linear": 1.0}


def prompt_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by a blank line."""
    return F.substring(F.sha2(F.concat_ws("\n\n", *parts), 256), 1, 16)


def entries(values: Column) -> Column:
    """Claimed strings without blanks around them, blank ones left out."""
    return F.filter(F.transform(values, lambda v: F.regexp_replace(v, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")), lambda v: v != "")


def turns_text(turns: Column, reasons: Column) -> Column:
    """All turns that have a stop reason, numbered, each with its reason."""
    both = F.slice(F.arrays_zip(turns.alias("text"), reasons.alias("reason")), 1, F.least(F.size(turns), F.size(reasons)))
    part = lambda x, i: F.concat(F.lit("## turn "), (i + 1).cast("string"), F.lit(" ("), F.coalesce(x["reason"], F.lit("")), F.lit(")\n\n"), F.coalesce(x["text"], F.lit("")))
    return F.when(F.least(F.size(turns), F.size(reasons)) > 0, F.array_join(F.transform(both, part), "\n\n")).otherwise("")


def summed(usages: Column) -> Column:
    """One usage of an array of them; missing counters are 0."""
    return F.struct(*(F.aggregate(usages, F.lit(0).cast("bigint"), lambda a, u, t=t: a + F.coalesce(u[t], F.lit(0))).alias(t) for t in TOKENS))


def success_record(values: Column, locations: Column) -> Column:
    """The claim record of an attack that came to its end."""
    return F.to_json(F.struct(entries(locations).alias("claimed_locations"), entries(values).alias("claimed_values")))


def failure_record(message: Column, turns: Column, reasons: Column) -> Column:
    """The record of one that broke off; it has no claim, so nothing can count it as an empty one."""
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(F.coalesce(message, F.lit("")).alias("failed"), F.coalesce(reasons, none).alias("stop_reasons"), F.size(F.coalesce(turns, none)).alias("turns_used")))


def grades_digest(grades: DataFrame, field: str = "located") -> DataFrame:
    """One row: the number of graded pairs and a digest that only their set decides.

    Digests of pairs are gathered in buckets by their first two bytes, and the buckets'
    digests in one, so no task holds more than its bucket.
    """
    one = F.sha2(F.concat_ws("\x00", *(F.col(c).cast("string") for c in PAIR), F.col(field).cast("string")), 256)
    rows = grades.where(F.col(field).isNotNull()).select(*PAIR, field).distinct().select(one.alias("d"))
    join = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    buckets = rows.groupBy(F.substring("d", 1, 4).alias("b")).agg(F.count("*").alias("n"), join("d").alias("d"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def published(grades: DataFrame, rubric: str | None = None, round_: str = "first") -> DataFrame:
    """The grade file: calls of the round that is the record, once each, in the pairs' order.

    Only round ``first`` is published. rubric: the digest that the calls must have been made
    under; another one is an error.
    """
    if round_ != "first":
        raise ValueError(f"round {round_!r} isn't the record")
    rows = grades.where((F.col("round") == round_) & F.col("located").isNotNull())
    if rubric is not None:
        other = F.raise_error(F.concat(F.lit("graded under another rubric: "), F.coalesce("rubric_sha256", F.lit("none")))).cast("boolean")
        rows = rows.where(F.when(F.col("rubric_sha256").eqNullSafe(F.lit(rubric)), True).otherwise(other))
    return rows.select(*PAIR, "located", "precise", "note", "round", "rubric_sha256").distinct().orderBy(*PAIR)


def grading_report(first: DataFrame, second: DataFrame, fraction: float = 0.2) -> DataFrame:
    """One row: pairs of the first pass, of the sample drawn from it and of those graded again, and what doesn't fit."""
    pairs = first.select(*PAIR).distinct()
    drawn = sample(first, fraction).select(*PAIR, F.lit(1).alias("drawn"))
    again = second.select(*PAIR).distinct().withColumn("again", F.lit(1))
    marked = pairs.join(drawn, PAIR, "left").join(again, PAIR, "left")
    counted = marked.agg(
        F.count("*").alias("first_round_pairs"), F.count("drawn").alias("sampled"), F.count("again").alias("regraded"),
        F.count_if(F.col("drawn").isNotNull() & F.col("again").isNull()).alias("missing"), F.count_if(F.col("drawn").isNull() & F.col("again").isNotNull()).alias("extra"),
    )
    say = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    reason = F.array_join(F.array_compact(F.array(say("missing", " sampled pairs not graded again"), say("extra", " pairs graded again outside the sample"))), "; ")
    return counted.withColumn("reason", reason)


def length_span(sizes: DataFrame, piloted: DataFrame) -> DataFrame:
    """One row: shortest and longest length (n_chars) of the piloted transcripts, and the mean of all."""
    marked = sizes.join(piloted.select("transcript", F.lit(True).alias("pilot")).distinct(), "transcript", "left")
    own = F.when(F.col("pilot"), F.col("n_chars"))
    return marked.agg(F.count("*").alias("n"), F.count("pilot").alias("n_piloted"), F.min(own).alias("shortest"), F.max(own).alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean"))


def clamp(e: Column) -> Column:
    """An exponent, held between 0 and 1."""
    return F.least(F.greatest(e, F.lit(0.0)), F.lit(1.0))


def candidates(fit: DataFrame) -> DataFrame:
    """(name, e, measured, informative): the fitted exponent, one standard error less and more, and the two fixed ones.

    The shift comes before the clamp. Without a fit its exponent is 0 and not measured; a
    standard error above 0.5 tells nothing.
    """
    known = F.col("slope").isNotNull()
    moved = [F.struct(F.lit(n).alias("name"), F.when(known, clamp(F.col("slope") + F.lit(s) * F.coalesce("se", F.lit(0.0)))).otherwise(0.0).alias("e"), known.alias("measured"), (known & (F.coalesce("se", F.lit(0.0)) <= 0.5)).alias("informative")) for n, s in SHIFTS.items()]
    fixed = [F.struct(F.lit(n).alias("name"), F.lit(e).alias("e"), F.lit(True).alias("measured"), F.lit(True).alias("informative")) for n, e in FLAT.items()]
    return fit.select(F.explode(F.array(*moved, *fixed)).alias("c")).select("c.*")


def projected(fit: DataFrame, sizes: DataFrame, piloted: DataFrame, spent: DataFrame) -> DataFrame:
    """(name, e, factor, measured, informative, stage, tokens): what each candidate projects for the whole corpus.

    sizes (transcript, n_chars); piloted (transcript); spent (stage, tokens), the pilot's.
    All candidates are summed in one pass over the sizes.
    """
    dim = candidates(fit)
    marked = sizes.join(piloted.select("transcript", F.lit(True).alias("pilot")).distinct(), "transcript", "left")
    p = F.pow(F.col("n_chars"), F.col("e"))
    factors = marked.crossJoin(F.broadcast(dim)).groupBy("name", "e", "measured", "informative").agg((F.sum(p) / F.sum(F.when(F.col("pilot"), p))).alias("factor"))
    return factors.crossJoin(spent).select("name", F.round("e", 6).alias("e"), F.round("factor", 6).alias("factor"), "measured", "informative", "stage", F.bround(F.col("tokens") * F.col("factor")).cast("bigint").alias("tokens"))


def bound(projections: DataFrame) -> DataFrame:
    """One row: the candidate that projects most in sum over the stages, and how much."""
    sums = projections.groupBy("name").agg(F.sum("tokens").alias("tokens"))
    return sums.agg(F.max(F.struct("tokens", "name")).alias("m")).select("m.name", "m.tokens")
