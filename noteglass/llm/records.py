"""Texts of the session tables as rows (rec, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteglass.session import table


def result_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(rec, text): result text of every tool turn; null when the turn has no text.

    A row that was delivered twice comes twice here; queries end in distinct rows.
    """
    turns = table(spark, folder, "transcripts").select(
        "id", F.posexplode(F.transform("turns", lambda t: F.struct(t["type"].alias("type"), t["body"]["text"].alias("texts")))).alias("turn", "t")
    )
    return turns.where("t.type = 'tool'").select(
        F.concat_ws(":", F.lit("result"), "id", F.col("turn").cast("string")).alias("rec"), F.array_join("t.texts", "\n").alias("text")
    )


def _field(name: str) -> Column:
    return F.struct(F.concat(F.lit(f"{name}:"), F.col("dist_id").cast("string")).alias("rec"), F.col(name).alias("text"))


def note_texts(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """(rec, text) of the named text fields of distillations, from one scan."""
    rows = table(spark, folder, "distillations").select(F.explode(F.array(*map(_field, fields or ("note",)))).alias("r"))
    return rows.select("r.rec", "r.text")


def passages(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """Fields of distillations and result texts in one relation, without null or empty texts."""
    return note_texts(spark, folder, *fields).unionByName(result_texts(spark, folder)).where("length(text) > 0")
