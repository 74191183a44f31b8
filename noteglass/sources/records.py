"""Readers and writers: sessions, run records, grades, decisions, manifests, reports.

Readers have fixed schemas and never infer. Directories are read in parallel by Spark; only
dimensions (manifests, keys) are parsed on the driver, after their size is known.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEEDLES = "id string, category string, canary_string string, entropy_tail string, target_file string, context string, referential_markers array<string>, slot string"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
RUNS = f"stage string, condition string, transcript string, sample int, output string, model string, effort string, prompt_hash string, usage {USAGE}, git_sha string, created_at string, stop_reason string, raw_output string"
GRADES = "arm string, condition string, transcript string, sample int, canary string, located boolean, precise boolean, note string, round string, rubric_sha256 string"
DECISIONS = "item string, located string, precise string, note string"
MOST_BYTES = 16_000_000


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, payload) of every JSON session below a folder, whole."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("payload"))


def runs(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Run records below a folder. strict: the first unreadable file fails the read; else it has ``bad`` set."""
    read = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json")
    if strict:
        return read.schema(RUNS).option("mode", "FAILFAST").json(folder)
    rows = read.schema(RUNS + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.withColumn("bad", F.col("_corrupt").isNotNull()).withColumn("path", F.col("_metadata.file_path")).drop("_corrupt")


def readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the paths of bad ones."""
    return rows.where("not bad").drop("bad", "path"), rows.where("bad").select("path").distinct()


def grades(spark: SparkSession, path: str) -> DataFrame:
    """Grades of a JSON array file; other keys are ignored."""
    return spark.read.schema(GRADES).option("multiLine", True).option("mode", "FAILFAST").json(path)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions as written, with what is wrong about each in ``fault``: no item, repeated item, no boolean."""
    rows = spark.read.schema(DECISIONS).option("multiLine", True).json(path)
    twice = rows.groupBy("item").agg(F.count("*").alias("_n"))
    flag = lambda c: F.lower(F.col(c)).isin("true", "false")
    fault = F.when(F.col("item").isNull() | (F.col("item") == ""), "no item").when(F.col("_n") > 1, "item repeated").when(~F.coalesce(flag("located"), F.lit(False)), "located is no boolean").when(F.col("precise").isNotNull() & ~flag("precise"), "precise is no boolean")
    return rows.join(twice, "item", "left").select("item", F.col("located").try_cast("boolean").alias("located"), F.col("precise").try_cast("boolean").alias("precise"), "note", fault.alias("fault"))


def key(spark: SparkSession, path: str) -> DataFrame:
    """(item, arm, condition, transcript, sample, needle) of a key file."""
    whole = spark.read.schema("round string, rubric_sha256 string, evidence boolean, items map<string,array<string>>").option("multiLine", True).json(path)
    items = whole.select(F.explode("items").alias("item", "p"))
    return items.select("item", F.col("p")[0].alias("arm"), F.col("p")[1].alias("condition"), F.col("p")[2].alias("transcript"), F.col("p")[3].cast("int").alias("sample"), F.col("p")[4].alias("needle"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Needles of a YAML or JSON manifest; an empty one is empty. Unknown or missing fields raise."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError("a manifest is a dimension; this file is too large for one")
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        rows = json.loads(text or "[]")
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML manifests need a YAML reader; use JSON") from e
        rows = yaml.safe_load(text)
    rows = rows.get("canaries", rows) if isinstance(rows, dict) else rows or []
    names = [c.split()[0] for c in NEEDLES.split(", ")]
    for k, row in enumerate(rows):
        if set(row) | {"slot"} != set(names):
            raise ValueError(f"entry {k}: fields {sorted(set(row) ^ set(names))} are unknown or missing")
    return spark.createDataFrame([tuple(row.get(n, "file" if n == "slot" else None) for n in names) for row in rows], NEEDLES)


def sections(text: str) -> dict[str, str]:
    """Bodies of the ``## name`` sections of a prompt."""
    parts = re.split(r"(?m)^## +", text)[1:]
    return {head.strip(): body.strip() for head, _, body in (p.partition("\n") for p in parts)}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, by their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def slug(value: Column) -> Column:
    """Safe path component."""
    safe = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^A-Za-z0-9._-]", "_")
    return F.when(safe.rlike(r"^\.*$"), F.lit("_")).otherwise(safe)


def write_runs(rows: DataFrame, path: str) -> None:
    """Records by stage, condition and transcript; a partition that is written again replaces its old self, atomically."""
    named = rows.withColumns({f"{c}_dir": slug(F.col(c)) for c in ("stage", "condition", "transcript")})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage_dir", "condition_dir", "transcript_dir").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each small report table; an empty one raises before anything is written."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"nothing to write for {', '.join(empty)}")
    for name, df in tables.items():
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
        flat.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_json(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A small artefact as one canonical file: sorted keys, indent 2, final line feed. The number of rows is checked."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("too many rows for one file; write them with Spark")
    data = sorted((r.asDict(recursive=True) for r in got), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, default=str, ensure_ascii=False) + "\n", encoding="utf-8")
