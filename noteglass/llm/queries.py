"""Queries of the language-model data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteglass.llm import credentials, packing, pairs, records, spans, splitting, tokens, truncation
from noteglass.session import table

#: Declared needles are a dimension; beyond this many they would have to be joined instead.
MOST_NEEDLES = 100_000


def declared(spark: SparkSession, folder: str) -> list[str]:
    """Labels, tails and planted values of the declared needles."""
    rows = table(spark, folder, "needles").select("canary_string", "entropy_tail").limit(MOST_NEEDLES + 1).collect()
    if len(rows) > MOST_NEEDLES:
        raise ValueError("too many needles to hold in a scanner")
    return sorted({x for r in rows for x in r if x})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = records.passages(spark, folder, "note", "raw")
    return credentials.scan(texts, declared(spark, folder)).select("rec", "line_no").distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    texts = records.passages(spark, folder, "note", "raw")
    return credentials.scan(texts, declared(spark, folder), redacted=True).dropDuplicates(["rec"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_texts(spark, folder)


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.shares(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.pairs(records.passages(spark, folder, "note"))


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return spans.coverage(records.passages(spark, folder, "note"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.found(spark, folder)


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.found(spark, folder).groupBy("src", "defect").agg(F.count("*").alias("n"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.check(table(spark, folder, "documents"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, folder, "documents"), groups=True))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "documents"))


def p6_exact(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, exact, covers): every document decodes to its text, and its offsets cover it."""
    return tokens.check(table(spark, folder, "documents")).select("doc_id", "exact", "covers")


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, whole, over): do the pieces of a document follow each other without a gap, and is one above the capacity?"""
    packed = packing.pack(table(spark, folder, "documents"))
    each = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.min("start_token").alias("first"), F.max("n_tokens").alias("most"), F.count_distinct("piece").alias("pieces"), F.count("*").alias("rows"))
    return each.select("doc_id", ((F.col("n") == F.col("end")) & (F.col("first") == 0) & (F.col("pieces") == F.col("rows"))).alias("whole"), (F.col("most") > packing.CAPACITY).alias("over"))


def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, whole, over): do the pieces of a split document give its text again, and is one above the limit?

    Documents within the limit are whole as they are.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    part = F.struct("piece", "start_char", "end_char", "n_tokens", "text")
    grouped = splitting.split(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(True).alias("fine"))
    joined = F.aggregate(
        "p", init,
        lambda acc, x: F.struct(x["end_char"].alias("at"), F.concat(acc["out"], F.substring(x["text"], acc["at"] - x["start_char"] + 1, F.length(x["text"]))).alias("out"), (acc["fine"] & (x["start_char"] <= acc["at"])).alias("fine")),
    )
    most = F.array_max(F.transform("p", lambda x: x["n_tokens"]))
    rows = docs.join(grouped.select("doc_id", joined.alias("j"), most.alias("most")), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("j.fine") & (F.col("j.out") == F.col("text")), F.lit(True)).alias("whole"), F.coalesce(F.col("most") > splitting.LIMIT, F.lit(False)).alias("over"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_redacted, p3_found, p3_shares, p4_found, p4_coverage, p5_found, p5_counts, p6_ids, p6_roundtrip, p6_exact, p7_containers, p7_fill, p7_whole, p8_pieces, p8_whole]
    return {f.__name__: f for f in own}


#: Notes and result texts, each record once.
PASSAGES = """x AS (SELECT DISTINCT 'note:' || dist_id AS rec, note AS text FROM distillations UNION
    SELECT DISTINCT 'result:' || id || ':' || (i - 1), array_to_string(list_filter(list_transform(turns[i].body, lambda b: b.text), lambda v: v IS NOT NULL), chr(10))
    FROM (SELECT id, turns, unnest(range(1, len(turns) + 1)) AS i FROM transcripts) WHERE turns[i].type = 'tool'),
  p AS (SELECT rec, text FROM x WHERE length(text) > 0)"""
#: Every window of 200 characters of every record: brute force for common substrings.
WINDOWS = f"""WITH {PASSAGES}, w AS MATERIALIZED (SELECT rec, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT rec, text, unnest(range(1, length(text) - 198)) AS i FROM p WHERE length(text) >= 200)),
  s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT rec) > 1), k AS MATERIALIZED (SELECT w.* FROM w JOIN s USING (h))"""


def oracle_sql() -> dict[str, str]:
    """Results that SQL can give by brute force, and checks whose answer is known for every row.

    The other methods aren't expressible in SQL; the tests hold them against brute force,
    round trips and held-out examples.
    """
    return {
        "p4_found": f"{WINDOWS} SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM (SELECT DISTINCT rec, h FROM k) a JOIN (SELECT DISTINCT rec, h FROM k) b ON a.h = b.h AND a.rec < b.rec",
        "p4_coverage": f"""{WINDOWS}, g AS (SELECT rec, least(200, coalesce(lead(i) OVER (PARTITION BY rec ORDER BY i) - i, 200)) AS fresh FROM (SELECT DISTINCT rec, i FROM k)), t AS (SELECT rec, sum(fresh)::BIGINT AS n FROM g GROUP BY rec)
          SELECT p.rec, length(text)::BIGINT AS n_chars, coalesce(n, 0) AS shared_chars, round(coalesce(n, 0) / length(text), 6) AS share FROM p LEFT JOIN t ON t.rec = p.rec""",
        "p6_exact": "SELECT DISTINCT doc_id, true AS exact, true AS covers FROM documents",
        "p7_whole": "SELECT DISTINCT doc_id, true AS whole, false AS over FROM documents",
        "p8_whole": "SELECT DISTINCT doc_id, true AS whole, false AS over FROM documents",
    }
