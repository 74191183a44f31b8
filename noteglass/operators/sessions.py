"""Sessions: rendering, turn grammar, file references, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(transcripts: DataFrame) -> DataFrame:
    return transcripts.dropDuplicates(["id"])


def body(turn: Column) -> Column:
    """Text pieces of a turn, in order; references don't count."""
    return F.coalesce(F.array_join(turn["body"]["text"], "\n"), F.lit(""))


def rendered() -> Column:
    """[type] blocks, tool blocks with their command and result or error, blank lines between."""
    tag = lambda t: F.when(F.coalesce(t["ok"], F.lit(True)), "result").otherwise("error")
    tool = lambda t: F.concat(F.lit("[tool:"), F.coalesce(t["tool"], F.lit("")), F.lit("] "), F.coalesce(t["command"], F.lit("")), F.lit("\n["), tag(t), F.lit("]\n"), body(t), F.lit("\n[/"), tag(t), F.lit("]"))
    plain = lambda t: F.concat(F.lit("["), F.coalesce(t["type"], F.lit("")), F.lit("]\n"), body(t))
    blocks = F.transform("turns", lambda t: F.coalesce(F.when(t["type"] == "tool", tool(t)).otherwise(plain(t)), F.lit("")))
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n"))


def render(transcripts: DataFrame) -> DataFrame:
    """(id, text) of the sessions that have turns."""
    return transcripts.select("id", rendered().alias("text")).where("text is not null")


def violations(transcripts: DataFrame, least_chars: int = 0) -> DataFrame:
    """(id, rule) of sessions against the turn grammar: first user, last assistant, each kind at least once, tools with tool and command.

    least_chars: fewest characters of a rendered session; 0 leaves the rule out.
    """
    kinds = F.transform("turns", lambda t: t["type"])
    rules = {
        "no turns": F.coalesce(F.size("turns"), F.lit(0)) <= 0,
        "first turn isn't the user's": F.get(kinds, F.lit(0)) != "user",
        "last turn isn't the assistant's": F.try_element_at(kinds, F.lit(-1)) != "assistant",
        "a kind of turn is missing": (F.size("turns") > 0) & ~(F.array_contains(kinds, "user") & F.array_contains(kinds, "assistant") & F.array_contains(kinds, "tool")),
        "unknown kind of turn": F.exists(kinds, lambda k: ~k.isin("user", "assistant", "tool")),
        "tool turn without tool": F.exists("turns", lambda t: (t["type"] == "tool") & t["tool"].isNull()),
        "tool turn without command": F.exists("turns", lambda t: (t["type"] == "tool") & t["command"].isNull()),
        "exposures not sorted": ~F.coalesce(F.transform("exposes", lambda e: e["canary"]) == F.array_sort(F.transform("exposes", lambda e: e["canary"])), F.lit(True)),
        "exposure repeated": F.size(F.array_distinct(F.transform("exposes", lambda e: e["canary"]))) < F.size("exposes"),
        "carriage return": F.exists("turns", lambda t: F.contains(body(t), F.lit("\r"))),
    }
    if least_chars > 0:
        rules["too few characters"] = F.length(rendered()) < least_chars
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return transcripts.select("id", F.explode(named).alias("rule"))


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (ref_id, file, match, before, after, prefix) with their text and status.

    files (file, content). Without match the whole file; else the one line that contains
    it, with its window, each line prefixed. Paths must be relative and stay inside.
    """
    safe = ~(F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)"))
    joined = refs.withColumn("safe", safe).join(files, "file", "left")
    lines = F.split(F.regexp_replace("content", r"\n+\z", ""), "\n", -1)
    hits = F.filter(F.transform(lines, lambda x, k: F.when(F.contains(x, F.col("match")), k)), lambda k: k.isNotNull())
    first = F.get(hits, F.lit(0))
    start = F.greatest(first - F.coalesce("before", F.lit(0)), F.lit(0))
    stop = first + F.coalesce("after", F.lit(0)) + 1
    window = F.array_join(F.transform(F.slice(lines, start + 1, stop - start), lambda x: F.concat(F.coalesce("prefix", F.lit("")), x)), "\n")
    status = F.when(~F.col("safe"), "unsafe path").when(F.col("content").isNull(), "no such file").when(F.col("match").isNotNull() & (F.size(hits) != 1), F.concat(F.size(hits).cast("string"), F.lit(" matching lines"))).otherwise("ok")
    marked = joined.withColumn("status", status)
    return marked.select("ref_id", "status", F.when(F.col("status") == "ok", F.when(F.col("match").isNull(), F.array_join(lines, "\n")).otherwise(window)).alias("text"))


def exposed(transcripts: DataFrame) -> DataFrame:
    """(transcript, needle, form, markers) as declared."""
    rows = once(transcripts).select(F.col("id").alias("transcript"), F.explode("exposes").alias("e"))
    return rows.select("transcript", F.col("e.canary").alias("needle"), "e.form", F.coalesce("e.markers", F.array().cast("array<string>")).alias("markers"))
