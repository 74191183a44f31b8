"""Text functions on columns: normal form, markers, lines, entropy, token shapes, spans.

White space and word characters are Unicode's; lines break where an editor breaks them.
Null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def planted_value(label: Column, tail: Column) -> Column:
    """label, or label-tail where there is a tail."""
    return F.when(F.coalesce(tail, F.lit("")) == "", label).otherwise(F.concat_ws("-", label, tail))


def normalise(text: Column) -> Column:
    """White space collapsed to single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE + "+", " ")))


def marker_regex(marker: Column) -> Column:
    """Pattern that finds a normalised marker as a whole token only."""
    quoted = F.regexp_replace(marker, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)"))


def fired_markers(markers: Column, normal: Column) -> Column:
    """Those of an array of markers that stand in a normalised text."""
    return F.filter(markers, lambda m: F.contains(normal, normalise(m)) & F.regexp_like(normal, marker_regex(normalise(m))))


def lines(text: Column) -> Column:
    """Lines of a text, without an empty one after a final break."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def entropy(token: Column) -> Column:
    """Shannon bits per character; 0 for the empty token."""
    length = F.length(token)

    def share(c: Column) -> Column:
        p = (length - F.length(F.replace(token, c, F.lit("")))) / length
        return -p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(token, ""), lambda c: c != ""))
    return F.when(length == 0, F.lit(0.0)).otherwise(F.aggregate(F.transform(chars, share), F.lit(0.0), lambda a, x: a + x))


def whole(text: Column, pattern: str) -> Column:
    """Does all of the text match?"""
    return text.rlike(rf"\A(?:{pattern})\z")


def classes(token: Column) -> Column:
    """How many of lower case, upper case and digits a token has."""
    return sum((F.when(token.rlike(p), 1).otherwise(0) for p in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}")), F.lit(0))


SPANS = "array<struct<start:int,end:int,rule:string,text:string>>"


def spans(text: Column, pattern: str, group: int = 0, rule: str = "", keep=None) -> Column:
    """array<struct<start, end, rule, text>> of a pattern's matches; offsets from 0, end excluded.

    The pattern must not match the empty string. With a group, the span is the group's and
    the pattern must have just two groups: what stands before it, and itself. keep: which
    matches count, by what stands before and by the span's text. The text is scanned for
    the matches and for what lies between them; groups are read from the matches alone.
    """
    # zipped once: what a lambda refers to from outside is evaluated again for every element
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        here, found = acc["at"] + F.length(part["between"]), part["found"]
        lead, inner = (F.regexp_extract(found, pattern, 1), F.regexp_extract(found, pattern, 2)) if group else (F.lit(""), found)
        first = here + F.length(lead)
        span = F.struct(first.cast("int").alias("start"), (first + F.length(inner)).cast("int").alias("end"), F.lit(rule).alias("rule"), inner.alias("text"))
        out = F.concat(acc["out"], F.array(span))
        more = F.struct((here + F.length(found)).cast("int").alias("at"), (out if keep is None else F.when(keep(lead, inner), out).otherwise(acc["out"])).alias("out"))
        return F.when(found.isNull(), acc).otherwise(more)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def disjoint(found: Column) -> Column:
    """Spans without overlaps: the earliest, then longest wins, then the rule that comes first in the array."""
    kind = "array<struct<start:int,end:int,rule:string,text:string>>"
    keyed = F.array_sort(F.transform(found, lambda s, k: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), k.alias("k"), s.alias("s"))))
    init = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))
    return F.aggregate(
        keyed, init,
        lambda acc, x: F.when(x["s"]["start"] < acc["end"], acc).otherwise(F.struct(x["s"]["end"].alias("end"), F.concat(acc["out"], F.array(x["s"])).alias("out"))),
        lambda acc: acc["out"],
    )


def replaced(text: Column, found: Column, mark: str) -> Column:
    """The text with every span replaced; the spans are disjoint and in order."""
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        found, init,
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
