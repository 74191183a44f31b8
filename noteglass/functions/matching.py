"""All needles in a text by one multi-pattern pass over Arrow batches.

Literals (label, tail, planted value) are searched as written, planted values also in lower
case, markers as whole tokens of the normal form, and parts of planted values and tails
anchor near misses. The three automata are built once for each task from the needles,
which are a dimension: what calls this checks their number and scans in blocks of them.

A text's row comes out once, with an array of the needles that it holds in any way; no row
is made for a text and a needle that have nothing to do with each other.

Defined cases: null text gives a null array, an empty one an empty array; null or empty
labels, tails and markers are never found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

EDITS = 2
HIT = "struct<needle:string,value:boolean,any_case:boolean,label:boolean,tail:boolean,near_value:boolean,near_tail:boolean,markers:array<string>>"
FLAGS = ["value", "any_case", "label", "tail", "near_value", "near_tail"]
_ARROW = pa.list_(pa.struct([("needle", pa.string()), *((f, pa.bool_()) for f in FLAGS), ("markers", pa.list_(pa.string()))]))
_BLANKS = re.compile(r"\s+")


class Needle(NamedTuple):
    needle: str
    label: str
    tail: str
    planted: str
    markers: tuple[str, ...]


def normal(text: str) -> str:
    """White space collapsed to single blanks, trimmed, lower case."""
    return _BLANKS.sub(" ", text).strip().lower()


def wordlike(c: str) -> bool:
    return c.isalnum() or c == "_"


def near(text: str, start: int, needle: str, edits: int = EDITS) -> bool:
    """Does a substring from start lie within that many edits of the needle?"""
    window, far = text[start : start + len(needle) + edits], edits + 1
    above = {j: j for j in range(min(edits, len(window)) + 1)}
    for i, c in enumerate(needle, 1):
        row = {}
        for j in range(max(0, i - edits), min(len(window), i + edits) + 1):
            best = min(above.get(j, far), row.get(j - 1, far)) + 1
            row[j] = min(best, above.get(j - 1, far) + (c != window[j - 1])) if j else i
        if not row or min(row.values()) > edits:
            return False
        above = row
    return any(n <= edits for n in above.values())


class Matcher:
    """Automata of a set of needles."""

    def __init__(self, needles: list[Needle], edits: int = EDITS):
        import ahocorasick

        self.needles, self.edits = needles, edits

        def automaton(words: dict[str, list]):
            made = ahocorasick.Automaton()
            for word, payload in words.items():
                made.add_word(word, (len(word), payload))
            if not words:
                return None
            made.make_automaton()
            return made

        raw: dict[str, list] = {}
        lower: dict[str, list] = {}
        markers: dict[str, list] = {}
        for k, n in enumerate(needles):
            for kind, word in (("label", n.label), ("tail", n.tail), ("value", n.planted)):
                if word:
                    raw.setdefault(word, []).append((k, kind, 0))
            for kind, word in (("near_value", n.planted), ("near_tail", n.tail)):
                size, parts = len(word or ""), edits + 1
                for p in range(parts if size > parts else 0):
                    a, b = p * size // parts, (p + 1) * size // parts
                    raw.setdefault(word[a:b], []).append((k, kind, a))
            if n.planted:
                lower.setdefault(n.planted.lower(), []).append(k)
            for order, m in enumerate(n.markers):
                if m is not None and normal(m):
                    markers.setdefault(normal(m), []).append((k, order))
        self.raw, self.lower, self.markers = automaton(raw), automaton(lower), automaton(markers)

    def literals(self, text: str) -> set[int]:
        """Numbers of the needles whose planted value or tail a text holds."""
        hits = self.raw.iter(text) if self.raw else ()
        return {k for _, (_, payload) in hits for k, kind, _ in payload if kind in ("value", "tail")}

    def spans(self, text: str) -> tuple[list[dict], list[dict], bool]:
        """Places of all literals in a text, of all markers in its normal form, and whether it leaks."""
        literal, marker, leaks = set(), set(), False
        for end, (size, payload) in self.raw.iter(text) if self.raw else ():
            kinds = {kind for _, kind, _ in payload if not kind.startswith("near")}
            if kinds:
                literal.add((end + 1 - size, end + 1))
                leaks |= kinds != {"label"}
        flat = normal(text)
        for end, (size, _) in self.markers.iter(flat) if self.markers else ():
            if self.whole(flat, end + 1 - size, end + 1):
                marker.add((end + 1 - size, end + 1))
        as_rows = lambda spans: [{"start": a, "end": b} for a, b in sorted(spans)]
        return as_rows(literal), as_rows(marker), leaks or bool(marker)

    @staticmethod
    def whole(flat: str, start: int, after: int) -> bool:
        """Does no word go on over the edges of a place?"""
        return not (start and wordlike(flat[start - 1])) and not (after < len(flat) and wordlike(flat[after]))

    def hits(self, text: str, nearly: bool = True) -> list[dict]:
        """One record for each needle that the text holds in any way, in the needles' order."""
        flags: dict[int, set[str]] = {}
        starts: dict[tuple[int, str], set[int]] = {}
        for end, (size, payload) in self.raw.iter(text) if self.raw else ():
            for k, kind, offset in payload:
                if not kind.startswith("near"):
                    flags.setdefault(k, set()).add(kind)
                elif nearly:
                    at = end + 1 - size - offset
                    starts.setdefault((k, kind), set()).update(range(max(0, at - self.edits), max(0, at + self.edits + 1)))
        for _, (_, payload) in self.lower.iter(text.lower()) if self.lower else ():
            for k in payload:
                flags.setdefault(k, set()).add("any_case")
        for (k, kind), places in starts.items():
            exact, word = ("value", self.needles[k].planted) if kind == "near_value" else ("tail", self.needles[k].tail)
            if exact not in flags.get(k, ()) and any(near(text, s, word, self.edits) for s in places):
                flags.setdefault(k, set()).add(kind)
        fired: dict[int, set[int]] = {}
        if self.markers:
            flat = normal(text)
            for end, (size, payload) in self.markers.iter(flat):
                if self.whole(flat, end + 1 - size, end + 1):
                    for k, order in payload:
                        fired.setdefault(k, set()).add(order)
        out = []
        for k in sorted(flags.keys() | fired.keys()):
            n, own = self.needles[k], flags.get(k, ())
            out.append({"needle": n.needle, **{f: f in own for f in FLAGS}, "markers": [n.markers[o] for o in sorted(fired.get(k, ()))]})
        return out


def places(texts: DataFrame, needles: list[Needle], text: str) -> DataFrame:
    """The texts with ``literal`` and ``marker``, the spans (start, end) of all needles in the text and in its normal form, overlaps included, and ``leaks``: does it hold a planted value, a tail or a marker?"""
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(needles)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [found.spans(t or "") for t in batch.column(text).to_pylist()]
            literal, marker, leaks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(literal, type=kind), pa.array(marker, type=kind), pa.array(leaks, type=pa.bool_())], names=[*names, "literal", "marker", "leaks"])

    span = "array<struct<start:int,end:int>>"
    return texts.mapInArrow(run, ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names), f"literal {span}", f"marker {span}", "leaks boolean"]))


def scan(texts: DataFrame, needles: list[Needle], text: str, hits: str = "hits", claims: str | None = None, carried: str = "carried", nearly: bool = True) -> DataFrame:
    """The other columns of texts with ``hits``; claims: an array of strings that becomes the array of the needles it carries."""
    keep = [c for c in texts.columns if c not in (text, claims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(needles)
        for batch in batches:
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array([None if t is None else found.hits(t, nearly) for t in batch.column(text).to_pylist()], type=_ARROW))
            if claims:
                rows = [None if v is None else sorted(set().union(*(found.literals(x) for x in v if x))) for v in batch.column(claims).to_pylist()]
                columns.append(pa.array([None if r is None else [needles[k].needle for k in r] for r in rows], type=pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, hits, *([carried] if claims else [])])

    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), f"`{hits}` array<{HIT}>", *([f"`{carried}` array<string>"] if claims else [])])
    return texts.select(*keep, text, *([claims] if claims else [])).mapInArrow(run, schema)


def collapse(texts: DataFrame, words: list[str], text: str, mark: str) -> DataFrame:
    """The texts with every word replaced by the mark; of overlapping ones the first, then the longest counts."""
    if not words:
        return texts
    names, schema = texts.columns, texts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, len(w))
        found.make_automaton()

        def one(value: str | None) -> str | None:
            spans = sorted((end + 1 - n, -(end + 1)) for end, n in found.iter(value)) if value else []
            out, at = [], 0
            for start, end in spans:
                if start >= at:
                    out += [value[at:start], mark]
                    at = -end
            return "".join([*out, value[at:]]) if spans else value

        for batch in batches:
            columns = [pa.array(list(map(one, batch.column(c).to_pylist())), type=batch.column(c).type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, schema)
