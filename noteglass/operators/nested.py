"""Nested session records as flat tables that keep their parent links.

A session is one JSON tree. A bottom-up tree automaton gives every node a state, once, from
its label set and the states of its children; the state is the structural variant, and each
variant is routed to the table of its subtype. Both runs over the tree, up for the states
and down for the rows, keep their own stack, so depth is bounded by the JSON reader alone:

    STR REF                 -> block       (text, ref)
    TURN                    -> turn        (the turn's type)
    MARKS EXPO              -> marker, exposure
    SESSION WRAP DIVISION   -> session     (plain, wrapped, divided)

All subtypes share the common keys rec, kind, i, j, node and parent.

Defined cases: a bare string or object where a list is expected counts as a list of one;
null, missing and empty values give no child; a payload that isn't one JSON document
gives no rows (a byte order mark, or JSON text inside a JSON string, is still one);
unknown labels are kept out of the tables; nesting too deep for the reader gives no rows,
and a value too deep to be written as text is null.
A record that was delivered twice gives its rows once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL, STR, SCALAR, LIST, REF, EXPO, TURN, DIVISION, SESSION, WRAP, OTHER = "null str scalar list ref expo turn division session wrap other".split()
CONTAINERS = {DIVISION, SESSION, WRAP}
COMMON = ["rec", "kind", "i", "j", "label", "node", "parent", "variant"]
#: Typed columns of each subtype, beside the common ones.
SUBTYPES = {
    "session": {"session_id": "string", "title": "string", "schema_version": "int", "centrality": "string", "chattiness": "string", "notes": "string"},
    "turn": {"tool": "string", "command": "string", "ok": "boolean", "meta": "string"},
    "block": {"text": "string", "file": "string", "match": "string", "before": "int", "after": "int", "prefix": "string"},
    "exposure": {"canary": "string", "form": "string"},
    "marker": {},
}
TYPED = {name: kind for part in SUBTYPES.values() for name, kind in part.items()}


def parse(payload: str | None):
    """The JSON document of a payload, or None: byte order marks dropped, quoted JSON unquoted."""
    try:
        value = payload
        while isinstance(value, str):
            value = json.loads(value.lstrip("﻿"))
        return value
    except (ValueError, RecursionError):
        return None


def listed(value) -> list:
    """A bare value is a list of one; null and empty values are none."""
    if value is None or value == "" or value == {}:
        return []
    return value if isinstance(value, list) else [value]


def children(node) -> Iterable:
    return node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()


def leaf(node) -> str:
    """State of a node without children of its own."""
    return NULL if node is None else STR if isinstance(node, str) else SCALAR


def transition(node, below: set[str]) -> str:
    """Transition of the automaton, from a node's labels and the states of its children."""
    if isinstance(node, list):
        return WRAP if below & CONTAINERS else LIST
    if isinstance(node.get("canary"), str):
        return EXPO
    if "turns" in node or "segments" in node or "exposes" in node:
        return SESSION if "id" in node or "exposes" in node or "segments" in node else DIVISION
    if isinstance(node.get("type"), str):
        return TURN
    if "file" in node:
        return REF
    if below & CONTAINERS:
        return WRAP
    return SESSION if "id" in node else OTHER


def states(tree) -> dict[int, str]:
    """State of every object and list, by identity: children before their parents, each once."""
    out: dict[int, str] = {}
    stack = [(tree, False)] if isinstance(tree, (dict, list)) else []
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack.extend((x, False) for x in children(node) if isinstance(x, (dict, list)))
        else:
            out[id(node)] = transition(node, {out[id(x)] for x in children(node) if isinstance(x, (dict, list))})
    return out


class Walk:
    """Rows of one record: turns count on through everything that wraps or divides a session."""

    def __init__(self, rec: str, found: dict[int, str]):
        self.rec, self.found, self.turns, self.exposures = rec, found, 0, 0
        self.rows: list[dict] = []

    def state(self, node) -> str:
        return self.found[id(node)] if isinstance(node, (dict, list)) else leaf(node)

    def emit(self, kind: str, i: int, j: int, label, variant: str, parent: str, **typed) -> str:
        node = {"session": self.rec, "turn": f"{self.rec}#t{i}", "block": f"{self.rec}#t{i}.{j}", "exposure": f"{self.rec}#e{i}", "marker": f"{self.rec}#e{i}.{j}"}[kind]
        self.rows.append({"rec": self.rec, "kind": kind, "i": i, "j": j, "label": label, "node": node, "parent": parent, "variant": variant} | typed)
        return node

    def run(self, tree) -> None:
        """Rows of a tree in document order; what is still to do is kept on a stack."""
        todo = [(tree, "")]
        while todo:
            node, wrapped = todo.pop()
            kind = self.state(node)
            if kind in CONTAINERS:
                todo.extend(reversed(list(self.container(node, kind, wrapped))))
            elif isinstance(node, dict):
                self.turn(node)

    def container(self, node, kind: str, wrapped: str) -> Iterator[tuple]:
        """Emit what a container holds itself; yields its containers and turns, in order."""
        if isinstance(node, list):
            yield from ((x, wrapped or "wrapped") for x in node if self.state(x) in CONTAINERS or self.state(x) == TURN)
            return
        if kind == WRAP:
            yield from ((x, "wrapped") for x in node.values() if self.state(x) in CONTAINERS)
            return
        if kind == SESSION:
            axes = node.get("axes") if isinstance(node.get("axes"), dict) else {}
            variant = "_".join(filter(None, [wrapped, "divided" if "segments" in node else "plain"]))
            self.emit("session", -1, -1, text(node.get("id")), variant, None, session_id=text(node.get("id")), title=text(node.get("title")), schema_version=number(node.get("schema_version")), centrality=text(axes.get("centrality")), chattiness=text(axes.get("chattiness")), notes=text(node.get("notes")))
        for x in listed(node.get("exposes")):
            self.exposure(x)
        for key in ("turns", "segments"):
            yield from ((x, wrapped) for x in listed(node.get(key)) if isinstance(x, dict) or self.state(x) in CONTAINERS)

    def turn(self, node: dict) -> None:
        i, kind = self.turns, text(node.get("type"))
        self.turns += 1
        own = self.emit("turn", i, -1, kind, f"turn.{kind}", self.rec, tool=text(node.get("tool")), command=text(node.get("command")), ok=node.get("ok") if isinstance(node.get("ok"), bool) else None, meta=sorted_text(node.get("meta")))
        names = ("body", "result", "text") if kind == "tool" else ("body", "text", "result")
        for j, x in enumerate(listed(next((node[k] for k in names if node.get(k) is not None), None))):
            if isinstance(x, dict):
                label = "ref" if x.get("text") is None else "text"
                self.emit("block", i, j, label, f"block.{label}", own, text=text(x.get("text")), file=text(x.get("file")), match=text(x.get("match")), before=number(x.get("before")), after=number(x.get("after")), prefix=text(x.get("prefix")))
            elif x is not None:
                self.emit("block", i, j, "text", "block.text", own, text=text(x))

    def exposure(self, node) -> None:
        i = self.exposures
        if node is None:
            return
        self.exposures += 1
        body = node if isinstance(node, dict) else {"canary": node}
        own = self.emit("exposure", i, -1, text(body.get("canary")), "exposure", self.rec, canary=text(body.get("canary")), form=text(body.get("form")))
        for j, x in enumerate(listed(body.get("markers"))):
            if x is not None:
                self.emit("marker", i, j, text(x), "marker", own)


def text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value)
    except RecursionError:
        return None


def sorted_text(value) -> str | None:
    try:
        return None if value is None else json.dumps(value, sort_keys=True)
    except RecursionError:
        return None


def number(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**31 else None


def rows(rec: str, payload: str | None) -> list[dict]:
    """All rows of one record, the session's own first."""
    tree = parse(payload)
    walk = Walk(rec, states(tree))
    if walk.state(tree) in CONTAINERS:
        walk.run(tree)
    return walk.rows


def flatten(records: DataFrame, columns: Iterable[str] | None = None, kinds: Iterable[str] = tuple(SUBTYPES)) -> DataFrame:
    """Rows of all variants, for records (rec, payload). columns: the wanted ones of COMMON and TYPED."""
    names = list(columns or [*COMMON, *TYPED])
    kinds = set(kinds)
    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [TYPED.get(c, "int" if c in "ij" else "string") for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for rec, payload in zip(batch.column("rec").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if rec is not None:
                    out += [r for r in rows(rec, payload) if r["kind"] in kinds]
                if len(out) > 50_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    def pack(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], type=arrow[t]) for c, t in zip(names, types, strict=True)], names=names)

    return records.select("rec", "payload").mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)))


def subtype(nodes: DataFrame, kind: str) -> DataFrame:
    """The typed table of one subtype, out of flatten()'s rows; each row once."""
    return nodes.where(F.col("kind") == kind).select(*COMMON, *SUBTYPES[kind]).distinct()


def sessions(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """(rec, payload) of typed sessions and of delivered files, in one relation."""
    typed = transcripts.select(F.concat(F.lit("session:"), "id").alias("rec"), F.to_json(F.struct("id", "title", "schema_version", "axes", "notes", "exposes", "turns")).alias("payload"))
    return typed.unionByName(files.select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("rec"), "payload"))


def child_rows(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """(rec, kind, i, j, label) of every child of every session; only what children need is read."""
    typed = transcripts.select(
        F.concat(F.lit("session:"), "id").alias("rec"),
        F.to_json(
            F.struct(
                F.lit("").alias("id"),
                "exposes",
                F.transform("turns", lambda t: F.struct(t["type"].alias("type"), F.transform(t["body"], lambda b: F.when(b.isNotNull(), F.struct(F.when(b["text"].isNotNull(), F.lit("x")).alias("text")))).alias("body"))).alias("turns"),
            )
        ).alias("payload"),
    )
    both = typed.unionByName(files.select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("rec"), "payload"))
    return flatten(both, ["rec", "kind", "i", "j", "label"], set(SUBTYPES) - {"session"}).distinct()
