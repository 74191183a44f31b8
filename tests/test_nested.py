import json

import pytest

from noteglass.operators import nested

TURNS = [{"type": "user", "text": "hi"}, {"type": "tool", "tool": "read", "command": "read x", "ok": True, "result": ["a", {"file": "x.py"}, {"text": "t", "file": None}]}, {"type": "assistant", "text": None}]
EXPOSES = [{"canary": "c1", "form": "full", "markers": ["m1", "m2"]}, {"canary": "c2", "form": "partial", "markers": "solo"}, {"canary": "c3", "markers": []}]
WANT = {("turn", 0, -1, "user"), ("turn", 1, -1, "tool"), ("turn", 2, -1, "assistant"), ("block", 0, 0, "text"), ("block", 1, 0, "text"), ("block", 1, 1, "ref"), ("block", 1, 2, "text"), ("exposure", 0, -1, "c1"), ("exposure", 1, -1, "c2"), ("exposure", 2, -1, "c3"), ("marker", 0, 0, "m1"), ("marker", 0, 1, "m2"), ("marker", 1, 0, "solo")}


def got(payload):
    return {(r["kind"], r["i"], r["j"], r["label"]) for r in nested.rows("r", payload) if r["kind"] != "session"}


@pytest.mark.parametrize(
    "tree",
    [
        {"id": "s", "turns": TURNS, "exposes": EXPOSES},
        {"exported": "now", "session": {"id": "s", "turns": TURNS, "exposes": EXPOSES}},
        {"id": "s", "exposes": EXPOSES, "segments": [{"label": "a", "turns": TURNS[:1]}, {"turns": TURNS[1:]}]},
        [{"id": "s", "turns": TURNS, "exposes": EXPOSES}],
        {"id": "s", "exposes": EXPOSES, "segments": {"turns": TURNS}},
    ],
)
def test_envelopes_give_the_same_children(tree):
    assert got(json.dumps(tree)) == WANT
    assert got("﻿" + json.dumps(tree)) == WANT
    assert got(json.dumps(json.dumps(tree))) == WANT


@pytest.mark.parametrize("payload", [None, "", "{", '{"a"=1}', "null", "3", '"text"', "[]", "{}", '{"turns": 1}{"turns": 2}', "[" * 5000])
def test_broken_payloads_give_nothing(payload):
    assert got(payload) == set()


def test_bare_values_and_empty_ones():
    assert got(json.dumps({"id": "s", "turns": {"type": "user", "text": {"file": "f"}}, "exposes": "c"})) == {("turn", 0, -1, "user"), ("block", 0, 0, "ref"), ("exposure", 0, -1, "c")}
    assert got(json.dumps({"id": "s", "turns": [{"type": "tool", "result": ""}, {"type": "user"}], "exposes": None})) == {("turn", 0, -1, "tool"), ("turn", 1, -1, "user")}


def test_parents_exist():
    out = nested.rows("r", json.dumps({"id": "s", "turns": TURNS, "exposes": EXPOSES}))
    nodes = {r["node"] for r in out}
    assert all(r["parent"] in nodes for r in out if r["parent"])
    assert len(nodes) == len(out)


def test_typed_and_json_sessions_agree(spark):
    turns = [("user", None, None, None, [("hi", None, None, None, None, None)]), ("tool", "read", "c", True, [(None, "f", None, None, None, None), ("x", None, None, None, None, None)]), ("assistant", None, None, None, None)]
    schema = "id string, title string, schema_version int, axes struct<centrality:string,chattiness:string>, notes string, exposes array<struct<canary:string,form:string,markers:array<string>>>, turns array<struct<type:string,tool:string,command:string,ok:boolean,body:array<struct<text:string,file:string,match:string,before:int,after:int,prefix:string>>>>, rec string"
    one = ("s", "t", 1, None, None, [("c", "full", ["m"]), ("d", "full", None)], turns, "clash")
    typed = spark.createDataFrame([one, one, ("e", None, None, None, None, None, None, None)], schema)
    files = spark.createDataFrame([(1, json.dumps({"id": "s", "turns": TURNS, "exposes": EXPOSES})), (2, None), (1, json.dumps({"id": "s", "turns": TURNS, "exposes": EXPOSES}))], "file_id bigint, payload string")
    rows = nested.child_rows(typed, files).collect()
    assert {tuple(r)[1:] for r in rows if r.rec == "file:1"} == WANT
    assert {tuple(r)[1:] for r in rows if r.rec == "session:s"} == {("turn", 0, -1, "user"), ("turn", 1, -1, "tool"), ("turn", 2, -1, "assistant"), ("block", 0, 0, "text"), ("block", 1, 0, "ref"), ("block", 1, 1, "text"), ("exposure", 0, -1, "c"), ("exposure", 1, -1, "d"), ("marker", 0, 0, "m")}
    assert len(rows) == len(set(rows))
    full = nested.flatten(nested.sessions(typed, files))
    assert nested.subtype(full, "block").where("rec = 'session:s'").count() == 3
    assert nested.subtype(full, "session").count() == 3


def test_empty_tables(spark, data):
    from noteglass.session import table

    t, f = table(spark, data, "transcripts").limit(0), table(spark, data, "transcript_files").limit(0)
    assert nested.child_rows(t, f).count() == 0


CORE = '{"id":"s","turns":[{"type":"user","text":"a"},{"type":"tool","result":["x",{"file":"f"}]}]}'


@pytest.mark.parametrize("payload, n", [('{"a":' * 600 + CORE + "}" * 600, 6), ("[" * 900 + CORE + "]" * 900, 6), ("[" * 5000 + "]" * 5000, 0), ('{"a":' * 100_000 + "1" + "}" * 100_000, 0)])
def test_deep_records(payload, n):
    """Depth costs neither the task nor the rows of what lies below."""
    assert len(nested.rows("r", payload)) == n


def test_every_node_has_one_state():
    tree = nested.parse('{"x": [{"segments": [{"turns": [{"type": "user", "text": "a"}]}], "id": 1}], "y": {"canary": "c"}, "z": {"q": 1}}')
    found = nested.states(tree)
    assert found[id(tree)] == found[id(tree["x"])] == nested.WRAP and found[id(tree["x"][0])] == nested.SESSION and found[id(tree["x"][0]["segments"][0])] == nested.DIVISION
    assert found[id(tree["y"])] == nested.EXPO and found[id(tree["z"])] == nested.OTHER and len(found) == 9
