"""Linking, order and validation against plain Python."""
import json
import random

import pytest

from filings_engine.llm import tool_calls as T

SCHEMA = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 9}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"enum": [1, "x"]}}}}


@pytest.mark.parametrize("text,errors", [
    ('{"a": 1}', []), ('{"b": ["x"], "a": 1.0, "c": "x"}', []), ('{"a": true}', ["$.a: not integer"]), ('{"a": 11, "z": 0}', ["$.a: maximum", "$.z: unknown"]),
    ('{"b": [1]}', ["$.a: missing", "$.b[0]: not string"]), ('{"a": 1, "a": 1}', ["not JSON"]), ("[]", ["$: not object"]), ("{", ["not JSON"]), (None, ["no arguments"]),
    ('{"a": NaN}', ["not JSON"]), ('{"a": 1e999}', ["not JSON"]), ('{"a": 1, "c": 2}', ["$.c: not in enum"]), ("[" * 100000, ["not JSON"]), ('"\\ud800"', ["not JSON"])])
def test_validation(text, errors):
    assert T.check_arguments("f", text, SCHEMA)[1] == errors


@pytest.mark.parametrize("schema, value, errors", [
    ({"type": ["string", "null"]}, None, []), ({"type": ["string", "null"]}, 1, ["$: not string or null"]), ({"type": ["integer", "boolean"]}, True, []),
    (True, {"a": 1}, []), (False, 1, ["$: not allowed"]), ({}, [1], []), ({"properties": {"a": False, "b": True}}, {"a": 1, "b": 2}, ["$.a: not allowed"]),
    ({"enum": [1]}, True, ["$: not in enum"]), ({"enum": [1]}, 1.0, []), ({"enum": [[0, {"a": False}]]}, [0, {"a": 0}], ["$: not in enum"]), ({"enum": [None, [1]]}, [1], []),
    ({"additionalProperties": {"type": "integer"}}, {"x": "y", "z": 1}, ["$.x: not integer"]), ({"items": False}, [], []), ({"items": False}, [1], ["$[0]: not allowed"])])
def test_schema_forms(schema, value, errors):
    assert T.violations(value, schema) == errors


def test_canonical():
    assert T.canonical(json.loads('{"b": [1, 2.50, "é\\n"], "a": {"y": null, "x": true}}')) == '{"a":{"x":true,"y":null},"b":[1,2.5,"é\\n"]}'


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, name string"


def test_links(spark):
    ok = '{"a": 1}'
    calls = [(1, 0, "x", "f", ok, [], "z"), (1, 2, "y", "f", ok, ["x", "none"], "z"), (1, 4, "y", "f", "{}", None, "z"), (1, 6, "w", "g", ok, None, "z"),
             (None, 0, "x", "f", ok, [], "z"), (1, 0, None, "f", None, [], "z"), (2, 0, "x", None, ok, ["x"], "z"), (2, 1, "v", "f", ok, ["x"], "z"), (2, 1, "u", "f", ok, ["t"], "z"), (2, 3, "t", "f", ok, None, "z")]
    results = [(1, 1, "x", "first", "z"), (1, 3, "x", "second", "z"), (2, 5, "q", "lost", "z"), (None, 1, "x", "none", "z"), (2, 9, "t", None, "z")]
    got = T.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA).collect()
    by = {(r.conv_id, r.call_id): (r.position, r.status, r.repeats, r.valid) for r in got}
    assert len(got) == len(by) == 10
    assert by[1, "x"] == (0, "linked", 0, True) and by[1, "y"] == (1, "no_result", 1, True) and by[1, "w"] == (2, "no_result", 0, False)
    assert by[None, "x"][1] == by[1, None][1] == "no_id" and by[2, "q"][:2] == (None, "no_call")
    assert by[2, "x"][1] == by[2, "v"][1] == "cycle" and by[2, "t"][0] < by[2, "u"][0] and by[2, "t"][1] == "linked"
    record = next(r.record for r in got if (r.conv_id, r.call_id) == (1, "x"))
    assert record == '{"arguments":{"a":1},"id":"x","name":"f","result":"first","status":"linked"}'
    assert T.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMA).count() == 0


def test_order_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(T, "TURNS_A_BLOCK", 3)
    r = random.Random(4)
    calls, cyclic = [], set()
    for conv in range(12):
        n = r.randrange(1, 15)
        order = r.sample(range(n), n)                       # a hidden order without cycles
        needs = {v: [order[j] for j in range(i) if r.random() < 0.2] for i, v in enumerate(order)}
        if conv % 4 == 3 and n > 2:
            needs[order[0]].append(order[2])
            needs[order[2]].append(order[0])
            cyclic.add(conv)
        calls += [(conv, v, f"c{v:02d}", "f", "{}", [f"c{x:02d}" for x in needs[v]], "") for v in range(n)]
    got = T.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMA).collect()
    place = {(x.conv_id, x.call_id): (x.position, x.status) for x in got}
    for conv in range(12):
        own = [c for c in calls if c[0] == conv]
        assert sorted(place[conv, c[2]][0] for c in own) == list(range(len(own)))
        for c in own:
            for need in c[5]:
                if place[conv, c[2]][1] != "cycle":
                    assert place[conv, need][0] < place[conv, c[2]][0]
        assert any(place[conv, c[2]][1] == "cycle" for c in own) == (conv in cyclic)


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "find\nit"), (1, 1, "assistant", "found"), (1, 2, "user", None), (None, 0, "user", "x"), (2, 0, None, "x"), (2, 1, "assistant", "y"), (1, 0, "user", "find\nit")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r.status for r in T.link_calls(*T.calls_of_turns(turns), T.SCHEMAS).collect()}
    assert got == {(1, "call_0"): "linked", (1, "call_2"): "no_result", (None, "call_0"): "no_id", (2, "call_0"): "no_call"}


def test_every_call_and_result_has_a_row(spark):
    ok, bad = '{"a": 1}', "{"
    calls = [(1, 0, "c", "f", ok, [], ""), (1, 2, "c", "f", bad, ["c"], ""), (1, 3000, "c", "f", ok, ["c", "d"], ""), (1, 4, "d", "f", ok, ["c"], ""),
             (None, 0, "c", "f", ok, [], ""), (2, 0, "s", "f", ok, ["s"], ""), (2, 1, "s", "f", ok, ["s"], "")]
    results = [(1, 1, "c", "r0", ""), (1, 3, "c", "r1", ""), (1, 5, "d", "r2", ""), (1, 6, "d", "r3", ""), (1, 7, "q", "r4", ""), (1, 8, "q", "r5", ""), (None, 9, "c", "r6", ""), (1, 9, None, "r7", "")]
    got = T.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA, every=True).collect()
    rows = [(r.conv_id, r.position, r.call_id, r.status, r.repeats, r.valid, json.loads(r.record)["result"]) for r in got]
    assert sorted(rows, key=str) == sorted([
        (1, 0, "c", "linked", 0, True, "r0"), (1, 1, "c", "linked", 1, False, "r1"), (1, 2, "d", "linked", 0, True, "r2"), (1, 3, "c", "no_result", 2, True, None),
        (None, None, "c", "no_id", 0, True, None), (2, 0, "s", "cycle", 0, True, None), (2, 1, "s", "cycle", 1, True, None),
        (1, None, "d", "extra_result", 0, True, "r3"), (1, None, "q", "no_call", 0, True, "r4"), (1, None, "q", "no_call", 0, True, "r5"),
        (None, None, "c", "no_id_result", 0, True, "r6"), (1, None, None, "no_id_result", 0, True, "r7")], key=str)
