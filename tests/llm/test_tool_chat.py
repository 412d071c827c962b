from __future__ import annotations

import json

from pyspark.sql import functions as F

from barloom.llm import tool_chat

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = "name string, key string, kind string, required boolean"
TOOLS = [("f", "a", "integer", True), ("f", "b", "string", False), ("g", "n", "number", True), ("g", "o", "object", False)]


def _run(spark, calls, results=(), tools=TOOLS):
    made = tool_chat.format_calls(
        spark.createDataFrame(list(calls), CALLS).withColumn("position", F.lit("mine")),
        spark.createDataFrame(list(results), RESULTS),
        spark.createDataFrame(list(tools), SCHEMAS),
    )
    return sorted(made.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))


def test_calls_follow_what_they_depend_on(spark):
    calls = [
        (1, 0, "x", "f", '{"a":1}', ["y", "z", "gone", "x"]),
        (1, 2, "y", "f", '{"a":2}', ["z"]),
        (1, 4, "z", "f", '{"a":3}', None),
        (1, 6, "p", "f", '{"a":4}', ["q"]),
        (1, 8, "q", "f", '{"a":5}', ["p"]),
        (2, 0, "y", "f", '{"a":6}', []),
    ]
    rows = _run(spark, calls)
    assert [(r.conv_id, r.position, r.call_id, r.level) for r in rows] == [
        (1, 0, "z", 0), (1, 1, "y", 1), (1, 2, "x", 2), (1, 3, "p", None), (1, 4, "q", None), (2, 0, "y", 0),
    ]


def test_arguments_are_checked(spark):
    cases = {
        '{"b":"é\\n\\"","a":1}': "",
        '{"a":"1"}': "kind:a",
        '{"b":2}': "kind:b;missing:a",
        '{"a":1,"c":null,"d":[1]}': "unknown:c;unknown:d",
        '{"a":1.5}': "kind:a",
        "[1]": "json",
        "{bad": "json",
        None: "json",
    }
    rows = _run(spark, [(1, i, f"c{i}", "f", a, None) for i, a in enumerate(cases)])
    assert [r.errors for r in rows] == list(cases.values())
    assert [r.valid for r in rows] == [e == "" for e in cases.values()]
    rows = _run(spark, [(1, 0, "a", "g", '{"n":1e2,"o":{"z":1,"a":[]}}', None), (1, 1, "b", "none", "{}", None)])
    assert [r.errors for r in rows] == ["", "tool"]


def test_json_is_canonical(spark):
    rows = _run(
        spark,
        [(1, 0, "i", "f", ' { "b" : "x\\u00e9/" , "a" : 7 } ', None), (1, 2, "j", "f", '{"a": "7"}', None)],
        [(1, 1, "i", 'say "hi"\n')],
    )
    assert rows[0].json == '{"arguments":{"a":7,"b":"xé/"},"id":"i","name":"f","result":"say \\"hi\\"\\n","type":"function"}'
    assert json.loads(rows[1].json)["arguments"] == '{"a": "7"}'
    for row in rows:
        assert row.json == json.dumps(json.loads(row.json), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_repeated_missing_and_null_identifiers(spark):
    calls = [
        (1, 4, "i", "f", '{"a":1}', None),
        (1, 2, "i", "f", '{"a":2}', None),
        (1, 6, None, "f", '{"a":3}', ["i"]),
        (None, 0, "i", "f", '{"a":4}', None),
        (1, None, "k", None, None, None),
    ]
    results = [(1, 9, "i", "late"), (1, 3, "i", "early"), (1, 3, None, "nobody"), (1, 1, "lost", "x"), (2, 1, "i", "other")]
    rows = _run(spark, calls, results)
    state = {(r.conv_id, r.turn, r.call_id): (r.status, json.loads(r.json).get("result")) for r in rows}
    assert state == {
        (1, 2, "i"): ("linked", "early"),
        (1, 4, "i"): ("repeated", None),
        (1, 6, None): ("pending", None),
        (1, None, "k"): ("pending", None),
        (None, 0, "i"): ("pending", None),
    }
    assert sorted(r.position for r in rows if r.conv_id == 1) == [0, 1, 2, 3]


def test_positions_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(tool_chat, "STRETCH", 3)
    rows = _run(spark, [(1, t, f"c{t:03}", "f", '{"a":1}', None) for t in range(50)])
    assert [(r.position, r.turn) for r in rows] == [(t, t) for t in range(50)]


def test_exact_repeats_are_kept(spark):
    rows = _run(spark, [(1, 0, "i", "f", '{"a":1}', None)] * 3)
    assert [r.position for r in rows] == [0, 1, 2]


def test_empty_tables(spark):
    assert _run(spark, []) == []
    assert [r.errors for r in _run(spark, [(1, 0, "i", "f", "{}", None)], tools=[])] == ["tool"]


def test_results_without_a_call_of_their_own_are_returned(spark):
    calls = [(1, 2, "i", "f", '{"a":2}', None), (1, 4, None, "f", "{}", None)]
    results = [(1, 9, "i", "late"), (1, 3, "i", "early"), (1, 3, None, "nobody"), (1, 1, "lost", "x"), (None, 3, "i", None)]
    rows = tool_chat.unlinked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    assert sorted((r.status, str(r.call_id), r.content or "") for r in rows) == [
        ("orphan", "None", "nobody"), ("orphan", "i", ""), ("orphan", "lost", "x"), ("repeated", "i", "late"),
    ]


MESSAGES = "conv_id long, turn long, role string, text string"


def _chat(spark, calls, results=(), messages=()):
    made = tool_chat.format_chat(
        spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS),
        spark.createDataFrame(list(messages), MESSAGES), spark.createDataFrame(TOOLS, SCHEMAS),
    )
    return sorted(made.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))


def test_everything_said_has_a_row(spark):
    calls = [(1, 2, "i", "f", '{"a":2}', None), (1, 4, None, "f", "{}", None)]
    results = [(1, 9, "i", "late"), (1, 3, "i", "early"), (1, 3, None, "nobody"), (1, 1, "lost", "x"), (2, 3, "i", None)]
    messages = [(1, 0, "system", "be \"kind\""), (2, 5, None, "odd"), (1, 8, "developer", None)]
    rows = _chat(spark, calls, results, messages)
    assert [(r.conv_id, r.position, r.turn, r.status) for r in rows] == [
        (1, 0, 0, "message"), (1, 1, 8, "message"), (1, 2, 2, "linked"), (1, 3, 1, "orphan"), (1, 4, 3, "orphan"),
        (1, 5, 4, "pending"), (1, 6, 9, "repeated"), (2, 0, 5, "message"), (2, 1, 3, "orphan"),
    ]
    assert rows[0].json == '{"content":"be \\"kind\\"","role":"system","type":"message"}'
    assert rows[3].json == '{"content":"x","id":"lost","type":"result"}'
    assert {r.name for r in rows if r.status not in ("linked", "pending")} == {None}
    assert all(r.valid for r in rows if r.status in ("message", "orphan", "repeated"))
    assert _chat(spark, []) == []


def test_every_turn_of_the_table_is_there_whole(spark):
    from barloom.llm import queries

    turns = {(r.conv_id, r.turn): (r.role, r.text) for r in queries.table(spark, "/root/testdata/sf0.01", "conversations").collect()}
    found = {}
    for r in queries.op8_tool_chat(spark, "/root/testdata/sf0.01").collect():
        row = json.loads(r.json)
        if r.status in ("linked", "pending"):
            told = row["arguments"] if isinstance(row["arguments"], dict) else json.loads(row["arguments"])
            assert (r.conv_id, r.turn) not in found
            found[r.conv_id, r.turn] = ("assistant", told.get("query", told.get("text")))
            if r.status == "linked":
                found[r.conv_id, r.turn + 1] = ("user", row["result"])
        else:
            assert (r.conv_id, r.turn) not in found
            found[r.conv_id, r.turn] = ("user" if row["type"] == "result" else row["role"], row["content"])
    assert found == turns


def test_long_texts_are_taken_whole(spark):
    text = "word \u00e9 \n" * 100_000
    (row,) = _chat(spark, [(1, 0, "i", "f", json.dumps({"a": 1, "b": text}), None)], [(1, 1, "i", text)])
    assert row.valid and json.loads(row.json)["result"] == json.loads(row.json)["arguments"]["b"] == text
