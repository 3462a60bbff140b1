import json

import pytest
from pyspark.sql import functions as F

from omenlog.llm import chat

SCHEMA = ("conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, "
          "needs array<string>, content string, status string")


def call(conv, turn, ident, name="translate", arguments='{"to":"en","text":"a"}', needs=()):
    return (conv, turn, "call", "assistant", ident, name, arguments, list(needs), None, "clash")


def result(conv, turn, ident, content="done"):
    return (conv, turn, "result", "tool", ident, None, None, None, content, "clash")


def linked(spark, rows):
    got = chat.link(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", "turn", "kind", "call_id", "name", "status", "linked_turn", "stage", "errors", "json"]
    return got.collect()


def test_calls_meet_their_results(spark):
    rows = [call(1, 0, "a"), result(1, 3, "a"), result(1, 1, "b"), call(1, 2, "c"), call(2, 0, "a"), call(None, 0, "a"),
            result(None, 1, "a"), call(3, 0, None), (3, 1, "message", "user", None, None, None, None, "hi", "x")]
    got = {(r["conv_id"], r["turn"]): (r["status"], r["linked_turn"], r["name"]) for r in linked(spark, rows)}
    assert got == {
        (1, 0): ("ok", 3, "translate"), (1, 3): ("ok", 0, "translate"), (1, 1): ("no call", None, None), (1, 2): ("no result", None, "translate"),
        (2, 0): ("no result", None, "translate"), (None, 0): ("no result", None, "translate"), (None, 1): ("no call", None, None),
        (3, 0): ("no result", None, "translate"), (3, 1): ("ok", None, None)}


def test_repeated_identifiers_do_not_multiply(spark):
    rows = [call(1, t, "a") for t in (4, 2, 2)] + [result(1, t, "a") for t in (9, 7, 7, 7)]
    got = linked(spark, rows)
    assert len(got) == 7
    assert {r["linked_turn"] for r in got if r["kind"] == "call"} == {7}
    assert {r["linked_turn"] for r in got if r["kind"] == "result"} == {2}


def test_topological_order(spark):
    rows = [call(1, 0, "a", needs=["b"]), call(1, 1, "b", needs=["c", "zz"]), call(1, 2, "c"), result(1, 3, "a"), result(1, 4, "b"),
            call(2, 0, "p"), call(2, 2, "q", needs=["p"]), call(3, 0, "x", needs=["y"]), call(3, 1, "y", needs=["x"]),
            call(3, 2, "w", needs=["y"]), call(3, 3, "v"), call(4, 0, "self", needs=["self"])]
    rows += [result(3, t, i) for t, i in ((5, "x"), (6, "y"), (7, "w"))] + [result(4, 1, "self")]
    got = {(r["conv_id"], r["kind"], r["call_id"]): r for r in linked(spark, rows)}
    stage = lambda c, i, kind="call": got[c, kind, i]["stage"]
    assert stage(1, "c") < stage(1, "b") < stage(1, "a") and stage(2, "p") < stage(2, "q")
    assert stage(1, "a", "result") == stage(1, "a") and stage(1, "b", "result") == stage(1, "b")
    assert got[1, "call", "b"]["status"] == "needs unknown call"
    assert {i: got[3, "call", i]["status"] for i in "xywv"} == {"x": "cyclic", "y": "cyclic", "w": "cyclic", "v": "no result"}
    assert got[4, "call", "self"]["status"] == "cyclic"


@pytest.mark.parametrize("name, arguments, want", [
    ("search", '{"limit": 3, "query": "x"}', []),
    ("search", '{"query": "x"}', ["limit is missing"]),
    ("search", '{"limit": "3", "query": 5}', ["limit is no integer", "query is no string"]),
    ("search", '{"limit": 3.5, "query": null}', ["limit is no integer", "query is no string"]),
    ("search", '{"limit": 3, "query": "x", "z": 1, "a": 2}', ["a is unknown", "z is unknown"]),
    ("summarise", '{"text": "x", "max_words": 9, "strict": true}', []),
    ("summarise", '{"text": "x", "max_words": 9, "strict": "yes"}', ["strict is no boolean"]),
    ("search", "[1]", ["no JSON object"]), ("search", "{broken", ["no JSON object"]), ("search", "", ["no JSON object"]),
    ("search", None, ["no JSON object"]), ("nothing", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]),
])
def test_arguments_are_validated(spark, name, arguments, want):
    df = spark.createDataFrame([(name, arguments)], "name string, arguments string")
    assert df.select(chat.errors(F.col("name"), F.col("arguments"), chat.SCHEMAS)).first()[0] == want


def test_canonical_json(spark):
    odd = 'quote " slash \\ line \n tab \t é 😀'
    rows = [call(1, 0, "a", arguments=' {"to" : "en",\n "text":' + json.dumps(odd) + "} "), result(1, 1, "a", odd), result(1, 2, "a", None)]
    got = {r["turn"]: r["json"] for r in linked(spark, rows)}
    canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[0] == canon({"arguments": {"text": odd, "to": "en"}, "call_id": "a", "name": "translate", "needs": [], "role": "assistant"})
    assert got[1] == canon({"call_id": "a", "content": odd, "name": "translate", "role": "tool"})
    assert got[2] == canon({"call_id": "a", "content": None, "name": "translate", "role": "tool"})


def test_empty_and_null_rows(spark):
    assert linked(spark, []) == []
    assert len(linked(spark, [(None,) * 10, (1,) + (None,) * 9, call(1, 0, "a", arguments='{"text":"' + "x" * 10**6 + '","to":"en"}')])) == 3
