import json
import random

from trawlix.llm import queries
from trawlix.llm import tool_calls as tc

SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}}, "any": {}}
CALLS = "conv_id long, call_id string, parent string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def plain(calls, results):
    least, copies, got = {}, {}, {}
    for conv, call, parent, turn, name, args in calls:
        if conv is None or call is None:
            continue
        copies[conv, call] = copies.get((conv, call), 0) + 1
        row = (turn, args or "", name, parent)
        least[conv, call] = min(least.get((conv, call), row), row)
    for conv, call, turn, content in results:
        if conv is not None and call is not None:
            got[conv, call] = min(got.get((conv, call), (turn, content)), (turn, content))

    def depth(key):
        seen, n = set(), 0
        while True:
            if key in seen:
                return None
            seen.add(key)
            up = (key[0], least[key][3])
            if least[key][3] is None or up not in least:
                return n
            key, n = up, n + 1

    out = {}
    for key in set(least) | set(got):
        if key not in least:
            out.setdefault(key[0], []).append((2**62, got[key][0], key[1], "orphan", 0))
            continue
        turn, args, name, _ = least[key]
        d = depth(key)
        _, wrong = tc.checked(name, args, SCHEMAS)
        state = "cyclic" if d is None else "invalid" if wrong else "linked" if key in got else "unanswered"
        out.setdefault(key[0], []).append((2**62 if d is None else d, turn, key[1], state, copies[key]))
    return {(conv, i + 1): (x[2], x[3], x[4], None if x[0] == 2**62 else x[0]) for conv, rows in out.items() for i, x in enumerate(sorted(rows))}


def test_against_plain_links(spark):
    rng = random.Random(3)
    calls, results = [], []
    for conv in range(12):
        for n in range(rng.randint(1, 9) if conv else 120):
            parent = rng.choice([None, f"k{n - 1}", f"k{n - 1}", "k99999", f"k{rng.randint(0, 9)}"]) if conv else f"k{n - 1}"
            args = rng.choice(['{"b": 1.5, "a": 2}', '{"a": "x"}', "[1]", "{broken", '{"a":1,"b":true,"c":0}', '{"a": NaN, "b": 1}'])
            calls.append((conv, f"k{n}", parent, n, rng.choice(["add", "add", "any", "none"]), args))
            if rng.random() < 0.7:
                results.append((conv, f"k{n}", n + 1, "ré\"sult"))
        results.append((conv, "lost", 3, "x"))
    calls += [calls[0], (0, "k0", None, 50, "add", "{}"), (None, "k1", None, 1, "add", "{}"), (20, None, None, 1, "add", "{}"), (21, "a", "b", 1, "any", "1"), (21, "b", "a", 2, "any", "1"), (21, "c", "b", 0, "any", "1"), (21, "d", None, 9, "any", "1")]
    got = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    want = plain(calls, results)
    assert {(r.conv_id, r.position): (r.call_id, r.status, r.copies, r.depth) for r in got} == want and len(got) == len(want)
    for r in got:
        assert tc.canonical(json.loads(r.json)) == r.json
        assert (r.status == "invalid") <= bool(r.errors)


def test_canonical_and_schema():
    assert tc.canonical({"b": [1, {"z": None, "a": "é\n"}], "a": 1.0}) == '{"a":1.0,"b":[1,{"a":"é\\n","z":null}]}'
    assert tc.problems({"a": True, "b": 2, "x": 1}, SCHEMAS["add"]) == ["$.a: not integer", "$.x: unknown"]
    assert tc.problems([1, "2"], {"type": "array", "items": {"type": "integer", "enum": [1]}}) == ["$[1]: not integer"]


def test_half_surrogates_long_and_odd_arguments(spark):
    deep, far = "[" * 100_000 + "]" * 100_000, "[" * 900 + "]" * 900
    args = ['{"x":"\\ud800"}', '{"\\udc00k":"\\ud83d\\ude00"}', '{"a":1e999}', "9" * 5000, deep, far, json.dumps({"t": "é" * 3_000_000}), '{"a":1,"a":2}', None, '{"a":1,"b":2,"\\ud801":3}']
    calls = [(1, f"k{i}", None, i, "add" if i == 9 else "any", a) for i, a in enumerate(args)]
    got = {r.call_id: r for r in tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    assert '"arguments":{"x":"\\ud800"}' in got["k0"].json and json.loads(got["k0"].json)["arguments"] == {"x": "\ud800"} and got["k0"].status == "unanswered"
    assert '{"\\udc00k":"😀"}' in got["k1"].json
    assert [got[f"k{i}"].status for i in (2, 3, 4, 8)] == ["invalid"] * 4 and got["k4"].errors == ["$: not JSON"]
    assert got["k5"].status in ("unanswered", "invalid") and len(json.loads(got["k6"].json)["arguments"]["t"]) == 3_000_000
    assert '"arguments":{"a":2}' in got["k7"].json and got["k9"].errors == ["$.\\ud801: unknown"]


def test_empty(spark):
    assert tc.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_turns_of_other_roles_are_context(spark, monkeypatch):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 4, None, "c"), (1, 4, "tool", "d"), (1, 4, "tool", "d"), (2, 0, "system", None), (None, 0, "system", "e"), (3, None, "system", "f")]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = queries.op9_tool_calls(spark, "").orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.call_id, r.name, r.depth, r.turn, r.copies, r.status) for r in got] == [
        (1, 1, "c1", "reply", 0, 1, 1, "linked"), (1, 2, "t0-system", "system", None, 0, 1, "context"), (1, 3, "t4-", None, None, 4, 1, "context"), (1, 4, "t4-tool", "tool", None, 4, 2, "context"),
        (2, 1, "t0-system", "system", None, 0, 1, "context"),
    ]
    assert [r.json for r in got[1:]] == ['{"content":"Be brief.","id":"t0-system","role":"system"}', '{"content":"c","id":"t4-","role":null}', '{"content":"d","id":"t4-tool","role":"tool"}', '{"content":null,"id":"t0-system","role":"system"}']


def test_context_may_have_the_id_of_a_call(spark):
    calls, context = [(1, "k", None, 1, "any", "1")], [(1, "k", 0, "system", "x")]
    got = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS, spark.createDataFrame(context, "conv_id long, call_id string, turn long, role string, content string")).collect()
    assert sorted((r.position, r.status) for r in got) == [(1, "unanswered"), (2, "context")]
