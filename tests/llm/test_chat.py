"""Linking, ordering and serialising of tool calls against a plain version, on transcripts that are odd in every way."""

import json
import random

import pytest

from darkslide.llm import chat, queries

TURNS = "conv_id string, turn long, role string, text string"
FAR = 2**31 - 1


def called(*calls):
    """An assistant's turn of calls (identifier, arguments)."""
    return json.dumps({"tool_calls": [{"id": i, "function": {"name": "search", "arguments": json.dumps(a)}} for i, a in calls]})


def plain_order(rows):
    """conv_id -> the parts of a conversation in order, with each call's level; by one pass over everything in memory."""
    parts = []
    for conv, turn, role, text in rows:
        for k, x in enumerate(chat.read_turn(role, text)):
            parts.append((conv, -(2**62) if turn is None else turn, k, x))
    first = {}
    for conv, turn, k, x in parts:
        if x["kind"] != "message" and x["id"] is not None and conv is not None:
            key = (conv, x["kind"], x["id"])
            first[key] = min(first.get(key, (turn, k)), (turn, k))
    refs = {}
    for conv, _, _, x in parts:
        if x["kind"] == "call" and (conv, "call", x["id"]) in first:
            known = {(conv, r) for r in chat._references(x["args"]) if r != x["id"] and (conv, "call", r) in first}
            refs.setdefault((conv, x["id"]), set()).update(known)
    level, place = {}, {}
    left = set(refs)
    while free := [c for c in left if all(r in level for r in refs[c])]:
        for c in free:
            level[c] = max((level[r] + 1 for r in refs[c]), default=0)
            place[c] = max([first[c[0], "call", c[1]][0], *(place[r] for r in refs[c])])
        left -= set(free)
    for c in left:  # in a cycle or behind one
        place[c] = max([first[c[0], "call", c[1]][0], *(place[r] for r in refs[c] if r in level)])
    keyed = []
    for conv, turn, k, x in parts:
        c = (conv, x.get("id"))
        if x["kind"] != "message" and c in refs:
            at = first[conv, "call", c[1]]
            key = (place[c], level.get(c, FAR), *at, 0 if x["kind"] == "call" else 1, turn, k)
        else:
            key = (turn, 0, turn, k, 1 if x["kind"] == "result" else 0, turn, k)
        linked = None if x["kind"] == "message" else False
        if x["kind"] != "message" and c in refs and (conv, "result", c[1]) in first:
            linked = first[conv, x["kind"], c[1]] == (turn, k)
        keyed.append((conv, key, (x["kind"], x.get("id"), turn, k, level.get(c) if c in refs else None, linked)))
    return {conv: [p for c, key, p in sorted(keyed, key=lambda r: r[1]) if c == conv] for conv in {c for c, *_ in keyed}}


@pytest.mark.parametrize(("rounds", "one_task"), [(3, 10**6), (1, 5)])
def test_random_transcripts_against_a_plain_version(spark, rounds, one_task):
    r = random.Random(11)
    rows = []
    for conv in [f"c{i}" for i in range(25)]:
        ids, n = [f"k{i}" for i in range(r.randint(1, 8))], r.randint(1, 14)
        for turn in r.sample(range(100), n):
            kind = r.random()
            some = [(r.choice(ids), {"query": " ".join(f"${r.choice(ids)}" for _ in range(r.randint(0, 2)))}) for _ in range(r.randint(1, 2))]
            rows.append((conv, turn, "assistant", called(*some)) if kind < 0.6 else (conv, turn, "tool", json.dumps({"tool_call_id": r.choice([*ids, "lost"]), "content": turn})) if kind < 0.9 else (conv, turn, "user", "well"))
    rows += [("chain", 200 - i, "assistant", called((f"n{i}", {"query": f"$n{i - 1}"}))) for i in range(100 if rounds > 2 else 8)]
    got = chat.format_chats(spark.createDataFrame(rows, TURNS), rounds=rounds, one_task=one_task).collect()
    want = plain_order(rows)
    for conv, parts in want.items():
        mine = sorted((x for x in got if x["conv_id"] == conv), key=lambda x: x["order_key"])
        assert [(x["kind"], x["call_id"], x["turn"], x["part"], x["level"], x["linked"]) for x in mine] == parts, conv
        place = {p[1]: i for i, p in reversed(list(enumerate(parts))) if p[0] == "call"}
        for x in mine:  # every call stands after those that it refers to, unless it is in a cycle
            if x["kind"] == "call" and x["level"] is not None:
                args = json.loads(x["message"])["tool_call"]["arguments"]
                assert all(place[q] < place[x["call_id"]] for q in chat._references(args) if q in place and q != x["call_id"])


def test_any_json_goes_through(spark):
    deep = "[" * 5000 + "]" * 5000
    odd = [
        called(("a", {"query": "\ud800", "limit": 10**400})), '{"tool_calls": [{"id": "\\ud800", "name": "search", "arguments": {"query": "\\udfff", "\\ud801": 1}}]}', '{"tool_calls": [{"id": "d", "name": "search", "arguments": ' + deep + "}]}",
        '{"tool_calls": [{"id": "s", "name": "search", "arguments": ' + json.dumps(deep) + "}]}", '{"tool_call_id": "a", "content": ' + "[" * 1500 + "]" * 1500 + "}", '{"tool_calls": [{"id": "i", "name": "search", "arguments": {"limit": 1e999, "query": NaN}}]}', '{"tool_calls": [null, 5, [], {"id": 7}, {"function": "f"}]}',
        '{"tool_calls": {}}', '{"tool_call_id": {"b": 1, "a": 2.0}}', '{"tool_calls": [{"id": "n", "name": "search", "arguments": {"limit": ' + "9" * 5000 + "}}]}", "{" * 3000, "{", "", '{"a": "\u0000"}', "﻿{}",
    ]
    tools = {"search": {"type": "object", "properties": {"limit": {"type": "integer", "maximum": 5}, "query": {"type": "string"}}, "additionalProperties": False}}
    df = spark.createDataFrame([("c", i, "assistant", t, 1, "x") for i, t in enumerate(odd)], TURNS + ", level int, order_key string")
    got = chat.format_chats(df, tools).collect()
    of = {(x["turn"], x["part"]): x for x in got}
    assert {t for t, _ in of} == set(range(len(odd)))
    for x in got:
        x["message"].encode()
        if "[" * 900 not in x["message"]:
            json.loads(x["message"])
    assert of[0, 0]["errors"] == ["$.limit: maximum"] and "\\ud800" in of[0, 0]["message"] and of[1, 0]["call_id"] == "\\ud800" and any("unknown" in e for e in of[1, 0]["errors"])
    assert of[5, 0]["errors"] == ["$.limit: not integer", "$.query: not string"] and of[8, 0]["call_id"] == '{"a":2,"b":1}'
    assert [of[6, k]["call_id"] for k in range(5)] == [None, None, None, "7", None] and of[13, 0]["kind"] == "message"


def test_canonical_equals_the_library_on_random_values():
    r = random.Random(5)

    def value(depth):
        k = r.random()
        if depth == 0 or k < 0.4:
            return r.choice([None, True, False, 0, -7, 10**30, 0.5, 1e-7, "", "é\"\\\n", "漢", " "])
        return [value(depth - 1) for _ in range(r.randint(0, 3))] if k < 0.7 else {r.choice("abcé\"") + str(r.randint(0, 9)): value(depth - 1) for _ in range(r.randint(0, 3))}

    for _ in range(300):
        v = value(5)
        assert chat.canonical(v) == json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert chat.canonical([1.0, -0.0, float("nan"), 1e300]) == "[1,0,null,1e+300]"
    nested = 1
    for _ in range(20_000):
        nested = [nested]
    assert chat.canonical(nested) == "[" * 20_000 + "1" + "]" * 20_000


def test_repeated_rows_and_tables_without_rows(spark):
    rows = [("c", 0, "assistant", called(("a", {"query": "x"}))), ("c", 1, "tool", json.dumps({"tool_call_id": "a"}))]
    got = chat.format_chats(spark.createDataFrame(rows * 2, TURNS), queries.TOOLS).collect()
    assert len(got) == 4 and all(x["linked"] for x in got)
    assert chat.format_chats(spark.createDataFrame([], TURNS + ", level int")).collect() == []
