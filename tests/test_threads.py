"""Prompts, segments, topics, turns, timelines and chunks against plain walks."""

import json
import random

import pytest


def entry(n, kind, parent=None, content="hi", session="s", minute=None, **more):
    base = {"parentUuid": parent, "type": kind, "uuid": f"{session}{n}", "sessionId": session} | ({"timestamp": f"2024-01-01T00:{n if minute is None else minute:02d}:00.000Z"} if minute != -1 else {})
    return base | ({"message": {"role": kind, "content": content}} if kind in ("user", "assistant") else {"content": content}) | more


def tables(spark, rows):
    from tracelode.operators import trees
    from tracelode.sources import jsonl

    count, lines = {}, []
    for r in rows:
        s = r["sessionId"]
        count[s] = count.get(s, 0) + 1
        lines.append((f"/x/{s}.jsonl", count[s], json.dumps(r)))
    e = jsonl.entries(jsonl.parsed(spark.createDataFrame(lines, "file_path string, line_no long, line string")))
    b = jsonl.blocks(e)
    return e, b, trees.nodes(e, b)


def use(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content="ok", bad=None):
    return {"type": "tool_result", "tool_use_id": i, "content": content} | ({"is_error": bad} if bad is not None else {})


def test_segments():
    from tracelode.operators.prompts import markdown_segments

    assert markdown_segments("a\nb\n> q\n```\ncode\n~~~\nstill\n```\nend\n") == [("primary", "a\nb"), ("quoted", "> q\n```\ncode\n~~~\nstill\n```"), ("primary", "end")]
    assert markdown_segments(" > q\n\n") == [("quoted", " > q")] and markdown_segments(None) == markdown_segments("\n \n") == [] and markdown_segments("~~~\nopen") == [("quoted", "~~~\nopen")]


def test_decisions(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import prompts

    rows = [("Option A is x, option B is y", True), ("1. a\n2. b\n", False), ("1. a\n2. b\nhowever, c", True), ("1) a\n 2) b\n3. c", True), ("- a\n- b\n* c", False), ("- a\n- b\n* c\nI recommend it", True), ("- a\n- b\n* c\n- d", True),
            ("Then WE DECIDED", True), ("the team decided to", True), ("he decided to", False), ("pros: cons:", True), (None, False), ("prefer", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert [r for r in df.select("t", "want", prompts.decides(F.col("t")).alias("got")).collect() if r.got != r.want] == []


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        entry(0, "user", None, "<command-name>x"), entry(1, "user", "s0", "please fix alpha"), entry(2, "assistant", "s1", [{"type": "thinking", "thinking": "alpha hm"}, {"type": "text", "text": "Looking"}, use("t1", "Read", file_path="/a/b.py")]),
        entry(3, "user", "s2", [result("t1", "x", True)]), entry(4, "assistant", "s3", [use("t2", "Edit", file_path="/a/c.py"), use("t3", "Bash", command="ls")]), entry(5, "user", "s4", [result("t2"), result("t3")]),
        entry(6, "assistant", "s5", [use("t4", "Bash")]), entry(7, "assistant", "s6", "we decided on alpha\n> alpha said"), entry(8, "system", "s7", "note"), entry(9, "assistant", "s8", "tail"), entry(10, "user", "s9", "bye", isMeta=True),
    ]
    return tables(spark, rows)


def test_topic(talk):
    from tracelode.operators import threads

    e, b, forest = talk
    main = threads.main_thread(forest, e, b)
    got = [(r.uuid, r.location, r.provenance, r.matches, r.asked, (r.answered or "")[:7]) for r in threads.topic(main, "alpha").collect()]
    assert got == [("s1", "user", "primary", 1, "please fix alpha", "Looking"), ("s7", "assistant", "primary", 2, None, "we deci")]
    deep = threads.topic(main, "alpha", thinking=True).collect()
    assert [(r.uuid, r.location, r.thought) for r in deep] == [("s1", "user", "alpha hm"), ("s2", "thinking", "alpha hm"), ("s7", "assistant", None)]
    assert [r.uuid for r in threads.topic(main, "alpha", decisions=True).collect()] == ["s7"] == [r.uuid for r in threads.topic(main, "alpha", role="assistant").collect()]
    assert [(r.uuid, r.provenance) for r in threads.topic(main, "command").collect()] == [("s0", "injected")] and [r.provenance for r in threads.topic(main, "said").collect()] == ["quoted"]
    assert [r.uuid for r in threads.topic(main, "alpha|bye|command", limit=2).collect()] == ["s1", "s7"]


def test_turns_and_timeline(talk):
    from tracelode.operators import threads

    e, b, forest = talk
    t = threads.turns(threads.main_thread(forest, e, b))
    got = [(r.turn, r.prompt, r.summary and r.summary[:7], r.tools, r.files, r.had_errors) for r in t.orderBy("turn").collect()]
    assert got == [
        (0, None, None, [], [], False), (1, "please fix alpha", "Looking", ["Read"], ["b.py"], False), (2, None, None, ["Edit", "Bash"], ["c.py"], True), (3, None, None, ["Bash"], [], False), (4, None, "we deci", [], [], False),
        (5, None, "tail", [], [], False), (6, None, None, [], [], False),
    ]
    line = [(r.turn, r.n, r.prompt, r.summary and r.summary[:7], r.tools, r.files, r.had_errors) for r in threads.timeline(t).orderBy("turn").collect()]
    assert line == [(0, 1, None, None, [], [], False), (1, 1, "please fix alpha", "Looking", ["Read"], ["b.py"], False), (2, 2, None, "[2 tool", ["Edit", "Bash"], ["c.py"], True), (4, 1, None, "we deci", [], [], False), (5, 1, None, "tail", [], [], False), (6, 1, None, None, [], [], False)]


def test_semantic_turns(spark):
    from tracelode.operators import threads, trees
    from tracelode.sources import envelope

    item = lambda role, text: {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}
    rows = [
        ("session_meta", {"id": "s"}), ("turn_context", {"turn_id": "t1"}), ("response_item", item("user", "<rules>")), ("response_item", item("user", "first")), ("event_msg", {"type": "user_message", "message": "first"}),
        ("response_item", {"type": "function_call", "name": "shell", "call_id": "k", "arguments": "{}"}), ("event_msg", {"type": "user_message", "message": "also this"}), ("response_item", item("assistant", "done")),
        ("turn_context", {"turn_id": "t2"}), ("response_item", {"type": "function_call", "name": "apply_patch", "call_id": "k2", "arguments": "{}"}), ("turn_context", {"turn_id": "t3"}), ("response_item", {"type": "reasoning", "summary": [{"text": "only"}]}),
    ]
    raw = spark.createDataFrame([("/l/s.jsonl", n, json.dumps({"timestamp": f"2025-01-01T00:00:{n:02d}.000Z", "type": t, "payload": p})) for n, (t, p) in enumerate(rows, 1)], "file_path string, line_no long, line string")
    n = envelope.normalized(raw)
    t = threads.turns(threads.main_thread(trees.nodes(n.entries, n.blocks), n.entries, n.blocks)).orderBy("turn").collect()
    # the harness' rules open no turn of their own that counts
    assert [(r.prompt, r.steering, r.summary, r.tools) for r in t] == [("first", ["also this"], "done", ["shell"]), (None, [], None, ["apply_patch"])]


def placed(nodes, boundary, ts):
    """A plain placement of nodes {uuid: (parent, main position or None)}."""
    main = sorted((u for u, (_, m) in nodes.items() if m is not None), key=lambda u: nodes[u][1])
    chunk, now, starts = {}, None, []
    for u in main:
        if u in boundary:
            now = 0 if now is None else now + 1
            starts.append(ts[u])
        chunk[u] = now
    out = {u: (chunk[u], "main" if chunk[u] is not None else "preamble") for u in main}
    for u, (p, m) in nodes.items():
        if m is not None:
            continue
        root, up = u, p
        while up is not None and up not in chunk:
            root, up = up, nodes[up][0]
        k = chunk[up] if up is not None else next((i for i in range(len(starts) - 1, -1, -1) if starts[i] is not None and ts[u] is not None and starts[i] <= ts[u]), None)
        out[u] = (k, "preamble" if k is None else "branch" if root in boundary else "attached")
    return out


def test_chunks_against_a_plain_walk(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import prompts, threads

    rng = random.Random(7)
    rows = []
    for s in range(15):
        key = f"k{s}-"
        for n in range(30):
            parent = None if n == 0 or rng.random() < 0.08 else f"{key}{rng.randrange(max(0, n - 4), n)}"
            rows.append(entry(n, rng.choice(["user", "assistant", "system"]), parent, rng.choice(["hi", "<system-reminder>", [result("x")]]) if rng.random() < 0.7 else "text", key, rng.choice([-1, rng.randint(0, 59), n])))
    e, b, forest = tables(spark, rows)
    said = prompts.with_authors(e, prompts.texts(b))
    human = said.filter("human").select("session_key", "uuid")
    got = {r.uuid: (r.chunk, r.place) for r in threads.chunks(forest, human, e).collect()}
    nodes, boundary, ts = {}, {r.uuid for r in human.collect()}, {r.uuid: r.ts for r in e.collect()}
    for r in forest.collect():
        nodes.setdefault(r.session_key, {})[r.uuid] = (r.parent_uuid, r.main_pos if r.is_main else None)
    want = {u: x for k in nodes.values() for u, x in placed(k, boundary, ts).items()}
    assert got == want and {p for _, p in got.values()} == {"main", "preamble", "branch", "attached"}
    members = threads.chunks(forest, human, e)
    summary = threads.chunk_summary(members, prompts.texts(b))
    assert sum(r.entries for r in summary.collect()) == sum(p in ("main", "attached") for _, p in got.values())
    one = threads.chunk_range(summary, "0-1")
    assert one.filter(F.col("chunk") > 1).count() == 0 < one.count()
    for bad in ("x", "3-2", "1-y"):
        with pytest.raises(ValueError):
            threads.chunk_range(summary, bad)
