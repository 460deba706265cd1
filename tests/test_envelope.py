"""The second dialect: each kind of record, a plain walk over random ones, and one schema with the first dialect."""

import json
import random

import pytest


def record(type_, payload, second=0):
    return {"timestamp": f"2025-01-01T00:{second // 60:02d}:{second % 60:02d}.000Z", "type": type_, "payload": payload}


def item(kind, **more):
    return record("response_item", {"type": kind, **more})


def event(kind, second=0, **more):
    return record("event_msg", {"type": kind, **more}, second)


def message(role, *texts, kind=None):
    return item("message", role=role, content=[{"type": kind or ("output_text" if role == "assistant" else "input_text"), "text": t} for t in texts])


def counter(i, o, c, second=0):
    return event("token_count", second, info={"total_token_usage": {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c}})


def raw_of(spark, records, path="/logs/r.jsonl"):
    rows = [(path, n, r if isinstance(r, str) else json.dumps(r)) for n, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, "file_path string, line_no long, line string")


SESSION = [
    record("session_meta", {"id": "s1", "cwd": "/p", "cli_version": "0.9"}),  # 1
    record("turn_context", {"model": "m-1", "turn_id": "t1"}),
    message("user", "<context>"),
    message("user", "fix ", "it"),
    event("user_message", message="fix it"),  # 5
    counter(100, 10, 40),
    item("reasoning", summary=[{"type": "summary_text", "text": "first"}, {"type": "summary_text", "text": " "}], content=[{"type": "text", "text": "second"}], encrypted_content="x"),
    event("agent_reasoning", text="first"),
    event("agent_reasoning", 9, text="never an item"),
    item("function_call", name="exec_command", call_id="k1", arguments='{"cmd":["ls"]}'),  # 10
    event("exec_command_end", call_id="k1", exit_code=0, stdout="a"),
    item("function_call_output", call_id="k1", output="a\nProcess exited with code 0"),
    event("exec_command_end", call_id="k9", exit_code=2, command=["make"], aggregated_output="no rule"),
    item("custom_tool_call", name="apply_patch", call_id="k2", input="*** Begin Patch"),
    item("custom_tool_call_output", call_id="k2", output={"content": "Success"}),  # 15
    item("web_search_call", id="ws1", status="completed", action={"query": "q"}),
    event("web_search_end", call_id="ws1", action={"query": "another"}),
    message("assistant", "done"),
    event("agent_message", message="done"),
    event("agent_message", message="done"),  # 20: the same event again
    counter(150, 30, 60),
    event("token_count", info=None),
    "not json",
    "",
    record("compacted", {"message": "so far", "replacement_history": [1, 2]}),  # 25
    counter(20, 5, 0),
    event("task_started", turn_id="t2"),
    event("user_message", message="and now"),
    item("function_call", name="shell", call_id="k3", arguments="not json"),
    counter(30, 5, 50),  # 30
    message("assistant", "x", kind="refusal"),
    record("world_state", {"full": True}),
]


@pytest.fixture(scope="module")
def walk(spark):
    from tracelode.sources import envelope

    raw = raw_of(spark, SESSION)
    n = envelope.normalized(raw)
    return raw, n, {(r.line_no // 2, r.line_no % 2): r for r in n.entries.collect()}, n.blocks.collect(), {r.record: r for r in n.dispositions.collect()}


def test_every_record_has_one_end(walk):
    from tracelode.sources import envelope

    raw, n, entries, _, ends = walk
    assert set(ends) == set(range(1, 33)) - {24} and n.dispositions.count() == 31
    suppressed = {k: r.twin for k, r in ends.items() if r.outcome == "suppressed"}
    assert suppressed == {5: 4, 8: 7, 19: 18, 20: 18, 22: None} and ends[22].reason == "no numbers"
    assert {k for k, r in ends.items() if r.outcome == "unknown"} == {1, 2, 17, 26, 27, 32} and ends[23].outcome == "unparseable"
    assert ends[11].entries == ["s1:10:0"] and ends[13].entries == ["s1:13:0", "s1:13:1"] and ends[6].entries == ["s1:7:0"] and ends[21].entries == ["s1:18:0"]
    assert entries[10, 0].origins == [10, 11] and entries[18, 0].origins == [18, 21] and entries[13, 1].origins == [13]
    assert envelope.violations(raw, n.entries, n.dispositions).count() == 0


def test_entries_follow_the_walk(walk):
    _, _, entries, _, _ = walk
    thread = [e for _, e in sorted(entries.items()) if e.uuid]
    assert [e.parent_uuid for e in thread] == [None, *[e.uuid for e in thread][:-1]]
    assert (entries[3, 0].author, entries[4, 0].author, entries[28, 0].author, entries[12, 0].author) == ("harness", "human", "human", "tool")
    assert (entries[4, 0].delivery, entries[28, 0].delivery) == ("turn_boundary", "mid_turn")
    first = entries[7, 0]
    assert (first.version, first.cwd, first.model, first.turn_id, first.entry_type) == ("0.9", "/p", "m-1", "t1", "assistant")
    assert (first.input_tokens, first.output_tokens, first.cache_read_tokens) == (60, 10, 40)
    assert (entries[18, 0].input_tokens, entries[18, 0].output_tokens, entries[18, 0].cache_read_tokens) == (30, 20, 20)
    assert (entries[29, 0].input_tokens, entries[29, 0].output_tokens, entries[29, 0].cache_read_tokens, entries[29, 0].turn_id) == (0, 0, 50, "t2")
    system = entries[25, 0]
    assert (system.entry_type, system.subtype, system.system_text, system.is_meta) == ("system", "compact_boundary", "so far", True)
    assert entries[1, 0].uuid is None and entries[1, 0].entry_type == "session_meta"


def test_blocks(walk):
    _, _, _, blocks, _ = walk
    of = {}
    for b in sorted(blocks, key=lambda b: (b.line_no, b.block_no)):
        of.setdefault((b.line_no // 2, b.line_no % 2), []).append(b)
    assert [b.text for b in of[4, 0]] == ["fix ", "it"] and of[7, 0][0].thinking == "first\n\nsecond" and of[9, 0][0].thinking == "never an item"
    call = of[10, 0][0]
    assert (call.block_type, call.call_id, call.tool_name, json.loads(call.tool_input.toJson())) == ("tool_use", "k1", "exec_command", {"cmd": ["ls"]})
    assert of[12, 0][0].result_text == "a\nProcess exited with code 0" and json.loads(of[15, 0][0].result_text) == {"content": "Success"}
    alone, printed = of[13, 0][0], of[13, 1][0]
    assert alone.tool_name == "exec_command" and json.loads(alone.tool_input.toJson())["command"] == ["make"] and (printed.result_text, printed.is_error, printed.entry_type) == ("no rule", True, "user")
    assert json.loads(of[16, 0][0].tool_input.toJson()) == {"status": "completed", "action": {"query": "q"}} and of[29, 0][0].tool_input.toPython() == "not json"
    assert (of[31, 0][0].block_type, of[31, 0][0].text) == ("refusal", None) and (19, 0) not in of


def test_one_schema_for_both_dialects(spark, walk, tmp_path):
    from tracelode.operators import lessons, trees, usage
    from tracelode.operators.index import Index
    from tracelode.sources import jsonl, sinks

    _, n, *_ = walk
    rows = [{"type": "user", "uuid": "a1", "timestamp": "2024-01-01T00:00:00.000Z", "message": {"role": "user", "content": "hello"}}, {"type": "assistant", "uuid": "a2", "parentUuid": "a1", "timestamp": "2024-01-01T00:00:01.000Z", "message": {"role": "assistant", "id": "m", "content": [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "x"}}]}}]
    e = jsonl.entries(jsonl.parsed(raw_of(spark, rows, "/logs/first.jsonl")))
    b = jsonl.blocks(e)
    kinds = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
    assert kinds(n.entries)[: len(e.columns)] == kinds(e) and sorted(map(str, kinds(n.blocks))) == sorted(map(str, kinds(b)))
    entries, blocks = e.unionByName(n.entries, allowMissingColumns=True), b.unionByName(n.blocks)
    nodes = trees.nodes(entries, blocks).collect()
    assert max(r.depth for r in nodes if r.session_key == "s1") == sum(r.session_key == "s1" for r in nodes) - 1
    total = {r.session_key: r for r in usage.token_totals(usage.turns(entries), "session_key").collect()}
    assert (total["s1"].input_tokens, total["s1"].output_tokens, total["s1"].cache_read_tokens) == (90, 30, 110)
    calls = {r.id: r for r in usage.tool_calls(blocks).collect()}
    assert calls["k9"].failed is True and calls["k1"].result.startswith("a") and set(calls) == {"k1", "k2", "k3", "k9", "ws1", "t"}
    assert {(r.id, r.basis) for r in lessons.failures(n.blocks, n.observed).collect()} == {("k9", "process_exit")}
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.update(entries, blocks) == {"added": 2} and {r.line_no // 2 for r in ix.search("never an item").collect()} == {9}
    assert sinks.to_text(blocks).count() == 2 == sinks.to_json(entries, blocks).count() and sinks.messages(entries, blocks).count() > 10
    assert sinks.relational(entries, blocks)["tool_uses"].count() == 6


def walked(records):
    """A plain walk: (outcome, twin) by line, and the tokens of each line's entry."""
    fate, tokens, start = {}, {}, 0
    bounds = [i for i, r in enumerate(records) if r["type"] in ("session_meta", "turn_context", "compacted") or r["payload"].get("type") == "task_started"]
    last = None
    for a, z in zip([0, *bounds], [*bounds, len(records)], strict=True):
        window = list(range(a, z))
        pools, seen = {"user": [], "assistant": [], "thought": []}, {}
        for i in window:
            p = records[i]["payload"]
            if records[i]["type"] == "response_item" and p["type"] == "message" and p["role"] in pools:
                pools[p["role"]].append([i, "".join(x["text"] for x in p["content"])])
            elif records[i]["type"] == "response_item" and p["type"] == "reasoning":
                pools["thought"] += [[i, x["text"]] for x in p["summary"]]
        where = {"user_message": ("user", "message"), "agent_message": ("assistant", "message"), "agent_reasoning": ("thought", "text")}
        speakers = []
        for i in window:
            r, p = records[i], records[i]["payload"]
            if r["type"] == "event_msg" and p["type"] in where:
                pool, field = where[p["type"]]
                print_ = (json.dumps(p, sort_keys=True), r["timestamp"])
                if print_ in seen:
                    first = seen[print_]
                    fate[i] = ("suppressed", fate[first][1] if fate[first][0] == "suppressed" else first)
                    continue
                seen[print_] = i
                hit = next((c for c in pools[pool] if c[1] == p[field]), None)
                if hit:
                    pools[pool].remove(hit)
                    fate[i] = ("suppressed", hit[0])
                    continue
                fate[i] = ("mapped", None)
            elif r["type"] in ("response_item", "compacted"):
                fate[i] = ("mapped", None)
            elif p.get("type") == "token_count":
                continue
            else:
                fate[i] = ("unknown", None)
            if fate[i][0] == "mapped" and (p.get("type") in ("agent_message", "agent_reasoning", "reasoning") or p.get("role") == "assistant"):
                speakers.append(i)
        for i in window:
            p = records[i]["payload"]
            if p.get("type") == "token_count":
                now = p["info"]["total_token_usage"]
                fresh = lambda t: max(t["input_tokens"] - t["cached_input_tokens"], 0)
                if last is None or now["input_tokens"] < last["input_tokens"] or now["output_tokens"] < last["output_tokens"]:
                    add = (fresh(now), now["output_tokens"])
                else:
                    add = (max(fresh(now) - fresh(last), 0), now["output_tokens"] - last["output_tokens"])
                last = now
                owner = max((s for s in speakers if s < i), default=min((s for s in speakers if s > i), default=None))
                fate[i] = ("unknown", None) if owner is None else ("mapped", None)
                if owner is not None:
                    old = tokens.get(owner, (0, 0))
                    tokens[owner] = (old[0] + add[0], old[1] + add[1])
    return fate, tokens


def test_random_records_against_a_plain_walk(spark):
    from functools import reduce

    from tracelode.sources import envelope

    rng = random.Random(5)
    sessions, frames = {}, []
    for s in range(12):
        records = [record("session_meta", {"id": f"s{s}"})]
        for _ in range(60):
            text, second = rng.choice("abc"), rng.randint(0, 1)
            records.append(
                rng.choice(
                    [
                        lambda: message("user", text), lambda: message("assistant", text), lambda: event("user_message", second, message=text), lambda: event("agent_message", second, message=text),
                        lambda: event("agent_reasoning", second, text=text), lambda: item("reasoning", summary=[{"text": rng.choice("abc")} for _ in range(rng.randint(0, 3))]),
                        lambda: counter(rng.randint(0, 300), rng.randint(0, 30), rng.randint(0, 200)), lambda: counter(1000, 100, rng.randint(0, 1000)),
                        lambda: record("turn_context", {}) if rng.random() < 0.5 else record("compacted", {"message": "m"}), lambda: message("developer", text),
                    ]
                )()
            )
        sessions[f"s{s}"] = records
        frames.append(raw_of(spark, records, f"/logs/s{s}.jsonl"))
    raw = reduce(lambda a, b: a.unionByName(b), frames)
    n = envelope.normalized(raw)
    got = {(r.session_key, r.record - 1): (r.outcome, r.twin - 1 if r.twin else None) for r in n.dispositions.collect()}
    tokens = {(r.session_key, r.line_no // 2 - 1): (r.input_tokens, r.output_tokens) for r in n.entries.collect() if r.input_tokens is not None}
    for s, records in sessions.items():
        fate, added = walked(records)
        assert {i: x for (k, i), x in got.items() if k == s} == fate
        assert {i: x for (k, i), x in tokens.items() if k == s} == added
    assert envelope.violations(raw, n.entries, n.dispositions).count() == 0


def test_violations_are_named(spark, walk):
    from pyspark.sql import functions as F

    from tracelode.sources import envelope

    raw, n, *_ = walk
    d, e = n.dispositions, n.entries
    named = lambda e, d: sorted((r.violation, r.record or 0) for r in envelope.violations(raw, e, d).collect())
    assert named(e, d.filter("record <> 2")) == [("entry that its record doesn't name", 2), ("record without a disposition", 2)]
    assert named(e, d.union(d.filter("record = 5"))) == [("record with several dispositions", 5)]
    assert named(e.filter("entry_id <> 's1:29:0'"), d) == [("entry that doesn't exist", 29), ("entry that doesn't exist", 30)]
    assert named(e.union(e.filter("entry_id = 's1:12:0'")), d) == [("entry id used twice", 0)]
    assert named(e, d.withColumn("twin", F.when(F.col("record") == 5, 1).otherwise(F.col("twin")).cast("long"))) == [("twin that isn't mapped", 5)]
    assert named(e, d.withColumn("entries", F.when(F.col("record") == 3, F.array(F.lit("s1:4:0"), F.lit("s1:4:0"))).otherwise(F.col("entries")))) == [
        ("entry named twice by one record", 3), ("entry that doesn't rest on the record", 3), ("entry that its record doesn't name", 3),
    ]
    assert ("disposition of no record", 24) in named(e, d.withColumn("record", F.when(F.col("record") == 23, 24).otherwise(F.col("record")).cast("long")))


def test_other_files_are_refused_and_one_copy_is_preferred(spark):
    from tracelode.sources import envelope, rollouts

    old = raw_of(spark, [{"id": "x", "timestamp": "2025"}, {"type": "message", "role": "user"}, {"record_type": "state"}], "/logs/old.jsonl")
    d = envelope.normalized(old).dispositions.collect()
    assert [(r.outcome, r.reason) for r in d] == [("refused", "legacy")] * 3
    both = raw_of(spark, SESSION[:3], "/logs/archived_sessions/r.jsonl").union(raw_of(spark, SESSION[:2], "/logs/r.jsonl.zst")).union(raw_of(spark, SESSION[:4], "/logs/z.jsonl"))
    assert {r.file_path for r in envelope.preferred(rollouts.records(both)).collect()} == {"/logs/z.jsonl"}
    assert envelope.normalized(old.limit(0)).entries.count() == 0
    forked = envelope.walked(rollouts.records(raw_of(spark, SESSION[:6])), spark.createDataFrame([("s1", 4)], "session_key string, first_new long"))
    assert [r.window for r in forked.orderBy("line_no").collect()] == [1, 2, 2, 3, 3, 3]
