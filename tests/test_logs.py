"""Logs from files to trees, usage and errors."""

import json

import pytest


def entry(n, kind="user", parent=None, content="hi", **more):
    base = {"parentUuid": parent, "type": kind, "uuid": f"u{n}", "timestamp": f"2024-01-01T00:{n:02d}:00.000Z", "sessionId": "s", "cwd": "/p", "version": "2.0.74"}
    return base | ({"message": {"role": kind, "content": content} | more.pop("message", {})} if kind in ("user", "assistant") else {}) | more


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    use = {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}
    rows = [
        entry(0),
        entry(1, "assistant", "u0", [{"type": "text", "text": "a"}], message={"id": "m1", "model": "m-20240101", "usage": {"input_tokens": 5, "output_tokens": 1}}),
        entry(2, "assistant", "u1", [use], message={"id": "m1", "model": "m-20240101", "usage": {"input_tokens": 5, "output_tokens": 9, "cache_read_input_tokens": 15}, "stop_reason": "tool_use"}),
        entry(3, "user", "u2", [{"type": "tool_result", "tool_use_id": "t1", "content": "no", "is_error": True}]),
        entry(4, "assistant", "u3", "done"),
        entry(5, "user", "u1", "another way"),
        entry(5, "user", "u1", "changed"),
        {"type": "summary", "summary": "x", "leafUuid": "u4"},
        entry(6, "user", "nowhere", "lost parent"),
    ]
    text = [json.dumps(r, separators=(",", ":")) for r in rows]
    torn = '{"parentUuid":"u5","type":"user","uu' + json.dumps(entry(7, "user", "u6", "saved"), separators=(",", ":"))
    (root / "abc.jsonl").write_text("\n".join([*text, "", "not json", torn]) + "\n")
    return str(root)


def test_parse(spark, logs):
    from tracelode.sources import jsonl

    p = jsonl.parsed(jsonl.lines(spark, logs)).cache()
    s = jsonl.parse_statistics(p).collect()[0]
    assert (s.parsed, s.skipped, s.empty) == (9, 2, 1) and s.lines_processed == s.parsed + s.skipped + s.empty
    assert jsonl.parse_errors(p).count() == 2
    saved = jsonl.entries(jsonl.salvaged(p)).collect()
    assert [(r.uuid, r.line_no) for r in saved] == [("u7", 12)]
    with pytest.raises(Exception, match="not an entry"):
        jsonl.strict(p).select("v").collect()


def test_tree(spark, logs):
    from tracelode.operators import trees
    from tracelode.sources import jsonl

    e = jsonl.entries(jsonl.parsed(jsonl.lines(spark, logs)))
    b = jsonl.blocks(e)
    n = {r.uuid: r for r in trees.nodes(e, b).collect()}
    assert len(n) == 7 and n["u6"].is_root and n["u1"].n_children == 2 and n["u4"].depth == 4 and n["u0"].subtree_size == 6
    # u5 spoke last, so the main thread goes there; the lost one is a root with a thread of its own
    assert [u for u, r in sorted(n.items(), key=lambda x: x[1].main_pos) if r.is_main] == ["u0", "u1", "u5", "u6"]
    assert [(r.uuid, r.exact) for r in trees.duplicates(e).collect()] == [("u5", False)]


def test_cycles_end(spark):
    from tracelode.operators import trees

    rows = [("s", 1, "a", "b", None), ("s", 2, "b", "c", None), ("s", 3, "c", "a", None), ("s", 4, "d", "a", None)]
    e = spark.createDataFrame(rows, "session_key string, line_no long, uuid string, parent_uuid string, logical_parent_uuid string").selectExpr("*", "cast(null as timestamp) as ts", "'user' as entry_type")
    b = spark.createDataFrame([], "session_key string, line_no long, block_type string, entry_type string")
    got = trees.nodes(e, b).collect()
    assert len(got) == 4 and sum(r.is_root for r in got) == 1 and max(r.depth for r in got) == 2


def test_usage(spark, logs):
    from tracelode.operators import usage
    from tracelode.sources import jsonl

    e = jsonl.entries(jsonl.parsed(jsonl.lines(spark, logs)))
    b = jsonl.blocks(e)
    t = usage.turns(e)
    m1 = t.filter("turn = 'm1'").collect()[0]
    assert (m1.input_tokens, m1.output_tokens, m1.cache_creation_tokens, m1.cache_read_tokens, m1.chunks, m1.stop_reason) == (5, 9, None, 15, 2, "tool_use")
    s = usage.token_totals(t, "session_key").collect()[0]
    assert (s.total_input, s.total_tokens, s.work_tokens, s.cache_hit_rate) == (20, 29, 14, 100.0)
    rates = spark.createDataFrame([("^m$", None, None, 2.0, 10.0, 0.0, 1.0)], "model_pattern string, since date, until date, input double, output double, cache_write double, cache_read double")
    c = usage.costs(t, rates, "session_key").collect()[0]
    assert abs(c.cost - (5 * 2 + 9 * 10 + 15) / 1e6) < 1e-12
    assert usage.costs(t, rates.limit(0), "session_key").collect()[0].cost is None
    call = usage.tool_calls(b).collect()[0]
    assert (call.tool_name, call.result, call.failed) == ("Bash", "no", True) and json.loads(call.input) == {"command": "ls"}
    assert [(r.uuid, r.fix_line) for r in usage.next_success(e, b).collect()] == [("u3", 5)]
    assert usage.sessions(e).collect()[0].users == 5


def test_stream(spark, sf_dir, tmp_path):
    from tracelode.streaming import watch

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in/events.parquet").write_bytes(open(f"{sf_dir}/events.parquet", "rb").read())
    s = watch.activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from activity").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
