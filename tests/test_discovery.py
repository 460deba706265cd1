"""Projects, side index, configuration, compressed files, validation, exports and lineage."""

import datetime
import json

import pytest
from test_threads import entry, result, tables, use


def test_sessions_and_projects(spark, tmp_path):
    from tracelode.sources import discovery, jsonl

    p = tmp_path / "projects"
    for name, cwd in (("-home-me-my-app/s1", "/home/me/my-app"), ("-home-me-my-app/s1/subagents/agent-a", "/home/me/my-app"), ("-home-me-my-app/s2", "/home/me/my.app"), ("-home-me-my-app/s3", "/elsewhere"), ("-x-y/agent-b", None), ("C--Users-me/s4", None), ("-a%2Db-c/s5", None)):
        f = p / f"{name}.jsonl"
        f.parent.mkdir(parents=True, exist_ok=True)
        lines = [{"type": "user", "uuid": "u", "message": {"role": "user", "content": "x"}} | ({"cwd": cwd} if cwd else {})]
        f.write_text("\n".join(json.dumps(x) for x in lines * (3 if name.endswith("s1") else 1)) + "\n")
    (p / "-x-y/z.jsonl.zst").write_bytes(b"x")
    (p / "-x-y/note.jsonl.bak").write_text("no")
    s = discovery.sessions(spark, str(tmp_path))
    got = {r.session_key: (r.project, r.is_subagent, r.dir_parent, r.compressed) for r in s.collect()}
    assert got["agent-a"] == ("-home-me-my-app", True, "s1", False) and got["agent-b"] == ("-x-y", True, None, False) and got["z"] == ("-x-y", False, None, True) and got["s4"][0] == "C--Users-me" and len(got) == 8
    e = jsonl.entries(jsonl.parsed(jsonl.lines(spark, f"{p}/*/*.jsonl")))
    paths = {r.project: (r.path, r.sessions, r.subagents) for r in discovery.projects(s, e).collect()}
    assert paths == {"-home-me-my-app": ("/home/me/my-app", 3, 1), "-x-y": ("/x/y", 1, 1), "C--Users-me": ("C:/Users/me", 1, 0), "-a%2Db-c": ("/a-b/c", 1, 0)}
    assert discovery.sessions(spark, str(tmp_path / "none")).count() == 0


def test_paths_between_systems(spark):
    from pyspark.sql import functions as F

    from tracelode.sources import discovery

    rows = [("C:\\Users\\me", "/mnt/c/Users/me"), ("a\\b", "a/b"), ("D:", "/mnt/d"), (None, None)]
    df = spark.createDataFrame(rows, "w string, u string")
    assert [r for r in df.select("u", discovery.windows_to_wsl(F.col("w")).alias("got")).collect() if r.got != r.u] == []
    back = spark.createDataFrame([("/mnt/c/Users/me", "C:\\Users\\me"), ("/home/x", None), ("/mnt/c", None), ("/mnt/d/", "D:\\")], "u string, w string")
    assert [r for r in back.select("u", "w", discovery.wsl_to_windows(F.col("u")).alias("got")).collect() if r.got != r.w] == []


def test_side_index(spark, tmp_path):
    from tracelode.sources import discovery

    for name, text in (("a", json.dumps({"version": 1, "entries": [{"sessionId": "s", "fullPath": "/p", "fileMtime": 1000, "messageCount": 2}, {"sessionId": "s", "fullPath": "/q", "fileMtime": 2000, "summary": "x", "created": "2024-01-01T00:00:00Z"}, {"sessionId": "t", "fullPath": "/t", "fileMtime": 1, "isSidechain": True}]})), ("b", "{torn")):
        (tmp_path / "projects" / name).mkdir(parents=True)
        (tmp_path / "projects" / name / "sessions-index.json").write_text(text)
    got = {r.session_key: (r.project, r.path, r.summary, r.messages, r.is_sidechain) for r in discovery.side_index(spark, str(tmp_path)).collect()}
    assert got == {"s": ("a", "/q", "x", None, False), "t": ("a", "/t", None, None, True)}


def test_sidecars(spark, tmp_path):
    from tracelode.sources import discovery

    for name, text in {
        "settings.json": json.dumps({"model": "m", "hooks": {"Stop": [{"matcher": "*", "hooks": [{"type": "command", "command": "run"}]}]}}), "mcp.json": json.dumps({"mcpServers": {"db": {"command": "srv"}, "web": {"url": "http://x"}}}), "credentials.json": '{"token":"secret"}',
        "NOTES.md": "read me", "commands/fix.md": "---\ndescription: \"Fix it\"\n---\nBody", "rules/a.md": "# Keep it short\nmore", "rules/b.md": "---\npriority: 7\nactive: false\n---\nx", "other.md": "no",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    s = discovery.sidecars(spark, str(tmp_path))
    got = {r.name: r for r in s.collect()}
    assert {n: r.kind for n, r in got.items()} == {"settings": "settings", "mcp": "servers", "credentials": "credentials", "NOTES": "instructions", "fix": "command", "a": "rule", "b": "rule"}
    assert got["fix"].description == "Fix it" and got["fix"].text == "Body" and got["a"].description == "Keep it short" and (got["b"].priority, got["b"].active) == (7, False) and got["credentials"].text is None
    assert discovery.has_credentials(spark, str(tmp_path)) and not discovery.has_credentials(spark, str(tmp_path / "rules"))
    assert {(r.server, r.command, r.url) for r in discovery.servers(s).collect()} == {("db", "srv", None), ("web", None, "http://x")}
    assert [(r.event, r.matcher, r.command) for r in discovery.hooks(s).collect()] == [("Stop", "*", "run")]


def test_compressed_files_within_bounds(spark, tmp_path):
    import zstandard

    from tracelode.sources import discovery

    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(b"one\ntwo\nthree"))
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(b"x\n" * 2_000_000))
    (tmp_path / "c.jsonl.zst").write_bytes(b"not compressed")
    got = {}
    for r in discovery.compressed_lines(spark, str(tmp_path), max_in=10_000, max_out=1_500_000).collect():
        got.setdefault(r.file_path[-11], []).append((r.line_no, r.line, r.refused))
    assert got["a"] == [(1, "one", None), (2, "two", None), (3, "three", None)] and got["b"][-1] == (None, None, "decompressed size") and got["c"][0][2].startswith("not readable")
    assert {r.refused for r in discovery.compressed_lines(spark, str(tmp_path), max_in=20).filter("refused is not null").collect()} >= {"compressed size"}


def test_validation(spark):
    from tracelode.operators import validation
    from tracelode.operators.service import Logs
    from tracelode.sources import jsonl

    good = [entry(0, "user"), entry(1, "assistant", "s0", [use("t", "Read")]), entry(2, "user", "s1", [result("t")])]
    bad = [entry(0, "user", session="b"), entry(1, "assistant", "b0", [use("t", "Read"), {"type": "text"}], session="b", odd=1), entry(1, "assistant", "b0", "changed", session="b"), entry(3, "user", "gone", session="b", minute=-1)]
    bad[0].pop("uuid")
    lines = [(f"/x/{r['sessionId']}.jsonl", n, json.dumps(r)) for rows in (good, bad) for n, r in enumerate(rows, 1)] + [("/x/b.jsonl", 9, "{torn")]
    p = jsonl.parsed(spark.createDataFrame(lines, "file_path string, line_no long, line string"))
    e = jsonl.entries(p)
    b = jsonl.blocks(e)
    got = {(r.session_key, r.level, r.finding): (r.n, r.example) for r in validation.findings(p, e, b).collect()}
    assert got == {
        ("b", "error", "line that doesn't parse"): (1, "0000000009"), ("b", "error", "entry without an id"): (1, "0000000001"), ("b", "error", "entry without a time"): (1, "0000000004"), ("b", "warning", "several roots"): (2, "b1"),
        ("b", "warning", "calls and results out of balance"): (1, "1 to 0"), ("b", "warning", "id used again with other content"): (1, "b1"), ("b", "warning", "unknown field"): (1, "odd"), ("b", "warning", "block without what its kind needs"): (1, "text 0000000002"),
    }
    verdict = {r.session_key: (r.entries, r.errors, r.warnings, r.is_valid) for r in Logs(e, b).validation(p).collect()}
    assert verdict == {"s": (3, 0, 0, True), "b": (4, 3, 5, False)}


def test_requests_over_threads(spark):
    from tracelode.operators.service import Logs

    e, b, _ = tables(spark, [entry(0, "user", None, "fix alpha"), entry(1, "assistant", "s0", "ok"), entry(2, "assistant", "s0", "other"), entry(3, "user", "s2", "No, that's wrong.")])
    x = Logs(e, b)
    assert [r.line for r in x.tree().collect()] == ["* s0 user: fix alpha", "  - s1 assistant: ok", "  * s2 assistant: other", "    * s3 user: No, that's wrong."]
    assert [(r.turn, r.prompt) for r in x.timeline().orderBy("turn").collect()] == [(0, "fix alpha"), (1, "No, that's wrong.")] and x.topic("alpha").count() == 1
    assert [(r.chunk, r.entries) for r in x.chunks().orderBy("chunk").collect()] == [(0, 3), (1, 1)] and x.entry("s2").first().uuid == "s2" and x.file_evolution("f").count() == 0
    assert [(r.line_no, r.before) for r in x.corrections().collect()] == [(4, "other")]


def test_json_exports(spark, tmp_path):
    from tracelode.sources import sinks

    e, b, forest = tables(spark, [entry(0, "user", None, "hi"), entry(1, "assistant", "s0", [use("t", "Bash", command="ls")]), entry(2, "user", "s1", [result("t", "no", True)]), entry(3, "assistant", "s0", "fork")])
    doc = json.loads(sinks.to_json(e, b, forest, analytics=True).first().document)
    assert doc["metadata"]["entry_count"] == 4 and doc["tree"] == {"roots": 1, "branch_points": 1, "max_depth": 2, "main_thread": 2} and doc["analytics"]["tools"] == {"Bash": 1} and doc["analytics"]["failed_results"] == 1
    assert doc["entries"][1]["content"][0]["tool_input"] == {"command": "ls"} and doc["entries"][2]["content"][0]["is_error"] is True
    whole = sinks.to_json(e, b, lossless=True)
    assert all(r.raw in whole.first().document for r in e.collect()) and len(json.loads(whole.first().document)["entries"]) == 4
    day = lambda n: datetime.datetime(2024, 1, n)
    sessions = spark.createDataFrame([("s", "P1", day(1), day(2)), ("z", "P2", day(1), day(2))], "session_key string, project string, start_ts timestamp, end_ts timestamp")
    sinks.export_all(whole, sessions, f"{tmp_path}/all", since=day(2), project="p1")
    assert [r.project for r in spark.read.text(f"{tmp_path}/all").collect()] == ["P1"]
    sinks.export_all(whole, sessions, f"{tmp_path}/none", since=day(3))
    assert spark.read.schema("value string").text(f"{tmp_path}/none").count() == 0


def test_edges_of_rollouts(spark):
    from tracelode.operators import lineage
    from tracelode.sources import rollouts

    meta = lambda id_, **more: {"type": "session_meta", "payload": {"id": id_, **more}}
    files = {
        "a": [meta("a"), meta("a")], "b": [meta("b", forked_from_id="a"), meta("a")], "c": [meta("c"), meta("old")], "d": [meta("d", parent_thread_id="a", agent_role="r")], "e": [meta("e", source={"subagent": {"thread_spawn": {"parent_thread_id": "gone", "tool_use_id": "t"}}})],
        "f": [meta("f", source={"subagent": "review"}), {"type": "turn_context", "payload": {"id": "z"}}],
    }
    rows = [(f"/l/{k}.jsonl", n, json.dumps(x)) for k, xs in files.items() for n, x in enumerate(xs, 1)]
    r = rollouts.records(spark.createDataFrame(rows, "file_path string, line_no long, line string"))
    assert {tuple(x) for x in lineage.rollout_edges(r).collect()} == {("b", "a", "fork", None, None), ("c", "old", "fork", None, None), ("d", "a", "spawn", None, "r"), ("e", "gone", "spawn", "t", None)}


def test_correlated_files_and_rates(spark):
    from tracelode.operators import usage

    commits = spark.createDataFrame([("s", "c1", None), ("s", "c2", None)], "session_key string, sha string, at timestamp")
    committed = spark.createDataFrame([("c1", "src/xlib.rs"), ("c2", "docs/a.md"), ("c3", "lib.rs")], "sha string, path string")
    touched = spark.createDataFrame([("s", "/p/src/lib.rs"), ("s", "/p/a.md"), ("s", "/"), ("z", "/p/lib.rs")], "session_key string, path string")
    assert {tuple(r) for r in usage.correlated_files(commits, committed, touched).collect()} == {("s", "c1", "/p/src/lib.rs"), ("s", "c2", "/p/a.md")}


def test_annotations(spark, tmp_path):
    from tracelode.operators.registry import Registry

    r, at = Registry(spark, str(tmp_path / "store")), datetime.datetime(2024, 1, 1)
    for kind, id_, key, more in (("tag", "1", "a", {"name": "x"}), ("tag", "2", "a", {"name": "y"}), ("tag", "3", "b", {"name": "x"}), ("outcome", "4", "a", {"status": "success"}), ("outcome", "5", "b", {"status": "failed"}), ("bookmark", "6", "b", {}), ("link", "7", "a", {"name": "b"}), ("name", "8", "a", {"name": "first"})):
        r.put(kind, id_, at, session_key=key, **more)
    keys = lambda df: sorted(x.session_key for x in df.collect())
    assert keys(r.find(("x",))) == ["a", "b"] and keys(r.find(("x", "y"))) == ["a"] and keys(r.find(("y", "z"), every=False)) == ["a"] and keys(r.find(outcome="failed")) == ["b"] and keys(r.find(bookmarked=True)) == ["b"]
    a = {x.session_key: x for x in r.annotations().collect()}["a"]
    assert (a.tags, a.outcome, a.name, a.links, a.bookmarked) == (["x", "y"], "success", "first", ["b"], False)
    assert {x.outcome: x.share for x in r.outcomes().collect()} == {"success": 50.0, "failed": 50.0}
    with pytest.raises(ValueError):
        r.put("outcome", "9", at, session_key="a", status="odd")
