"""Lineage, lessons, the second dialect, the index and exports."""

import json

from pyspark.sql import functions as F


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from tracelode.sources import jsonl

    want = {}
    for name, n in (("a", 4000), ("b", 3), ("c", 1500)):
        rows = [json.dumps({"n": i, "pad": "x" * (i % 50)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
        want[name] = rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = jsonl.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {k: {} for k in want}
    for r in got:
        by[r.file_path[-7]][r.line_no] = r.line
    assert {k: [v[i + 1] for i in range(len(v))] for k, v in by.items()} == want


def test_fused_and_torn_lines(spark):
    from tracelode.sources import jsonl

    a, b = '{"type":"user","uuid":"u1"}', '{"uuid":"u2","type":"user"}'
    lines = [a, a + "garbage", a + b, a + ",", "[1]", "1", '{"type":"user","uu' + a + " " + b, '{"parentUuid":{"type":"torn' + b, '{"x":"' + a + "}", '{"type":"user","x":[', f" {a} ", ""]
    raw = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file_path string, line_no long, line string")
    p = jsonl.parsed(raw)
    assert {r.line_no: r.status for r in p.collect()} == dict(enumerate(["parsed", *["skipped"] * 9, "parsed", "empty"]))
    saved = sorted((r.line_no, r.uuid) for r in jsonl.entries(jsonl.salvaged(p)).collect())
    # a line that begins with an entry lost nothing before it but that entry's own line
    assert saved == [(2, "u2"), (6, "u1"), (6, "u2"), (7, "u2")]


def test_cycles_are_cut_at_logical_parents(spark):
    from tracelode.operators import trees

    rows = [("s", 1, "a", "c", None), ("s", 2, "b", None, "a"), ("s", 3, "c", "b", None), ("s", 4, "d", "c", None), ("s", 5, None, None, None)]
    e = spark.createDataFrame(rows, "session_key string, line_no long, uuid string, parent_uuid string, logical_parent_uuid string").selectExpr("*", "cast(null as timestamp) as ts", "'user' as entry_type")
    b = spark.createDataFrame([], "session_key string, line_no long, block_type string, entry_type string")
    n = trees.nodes(e, b)
    assert [r.uuid for r in n.filter("is_root").collect()] == ["b"] and [r.line_no for r in trees.orphans(e).collect()] == [5]
    p = {r.uuid: r.path for r in trees.paths(n, n).collect()}
    assert p == {"b": ["b"], "c": ["b", "c"], "a": ["b", "c", "a"], "d": ["b", "c", "d"]}
    pair = spark.createDataFrame([(p["a"], p["d"], ["x"])], "a array<string>, d array<string>, x array<string>")
    assert tuple(pair.select(trees.common_ancestor(F.col("a"), F.col("d")), trees.common_ancestor(F.col("a"), F.col("x"))).first()) == ("c", None)


def test_units(spark):
    from tracelode.operators import lineage

    chain = [(f"n{i:02d}", f"n{i - 1:02d}", "continuation") for i in range(1, 20)]
    circle = [("c2", "c1", "continuation"), ("c3", "c2", "continuation"), ("c1", "c3", "continuation"), ("t2", "t1", "continuation"), ("t1", "c2", "continuation")]
    rest = [("lost", "nowhere", "continuation"), ("child", "n00", "spawn"), ("own", "own", "continuation")]
    edges = spark.createDataFrame(chain + circle + rest, "child string, parent string, kind string")
    nodes = spark.createDataFrame([(x,) for x in sorted({c for c, _, _ in chain + circle + rest} | {"n00"})], "session_key string")
    got = {r.session_key: (r.root, r.depth) for r in lineage.units(edges, nodes).collect()}
    want = {f"n{i:02d}": ("n00", i) for i in range(20)} | {"c1": ("c1", 0), "c2": ("c1", 1), "c3": ("c1", 2), "t1": ("c1", 2), "t2": ("c1", 3), "lost": ("lost", 0), "own": ("own", 0)}
    assert got == want
    assert lineage.units(edges.limit(0), nodes.limit(0)).count() == 0


def test_copied_prefixes_end_at_the_first_difference(spark):
    from tracelode.operators import lineage

    texts = {"p": "abcdef", "x": "*abcXef", "y": "*abcdefgh", "z": "*Q", "e": "*"}
    records = spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "session_key string, pos long, digest string")
    forks = spark.createDataFrame([(k, "p") for k in "xyze"], "child string, parent string")
    assert {r.child: r.copied for r in lineage.copied_prefix(forks, records).collect()} == {"x": 3, "y": 6, "z": 0}


def test_subagents_in_three_passes(spark):
    from tracelode.operators import lineage

    calls = [("s", "c1", 1, "a"), ("s", "c2", 2, "b"), ("s", "c3", 3, "b"), ("s", "c4", 4, None), ("t", "d1", 1, "x"), ("t", "d2", 2, "x")]
    links = [("s", "g1", "c1", "b"), ("s", "g2", None, "b"), ("s", "g3", None, "z"), ("t", "h1", None, "x"), ("t", "h2", None, "x"), ("u", "k", None, None)]
    got = lineage.match_subagents(spark.createDataFrame(calls, "session_key string, call_id string, nr int, description string"), spark.createDataFrame(links, "session_key string, agent_key string, tool_use_id string, description string"))
    rows = {(r.call_id, r.agent_key, r.how) for r in got.collect()}
    # two calls and one subagent are left in s, two and two in t: nothing more is certain
    assert rows == {("c1", "g1", "id"), ("c2", "g2", "description"), (None, "g3", "none"), (None, "h1", "none"), (None, "h2", "none"), (None, "k", "none")}
    one = lineage.match_subagents(spark.createDataFrame(calls[:1], "session_key string, call_id string, nr int, description string"), spark.createDataFrame([("s", "g9", None, None)], "session_key string, agent_key string, tool_use_id string, description string"))
    assert [(r.call_id, r.agent_key, r.how) for r in one.collect()] == [("c1", "g9", "only")]


def test_failures(spark):
    """Cases of each rule, written down by hand."""
    from tracelode.operators import lessons

    rows = [
        ("Read", None, "  12→text", True, None), ("Read", None, "787\ttext", True, None), ("Read", None, "gone", True, "native_error_flag"), ("Read", None, "12: text", True, "native_error_flag"),
        ("Grep", None, "21:x", True, None), ("Grep", None, "21-x", True, None), ("Grep", None, "a1-b is no directory", True, "native_error_flag"), ("mcp__a__b", None, ' {"ok":1}', True, None), ("mcp__a__b", None, "refused", True, "native_error_flag"),
        ("Agent", None, "y" * 201, True, None), ("Agent", None, "Error " + "y" * 201, True, "native_error_flag"), ("Agent", None, "short", True, "native_error_flag"), (None, None, None, True, "native_error_flag"),
        ("Bash", {"command": " git log -1"}, "fix stack overflow", False, None), ("Bash", {"command": "make"}, "x.c: undefined reference to f", None, "text_signature"), ("Bash", {"command": "run"}, "thread 'main' panicked at", None, "text_signature"),
        ("Bash", {"command": "run"}, "Segmentation fault (core dumped)", None, "text_signature"), ("Bash", {"command": "run"}, "Exit code 1", None, "text_signature"), ("Bash", {"command": "run"}, "Exit code 0", None, None),
        ("Bash", {"command": "cargo"}, "error[E0308]: mismatched", None, "text_signature"), ("Bash", {"command": "python x"}, "Traceback (most recent call last)", None, None), ("Bash", {"command": "x"}, "Error: none", None, None),
        ("Odd", None, '{"error":"x"}', False, "structured_error"), ("Odd", None, '{"error":false}', False, None), ("Odd", None, '{"error":null}', False, None), ("Odd", None, '{"error":0}', False, "structured_error"), ("Odd", None, "[1]", None, None), ("Odd", None, None, None, None),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(g), *r) for i, (t, g, *r) in enumerate(rows)], "i int, tool string, given string, content string, flag boolean, want string")
    got = df.select("i", "want", lessons.failure(F.col("tool"), F.col("given"), F.col("content"), F.col("flag"))["basis"].alias("got")).collect()
    assert [(r.i, r.got) for r in got if r.got != r.want] == []


def test_typed_failures(spark):
    from tracelode.operators import lessons

    shell = lambda command, content, want, flag=None, seen=(None, None, None): ("exec_command", {"cmd": command}, content, flag, *seen, want)
    rows = [
        shell("make", "error: x\nProcess exited with code 0", None), shell("make", "Process exited with code 2", "process_exit"), shell("rg x", "Process exited with code 1", None), shell("rg x", "Process exited with code 2", "process_exit"),
        shell(["grep", "x"], "Exit code: 1", None), shell("make", '{"output":"","metadata":{"exit_code":3}}', "process_exit"), shell("make", '{"exit_code":0,"error":"x"}', None), shell("make", "panic\nProcess running with session ID 5", None),
        shell("cat r.json", '{"error":{"a":1}}', None), shell("cat log", "Error: in the file", None), shell("make", '{"error":"x"}', "structured_error"), shell("make", " Error: x", "text_signature"), shell("make", "panicked", "text_signature"), shell("make", "fine", None),
        shell("make", "Process exited with code 0", "native_error_flag", True), shell("make", "panic", "process_exit", None, (2, None, None)), shell("rg x", "panic", None, None, (1, None, "failed")), shell("make", "panic", None, None, (0, None, None)),
        shell("make", "fine", "native_lifecycle_status", None, (None, False, None)), shell("make", "fine", "native_lifecycle_status", None, (None, None, "declined")), shell("make", "panic", None, None, (None, None, "completed")), shell("make", "panic", "text_signature", None, (None, None, None)),
        ("apply_patch", "*** Begin", "apply_patch verification failed: no file", None, None, None, None, "text_signature"), ("apply_patch", None, '{"error":"x"}', None, None, None, None, "structured_error"), ("apply_patch", None, "panic in a comment", None, None, None, None, None),
        ("read_file", None, '{"error":"in a file"}', None, None, None, None, None), ("grep", None, "panic", None, None, None, None, None), ("web_search", None, "Error: said a page", None, None, None, None, None), ("web_search", None, '{"error":"x"}', None, None, None, None, "structured_error"),
        ("mcp__a__b", None, "Error: x", None, None, None, None, None), ("update_plan", None, "Error: x", None, None, None, None, None), ("odd", None, '{"error":1}', None, None, None, None, "structured_error"), ("odd", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(g), *r) for i, (t, g, *r) in enumerate(rows)], "i int, tool string, given string, content string, flag boolean, code int, success boolean, status string, want string")
    got = df.select("i", "want", lessons.typed_failure(*[F.col(c) for c in ("tool", "given", "content", "flag", "code", "success", "status")])["basis"].alias("got")).collect()
    assert [(r.i, r.got) for r in got if r.got != r.want] == []


def test_error_fixes_and_corrections(spark):
    from tracelode.operators import lessons

    call = lambda i, name, given: {"type": "tool_use", "id": i, "name": name, "input": given}
    result = lambda i, content, bad=None: {"type": "tool_result", "tool_use_id": i, "content": content} | ({"is_error": bad} if bad is not None else {})
    rows = [
        ("a", 1, "user", "What do I mean? No, that's wrong."), ("a", 2, "assistant", [{"type": "text", "text": "trying"}, call("t1", "MultiEdit", {"file_path": "/f", "edits": [{"old_string": "a", "new_string": "b"}, {}]})]),
        ("a", 3, "user", [result("t1", [{"type": "text", "text": "not"}, {"type": "text", "text": "there"}], True)]), ("a", 4, "user", "No, that's wrong, twice."),
        ("a", 5, "assistant", [{"type": "text", "text": " another way "}, call("t2", "Bash", {"command": "make"}), call("t3", "Read", {})]), ("a", 6, "user", [result("t2", "panic"), result("t3", "1→ok", True)]), ("a", 7, "user", "no, wait"),
    ]
    e, b = entries_of(spark, rows)
    got = {r.id: r for r in lessons.error_fixes(e, b).collect()}
    assert set(got) == {"t1", "t2"} and got["t1"].preview == "not\nthere" and got["t1"].given == {"file_path": "/f", "edit_count": "2", "old_string": "a", "new_string": "b"}
    assert (got["t1"].fix_line, got["t1"].resolution, got["t1"].resolution_tools) == (5, "another way", ["Bash", "Read"]) and (got["t2"].fix_line, got["t2"].resolution_tools, got["t2"].given) == (None, [], {"command": "make"})
    human = e.filter("entry_type = 'user'")
    assert [(r.line_no, r.basis, r.before) for r in lessons.corrections(b, human).collect()] == [(4, "explicit_rejection", "trying")]
    assert lessons.corrections(b, human.filter("line_no < 4")).count() == 0


def test_corrections(spark):
    from tracelode.operators import lessons

    rows = [("No, that's wrong. Why did you do this?", 402, "explicit_rejection"), ("No action needed", None, None), ("please stop guessing", 251, "behavioral_redirect"), ("how many times", 351, "performance_critique"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, s int, b string").select("s", "b", lessons.correction(F.col("t")).alias("c"))
    for r in df.collect():
        assert (r.c.strength, r.c.basis) == (r.s, r.b) if r.c else r.s is None


def rollout(kind, payload, n=0):
    return json.dumps({"timestamp": f"2025-01-01T00:00:{n:02d}.000Z", "type": kind, "payload": payload})


def test_second_dialect(spark, tmp_path):
    from tracelode.sources import jsonl, rollouts

    item = lambda role, text: {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]}
    count = lambda i, o, c: {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c}}}
    patch = "*** Begin Patch\n*** Add File: a.txt\n+one\n+two\n*** Update File: b.txt\n*** Move to: c.txt\n@@\n-x\n+y\n*** Delete File: d.txt\n*** End Patch\n"
    lines = [
        rollout("session_meta", {"id": "s1", "cwd": "/p", "forked_from_id": "s0"}), rollout("turn_context", {}), rollout("response_item", item("user", "hi")), rollout("event_msg", {"type": "user_message", "message": "hi"}),
        rollout("event_msg", {"type": "agent_message", "message": "alone"}), rollout("response_item", {"type": "function_call", "name": "shell", "call_id": "k1", "arguments": '{"command":["ls"]}'}),
        rollout("response_item", {"type": "function_call_output", "call_id": "k1", "output": "done"}), rollout("event_msg", count(100, 10, 40)), rollout("event_msg", count(100, 10, 40)), rollout("event_msg", count(150, 30, 60)),
        rollout("event_msg", count(20, 5, 0)), rollout("event_msg", count(30, 5, 50)), rollout("turn_context", {}), rollout("event_msg", {"type": "user_message", "message": "hi"}),
        rollout("response_item", {"type": "custom_tool_call", "name": "apply_patch", "call_id": "k2", "input": patch}),
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "old.jsonl").write_text('{"id":"x","timestamp":"2025"}\n{"type":"message","role":"user"}\n{"record_type":"state"}\n')
    r = rollouts.records(jsonl.lines(spark, str(tmp_path)))
    inv = {x.session_key: x for x in rollouts.inventory(r).collect()}
    assert inv["s1"].dialect == "envelope" and inv["s1"].forked_from == "s0" and inv["old"].dialect == "legacy"
    u = rollouts.usage_epochs(rollouts.token_counts(r)).orderBy("line_no").collect()
    assert [(x.epoch, x.fresh, x.added_output, x.added_cached, x.ambiguous) for x in u] == [(1, 60, 10, 40, False), (1, 0, 0, 0, False), (1, 30, 20, 20, False), (2, 20, 5, 0, False), (2, 0, 0, 50, True)]
    calls = spark.createDataFrame([("s1", "k2", patch)], "session_key string, call_id string, patch string")
    got = [(x.kind, x.path, x.moved_to, x.body, x.unparsed) for x in rollouts.declared_changes(calls).orderBy("nr").collect()]
    assert got == [("add", "a.txt", None, "one\ntwo\n", 0), ("update", "b.txt", "c.txt", "@@\n-x\n+y", 0), ("delete", "d.txt", None, None, 0)]
    assert rollouts.patch_changes("no patch") == ([], 1) and rollouts.patch_changes("*** Begin Patch\n*** Add File: a\nx\n*** End Patch") == ([("add", "a", None, None)], 1)


def entries_of(spark, rows):
    from tracelode.sources import jsonl

    lines = [(f"/x/{key}.jsonl", n, json.dumps({"type": kind, "uuid": f"{key}{n}", "timestamp": f"2024-01-01T00:00:{n:02d}.000Z", "message": {"role": kind, "content": content}})) for key, n, kind, content in rows]
    e = jsonl.entries(jsonl.parsed(spark.createDataFrame(lines, "file_path string, line_no long, line string")))
    return e, jsonl.blocks(e)


def test_index_follows_changes(spark, tmp_path):
    from tracelode.operators.index import Index

    rows = [("a", 1, "user", "find me"), ("a", 2, "assistant", "found"), ("b", 1, "user", "find that"), ("c", 1, "user", "nothing")]
    ix = Index(spark, str(tmp_path / "ix"))
    e, b = entries_of(spark, rows)
    assert ix.update(e, b) == {"added": 3} and {r.session_key for r in ix.search("find").collect()} == {"a", "b"}
    e, b = entries_of(spark, [("a", 1, "user", "lose me"), *rows[1:2], rows[3], ("d", 1, "user", "find d")])
    assert tuple(ix.coverage(e).first()) == (1, 1, 1, 1)
    assert ix.update(e, b) == {"added": 1, "changed": 1, "removed": 1, "same": 1}
    assert {r.session_key for r in ix.search("find").collect()} == {"d"} and ix.search("lose", ("user_text",)).count() == 1 and ix.search("lose", ("thinking",)).count() == 0
    assert tuple(ix.coverage(e).first()) == (3, 0, 0, 0)


def test_exports(spark, tmp_path):
    from tracelode.sources import sinks

    use = {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls  -l"}}
    e, b = entries_of(spark, [("a", 1, "user", "mail <bob@example.org>"), ("a", 2, "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, use])])
    doc = json.loads(sinks.to_json(e, b).first().document)
    assert doc["metadata"]["entry_count"] == 2 and [x["type"] for x in doc["entries"]] == ["user", "assistant"] and doc["entries"][1]["content"][1]["text"] == "ok"
    assert sinks.to_text(b).first().document == "[USER]\nmail <bob@example.org>\n\n[THINKING]\nhm\n\n[ASSISTANT]\nok\n\n[TOOL USE]\nBash: ls -l"
    e2, b2 = sinks.transformed(e, b, hide="all", only=("user",), thinking=False)
    page = sinks.to_html(b2, dark=True).first().document
    assert "mail &lt;[REDACTED]&gt;" in page and "bob" not in page and "hm" not in page and e2.count() == 1
    assert sinks.from_template(e.filter("line_no = 1").select("session_key", "uuid"), "<{{uuid}} of {{ session_key }}>").first().document == "<a1 of a>"
    # a secret in a call, a result, a thought and a text leaves no exporter, behind quotes and escapes neither
    token, word = "ghp_" + "a1B2" * 10, "hunter22x"
    rows = [
        ("a", 1, "user", f"use {token}"), ("a", 2, "assistant", [{"type": "thinking", "thinking": token}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": f'export PASSWORD="{word}" T={token}\n\\', "n": [1, None, "plain"]}}]),
        ("a", 3, "user", [{"type": "tool_result", "tool_use_id": "t", "content": f"said {token}"}]),
    ]
    e3, b3 = sinks.transformed(*entries_of(spark, rows), hide="all")
    tables = sinks.relational(e3, b3)
    out = [*[r.document for f in (sinks.to_text(b3), sinks.to_html(b3), sinks.to_json(e3, b3)) for r in f.collect()], *[str(r) for t in tables.values() for r in t.collect()], *[r.raw for r in e3.collect()]]
    assert not [x for x in out if token in x or word in x]
    given = json.loads(tables["tool_uses"].first().input)
    assert given["n"] == [1, None, "plain"] and given["command"].startswith("export PASSWORD=[REDACTED]") and given["command"].endswith("\n\\") and json.loads(e3.filter("line_no = 2").first().raw)["uuid"] == "a2"
    sinks.to_jsonl(entries_of(spark, rows)[0], f"{tmp_path}/out", hide="all")
    assert not [r.value for r in spark.read.text(f"{tmp_path}/out").collect() if token in r.value or word in r.value]
    tables = sinks.relational(e, b)
    assert tables["tool_uses"].count() == 1 and tables["content_blocks"].count() == 4 and tables["entries"].count() == 2


def test_decision_scores(spark):
    from tracelode.operators import decisions, threads, trees

    call = {"type": "tool_use", "id": "t", "name": "Edit", "input": {}}
    rows = [
        ("a", 1, "user", "start"), ("a", 2, "assistant", "We use Parquet tables for storage; alternatively CSV, option a or option b"), ("a", 3, "user", "Yes, go"), ("a", 4, "assistant", [call]),
        ("b", 1, "user", "x"), ("b", 2, "assistant", "rename modules"), ("b", 3, "user", "No, rename modules is wrong now"), ("c", 1, "user", "x"), ("c", 2, "assistant", "Parquet storage it is"), ("c", 3, "user", "why?"), ("c", 4, "assistant", [call]),
        ("e", 1, "user", "x"), ("e", 2, "assistant", "parquet storage"), ("e", 3, "user", "great"),
    ]
    lines = [(f"/x/{key}.jsonl", n, json.dumps({"type": kind, "uuid": f"{key}{n}", "parentUuid": f"{key}{n - 1}" if n > 1 else None, "timestamp": f"2024-01-01T00:00:{n:02d}.000Z", "message": {"role": kind, "content": content}})) for key, n, kind, content in rows]
    from tracelode.sources import jsonl

    e = jsonl.entries(jsonl.parsed(spark.createDataFrame(lines, "file_path string, line_no long, line string")))
    b = jsonl.blocks(e)
    main = threads.main_thread(trees.nodes(e, b), e, b)
    projects = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p"), ("e", "q")], "session_key string, project string")
    d = spark.createDataFrame([("1", "Parquet storage", "proposed", "a", None), ("2", "rename modules", "superseded", "b", None), ("3", "unheard of", "confirmed", "c", None), ("4", "Parquet storage", "proposed", "c", ["a"]), ("5", "x", "proposed", "gone", None), ("6", "Parquet storage", "proposed", "b", None)], "id string, title string, status string, session_key string, references array<string>")
    # 1: agreed, calls follow, options, and c calls after naming it; 4: the same in a, c its own; 6: a agrees and calls, c calls
    assert {r.id: r.score for r in decisions.scores(d, main, projects).collect()} == {"1": 1.0, "2": 0.15, "3": 0.6, "4": 0.95, "6": 0.7}
    said = spark.createDataFrame([("Yes", True), ("I pick b", True), ("that sounds fine", True), ("sounds fine?", False), ("no", False), (None, False), ("word " * 31 + "great", False)], "t string, want boolean")
    assert [r for r in said.select("t", "want", decisions.affirmative(F.col("t")).alias("got")).collect() if r.got != r.want] == []
