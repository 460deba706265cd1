"""Subagents by folder and time, totals, transcripts, similarity and file history."""

import json
import math
import random

from test_threads import entry, result, tables, use


def nearest(mains, second, window):
    return min(((abs(second - s), k) for k, s in mains if abs(second - s) <= window), default=(None, None))[1]


def test_assigned_against_a_plain_search(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import hierarchy

    rng = random.Random(5)
    rows = []
    for i in range(400):
        sub = rng.random() < 0.6
        rows.append((rng.choice(["p", "q"]), f"k{i:03d}", sub, f"k{rng.randrange(450):03d}" if sub and rng.random() < 0.3 else None, rng.randint(0, 200_000) // 100 * 100))
    df = spark.createDataFrame(rows, "project string, session_key string, is_subagent boolean, dir_parent string, s long").withColumn("modified", F.timestamp_seconds("s"))
    for window in (3600, 500):
        got = {r.session_key: (r.parent_key, r.how) for r in hierarchy.assigned(df, window).collect()}
        for p, k, sub, folder, s in rows:
            mains = [(key, t) for q, key, is_sub, _, t in rows if q == p and not is_sub]
            want = (None, None)
            if sub and folder is not None:
                want = (folder, "folder") if folder in dict(mains) else (None, None)
            elif sub:
                near = nearest(mains, s, window)
                want = (near, "time" if near else None)
            assert got[k] == want
    assert len(got) == 400
    tree = hierarchy.assigned(df)
    stats = df.select("session_key", F.lit(1).alias("one"), "s")
    t = hierarchy.totals(tree, stats)
    assert t.agg(F.sum("one"), F.sum("sessions"), F.sum("s")).first() == (400, 400, sum(r[4] for r in rows)) and t.filter("main_sessions > 1").count() == 0


def test_transcripts_together(spark):
    from tracelode.operators import hierarchy

    rows = [
        entry(0, "user", None, "go"), entry(1, "assistant", "s0", [use("c1", "Task"), use("c2", "Task")]), entry(2, "user", "s1", [result("c1")]), entry(9, "assistant", "s2", "done"),
        entry(3, "user", None, "sub task", "agent-a"), entry(4, "assistant", "agent-a3", "y" * 600, "agent-a"), entry(5, "user", None, "other", "agent-b"), entry(6, "user", None, "own", "z"),
    ]
    e, b, forest = tables(spark, rows)
    links = spark.createDataFrame([("s", "c1", "agent-a"), ("s", "c2", "agent-b"), ("s", None, "agent-x")], "session_key string, call_id string, agent_key string")
    got = hierarchy.nested(forest, e, b, links).orderBy("session_key", "call_pos", F_nulls_first("under_call"), "pos").collect()
    assert [(r.session_key, r.under_call, r.uuid) for r in got] == [("s", None, "s0"), ("s", None, "s1"), ("s", "c1", "agent-a3"), ("s", "c1", "agent-a4"), ("s", "c2", "agent-b5"), ("s", None, "s2"), ("s", None, "s9"), ("z", None, "z6")]
    assert len(got[3].text) == 503
    tree = spark.createDataFrame([("p", "s", None, False), ("p", "agent-a", "s", True), ("p", "agent-b", "s", True), ("p", "z", None, False)], "project string, session_key string, parent_key string, is_subagent boolean")
    line = hierarchy.combined(tree, e).collect()
    assert [(r.root_key, r.label, r.line_no) for r in line] == [("s", "[Main s]", 1), ("s", "[Main s]", 2), ("s", "[Main s]", 3), ("s", "[Agent agent-a]", 1), ("s", "[Agent agent-a]", 2), ("s", "[Agent agent-b]", 1), ("s", "[Main s]", 4), ("z", "[Main z]", 1)]


def F_nulls_first(c):  # noqa: N802
    from pyspark.sql import functions as F

    return F.col(c).asc_nulls_first()


def test_similar_sessions(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import similarity

    rng = random.Random(9)
    rows = [(f"k{i}", rng.choice(["/a/b", "/a/b/c", "/x", None]), rng.randint(0, 10**6), rng.sample(["R", "W", "B"], rng.randint(0, 3)), rng.sample(["t", "u"], rng.randint(0, 2)), rng.choice([0, 10, 400])) for i in range(40)]
    df = spark.createDataFrame(rows, "session_key string, project string, s long, tools array<string>, tags array<string>, tokens long").withColumn("modified", F.timestamp_seconds("s"))

    def score(a, b):
        sets = lambda x, y, none: none if not x and not y else 100 * len(set(x) & set(y)) / len(set(x) | set(y))
        p, q = ((x[1] or "").split("/") for x in (a, b))
        shared = next((i for i, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))
        parts = {"tools": sets(a[3], b[3], 100.0), "project": 100.0 if p == q else 100 * shared / max(len(p), len(q)), "time": 100 * math.exp(-abs(a[2] - b[2]) / 604800), "tags": sets(a[4], b[4], 50.0)}
        parts["tokens"] = 100.0 if a[5] == b[5] == 0 else 0.0 if 0 in (a[5], b[5]) else 100 * (1 - abs(a[5] - b[5]) / max(a[5], b[5]))
        return sum(parts[k] * w for k, w in similarity.WEIGHTS.items()) / sum(similarity.WEIGHTS.values())

    want = sorted(((round(score(rows[3], r), 6), r[0]) for r in rows if r[0] != "k3"), key=lambda x: (-x[0], x[1]))
    got = [(round(r.total, 6), r.session_key) for r in similarity.similar(df, "k3").collect()]
    assert got == want
    assert [r.session_key for r in similarity.similar(df, "k3", least=50, most=5).collect()] == [k for t, k in want if t >= 50][:5] and similarity.similar(df, "none").count() == 0


def test_file_history(spark):
    from tracelode.operators import history, prompts
    from tracelode.sources import jsonl

    def snapshot(message, **files):
        return {"type": "file-history-snapshot", "messageId": message, "snapshot": {"messageId": message, "trackedFileBackups": {p.replace("_", "/"): {"backupFileName": b, "version": v, "backupTime": f"2024-01-01T00:{m:02d}:00.000Z"} for p, (b, v, m) in files.items()}}}

    rows = [
        entry(0, "user", None, "change it"), entry(1, "assistant", "s0", [{"type": "thinking", "thinking": "how"}, {"type": "text", "text": "so"}, use("t", "Edit")]), snapshot("s1", a_f=(None, 1, 1)) | {"sessionId": "s"}, entry(2, "user", "s1", [result("t", "no", True)]),
        entry(3, "user", "s2", "more"), snapshot("s3", a_f=("x", 1, 5), b_g=("y", 2, 4)) | {"sessionId": "s"}, entry(4, "assistant", "s3", "yes"), entry(5, "user", None, 'text with "type":"file-history-snapshot" in it', "z"),
    ]
    e, b, _ = tables(spark, rows)
    raw = e.select("file_path", "line_no", e.raw.alias("line"))
    h = history.file_history(history.snapshots(raw))
    assert sorted((r.path, r.session_key, r.version, r.line_no, r.is_new) for r in h.collect()) == [("a/f", "s", 1, 3, True), ("b/g", "s", 2, 6, False)]
    plan = history.snapshots(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "file-history-snapshot" in plan and history.snapshot_lines(raw).count() <= 3
    said = prompts.with_authors(e, prompts.texts(b))
    got = {r.path: r for r in history.evolution(h, said).collect()}
    assert (got["a/f"].prompt, got["a/f"].response, got["a/f"].thought, got["a/f"].tools, got["a/f"].had_errors) == (None, "so", "how", ["Edit"], True)
    assert (got["b/g"].prompt, got["b/g"].response, got["b/g"].had_errors) == ("more", "yes", False)
    wide = {r.path: r for r in history.evolution(h, said, context=2, pattern="f").collect()}
    assert set(wide) == {"a/f"} and wide["a/f"].prompt == "change it"
    assert [(r.path, r.changes, r.sessions) for r in history.summary(h).orderBy("path").collect()] == [("a/f", 1, 1), ("b/g", 1, 1)]
    assert jsonl.parsed(raw).count() == len(rows)


