"""Sequence and text diffs, file versions, and the posting index."""

import difflib
import json
import random
import tracemalloc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_is_longest():
    from tracelode.operators import replay

    rng = random.Random(2)
    for _ in range(400):
        letters = "abcdefghij"[: rng.randint(1, 10)]
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
        pairs = replay.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == lcs(a, b)
    a = ["x"] * 500 + ["y"] * 300
    assert len(replay.common(a, a[::-1])) == 500


def test_memory_is_linear():
    from tracelode.operators import replay

    rng = random.Random(3)
    for a, b in (([f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)]), ([str(i) for i in range(20_000)], [str(i) for i in rng.sample(range(20_000), 20_000)])):
        tracemalloc.start()
        pairs = replay.common(a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6 and (len(pairs) > 200) == (a[0] == "0")


def applied(a, diff):
    """a after the hunks of a unified diff."""
    out, at = [], 0
    lines = diff.split("\n")[:-1]
    k = 0
    while k < len(lines):
        start, n = map(int, lines[k].split()[1][1:].split(","))
        start = start - 1 if n else start
        out += a[at:start]
        at, k = start, k + 1
        while k < len(lines) and not lines[k].startswith("@@ -"):
            sign, text = lines[k][0], lines[k][1:]
            if sign != "+":
                assert a[at] == text
                at += 1
            if sign != "-":
                out.append(text)
            k += 1
    return out + a[at:]


def test_hunks():
    from tracelode.operators import replay

    added, removed, same, diff = replay.hunks(["line 1", "line 2", "line 3"], ["line 1", "line 2 modified", "line 3", "line 4"])
    assert (added, removed, same) == (2, 1, 2) and diff == "@@ -1,3 +1,4 @@\n line 1\n-line 2\n+line 2 modified\n line 3\n+line 4\n"
    a = [str(i) for i in range(40)]
    b = [*a[:5], "x", *a[5:20], *a[21:]]
    mine = replay.hunks(a, b)[3]
    assert mine == "".join(x + "\n" for x in list(difflib.unified_diff(a, b, lineterm=""))[2:]) and replay.hunks(a, a)[3] == "" and replay.hunks([], [])[:3] == (0, 0, 0)
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(2))
        added, removed, same, diff = replay.hunks(a, b)
        assert applied(a, diff) == b and added + same == len(b) and removed + same == len(a)


def test_versions_of_files(spark, tmp_path):
    import os

    from tracelode.operators import replay

    for k, (name, text) in enumerate([("home-me-f.rs-aa.bak", "one\ntwo\n"), ("home-me-f.rs-bb.bak", "one\n2\nthree\n"), ("home-me-f.rs-cc.bak", "one\n2\nthree\n"), ("home-me-g-dd.bak", "x"), ("note.txt", "no")]):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    v = replay.backups(spark, str(tmp_path))
    assert sorted((r.path, r.version, r.size) for r in v.collect()) == [("home/me/f.rs", 1, 8), ("home/me/f.rs", 2, 12), ("home/me/f.rs", 3, 12), ("home/me/g", 1, 1)]
    d = {r.version: r for r in replay.version_diffs(v).collect()}
    assert (d[2].added, d[2].removed, d[2].unchanged, d[2].diff) == (2, 1, 1, "@@ -1,2 +1,3 @@\n one\n-two\n+2\n+three\n") and (d[3].added, d[3].diff) == (0, "") and set(d) == {2, 3}
    assert [(r.path, r.content) for r in replay.at_version(v, 2).collect()] == [("home/me/f.rs", "one\n2\nthree\n")]


def blocks_of(spark, texts):
    from tracelode.sources import jsonl

    lines = [(f"/x/s{i % 7}.jsonl", i, json.dumps({"type": "user", "uuid": f"u{i}", "message": {"role": "user", "content": t}})) for i, t in enumerate(texts)]
    e = jsonl.entries(jsonl.parsed(spark.createDataFrame(lines, "file_path string, line_no long, line string")))
    return e, jsonl.blocks(e)


def test_postings_find_what_a_full_search_finds(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracelode.operators import index

    rng = random.Random(6)
    words = ["alpha", "Alphabet", "beta", "be", "42x", "ünalpha", "y" * 39, "y" * 40 + "alpha", "al-pha", "gamma"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    ix = index.Index(spark, str(tmp_path / "ix"))
    e, b = blocks_of(spark, texts)
    ix.update(e, b)
    whole = index.segments(b)
    for pattern in ("alpha", "ALPHA", "bet", "42x", "nosuch", "yyy", "al-pha", "be", "^beta"):
        for low in (False, True):
            want = sorted(r.line_no for r in whole.filter(F.col("text").rlike("(?i)" + pattern if low else pattern)).collect())
            assert sorted(r.line_no for r in ix.search(pattern, ignore_case=low).collect()) == want, (pattern, low)
    assert index.literal("al-pha") is index.literal("be") is None and index.literal("Beta") == "beta"
    plan = ix.search("gamma")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    n = ix.narrowed("gamma").first()
    held = lambda t: "gamma" in t or any(ord(c) > 127 for c in t) or "y" * 40 in t
    assert n.segments == 120 and n.candidates == sum(map(held, texts)) and n.fallback == sum(held(t) and "gamma" not in t for t in texts)
    # a later generation, and then one in place of both
    e, b = blocks_of(spark, [*texts[:50], *["gamma ray"] * 70])
    ix.update(e, b)
    want = sorted(r.line_no for r in index.segments(b).filter("text like '%gamma%'").collect())
    assert sorted(r.line_no for r in ix.search("gamma").collect()) == want
    assert ix.compact() == 2 and sorted(r.line_no for r in ix.search("gamma").collect()) == want and ix.update(e, b) == {"same": 7}
    none = index.Index(spark, str(tmp_path / "none"))
    assert none.search("gamma").count() == 0 == none.compact()
