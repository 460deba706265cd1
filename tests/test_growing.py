"""Files that grow: appended lines, torn tails, restarts and ranges."""

import json
import random

from pyarrow import fs


def test_ranges_share_out_the_lines(tmp_path, monkeypatch):
    from tracelode.streaming import growing

    rng = random.Random(1)
    text = b"".join(bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 40))) + rng.choice([b"\n", b"\r\n"]) for _ in range(300))
    (tmp_path / "f").write_bytes(text + b"torn")
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    for block, size in ((7, 10), (64, 1000), (1 << 16, 1 << 20), (3, 1)):
        monkeypatch.setattr(growing, "BLOCK", block)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as f:
            end = growing.last_end(f, len(text) + 4)
            assert end == len(text) and growing.last_end(f, 0) == 0
            assert [x for a in range(0, end, size) for x in growing.lines_of(f, a, min(a + size, end))] == want


def follow(spark, root, work, start="beginning"):
    from tracelode.streaming import watch

    stream = watch.follow(spark, str(root), start=start)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/check").option("path", f"{work}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.file_path.rpartition("/")[2], r.line) for r in spark.read.schema("file_path string, line_no long, line string").parquet(f"{work}/out").collect())


def test_appended_lines_arrive_once(spark, tmp_path):
    root, work = tmp_path / "logs", tmp_path / "work"
    (root / "p").mkdir(parents=True)
    a, b = root / "p" / "a.jsonl", root / "b.jsonl"
    a.write_text("one\ntwo\nhal")
    (root / "other.txt").write_text("no\n")
    assert follow(spark, root, work) == [("a.jsonl", "one"), ("a.jsonl", "two")]
    with a.open("a") as f:
        f.write("f line\nthree\nagain torn")
    b.write_text("é\n\n")
    want = [("a.jsonl", "half line"), ("a.jsonl", "one"), ("a.jsonl", "three"), ("a.jsonl", "two"), ("b.jsonl", ""), ("b.jsonl", "é")]
    assert follow(spark, root, work) == want
    assert follow(spark, root, work) == want  # started again, nothing new
    with a.open("a") as f:
        f.write("\n")
    assert follow(spark, root, work) == sorted([*want, ("a.jsonl", "again torn")])
    b.write_text("x\n")  # shorter than before: written anew
    assert follow(spark, root, work) == sorted([*want, ("a.jsonl", "again torn"), ("b.jsonl", "x")])


def test_from_the_end_on(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    a = tmp_path / "logs" / "a.jsonl"
    a.write_text("old\n")
    assert follow(spark, tmp_path / "logs", tmp_path / "work", "end") == []
    with a.open("a") as f:
        f.write("new\n")
    assert follow(spark, tmp_path / "logs", tmp_path / "work", "end") == [("a.jsonl", "new")]


def test_entries_of_a_growing_log(spark, tmp_path):
    from tracelode.streaming import watch

    (tmp_path / "logs").mkdir()
    line = lambda n: json.dumps({"type": "user", "uuid": f"u{n}", "timestamp": f"2024-01-01T00:0{n}:00.000Z", "message": {"role": "user", "content": "hi"}}) + "\n"
    (tmp_path / "logs/s.jsonl").write_text(line(0) + "not json\n" + line(1) + line(9))
    e = watch.entries(spark, str(tmp_path / "logs"))
    q = watch.states(e).writeStream.format("memory").queryName("spells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.session_key, r.entries) for r in spark.sql("select * from spells").collect()) == [("s", 1), ("s", 2)]
