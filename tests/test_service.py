"""Requests, registries and exports over a small log."""

import datetime

from test_logs import logs  # noqa: F401


def tables(spark, logs):  # noqa: F811
    from tracelode.sources import jsonl

    e = jsonl.entries(jsonl.parsed(jsonl.lines(spark, logs)))
    return e, jsonl.blocks(e)


def test_requests(spark, logs):  # noqa: F811
    from tracelode.operators.service import Logs

    x = Logs(*tables(spark, logs))
    assert [r.session_key for r in x.list_sessions("/P").collect()] == ["abc"]
    assert x.session("abc").entries.count() == 9 and x.session("none").entries.count() == 0
    assert x.stats("session_key").first().total_tokens == 29
    assert [r.text for r in x.messages(limit=2).collect()] == ["hi", "a"]
    assert [r.line for r in x.search("an.ther").collect()] == ["another way"]
    assert x.tool_calls("bash", failed_only=True).count() == 1 and x.lessons().count() == 1
    assert x.file_history().count() == 0 and x.priorities().count() == 0 and x.corrections().count() == 0
    assert [r.place for r in x.context("u1", 1).orderBy("place").collect()] == [-1, 0, 1]


def test_registry(spark, tmp_path):
    import pytest
    from tracelode.operators.registry import Registry

    r, at = Registry(spark, str(tmp_path / "store")), datetime.datetime(2024, 1, 1)
    assert r.items().count() == 0
    r.put("goal", "g1", at, name="ship", status="open")
    r.put("goal", "g1", at, status="done")
    r.put("tag", "t1", at, session_key="s", name="x")
    r.put("tag", "t2", at, session_key="s", name="y")
    r.remove("tag", "t2", at)
    r.put("decision", "d1", at, name="a", status="proposed")
    r.supersede("d1", "d2", at, name="b")
    goal = r.items("goal").first()
    assert (goal.name, goal.status) == ("ship", "done") and r.items("tag").count() == 1
    assert {(d.id, d.status) for d in r.items("decision").collect()} == {("d1", "superseded"), ("d2", "confirmed")}
    assert r.annotate(spark.createDataFrame([("s",), ("z",)], "session_key string")).filter("tags is not null").first().tags == ["x"]
    with pytest.raises(ValueError):
        r.put("goal", "g2", at, status="odd")


def test_exports(spark, logs, tmp_path):  # noqa: F811
    from tracelode.sources import sinks

    e, b = tables(spark, logs)
    sinks.to_jsonl(e, str(tmp_path / "raw"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "raw")).collect()) == sorted(r.raw for r in e.collect())
    sinks.to_csv(sinks.messages(e, b), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert len(back) == 8 and {r.uuid: r.tool_count for r in back}["u2"] == "1"
    assert sinks.to_markdown(e, b).first().document.startswith("## User\n\nhi\n\n## Assistant\n\na")
    code = spark.createDataFrame([("s", 1, 0, "text", "user", "x ```py\nprint(1)\n``` y")], "session_key string, line_no int, block_no int, block_type string, entry_type string, text string")
    assert [(r.language, r.code) for r in sinks.code_blocks(code).collect()] == [("py", "print(1)\n")]
