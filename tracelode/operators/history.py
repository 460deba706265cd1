"""Files over sessions: what snapshots say of them, and what was said around each change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import jsonl

#: Where a line's type has to stand for it to be parsed.
HEAD = 65_536


def snapshot_lines(raw: DataFrame) -> DataFrame:
    """The lines of raw(file_path, line_no, line) that may be snapshots of files, by their beginning alone: others are never parsed."""
    return raw.filter(F.substring("line", 1, HEAD).rlike(r'"type"\s*:\s*"file-history-snapshot"'))


def snapshots(raw: DataFrame) -> DataFrame:
    """(session_key, line_no, message_id, path, version, at, is_new): each file that a snapshot lists."""
    p = jsonl.parsed(snapshot_lines(raw)).filter("status = 'parsed'")
    name = F.regexp_extract("file_path", r"([^/]+?)(\.jsonl)?(\.zst)?$", 1)
    get = lambda path, kind="string": F.try_variant_get(F.col("v"), path, kind)
    of = lambda path, kind="string": F.try_variant_get(F.col("backup"), path, kind)
    s = p.filter(get("$.type") == "file-history-snapshot").select(name.alias("session_key"), "line_no", get("$.messageId").alias("message_id"), F.explode(get("$.snapshot.trackedFileBackups", "map<string,variant>")).alias("path", "backup"))
    return s.select("session_key", "line_no", "message_id", "path", of("$.version", "int").alias("version"), F.try_to_timestamp(of("$.backupTime")).alias("at"), of("$.backupFileName").isNull().alias("is_new"))


def file_history(listed: DataFrame) -> DataFrame:
    """snapshots() without repetitions: a snapshot lists all files each time one changes, so of each path, session and version the earliest stays."""
    w = Window.partitionBy("path", "session_key", "version").orderBy(F.col("at").asc_nulls_last(), "line_no")
    return listed.withColumn("nr", F.row_number().over(w)).filter("nr = 1").drop("nr")


def summary(history: DataFrame) -> DataFrame:
    """(path, changes, sessions, first_at, last_at)."""
    return history.groupBy("path").agg(F.count("*").alias("changes"), F.count_distinct("session_key").alias("sessions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def evolution(history: DataFrame, said: DataFrame, context: int = 1, chars: int = 500, pattern: str | None = None) -> DataFrame:
    """Each change of file_history() with what was said around it.

    said is prompts.with_authors(). Around are the entries at most `context` places from the change's line in its
    session, or, where entries have turns, those of the turns at most `context` from the change's. (path, session_key,
    line_no, version, at, prompt, response, thought, tools, had_errors): the first person's text, the first answer and
    thought, all tools in order, and whether a result failed. pattern keeps paths that hold it.
    """
    full = history.filter(F.col("path").contains(pattern)) if pattern else history
    sessions = full.select("session_key").distinct()
    s = said.join(sessions, "session_key", "left_semi").select("session_key", "line_no", "entry_type", "text", "thinking", "tools", "errors", "human", "turn_id")
    # changes and entries in one order: a change's own place is after the entries up to its line
    h = full.select("session_key", "line_no").distinct().withColumn("change", F.lit(True))
    x = s.join(h, ["session_key", "line_no"], "full").withColumn("change", F.coalesce("change", F.lit(False)))
    by = Window.partitionBy("session_key").orderBy("line_no")
    turn = F.last("turn_id", ignorenulls=True).over(by)
    x = x.withColumn("turn", turn).withColumn("place", F.row_number().over(by))
    x = x.withColumn("turn_nr", F.sum(F.coalesce((F.col("turn") != F.lag("turn").over(by)).cast("int"), F.lit(0))).over(by))
    place = F.when(F.col("turn").isNotNull(), F.col("turn_nr")).otherwise(F.col("place"))
    x = x.withColumn("at_place", place)
    near = x.filter("change").select("session_key", F.col("line_no").alias("change_line"), F.explode(F.sequence(F.col("at_place") - context, F.col("at_place") + context)).alias("at_place"))
    around = near.join(x.filter("entry_type is not null"), ["session_key", "at_place"])
    first = lambda c, cond: F.min_by(F.col(c), F.when(cond & F.col(c).isNotNull(), F.col("line_no")))
    cut = lambda c: T.truncated(F.trim(c), chars)
    assistant = F.col("entry_type") == "assistant"
    tools = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "tools"))), lambda t: t["tools"])))
    told = around.groupBy("session_key", F.col("change_line").alias("line_no")).agg(cut(first("text", F.col("human"))).alias("prompt"), cut(first("text", assistant)).alias("response"), cut(first("thinking", assistant)).alias("thought"), tools.alias("tools"), F.bool_or(F.col("errors") > 0).alias("had_errors"))
    out = full.join(told, ["session_key", "line_no"], "left")
    return out.select("path", "session_key", "line_no", "version", "at", "prompt", "response", "thought", F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), F.coalesce("had_errors", F.lit(False)).alias("had_errors"))

