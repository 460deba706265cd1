"""Sessions and the subagents that they ran: who belongs to whom, totals over both, and transcripts put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prompts

WINDOW = 3600


def assigned(sessions: DataFrame, window: int = WINDOW) -> DataFrame:
    """(project, session_key, parent_key, is_subagent, how) of sessions(project, session_key, is_subagent, dir_parent, modified).

    A subagent in a folder of its parent belongs to that session, if it is a main one. Without such a folder it
    belongs to the main session of its project that was modified nearest to it, at most `window` seconds apart; of
    equal distances the smaller key. Others stand alone. how is folder, time, or null.

    Times are cut into pieces of the window's length: a session is near only to those of its own piece and the two
    beside it, so a project falls apart into groups by time, and in each the nearest before and after are looked up.
    """
    s = sessions.withColumn("second", F.unix_seconds(F.col("modified").cast("timestamp")))
    main, sub = s.filter("not is_subagent"), s.filter("is_subagent")
    known = main.select("project", F.col("session_key").alias("dir_parent")).distinct().withColumn("by_folder", F.lit(True))
    sub = sub.join(known, ["project", "dir_parent"], "left")
    free = sub.filter("dir_parent is null").select("project", "session_key", "second")
    piece = F.floor(F.col("second") / window)
    one = main.groupBy("project", "second").agg(F.min("session_key").alias("main_key"))
    around = one.select("project", F.explode(F.array(piece - 1, piece, piece + 1)).alias("piece"), "second", "main_key", F.lit(None).cast("string").alias("session_key"))
    line = around.unionByName(free.select("project", piece.alias("piece"), "second", F.lit(None).cast("string").alias("main_key"), "session_key"))
    by = Window.partitionBy("project", "piece").orderBy("second")
    here = F.when(F.col("main_key").isNotNull(), F.struct("second", "main_key"))
    line = line.withColumn("before", F.last(here, ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(here, ignorenulls=True).over(by.rangeBetween(0, Window.unboundedFollowing)))
    far = lambda c: F.struct(F.abs(F.col(f"{c}.second") - F.col("second")).alias("far"), F.col(f"{c}.main_key").alias("main_key"))
    near = F.array_min(F.filter(F.array(far("before"), far("after")), lambda x: x["far"] <= window))
    timed = line.filter("session_key is not null").select("project", "session_key", near["main_key"].alias("near_key"))
    sub = sub.join(timed, ["project", "session_key"], "left")
    parent = F.when(F.col("by_folder"), F.col("dir_parent")).otherwise(F.col("near_key"))
    how = F.when(F.col("by_folder"), "folder").when(F.col("near_key").isNotNull(), "time")
    sub = sub.select("project", "session_key", parent.alias("parent_key"), "is_subagent", how.alias("how"))
    return main.select("project", "session_key", F.lit(None).cast("string").alias("parent_key"), "is_subagent", F.lit(None).cast("string").alias("how")).unionByName(sub)


def totals(tree: DataFrame, stats: DataFrame) -> DataFrame:
    """Sums of stats(session_key, numbers...) over each session of assigned() and the subagents that belong to it, with how many of both there are."""
    numbers = [c for c in stats.columns if c != "session_key"]
    x = tree.withColumn("root_key", F.coalesce("parent_key", "session_key")).join(stats, "session_key", "left")
    return x.groupBy("root_key").agg(
        F.count("*").alias("sessions"), F.count_if(~F.col("is_subagent")).alias("main_sessions"), F.count_if("is_subagent").alias("subagent_sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]
    )


def combined(tree: DataFrame, entries: DataFrame) -> DataFrame:
    """(root_key, label, ts, session_key, line_no, raw): the entries of each session and its subagents by time, entries without one first. Rows are ordered by ranges; no group holds a session."""
    short = F.substring("session_key", 1, 8)
    label = F.when(F.col("is_subagent"), F.concat(F.lit("[Agent "), short, F.lit("]"))).otherwise(F.concat(F.lit("[Main "), short, F.lit("]")))
    t = tree.select("session_key", F.coalesce("parent_key", "session_key").alias("root_key"), label.alias("label"))
    x = entries.select("session_key", "line_no", "ts", "raw").join(t, "session_key")
    return x.select("root_key", "label", "ts", "session_key", "line_no", "raw").orderBy("root_key", F.col("ts").asc_nulls_first(), "session_key", "line_no")


def nested(forest: DataFrame, entries: DataFrame, blocks: DataFrame, links: DataFrame, thinking: bool = False) -> DataFrame:
    """Main threads with the transcripts of matched subagents under their calls.

    links(session_key, call_id, agent_key) says which call ran which subagent. A row is an entry; under_call is null
    for the session's own, and call_pos and pos give the order: session_key, call_pos, under_call (nulls first), pos.
    text is cut at 500 characters, thought at 1,000.
    """
    on = forest.filter("is_main").select("session_key", "uuid", F.col("main_pos").alias("pos"))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))
    said = prompts.texts(blocks).select("session_key", "uuid", "ts", "entry_type", cut("text", 500).alias("text"), "tools", *([cut("thinking", 1000).alias("thought")] if thinking else []))
    rows = on.join(said, ["session_key", "uuid"])
    agents = links.filter("call_id is not null").select(F.col("session_key").alias("of"), "call_id", F.col("agent_key").alias("session_key"))
    calls = blocks.filter("block_type = 'tool_use'").select(F.col("session_key").alias("of"), "call_id", "uuid").join(on.select(F.col("session_key").alias("of"), "uuid", F.col("pos").alias("call_pos")), ["of", "uuid"]).groupBy("of", "call_id").agg(F.min("call_pos").alias("call_pos"))
    under = rows.join(agents, "session_key").join(calls, ["of", "call_id"]).withColumn("agent_key", F.col("session_key"))
    cols = [c for c in rows.columns if c not in ("session_key", "pos")]
    inner = under.select(F.col("of").alias("session_key"), "call_pos", F.col("call_id").alias("under_call"), "agent_key", "pos", *cols)
    own = rows.join(agents.select("session_key").distinct(), "session_key", "left_anti")
    own = own.select("session_key", F.col("pos").alias("call_pos"), F.lit(None).cast("string").alias("under_call"), F.lit(None).cast("string").alias("agent_key"), "pos", *cols)
    return own.unionByName(inner)
