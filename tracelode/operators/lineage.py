"""Lineage of sessions: continuation units, copied prefixes, subagents and their calls; and differences of lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def edges(entries: DataFrame) -> DataFrame:
    """(child, parent, kind): a file whose entries name another session continues it; a subagent's file is spawned by the session that it names. Edges to sessions that aren't there are kept."""
    e = entries.filter("session_id is not null and session_id <> session_key")
    kind = F.when(F.col("is_subagent"), F.lit("spawn")).otherwise(F.lit("continuation"))
    return e.select(F.col("session_key").alias("child"), F.col("session_id").alias("parent"), kind.alias("kind")).distinct()


def rollout_edges(r: DataFrame) -> DataFrame:
    """(child, parent, kind, tool_use_id, agent_type) of the second dialect's records(): forks and spawns, by a file's first line.

    A fork names its parent, or, in older files, is followed at once by a copy of the parent's first line. A spawn
    names its parent's thread in the first line or in its source. Parents that aren't there are kept.
    """
    get = lambda path: F.try_variant_get(F.col("v"), path, "string")
    w = Window.partitionBy("file_path").orderBy("line_no")
    head = r.filter("dialect = 'envelope'").withColumn("nr", F.row_number().over(w)).filter("nr <= 2 and type = 'session_meta'")
    own = F.struct(get("$.payload.id").alias("id"), get("$.payload.forked_from_id").alias("forked"), get("$.payload.parent_thread_id").alias("thread"), get("$.payload.agent_role").alias("role"), *[get(f"$.payload.source.subagent.thread_spawn.{x}").alias(f"spawn_{x}") for x in ("parent_thread_id", "tool_use_id", "agent_role")])
    f = head.groupBy("file_path", "session_key").agg(F.max(F.when(F.col("nr") == 1, own)).alias("a"), F.max(F.when(F.col("nr") == 2, get("$.payload.id"))).alias("copied")).filter("a is not null")
    none = lambda name: F.lit(None).cast("string").alias(name)
    fork = F.coalesce("a.forked", F.when(F.col("copied") != F.col("a.id"), F.col("copied")))
    forks = f.select(F.col("a.id").alias("child"), fork.alias("parent"), F.lit("fork").alias("kind"), none("tool_use_id"), none("agent_type"))
    spawns = f.select(F.col("a.id").alias("child"), F.coalesce("a.thread", "a.spawn_parent_thread_id").alias("parent"), F.lit("spawn").alias("kind"), F.col("a.spawn_tool_use_id").alias("tool_use_id"), F.coalesce("a.role", "a.spawn_agent_role").alias("agent_type"))
    return forks.unionByName(spawns).filter("parent is not null and child is not null and parent <> child").distinct()


def _climbed(up: DataFrame, steps: int) -> DataFrame:
    """(node, up, low, hops) of up(node, up): 2**steps parents further, the least node on the way, and the steps that moved; a root is its own parent."""
    now = kept(up.select("node", "up", F.least("node", "up").alias("low"), F.when(F.col("node") == F.col("up"), 0).otherwise(1).cast("long").alias("hops")), "lineage")
    for _ in range(steps):
        far = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("low").alias("far_low"), F.col("hops").alias("more"))
        now = kept(now.join(far, "up").select("node", F.col("far").alias("up"), F.least("low", "far_low").alias("low"), (F.col("hops") + F.col("more")).alias("hops")), "lineage")
    return now


def units(lineage: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_key, root, depth): sessions that continue each other, by the one that they go back to.

    lineage has edges(); of several parents the smallest counts. Spawned sessions belong to no unit. Where sessions
    continue each other in a circle, the smallest of them is the root. Parents are followed by doubling, so a chain of
    n sessions takes log2(n) joins. A parent that isn't among the sessions makes its child a root.
    """
    spawned = lineage.filter("kind = 'spawn'").select(F.col("child").alias("session_key"))
    nodes = sessions.select("session_key").distinct().join(spawned, "session_key", "left_anti").select(F.col("session_key").alias("node"))
    known = nodes.select(F.col("node").alias("parent"))
    parents = lineage.filter("kind = 'continuation' and child <> parent").join(known, "parent").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    up = kept(nodes.join(parents, "node", "left").withColumn("up", F.coalesce("up", "node")), "parents")
    n = up.filter("node <> up").count()
    steps = max(1, math.ceil(math.log2(n + 1)) + 1)
    far = _climbed(up, steps)
    ends = far.select("up").distinct().join(up.select(F.col("node").alias("up"), F.col("up").alias("then")), "up").filter("up <> then")
    if ends.head(1):  # circles: whoever is met after that many steps lies on one, and has seen all of it
        roots = ends.select(F.col("up").alias("node")).join(far, "node").select(F.col("low").alias("node")).distinct().withColumn("cut", F.lit(True))
        up = kept(up.join(roots, "node", "left").select("node", F.when(F.col("cut"), F.col("node")).otherwise(F.col("up")).alias("up")), "parents")
        far = _climbed(up, steps)
    return far.select(F.col("node").alias("session_key"), F.col("up").alias("root"), F.col("hops").alias("depth"))


def copied_prefix(forks: DataFrame, records: DataFrame) -> DataFrame:
    """(child, parent, copied): how many records after its own first one a fork repeats from its parent's beginning, without a gap.

    forks(child, parent), records(session_key, pos, digest); pos counts from 0, and the digest leaves times out.
    """
    own = records.select(F.col("session_key").alias("child"), "pos", "digest").filter("pos >= 1").join(forks, "child")
    theirs = records.select(F.col("session_key").alias("parent"), (F.col("pos") + 1).alias("pos"), F.col("digest").alias("theirs"))
    both = own.join(theirs, ["parent", "pos"], "left").withColumn("same", F.coalesce(F.col("digest") == F.col("theirs"), F.lit(False)))
    first = both.groupBy("child", "parent").agg(F.min(F.when(~F.col("same"), F.col("pos"))).alias("bad"), F.max("pos").alias("last"))
    return first.select("child", "parent", F.coalesce(F.col("bad") - 1, F.col("last")).alias("copied"))


def match_subagents(calls: DataFrame, links: DataFrame) -> DataFrame:
    """(session_key, call_id, agent_key, how) of calls(session_key, call_id, nr, description) and links(session_key, agent_key, tool_use_id, description).

    First by the call's id; then a call takes the only subagent left with its description; then, if one call and one
    subagent of a session are left, they belong together. Subagents without a call follow with a null call_id.
    """
    nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    named = links.filter("tool_use_id is not null").select("session_key", F.col("tool_use_id").alias("call_id"), "agent_key")
    # of links that name one call the last one counts, of calls of one subagent the first
    named = named.withColumn("n", nth(["session_key", "call_id"], [F.desc("agent_key")])).filter("n = 1").drop("n")
    one = calls.join(named, ["session_key", "call_id"]).withColumn("n", nth(["session_key", "agent_key"], ["nr"])).filter("n = 1")
    one = one.select("session_key", "call_id", "agent_key", F.lit("id").alias("how"))
    open_calls = calls.join(one, ["session_key", "call_id"], "left_anti")
    open_links = links.join(one, ["session_key", "agent_key"], "left_anti")
    single = open_links.filter("description is not null").groupBy("session_key", "description").agg(F.count("*").alias("n"), F.min("agent_key").alias("agent_key")).filter("n = 1").drop("n")
    two = open_calls.join(single, ["session_key", "description"]).withColumn("n", nth(["session_key", "description"], ["nr"])).filter("n = 1")
    two = two.select("session_key", "call_id", "agent_key", F.lit("description").alias("how"))
    left_calls = open_calls.join(two, ["session_key", "call_id"], "left_anti").groupBy("session_key").agg(F.count("*").alias("n"), F.min("call_id").alias("call_id")).filter("n = 1").drop("n")
    left_links = open_links.join(two, ["session_key", "agent_key"], "left_anti").groupBy("session_key").agg(F.count("*").alias("n"), F.min("agent_key").alias("agent_key")).filter("n = 1").drop("n")
    three = left_calls.join(left_links, "session_key").select("session_key", "call_id", "agent_key", F.lit("only").alias("how"))
    matched = one.union(two).union(three)
    rest = links.select("session_key", "agent_key").distinct().join(matched, ["session_key", "agent_key"], "left_anti")
    return matched.union(rest.select("session_key", F.lit(None).cast("string"), "agent_key", F.lit("none")))


def line_diff(first: DataFrame, second: DataFrame, column: str = "line") -> DataFrame:
    """(line, common, only_first, only_second): how often a line stands in both, and in either beyond that. Lines are counted before they meet."""
    a = first.groupBy(F.col(column).alias("line")).agg(F.count("*").alias("a"))
    b = second.groupBy(F.col(column).alias("other")).agg(F.count("*").alias("b"))
    both = a.join(b, F.col("line").eqNullSafe(F.col("other")), "full")
    one, two = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    common = F.least(one, two)
    return both.select(F.when(F.col("a").isNull(), F.col("other")).otherwise(F.col("line")).alias("line"), common.alias("common"), (one - common).alias("only_first"), (two - common).alias("only_second"))
