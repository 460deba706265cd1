"""Usage, tools and errors of the canonical entries and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rates that a card may have, as it goes to all tasks.
CARD = 10_000
TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def turns(entries: DataFrame) -> DataFrame:
    """One row an assistant message: the chunks that stream it repeat its usage, so each count is their maximum; null stays null."""
    a = entries.filter("entry_type = 'assistant'").withColumn("turn", F.coalesce("message_id", "uuid"))
    return a.groupBy("session_key", "model", "turn").agg(*[F.max(c).alias(c) for c in TOKENS], F.min("ts").alias("ts"), F.max_by("stop_reason", "line_no").alias("stop_reason"), F.count("*").alias("chunks"))


def token_totals(t: DataFrame, *by: str) -> DataFrame:
    """Sums of turns by the columns, with total and work tokens and the cache's hit rate."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    s = t.groupBy(*by).agg(*[F.sum(c).alias(c) for c in TOKENS], F.count("*").alias("turns"))
    cache = zero("cache_creation_tokens") + zero("cache_read_tokens")
    return (
        s.withColumn("total_input", zero("input_tokens") + cache)
        .withColumn("total_tokens", F.col("total_input") + zero("output_tokens"))
        .withColumn("work_tokens", zero("input_tokens") + zero("cache_creation_tokens") + zero("output_tokens"))
        .withColumn("cache_hit_rate", F.when(cache == 0, 0.0).otherwise(100.0 * zero("cache_read_tokens") / cache))
    )


def costs(t: DataFrame, rates: DataFrame, *by: str) -> DataFrame:
    """Cost of turns under rates(model_pattern, since, until, input, output, cache_write, cache_read), USD a million tokens.

    Patterns are regular expressions on the model's name without its date. What no rate covers is listed, and
    never counts as free: the cost is null where nothing has a price. A turn without a time has the rate that is
    still in force.
    """
    m = t.withColumn("model_name", F.regexp_replace("model", r"-\d{8}$", ""))
    at = F.to_date("ts")
    dated = ((F.col("since").isNull()) | (at >= F.col("since"))) & ((F.col("until").isNull()) | (at < F.col("until")))
    on = F.expr("model_name rlike model_pattern") & F.when(at.isNull(), F.col("until").isNull()).otherwise(dated)
    if rates.limit(CARD + 1).count() > CARD:
        raise ValueError(f"more than {CARD} rates: a card is compared with every turn")
    j = m.join(F.broadcast(rates), on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = (zero("input_tokens") * F.col("input") + zero("output_tokens") * F.col("output") + zero("cache_creation_tokens") * F.col("cache_write") + zero("cache_read_tokens") * F.col("cache_read")) / 1e6
    return j.withColumn("cost", cost).groupBy(*by).agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_set(F.when(F.col("input").isNull(), F.col("model")))).alias("unpriced"))


def tool_calls(blocks: DataFrame) -> DataFrame:
    """Calls with their results: the last definition of an id wins, and so does the last result."""
    last = Window.partitionBy("session_key", "id").orderBy(F.desc("line_no"), F.desc("block_no"))
    calls = blocks.filter("block_type = 'tool_use'").withColumn("id", F.col("call_id")).withColumn("nr", F.row_number().over(last)).filter("nr = 1")
    results = blocks.filter("block_type = 'tool_result'").withColumn("id", F.col("tool_use_id")).withColumn("nr", F.row_number().over(last)).filter("nr = 1")
    r = results.select("session_key", "id", F.col("line_no").alias("result_line"), F.col("result_text").alias("result"), F.col("is_error").alias("failed"))
    return calls.select("session_key", "id", "line_no", "ts", "tool_name", F.to_json("tool_input").alias("input")).join(r, ["session_key", "id"], "left")


def next_success(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Failed results with the first assistant entry after each."""
    failed = blocks.filter("block_type = 'tool_result' and is_error").select("session_key", "line_no").distinct().withColumn("failed", F.lit(True))
    w = Window.partitionBy("session_key").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    e = entries.join(failed, ["session_key", "line_no"], "left").withColumn("fix_line", F.first(F.when(F.col("entry_type") == "assistant", F.col("line_no")), ignorenulls=True).over(w))
    return e.filter("failed").select("session_key", "line_no", "uuid", "fix_line")


def sessions(entries: DataFrame) -> DataFrame:
    """One row a session, from its entries alone."""
    return entries.groupBy("session_key").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("entries"), F.count_if(F.col("entry_type") == "user").alias("users"),
        F.count_distinct(F.when(F.col("entry_type") == "assistant", F.coalesce("message_id", "uuid"))).alias("assistants"), F.min_by("cwd", "line_no").alias("cwd"),
        F.max_by("version", "line_no").alias("version"), F.bool_or(F.col("subtype") == "compact_boundary").alias("compacted"), F.min_by("session_id", "line_no").alias("session_id"),
    )


def phases(entries: DataFrame, short: int = 120, edge: int = 30) -> DataFrame:
    """(session_key, line_no, phase, minutes_in, after_compaction): sessions of up to `short` minutes fall into thirds, longer ones have `edge` minutes at either end."""
    all_, so_far = Window.partitionBy("session_key"), Window.partitionBy("session_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    e = entries.withColumn("into", t - F.min(t).over(all_)).withColumn("left", F.max(t).over(all_) - t)
    whole = F.col("into") + F.col("left")
    ratio = F.when(whole == 0, F.lit(0.0)).otherwise(F.col("into") / whole)
    third = F.when(ratio < 0.33, "early").when(ratio < 0.67, "middle").otherwise("late")
    ends = F.when(F.col("into") < edge, "early").when(F.col("left") < edge, "late").otherwise("middle")
    compacted = F.coalesce(F.bool_or(F.col("subtype") == "compact_boundary").over(so_far), F.lit(False))
    return e.select("session_key", "line_no", F.when(whole <= short, third).otherwise(ends).alias("phase"), F.floor("into").cast("long").alias("minutes_in"), compacted.alias("after_compaction"))


def correlated_files(commits: DataFrame, committed: DataFrame, touched: DataFrame) -> DataFrame:
    """(session_key, sha, path): the files touched(session_key, path) in a session that a commit of it, commits_of(), has among committed(sha, path): one whose path ends with the file's name. Only a session's files and its own commits' meet."""
    name = F.regexp_extract("path", r"([^/]+)/*$", 1)
    t = touched.select("session_key", "path", name.alias("name")).filter("name <> ''").distinct()
    c = commits.select("session_key", "sha").join(committed.select("sha", F.col("path").alias("in_commit")), "sha")
    return t.join(c, "session_key").filter(F.col("in_commit").endswith(F.col("name"))).select("session_key", "sha", "path").distinct()


#: Seconds of the shortest span of time, and how often spans double.
SPAN, DOUBLED = 3_600, 20


def commits_of(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """(session_key, sha, at): commits(repo, sha, at) in a session's own folder between its start and its end.

    A session's time is parted into the largest spans of one, two, four ... hours that begin at a multiple of their
    size, and a commit stands under the one span of each size that holds it. So sessions meet commits by equal spans:
    each pair once, and none but those that a session's first or last hour then rules out.
    """
    hour = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / SPAN).cast("long")
    s = sessions.select("session_key", F.col("cwd").alias("repo"), "start_ts", "end_ts").filter("repo is not null and start_ts <= end_ts")
    s = s.withColumns({"low": hour("start_ts"), "high": hour("end_ts") + 1})
    # at a level, a span without a partner within the session is taken; the rest goes on in pairs
    low, high = "-shiftright(-low, level)", "shiftright(high, level)"
    taken = f"filter(array(if({low} % 2 <> 0, {low}, null), if({high} % 2 <> 0, {high} - 1, null)), x -> x is not null)"
    parts = f"flatten(transform(sequence(0, {DOUBLED}), level -> transform(case when {low} >= {high} then array() when level = {DOUBLED} then sequence({low}, {high} - 1) else {taken} end, x -> struct(level, x as span))))"
    s = s.select("session_key", "repo", "start_ts", "end_ts", F.expr(f"inline({parts})"))
    c = commits.select("repo", "sha", "at", hour("at").alias("hour")).select("repo", "sha", "at", F.explode(F.sequence(F.lit(0), F.lit(DOUBLED))).alias("level"), "hour")
    c = c.select("repo", "sha", "at", "level", F.expr("shiftright(hour, level)").alias("span"))
    return s.join(c.hint("merge"), ["repo", "level", "span"]).filter("at between start_ts and end_ts").select("session_key", "sha", "at")
