"""Main threads read along: topics with what was asked and answered, turns, timelines and chunks by prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import prompts

BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)


def main_thread(forest: DataFrame, entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The texts of each session's main thread with their authors, and pos, their order along it. forest is nodes() of the same tables."""
    on = forest.filter("is_main").select("session_key", "uuid", "line_no", F.col("main_pos").alias("pos"))
    return prompts.with_authors(entries, prompts.texts(blocks)).join(on, ["session_key", "uuid", "line_no"])


def topic(main: DataFrame, pattern: str, role: str | None = None, decisions: bool = False, thinking: bool = False, limit: int = 30) -> DataFrame:
    """Entries of main_thread() that a pattern matches, with what was asked before and answered after, in the order of time.

    Each match is counted in its segment; an entry's provenance is its best one (its own words before quotes before
    what the harness wrote), and if more than `limit` entries match, those of better provenance and then the earlier
    ones stay. location is the entry's type, or thinking where only that matches. decisions keeps points of decision
    alone: entries that look like one, and prompts that are answered by one.
    """
    w = Window.partitionBy("session_key").orderBy("pos")
    near = lambda who, c, frame, pick: pick(F.when(F.col("entry_type") == who, F.struct(c)), ignorenulls=True).over(w.rowsBetween(*frame))[c]
    x = main.withColumns({
        "asked": F.when(F.col("entry_type") == "user", F.col("text")).otherwise(near("user", "text", BEFORE, F.last)),
        "answered": F.when(F.col("entry_type") == "assistant", F.col("text")).otherwise(near("assistant", "text", AFTER, F.first)),
        "thought": F.when(F.col("entry_type") == "assistant", F.col("thinking")).otherwise(near("assistant", "thinking", AFTER, F.first)),
    })
    own = prompts.segments(F.col("text"), F.col("injected"))
    counted = lambda s: F.transform(s, lambda p: F.struct(F.when(p["kind"] == prompts.PRIMARY, 0).when(p["kind"] == prompts.QUOTED, 1).otherwise(2).alias("rank"), F.regexp_count(p["text"], F.lit(pattern)).alias("n")))
    inner = prompts.segments(F.col("thinking"), F.lit(False)) if thinking else F.array().cast("array<struct<kind:string,text:string>>")
    x = x.withColumns({"in_text": counted(own), "in_thought": counted(inner)})
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["n"])
    x = x.withColumn("matches", total("in_text") + total("in_thought")).filter("matches > 0")
    rank = F.array_min(F.transform(F.filter(F.concat("in_text", "in_thought"), lambda s: s["n"] > 0), lambda s: s["rank"]))
    x = x.withColumns({"rank": rank, "location": F.when(total("in_text") > 0, F.col("entry_type")).otherwise("thinking")})
    if role:
        x = x.filter(F.col("entry_type") == role)
    if decisions:
        x = x.filter(prompts.decides(F.col("text")) | ((F.col("entry_type") == "user") & prompts.decides(F.col("answered"))))
    best = x.orderBy("rank", "ts", "session_key", "uuid").limit(limit)
    cut = lambda c: T.truncated(F.trim(c), 500)
    provenance = F.element_at(F.array(*[F.lit(k) for k in (prompts.PRIMARY, prompts.QUOTED, prompts.INJECTED)]), F.col("rank") + 1)
    shown = [cut("asked").alias("asked"), cut("answered").alias("answered"), *([cut("thought").alias("thought")] if thinking else [])]
    return best.select("session_key", "uuid", "ts", *shown, "location", provenance.alias("provenance"), "matches").orderBy("ts", "session_key", "uuid")


def turns(main: DataFrame) -> DataFrame:
    """(session_key, turn, ...) of main_thread(): a row for each turn.

    With turn_id (the second dialect) a turn begins at a person's prompt that isn't given mid-turn, and where turn_id
    changes; without, each user's entry takes the assistant's right after it, and other assistants' stand alone. Turns
    with neither a person's word, a call nor an assistant's text don't count. prompt is the first person's text,
    steering those given mid-turn, summary the last assistant's text, files those of the same entry.
    """
    by = Window.partitionBy("session_key").orderBy("pos")
    typed = F.max(F.col("turn_id").isNotNull()).over(Window.partitionBy("session_key"))
    kept = F.last("turn_id", ignorenulls=True).over(by.rowsBetween(*BEFORE))
    boundary = F.col("human") & ~F.col("mid_turn")
    changed = F.col("turn_id").isNotNull() & F.when(kept.isNotNull(), F.col("turn_id") != kept).otherwise(F.row_number().over(by) > 1)
    assistant = F.col("entry_type") == "assistant"
    follows = (F.lag("entry_type").over(by) == "user") & (F.lag("pos").over(by) == F.col("pos") - 1)
    alone = (F.col("entry_type") == "user") | ~F.coalesce(follows, F.lit(False))
    x = main.withColumn("begins", F.when(typed, boundary | changed).otherwise(alone)).withColumn("typed", typed)
    x = x.withColumn("nr", F.sum(F.col("begins").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c.alias("x")))), lambda s: s["x"])
    texts = lambda c: F.filter(in_order(F.when(c, F.col("text"))), lambda t: t.isNotNull())
    spoke = assistant & F.col("text").isNotNull()
    last = F.max_by(F.struct("text", "files", "ts"), F.when(F.when(F.col("typed"), spoke).otherwise(assistant), F.col("pos")))
    t = x.groupBy("session_key", "nr").agg(
        F.min("pos").alias("pos"), F.try_element_at(texts(boundary), F.lit(1)).alias("prompt"), texts(F.col("human") & F.col("mid_turn")).alias("steering"), last.alias("said"),
        F.array_distinct(F.flatten(in_order(F.col("tools")))).alias("tools"), (F.sum("errors") > 0).alias("had_errors"), 
        F.min_by("ts", F.when(F.when(F.col("typed"), boundary).otherwise(F.col("entry_type") == "user"), F.col("pos"))).alias("asked_ts"), F.min_by("ts", F.when(F.col("human") & F.col("mid_turn"), F.col("pos"))).alias("steered_ts"),
        F.bool_or(F.col("human") | (F.size("tools") > 0) | spoke | ~F.col("typed")).alias("counts"),
    )
    t = t.filter("counts").withColumn("turn", F.row_number().over(Window.partitionBy("session_key").orderBy("pos")) - 1)
    return t.select("session_key", "turn", F.coalesce("asked_ts", "steered_ts", "said.ts").alias("ts"), "prompt", "steering", F.col("said.text").alias("summary"), "tools", F.coalesce("said.files", F.array().cast("array<string>")).alias("files"), "had_errors")


def timeline(t: DataFrame, prompt_chars: int = 200, summary_chars: int = 200) -> DataFrame:
    """turns() as a timeline: runs of two or more turns that only call tools are one row, with their tools and files in order, whether one failed, and how many they are."""
    quiet = F.col("prompt").isNull() & (F.size("steering") == 0) & F.col("summary").isNull()
    by = Window.partitionBy("session_key").orderBy("turn")
    x = t.withColumn("quiet", quiet)
    x = x.withColumn("row", F.sum((~(F.col("quiet") & F.coalesce(F.lag("quiet").over(by), F.lit(False)))).cast("int")).over(by))
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col(c).alias("x")))), lambda s: s["x"])))
    first = lambda c: F.min_by(c, "turn")
    cut = lambda c, n: T.truncated(F.trim(c), n)
    r = x.groupBy("session_key", "row").agg(
        F.count("*").alias("n"), F.min("turn").alias("turn"), first("ts").alias("ts"), first("prompt").alias("prompt"), first("steering").alias("steering"), first("summary").alias("summary"), in_order("tools").alias("tools"), in_order("files").alias("files"),
        F.bool_or("had_errors").alias("had_errors"),
    )
    summary = F.when(F.col("n") > 1, F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" tool-only turns collapsed]"))).otherwise(cut("summary", summary_chars))
    return r.select("session_key", "turn", "n", "ts", cut("prompt", prompt_chars).alias("prompt"), F.transform("steering", lambda s: T.truncated(F.trim(s), prompt_chars)).alias("steering"), summary.alias("summary"), "tools", "files", "had_errors")


def chunks(forest: DataFrame, boundaries: DataFrame, times: DataFrame) -> DataFrame:
    """(session_key, uuid, chunk, place, fork_root) of all nodes: which prompt's chunk each belongs to, and how.

    boundaries(session_key, uuid) are the prompts that may open a chunk, times(session_key, uuid, ts) the nodes'. On
    the main thread each opens one, and what comes before the first is the preamble (chunk null). A node off the thread
    goes to the chunk of the node that its branch hangs by; one that hangs by none to the last chunk whose prompt isn't
    later than it, if there is one. Branches that begin with a prompt are branches, other nodes attached.
    """
    opens = boundaries.select("session_key", "uuid").distinct().withColumn("opens", F.lit(True))
    n = forest.select("session_key", "uuid", "is_main", "main_pos", "fork_root", "anchor").join(opens, ["session_key", "uuid"], "left").join(times.select("session_key", "uuid", "ts").dropDuplicates(["session_key", "uuid"]), ["session_key", "uuid"], "left")
    n = n.withColumn("opens", F.coalesce("opens", F.lit(False)))
    by = Window.partitionBy("session_key").orderBy("main_pos")
    main = n.filter("is_main").withColumn("chunk", F.nullif(F.sum(F.col("opens").cast("int")).over(by), F.lit(0)) - 1)
    off = n.filter("not is_main")
    hung = main.select("session_key", F.col("uuid").alias("anchor"), F.col("chunk").alias("hung"))
    off = off.join(hung, ["session_key", "anchor"], "left")
    # the prompts and the nodes without an anchor in the order of time, prompts first where they are equal
    late = off.filter("anchor is null and ts is not null").select("session_key", "ts", F.lit(1).alias("side"), "uuid", F.lit(None).cast("long").alias("chunk"))
    line = main.filter("opens and ts is not null").select("session_key", "ts", F.lit(0).alias("side"), "uuid", F.col("chunk").cast("long").alias("chunk")).unionByName(late)
    found = line.withColumn("timed", F.max("chunk").over(Window.partitionBy("session_key").orderBy("ts", "side"))).filter("side = 1").select("session_key", "uuid", "timed")
    prompt = opens.select("session_key", F.col("uuid").alias("fork_root"), F.col("opens").alias("by_prompt"))
    off = off.join(found, ["session_key", "uuid"], "left").join(prompt, ["session_key", "fork_root"], "left").withColumn("chunk", F.when(F.col("anchor").isNotNull(), F.col("hung")).otherwise(F.col("timed")))
    place = F.when(F.col("chunk").isNull(), "preamble").when(F.col("is_main"), "main").when(F.col("by_prompt"), "branch").otherwise("attached")
    cols = ["session_key", "uuid", F.col("chunk").cast("long").alias("chunk"), place.alias("place"), "fork_root"]
    return main.withColumn("by_prompt", F.lit(None).cast("boolean")).select(*cols).unionByName(off.select(*cols))


def chunk_summary(members: DataFrame, said: DataFrame) -> DataFrame:
    """(session_key, chunk, start_ts, end_ts, tool_calls, errors, entries, branches): a row for each chunk, by its own and its attached nodes; said is prompts.texts()."""
    branches = members.filter("place = 'branch'").groupBy("session_key", "chunk").agg(F.count_distinct("fork_root").alias("branches"))
    own = members.filter("place in ('main', 'attached')").join(said.select("session_key", "uuid", "ts", "tools", "errors"), ["session_key", "uuid"], "left")
    s = own.groupBy("session_key", "chunk").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum(F.coalesce(F.size("tools"), F.lit(0))).alias("tool_calls"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.count("*").alias("entries"))
    return s.join(branches, ["session_key", "chunk"], "left").withColumn("branches", F.coalesce("branches", F.lit(0)))


def chunk_range(summary: DataFrame, spec: str) -> DataFrame:
    """The chunks of a selector, one number or an inclusive range, of sessions that have them all; a malformed or reversed one is an error."""
    first, _, last = spec.strip().partition("-")
    try:
        low, high = int(first), int(last) if last else int(first)
    except ValueError as e:
        raise ValueError(f"{spec}: expected a number like 4 or a range like 2-5") from e
    if low > high:
        raise ValueError(f"{spec}: the range is reversed")
    most = F.max("chunk").over(Window.partitionBy("session_key"))
    return summary.withColumn("most", most).filter((F.col("most") >= high) & F.col("chunk").between(low, high)).drop("most")

