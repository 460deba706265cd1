"""Queries over main threads, hierarchies and file histories, each beside DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, history, prompts, similarity, threads, trees
from ..sources.tables import kept, load
from .catalogue import register
from .logs import _canonical


@register(
    "X14_segments",
    """with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents),
    m as (select doc_id, i, case length(line) % 7 when 0 then '```' when 1 then concat('> ', line) else line end as line from l),
    f as (select *, coalesce(count_if(starts_with(ltrim(line), '```')) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as inside from m),
    k as (select *, case when inside or starts_with(ltrim(line), '```') or starts_with(ltrim(line), '>') then 'quoted' else 'primary' end as kind from f),
    g as (select *, case when kind is distinct from lag(kind) over (partition by doc_id order by i) then 1 else 0 end as starts from k),
    r as (select *, sum(starts) over (partition by doc_id order by i) as run from g),
    s as (select doc_id, run, any_value(kind) as kind, sum(length(line)) + count(*) - 1 as chars, bool_or(regexp_matches(line, '[^ \\t]')) as said from r group by doc_id, run)
    select doc_id, kind, count(*) as segments, cast(sum(chars) as bigint) as chars from s where said group by doc_id, kind""".replace("\\t", "\t"),
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are made fences or quotes by their lengths."""
    made = lambda x: F.when(F.length(x) % 7 == 0, F.lit("```")).when(F.length(x) % 7 == 1, F.concat(F.lit("> "), x)).otherwise(x)
    d = load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), made), "\n").alias("text"))
    s = d.select("doc_id", F.explode(prompts.segments(F.col("text"), F.lit(False))).alias("s"))
    return s.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("segments"), F.sum(F.length("s.text")).alias("chars"))


_TALK = "with t as (select *, conv_id || '-' || turn as id, len(regexp_extract_all(text, '(?i)e[nr]')) as n from conversations where role in ('user', 'assistant'))"


@register(
    "X13_topic",
    _TALK
    + """, p as (select *, case when role = 'user' then text else last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) end as asked,
      case when role = 'assistant' then text else first_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) end as answered from t)
    select cast(conv_id as varchar) as session_key, id as uuid, role as location, cast(n as int) as matches, left(trim(asked), 40) as asked, left(trim(answered), 40) as answered from p where n > 0 order by conv_id * 600 + turn * 60, session_key, uuid limit 200""",
)
def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 texts with a pair of letters, as the report of a topic cuts them."""
    e, b = _canonical(spark, sf_dir)
    t = threads.topic(threads.main_thread(trees.nodes(e, b), e, b), "(?i)e[nr]", limit=200)
    return t.select("session_key", "uuid", "location", F.col("matches").cast("int").alias("matches"), F.substring("asked", 1, 40).alias("asked"), F.substring("answered", 1, 40).alias("answered"))


@register(
    "G13_turns_of_logs",
    """with t as (select *, lag(role) over w as was, lag(turn) over w as was_turn from conversations window w as (partition by conv_id order by turn)),
    s as (select * from t where role = 'user' or role = 'assistant' and not coalesce(was = 'user' and was_turn = turn - 1, false)),
    n as (select s.conv_id, s.turn, s.role, c.role as next from s left join conversations c on c.conv_id = s.conv_id and c.turn = s.turn + 1),
    l as (select conv_id, max_by(role, turn) as last from conversations group by conv_id)
    select cast(n.conv_id as varchar) as session_key, count(*) + case when any_value(last) = 'assistant' then 1 else 0 end as turns, count(*) filter (where role = 'user') as prompts, count(*) filter (where role = 'assistant' or next = 'assistant') as answered
    from n join l on n.conv_id = l.conv_id group by n.conv_id""",
)
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the answers that follow them at once, and answers alone; where the last turn calls a tool, its result is one more."""
    e, b = _canonical(spark, sf_dir)
    t = threads.turns(threads.main_thread(trees.nodes(e, b), e, b))
    return t.groupBy("session_key").agg(F.count("*").alias("turns"), F.count("prompt").alias("prompts"), F.count("summary").alias("answered"))


@register(
    "W1_collapsed_timeline",
    """with e as (select user_id, event_id, event_type, json_extract_string(props, '$.k') as k, event_type in ('view', 'click') as quiet from events),
    r as (select *, sum(case when quiet and coalesce(was, false) then 0 else 1 end) over (partition by user_id order by event_id) as row from (select *, lag(quiet) over (partition by user_id order by event_id) as was from e) x),
    g as (select user_id, row, count(*) as n, min(event_id) as turn, any_value(event_type) as one, list(event_type order by event_id) as types, list(k order by event_id) as ks, any_value(quiet) as quiet from r group by user_id, row)
    select cast(user_id as varchar) as session_key, turn, n, case when n > 1 then concat('[', n, ' tool-only turns collapsed]') when not quiet then one end as summary,
      array_to_string(list_filter(types, lambda x, i: list_position(types, x) = i), ',') as tools, array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i), ',') as files from g""",
)
def collapsed_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as turns of which views and clicks only call tools."""
    quiet = F.col("event_type").isin("view", "click")
    t = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("turn"), "ts", F.lit(None).cast("string").alias("prompt"), F.array().cast("array<string>").alias("steering"), F.when(~quiet, F.col("event_type")).alias("summary"),
        F.array("event_type").alias("tools"), F.array(F.get_json_object("props", "$.k")).alias("files"), (F.col("event_type") == "error").alias("had_errors"),
    )
    return threads.timeline(t).select("session_key", "turn", "n", "summary", F.array_join("tools", ",").alias("tools"), F.array_join("files", ",").alias("files"))


@register(
    "G15_prompt_chunks",
    """with t as (select *, max(turn) over (partition by conv_id) as last from conversations),
    m as (select *, not (turn % 3 = 1 and turn < last) as main from t),
    c as (select *, sum(case when main and role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as k from m),
    p as (select *, nullif(k, 0) - 1 as chunk from c)
    select cast(conv_id as varchar) as session_key, conv_id || '/' || turn as uuid, cast(chunk as bigint) as chunk, case when chunk is null then 'preamble' when main then 'main' when role = 'user' then 'branch' else 'attached' end as place from p""",
)
def prompt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations where the second of each three turns is left for another answer to the first, and users' turns open chunks."""
    key = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    e = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_key"), (turn + 1).alias("line_no"), key(turn).alias("uuid"), F.when(turn > 0, key(F.when(turn % 3 == 2, turn - 2).otherwise(turn - 1))).alias("parent_uuid"), F.lit(None).cast("string").alias("logical_parent_uuid"),
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("entry_type"), "role", F.timestamp_seconds("turn").alias("ts"),
    )
    forest = kept(trees.nodes(e, e.select("session_key", "line_no", "entry_type", F.lit("text").alias("block_type"))), "forest")
    return threads.chunks(forest, e.filter("role = 'user'").select("session_key", "uuid"), e).select("session_key", "uuid", "chunk", "place")


_NEAR = """with m as (select cast(c_nationkey as varchar) as project, 'c' || c_custkey as k, cast(floor(c_acctbal * 100) as bigint) as s from customer),
    u as (select cast(s_nationkey as varchar) as project, 's' || s_suppkey as k, cast(floor(s_acctbal * 100) as bigint) as s, case when s_suppkey % 5 = 0 then 'c' || (s_suppkey * 3) end as folder from supplier),
    n as (select u.k, arg_min(m.k, (abs(u.s - m.s), m.k)) as near from u join m on u.project = m.project and abs(u.s - m.s) <= 3600 where folder is null group by u.k),
    a as (select u.project, u.k, case when folder is null then near when exists (select 1 from m where m.project = u.project and m.k = u.folder) then folder end as parent, case when folder is null then case when near is not null then 'time' end when exists (select 1 from m where m.project = u.project and m.k = u.folder) then 'folder' end as how
      from u left join n on u.k = n.k)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as main sessions and suppliers as subagents in their nations, at times by their balances; each fifth supplier names a customer."""
    at = lambda c: F.timestamp_seconds(F.floor(F.col(c) * 100))
    main = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("project"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session_key"), F.lit(False).alias("is_subagent"), F.lit(None).cast("string").alias("dir_parent"), at("c_acctbal").alias("modified"))
    folder = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("c"), (F.col("s_suppkey") * 3).cast("string")))
    sub = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("project"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("session_key"), F.lit(True).alias("is_subagent"), folder.alias("dir_parent"), at("s_acctbal").alias("modified"))
    return main.unionByName(sub)


@register("G19_nearest_parents", _NEAR + " select k as session_key, parent as parent_key, how from a")
def nearest_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.assigned(_sessions(spark, sf_dir)).filter("is_subagent").select("session_key", "parent_key", "how")


@register(
    "A40_hierarchy_totals",
    _NEAR
    + """, every as (select k as root, false as sub, s from m union all select coalesce(a.parent, a.k), true, u.s from a join u on a.k = u.k)
    select root as root_key, count(*) as sessions, count_if(not sub) as main_sessions, count_if(sub) as subagent_sessions, cast(sum(s) as bigint) as total from every group by root""",
)
def hierarchy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    return hierarchy.totals(hierarchy.assigned(s), s.select("session_key", F.unix_seconds("modified").alias("total")))


@register(
    "K11_similarity",
    """with s as (select c_custkey as k, concat('/', c_nationkey, '/', c_mktsegment) as project, max(o_orderdate) as at, list_distinct(list(o_orderpriority)) as tools, list_distinct(list(case when o_orderkey % 7 = 0 then o_orderstatus end)) as tags, count(*) as tokens
      from customer join orders on c_custkey = o_custkey group by c_custkey, c_nationkey, c_mktsegment),
    g as (select * from s where k = (select min(k) from s)),
    p as (select s.k, case when len(s.tools) = 0 and len(g.tools) = 0 then 100 when len(s.tools) = 0 or len(g.tools) = 0 then 0 else 100.0::double * len(list_intersect(s.tools, g.tools)) / len(list_distinct(list_concat(s.tools, g.tools))) end as tools,
      case when s.project = g.project then 100 else 100.0::double * (1 + case when string_split(s.project, '/')[2] = string_split(g.project, '/')[2] then 1 else 0 end) / 3 end as project,
      100 * exp(-abs(epoch(s.at) - epoch(g.at)) / (7 * 86400.0)) as time,
      case when len(s.tags) = 0 and len(g.tags) = 0 then 50 when len(s.tags) = 0 or len(g.tags) = 0 then 0 else 100.0::double * len(list_intersect(s.tags, g.tags)) / len(list_distinct(list_concat(s.tags, g.tags))) end as tags,
      100.0::double * (1 - abs(s.tokens - g.tokens)::double / greatest(s.tokens, g.tokens)) as tokens from s, g where s.k <> g.k)
    select cast(k as varchar) as session_key, round((tools * 30 + project * 25 + time * 15 + tags * 20 + tokens * 10) / 100, 4) as total from p""",
)
def similar_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their orders against the first that has one."""
    j = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    s = j.groupBy("c_custkey", "c_nationkey", "c_mktsegment").agg(F.max("o_orderdate").alias("modified"), F.collect_set("o_orderpriority").alias("tools"), F.collect_set(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus"))).alias("tags"), F.count("*").alias("tokens"))
    s = s.select(F.col("c_custkey").cast("string").alias("session_key"), F.concat(F.lit("/"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment").alias("project"), "modified", "tools", "tags", "tokens")
    first = load(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    return similarity.similar(s, str(first)).select("session_key", F.round("total", 4).alias("total"))


@register(
    "A45_file_history",
    """with s as (select user_id, event_id, ts, cast(json_extract_string(props, '$.k') as int) as k from events where event_type <> 'click'),
    f as (select user_id, event_id, ts, '/src/f' || k % 10 as path, event_id % 4 as version from s union all select user_id, event_id, ts, '/doc/g' || k % 3, k % 5 from s)
    select cast(user_id as varchar) as session_key, path, cast(version as int) as version, min(event_id) as line_no from f group by user_id, path, version""",
)
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of which all but clicks are snapshots of two files."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    file = lambda version: F.struct(F.lit("b").alias("backupFileName"), version.alias("version"), at.alias("backupTime"))
    listed = F.create_map(F.concat(F.lit("/src/f"), (F.col("k") % 10).cast("string")), file((F.col("event_id") % 4).cast("int")), F.concat(F.lit("/doc/g"), (F.col("k") % 3).cast("string")), file(F.col("k") % 5))
    snapshot = F.to_json(F.struct(F.lit("file-history-snapshot").alias("type"), F.col("event_id").cast("string").alias("messageId"), F.struct(listed.alias("trackedFileBackups")).alias("snapshot")))
    other = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("no file-history-snapshot "), "event_type").alias("content")))
    raw = e.select(F.concat(F.lit("/logs/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.col("event_id").alias("line_no"), F.explode(F.array(F.when(F.col("event_type") == "click", other).otherwise(snapshot))).alias("line"))  # made once, not again in each filter
    return history.file_history(history.snapshots(raw)).select("session_key", "path", "version", "line_no")


@register(
    "W9_file_evolution",
    """with t as (select *, lag(text) over w as before, lag(role) over w as before_role, lead(text) over w as after, lead(role) over w as after_role from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn))
    select cast(conv_id as varchar) as session_key, turn, case when before_role = 'user' then left(trim(before), 30) when role = 'user' then left(trim(text), 30) when after_role = 'user' then left(trim(after), 30) end as prompt,
      case when before_role = 'assistant' then left(trim(before), 30) when role = 'assistant' then left(trim(text), 30) when after_role = 'assistant' then left(trim(after), 30) end as response from t where conv_id % 2 = 0""",
)
def file_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of every second conversation as a change of a file, with the texts beside it."""
    c = load(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    key = [F.col("conv_id").cast("string").alias("session_key"), F.col("turn").alias("line_no")]
    user = F.col("role") == "user"
    none = F.lit(None).cast("string")
    said = c.select(*key, F.col("role").alias("entry_type"), "text", none.alias("thinking"), F.array().cast("array<string>").alias("tools"), F.lit(0).cast("long").alias("errors"), user.alias("human"), none.alias("turn_id"))
    changes = c.filter("conv_id % 2 = 0").select(*key, F.lit("/f").alias("path"), F.col("turn").cast("int").alias("version"), F.lit(None).cast("timestamp").alias("at"))
    cut = lambda x: F.substring(x, 1, 30).alias(x)
    return history.evolution(changes, said).select("session_key", F.col("line_no").alias("turn"), cut("prompt"), cut("response"))
