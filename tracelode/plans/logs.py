"""Queries that start from log lines: the driver's conversations written as JSON Lines of both dialects and read again.

Their SQL works on the conversations and the rules below, and knows nothing of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import index, lessons, replay, usage, validation
from ..sources import envelope, jsonl
from ..sources.tables import kept, kept_path, load
from .catalogue import register

#: What calls give, in turn: tool, command, result, native flag.
RESULTS = (
    ("Bash", "make", "Segmentation fault", None), ("Bash", "git log", "fix stack overflow", None), ("Read", "f", "  12→panic", True), ("Read", "f", "gone", True), ("Grep", "p", "21:panic", True), ("Grep", "p", "a1-b", True),
    ("mcp__a__b", "q", '{"ok":1}', True), ("Odd", "q", '{"error":"x"}', False), ("Odd", "q", '{"error":false}', None), ("Bash", "make", "Exit code 2", None), ("Bash", "cat f", "cannot find it", False), ("Bash", "ls", "fine", None),
)
_SQL_RESULTS = "[" + ", ".join("{{'tool': '{}', 'command': '{}', 'content': '{}', 'flag': {}}}".format(t, c, r, "null::boolean" if f is None else str(f).lower()) for t, c, r, f in RESULTS) + "]"
#: The turns in the order of their rows, with what their calls give; torn ones are those whose line is broken.
_TURNS = f"""turns as (select *, conv_id || '-' || turn as id, {_SQL_RESULTS}[(conv_id * 5 + turn) % {len(RESULTS)} + 1] as call, conv_id % 9 = 4 and turn = 1 as torn from conversations)"""


def _line(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def first_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line_no, line): conversations as a log, written and read back.

    Turns follow each other. An assistant's turn thinks, speaks and calls a tool; it is streamed in two lines, and its
    result has a third. In each ninth conversation the second turn's first line is torn and goes on behind the tear;
    each fifth has a blank line.
    """
    call = F.element_at(F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(c).alias("command"), F.lit(r).alias("content"), F.lit(f).cast("boolean").alias("flag")) for t, c, r, f in RESULTS]), ((F.col("conv_id") * 5 + F.col("turn")) % len(RESULTS) + 1).cast("int"))
    rows = load(spark, sf_dir, "conversations").withColumn("id", F.concat("conv_id", F.lit("-"), "turn")).withColumn("call", call)
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    session = F.col("conv_id").cast("string").alias("sessionId")
    base = [F.when(F.col("turn") > 0, F.concat("conv_id", F.lit("-"), F.col("turn") - 1)).alias("parentUuid"), F.col("id").alias("uuid"), session, time.alias("timestamp")]
    user = _line(*base, F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message"))
    system = _line(*base, F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), F.col("text").alias("content"))
    block = lambda kind, **f: _line(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()])
    blocks = F.concat_ws(",", block("thinking", thinking=F.lit("hm")), block("text", text=F.col("text")), block("tool_use", id=F.col("id"), name=F.col("call.tool"), input=F.struct(F.col("call.command").alias("command"))))
    head = F.regexp_replace(_line(*base, F.lit("assistant").alias("type")), r"\}$", "")

    def said(output: Column) -> Column:
        used = _line(F.length("text").alias("input_tokens"), output.alias("output_tokens"))
        return F.concat(head, F.lit(',"message":{"role":"assistant","model":"m-1","id":"m'), F.col("id"), F.lit('","usage":'), used, F.lit(',"content":['), blocks, F.lit("]}}"))

    given = F.array(F.struct(F.lit("tool_result").alias("type"), F.col("id").alias("tool_use_id"), F.col("call.content").alias("content"), F.col("call.flag").alias("is_error")))
    result = _line(F.col("id").alias("parentUuid"), F.concat("id", F.lit("r")).alias("uuid"), session, time.alias("timestamp"), F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), given.alias("content")).alias("message"))
    lines = F.when(F.col("role") == "system", F.array(system)).when(F.col("role") == "assistant", F.array(said(F.lit(1)), said(F.col("turn") * 10 + 5), result)).otherwise(F.array(user))
    torn = (F.col("conv_id") % 9 == 4) & (F.col("turn") == 1)
    lines = F.transform(lines, lambda x, i: F.when(torn & (i == 0), F.concat(F.lit('{"parentUuid":"x","type":"us'), x)).otherwise(x))
    lines = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), F.concat(lines, F.array(F.lit("")))).otherwise(lines)
    path = kept_path(spark, "first-dialect")
    rows.select("conv_id", "turn", F.posexplode(lines).alias("nr", "value")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nr").select("value").write.text(path)
    return jsonl.lines(spark, path)


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries, those salvaged included, and blocks of the first dialect; a session is a conversation."""
    p = jsonl.parsed(first_dialect(spark, sf_dir))
    e = jsonl.entries(p).unionByName(jsonl.entries(jsonl.salvaged(p))).withColumn("session_key", F.col("session_id"))
    return e, jsonl.blocks(e)


@register(
    "S4_parse_report",
    """select cast(sum(case role when 'assistant' then 3 else 1 end) - count_if(conv_id % 9 = 4 and turn = 1) as bigint) as parsed, count_if(conv_id % 9 = 4 and turn = 1) as skipped, count_if(conv_id % 5 = 0 and turn = 0) as empty,
      count_if(conv_id % 9 = 4 and turn = 1) as salvaged from conversations""",
)
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = jsonl.parse_report(jsonl.parsed(first_dialect(spark, sf_dir)))
    return r.agg(*[F.sum(c).cast("long").alias(c) for c in ("parsed", "skipped", "empty", "salvaged")])


@register(
    "S35_canonical_entries",
    """select cast(conv_id as varchar) as session_key, count_if(role = 'system') as systems, count_if(role <> 'system') as turns,
      count_if(role = 'assistant') as thoughts, count_if(role = 'assistant') as calls, count_if(role = 'assistant') as results, cast(sum(case when role <> 'system' then length(text) else 0 end) as bigint) as said from conversations group by conv_id""",
)
def canonical_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's lines hold, streamed ones counted once."""
    e, b = _canonical(spark, sf_dir)
    n = lambda c: F.count_distinct(F.when(c, F.col("uuid")))
    of = b.groupBy("session_key").agg(
        n(F.col("block_type") == "text").alias("turns"), n(F.col("block_type") == "thinking").alias("thoughts"), F.count_distinct(F.when(F.col("block_type") == "tool_use", F.col("call_id"))).alias("calls"), F.count_if(F.col("block_type") == "tool_result").alias("results"),
    )
    said = b.filter("block_type = 'text'").select("session_key", "uuid", F.length("text").alias("n")).distinct().groupBy("session_key").agg(F.sum("n").alias("said"))
    systems = e.groupBy("session_key").agg(F.count_if(F.col("entry_type") == "system").alias("systems"))
    return systems.join(of, "session_key", "left").join(said, "session_key", "left").na.fill(0).select("session_key", "systems", "turns", "thoughts", "calls", "results", "said")


@register("A3_tokens_of_logs", "select cast(conv_id as varchar) as session_key, count(*) as turns, cast(sum(length(text)) as bigint) as input_tokens, cast(sum(turn * 10 + 5) as bigint) as output_tokens from conversations where role = 'assistant' group by conv_id")
def tokens_of_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest count of each streamed message, summed."""
    e, _ = _canonical(spark, sf_dir)
    return usage.token_totals(usage.turns(e), "session_key").select("session_key", "turns", "input_tokens", "output_tokens")


#: The first dialect's rules of failures, for DuckDB.
_FAILED = (
    "with "
    + _TURNS
    + r""", c as (select *, call.tool as tool, call.command as command, call.content as content, coalesce(call.flag, false) as flag, case when json_valid(call.content) then json_type(call.content, '$.error') end as err from turns where role = 'assistant'),
    failed as (select *, case
      when flag then case when tool = 'Read' and regexp_matches(content, '^\s*[0-9]+[→\t]') or tool = 'Grep' and regexp_matches(content, '^\s*[0-9]+[:-]') or tool like 'mcp!_!_%' escape '!' and regexp_matches(content, '^\s*[{\[]') then null else 'native_error_flag' end
      when tool = 'Bash' and regexp_matches(command, '^\s*git (log|show|diff|blame|status)') then null
      when err is not null and err <> 'NULL' and not (err = 'BOOLEAN' and json_extract_string(content, '$.error') = 'false') then 'structured_error'
      when regexp_matches(content, '(?i)(segmentation fault|sigsegv|sigabrt|panic|stack overflow|assertion failed|fatal error|exit code [1-9][0-9]*|error\[E[0-9]+\]|cannot find|unresolved|undefined reference)') then 'text_signature' end as basis from c)"""
)


@register("C15_failures", _FAILED + " select cast(conv_id as varchar) as session_key, id, tool as tool_name, case basis when 'text_signature' then 'inferred' else 'confirmed' end as kind, basis from failed where basis is not null")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, b = _canonical(spark, sf_dir)
    return lessons.failures(b).select("session_key", "id", "tool_name", "kind", "basis")


@register(
    "P5_error_fixes",
    _FAILED
    + """, said as (select conv_id, turn, text, lead(text) over w as then_text, lead(call.tool) over w as then_tool from turns where role = 'assistant' window w as (partition by conv_id order by turn))
    select cast(f.conv_id as varchar) as session_key, id, basis, content as preview, then_tool as next_tool, length(trim(then_text)) > 200 as cut, left(trim(then_text), 20) as resolution
    from failed f join said s on s.conv_id = f.conv_id and s.turn = f.turn where basis is not null""",
)
def error_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls with the beginning of what the assistant says next."""
    f = lessons.error_fixes(*_canonical(spark, sf_dir))
    return f.select("session_key", "id", "basis", F.trim("preview").alias("preview"), F.get("resolution_tools", F.lit(0)).alias("next_tool"), F.col("resolution").endswith("...").alias("cut"), F.substring("resolution", 1, 20).alias("resolution"))


@register(
    "O14_validation",
    """with a as (select cast(conv_id as varchar) as session_key, count(*) as n from conversations where role = 'assistant' group by conv_id)
    select session_key, 'warning' as level, 'calls and results out of balance' as finding, n from a union all select session_key, 'warning', 'id used again with other content', n from a""",
)
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a validation says of the log: messages streamed twice use their ids and calls again. Torn lines have no session of their own here."""
    p = jsonl.parsed(first_dialect(spark, sf_dir))
    e = jsonl.entries(p).unionByName(jsonl.entries(jsonl.salvaged(p))).withColumn("session_key", F.col("session_id"))
    return validation.findings(p.filter("status = 'parsed'"), e, jsonl.blocks(e)).select("session_key", "level", "finding", "n")


@register(
    "J7_commit_files",
    """with t as (select distinct o_custkey, l_suppkey % 30 as name from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 4 = 0),
    c as (select distinct o_custkey, o_orderkey, l_partkey % 40 as part from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 4 <> 0)
    select distinct cast(t.o_custkey as varchar) as session_key, cast(o_orderkey as varchar) as sha, '/w/' || name || '.rs' as path from t join c on t.o_custkey = c.o_custkey where ends_with('src/p' || part || '.rs', name || '.rs')""",
)
def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions: three of four orders are their commits of parts, and the suppliers of the others the files that they touched."""
    j = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    text = lambda c: F.col(c).cast("string")
    commits = load(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select(text("o_custkey").alias("session_key"), text("o_orderkey").alias("sha"))
    committed = j.select(text("o_orderkey").alias("sha"), F.concat(F.lit("src/p"), (F.col("l_partkey") % 40).cast("string"), F.lit(".rs")).alias("path")).distinct()
    touched = j.filter("o_orderkey % 4 = 0").select(text("o_custkey").alias("session_key"), F.concat(F.lit("/w/"), (F.col("l_suppkey") % 30).cast("string"), F.lit(".rs")).alias("path"))
    return usage.correlated_files(commits, committed, touched)


def second_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line_no, line): each conversation as a file of the second dialect.

    A user's turn opens a context; its item is said again by an event, in every third conversation in other words, and
    in every fifth twice. An assistant's turn thinks (said again by an event), calls a command whose end was seen,
    speaks (said again), and a counter follows. A system's turn compacts.
    """
    record = lambda type_, payload: _line(F.lit("2025-01-01T00:00:00.000Z").alias("timestamp"), F.lit(type_).alias("type"), payload.alias("payload"))
    of = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    say = lambda who, kind: record("response_item", of(type=F.lit("message"), role=F.lit(who), content=F.array(of(type=F.lit(kind), text=F.col("text")))))
    heard = lambda kind: record("event_msg", of(type=F.lit(kind), message=F.when((F.lit(kind) == "user_message") & (F.col("conv_id") % 3 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    id_ = F.concat("conv_id", F.lit("-"), "turn")
    user = F.array(record("turn_context", of(model=F.lit("m"))), say("user", "input_text"), heard("user_message"))
    user = F.when(F.col("conv_id") % 5 == 0, F.concat(user, F.array(heard("user_message")))).otherwise(user)
    counted = of(total_token_usage=of(input_tokens=(F.col("turn") + 1) * 100, output_tokens=(F.col("turn") + 1) * 7, cached_input_tokens=F.col("turn") * 10))
    assistant = F.array(
        record("response_item", of(type=F.lit("reasoning"), summary=F.array(of(text=F.lit("first")), of(text=F.lit("second"))))), record("event_msg", of(type=F.lit("agent_reasoning"), text=F.lit("second"))),
        record("response_item", of(type=F.lit("function_call"), name=F.lit("exec_command"), call_id=id_, arguments=F.lit('{"cmd":"ls"}'))), record("event_msg", of(type=F.lit("exec_command_end"), call_id=id_, exit_code=F.col("turn") % 2)),
        say("assistant", "output_text"), heard("agent_message"), record("event_msg", of(type=F.lit("token_count"), info=counted)),
    )
    lines = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(F.array(record("compacted", of(message=F.col("text")))))
    meta = record("session_meta", of(id=F.col("conv_id").cast("string"), cli_version=F.lit("1")))
    first = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf_dir, "conversations").withColumn("opens", F.row_number().over(first) == 1)
    rows = c.select("conv_id", "turn", F.posexplode(F.when(F.col("opens"), F.concat(F.array(meta), lines)).otherwise(lines)).alias("nr", "line"))
    return rows.select(F.concat(F.lit("/logs/"), "conv_id", F.lit(".jsonl")).alias("file_path"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "nr")).cast("long").alias("line_no"), "line")


#: The lines by conversation, turn and part, numbered, with what becomes of them.
_RECORDS = """opened as (select *, row_number() over (partition by conv_id order by turn) = 1 as opens from conversations),
    parts as (
      select conv_id, turn, 0 as nr, 'meta' as part from opened where opens
      union all select conv_id, turn, unnest([1, 2, 3]), unnest(['context', 'asked', 'asked again']) from opened where role = 'user' union all select conv_id, turn, 4, 'asked twice' from opened where role = 'user' and conv_id % 5 = 0
      union all select conv_id, turn, unnest(range(1, 8)), unnest(['thought', 'thought again', 'call', 'end', 'said', 'said again', 'counter']) from opened where role = 'assistant'
      union all select conv_id, turn, 1, 'compacted' from opened where role not in ('user', 'assistant')),
    records as (select *, row_number() over (partition by conv_id order by turn, nr) as record from parts),
    ends as (select *, case when part in ('meta', 'context') then 'unknown' when part in ('thought again', 'said again', 'asked twice') or part = 'asked again' and conv_id % 3 <> 0 then 'suppressed' else 'mapped' end as outcome,
      case part when 'thought again' then record - 1 when 'said again' then record - 1 when 'asked again' then case when conv_id % 3 <> 0 then record - 1 end when 'asked twice' then case when conv_id % 3 <> 0 then record - 2 else record - 1 end end as twin from records)"""


@register("P3_dispositions", "with " + _RECORDS + " select cast(conv_id as varchar) as session_key, record, outcome, twin from ends")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.normalized(second_dialect(spark, sf_dir)).dispositions.select("session_key", "record", "outcome", "twin")


@register(
    "S36_second_dialect",
    """with t as (select *, lag(turn) over (partition by conv_id order by turn) as was from conversations where role = 'assistant'),
    a as (select conv_id, sum((turn + 1) * 100 - turn * 10 - case when was is null then 0 else (was + 1) * 100 - was * 10 end) as input_tokens, sum((turn + 1) * 7 - coalesce((was + 1) * 7, 0)) as output_tokens, sum(turn * 10 - coalesce(was * 10, 0)) as cache_read_tokens, count(*) as calls, count_if(turn % 2 = 1) as failed from t group by conv_id),
    s as (select conv_id, count_if(role = 'user') + case when conv_id % 3 = 0 then count_if(role = 'user') else 0 end as asked, count_if(role = 'assistant') as answered from conversations group by conv_id)
    select cast(s.conv_id as varchar) as session_key, asked, answered, coalesce(calls, 0) as calls, coalesce(failed, 0) as failed, cast(coalesce(input_tokens, 0) as bigint) as input_tokens, cast(coalesce(output_tokens, 0) as bigint) as output_tokens,
      cast(coalesce(cache_read_tokens, 0) as bigint) as cache_read_tokens from s left join a on a.conv_id = s.conv_id""",
)
def second_dialect_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, calls, failures and tokens of each session, through the operators of the first dialect."""
    n = envelope.normalized(second_dialect(spark, sf_dir))
    texts = n.blocks.groupBy("session_key").agg(*[F.count_if((F.col("block_type") == "text") & (F.col("entry_type") == who)).alias(name) for who, name in (("user", "asked"), ("assistant", "answered"))], F.count_if(F.col("block_type") == "tool_use").alias("calls"))
    # a failure needs a result of the call: the ends alone tell it here
    failed = n.observed.filter("exit_code <> 0").groupBy("session_key").agg(F.count("*").alias("failed"))
    tokens = usage.token_totals(usage.turns(n.entries), "session_key").select("session_key", "input_tokens", "output_tokens", "cache_read_tokens")
    every = n.entries.select("session_key").distinct()
    return every.join(texts, "session_key", "left").join(failed, "session_key", "left").join(tokens, "session_key", "left").na.fill(0)


@register(
    "P4_violations",
    "with "
    + _RECORDS
    + """, planted as (
      select conv_id, record, 'record without a disposition' as violation from ends where record % 13 = 5
      union all select conv_id, record, 'record with several dispositions' from ends where record % 13 = 6
      union all select conv_id, record, 'entry named twice by one record' from ends where record % 13 = 6 and outcome <> 'suppressed'
      union all select conv_id, record, 'entry that its record doesn''t name' from ends where record % 13 = 5 and outcome <> 'suppressed'
      union all select a.conv_id, a.record, 'twin that isn''t mapped' from ends a join ends b on a.conv_id = b.conv_id and a.twin = b.record where a.outcome = 'suppressed' and a.record % 13 not in (5, 6) and b.record % 13 = 5
      union all select a.conv_id, a.record, 'twin that isn''t mapped' from ends a join ends b on a.conv_id = b.conv_id and a.twin = b.record cross join range(2) where a.outcome = 'suppressed' and a.record % 13 = 6 and b.record % 13 = 5)
    select concat('/logs/', conv_id, '.jsonl') as file_path, record, violation from planted""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the account of the second dialect lacks once some dispositions are taken away and others given twice."""
    raw = kept(second_dialect(spark, sf_dir), "lines")
    n = envelope.normalized(raw)
    d = n.dispositions.filter("record % 13 <> 5")
    return envelope.violations(raw, n.entries, d.union(d.filter("record % 13 = 6"))).select("file_path", "record", "violation")


def _document_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """Documents as the texts of a session for each source."""
    d = load(spark, sf_dir, "documents").filter("source is not null")
    b = d.select(F.col("source").alias("session_key"), F.col("doc_id").alias("line_no"), F.lit(0).alias("block_no"), F.lit(None).cast("timestamp").alias("ts"), F.lit("user").alias("entry_type"), F.lit("text").alias("block_type"), "text", *[F.lit(None).cast("string").alias(c) for c in ("thinking", "result_text")], F.lit(None).cast("variant").alias("tool_input"))
    ix = index.Index(spark, kept_path(spark, "index"))
    ix.update(b.withColumn("raw", F.col("text")), b)
    return ix


@register("X12_literal_hits", "select source as session_key, doc_id as line_no from documents where source is not null and regexp_matches(text, '(?i)licen')")
def literal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the literal, found through the postings."""
    return _document_index(spark, sf_dir).search("licen", ignore_case=True).select("session_key", "line_no")


@register(
    "X11_narrowed",
    r"""with t as (select doc_id, list_distinct(regexp_extract_all(text, '[\p{L}\p{Nl}\p{N}]+')) as tokens, text from documents where source is not null and text <> ''),
    m as (select *, len(list_filter(tokens, lambda t: strlen(t) < 40 and strlen(t) = length(t) and contains(lower(t), 'licen'))) > 0 as sure, len(list_filter(tokens, lambda t: strlen(t) >= 40 or strlen(t) > length(t))) > 0 as odd from t)
    select count(*) as segments, count_if(sure or odd) as candidates, count_if(odd and not sure) as fallback from m""",
)
def narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all segments the postings leave to look at."""
    return _document_index(spark, sf_dir).narrowed("licen")


@register(
    "S22_version_diffs",
    """with l as (select distinct n_nationkey, p_size, p_partkey % 97 as line from part join nation on p_partkey % 25 = n_nationkey),
    v as (select n_nationkey, p_size, list_sort(list(line)) as lines, row_number() over (partition by n_nationkey order by p_size) as version from l group by n_nationkey, p_size),
    p as (select *, lag(lines) over (partition by n_nationkey order by version) as was from v)
    select cast(n_nationkey as varchar) as path, version, cast(len(lines) - len(list_intersect(lines, was)) as int) as added, cast(len(was) - len(list_intersect(lines, was)) as int) as removed, cast(len(list_intersect(lines, was)) as int) as unchanged from p where was is not null""",
)
def version_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' numbers as the lines of files, a version for each size."""
    x = load(spark, sf_dir, "part").select((F.col("p_partkey") % 25).cast("string").alias("path"), "p_size", (F.col("p_partkey") % 97).alias("line")).distinct()
    v = x.groupBy("path", "p_size").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda n: n.cast("string")), "\n").alias("content"))
    v = v.withColumn("version", F.row_number().over(Window.partitionBy("path").orderBy("p_size")))
    return replay.version_diffs(v).select("path", F.col("version").cast("long").alias("version"), "added", "removed", "unchanged")


@register(
    "K9_common_turns",
    """with a as (select distinct conv_id, length(text) as n from conversations), b as (select distinct conv_id + 1 as conv_id, length(text) as n from conversations)
    select coalesce(a.conv_id, b.conv_id) as conv_id, count(*) filter (where a.n = b.n) as common, count(*) filter (where b.n is null) as removed, count(*) filter (where a.n is null) as added from a full join b on a.conv_id = b.conv_id and a.n = b.n group by 1""",
)
def common_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's lengths of texts, in order, against those of the one before."""
    c = load(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("n")).distinct()
    d = replay.sequence_diff(c, c.withColumn("conv_id", F.col("conv_id") + 1), "conv_id", "n", "n")
    return d.groupBy("conv_id").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("common", "removed", "added")])
