"""The second dialect's records as canonical entries and blocks, with an account of every record.

A file is walked in windows: a session's or turn's context, a compaction and a task's start begin a new one. What a
message or a thought says comes twice, as an item and as an event. Within a window, equal events are one; each then
claims the first item not claimed yet that says the same, and what claims none is content of its own. The ends of
commands, patches and searches go to the one call of their id, and are calls of their own where there is none.
Cumulative counters add to the assistant's entry before them, or else to the next one, of their window.

Every record ends in one of: mapped (to entries of its own or another's), suppressed (said twice, or a counter without
numbers), unknown (kept as it is, without meaning), unparseable, or refused (a file of another shape).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rollouts
from .jsonl import FIELDS, parsed
from .tables import kept

#: Events that repeat what items say, and the pool of items in which each looks for its twin.
SAID = {"user_message": "user", "agent_message": "assistant", "agent_reasoning": "thought", "agent_reasoning_raw_content": "thought"}
#: Ends of operations: the name of the tool whose call they belong to.
ENDS = {"exec_command_end": "exec_command", "patch_apply_end": "apply_patch", "web_search_end": "web_search"}
CALLS, RESULTS = ("function_call", "custom_tool_call"), ("function_call_output", "custom_tool_call_output")
BLOCKS = (
    "session_key string, line_no long, uuid string, ts timestamp, entry_type string, message_id string, block_no int, block_type string, text string, thinking string, "
    "tool_use_id string, call_id string, tool_name string, tool_input variant, result_text string, is_error boolean"
)
DISPOSITIONS = "session_key string, file_path string, record long, outcome string, reason string, twin long, entries array<string>"


class Normalized(NamedTuple):
    entries: DataFrame
    blocks: DataFrame
    dispositions: DataFrame
    observed: DataFrame


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def _is(type_: str, *kinds: str) -> Column:
    c = F.col("type") == type_
    return F.coalesce(c & F.col("kind").isin(*kinds) if kinds else c, F.lit(False))


def _texts(path: str) -> Column:
    """The text of each element of a list that has one."""
    return F.filter(F.transform(_get(path, "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull())


def _filled(c: Column) -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy("file_path").orderBy("line_no"))


def preferred(r: DataFrame) -> DataFrame:
    """The records of one file a session: rather one that isn't archived, then one that isn't compressed, then the first by path."""
    rank = F.struct(F.col("file_path").contains("/archived_sessions/"), F.col("file_path").endswith(".zst"), "file_path")
    best = r.groupBy("session_key").agg(F.min(rank)["file_path"].alias("file_path"))
    return r.join(best, ["session_key", "file_path"])


def walked(r: DataFrame, first_new: DataFrame | None = None) -> DataFrame:
    """Envelope records with their window and the version, folder, model and turn that hold at each.

    first_new(session_key, first_new) names the first line of forks that wasn't copied: it begins a window too.
    """
    e = r.filter("dialect = 'envelope'")
    begins = _is("session_meta") | _is("turn_context") | _is("compacted") | _is("event_msg", "task_started")
    if first_new is not None:
        e = e.join(first_new, "session_key", "left")
        begins = begins | F.coalesce(F.col("line_no") == F.col("first_new"), F.lit(False))
    turn = F.when(_is("turn_context") | _is("event_msg", "task_started"), _get("$.payload.turn_id")).when(_is("event_msg", *ENDS), F.nullif(_get("$.payload.turn_id"), F.lit("")))
    turn = turn.when(_is("response_item"), F.coalesce(_get("$.payload.internal_chat_message_metadata_passthrough.turn_id"), _get("$.payload.metadata.turn_id")))
    return e.select(
        "session_key", "file_path", "line_no", "type", "kind", "ts", "line", "v",
        F.sum(begins.cast("int")).over(Window.partitionBy("file_path").orderBy("line_no")).alias("window"),
        F.coalesce(_filled(F.when(_is("session_meta"), _get("$.payload.cli_version"))), F.lit("unknown")).alias("version"),
        _filled(F.when(_is("session_meta") | _is("turn_context"), _get("$.payload.cwd"))).alias("cwd"),
        F.coalesce(_filled(F.when(_is("turn_context"), _get("$.payload.model"))), F.lit("unknown")).alias("model"), _filled(turn).alias("turn_id"),
    )


def twins(w: DataFrame) -> DataFrame:
    """(file_path, line_no, twin, human) of events that say again what the item or event of line twin says; human if that item is a user's.

    Claims go in order and only to equal texts of one pool and window, so the n-th event that says a thing has the n-th
    item that does.
    """
    key = ("file_path", "window")
    pool = F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv])[F.col("kind")]
    event = w.filter(_is("event_msg", *SAID)).select(*key, "line_no", "kind", pool.alias("pool"), F.coalesce(F.when(pool == "thought", _get("$.payload.text")).otherwise(_get("$.payload.message")), F.lit("")).alias("said"), F.md5(F.to_json(_get("$.payload", "variant"))).alias("print"), F.coalesce(_get("$.timestamp"), F.lit("")).alias("at"))
    event = event.withColumn("first", F.min("line_no").over(Window.partitionBy(*key, "kind", "print", "at")))
    role = _get("$.payload.role")
    message = w.filter(_is("response_item", "message") & role.isin("user", "assistant")).select(*key, "line_no", role.alias("pool"), F.coalesce(F.array_join(_texts("$.payload.content"), ""), F.lit("")).alias("said"), F.lit(0).alias("part"))
    lists = [F.coalesce(_texts(f"$.payload.{x}"), F.array().cast("array<string>")) for x in ("summary", "content")]
    thought = w.filter(_is("response_item", "reasoning")).select(*key, "line_no", F.lit("thought").alias("pool"), F.posexplode(F.concat(*lists)).alias("part", "said")).select(*message.columns)
    sides = event.filter("first = line_no").select(*key, "line_no", "pool", "said", F.lit(0).alias("part"), F.lit(True).alias("is_event"))
    sides = sides.unionByName(message.unionByName(thought).withColumn("is_event", F.lit(False)))
    same = (*key, "pool", "said")
    sides = sides.withColumn("nr", F.row_number().over(Window.partitionBy(*same, "is_event").orderBy("line_no", "part")))
    pairs = sides.groupBy(*same, "nr").agg(F.max(F.when(F.col("is_event"), F.col("line_no"))).alias("first"), F.max(F.when(~F.col("is_event"), F.col("line_no"))).alias("item"))
    pairs = pairs.filter("first is not null and item is not null").select("file_path", "first", "item")
    found = event.select("file_path", "line_no", "first", "pool").join(pairs, ["file_path", "first"], "left")
    twin = F.coalesce("item", F.when(F.col("first") < F.col("line_no"), F.col("first")))
    return found.select("file_path", "line_no", twin.alias("twin"), ((F.col("pool") == "user") & F.col("item").isNotNull()).alias("human")).filter("twin is not null")


def ends(w: DataFrame) -> DataFrame:
    """(file_path, line_no, fate, target) of the ends of operations: paired with the call of line target, alone, or ambiguous."""
    tool = F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv])[F.col("kind")]
    name = _get("$.payload.name")
    call = F.when(_is("response_item", "function_call") & (name == "exec_command"), F.struct(name.alias("tool"), _get("$.payload.call_id").alias("id"))).when(
        _is("response_item", "custom_tool_call") & (name == "apply_patch"), F.struct(name.alias("tool"), _get("$.payload.call_id").alias("id"))
    ).when(_is("response_item", "web_search_call"), F.struct(F.lit("web_search").alias("tool"), F.coalesce(_get("$.payload.id"), _get("$.payload.call_id")).alias("id")))
    end = F.when(_is("event_msg", *ENDS), F.struct(tool.alias("tool"), _get("$.payload.call_id").alias("id")))
    x = w.select("file_path", "window", "line_no", end.isNotNull().alias("is_end"), F.coalesce(end, call).alias("k"), F.to_json(_get("$.payload.action", "variant")).alias("action"))
    x = x.filter("k.id <> ''").select("*", "k.tool", "k.id")
    of = Window.partitionBy("file_path", "window", "tool", "id")
    x = x.select("*", F.count_if("is_end").over(of).alias("n_ends"), F.count_if(~F.col("is_end")).over(of).alias("n_calls"), F.min(F.when(~F.col("is_end"), F.struct("line_no", "action"))).over(of).alias("call"))
    unlike = (F.col("tool") == "web_search") & ~F.col("action").eqNullSafe(F.col("call.action"))
    fate = F.when((F.col("n_ends") != 1) | (F.col("n_calls") > 1), "ambiguous").when(F.col("n_calls") == 0, "alone").when(unlike, "ambiguous").otherwise("paired")
    return x.filter("is_end").select("file_path", "line_no", fate.alias("fate"), F.when(fate == "paired", F.col("call.line_no")).alias("target"))


def _told(w: DataFrame) -> DataFrame:
    """w with what becomes of each record: shape, the record that it is attached to, and what a counter adds."""
    twin = twins(w)
    human = twin.filter("human").select("file_path", F.col("twin").alias("line_no")).distinct().withColumn("answered", F.lit(True))
    x = w.join(twin.drop("human"), ["file_path", "line_no"], "left").join(ends(w), ["file_path", "line_no"], "left").join(human, ["file_path", "line_no"], "left")
    total = lambda c: F.greatest(F.coalesce(_get(f"$.payload.info.total_token_usage.{c}", "bigint"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    counted = _is("event_msg", "token_count") & _get("$.payload.info.total_token_usage", "variant").isNotNull()
    shape = (
        F.when(_is("compacted"), "system").when(_is("response_item", "message"), F.when(_get("$.payload.role") == "assistant", "assistant").otherwise("user"))
        .when(_is("response_item", "reasoning", "web_search_call", *CALLS), "assistant").when(_is("response_item", *RESULTS), "user")
        .when(_is("event_msg", *SAID), F.when(F.col("twin").isNotNull(), "suppressed").when(F.col("kind") == "user_message", "user").otherwise("assistant"))
        .when(counted, "counter").when(_is("event_msg", "token_count"), "suppressed")
        .when(F.col("fate") == "paired", "paired").when(F.col("fate") == "alone", "operation").otherwise("unknown")
    )
    x = x.withColumn("shape", shape).withColumn("total", F.when(counted, F.struct(total("input_tokens").alias("input"), total("cached_input_tokens").alias("cached"), total("output_tokens").alias("output"))))
    before = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("was", F.last("total", ignorenulls=True).over(before))
    fresh = lambda t: F.greatest(F.col(f"{t}.input") - F.col(f"{t}.cached"), F.lit(0))
    reset = F.col("was").isNull() | (F.col("total.input") < F.col("was.input")) | (F.col("total.output") < F.col("was.output"))
    more = lambda now, was: F.when(F.col("total").isNotNull(), F.when(reset, now).otherwise(F.greatest(now - was, F.lit(0))))
    x = x.withColumn("added", F.struct(more(fresh("total"), fresh("was")).alias("input"), more(F.col("total.output"), F.col("was.output")).alias("output"), more(F.col("total.cached"), F.col("was.cached")).alias("cached")))
    by = Window.partitionBy("file_path", "window").orderBy("line_no")
    said = F.when(F.col("shape") == "assistant", F.col("line_no"))
    owner = F.coalesce(F.last(said, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.first(said, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    x = x.withColumn("target", F.when(F.col("shape") == "counter", owner).otherwise(F.col("target")))
    return x.withColumn("shape", F.when((F.col("shape") == "counter") & F.col("target").isNull(), "unknown").otherwise(F.col("shape"))).drop("total", "was")


def _id(line: Column, sub: int | Column = 0) -> Column:
    return F.concat_ws(":", F.col("session_key"), line.cast("string"), (F.lit(sub) if isinstance(sub, int) else sub).cast("string"))


def _result() -> Column:
    """What an operation without a call printed; searches end without a result."""
    printed = F.coalesce(F.nullif(_get("$.payload.formatted_output"), F.lit("")), F.nullif(_get("$.payload.aggregated_output"), F.lit("")))
    streams = F.concat(F.coalesce(_get("$.payload.stdout"), F.lit("")), F.coalesce(_get("$.payload.stderr"), F.lit("")))
    return F.when(F.col("kind") == "exec_command_end", F.coalesce(printed, streams)).when(F.col("kind") == "patch_apply_end", streams)


def _failed() -> Column:
    no = lambda c: F.coalesce(c, F.lit(False))
    return no(_get("$.payload.status").isin("failed", "declined")) | no(~_get("$.payload.success", "boolean")) | no(_get("$.payload.exit_code", "bigint") != 0)


def _entries(x: DataFrame) -> DataFrame:
    attached = x.filter("shape in ('counter', 'paired')").groupBy("file_path", F.col("target").alias("line_no")).agg(
        F.sum("added.input").alias("input_tokens"), F.sum("added.output").alias("output_tokens"), F.sum("added.cached").alias("cache_read_tokens"), F.collect_list("line_no").alias("lines")
    )
    own = x.filter("shape in ('system', 'user', 'assistant', 'operation', 'unknown')").join(attached, ["file_path", "line_no"], "left")
    # an operation without a call is a call and, where it printed something, a result
    subs = F.when((F.col("shape") == "operation") & _result().isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = own.withColumn("subindex", F.explode(subs)).withColumn("entry_id", _id(F.col("line_no"), F.col("subindex"))).withColumn("uuid", F.when(F.col("shape") != "unknown", F.col("entry_id")))
    before = Window.partitionBy("file_path").orderBy("line_no", "subindex").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("parent_uuid", F.when(F.col("uuid").isNotNull(), F.last("uuid", ignorenulls=True).over(before)))
    assistant = (F.col("shape") == "assistant") | ((F.col("shape") == "operation") & (F.col("subindex") == 0))
    kind = F.when(F.col("shape").isin("system", "unknown"), F.when(F.col("shape") == "system", "system").otherwise(F.col("type"))).otherwise(F.when(assistant, "assistant").otherwise("user"))
    said = F.col("uuid").isNotNull()
    system = F.col("shape") == "system"
    mine = {
        "entry_type": kind, "uuid": F.col("uuid"), "parent_uuid": F.col("parent_uuid"), "logical_parent_uuid": F.when(system, F.col("parent_uuid")), "session_id": F.col("session_key"), "version": F.when(said, F.col("version")),
        "cwd": F.when(said, F.col("cwd")), "subtype": F.when(system, "compact_boundary"), "level": F.when(system, "info"), "is_meta": F.when(system, F.lit(True)), "is_sidechain": F.when(said & ~system, F.lit(False)),
        "message_id": F.when(assistant, F.col("uuid")), "role": F.when(assistant, "assistant").when(said & ~system, F.coalesce(F.when(_is("response_item", "message"), _get("$.payload.role")), F.lit("user"))),
        "model": F.when(assistant, F.col("model")), "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "cache_read_tokens": F.col("cache_read_tokens"),
        "content": _get("$.payload.content", "variant"), "system_text": F.when(system, _get("$.payload.message")),
    }
    author = F.when(_is("response_item", *RESULTS), "tool").when(_is("event_msg", "user_message") | F.col("answered"), "human").otherwise("harness")
    user = F.coalesce(kind == "user", F.lit(False)) & said & (F.col("shape") == "user")
    return e.select(
        "session_key", "file_path", (F.col("line_no") * 2 + F.col("subindex")).alias("line_no"), F.lit(False).alias("is_subagent"),
        *[mine.get(c, F.lit(None)).cast(t).alias(c) for c, _, t in FIELDS], "ts", F.col("line").alias("raw"),
        "entry_id", F.sort_array(F.concat(F.array("line_no"), F.when(F.col("subindex") == 0, F.coalesce("lines", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")))).alias("origins"),
        F.when(said, F.col("turn_id")).alias("turn_id"), F.when(user, author).alias("author"), F.when(user, F.when(_is("response_item", "message"), "turn_boundary").otherwise("mid_turn")).alias("delivery"),
    )


def _blocks(x: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = dict(f.split() for f in BLOCKS.split(", "))

    def rows(df: DataFrame, who: Column | str, sub: int = 0, **made: Column) -> DataFrame:
        uuid = _id(F.col("line_no"), sub)
        who = F.lit(who) if isinstance(who, str) else who
        base = {"session_key": F.col("session_key"), "line_no": F.col("line_no") * 2 + sub, "uuid": uuid, "ts": F.col("ts"), "entry_type": who, "message_id": F.when(who == "assistant", uuid), "block_no": F.lit(0)} | made
        return df.select(*[base.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])

    message = x.filter(_is("response_item", "message")).select("*", F.posexplode(_get("$.payload.content", "array<variant>")).alias("part", "b"))
    b = lambda path: F.try_variant_get(F.col("b"), path, "string")
    plain = b("$.type").isin("input_text", "output_text")
    thoughts = F.filter(F.concat(*[F.coalesce(_texts(f"$.payload.{c}"), F.array().cast("array<string>")) for c in ("summary", "content")]), lambda t: F.trim(t) != "")
    arguments, input_ = _get("$.payload.arguments"), _get("$.payload.input", "variant")
    given = F.when(F.col("kind") == "function_call", F.coalesce(F.try_parse_json(arguments), arguments.cast("variant"))).otherwise(input_)
    variant = lambda *fields: F.to_variant_object(F.struct(*[_get(f"$.payload.{f}", "variant").alias(f) for f in fields]))
    searched = x.filter(_is("response_item", "web_search_call"))
    tool = F.create_map(*[F.lit(y) for kv in ENDS.items() for y in kv])[F.col("kind")]
    done = F.when(F.col("kind") == "exec_command_end", variant("command", "cwd", "parsed_cmd", "source")).when(F.col("kind") == "patch_apply_end", variant("changes")).otherwise(variant("query", "action"))
    output = F.coalesce(F.when(F.schema_of_variant(_get("$.payload.output", "variant")) == "STRING", _get("$.payload.output")), F.to_json(_get("$.payload.output", "variant")), F.lit(""))
    event, operation = x.filter(_is("event_msg", *SAID) & (F.col("shape") != "suppressed")), x.filter("shape = 'operation'")
    out = [
        rows(message, F.col("shape"), block_no=F.col("part"), block_type=F.when(plain, "text").otherwise(F.coalesce(b("$.type"), F.lit(""))), text=F.when(plain, F.coalesce(b("$.text"), F.lit("")))),
        rows(x.filter(_is("response_item", "reasoning")), "assistant", block_type=F.lit("thinking"), thinking=F.array_join(thoughts, "\n\n")),
        rows(x.filter(_is("response_item", *CALLS)), "assistant", block_type=F.lit("tool_use"), call_id=F.coalesce(_get("$.payload.call_id"), F.lit("")), tool_name=F.coalesce(_get("$.payload.name"), F.lit("unknown")), tool_input=given),
        rows(searched, "assistant", block_type=F.lit("tool_use"), call_id=F.coalesce(_get("$.payload.id"), _get("$.payload.call_id"), F.concat(F.lit("ws_"), F.col("line_no").cast("string"))), tool_name=F.lit("web_search"), tool_input=variant("status", "action")),
        rows(x.filter(_is("response_item", *RESULTS)), "user", block_type=F.lit("tool_result"), tool_use_id=F.coalesce(_get("$.payload.call_id"), F.lit("")), result_text=output),
        rows(event.filter("kind in ('user_message', 'agent_message')"), F.col("shape"), block_type=F.lit("text"), text=F.coalesce(_get("$.payload.message"), F.lit(""))),
        rows(event.filter("kind not in ('user_message', 'agent_message')"), "assistant", block_type=F.lit("thinking"), thinking=F.coalesce(_get("$.payload.text"), F.lit(""))),
        rows(operation, "assistant", block_type=F.lit("tool_use"), call_id=_get("$.payload.call_id"), tool_name=tool, tool_input=done),
        rows(operation.filter(_result().isNotNull()), "user", 1, block_type=F.lit("tool_result"), tool_use_id=_get("$.payload.call_id"), result_text=_result(), is_error=_failed()),
    ]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _dispositions(x: DataFrame) -> DataFrame:
    own = F.when((F.col("shape") == "operation") & _result().isNotNull(), F.array(_id(F.col("line_no")), _id(F.col("line_no"), 1))).otherwise(F.array(_id(F.col("line_no"))))
    named = F.when(F.col("shape").isin("counter", "paired"), F.array(_id(F.col("target")))).when(F.col("shape") != "suppressed", own).otherwise(F.array().cast("array<string>"))
    outcome = F.when(F.col("shape").isin("suppressed", "unknown"), F.col("shape")).otherwise("mapped")
    reason = F.when(F.col("shape") == "suppressed", F.when(F.col("twin").isNotNull(), "twin").otherwise("no numbers"))
    return x.select("session_key", "file_path", F.col("line_no").alias("record"), outcome.alias("outcome"), reason.alias("reason"), F.when(F.col("shape") == "suppressed", F.col("twin")).alias("twin"), named.alias("entries"))


def _observed(x: DataFrame) -> DataFrame:
    """(session_key, call_id, record, exit_code, success, status, seconds): the ends of operations that belong to a call or are one."""
    nanos = _get("$.payload.duration.nanos", "bigint")
    seconds = F.when(nanos.between(0, 999_999_999), _get("$.payload.duration.secs", "bigint") + nanos / 1e9)
    return x.filter("fate in ('paired', 'alone')").select("session_key", _get("$.payload.call_id").alias("call_id"), F.col("line_no").alias("record"), _get("$.payload.exit_code", "int").alias("exit_code"), _get("$.payload.success", "boolean").alias("success"), _get("$.payload.status").alias("status"), seconds.alias("seconds"))


def normalized(raw: DataFrame, first_new: DataFrame | None = None) -> Normalized:
    """Canonical entries and blocks of raw(file_path, line_no, line), a disposition for every line that isn't blank, and the observed ends of operations.

    A line may give two entries, so line_no in the canonical tables is twice the line's number plus the entry's within
    it; origins lists the lines of the file that an entry rests on. Entries have, beyond the canonical columns, turn_id,
    and author (human, harness, tool) and delivery (turn_boundary, mid_turn) of users' ones. Unknown entries have no
    uuid and stand outside the thread. Files of another shape are refused whole. The walk is written once to the shared
    folder; a file is one group of its windows, ordered by line.
    """
    p = parsed(raw).filter("status <> 'empty'")
    r = rollouts.records(raw)
    x = kept(_told(kept(walked(r, first_new), "walked")), "told")
    refused = r.filter("dialect <> 'envelope'").select("session_key", "file_path", F.col("line_no").alias("record"), F.lit("refused").alias("outcome"), F.col("dialect").alias("reason"))
    broken = p.filter("status = 'skipped'").select(F.lit(None).cast("string").alias("session_key"), "file_path", F.col("line_no").alias("record"), F.lit("unparseable").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    rest = refused.unionByName(broken).withColumns({"twin": F.lit(None).cast("long"), "entries": F.array().cast("array<string>")})
    return Normalized(_entries(x), _blocks(x), _dispositions(x).unionByName(rest), _observed(x))


def violations(raw: DataFrame, entries: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(file_path, record, entry_id, violation) where the account of raw's lines doesn't add up; no rows if it does.

    Every line that isn't blank has to have one disposition. What is mapped or unknown names entries, each once, that
    exist and rest on that line; an entry is unique and each line that it rests on names it. A twin is a mapped line.
    """
    none = lambda k: F.lit(None).cast(k)
    said = lambda df, record="record", entry=None: df.select("file_path", F.col(record).alias("record") if record else none("long").alias("record"), F.col(entry).alias("entry_id") if entry else none("string").alias("entry_id"), "violation")
    # each side is written once, and each join gives all that it shows: a finding of its own doesn't make it again
    each = lambda df, **what: df.withColumn("violation", F.explode(F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(text)) for text, cond in what.items()]))))
    dispositions = kept(dispositions.select("file_path", "record", "outcome", "twin", "entries"), "dispositions")
    origins = kept(entries.select("file_path", "entry_id", "origins"), "origins")
    lines = raw.filter(F.trim("line") != "").select("file_path", F.col("line_no").alias("record"))
    counted = dispositions.groupBy("file_path", "record").agg(F.count("*").alias("n"), F.max((F.col("outcome") == "mapped").cast("int")).alias("mapped"))
    both = lines.withColumn("there", F.lit(True)).join(counted, ["file_path", "record"], "full")
    producing = dispositions.filter("outcome in ('mapped', 'unknown')")
    named = producing.select("file_path", "record", F.explode("entries").alias("entry_id")).groupBy("file_path", "record", "entry_id").agg(F.count("*").alias("times"))
    rests = origins.select("file_path", "entry_id", F.explode("origins").alias("record")).distinct()
    ids = origins.groupBy("file_path", "entry_id").agg(F.count("*").alias("n"))
    met = named.join(rests.withColumn("rests", F.lit(True)), ["file_path", "record", "entry_id"], "full").join(ids, ["file_path", "entry_id"], "left")
    twin = dispositions.filter("outcome = 'suppressed' and twin is not null").select("file_path", "record", "twin")
    mapped = dispositions.filter("outcome = 'mapped'").select("file_path", F.col("record").alias("twin"))
    found = [
        said(each(both, **{"record without a disposition": "n is null", "disposition of no record": "there is null", "record with several dispositions": "n > 1"})),
        said(producing.filter("size(entries) = 0").withColumn("violation", F.lit("producing record without entries"))),
        said(each(met, **{"entry named twice by one record": "times > 1", "entry that doesn't exist": "times is not null and n is null", "entry that doesn't rest on the record": "times is not null and rests is null and n is not null", "entry that its record doesn't name": "times is null"}), entry="entry_id"),
        said(ids.filter("n > 1").withColumn("violation", F.lit("entry id used twice")), None, "entry_id"),
        said(twin.join(mapped, ["file_path", "twin"], "left_anti").withColumn("violation", F.lit("twin that isn't mapped"))),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
