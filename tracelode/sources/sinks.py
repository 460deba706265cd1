"""Exports of entries and blocks through Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redact, text
from ..operators import usage


def to_jsonl(entries: DataFrame, path: str, hide: str | None = None) -> None:
    """The lines as they were read, in file order within a session, or with a redaction level applied."""
    raw = F.col("raw") if hide is None else redact.redacted_json(F.col("raw"), hide)
    entries.sortWithinPartitions("session_key", "line_no").select(raw.alias("value")).write.mode("error").text(path)


def messages(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """The CSV export's rows of messages: a preview of the visible text and the number of tool calls."""
    said = blocks.groupBy("session_key", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("block_type") == "text", F.struct("block_no", "text")))), lambda x: x["text"]), "\n").alias("visible"),
        F.count_if(F.col("block_type") == "tool_use").alias("tool_count"),
    )
    e = entries.filter(F.col("entry_type").isin("user", "assistant")).join(said, ["session_key", "line_no"], "left")
    return e.select("uuid", "parent_uuid", F.col("entry_type").alias("type"), F.col("ts").alias("timestamp"), "model", text.truncated(F.col("visible"), 100).alias("content_preview"), "input_tokens", "output_tokens", F.coalesce("tool_count", F.lit(0)).alias("tool_count"))


def to_csv(rows: DataFrame, path: str) -> None:
    """Any flat rows as CSV with a header; quotes are doubled."""
    rows.write.mode("error").option("header", True).option("escape", '"').csv(path)


def to_markdown(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(session_key, document): each session's messages under headings, in order. A group is one session's texts."""
    part = F.concat(F.lit("## "), F.initcap("entry_type"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = blocks.filter("block_type = 'text' and entry_type in ('user', 'assistant')").select("session_key", F.struct("line_no", "block_no", part.alias("part")).alias("x"))
    listed = rows.groupBy("session_key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return listed.select("session_key", F.array_join(F.transform("xs", lambda x: x["part"]), "\n\n").alias("document"))


def code_blocks(blocks: DataFrame) -> DataFrame:
    """Fenced code of text blocks with its language."""
    found = blocks.filter("block_type = 'text'").select("session_key", "line_no", "block_no", "entry_type", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)```(.*?)```"), F.lit(1))).alias("nr", "code"))
    return found.select("session_key", "line_no", "block_no", "entry_type", "nr", F.regexp_extract("code", r"^([^\n]*)\n", 1).alias("language"), F.regexp_replace("code", r"^[^\n]*\n", "").alias("code"))


def _hidden(df: DataFrame, columns: tuple[str, ...], level: str) -> DataFrame:
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    how = lambda c: redact.redacted_json if c == "raw" else redact.redacted_variant if kinds[c] == "variant" else redact.redacted
    return df.withColumns({c: how(c)(F.col(c), level) for c in columns if c in kinds})


def transformed(entries: DataFrame, blocks: DataFrame, hide: str | None = None, only: tuple[str, ...] | None = None, thinking: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables as an export shows them: of some entry types, with or without thinking, and redacted at a level, texts, results and what tools were given alike."""
    if only:
        entries, blocks = entries.filter(F.col("entry_type").isin(*only)), blocks.filter(F.col("entry_type").isin(*only))
    if not thinking:
        blocks = blocks.filter("block_type <> 'thinking'")
    if hide is not None:
        entries = _hidden(entries, ("raw", "summary", "system_text", "content", "tool_use_result"), hide)
        blocks = _hidden(blocks, ("text", "thinking", "result_text", "tool_input"), hide)
    return entries, blocks


def to_json(entries: DataFrame, blocks: DataFrame, forest: DataFrame | None = None, analytics: bool = False, lossless: bool = False) -> DataFrame:
    """(session_key, document): a session as one JSON object with its facts and its entries in order. A group is one session.

    With forest (trees.nodes()) `tree` tells the roots, branch points, depth and the main thread's length. analytics adds
    turns, tokens, calls by tool and failed results. Entries show their blocks with what calls were given; lossless
    ones are the lines as they were read, byte for byte.
    """
    facts = F.struct("session_key", F.size("entries").alias("entry_count"), F.col("start").alias("start"), F.col("end").alias("end"))
    span = entries.groupBy("session_key").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    if lossless:
        e = entries.select("session_key", F.struct("line_no", "raw").alias("e"))
    else:
        block = F.struct("block_no", "block_type", "text", "thinking", "call_id", "tool_name", F.col("tool_input").alias("tool_input"), "tool_use_id", "result_text", "is_error")
        own = blocks.groupBy("session_key", "line_no").agg(F.transform(F.array_sort(F.collect_list(block), lambda x, y: x["block_no"] - y["block_no"]), lambda x: x).alias("shown"))
        e = entries.join(own, ["session_key", "line_no"], "left").select("session_key", F.struct("line_no", F.to_json(F.struct("line_no", "uuid", "parent_uuid", F.col("entry_type").alias("type"), F.col("ts").alias("timestamp"), "model", F.col("shown").alias("content"))).alias("raw")).alias("e"))
    s = e.groupBy("session_key").agg(F.sort_array(F.collect_list("e")).alias("entries")).join(span, "session_key")
    parts = [F.concat(F.lit('"metadata":'), F.to_json(facts))]
    if analytics:
        t = usage.token_totals(usage.turns(entries), "session_key").select("session_key", F.struct("turns", *usage.TOKENS, "total_tokens").alias("tokens"))
        tools = blocks.filter("block_type = 'tool_use'").groupBy("session_key", "tool_name").agg(F.count("*").alias("n")).groupBy("session_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool_name", "n")))).alias("tools"))
        failed = blocks.groupBy("session_key").agg(F.count_if("is_error").alias("failed_results"))
        s = s.join(t, "session_key", "left").join(tools, "session_key", "left").join(failed, "session_key", "left")
        parts.append(F.concat(F.lit('"analytics":'), F.to_json(F.struct("tokens", "tools", "failed_results"))))
    if forest is not None:
        shape = forest.groupBy("session_key").agg(F.struct(F.count_if("is_root").alias("roots"), F.count_if(F.col("n_children") > 1).alias("branch_points"), F.max("depth").alias("max_depth"), F.count_if("is_main").alias("main_thread")).alias("tree"))
        s = s.join(shape, "session_key", "left")
        parts.append(F.concat(F.lit('"tree":'), F.coalesce(F.to_json("tree"), F.lit("null"))))
    parts.append(F.concat(F.lit('"entries":['), F.array_join(F.transform("entries", lambda x: x["raw"]), ","), F.lit("]")))
    return s.select("session_key", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("document"))


def export_all(documents: DataFrame, sessions: DataFrame, path: str, since=None, until=None, project: str | None = None) -> None:
    """Writes documents(session_key, document) as text, in a folder for each project, of the sessions(session_key, project, start_ts, end_ts) that overlap since to until and whose project holds the text.

    Each document is one line if it has none of its own line ends, as JSON hasn't.
    """
    s = sessions
    if since is not None:
        s = s.filter(F.col("end_ts") >= F.lit(since))
    if until is not None:
        s = s.filter(F.col("start_ts") <= F.lit(until))
    if project:
        s = s.filter(F.contains(F.lower("project"), F.lit(project.lower())))
    named = documents.join(s.select("session_key", F.coalesce("project", F.lit("")).alias("project")), "session_key")
    named.select("project", F.col("document").alias("value")).write.mode("error").partitionBy("project").text(path)


def tool_line(name: Column, args: Column) -> Column:
    """A call in one line: the tool and what it works on."""
    what = F.coalesce(*[F.get_json_object(args, f"$.{k}") for k in ("command", "file_path", "notebook_path", "pattern", "path", "url", "query", "description", "prompt")], F.lit(""))
    return F.concat(name, F.when(what == "", F.lit("")).otherwise(F.concat(F.lit(": "), text.truncated(F.regexp_replace(what, r"\s+", " "), 100))))


def escaped(t: Column) -> Column:
    out = t
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _shown(blocks: DataFrame) -> DataFrame:
    """(session_key, x) with x(line_no, block_no, who, kind, body) of what a reader sees."""
    body = F.when(F.col("block_type") == "tool_use", tool_line(F.col("tool_name"), F.to_json("tool_input"))).otherwise(F.coalesce("text", "thinking", "result_text", F.lit("")))
    return blocks.filter(F.col("block_type").isin("text", "thinking", "tool_use", "tool_result")).select("session_key", F.struct("line_no", "block_no", F.col("entry_type").alias("who"), F.col("block_type").alias("kind"), body.alias("body")).alias("x"))


def to_text(blocks: DataFrame) -> DataFrame:
    """(session_key, document): plain text, a paragraph a block after who says it."""
    s = _shown(blocks).groupBy("session_key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    mark = lambda x: F.when(x["kind"] == "text", F.upper(x["who"])).otherwise(F.upper(F.replace(x["kind"], F.lit("_"), F.lit(" "))))
    return s.select("session_key", F.array_join(F.transform("xs", lambda x: F.concat(F.lit("["), mark(x), F.lit("]\n"), x["body"])), "\n\n").alias("document"))


def to_html(blocks: DataFrame, dark: bool = False) -> DataFrame:
    """(session_key, document): a page for each session; thinking and results are folded."""
    s = _shown(blocks).groupBy("session_key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    plain = lambda x: F.concat(F.lit('<section class="'), x["who"], F.lit('"><h2>'), F.initcap(x["who"]), F.lit("</h2><pre>"), escaped(x["body"]), F.lit("</pre></section>"))
    folded = lambda x: F.concat(F.lit("<details><summary>"), F.replace(x["kind"], F.lit("_"), F.lit(" ")), F.lit("</summary><pre>"), escaped(x["body"]), F.lit("</pre></details>"))
    body = F.array_join(F.transform("xs", lambda x: F.when(x["kind"] == "text", plain(x)).otherwise(folded(x))), "\n")
    style = "body{background:#111;color:#eee}" if dark else "body{background:#fff;color:#111}"
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped(F.col("session_key")), F.lit(f"</title><style>{style}</style></head><body>"))
    return s.select("session_key", F.concat(head, body, F.lit("</body></html>")).alias("document"))


def from_template(rows: DataFrame, template: str) -> DataFrame:
    """rows with `document`: the template with each {{column}} replaced by the row's value; unknown names are an error."""
    parts, rest = [], template
    while "{{" in rest:
        before, _, rest = rest.partition("{{")
        name, closed, rest = rest.partition("}}")
        if not closed or name.strip() not in rows.columns:
            raise ValueError(f"{name.strip()}: no such column")
        parts += [F.lit(before), F.coalesce(F.col(f"`{name.strip()}`").cast("string"), F.lit(""))]
    return rows.withColumn("document", F.concat(*parts, F.lit(rest)))


def relational(entries: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """The tables of a relational export, by name; each can be written as Parquet or through JDBC."""
    key = ["session_key", "line_no", "block_no"]
    return {
        "entries": entries.select("session_key", "line_no", "uuid", "parent_uuid", "entry_type", "ts", "model", "is_sidechain"),
        "content_blocks": blocks.select(*key, "block_type", "text"),
        "thinking_blocks": blocks.filter("block_type = 'thinking'").select(*key, "thinking"),
        "tool_uses": blocks.filter("block_type = 'tool_use'").select(*key, "call_id", "tool_name", F.to_json("tool_input").alias("input")),
        "tool_results": blocks.filter("block_type = 'tool_result'").select(*key, "tool_use_id", "result_text", "is_error"),
        "usage_stats": entries.filter("entry_type = 'assistant'").select("session_key", "line_no", "message_id", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"),
    }
