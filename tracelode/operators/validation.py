"""What is wrong with sessions: a row for each finding, and a verdict for each session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees

# The fields that entries are known to have.
KNOWN = (
    "type", "uuid", "parentUuid", "logicalParentUuid", "timestamp", "sessionId", "version", "cwd", "gitBranch", "userType", "agentId", "slug", "requestId", "subtype", "level", "summary", "leafUuid", "isSidechain", "isTeammate", "isMeta",
    "isCompactSummary", "isVisibleInTranscriptOnly", "message", "content", "toolUseResult", "compactMetadata", "messageId", "snapshot", "isSnapshotUpdate", "operation", "attachment", "toolUseID", "parentToolUseID", "data", "todos", "thinkingMetadata",
)
#: Kinds of entries that need an id and a time.
NEEDS = ("user", "assistant", "system")


def findings(parsed: DataFrame, entries: DataFrame, blocks: DataFrame, schema: bool = True, relationships: bool = True, unknown: bool = True) -> DataFrame:
    """(session_key, level, finding, n, example): errors and warnings of each session, counted, with the least example.

    Errors are lines that don't parse and user, assistant and system entries without an id or a time. Warnings are
    several roots, calls and results out of balance, ids used twice (with other content, or the same), fields that
    aren't known, and, with schema, blocks without what their kind needs.
    """
    name = F.regexp_extract("file_path", r"([^/]+?)(\.jsonl)?(\.zst)?$", 1)
    say = lambda df, level, what, example: df.groupBy("session_key").agg(F.lit(level).alias("level"), F.lit(what).alias("finding"), F.count("*").alias("n"), F.min(example.cast("string")).alias("example"))
    line = F.format_string("%010d", F.col("line_no"))
    needs = entries.filter(F.col("entry_type").isin(*NEEDS))
    out = [
        say(parsed.filter("status = 'skipped'").select(name.alias("session_key"), "line_no"), "error", "line that doesn't parse", line),
        say(needs.filter("uuid is null"), "error", "entry without an id", line), say(needs.filter("ts is null"), "error", "entry without a time", line),
    ]
    if relationships:
        roots = trees.nodes(entries, blocks).filter("is_root").groupBy("session_key").agg(F.count("*").alias("n"), F.min("uuid").alias("example")).filter("n > 1")
        out.append(roots.select("session_key", F.lit("warning").alias("level"), F.lit("several roots").alias("finding"), "n", "example"))
        sides = blocks.groupBy("session_key").agg(F.count_if(F.col("block_type") == "tool_use").alias("uses"), F.count_if(F.col("block_type") == "tool_result").alias("results")).filter("uses <> results")
        out.append(sides.select("session_key", F.lit("warning").alias("level"), F.lit("calls and results out of balance").alias("finding"), F.abs(F.col("uses") - F.col("results")).alias("n"), F.concat_ws(" to ", F.col("uses").cast("string"), F.col("results").cast("string")).alias("example")))
        twice = trees.duplicates(entries)
        out += [say(twice.filter("not exact"), "warning", "id used again with other content", F.col("uuid")), say(twice.filter("exact"), "warning", "entry repeated", F.col("uuid"))]
    if unknown:
        fields = entries.select("session_key", F.explode(F.map_keys(F.try_variant_get(F.try_parse_json("raw"), "$", "map<string,variant>"))).alias("field"))
        out.append(say(fields.filter(~F.col("field").isin(*KNOWN)), "warning", "unknown field", F.col("field")))
    if schema:
        lacks = ((F.col("block_type") == "text") & F.col("text").isNull()) | ((F.col("block_type") == "tool_use") & (F.col("call_id").isNull() | F.col("tool_name").isNull())) | ((F.col("block_type") == "tool_result") & F.col("tool_use_id").isNull())
        out.append(say(blocks.filter(lacks), "warning", "block without what its kind needs", F.concat_ws(" ", F.col("block_type"), line)))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def report(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(session_key, entries, errors, warnings, is_valid, version) of all sessions that have entries or findings."""
    e = entries.groupBy("session_key").agg(F.count("*").alias("entries"), F.min_by("version", F.when(F.col("version").isNotNull(), F.col("line_no"))).alias("version"))
    f = found.groupBy("session_key").agg(F.coalesce(F.sum(F.when(F.col("level") == "error", F.col("n"))), F.lit(0)).alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    x = e.join(f, "session_key", "full").na.fill(0, ["entries", "errors", "warnings"])
    return x.select("session_key", "entries", "errors", "warnings", (F.col("errors") == 0).alias("is_valid"), "version")
