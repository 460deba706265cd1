"""Queries whose operators need a grouped pass or a Python function, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import redact, text
from ..operators import replay, trees, usage
from ..sources.tables import load
from .catalogue import register


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as canonical entries (each turn's parent is the one before) and their text blocks."""
    key = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    c = load(spark, sf_dir, "conversations")
    e = c.select(
        F.col("conv_id").cast("string").alias("session_key"), (F.col("turn") + 1).alias("line_no"), key(F.col("turn")).alias("uuid"),
        F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("parent_uuid"), F.lit(None).cast("string").alias("logical_parent_uuid"), F.col("role").alias("entry_type"),
        F.timestamp_seconds(F.col("turn")).alias("ts"), F.col("text").alias("raw"),
    )
    b = e.select("session_key", "line_no", "entry_type", F.lit("text").alias("block_type"))
    return e, b


@register(
    "G6_main_thread",
    """with n as (select conv_id, turn, max(case when role in ('user', 'assistant') then turn end) over (partition by conv_id) as last_talk,
      count(*) over (partition by conv_id order by turn rows between current row and unbounded following) as size from conversations)
    select cast(conv_id as varchar) as session_key, concat(conv_id, '/', turn) as uuid, turn as depth, size as subtree_size, turn as main_pos from n""",
)
def main_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = _entries(spark, sf_dir)
    return trees.nodes(e, b).filter("is_main").select("session_key", "uuid", F.col("depth").cast("long").alias("depth"), F.col("subtree_size").cast("long").alias("subtree_size"), F.col("main_pos").cast("long").alias("main_pos"))


@register("G2_duplicate_entries", "select cast(conv_id as varchar) as session_key, turn + 1 as line_no from (select *, row_number() over (partition by conv_id, turn order by turn) as nr from conversations) x where nr > 1")
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.duplicates(_entries(spark, sf_dir)[0]).select("session_key", "line_no")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.pmod(F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(2)).alias("side"))
    return e.filter("side = 0"), e.filter("side = 1")


@register("K9_sequence_diff")
def sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's odd events against the even ones, by type."""
    return replay.sequence_diff(*_sides(spark, sf_dir), "user_id", "event_id", "event_type")


@register("P1_file_replay")
def file_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files: each assistant turn writes its text, each user turn replaces its first word there."""
    c = load(spark, sf_dir, "conversations")
    word = F.element_at(F.split("text", " "), 1)
    ops = c.select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "write").otherwise("edit").alias("kind"), F.col("text").alias("content"),
        F.lower(word).alias("old"), F.lit("<new>").alias("new"), F.lit(True).alias("replace_all"),
    )
    return replay.recovered(ops)


@register("X5_fuzzy")
def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that `license` matches as a subsequence, numbered from one."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    d = d.select("doc_id", (F.col("nr") + 1).alias("line_no"), "line")
    return replay.fuzzy_matches(d, "line", "license", 70)


@register("C6_redaction_preview")
def redaction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.filter(F.col("text").rlike(redact.PATTERNS["email"])).select("doc_id", redact.marked(F.col("text"), "email").alias("text"), redact.kinds_found(F.col("text")).alias("kinds"))


@register("C4_redact_all")
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.filter(F.array(redact.redacted(F.col("text"))), lambda x: x != F.col("text"))  # a filter below would redact twice
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(changed).alias("redacted"))


@register(
    "C1_word_truncate",
    """with h as (select doc_id, text, left(text, 80) as head from documents), s as (select *, length(head) - strpos(reverse(head), ' ') as space from h)
    select doc_id, case when length(text) <= 80 then text when strpos(head, ' ') > 0 and space > 40 then left(head, space) || '...' else head || '...' end as preview from s""",
)
def word_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 80).alias("preview"))


@register(
    "A2_streamed_turns",
    """select cast(user_id as varchar) as session_key, max(cast(floor(value * 100) as bigint)) as input_tokens, count(*) as chunks from events
    where event_type <> 'signup' group by user_id, event_type, cast(json_extract_string(props, '$.k') as int) // 10""",
)
def streamed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as streamed chunks of turns: one turn a user, type and tenth of k."""
    e = load(spark, sf_dir, "events").filter("event_type <> 'signup'")
    turn = F.concat_ws("/", "event_type", F.expr("cast(get_json_object(props, '$.k') as int) div 10").cast("string"))
    none = F.lit(None).cast("long")
    rows = e.select(
        F.col("user_id").cast("string").alias("session_key"), F.lit("assistant").alias("entry_type"), turn.alias("message_id"), F.col("event_id").cast("string").alias("uuid"), F.col("event_type").alias("model"),
        F.floor(F.col("value") * 100).alias("input_tokens"), none.alias("output_tokens"), none.alias("cache_creation_tokens"), none.alias("cache_read_tokens"), F.col("ts"), F.lit("x").alias("stop_reason"), F.col("event_id").alias("line_no"),
    )
    return usage.turns(rows).select("session_key", "input_tokens", "chunks")
