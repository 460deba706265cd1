"""Session logs: JSON Lines files to the canonical entries and blocks.

Lines are read as text and parsed once to VARIANT, so a line that is no JSON, or a field of an unexpected kind,
never fails a scan: the line becomes a parse error, the field null, and the raw text stays at hand.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A file whose name begins with it is a subagent's log.
AGENT_PREFIX = "agent-"
#: Where a whole entry may begin inside a torn line.
ENTRY_STARTS = r'\{"(?:parentUuid|type|uuid)"'
#: Scalar fields of an entry: column, path, type.
FIELDS = (
    ("entry_type", "$.type", "string"), ("uuid", "$.uuid", "string"), ("parent_uuid", "$.parentUuid", "string"), ("logical_parent_uuid", "$.logicalParentUuid", "string"),
    ("session_id", "$.sessionId", "string"), ("version", "$.version", "string"), ("cwd", "$.cwd", "string"), ("git_branch", "$.gitBranch", "string"), ("agent_id", "$.agentId", "string"),
    ("slug", "$.slug", "string"), ("request_id", "$.requestId", "string"), ("subtype", "$.subtype", "string"), ("level", "$.level", "string"), ("summary", "$.summary", "string"),
    ("is_sidechain", "$.isSidechain", "boolean"), ("is_meta", "$.isMeta", "boolean"), ("is_compact_summary", "$.isCompactSummary", "boolean"),
    ("message_id", "$.message.id", "string"), ("role", "$.message.role", "string"), ("model", "$.message.model", "string"), ("stop_reason", "$.message.stop_reason", "string"),
    ("input_tokens", "$.message.usage.input_tokens", "bigint"), ("output_tokens", "$.message.usage.output_tokens", "bigint"),
    ("cache_creation_tokens", "$.message.usage.cache_creation_input_tokens", "bigint"), ("cache_read_tokens", "$.message.usage.cache_read_input_tokens", "bigint"),
    ("content", "$.message.content", "variant"), ("tool_use_result", "$.toolUseResult", "variant"), ("system_text", "$.content", "string"),
)


def _get(column: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(column), path, kind)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_no, line) of the files at path, compressed ones included; line numbers count from 1 within a file.

    Large files are read in splits. A line's number within its split comes from the order of reading, and the splits
    before it in the file add theirs; only a row for each split is shuffled for that.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = text.groupBy("file_path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return text.join(splits, ["file_path", "split"]).select("file_path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def parsed(raw: DataFrame) -> DataFrame:
    """raw lines with v, the parsed value (null for blank lines and those that aren't one JSON object and nothing else), and status."""
    # within brackets, text after the object is an error and a second object is a second element
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]"))), "$", "array<variant>")
    # filters on what follows stop at the generated column: a line isn't parsed again for each of them
    r = raw.select("*", F.explode(F.array(items)).alias("_items"))
    ok = F.coalesce((F.size("_items") == 1) & F.ltrim("line").startswith("{"), F.lit(False))
    blank = F.trim("line") == ""
    status = F.when(blank, "empty").when(ok, "parsed").otherwise("skipped")
    return r.select(*[c for c in raw.columns if c not in ("v", "status")], F.when(ok, F.get("_items", F.lit(0))).alias("v"), status.alias("status"))


def parse_statistics(p: DataFrame) -> DataFrame:
    """Per file: lines processed, parsed, skipped, empty, and the success rate (100 without lines, 0 without a valid one)."""
    by = p.groupBy("file_path").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("parsed", "skipped", "empty")], F.count("*").alias("lines_processed"))
    tried = F.col("parsed") + F.col("skipped")
    return by.withColumn("success_rate", F.when(tried == 0, 100.0).otherwise(100.0 * F.col("parsed") / tried))


def parse_report(p: DataFrame) -> DataFrame:
    """parse_statistics with salvaged: whole entries found in the lines that were skipped."""
    found = salvaged(p).groupBy("file_path").agg(F.count("*").alias("salvaged"))
    return parse_statistics(p).join(found, "file_path", "left").withColumn("salvaged", F.coalesce("salvaged", F.lit(0)))


def parse_errors(p: DataFrame) -> DataFrame:
    return p.filter("status = 'skipped'").select("file_path", "line_no", "line")


def strict(p: DataFrame) -> DataFrame:
    """The parsed lines; the job fails at a line that doesn't parse, naming it."""
    said = F.concat(F.col("file_path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": not an entry"))
    return p.withColumn("v", F.when(F.col("status") == "skipped", F.raise_error(said).cast("variant")).otherwise(F.col("v"))).filter("status <> 'empty'")


def salvaged(p: DataFrame) -> DataFrame:
    """Whole entries at the end of torn lines: from the first place where an entry may begin and from which on the line is nothing but entries, all of these."""
    torn = p.filter("status = 'skipped'").filter(F.col("line").rlike(rf"(?s).{ENTRY_STARTS}")).select("file_path", "line_no", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, n, x) for f, n, line in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in whole_entries(line)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], b.schema.field(i).type) for i in range(3)], names=b.schema.names)

    return parsed(torn.mapInArrow(run, torn.schema)).filter("status = 'parsed'")


def whole_entries(line: str) -> list[str]:
    """The entries that a torn line ends with, as texts."""
    decoder = json.JSONDecoder()
    for start in (m.start() for m in re.finditer(ENTRY_STARTS, line)):
        found, at = [], start
        while start and at < len(line):
            try:
                value, end = decoder.raw_decode(line, at)
            except ValueError:
                break
            if not isinstance(value, dict):
                break
            found.append(line[at:end])
            at = end + len(line[end:]) - len(line[end:].lstrip())
        if found and at == len(line):
            return found
    return []


def entries(p: DataFrame) -> DataFrame:
    """The canonical entries of parsed lines, one row a line; session_key is the file's name without its ending."""
    name = F.regexp_extract("file_path", r"([^/]+?)(\.jsonl)?(\.zst)?$", 1)
    e = p.filter("status = 'parsed'")
    return e.select(
        name.alias("session_key"), "file_path", "line_no", name.startswith(AGENT_PREFIX).alias("is_subagent"),
        *[_get("v", path, kind).alias(c) for c, path, kind in FIELDS], F.try_to_timestamp(_get("v", "$.timestamp", "string")).alias("ts"), F.col("line").alias("raw"),
    )


def blocks(e: DataFrame) -> DataFrame:
    """Content blocks of entries: a plain string counts as one text block."""
    kind = F.schema_of_variant("content")
    text = F.try_variant_get(F.col("content"), "$", "string")
    listed = F.try_variant_get(F.col("content"), "$", "array<variant>")
    rows = e.withColumn("is_text", kind == "STRING").withColumn("plain", text).withColumn("listed", F.when(kind.startswith("ARRAY"), listed))
    one = rows.filter("is_text").select(*_KEY, F.lit(0).alias("block_no"), F.lit("text").alias("block_type"), F.col("plain").alias("text"), *[F.lit(None).cast(t).alias(c) for c, _, t in _BLOCK])
    many = rows.filter("listed is not null").select(*_KEY, F.posexplode("listed").alias("block_no", "b"))
    many = many.select(*_KEY, "block_no", _get("b", "$.type", "string").alias("block_type"), _get("b", "$.text", "string").alias("text"), *[_get("b", path, t).alias(c) for c, path, t in _BLOCK], _get("b", "$.content", "array<variant>").alias("parts"))
    # a result may be a list of parts: its texts, one below the other
    texts = F.filter(F.transform("parts", lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull())
    many = many.withColumn("result_text", F.when((F.col("block_type") == "tool_result") & F.col("parts").isNotNull(), F.array_join(texts, "\n")).otherwise(F.col("result_text"))).drop("parts")
    return one.unionByName(many)


_KEY = ("session_key", "line_no", "uuid", "ts", "entry_type", "message_id")
_BLOCK = (
    ("thinking", "$.thinking", "string"), ("tool_use_id", "$.tool_use_id", "string"), ("call_id", "$.id", "string"), ("tool_name", "$.name", "string"), ("tool_input", "$.input", "variant"),
    ("result_text", "$.content", "string"), ("is_error", "$.is_error", "boolean"),
)
