"""The second log dialect: lines of {timestamp, type, payload}, their counters and the patches of their calls.

Older files of bare items are recognised and refused. envelope.py brings the records to canonical entries and blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jsonl import parsed

#: Types of the envelope.
ENVELOPE = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def records(raw: DataFrame) -> DataFrame:
    """Parsed lines with session_key, record type, kind of the payload, payload time and dialect: envelope, legacy or unknown, told by each file's first line."""
    p = parsed(raw).filter("status = 'parsed'")
    r = p.select("file_path", "line_no", "line", "v", _get("$.type").alias("type"), _get("$.payload.type").alias("kind"), F.try_to_timestamp(_get("$.timestamp")).alias("ts"))
    shape = F.when(F.col("type").isin(*ENVELOPE) & _get("$.payload", "variant").isNotNull(), F.lit("envelope")).when(_get("$.id").isNotNull() | _get("$.record_type").isNotNull() | F.col("type").isNotNull(), F.lit("legacy")).otherwise(F.lit("unknown"))
    first = r.withColumn("shape", shape).groupBy("file_path").agg(F.min_by("shape", "line_no").alias("dialect"), F.max(F.when(F.col("type") == "session_meta", _get("$.payload.id"))).alias("session_id"))
    name = F.regexp_extract("file_path", r"([^/]+?)(\.jsonl)?(\.zst)?$", 1)
    return r.join(first, "file_path").withColumn("session_key", F.coalesce("session_id", name))


def inventory(r: DataFrame) -> DataFrame:
    """A row for each file: dialect, records, first and last time, and the session that it forked from."""
    return r.groupBy("file_path", "session_key", "dialect").agg(
        F.count("*").alias("records"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max(_get("$.payload.forked_from_id")).alias("forked_from"), F.max(_get("$.payload.cwd")).alias("cwd")
    )


def token_counts(r: DataFrame) -> DataFrame:
    """(session_key, line_no, ts, input, output, cached): the cumulative counters of the token events."""
    t = r.filter("dialect = 'envelope' and type = 'event_msg' and kind = 'token_count'")
    total = lambda c: _get(f"$.payload.info.total_token_usage.{c}", "bigint")
    return t.select("session_key", "line_no", "ts", total("input_tokens").alias("input"), total("output_tokens").alias("output"), F.coalesce(total("cached_input_tokens"), F.lit(0)).alias("cached")).filter("input is not null and output is not null")


def usage_epochs(counts: DataFrame) -> DataFrame:
    """counts(session_key, line_no, input, output, cached) with epoch, and what each adds: fresh (input that no cache served), output and cached tokens.

    The counters are cumulative. Where input or output falls a new epoch begins, and counts from zero. More cached
    than new input without a reset is ambiguous and adds no fresh tokens.
    """
    w = Window.partitionBy("session_key").orderBy("line_no")
    before = {c: F.lag(c).over(w) for c in ("input", "output", "cached")}
    c = counts.withColumns({f"was_{k}": v for k, v in before.items()})
    reset = F.col("was_input").isNull() | (F.col("input") < F.col("was_input")) | (F.col("output") < F.col("was_output"))
    c = c.withColumn("reset", reset)
    added = {k: F.when(F.col("reset"), F.col(k)).otherwise(F.col(k) - F.col(f"was_{k}")) for k in before}
    c = c.withColumns({f"more_{k}": v for k, v in added.items()}).withColumn("epoch", F.sum(F.col("reset").cast("int")).over(w))
    fresh = F.col("more_input") - F.col("more_cached")
    return c.select(*counts.columns, "epoch", F.greatest(fresh, F.lit(0)).alias("fresh"), F.col("more_output").alias("added_output"), F.greatest("more_cached", F.lit(0)).alias("added_cached"), (fresh < 0).alias("ambiguous"))


def patch_changes(patch: str) -> tuple[list[tuple[str, str, str | None, str | None]], int]:
    """((kind, path, moved to, body) of a patch's sections, and how many parts of it can't be read)."""
    lines = [x.rstrip("\r") for x in patch.rstrip("\r\n").split("\n")]
    if len(lines) < 2 or lines[0] != "*** Begin Patch" or lines[-1] != "*** End Patch":
        return [], 1
    sections: list[tuple[str, str, list[str]]] = []
    bad = 0
    for line in lines[1:-1]:
        head = next((k for k in ("Add", "Delete", "Update") if line.startswith(f"*** {k} File:")), None)
        if head:
            sections.append((head.lower(), line.partition(":")[2].strip(), []))
        elif sections:
            sections[-1][2].append(line)
        else:
            bad += 1
    out = []
    for kind, path, body in sections:
        if not path:
            bad += 1
            continue
        moved = None
        if kind == "update" and body and body[0].startswith("*** Move to:"):
            moved, body = body[0].partition(":")[2].strip() or None, body[1:]
        whole = None
        if kind == "add":
            if all(x.startswith("+") for x in body):
                whole = "".join(x[1:] + "\n" for x in body)
            else:
                bad += 1
        elif kind == "update":
            whole = "\n".join(body)
        elif body:
            bad += 1
        out.append((kind, path, moved, whole))
    return out, bad


CHANGES = "session_key string, call_id string, nr int, kind string, path string, moved_to string, body string, unparsed int"


def declared_changes(calls: DataFrame) -> DataFrame:
    """CHANGES of calls(session_key, call_id, patch): a row for each file that a patch names, or one of nr -1 that only says how much of it couldn't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHANGES.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        for b in batches:
            rows = []
            for key, call, patch in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found, bad = patch_changes(patch or "")
                rows += [(key, call, i, *x, bad) for i, x in enumerate(found)] or [(key, call, -1, None, None, None, None, bad)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return calls.select("session_key", "call_id", "patch").mapInArrow(run, CHANGES)
