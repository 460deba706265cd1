"""What entries say: visible texts, the prompts that people wrote, and which parts of a text are its own."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What begins texts that the harness writes in a user's name, and the words that mark decisions and the
# weighing of options.
NOISE = ("<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "<command-name>", "<system-reminder>", "<task-notification>", "[Request interrupted")
WEIGHING = (
    "alternatively", "or we could", "another approach", "another option", "we could also", "you could also", "versus", " vs ", " vs.", "trade-off", "tradeoff", "on the other hand", "the downside", "the upside",
    "compared to", "either way", "pros:", "cons:", "however,", "recommend", "i'd suggest", "i would suggest", "the best approach", "prefer",
)
DECIDED = ("we decided", "design decision", "the decision is", "final decision", "agreed to", "agreed that", "agreed on", "after discussion", "after considering")
BOTH = (("option a", "option b"), ("approach 1", "approach 2"), ("option 1", "option 2"), ("pros:", "cons:"), ("advantages", "disadvantages"))
#: Kinds of segments, the one that counts most first.
PRIMARY, QUOTED, INJECTED = "primary", "quoted", "injected"


def texts(blocks: DataFrame) -> DataFrame:
    """(session_key, line_no, uuid, entry_type, ts, text, thinking, tools, files, has_result, errors) of user and assistant entries.

    text is what one sees of an entry, null if nothing; tools are its calls' names in order, files the names of the
    files that it reads or writes, errors the results flagged as failed.
    """
    listed = lambda kind, c: F.transform(F.sort_array(F.collect_list(F.when(F.col("block_type") == kind, F.struct("block_no", c.alias("x"))))), lambda x: x["x"])
    told = F.coalesce(F.trim("text"), F.lit(""))
    path = F.when(F.col("tool_name").isin("Write", "Edit", "Read"), F.try_variant_get("tool_input", "$.file_path", "string"))
    b = blocks.filter("entry_type in ('user', 'assistant')").groupBy("session_key", "line_no", "uuid", "entry_type", "ts").agg(
        F.array_join(F.filter(listed("text", F.when(F.col("entry_type") == "user", told).otherwise(F.col("text"))), lambda x: x != ""), "\n").alias("text"),
        F.array_join(F.filter(listed("thinking", F.col("thinking")), lambda x: x.isNotNull()), "\n---\n").alias("thinking"), listed("tool_use", F.col("tool_name")).alias("tools"),
        F.sort_array(F.collect_set(F.when(F.col("block_type") == "tool_use", F.regexp_extract(path, r"([^/]+)/*$", 1)))).alias("files"),
        F.bool_or(F.col("block_type") == "tool_result").alias("has_result"), F.count_if((F.col("block_type") == "tool_result") & F.col("is_error")).alias("errors"),
    )
    return b.withColumns({"text": F.when(F.trim("text") != "", F.col("text")), "thinking": F.nullif("thinking", F.lit("")), "files": F.filter("files", lambda x: x != "")})


def noise(text: Column) -> Column:
    """Whether the harness wrote a text that stands as a user's."""
    t = F.trim(text)
    return F.reduce(F.array(*[t.startswith(x) for x in NOISE]), F.lit(False), lambda a, x: a | x)


def with_authors(entries: DataFrame, said: DataFrame) -> DataFrame:
    """texts() with human (a prompt that a person wrote), mid_turn, turn_id and injected (the harness wrote it).

    Where entries have an author (the second dialect), it says who wrote. Else a user's entry is a prompt unless it is
    meta, a compaction's summary, holds a tool's result, has no text, or its text is the harness'.
    """
    extra = [F.col(c) if c in entries.columns else F.lit(None).cast("string").alias(c) for c in ("author", "delivery", "turn_id")]
    e = entries.filter("uuid is not null").select("session_key", "line_no", "is_meta", "is_compact_summary", *extra)
    x = said.join(e, ["session_key", "line_no"])
    no = lambda c: ~F.coalesce(c, F.lit(False))
    plain = no(F.col("is_meta")) & no(F.col("is_compact_summary")) & ~F.col("has_result") & F.col("text").isNotNull() & ~F.coalesce(noise(F.col("text")), F.lit(False))
    human = (F.col("entry_type") == "user") & F.when(F.col("author").isNotNull(), F.col("author") == "human").otherwise(plain)
    injected = (F.col("entry_type") == "user") & (~plain | F.coalesce(F.col("author") == "harness", F.lit(False)))
    return x.withColumns({"human": human, "injected": injected, "mid_turn": F.coalesce(F.col("delivery") == "mid_turn", F.lit(False))}).drop("is_meta", "is_compact_summary", "author", "delivery")


def weighs_options(text: Column) -> Column:
    """Whether a text sets options against each other."""
    low = F.lower(text)
    weighing = F.reduce(F.array(*[low.contains(x) for x in WEIGHING]), F.lit(False), lambda a, x: a | x)
    pairs = F.reduce(F.array(*[low.contains(a) & low.contains(b) for a, b in BOTH]), F.lit(False), lambda a, x: a | x)
    numbers, bullets = F.regexp_count(text, F.lit(r"(?m)^\s*\d+[.)]\s+")), F.regexp_count(text, F.lit(r"(?m)^\s*[-*]\s+"))
    return F.coalesce(pairs | (numbers >= 3) | ((numbers >= 2) & weighing) | (bullets >= 4) | ((bullets >= 3) & weighing), F.lit(False))


def decides(text: Column) -> Column:
    """Whether a text looks like a point of decision."""
    low = F.lower(text)
    said = F.reduce(F.array(*[low.contains(x) for x in DECIDED]), F.lit(False), lambda a, x: a | x) | low.rlike("(?:we|they|team) decided to")
    return weighs_options(text) | F.coalesce(said, F.lit(False))


def markdown_segments(text: str | None) -> list[tuple[str, str]]:
    """(kind, text) of runs of lines: fenced code, its fences and lines that quote are quoted, the rest is the text's own. Empty runs are left out."""
    out: list[tuple[str, list[str]]] = []
    fence = None
    lines = (text or "").split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        line = line.removesuffix("\r")
        start = line.lstrip()
        mark = start[:3] if start[:3] in ("```", "~~~") else None
        kind = QUOTED if fence or mark or start.startswith(">") else PRIMARY
        if not out or out[-1][0] != kind:
            out.append((kind, []))
        out[-1][1].append(line)
        if mark:
            fence = mark if fence is None else None if fence == mark else fence
    joined = [(k, "\n".join(x)) for k, x in out]
    return [(k, x) for k, x in joined if x.strip()]


#: Texts whose segments are held as Python's values at once.
HELD = 256
_SEGMENTS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))


def _segments(texts: pa.Array) -> pa.Array:
    few = (texts.slice(i, HELD).to_pylist() for i in range(0, len(texts), HELD))
    made = [pa.array([[{"kind": k, "text": y} for k, y in markdown_segments(x)] for x in some], _SEGMENTS) for some in few]
    return pa.concat_arrays(made) if made else pa.array([], _SEGMENTS)


def segments(text: Column, injected: Column) -> Column:
    """The segments of an entry's text; what the harness wrote is injected as a whole."""
    whole = F.array(F.struct(F.lit(INJECTED).alias("kind"), text.alias("text")))
    return F.when(text.isNull(), F.array().cast("array<struct<kind:string,text:string>>")).when(injected, whole).otherwise(F.arrow_udf(_segments, "array<struct<kind:string,text:string>>")(text))
