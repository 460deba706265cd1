"""Requests over the canonical tables, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import history, lessons, prompts, threads, trees, usage, validation


@dataclass
class Logs:
    """The canonical tables that requests read."""

    entries: DataFrame
    blocks: DataFrame

    def list_sessions(self, contains: str | None = None, since=None, limit: int = 50) -> DataFrame:
        s = usage.sessions(self.entries)
        if contains:
            s = s.filter(F.contains(F.lower("cwd"), F.lit(contains.lower())))
        if since is not None:
            s = s.filter(F.col("end_ts") >= F.lit(since))
        return s.orderBy(F.desc_nulls_last("end_ts"), "session_key").limit(limit) if limit else s

    def session(self, key: str) -> Logs:
        return Logs(self.entries.filter(F.col("session_key") == key), self.blocks.filter(F.col("session_key") == key))

    def stats(self, *by: str) -> DataFrame:
        return usage.token_totals(usage.turns(self.entries), *by)

    def messages(self, offset: int = 0, limit: int = 50, reverse: bool = False) -> DataFrame:
        texts = self.blocks.filter("block_type = 'text' and entry_type in ('user', 'assistant')")
        order = [F.desc("line_no"), F.desc("block_no")] if reverse else ["line_no", "block_no"]
        return texts.select("session_key", "line_no", "block_no", "entry_type", "text", "ts").orderBy("session_key", *order).offset(offset).limit(limit)

    def search(self, pattern: str, limit: int = 100) -> DataFrame:
        """Lines of visible text that the pattern matches, one row a line, newest first."""
        line = self.blocks.filter("block_type = 'text'").select("session_key", "uuid", "line_no", "ts", "entry_type", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        return line.filter(F.col("line").rlike(pattern)).orderBy(F.desc_nulls_last("ts"), "session_key", "line_no", "at").limit(limit)

    def tool_calls(self, name: str | None = None, failed_only: bool = False) -> DataFrame:
        c = usage.tool_calls(self.blocks)
        c = c.filter(F.lower("tool_name") == name.lower()) if name else c
        return c.filter("failed") if failed_only else c

    def forest(self) -> DataFrame:
        return trees.nodes(self.entries, self.blocks)

    def main(self) -> DataFrame:
        return threads.main_thread(self.forest(), self.entries, self.blocks)

    def timeline(self, limit: int = 30) -> DataFrame:
        """The first rows of each session's timeline."""
        t = threads.timeline(threads.turns(self.main()))
        return t.withColumn("nr", F.row_number().over(Window.partitionBy("session_key").orderBy("turn"))).filter(F.col("nr") <= limit).drop("nr")

    def topic(self, pattern: str, **options) -> DataFrame:
        return threads.topic(self.main(), pattern, **options)

    def chunks(self) -> DataFrame:
        """A row for each prompt's chunk."""
        said = prompts.texts(self.blocks)
        human = prompts.with_authors(self.entries, said).filter("human and not mid_turn").select("session_key", "uuid")
        return threads.chunk_summary(threads.chunks(self.forest(), human, self.entries), said)

    def tree(self) -> DataFrame:
        """(session_key, dfs_pos, line): each session's tree as indented lines; a star marks the main thread."""
        n = self.forest().join(prompts.texts(self.blocks).select("session_key", "uuid", "line_no", "text"), ["session_key", "uuid", "line_no"], "left").join(self.entries.select("session_key", "line_no", "entry_type"), ["session_key", "line_no"])
        line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("is_main"), "* ").otherwise("- "), F.substring("uuid", 1, 8), F.lit(" "), "entry_type", F.coalesce(F.concat(F.lit(": "), text.truncated(F.regexp_replace("text", r"\s+", " "), 60)), F.lit("")))
        return n.select("session_key", "dfs_pos", line.alias("line")).orderBy("session_key", "dfs_pos")

    def entry(self, uuid_prefix: str) -> DataFrame:
        """Entries whose id begins so, as they were read."""
        return self.entries.filter(F.col("uuid").startswith(uuid_prefix)).select("session_key", "line_no", "uuid", "entry_type", "ts", "raw")

    def file_evolution(self, pattern: str, context: int = 1) -> DataFrame:
        """Changes of files whose path holds the pattern, by snapshots, with what was said around each."""
        raw = self.entries.select("file_path", "line_no", F.col("raw").alias("line"))
        said = prompts.with_authors(self.entries, prompts.texts(self.blocks))
        return history.evolution(history.file_history(history.snapshots(raw)), said, context=context, pattern=pattern).orderBy("path", F.asc_nulls_last("at"), "session_key")

    def validation(self, parsed: DataFrame) -> DataFrame:
        """The verdict on each session; parsed are the lines that the entries came from."""
        return validation.report(validation.findings(parsed, self.entries, self.blocks), self.entries)

    def lessons(self) -> DataFrame:
        """Failed calls with the answer after each."""
        return lessons.error_fixes(self.entries, self.blocks)

    def corrections(self) -> DataFrame:
        """User texts that correct, the strongest first."""
        human = prompts.with_authors(self.entries, prompts.texts(self.blocks)).filter("human").select("session_key", "line_no")
        return lessons.corrections(self.blocks, human).orderBy(F.desc("strength"), "session_key", "line_no")

    def file_history(self, path: str | None = None) -> DataFrame:
        """Files that calls wrote, with their sessions and whether the call held."""
        p = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.notebook_path"))
        c = usage.tool_calls(self.blocks).filter(F.lower("tool_name").isin("write", "edit", "multiedit", "notebookedit")).withColumn("path", p).filter("path is not null")
        c = c.filter(F.col("path") == path) if path else c
        return c.groupBy("path", "session_key").agg(F.count("*").alias("attempts"), F.count_if(~F.coalesce("failed", F.lit(False))).alias("applied"), F.max("ts").alias("last_ts"))

    def health(self) -> DataFrame:
        """Files by how many sessions changed them, and how often."""
        return self.file_history().groupBy("path").agg(F.count("*").alias("sessions"), F.sum("applied").alias("changes")).orderBy(F.desc("sessions"), F.desc("changes"), "path")

    def priorities(self, top: int = 10) -> DataFrame:
        """Files worth a look, by rework and versions."""
        score = 1.5 * F.col("sessions") + F.log(F.greatest(F.col("changes"), F.lit(1)))
        w = Window.orderBy(F.desc("score"), "path")
        ranked = self.health().filter("sessions >= 3").withColumn("score", score).orderBy(F.desc("score"), "path").limit(top)
        return ranked.withColumn("rank", F.row_number().over(w))

    def context(self, uuid_prefix: str, around: int = 5) -> DataFrame:
        """Entries around the one whose id begins so, in its session."""
        hit = self.entries.filter(F.col("uuid").startswith(uuid_prefix)).select("session_key", F.col("line_no").alias("at")).limit(1)
        near = self.entries.join(F.broadcast(hit), "session_key").filter(F.abs(F.col("line_no") - F.col("at")) <= around)
        return near.select("session_key", "line_no", "uuid", "entry_type", (F.col("line_no") - F.col("at")).alias("place"))
