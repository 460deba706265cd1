"""What lies around the logs: projects and session files, the side index, configuration, and compressed files within bounds."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a compressed file: its own bytes, those that it holds, and the window that its frames may ask for.
MAX_IN, MAX_OUT, MAX_WINDOW = 256 << 20, 2 << 30, 1 << 27
_FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files below root whose names fit; contents are read only where they are used. Spark lists no empty files, and a folder that isn't there holds none."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _FILES)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """(project, session_key, path, is_subagent, dir_parent, compressed, modified, bytes) of the session files below root/projects.

    A project is the folder under projects. A subagent's file lies in <session>/subagents, or has the prefix of its
    name alone, and then no parent by folder.
    """
    f = files(spark, f"{root}/projects", "*.jsonl*").select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    inner = F.regexp_extract("path", r"/projects/(.+)$", 1)
    name = F.regexp_extract("path", r"([^/]+?)\.jsonl(?:\.zst)?$", 1)
    return f.filter(F.col("path").rlike(r"\.jsonl(\.zst)?$")).select(
        F.substring_index(inner, "/", 1).alias("project"), name.alias("session_key"), "path", (name.startswith("agent-") | F.col("path").contains("/subagents/")).alias("is_subagent"),
        F.nullif(F.regexp_extract(inner, r"([^/]+)/subagents/", 1), F.lit("")).alias("dir_parent"), F.col("path").endswith(".zst").alias("compressed"), "modified", "bytes",
    )


def encoded(path: Column) -> Column:
    """A folder's path as the name of its project: separators, dots, underscores and colons become hyphens."""
    return F.regexp_replace(path, r"[\\/:._]", "-")


def decoded(name: Column) -> Column:
    """The path that a project's name most plainly stands for: hyphens are separators but for %2D, and a drive letter comes first."""
    held = F.replace(name, F.lit("%2D"), F.lit("\u0001"))
    drive = F.regexp_extract(held, r"^([A-Za-z])-(?=-|$)", 1)
    rest = F.when(drive != "", F.substring(held, F.lit(3), F.length(held))).otherwise(held)
    return F.replace(F.concat(F.when(drive != "", F.concat(drive, F.lit(":"))).otherwise(F.lit("")), F.replace(rest, F.lit("-"), F.lit("/"))), F.lit("\u0001"), F.lit("-"))


def projects(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(project, path, sessions, subagents, bytes, modified): the projects of sessions() with the folder that their entries name.

    A name stands for several paths; of the folders that the project's own entries were in and whose name it is, the
    most frequent counts (of equal ones the first by code point), else the plainest reading of the name.
    """
    cwd = entries.filter("cwd is not null").groupBy("session_key", "cwd").agg(F.count("*").alias("n"))
    # hyphens of a path stay hyphens or are written as %2D
    named = found.select("project", "session_key").distinct().join(cwd, "session_key").filter(F.replace("project", F.lit("%2D"), F.lit("-")) == encoded(F.col("cwd"))).groupBy("project", "cwd").agg(F.sum("n").alias("n"))
    best = named.groupBy("project").agg(F.min(F.struct((-F.col("n")).alias("n"), "cwd"))["cwd"].alias("cwd"))
    p = found.groupBy("project").agg(F.count_if(~F.col("is_subagent")).alias("sessions"), F.count_if("is_subagent").alias("subagents"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))
    return p.join(best, "project", "left").select("project", F.coalesce("cwd", decoded(F.col("project"))).alias("path"), "sessions", "subagents", "bytes", "modified")


def windows_to_wsl(path: Column) -> Column:
    """A path with a drive letter below /mnt, with slashes."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.substring(path, 2, 1) == ":", F.concat(F.lit("/mnt/"), F.lower(F.substring(path, 1, 1)), F.substring(slashed, F.lit(3), F.length(slashed)))).otherwise(slashed)


def wsl_to_windows(path: Column) -> Column:
    """The other way; null for paths that aren't below /mnt."""
    rest = F.regexp_extract(path, r"^/mnt/(.{2,})$", 1)
    return F.when(rest != "", F.concat(F.upper(F.substring(rest, 1, 1)), F.lit(":"), F.replace(F.substring(rest, F.lit(2), F.length(rest)), F.lit("/"), F.lit("\\"))))


INDEX = "entries array<struct<sessionId:string,fullPath:string,fileMtime:long,firstPrompt:string,summary:string,messageCount:long,created:string,modified:string,gitBranch:string,projectPath:string,isSidechain:boolean>>"


def side_index(spark: SparkSession, root: str) -> DataFrame:
    """(project, session_key, path, modified, first_prompt, summary, messages, created, branch, cwd, is_sidechain) of all sessions-index.json; of a session named twice the last entry counts, and an index that is no JSON is empty."""
    f = files(spark, f"{root}/projects", "sessions-index.json").select(F.regexp_extract("path", r"/projects/([^/]+)/", 1).alias("project"), F.from_json(F.col("content").cast("string"), INDEX)["entries"].alias("e"))
    x = f.select("project", F.posexplode("e").alias("at", "x")).groupBy("project", F.col("x.sessionId").alias("session_key")).agg(F.max_by("x", "at").alias("x")).filter("session_key is not null")
    return x.select(
        "project", "session_key", F.col("x.fullPath").alias("path"), F.timestamp_millis(F.col("x.fileMtime")).alias("modified"), F.col("x.firstPrompt").alias("first_prompt"), F.col("x.summary").alias("summary"), F.col("x.messageCount").alias("messages"),
        F.try_to_timestamp("x.created").alias("created"), F.col("x.gitBranch").alias("branch"), F.col("x.projectPath").alias("cwd"), F.coalesce("x.isSidechain", F.lit(False)).alias("is_sidechain"),
    )


def _front(key: str) -> Column:
    head = F.regexp_extract("text", r"(?s)^\s*---(.*?)---", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^\s*{key}\s*:\s*(.*?)\s*$", 1), r"""^["']|["']$""", "")), F.lit(""))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(kind, name, path, description, priority, active, text) of the configuration below a folder.

    Kinds are settings, servers, command, rule, style, instructions (a page whose name is in capitals) and credentials, of
    which only that they are there is told. Front matter gives description, priority and active; without one the
    first line that says something describes a command or a rule. Settings and servers have their JSON as text. Spark
    lists no names that begin with a dot below root; has_credentials() looks for those of credentials.
    """
    f = files(spark, root)
    inner = F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)
    kind = (
        F.when(F.col("path").rlike(r"/settings(\.local)?\.json$"), "settings").when(F.col("path").rlike(r"/\.?mcp\.json$"), "servers").when(F.col("path").rlike(r"/commands/.*\.md$"), "command").when(F.col("path").rlike(r"/rules/.*\.md$"), "rule")
        .when(F.col("path").rlike(r"/output-styles/.*\.md$"), "style").when(F.col("path").rlike(r"/[A-Z]+\.md$"), "instructions").when(F.col("path").rlike(r"/\.?credentials\.json$"), "credentials")
    )
    s = f.withColumn("kind", kind).filter("kind is not null").select("kind", inner.alias("name"), "path", F.when(F.col("kind") != "credentials", F.col("content").cast("string")).alias("text"))
    body = F.regexp_replace("text", r"(?s)^\s*---.*?---\s*", "")
    first = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(body, r"(?m)^(\s*[^\s].*)$", 1), r"^\s*#+\s*", "")), F.lit(""))
    told = F.col("kind").isin("command", "rule", "style")
    return s.select(
        "kind", "name", "path", F.when(told, F.coalesce(_front("description"), first)).alias("description"), F.when(told, F.coalesce(_front("priority").try_cast("int"), F.lit(0))).alias("priority"),
        F.when(told, F.coalesce(F.lower(_front("active")) != "false", F.lit(True))).alias("active"), F.when(told, body).otherwise(F.col("text")).alias("text"),
    )


def has_credentials(spark: SparkSession, root: str) -> bool:
    """Whether a file of credentials lies in root; it isn't opened."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}") for name in (".credentials.json", "credentials.json")]
    return any(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def servers(configured: DataFrame) -> DataFrame:
    """(path, server, command, url) of the servers that sidecars() lists."""
    s = configured.filter("kind = 'servers'").select("path", F.explode(F.from_json(F.get_json_object("text", "$.mcpServers"), "map<string,struct<command:string,url:string>>")).alias("server", "x"))
    return s.select("path", "server", "x.command", "x.url")


def hooks(configured: DataFrame) -> DataFrame:
    """(path, event, matcher, command) of the hooks in settings."""
    s = configured.filter("kind = 'settings'").select("path", F.explode(F.from_json(F.get_json_object("text", "$.hooks"), "map<string,array<struct<matcher:string,hooks:array<struct<type:string,command:string>>>>>")).alias("event", "x"))
    s = s.select("path", "event", F.explode("x").alias("h")).select("path", "event", "h.matcher", F.explode("h.hooks").alias("c"))
    return s.select("path", "event", "matcher", "c.command")


LINES = "file_path string, line_no long, line string, refused string"


def compressed_lines(spark: SparkSession, root: str, max_in: int = MAX_IN, max_out: int = MAX_OUT, max_window: int = MAX_WINDOW) -> DataFrame:
    """(file_path, line_no, line, refused) of Zstandard files below root, read in a stream within bounds.

    A file that is larger than max_in isn't opened; one that holds more than max_out, asks for a larger window or is
    broken ends with a row that says so and has no line: what came before it stands.
    """
    f = files(spark, root, "*.jsonl.zst")
    large = f.filter(F.col("length") > max_in).select(F.col("path").alias("file_path"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit("compressed size").alias("refused"))

    def lines(content: bytes) -> Iterator[tuple[int | None, str | None, str | None]]:
        import zstandard

        n = size = 0
        try:
            with zstandard.ZstdDecompressor(max_window_size=max_window).stream_reader(io.BytesIO(content), read_across_frames=True) as stream:
                rest = b""
                while block := stream.read(1 << 20):
                    size += len(block)
                    if size > max_out:
                        yield None, None, "decompressed size"
                        return
                    parts = (rest + block).split(b"\n")
                    rest = parts.pop()
                    for p in parts:
                        n += 1
                        yield n, p.decode("utf-8", "replace"), None
                if rest:
                    yield n + 1, rest.decode("utf-8", "replace"), None
        except zstandard.ZstdError as e:
            yield None, None, f"not readable: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for row in lines(content):
                    rows.append((path, *row))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file_path", "line_no", "line", "refused"]).astype({"line_no": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=["file_path", "line_no", "line", "refused"]).astype({"line_no": "Int64"})

    # a file is one row, so few are handed over at a time
    small = f.filter(F.col("length") <= max_in).select("path", "content")
    return small.mapInPandas(run, LINES).unionByName(large)
