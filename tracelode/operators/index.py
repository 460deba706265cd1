"""A search index of segments as Parquet tables, renewed session by session.

Each generation holds the segments of the sessions that changed, and a manifest of all sessions with the generation
that has theirs. A reader takes the newest manifest and joins it to the segments, so that what was replaced or
removed is not found, and a generation without a manifest, as an interrupted run leaves it, doesn't count.

Beside the segments stand their tokens (runs of letters and digits) and where each occurs. A plain literal lies within
one token, so the tokens that hold it name all segments that can; those with tokens that are long or not ASCII are
looked at in any case. Segments lie in shards by session, so that a search reads the shards of its candidates alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "session_key string, line_no long, block_no int, ts timestamp, kind string, text string, gen long, shard int"
POSTINGS = "token string, session_key string, line_no long, block_no int, gen long, shard int, bin int"
TOKENS = "token string, gen long, bin int"
KEY = ["gen", "shard", "session_key", "line_no", "block_no"]
#: Shards of sessions and bins of tokens; bytes from which on a token isn't listed; the token of segments that hold such.
SHARDS, BINS, LONG, ANY = 64, 64, 40, ""
#: Segments whose postings of a bin go to one task.
SLICE = 1_000_000
MANIFEST = "session_key string, fingerprint string, entries long, segments long, gen long, generation long"


def segments(blocks: DataFrame) -> DataFrame:
    """(session_key, line_no, block_no, ts, kind, text): what a search sees of each block."""
    kind = (
        F.when(F.col("block_type") == "text", F.concat("entry_type", F.lit("_text")))
        .when(F.col("block_type") == "thinking", F.lit("thinking")).when(F.col("block_type") == "tool_use", F.lit("tool_input")).when(F.col("block_type") == "tool_result", F.lit("tool_result"))
    )
    shown = F.coalesce("text", "thinking", F.to_json("tool_input"), "result_text")
    return blocks.select("session_key", "line_no", "block_no", "ts", kind.alias("kind"), shown.alias("text")).filter("kind is not null and text <> ''")


def manifest(entries: DataFrame) -> DataFrame:
    """(session_key, fingerprint, entries): a session's fingerprint follows from its lines, whatever their order of arrival."""
    h = F.xxhash64("line_no", "raw").cast("decimal(38,0)")
    return entries.groupBy("session_key").agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(h).cast("string")).alias("fingerprint"), F.count("*").alias("entries"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(session_key, change) between two manifests: added, changed, removed or same."""
    both = old.select("session_key", F.col("fingerprint").alias("was")).join(new.select("session_key", "fingerprint"), "session_key", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("fingerprint").isNull(), "removed").when(F.col("was") != F.col("fingerprint"), "changed").otherwise("same")
    return both.select("session_key", change.alias("change"))


def tokens_of(text: Column) -> Column:
    """The distinct tokens of a text, in lower case, with ANY in place of all that are long or not ASCII."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.when((F.octet_length(t) >= LONG) | (F.octet_length(t) > F.length(t)), F.lit(ANY)).otherwise(F.lower(t))))


def literal(pattern: str) -> str | None:
    """The pattern in lower case if it is a plain literal that lies within a token: three ASCII letters or digits at least."""
    return pattern.lower() if re.fullmatch(r"[A-Za-z0-9]{3,}", pattern) else None


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """The newest manifest."""
        m = self._read("manifest", MANIFEST)
        newest = m.agg(F.max("generation")).first()[0]
        return m.filter(F.col("generation") == newest) if newest is not None else m

    def update(self, entries: DataFrame, blocks: DataFrame) -> dict[str, int]:
        """Indexes the sessions that changed and forgets those that vanished; says how many of each. The manifest is written last."""
        old, new = self.current(), manifest(entries)
        generation = (self._read("manifest", MANIFEST).agg(F.max("generation")).first()[0] or 0) + 1
        change = changes(old, new)
        counts = {r[0]: r[1] for r in change.groupBy("change").count().collect()}
        fresh = change.filter("change in ('added', 'changed')").select("session_key")
        part = f"{self.path}/segments/gen={generation}"
        self._add(segments(blocks.join(fresh, "session_key", "left_semi")), generation)
        sizes = self.spark.read.parquet(part).groupBy("session_key").agg(F.count("*").alias("segments")) if counts.get("added") or counts.get("changed") else self.spark.createDataFrame([], "session_key string, segments long")
        renewed = new.join(fresh, "session_key", "left_semi").join(sizes, "session_key", "left").select("session_key", "fingerprint", "entries", F.coalesce("segments", F.lit(0)).alias("segments"), F.lit(generation).cast("long").alias("gen"))
        same = old.join(change.filter("change = 'same'"), "session_key", "left_semi").select(*renewed.columns)
        renewed.union(same).withColumn("generation", F.lit(generation).cast("long")).write.mode("append").parquet(f"{self.path}/manifest")
        return counts

    def _add(self, rows: DataFrame, generation: int) -> None:
        """Writes segments, their postings and the tokens of a generation. Ranges of sessions and lines are the files, so a large session is several."""
        part = lambda what: f"{self.path}/{what}/gen={generation}"
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("session_key"), F.lit(SHARDS)).cast("int"))
        order = ["shard", "session_key", "line_no", "block_no"]
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("shard").parquet(part("segments"))
        if not rows.sparkSession.read.schema("shard int").parquet(part("segments")).head(1):
            return
        listed = self.spark.read.schema(SEGMENTS.replace(", gen long", "")).parquet(part("segments"))
        listed = listed.select(F.explode(tokens_of(F.col("text"))).alias("token"), *KEY[1:]).withColumn("bin", F.pmod(F.xxhash64("token"), F.lit(BINS)).cast("int"))
        # dealt by bin and a slice of the lines, so a frequent token is split too; ranges would find all tokens once more to sample them
        n = self.spark.read.schema("line_no long").parquet(part("segments")).count()
        slice_ = F.pmod(F.xxhash64("session_key", "line_no"), F.lit(n // SLICE + 1))
        listed.repartition("bin", slice_).sortWithinPartitions("bin", "token", "session_key", "line_no").write.mode("overwrite").partitionBy("bin").parquet(part("postings"))
        # the postings stand sorted by token, so their distinct ones are found without going over the texts again
        posted = self.spark.read.schema("bin int, token string").parquet(part("postings"))
        posted.distinct().repartition("bin").write.mode("overwrite").partitionBy("bin").parquet(part("tokens"))

    def candidates(self, word: str) -> DataFrame:
        """The keys of all segments that may hold the literal. Tokens are searched for it, then the postings of those that have it; Spark prunes bins by the tokens found."""
        hit = self._read("tokens", TOKENS).filter(F.col("token").contains(word) | (F.col("token") == ANY))
        posted = self._read("postings", POSTINGS)
        return posted.join(hit, ["gen", "bin", "token"], "left_semi").select(*KEY).distinct()

    def search(self, pattern: str, kinds: tuple[str, ...] | None = None, ignore_case: bool = False) -> DataFrame:
        """Segments of the current sessions that the pattern matches. Where it is a plain literal, only the shards of its candidates are read; the pattern itself decides in any case."""
        s, word = self._read("segments", SEGMENTS), literal(pattern)
        if word is not None:
            s = s.join(self.candidates(word), KEY, "left_semi")
        s = s.filter(F.col("text").rlike("(?i)" + pattern if ignore_case else pattern))
        s = s.filter(F.col("kind").isin(*kinds)) if kinds else s
        return s.join(self.current().select("session_key", "gen"), ["session_key", "gen"], "left_semi").drop("gen", "shard")

    def narrowed(self, word: str) -> DataFrame:
        """One row: segments in all, candidates of a literal, and how many of these only because of a long or non-ASCII token."""
        hit = self._read("tokens", TOKENS).filter(F.col("token").contains(word) | (F.col("token") == ANY))
        posted = self._read("postings", POSTINGS).join(hit, ["gen", "bin", "token"], "left_semi")
        live = self.current().select("session_key", "gen")
        found = posted.groupBy(*KEY).agg(F.bool_or(F.col("token") != ANY).alias("sure")).join(live, ["session_key", "gen"], "left_semi")
        count = self._read("segments", SEGMENTS).join(live, ["session_key", "gen"], "left_semi").agg(F.count("*").alias("segments"))
        return count.crossJoin(found.agg(F.count("*").alias("candidates"), F.count_if(~F.col("sure")).alias("fallback")))

    def compact(self) -> int:
        """Writes the current sessions' segments as one generation and removes the others; says how many generations went. Readers that started before have to start again."""
        now = self.current()
        generation = (self._read("manifest", MANIFEST).agg(F.max("generation")).first()[0] or 0) + 1
        kept = self._read("segments", SEGMENTS).join(now.select("session_key", "gen"), ["session_key", "gen"], "left_semi").drop("gen", "shard")
        self._add(kept, generation)
        now.withColumns({"gen": F.lit(generation).cast("long"), "generation": F.lit(generation).cast("long")}).write.mode("append").parquet(f"{self.path}/manifest")
        gone = 0
        for what in ("segments", "postings", "tokens"):
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
            system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not system.exists(root):
                continue
            for f in system.listStatus(root):
                if f.getPath().getName().startswith("gen=") and int(f.getPath().getName()[4:]) < generation:
                    system.delete(f.getPath(), True)
                    gone += what == "segments"
        return gone

    def coverage(self, entries: DataFrame) -> DataFrame:
        """How many of the sessions the index has as they are now, and how many are stale or missing."""
        c = changes(self.current(), manifest(entries))
        return c.agg(*[F.count_if(F.col("change") == k).alias(n) for k, n in (("same", "covered"), ("changed", "stale"), ("added", "missing"), ("removed", "vanished"))])
