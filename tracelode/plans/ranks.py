"""Ranks, medians and recursions whose shared SQL would order or gather everything in one task: here by ranges and grouped passes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import trees
from ..sources.tables import kept, load, ranked
from .catalogue import register
from .custom import _entries
from .dialect import expand, frame
from .texts import _redacted


def _duck(name: str, sql: str):
    return register(name, expand(sql, 1))


def _at_places(values: DataFrame, column: str, n: Column, places: dict[str, Column]) -> DataFrame:
    """One row of the values at the places (from 1) of their order; n is their number's column, and 0 of them make no row."""
    count = values.agg(F.count("*").alias("n"))
    r = ranked(values, column).crossJoin(F.broadcast(count))
    return r.agg(F.max("n").alias("n"), *[F.max(F.when(F.col("nr") == place, F.col(column))).alias(name) for name, place in places.items()]).filter("n > 0")


_RESPONSES = """select (next_t - t) / 1e6 as s from (select user_id, event_type, @us(ts) as t, lead(event_type) over (partition by user_id order by ts, event_id) as next_type, lead(@us(ts)) over (partition by user_id order by ts, event_id) as next_t from {events}) o
    where event_type = 'click' and next_type = 'view' and next_t > t and next_t - t < 3600000000"""


@_duck("A20_response_time", f"""with d as ({_RESPONSES}), l as (select @list(s) as x, count(*) as n, avg(s) as mean from d)
    select n, round(mean, 6) as mean_s, round(@at(x, 1), 6) as min_s, round(@at(x, n), 6) as max_s, round(@at(x, floor(n / 2) + 1), 6) as median_s, round(@at(x, floor(n * 0.95) + 1), 6) as p95_s from l where n > 0""")
def response_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = kept(frame(spark, sf_dir, _RESPONSES), "responses"), F.col("n")
    r = _at_places(d, "s", n, {"min_s": F.lit(1), "max_s": n, "median_s": F.floor(n / 2) + 1, "p95_s": F.floor(n * 0.95) + 1})
    return r.crossJoin(d.agg(F.round(F.avg("s"), 6).alias("mean_s"))).select("n", "mean_s", *[F.round(c, 6).alias(c) for c in ("min_s", "max_s", "median_s", "p95_s")])


@_duck(
    "A28_prompt_stats",
    """with p as (select text, length(text) as c from {conversations} where role = 'user'), u as (select text, count(*) as n from p group by text), l as (select @list(c) as x, count(*) as n, avg(c) as mean from p)
    select l.n as total, (select count(*) from u) as unique_texts, (select count(*) filter (where n > 1) from u) as reused, round(l.mean, 6) as mean_chars,
      @at(l.x, 1) as min_chars, @at(l.x, l.n) as max_chars, @at(l.x, floor(l.n / 2) + 1) as median_chars,
      (select count(*) filter (where c < 50) from p) as under_50, (select count(*) filter (where c >= 50 and c < 200) from p) as under_200, (select count(*) filter (where c >= 200) from p) as longer from l""",
)
def prompt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = frame(spark, sf_dir, "select text, length(text) as c from {conversations} where role = 'user'"), F.col("n")
    r = _at_places(p.filter("c is not null").select("c"), "c", n, {"min_chars": F.lit(1), "max_chars": n, "median_chars": F.floor(n / 2) + 1}).drop("n")
    texts = p.groupBy("text").agg(F.count("*").alias("k")).agg(F.count("*").alias("unique_texts"), F.count_if(F.col("k") > 1).alias("reused"))
    c = F.col("c")
    return p.agg(F.count("*").alias("total"), F.round(F.avg("c"), 6).alias("mean_chars"), F.count_if(c < 50).alias("under_50"), F.count_if((c >= 50) & (c < 200)).alias("under_200"), F.count_if(c >= 200).alias("longer")).crossJoin(texts).crossJoin(r)


def _rank(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with the rank of a value, the greatest first; equal values share it."""
    first = ranked(rows.select(by), F.desc(by)).groupBy(by).agg(F.min("nr").cast("int").alias(name))
    return rows.join(first, by)


@_duck("A29_hotspots", "select l_partkey as part, count(*) as changes, rank() over (order by count(*) desc) as rank_no from {lineitem} group by l_partkey")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("changes")), "changes", "rank_no").select("part", "changes", "rank_no")


@_duck("A34_error_prone", "select user_id, n, row_number() over (order by n desc, user_id) as rank_no from (select user_id, count(*) as n from {events} where event_type = 'error' group by user_id) x")
def error_prone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(frame(spark, sf_dir, "select user_id, count(*) as n from {events} where event_type = 'error' group by user_id"), F.desc("n"), "user_id", name="rank_no").select("user_id", "n", F.col("rank_no").cast("int").alias("rank_no"))


@_duck("K3_relevance", "select doc_id, hits, rank() over (order by hits desc) as rank_no from (select doc_id, @count_re(text, 'ing') as hits from {documents}) x where hits > 0")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(frame(spark, sf_dir, "select * from (select doc_id, @count_re(text, 'ing') as hits from {documents}) x where hits > 0"), "hits", "rank_no").select("doc_id", "hits", "rank_no")


@_duck("K5_strength", "select conv_id, turn, row_number() over (order by strength desc, conv_id, turn) as nr from (select conv_id, turn, length(text) % 10 as strength from {conversations} where role = 'user') x")
def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(frame(spark, sf_dir, "select conv_id, turn, length(text) % 10 as strength from {conversations} where role = 'user'"), F.desc("strength"), "conv_id", "turn").select("conv_id", "turn", F.col("nr").cast("int").alias("nr"))


@_duck("M15_thread_topic", "select conv_id, turn, role, row_number() over (order by conv_id, turn) as pos from {conversations} where @like_re(text, 'ment')")
def thread_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(frame(spark, sf_dir, "select conv_id, turn, role from {conversations} where @like_re(text, 'ment')"), "conv_id", "turn", name="pos").select("conv_id", "turn", "role", F.col("pos").cast("int").alias("pos"))


_PARTS = "select l_partkey as part, round(1.5e0 * count(distinct l_orderkey) + ln(count(*)), 6) as score from {lineitem} group by l_partkey having count(distinct l_orderkey) >= 3"


@_duck("M17_priorities", f"select part, score, row_number() over (order by score desc, part) as rank_no from ({_PARTS}) x")
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(frame(spark, sf_dir, _PARTS), F.desc("score"), "part", name="rank_no").select("part", "score", F.col("rank_no").cast("int").alias("rank_no"))


@_duck("turn_levels", "select conv_id, turn, dense_rank() over (order by turn) as level from {conversations}")
def turn_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    return c.join(ranked(c.select("turn").distinct(), "turn", name="level"), "turn").select("conv_id", "turn", F.col("level").cast("int").alias("level"))


@_duck("C7_anonymise", "select event_id, concat('session-', lpad(@text(dense_rank() over (order by user_id)), 4, '0')) as session_name, @us(date_trunc('hour', ts)) as hour_us from {events}")
def anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frame(spark, sf_dir, "select event_id, user_id, @us(date_trunc('hour', ts)) as hour_us from {events}")
    names = ranked(e.select("user_id").distinct(), "user_id").select("user_id", F.concat(F.lit("session-"), F.lpad(F.col("nr").cast("string"), 4, "0")).alias("session_name"))
    return e.join(names, "user_id").select("event_id", "session_name", "hour_us")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, id) as (key, part, nr, n, ids): the ids of each key of a batch, joined, and its number of rows, ids that are null included."""
    part, nr = TaskContext.get().partitionId(), 0
    for b in batches:
        by: dict[str | None, list[str | None]] = {}
        for key, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by.setdefault(key, []).append(i)
        if by:
            there = [[i for i in ids if i is not None] for ids in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([part] * len(by), pa.int64()), pa.array(range(nr, nr + len(by)), pa.int64()), pa.array([len(x) for x in by.values()], pa.int64()), pa.array([",".join(x) if x else None for x in there], pa.string())], names=["key", "part", "nr", "n", "ids"])
            nr += len(by)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, revision) of _joined() rows in order: a digest takes one piece after the other, so no key's ids are held."""
    out = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "n", "revision"])
    key, n, begun, digest = None, 0, False, None
    for b in batches:
        for new, more, ids in zip(*(b.column(c).to_pylist() for c in ("key", "n", "ids")), strict=True):
            if digest is None or new != key:
                if digest is not None:
                    yield out(key, n, digest.hexdigest())
                key, n, begun, digest = new, 0, False, hashlib.md5()
            n += more
            if ids is not None:
                digest.update((("," if begun else "") + ids).encode())
                begun = True
    if digest is not None:
        yield out(key, n, digest.hexdigest())


def revisions(rows: DataFrame) -> DataFrame:
    """(key, n, revision) of rows(key, id): MD5 of a key's ids in order, joined by commas. Ranges of keys and ids are sorted and joined in tasks of their own; only the joined pieces go to their key."""
    dealt = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    pieces = dealt.mapInArrow(_joined, "key string, part long, nr long, n long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "part", "nr").mapInArrow(_digests, "key string, n long, revision string")


@_duck("S37_revision", "select source, count(*) as n, @md5(@join(@list(@text(doc_id)), ',')) as revision from {documents} group by source")
def revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of a source's ids, whatever their order of arrival."""
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").cast("string").alias("id"))
    return revisions(d).withColumnRenamed("key", "source")


@_duck("turn_paths", "select conv_id, turn, @join(@list(lpad(@text(p), 3, '0')), '/') as path from (select c.conv_id, c.turn, q.turn as p from {conversations} c join {conversations} q on q.conv_id = c.conv_id and q.turn <= c.turn) x group by conv_id, turn")
def turn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(F.lpad(F.col("turn").cast("string"), 3, "0")).over(w), "/").alias("path"))


@_duck(
    "G4_depth",
    """with recursive t(conv_id, turn, depth) as (select conv_id, turn, 0 from {conversations} where turn = 0
    union all select c.conv_id, c.turn, t.depth + 1 from t join {conversations} c on c.conv_id = t.conv_id and c.turn = t.turn + 1)
    select conv_id, max(depth) as max_depth, count(*) as nodes from t group by conv_id""",
)
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the trees' grouped pass: a level isn't a join."""
    n = trees.nodes(*_entries(spark, sf_dir))
    return n.groupBy(F.col("session_key").cast("long").alias("conv_id")).agg(F.max("depth").alias("max_depth"), F.count("*").alias("nodes"))


@_duck(
    "G11_subtree",
    """with recursive t(conv_id, top, turn) as (select conv_id, turn, turn from {conversations} where role = 'user'
    union all select c.conv_id, t.top, c.turn from t join {conversations} c on c.conv_id = t.conv_id and c.turn = t.turn + 1)
    select conv_id, top, count(*) as size from t group by conv_id, top""",
)
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, b = _entries(spark, sf_dir)
    n = trees.nodes(e, b).join(e.filter("entry_type = 'user'").select("session_key", "uuid"), ["session_key", "uuid"])
    return n.select(F.col("session_key").cast("long").alias("conv_id"), (F.col("line_no") - 1).alias("top"), F.col("subtree_size").cast("long").alias("size"))


_SCORE = """n as (select doc_id, {} as len from {{documents}}), s as (select count(*) as docs, avg(len) as mean from n), f as (select term, count(*) as df from w group by term)
    select w.doc_id, round(sum(ln(1 + (s.docs - f.df + 0.5e0) / (f.df + 0.5e0)) * w.tf * 2.2e0 / (w.tf + 1.2e0 * (0.25e0 + 0.75e0 * n.len / s.mean))), 6) as score
    from w join f on w.term = f.term join n on w.doc_id = n.doc_id cross join s group by w.doc_id"""
_TERMS = "('license', 'license.', 'the', 'mit')"


@_duck("X9_bm25", f"with w as (select doc_id, term, count(*) as tf from (select doc_id, unnest(string_split(lower(text), ' ')) as term from {{documents}}) x where term in {_TERMS} group by doc_id, term), " + _SCORE.format("len(string_split(text, ' '))"))
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's length is the number of its spaces and one: it is split once."""
    w = f"select doc_id, term, count(*) as tf from (select doc_id, explode(split(lower(text), ' ')) as term from {{documents}}) x where term in {_TERMS} group by doc_id, term"
    return frame(spark, sf_dir, f"with w as ({w}), " + _SCORE.format("length(text) - length(replace(text, ' ')) + 1"))


@register("C4_redact", f"select doc_id, text from (select doc_id, text as raw, {_redacted(1)} as text from documents) x where raw <> text")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only texts that have what each kind needs are rewritten: a sign, a prefix, or digits about a hyphen or a point."""
    may = "contains(text, '@') or contains(text, 'ghp_') or contains(text, 'AKIA') or text rlike '[0-9][-.][0-9]'"
    return frame(spark, sf_dir, f"select doc_id, text from (select doc_id, text as raw, {_redacted(0)} as text from {{documents}} where {may}) x where raw <> text")
