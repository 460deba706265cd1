"""Queries that run the engine's operators over canonical tables made of the driver's, each beside SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, lessons, lineage, trees, usage
from ..sources import rollouts
from ..sources.tables import load
from .catalogue import register


def _branching(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as trees: each turn answers the one at half its number, so that every node has up to two children."""
    key = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    e = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_key"), (F.col("turn") + 1).alias("line_no"), key(F.col("turn")).alias("uuid"), F.when(F.col("turn") > 0, key(F.expr("(turn - 1) div 2"))).alias("parent_uuid"),
        F.lit(None).cast("string").alias("logical_parent_uuid"), F.col("role").alias("entry_type"), F.timestamp_seconds("turn").alias("ts"), F.col("text").alias("raw"),
    )
    return e, e.select("session_key", "line_no", "entry_type", F.lit("text").alias("block_type"))


_TREE = """with recursive t(conv_id, turn, depth, path) as (select conv_id, turn, 0, [turn] from conversations where turn = 0
  union all select c.conv_id, c.turn, t.depth + 1, list_append(t.path, c.turn) from t join conversations c on c.conv_id = t.conv_id and c.turn > 0 and (c.turn - 1) // 2 = t.turn)"""


@register("G9_traversal", _TREE + " select cast(conv_id as varchar) as session_key, concat(conv_id, '/', turn) as uuid, row_number() over (partition by conv_id order by path) - 1 as dfs_pos, row_number() over (partition by conv_id order by depth, turn) - 1 as bfs_pos from t")
def traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trees.nodes(*_branching(spark, sf_dir))
    return n.select("session_key", "uuid", F.col("dfs_pos").cast("long").alias("dfs_pos"), F.col("bfs_pos").cast("long").alias("bfs_pos"))


@register("G5_branch_points", "select cast(conv_id as varchar) as session_key, concat(conv_id, '/', (turn - 1) // 2) as uuid, count(*) as children from conversations where turn > 0 group by conv_id, (turn - 1) // 2 having count(*) > 1")
def branch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.nodes(*_branching(spark, sf_dir)).filter("n_children > 1").select("session_key", "uuid", F.col("n_children").cast("long").alias("children"))


@register("G10_leaf_paths", _TREE + " select cast(conv_id as varchar) as session_key, concat(conv_id, '/', turn) as uuid, array_to_string(path, '>') as path from t where not exists (select 1 from conversations c where c.conv_id = t.conv_id and c.turn > 0 and (c.turn - 1) // 2 = t.turn)")
def leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trees.nodes(*_branching(spark, sf_dir))
    p = trees.paths(n, n.filter("is_leaf"))
    return p.select("session_key", "uuid", F.array_join(F.transform("path", lambda x: F.element_at(F.split(x, "/"), 2)), ">").alias("path"))


@register(
    "G21_lineage_units",
    """with recursive n as (select distinct conv_id from conversations where conv_id not in (select conv_id from conversations where role = 'system')),
    t(conv_id, root, depth) as (select conv_id, conv_id, 0 from n where conv_id // 3 not in (select conv_id from n) or conv_id // 3 = conv_id
      union all select n.conv_id, t.root, t.depth + 1 from t join n on n.conv_id // 3 = t.conv_id and n.conv_id <> t.conv_id)
    select cast(conv_id as varchar) as session_key, cast(root as varchar) as root, cast(depth as bigint) as depth from t""",
)
def lineage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation continues that of a third of its number; those with a system turn are spawned."""
    c = load(spark, sf_dir, "conversations")
    key = lambda x: x.cast("string")
    more = c.select(key(F.col("conv_id")).alias("child"), key(F.expr("conv_id div 3")).alias("parent"), F.lit("continuation").alias("kind")).distinct()
    spawn = c.filter("role = 'system'").select(key(F.col("conv_id")).alias("child"), F.lit("x").alias("parent"), F.lit("spawn").alias("kind")).distinct()
    return lineage.units(more.union(spawn), c.select(key(F.col("conv_id")).alias("session_key")))


@register(
    "S28_copied_prefix",
    """with r as (select conv_id, turn, role from conversations),
    b as (select c.conv_id as child, c.turn, coalesce(c.role = p.role, false) as same from r c left join r p on p.conv_id = c.conv_id - 1 and p.turn = c.turn - 1 where c.turn >= 1)
    select child, child - 1 as parent, coalesce(min(case when not same then turn end) - 1, max(turn)) as copied from b group by child""",
)
def copied_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a fork of the one before it, by the roles of their turns."""
    c = load(spark, sf_dir, "conversations")
    records = c.select(F.col("conv_id").alias("session_key"), F.col("turn").alias("pos"), F.col("role").alias("digest"))
    forks = c.select(F.col("conv_id").alias("child"), (F.col("conv_id") - 1).alias("parent")).distinct()
    return lineage.copied_prefix(forks, records)


@register(
    "J8_spawn_links",
    """with c as (select user_id, event_id, cast(json_extract_string(props, '$.k') as int) as k from events where event_type = 'click'),
    l as (select user_id, event_id as agent, cast(json_extract_string(props, '$.k') as int) as k, event_id - 1 as target from events where event_type = 'view'),
    one as (select c.user_id, c.event_id, l.agent from c join l on l.user_id = c.user_id and l.target = c.event_id),
    oc as (select * from c where event_id not in (select event_id from one)), ol as (select * from l where agent not in (select agent from one)),
    s as (select user_id, k, min(agent) as agent from ol group by user_id, k having count(*) = 1),
    two as (select f.user_id, f.event_id, s.agent from (select user_id, k, min(event_id) as event_id from oc group by user_id, k) f join s on s.user_id = f.user_id and s.k = f.k),
    lc as (select user_id, min(event_id) as event_id from oc where event_id not in (select event_id from two) group by user_id having count(*) = 1),
    ll as (select user_id, min(agent) as agent from ol where agent not in (select agent from two) group by user_id having count(*) = 1),
    m as (select *, 'id' as how from one union all select *, 'description' from two union all select lc.user_id, lc.event_id, ll.agent, 'only' from lc join ll on lc.user_id = ll.user_id)
    select cast(user_id as varchar) as session_key, cast(event_id as varchar) as call_id, cast(agent as varchar) as agent_key, how from m
    union all select cast(user_id as varchar), null, cast(agent as varchar), 'none' from l where agent not in (select agent from m)""",
)
def spawn_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls and views as subagents; a view names the event before it, and both are described by k."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    text = lambda c: F.col(c).cast("string")
    calls = e.filter("event_type = 'click'").select(text("user_id").alias("session_key"), text("event_id").alias("call_id"), F.col("event_id").alias("nr"), F.col("k").alias("description"))
    links = e.filter("event_type = 'view'").select(text("user_id").alias("session_key"), text("event_id").alias("agent_key"), (F.col("event_id") - 1).cast("string").alias("tool_use_id"), F.col("k").alias("description"))
    return lineage.match_subagents(calls, links)


@register(
    "K10_line_diff",
    """with l as (select source, unnest(string_split(text, chr(10))) as line from documents where source in ('src0', 'src1')),
    c as (select line, count(*) filter (where source = 'src0') as a, count(*) filter (where source = 'src1') as b from l group by line)
    select line, least(a, b) as common, a - least(a, b) as only_first, b - least(a, b) as only_second from c""",
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of two sources' documents, as of two files."""
    d = load(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lineage.line_diff(d.filter("source = 'src0'"), d.filter("source = 'src1'"))


@register(
    "T4_manifest_changes",
    """with o as (select source, count(*) as n, count(distinct text) as k from documents where doc_id in (select doc_id from labels) group by source), n as (select source, count(*) as n, count(distinct text) as k from documents where lang <> 'de' group by source)
    select coalesce(o.source, n.source) as session_key, case when o.source is null then 'added' when n.source is null then 'removed' when o.n <> n.n or o.k <> n.k then 'changed' else 'same' end as change
    from o full join n on o.source = n.source""",
)
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as sessions: the labelled documents were indexed before, those that aren't German are there now."""
    d = load(spark, sf_dir, "documents")
    of = lambda x: x.groupBy(F.col("source").alias("session_key")).agg(F.concat_ws("-", F.count("*").cast("string"), F.count_distinct("text").cast("string")).alias("fingerprint"))
    return index.changes(of(d.join(load(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")), of(d.filter("lang <> 'de'")))


def _corrections_sql() -> str:
    quoted = [(name, base, ("(?im)" + p).replace("'", "''")) for name, base, p in lessons.CORRECTIONS]
    hits = ", ".join(f"cast(regexp_matches(text, '{p}') as int) as h{i}" for i, (_, _, p) in enumerate(quoted))
    total = " + ".join(f"h{i}" for i in range(len(quoted)))
    base = " ".join(f"when h{i} = 1 then {b}" for i, (_, b, _) in enumerate(quoted))
    name = " ".join(f"when h{i} = 1 then '{n}'" for i, (n, _, _) in enumerate(quoted))
    return f"select doc_id, case {base} end + {total} as strength, case {name} end as basis from (select doc_id, {hits} from documents) x where {total} > 0"


@register("C16_correction_families", _corrections_sql())
def correction_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as users' texts."""
    d = load(spark, sf_dir, "documents").select("doc_id", lessons.correction(F.col("text")).alias("c"))
    return d.filter("c is not null").select("doc_id", F.col("c.strength").alias("strength"), F.col("c.basis").alias("basis"))


@register(
    "W4_session_phases",
    """with e as (select user_id, event_id, event_type, epoch_us(ts) / 6e7 as t from events), x as (select *, t - min(t) over (partition by user_id) as into_, max(t) over (partition by user_id) - t as left_ from e)
    select cast(user_id as varchar) as session_key, event_id as line_no, case when into_ + left_ <= 120 then case when into_ + left_ = 0 or into_ / (into_ + left_) < 0.33 then 'early' when into_ / (into_ + left_) < 0.67 then 'middle' else 'late' end
      when into_ < 30 then 'early' when left_ < 30 then 'late' else 'middle' end as phase, cast(floor(into_) as bigint) as minutes_in,
      bool_or(event_type = 'signup') over (partition by user_id order by event_id rows between unbounded preceding and current row) as after_compaction from x""",
)
def session_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as sessions; a signup compacts."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("line_no"), "ts", F.when(F.col("event_type") == "signup", "compact_boundary").alias("subtype"))
    return usage.phases(e)


@register(
    "W5_usage_epochs",
    """with e as (select user_id, event_id, cast(floor(value * 100) as bigint) as input, cast(json_extract_string(props, '$.k') as bigint) as output from events),
    o as (select *, lag(input) over w as wi, lag(output) over w as wo from e window w as (partition by user_id order by event_id)),
    r as (select *, wi is null or input < wi or output < wo as reset from o)
    select cast(user_id as varchar) as session_key, event_id as line_no, sum(cast(reset as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and current row) as epoch,
      case when reset then input else input - wi end as fresh, case when reset then output else output - wo end as added_output from r""",
)
def usage_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cumulative counters of their users."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("line_no"), F.floor(F.col("value") * 100).alias("input"), F.get_json_object("props", "$.k").cast("long").alias("output"), F.lit(0).cast("long").alias("cached"))
    return rollouts.usage_epochs(e).select("session_key", "line_no", "epoch", "fresh", "added_output")


@register(
    "J7_commits",
    """with s as (select o_custkey % 25 as repo, o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from orders group by o_custkey)
    select cast(s.o_custkey as varchar) as session_key, cast(s_suppkey as varchar) as sha from s join supplier p on p.s_nationkey = s.repo
    where timestamp '1992-01-01 00:00:00' + interval '1' day * s_suppkey between a and b""",
)
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as sessions in one of 25 folders, suppliers as the commits of their nation's folder, one a day."""
    s = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start_ts"), F.max("o_orderdate").alias("end_ts"))
    s = s.select(F.col("o_custkey").cast("string").alias("session_key"), (F.col("o_custkey") % 25).cast("string").alias("cwd"), "start_ts", "end_ts")
    c = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("repo"), F.col("s_suppkey").cast("string").alias("sha"), F.expr("timestamp '1992-01-01 00:00:00' + make_dt_interval(cast(s_suppkey as int))").alias("at"))
    return usage.commits_of(s, c).select("session_key", "sha")
