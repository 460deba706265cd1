"""Conversation trees of the canonical entries.

A session's tree is rebuilt by one grouped pass: its depth has no bound that recursion in SQL would keep, and the
choice of the main thread compares whole subtrees. Sessions come one after
the other through a task that holds one's ids and times, without contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "session_key string, uuid string, parent_uuid string, line_no long, depth int, subtree_size int, n_children int, is_root boolean, is_main boolean, main_pos int, is_leaf boolean, dfs_pos int, bfs_pos int, fork_root string, anchor string"
#: Nodes that a task hands on at once.
BATCH = 20_000


def _rebuild(rows: list[tuple]) -> list[list]:
    """The columns of NODES but the first, of one session's (uuid, parent, logical parent, line, time, conversational) in the order of lines; of an id that comes again the first counts."""
    seen: set[str] = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    ids = [r[0] for r in rows]
    at = {u: i for i, u in enumerate(ids)}
    parent, bridged = [], []
    for u, p, q, *_ in rows:
        found = next(((at[x], x is q) for x in (p, q) if x is not None and x in at), (None, False))
        parent.append(None if found[0] is None or ids[found[0]] == u else found[0])
        bridged.append(found[1])
    # cut cycles: a node that hangs by its logical parent becomes a root, else the one met again on its own way up
    state = [0] * len(ids)
    for i in range(len(ids)):
        way, now = [], i
        while now is not None and state[now] == 0:
            state[now] = 1
            way.append(now)
            now = parent[now]
        if now is not None and state[now] == 1:
            circle = way[way.index(now) :]
            parent[next((x for x in circle if bridged[x]), now)] = None
        for x in way:
            state[x] = 2
    children: list[list[int]] = [[] for _ in ids]
    roots = []
    for i, p in enumerate(parent):
        (roots if p is None else children[p]).append(i)
    depth, order, stack = [0] * len(ids), [], list(reversed(roots))
    while stack:
        i = stack.pop()
        order.append(i)
        for c in children[i]:
            depth[c] = depth[i] + 1
        stack.extend(reversed(children[i]))
    weight = [1 if r[5] else 0 for r in rows]
    ts = [-1 if r[4] is None else r[4] for r in rows]
    size, talk, latest = [1] * len(ids), list(weight), [t if w else -1 for t, w in zip(ts, weight, strict=True)]
    for i in reversed(order):
        for c in children[i]:
            size[i] += size[c]
            talk[i] += talk[c]
            latest[i] = max(latest[i], latest[c])
    main, pos = [False] * len(ids), [-1] * len(ids)
    n = 0
    rank = lambda i: (latest[i], talk[i])
    for r in sorted((r for r in roots if talk[r]), key=rank):
        now = r
        while now is not None:
            main[now], pos[now] = True, n
            n += 1
            # of equal keys the last one wins
            now = max(reversed(children[now]), key=rank) if children[now] else None
    # off the main thread: the topmost node of the same branch, and the node of the main thread that it hangs by
    fork, anchor = [None] * len(ids), [None] * len(ids)
    for i in order:
        if not main[i]:
            p = parent[i]
            fork[i], anchor[i] = (ids[i], None if p is None else ids[p]) if p is None or main[p] else (fork[p], anchor[p])
    dfs, bfs = [0] * len(ids), [0] * len(ids)
    for k, i in enumerate(order):
        dfs[i] = k
    for k, i in enumerate(sorted(order, key=depth.__getitem__)):
        bfs[i] = k
    up = [None if p is None else ids[p] for p in parent]
    return [ids, up, [r[3] for r in rows], depth, size, [len(c) for c in children], [p is None for p in parent], main, pos, [not c for c in children], dfs, bfs, fork, anchor]


def nodes(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each entry with a uuid: its place in the session's forest, and on the main thread (main_pos -1: not on it).

    Parent is parentUuid, else logicalParentUuid; a missing parent makes a root. The main thread follows, from each
    root that holds conversation, the child whose subtree spoke last, then the larger one, then the later one.
    Progress entries and tool results don't count as conversation. dfs_pos and bfs_pos number the session's nodes
    depth first and level by level. Nodes off the main thread have fork_root, the topmost node of their branch, and
    anchor, the node of the main thread that it hangs by, if any. A cycle is cut at an edge to a logical parent, if it has one. Entries without a
    uuid are no nodes: orphans() has them.
    """
    results = blocks.filter("block_type = 'tool_result' and entry_type = 'user'").select("session_key", "line_no").distinct().withColumn("has_result", F.lit(True))
    e = entries.filter("uuid is not null").join(results, ["session_key", "line_no"], "left")
    talks = F.col("entry_type").isin("user", "assistant") & F.col("has_result").isNull()
    slim = e.select("session_key", "uuid", "parent_uuid", "logical_parent_uuid", "line_no", "ts", talks.alias("conversational"))
    # times in microseconds; a session's rows follow each other in one task
    slim = slim.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("session_key").sortWithinPartitions("session_key", "line_no")
    return slim.mapInArrow(_by_session, NODES)


def _by_session(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string())
    names = [f.split()[0] for f in NODES.split(", ")]
    done: list[list] = [[] for _ in names]

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds, strict=True)], names=names)
        for c in done:
            c.clear()
        return out

    def add(key: str | None, rows: list[tuple]) -> None:
        columns = _rebuild(rows)
        done[0].extend([key] * len(columns[0]))
        for c, x in zip(done[1:], columns, strict=True):
            c.extend(x)

    now, rows = None, []
    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now and rows:
                add(now, rows)
                rows = []
                if len(done[0]) >= BATCH:
                    yield made()
            now = key
            rows.append((row[0], row[1], row[2], row[3], row[4], row[5]))
    if rows:
        add(now, rows)
    yield made()


def orphans(entries: DataFrame) -> DataFrame:
    """Entries without a uuid, in their files' order."""
    return entries.filter("uuid is null").orderBy("session_key", "line_no")


def paths(forest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_key, uuid, path): the uuids from the root down to each wanted(session_key, uuid) of nodes(). A group is one session's ids; the paths are as long as the nodes are deep."""

    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        up = dict(zip(rows["uuid"], rows["parent_uuid"], strict=True))
        out = []
        for u in asked["asked"].drop_duplicates():
            if u in up:
                way, now = [], u
                while isinstance(now, str):
                    way.append(now)
                    now = up.get(now)
                out.append((key[0], u, way[::-1]))
        return pd.DataFrame(out, columns=["session_key", "uuid", "path"])

    return forest.select("session_key", "uuid", "parent_uuid").groupBy("session_key").cogroup(wanted.select(F.col("session_key").alias("asked_key"), F.col("uuid").alias("asked")).groupBy("asked_key")).applyInPandas(run, "session_key string, uuid string, path array<string>")


def common_ancestor(a: Column, b: Column) -> Column:
    """The deepest node that two paths share, null if they have no node in common."""
    return F.try_element_at(F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(-1))


def duplicates(entries: DataFrame) -> DataFrame:
    """Entries whose uuid came before in the same session, and whether the first is the same text."""
    first = entries.filter("uuid is not null").groupBy("session_key", "uuid").agg(F.min_by("raw", "line_no").alias("first_raw"), F.min("line_no").alias("first_line"), F.count("*").alias("n"))
    d = entries.join(first.filter("n > 1"), ["session_key", "uuid"]).filter("line_no > first_line")
    return d.select("session_key", "uuid", "line_no", (F.col("raw") == F.col("first_raw")).alias("exact"))
