"""Approximate nearest neighbours by inverted lists and an adaptive scan of dimensions.

Vectors are scaled to length one and turned by a random rotation, so that any few of their dimensions are a fair
sample of the distance. k-means centres, fitted on a bounded sample, part all vectors into lists; a query looks
into the lists nearest to it. Within a list, dimensions are scanned in blocks of columns; after each block a
hypothesis test drops the candidates whose partial distance is already too large for the query's best so far.
What is left is scored exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors that the centres are fitted on, at most, and the most centres.
SAMPLE, MAX_LISTS = 20_000, 4_096
#: Lists to the square root of the vectors; the fewest lists that a query looks into; and the share of near vectors of the sample that must lie in them.
LISTS_BY_ROOT, LEAST_PROBES, REACH = 0.5, 10, 0.96
#: Vectors of the sample whose neighbours in it tell how many lists that takes.
TRIED = 400
#: Columns of a block; the test's width: a partial distance this many deviations above the best is given up.
COLUMNS, WIDTH = 16, 2.1
#: Vectors and queries of a group, about: what a task holds at once; and queries scanned together.
GROUP, CALLS, TILE = 16_384, 65_536, 256
SEED = 7
#: Different lengths of vectors in one table, the most frequent ones, that have an index each; vectors of the others are compared with all of their length.
MAX_LENGTHS = 64
NEAREST, QUERY_EVERY = 5, 50


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres_of(sample: np.ndarray, n: int, seed: int = SEED, rounds: int = 12) -> np.ndarray:
    """k-means of unit vectors; empty centres start again at the vectors farthest from theirs."""
    n = max(1, min(n, len(sample)))
    c = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = sample @ c.T
        of = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        count = np.bincount(of, minlength=n)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return c


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int = NEAREST, reach: float = REACH) -> int:
    """How many lists hold this share of the k nearest of some of the sample's unit vectors within the sample.

    Few where the vectors have clusters, nearly all where they have none. In the whole table neighbours are nearer
    than in the sample, so the share found there is no smaller.
    """
    tried = np.random.default_rng(SEED).permutation(len(sample))[:TRIED]
    if len(sample) < 2:
        return len(centres)
    near = sample[tried] @ sample.T
    near[np.arange(len(tried)), tried] = -np.inf
    k = min(k, len(sample) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    of = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(sample[tried] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(tried), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, of[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(reach * len(needed)) - 1)])


def _unit(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, and scaled to length one; scaled by their largest component first, so that no square overflows."""
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    u = v / np.abs(v).max(axis=1, keepdims=True)
    return v, u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row; each row is summed alike wherever it stands, so equal vectors have equal scores."""
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def scan(queries: np.ndarray, rows: np.ndarray, barred: np.ndarray, k: int, columns: int = COLUMNS, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among a query's k nearest rows; both are rotated vectors, barred pairs take no part.

    Block by block of columns the partial distances grow, and a test against the best whole distances gives pairs
    up. While most pairs are left, a block is one matrix product; once few are, only their own columns are read.
    """
    (m, d), n = queries.shape, len(rows)
    if not m or not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    partial, alive, best, seen = np.zeros((m, n)), ~barred, np.full(m, np.inf), 0
    factor = lambda at: 1.0 if at == d else (1 + width / math.sqrt(at)) ** 2 * at / d
    while seen < d and (seen == 0 or alive.mean() > 0.125):
        q, r = queries[:, seen : seen + columns], rows[:, seen : seen + columns]
        partial += (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1) - 2 * (q @ r.T)
        if seen == 0 and n > 2 * k:  # whole distances of those that start best bound the others
            first = np.argpartition(np.where(alive, partial, np.inf), 2 * k - 1, axis=1)[:, : 2 * k]
            whole = ((rows[first] - queries[:, None]) ** 2).sum(axis=2)
            whole[~np.take_along_axis(alive, first, axis=1)] = np.inf
            best = np.partition(whole, k - 1, axis=1)[:, k - 1]
        seen = min(seen + columns, d)
        alive &= partial <= (best * factor(seen))[:, None] + 1e-9
    i, j = np.nonzero(alive)
    left = partial[i, j]
    while seen < d and len(i):
        part = queries[i, seen : seen + columns] - rows[j, seen : seen + columns]
        left = left + (part * part).sum(axis=1)
        seen = min(seen + columns, d)
        keep = left <= best[i] * factor(seen) + 1e-9
        i, j, left = i[keep], j[keep], left[keep]
    return i, j


def searched(rows: pa.Table, calls: pa.Table, d: int, turn: np.ndarray, k: int, width: float = WIDTH) -> pa.Table:
    """(query_id, vec_id, score) of the k nearest of rows(id, v) to each of calls(id, v), all of d components; turn rotates them for the scan."""
    kind = rows.schema.field("id").type
    tables = []
    if rows.num_rows and calls.num_rows:
        own, (v, u) = np.asarray(rows["id"]), _unit(rows["v"].combine_chunks(), d)
        u = u @ turn
        who, (q, uq) = np.asarray(calls["id"]), _unit(calls["v"].combine_chunks(), d)
        uq = uq @ turn
        for low in range(0, len(who), TILE):
            part = who[low : low + TILE]
            i, j = scan(uq[low : low + TILE], u, part[:, None] == own, k, width=width)
            score = cosine(q[low + i], v[j])
            order = np.lexsort((own[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) < k
            tables.append(pa.table({"query_id": pa.array(part[i[near]], kind), "vec_id": pa.array(own[j[near]], kind), "score": pa.array(score[near])}))
    return pa.concat_tables(tables) if tables else pa.schema([("query_id", kind), ("vec_id", kind), ("score", pa.float64())]).empty_table()


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest by cosine, ties to the smaller id.

    queries has the same two columns. A candidate with the query's own id takes no part; nor do null ids and vectors
    that usable() refuses. Vectors of different lengths have no cosine: each length is searched by itself. Repeated
    rows are candidates each; of queries that repeat an id, the smallest vector is asked. Every vector is indexed;
    only the centres, and how many lists a query looks into, come from a sample of at most SAMPLE vectors, chosen by
    a hash of the id. A query looks into more lists until these hold a multiple of k vectors. Long lists, and lists
    that many queries ask, are dealt over groups of about GROUP vectors by CALLS queries, so that a hot list is no
    task of its own. To the driver go the sample and a count for each list. Empty tables give no rows.
    """
    pick = lambda df: df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    base, asked = pick(vectors), pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    kind = dict(base.dtypes)["id"]
    lengths = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(MAX_LENGTHS + 1).collect()
    out = vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    for n, (d, total) in enumerate(lengths[:MAX_LENGTHS]):
        found = _nearest(base.filter(F.size("v") == d), asked.filter(F.size("v") == d), kind, d, total, k, reach)
        out = found if n == 0 else out.union(found)
    if len(lengths) > MAX_LENGTHS:
        rest = ~F.size("v").isin([d for d, _ in lengths[:MAX_LENGTHS]])
        out = out.union(_exact(base.filter(rest), asked.filter(rest), kind, k))
    return out


def _nearest(base: DataFrame, asked: DataFrame, kind: str, d: int, total: int, k: int, reach: float) -> DataFrame:
    """nearest() of vectors(id, v) of one length."""
    sample = base.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    turn = rotation(d)
    sample = _unit(sample, d)[1] @ turn
    centres = centres_of(sample, min(MAX_LISTS, round(LISTS_BY_ROOT * math.sqrt(total))))
    n_lists = len(centres)
    probes = max(LEAST_PROBES, probes_for(sample, centres, k, reach))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                of = (_unit(b.column(1), d)[1] @ turn @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32))], names=["id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-(_unit(b.column(1), d)[1] @ turn @ centres.T), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) >= 20 * (k + 1)).argmax(axis=1) + 1
            enough[sizes.sum() < 20 * (k + 1)] = n_lists
            chosen = [o[: max(n, probes)] for o, n in zip(order.tolist(), enough.tolist(), strict=True)]
            chosen = [[x for x in c if sizes[x]] for c in chosen]
            lists = pa.array(chosen, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "v", "lists"])

    placed = base.mapInArrow(place, f"id {kind}, v {dict(base.dtypes)['v']}, list int")
    sizes = np.zeros(n_lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list, at most MAX_LISTS
        sizes[r[0]] = r[1]
    probed = asked.mapInArrow(probe, f"id {kind}, v {dict(base.dtypes)['v']}, lists array<int>").select("id", "v", F.explode("lists").alias("list"))
    demand = np.zeros(n_lists, np.int64)
    for r in probed.groupBy("list").count().collect():
        demand[r[0]] = r[1]

    def dealt(count: np.ndarray, most: int) -> Column:
        """How many groups a list's rows go to."""
        return F.element_at(F.array(*[F.lit(int(max(1, -(-x // most)))) for x in count]), F.col("list") + 1)

    row, call = dealt(sizes, GROUP), dealt(demand, CALLS)
    parts = placed.withColumn("a", F.pmod(F.xxhash64("id"), row).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), call - 1)))
    calls = probed.withColumn("b", F.pmod(F.xxhash64("id"), call).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), row - 1)))

    def search(rows: pa.Table, calls: pa.Table) -> pa.Table:
        return searched(rows, calls, d, turn, k)

    found = parts.groupBy("list", "a", "b").cogroup(calls.groupBy("list", "a", "b")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(base: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """nearest() of vectors(id, v) of any number of lengths, comparing all of a length: for the lengths that few vectors have. Groups of a length are dealt by their numbers, which stay a table."""
    count = lambda df, name: df.groupBy(F.size("v").alias("d")).agg(F.count("*").alias(name))
    sizes = count(base, "n").join(count(asked, "m"), "d").select("d", F.ceil(F.col("n") / GROUP).cast("int").alias("row"), F.ceil(F.col("m") / CALLS).cast("int").alias("call"))
    part = lambda df: df.withColumn("d", F.size("v")).join(sizes, "d")
    place, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = part(base).withColumn("a", place("row")).withColumn("b", every("call")).select("d", "a", "b", "id", "v")
    calls = part(asked).withColumn("b", place("call")).withColumn("a", every("row")).select("d", "a", "b", "id", "v")

    def search(rows: pa.Table, calls: pa.Table) -> pa.Table:
        d = (rows if rows.num_rows else calls)["d"][0].as_py()
        return searched(rows, calls, d, np.eye(d), k, 1e6)

    found = parts.groupBy("d", "a", "b").cogroup(calls.groupBy("d", "a", "b")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    return _first(found, k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))
