"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Exact links within few bits: the fingerprint falls into segments, so two fingerprints within the distance agree up
to a small radius in one of them. Each segment's values index a table; every fingerprint looks up all values of
the Hamming ball of that radius around its own, and the matches' complete distances are verified.

A dense bucket of a table holds many fingerprints that share a segment. There, instead of meeting pairwise, the
fingerprints enumerate the ball of radius one within each segment with the other segments as they are: two
fingerprints within two bits have a point of their balls in common, and each point links its visitors to the
smallest. That finds the same components with a number of rows that doesn't grow with the bucket.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, small, table, text_id, unused, values, written
from .components import components

SEED = 42
#: Words of a shingle and bits of difference of the query.
WORDS, DISTANCE = 3, 2
#: Distinct fingerprints that a table's bucket holds before it counts as dense.
DENSE = 64
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 15
#: For similarity search: 64-bit hashes a shingle, bits of a segment, and the least certain bits that are flipped.
LANES, SEGMENT, FLIPS = 10, 32, 4
#: Texts of a task whose copies are told at once.
SEEN = 500_000
#: Texts of a group that a task compares with one another; more are dealt in blocks, and all pairs of blocks compared.
CROWD = 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, as big-endian bytes (n, 8).

    A-Z are lower-cased, words are parted by space and the bytes 9 to 13; fewer words than a shingle has are one.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty((0, 8), np.uint8)
    joined = b" ".join(w)
    if len(w) <= words:
        parts = [joined]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w))
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        parts = [joined[a:b] for a, b in zip(begin[: len(w) - words + 1].tolist(), (begin + size)[words - 1 :].tolist(), strict=True)]
    return np.frombuffer(b"".join([xxhash.xxh64_digest(p, SEED) for p in parts]), np.uint8).reshape(-1, 8)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits of each hash (splitmix64's finish)."""
    x = h + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_margins(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Per bit, twice the number of hashes that set it less their number; the first bit is the highest."""
    total, block = np.zeros(64 * lanes, np.int64), BLOCK // lanes
    for low in range(0, len(hashes), block):
        part = hashes[low : low + block]
        if lanes > 1:
            h = np.ascontiguousarray(part).view(">u8").astype(np.uint64).ravel()
            part = np.stack([_mixed(h, lane) for lane in range(lanes)], axis=1).astype(">u8").view(np.uint8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return 2 * total - len(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row, as a signed long. Null and empty texts have zero."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(bit_margins(shingle_hashes(x, words)) > 0) for x in values(b.column(1))]
            fp = np.frombuffer(b"".join(x.tobytes() for x in bits), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    """Masks that flip at most radius of the lowest bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]


def _half(c: Column, segment: int) -> Column:
    return F.shiftrightunsigned(c, 32) if segment == 0 else c.bitwiseAND(F.lit(0xFFFFFFFF))


def _probes(ball: Column, segment: int) -> Column:
    """The values of one segment's ball, as entries of its table."""
    return F.transform(ball, lambda m: F.struct(F.lit(segment).alias("segment"), _half(F.col("fp"), segment).bitwiseXOR(m).alias("value")))


def links(fps: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fps(fp) that join all within `distance` (at most 3) bits.

    All pairs are among the edges but those within dense buckets, which share their components all the same; for
    a distance of 3 there are two flips on one side and one on the other, so dense buckets take it up to 2 only.
    """
    if not 0 <= distance <= 2:
        raise ValueError("two segments with a radius of one cover distances up to 2 and dense buckets too")
    ball = F.array(*[F.lit(m) for m in _ball(32, distance // 2)])
    halves = [F.struct(F.lit(s).alias("segment"), _half(F.col("fp"), s).alias("value")) for s in (0, 1)]
    index = fps.select("fp", F.inline(F.array(*halves)))
    sizes = index.groupBy("segment", "value").agg(F.count("*").alias("n"))
    # a bucket beside a dense one counts as dense: all who look into any other bucket are of sparse ones, so they are few
    full = sizes.filter(F.col("n") > dense).select("segment", F.explode(F.transform(ball, lambda m: F.col("value").bitwiseXOR(m))).alias("value")).distinct()
    probes = [_probes(ball, s) for s in (0, 1)]
    probed = fps.select(F.col("fp").alias("probe"), F.inline(F.concat(*probes)))
    sparse = index.join(full, ["segment", "value"], "left_anti").select("segment", "value", "fp")
    pairs = probed.join(sparse, ["segment", "value"]).filter((F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= distance) & (F.col("probe") != F.col("fp")))
    pairs = pairs.select(F.greatest("probe", "fp").alias("a"), F.least("probe", "fp").alias("b"))
    # whoever looks into a dense bucket enumerates points instead
    visitors = probed.join(full, ["segment", "value"], "left_semi").select(F.col("probe").alias("fp")).distinct()
    return pairs.union(_star(visitors, distance)).distinct()


def _star(fps: DataFrame, distance: int) -> DataFrame:
    """Edges from each fingerprint to the smallest visitor of every point that its balls reach."""
    masks = [0] if distance == 0 else [0, *((m << s) - (1 << 64 if (m << s) >> 63 else 0) for s in (0, 32) for m in _ball(32, 1)[1:])]
    points = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks]).cast("array<bigint>")).alias("mask"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    if distance == 1:  # only meetings in one of the two fingerprints count
        points = points.join(fps.select(F.col("fp").alias("point")), "point", "left_semi")
    first = points.groupBy("point").agg(F.min("fp").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    met = points.join(first, "point").filter("fp <> leader")
    if distance == 1:
        met = met.select(F.col("fp").alias("x"), F.col("point").alias("y")).union(met.select(F.col("leader").alias("x"), F.col("point").alias("y")))
    else:
        met = met.select(F.col("fp").alias("x"), F.col("leader").alias("y"))
    close = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance) & (F.col("x") != F.col("y"))
    return met.filter(close).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(id, fp, component_id) of every row: groups of fingerprints within `distance` bits of each other, chains included.

    component_id is the smallest id of the group; null ids don't count for it, and a group of null ids alone has
    none. Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node, so
    copies cost nothing; repeated rows each keep a row. Other columns are left out.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = written(components(links(least.select("fp"), distance, dense)), "roots")
    grouped = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.join(of_root, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents within two bits of 64, by shingles of three words."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def bit_limit(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts with this Jaccard similarity differ: what is expected, and three deviations more.

    Sets of a Jaccard similarity s meet at an angle whose cosine is 2s / (1 + s), and each bit tells a random plane's sides.
    The limit only chooses what is verified: one pair in a thousand at this similarity lies beyond it.
    """
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(tid, signature, doubts) of texts(tid, text): LANES words of bits, and of each segment the FLIPS bits with the smallest margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tids, bits, doubts = [], [], []
            for tid, text in zip(b.column(0).to_pylist(), values(b.column(1)), strict=True):
                if not fresh(seen, tid, SEEN):
                    continue
                margins = bit_margins(shingle_hashes(text, words), LANES)
                tids.append(tid)
                bits.append(np.packbits(margins > 0).tobytes())
                doubts.append(np.argsort(np.abs(margins).reshape(-1, SEGMENT), axis=1, kind="stable")[:, :FLIPS].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(bits, pa.binary()), pa.array(doubts, pa.binary())], names=["tid", "signature", "doubts"])

    return texts.mapInArrow(run, "tid long, signature binary, doubts binary")


def _lookups(sketched: DataFrame) -> DataFrame:
    """(key, tid): of every segment the values in the ball that its doubtful bits span."""
    segments = LANES * 64 // SEGMENT
    chosen = np.array(list(itertools.product((0, 1), repeat=FLIPS)), np.uint32)  # each subset of the doubtful bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(low, 2_000) for x in batches for low in range(0, x.num_rows, 2_000)):
            value = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(-1, segments, 1).astype(np.uint32)
            doubt = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, segments, 1, FLIPS)
            mask = ((np.uint32(1) << (31 - doubt).astype(np.uint32)) * chosen).sum(axis=3, dtype=np.uint32)
            key = (np.arange(segments, dtype=np.int64) << 32)[:, None] | (value ^ mask).astype(np.int64)
            tid = np.repeat(b.column(0).to_numpy(), segments * len(chosen))
            key = key.reshape(-1)
            for low in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[low : low + 100_000]), pa.array(tid[low : low + 100_000])], names=["key", "tid"])

    return sketched.mapInArrow(run, "key long, tid long")


def _meetings(found: DataFrame) -> DataFrame:
    """(key, tid, leader, n) of the values that more than one text looks up: their number, and the first in one order of all texts."""
    w = Window.partitionBy("key")
    first = F.struct(F.xxhash64("tid").alias("h"), "tid")
    met = found.select("key", "tid", F.min(first).over(w)["tid"].alias("leader"), F.count("*").over(w).alias("n"))
    return met.filter("n > 1")


def _within(pairs: DataFrame, bits: DataFrame, limit: int) -> DataFrame:
    """(a, b, apart) of the distinct pairs(a, b) whose complete fingerprints bits(tid, s0, ...) differ in at most `limit` bits.

    The partners of an a are gathered, so that each a meets its fingerprint once: they are as many as a text's lookups
    have leaders or few others, which the number of lookups bounds.
    """
    one = bits.select(F.col("tid").alias("a"), *[F.col(f"s{i}").alias(f"a{i}") for i in range(LANES)])
    two = bits.select(F.col("tid").alias("b"), *[F.col(f"s{i}").alias(f"b{i}") for i in range(LANES)])
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, LANES)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    met = pairs.groupBy("a").agg(F.collect_set("b").alias("l")).join(one, "a").select("*", F.explode("l").alias("b")).drop("l")
    return met.join(two, "b").select("a", "b", apart.alias("apart")).filter(F.col("apart") <= limit)


def _close_pairs(group: np.ndarray, tid: np.ndarray, root: np.ndarray, block: np.ndarray, bits: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one value's texts, the pairs within `limit` bits that no component joins yet; of two blocks, one text from each.

    bits are unsigned: of a negative number numpy counts the bits of its absolute value.
    """
    names, sizes = np.unique(root, return_counts=True)
    rest = root != names[sizes.argmax()]
    order = np.argsort(~rest, kind="stable")  # those of the largest component come last and need not meet each other
    tid, root, block, bits = tid[order], root[order], block[order], bits[order]
    two = group[1] != group[2]
    for i in range(int(rest.sum())):
        ok = (np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int32) <= limit) & (root[i + 1 :] != root[i])
        if two:
            ok &= block[i + 1 :] != block[i]
        other = tid[i + 1 :][ok]
        if len(other):
            yield np.maximum(other, tid[i]), np.minimum(other, tid[i])


def _group_pairs(t: np.ndarray, value: np.ndarray, row: np.ndarray, limit: int) -> np.ndarray:
    """The distinct pairs, (n, 2), of one group's rows t: those close under one of the values, of which row[i] has value[i]."""
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    ends, root = np.r_[starts[1:], len(value)], t[row, 5]
    apart = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    found = []
    for x, y in zip(starts[apart].tolist(), ends[apart].tolist(), strict=True):
        own = t[row[x:y]]
        found += [np.stack(p, axis=1) for p in _close_pairs(own[0], own[:, 4], own[:, 5], own[:, 3], own[:, 6:].view(np.uint64), limit)]
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _crowded_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b): pairs of different components within `limit` bits, of the texts of a group, rows(key, tid, root, n, s0, ...).

    With a column `values`, an array of longs, only texts that share one of them are compared, else all of a group.
    """
    blocks = F.ceil(F.col("n") / CROWD).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("tid"), blocks).cast("int"))
    shared = F.col("values") if "values" in rows.columns else F.array("key")
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tid", "root", *[f"s{i}" for i in range(LANES)], shared.alias("values")
    )
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows, and the values of each
        for b in itertools.chain((x for x in batches if x.num_rows), [None]):
            if b is not None:
                t = np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:-1]], axis=1)
                new = t, np.diff(b.column(b.num_columns - 1).offsets.to_numpy()), b.column(b.num_columns - 1).flatten().to_numpy()
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            if held is None:
                continue
            t, n, value = held
            ends = np.r_[np.flatnonzero((t[1:, :3] != t[:-1, :3]).any(axis=1)) + 1, len(t)]
            at = np.r_[0, np.cumsum(n)]
            x = 0
            for y in (ends if b is None else ends[:-1]).tolist():  # the last group may go on in the next batch
                pairs = _group_pairs(t[x:y], value[at[x] : at[y]], np.repeat(np.arange(y - x), n[x:y]), limit)
                for low in range(0, len(pairs), 100_000):
                    part = pairs[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])
                x = y
            held = t[x:], n[x:], value[at[x] :]

    return dealt.mapInArrow(run, "a long, b long").distinct()


def shingle_sets(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(tid, shingles) of the texts(tid, text) that pairs(a, b) name: the hashes of their distinct shingles, as a written table."""
    needed = pairs.select(F.col("a").alias("tid")).union(pairs.select(F.col("b").alias("tid"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small(batches):
            tids, found = [], []
            for tid, text in zip(b.column(0).to_pylist(), values(b.column(1)), strict=True):
                if fresh(seen, tid, SEEN):
                    tids.append(tid)
                    found.append(np.unique(shingle_hashes(text, words).view("<u8").ravel()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(found, pa.binary())], names=["tid", "shingles"])

    of_text = texts.join(needed, "tid", "left_semi").select("tid", "text").mapInArrow(sets, "tid long, shingles binary")
    return written(of_text.dropDuplicates(["tid"]), "shingles")


def verified(pairs: DataFrame, of_text: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sets of shingles, of_text(tid, shingles), have at least this Jaccard similarity; two texts without words are alike."""
    both = pairs.join(of_text.select(F.col("tid").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(of_text.select(F.col("tid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            keep = []
            for x, y in zip(values(b.column(2)), values(b.column(3)), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(alike, "a long, b long")


def similar_groups(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(tid, root) of the texts(tid, text) that have near-duplicates: components of pairs of at least this similarity.

    A fingerprint of LANES * 64 bits falls into segments of SEGMENT bits. Every text looks up, in each segment's
    table, the values reached by flipping its least certain bits, and is in the table under them too, so two texts
    meet where their differences in a segment lie among the doubtful bits of either. Of those that meet under a value
    all pairs are compared: first each with one of them, in two rounds of half the segments each, the nearest of a
    text's before the others, then, where that leaves more than one component, all pairs of different components. For these the
    values are grouped by that one text, so that a text has a row for each it met, not for each value, and a task compares those
    of a group that share a value. Pairs with near enough fingerprints are verified by their sets of shingles before they
    link; those that are joined already aren't.
    What is lost are pairs that never meet: at a similarity of 0.8 four in a hundred, at 0.85 less than one (simulated).
    """
    limit = bit_limit(similarity, LANES * 64)
    sketched = written(sketches(texts, words).groupBy("tid").agg(F.first("signature").alias("signature"), F.first("doubts").alias("doubts")), "sketches")
    # a task's rows grow by the number of lookups, so the small table is dealt over all tasks first
    met = written(_meetings(_lookups(sketched.repartition("tid"))), "met")
    lanes = [F.conv(F.hex(F.substring("signature", 1 + 8 * i, 8)), 16, -10).cast("long").alias(f"s{i}") for i in range(LANES)]
    bits = sketched.select("tid", *lanes)
    led, half = met.filter("tid <> leader"), LANES * 64 // SEGMENT // 2
    # by one half of the segments first: of the pairs that only the other half brings, those joined by then need no comparison
    roots = _linked(led.filter(F.shiftright("key", 32) < half).select(F.col("tid").alias("a"), F.col("leader").alias("b")), None, bits, limit, texts, words, similarity)
    roots = _linked(led.filter(F.shiftright("key", 32) >= half).select(F.col("tid").alias("a"), F.col("leader").alias("b")), roots, bits, limit, texts, words, similarity)
    # all under a value have met their leader; any other two need to be compared unless they are joined already
    met = met.filter("n > 2 and tid <> leader").groupBy("leader", "tid").agg(F.collect_list("key").alias("values"))  # as many as a text's lookups at most
    rest = written(met.withColumnRenamed("leader", "key").join(roots, "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root"), "values"), "rest")
    apart = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n")
    crowd = rest.join(apart, "key").join(bits, "tid").select("key", "tid", "root", "n", "values", *[f"s{i}" for i in range(LANES)])
    close = written(_crowded_pairs(crowd, limit), "close")
    more = written(verified(close, shingle_sets(close, texts, words), similarity), "more-links")
    return _joined(roots, more) if more.head(1) else roots


def _linked(pairs: DataFrame, roots: DataFrame | None, bits: DataFrame, limit: int, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """roots(tid, root), or none yet, after the links among pairs(a, b): those near enough by their fingerprints whose sets of shingles have the similarity."""
    if roots is not None:
        pairs = written(_unjoined(pairs.distinct(), roots).select("a", "b"), "apart")
    near = written(_within(pairs, bits, limit), "near")
    sets = shingle_sets(near, texts, words)
    # each text and its nearest leader first: of the other pairs, those whose texts that joins need no look at their sets
    first = written(near.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")), "first")
    links = verified(first, sets, similarity)
    roots = written(components(links).withColumnRenamed("node", "tid"), "roots") if roots is None else written(_joined(roots, written(links, "links")), "roots")
    second = written(verified(_unjoined(near.select("a", "b").join(first, ["a", "b"], "left_anti"), roots).select("a", "b"), sets, similarity), "links")
    return written(_joined(roots, second), "roots") if second.head(1) else roots


def _unjoined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, x, y) of the pairs(a, b) whose components under roots(tid, root), x and y, are different."""
    one, two = (roots.select(F.col("tid").alias(t), F.col("root").alias(r)) for t, r in (("a", "x"), ("b", "y")))
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots(tid, root) after the links more(a, b): the components so far are the nodes that the links join."""
    edges = _unjoined(more, roots).select(F.col("x").alias("a"), F.col("y").alias("b"))
    above = written(components(edges).select(F.col("node").alias("root"), F.col("root").alias("above")), "above")
    alone = above.join(roots.select(F.col("tid").alias("root")), "root", "left_anti").select(F.col("root").alias("tid"), "root")
    return roots.select("tid", "root").union(alone).join(above, "root", "left").select("tid", F.coalesce("above", "root").alias("root"))


def text_hash(text: Column) -> Column:
    """64 bits of a text; different texts may share them."""
    return F.xxhash64(text)


def _renamed(slim: DataFrame) -> DataFrame | None:
    """(t, tid): other numbers for the texts of slim(tid, t), where t is their 128-bit id, that share a number with another text; None if there are none.

    Of n texts some n * n / 2**65 share one. They get numbers made of t, until none of these is taken either.
    """
    now, fixed = slim.select("tid", "t").distinct(), None
    for salt in range(1, 9):
        clash = now.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").select("tid")
        wrong = written(now.join(clash, "tid").select("t", F.xxhash64(F.lit(salt), "t").alias("tid")), "clashes")
        if not wrong.head(1):
            return fixed
        fixed = wrong if fixed is None else written(fixed.join(wrong, "t", "left_anti").unionByName(wrong), "renamed")
        now = written(now.join(wrong.select("t"), "t", "left_anti").unionByName(wrong.select("tid", "t")), "numbers")
    raise ArithmeticError("texts share their numbers under eight salts")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id, nulls last, then the smallest text id.

    Equal texts are near-duplicates, empty and null texts of one another too. Of rows that repeat an id with the
    same text, one stays. All columns pass through. Texts are told apart by 128 bits.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = written(docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text).alias("tid"), text_id(text).alias("t")), "ids")
    texts = docs.select(text.alias("text"), text_hash(text).alias("tid"))
    fixed = _renamed(slim)
    if fixed is not None:
        fixed = fixed.withColumnRenamed("tid", "own")
        number = F.coalesce("own", "tid").alias("tid")
        slim = slim.join(fixed, "t", "left").select("id", number, "t")
        texts = texts.withColumn("t", text_id(F.col("text"))).join(fixed, "t", "left").select("text", number)
    roots = written(similar_groups(texts.select("tid", "text"), words, similarity), "groups")
    known = slim.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    one, two = unused("kept_id", docs.columns), unused("kept_text", docs.columns)
    best = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("x")).select(F.col("x.id").alias(one), F.col("x.t").alias(two))
    own = unused("text_id", docs.columns)
    out = docs.withColumn(own, text_id(text)).join(best, F.col(f"`{id_col}`").eqNullSafe(F.col(one)) & (F.col(own) == F.col(two)), "left_semi")
    if slim.groupBy("id", "t").count().filter("count > 1").head(1):
        out = out.dropDuplicates([id_col, own])
    return out.drop(own)
