"""Repeated byte strings by common-prefix intervals of enhanced suffix arrays.

A window is a place where LENGTH bytes start. Among the runs of GRAM bytes within a window, the first with the least
hash is its anchor, so equal windows have equal anchors at the same place within them. The windows of one anchor are
a stretch of the text. Only anchors that occur twice can hold repeats.

Equal things are collapsed before anything meets: copies of a text within a task, equal stretches within a text, and
equal stretches of different texts, which a 128-bit digest tells and which combine before the shuffle. A stretch that
occurs twice is a repeat as a whole. The bytes of one example of each kind of stretch are gathered by anchor, and a
suffix array is built over them, with the lengths of the common prefixes of neighbours. A scan with a stack gives the
tree of the intervals of common prefixes; one whose members differ in the byte to their left is a maximal repeat,
given out with all its places.

An anchor with more than GROUP kinds of stretches falls apart by its next bytes: the places of the anchor within the
window are halved, and kinds stay together that agree in all bytes that the windows of a half share. Equal ones
collapse again. After eight halvings a part is one window, and all in it are equal; so arrays have a bounded size and
no string is counted in another way than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, small, table, text_id, unused, values, written

#: Bytes of a repeat, and of what an anchor hashes.
LENGTH, GRAM = 200, 40
#: Kinds of stretches under one key that an array takes; and bytes that one array takes, about.
GROUP, GATHERED = 4_096, 1 << 20
#: Texts of a task whose copies are told at once.
SEEN = 200_000
#: Windows of a text handled at once (their places take 20 bits).
BLOCK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """The first n powers of BASE modulo 2**64."""
    if len(_KEPT.get(0, ())) < n:
        x = np.full(1 << max(16, (n - 1).bit_length()), BASE, np.uint64)
        x[0] = 1
        _KEPT[0] = np.multiply.accumulate(x)
    return _KEPT[0][:n]


def window_hashes(data: np.ndarray, size: int, most: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes; comparable between calls with the same `most`, a bound of the data's size."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    pw = _powers(most + 1)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
    h = (total[size:] - total[: n + 1 - size]) * pw[most - n + size : most + 1][::-1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values: running minima within blocks, from either end."""
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def stretches(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hashes, first windows, last windows, anchors' places) of a text, block by block."""
    width = length - gram + 1
    for low in range(0, len(data) - length + 1, BLOCK):
        h = window_hashes(data[low : low + BLOCK + length - 1], gram, BLOCK + length)
        # equal hashes are told apart by place, so that the first one is the least
        at = (_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield h[at[first]], low + first, low + np.append(first[1:], len(at)) - 1, low + at[first]


def suffix_array(data: np.ndarray, depth: int, starts: np.ndarray) -> np.ndarray:
    """The places of starts whose `depth` symbols to come stand at another start too, in the order of all that follows; data: symbols from 0 to 511.

    Prefix doubling: ranks by seven symbols, then by pairs of ranks, each time among those that are still equal.
    """
    n, seen = len(data), 7
    padded = np.concatenate((data.astype(np.uint16), np.zeros(7, np.uint16)))
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key |= padded[k : k + n]
    rank = np.zeros(n + 1, np.int32)  # the last one is that of the end
    rank[n] = -1
    open_ = found = np.arange(n, dtype=np.int32)
    while True:
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        del order
        here, before = np.arange(len(open_), dtype=np.int32), rank[open_]
        new, old = np.ones(len(open_), bool), np.ones(len(open_), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        np.not_equal(before[1:], before[:-1], out=old[1:])
        rank[open_] = before + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(old, here, 0))
        del here, before, old, key
        new = np.append(new, True)
        open_ = open_[~(new[:-1] & new[1:])]
        if seen <= depth:
            found = open_
        if not len(open_):
            break
        key = rank[open_].astype(np.int64)
        key *= n + 1
        key += rank[np.minimum(open_ + seen, n)] + 1
        seen *= 2
    found = found[starts[found]]
    return found[np.argsort(rank[found])]


def common_prefixes(data: np.ndarray, ends: np.ndarray, places: np.ndarray, block: int = 8_192) -> np.ndarray:
    """Symbols that each of the suffixes data[i:ends[i]] shares with the one before it."""
    common = np.zeros(len(places), np.int32)
    size = ends[places] - places
    depth = int(size.max()) if len(size) else 0
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(depth + 1, data.dtype))), depth + 1)
    for low in range(1, len(places), block):
        one = places[low : low + block]
        differ = rows[one] != rows[places[low - 1 : low - 1 + len(one)]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        common[low : low + len(one)] = np.minimum(first, np.minimum(size[low : low + block], size[low - 1 : low - 1 + len(one)]))
    return common


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of the array whose members share at least `least` bytes, inner ones first."""
    stack: list[tuple[int, int]] = []  # (common prefix, first member) of the open intervals
    blocks = (common[low : low + 8_192].tolist() for low in range(1, len(common), 8_192))
    for i, value in enumerate(chain(chain.from_iterable(blocks), (0,)), 1):
        first = i - 1
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(data: np.ndarray, ends: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the maximal repeats of at least `least` symbols among the suffixes data[i:ends[i]], with all their places, inner ones first.

    data holds no symbol across an end twice (a separator). first marks the places where a part begins: what stands
    to their left differs from everything. An interval whose members all have the same symbol to their left can be
    extended, and is no maximal repeat.
    """
    places = suffix_array(data, least, ends - np.arange(len(data), dtype=ends.dtype) >= least)
    common = common_prefixes(data, ends, places)
    before = np.where(first[places], -1, data[places - 1].astype(np.int32))
    # whole trees whose members have the same symbol to their left hold no maximal repeat
    tree = np.cumsum(common < least) - 1
    low, high = (np.full(tree[-1] + 1 if len(tree) else 0, x) for x in (999, -999))
    np.minimum.at(low, tree, before)
    np.maximum.at(high, tree, before)
    keep = ((low != high) | (low < 0))[tree]
    places, common, before = places[keep], common[keep], before[keep]
    # the last member of an interval that differs from its neighbour to the left tells its diversity
    change = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))))
    for depth, a, z in intervals(common, least):
        if change[z] > change[a] or before[a] < 0:
            yield depth, places[a : z + 1]


def repeats_of(parts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, parts, places within them) of the maximal repeats of `length` bytes or more among the parts, inner ones first."""
    size = np.array([len(p) for p in parts], np.int64) + 1
    base = np.cumsum(size) - size
    # numbers of 32 bits: an array's working memory is many times its bytes
    of = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    ends = (base + size - 1).astype(np.int32)[of]
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    data[base + size - 1] = 0
    first = np.zeros(len(data), bool)
    first[base] = True
    for depth, places in maximal_repeats(data, ends, first, length):
        yield depth, of[places], places - base[of[places]]


#: A stretch: digest of its anchor, of all its bytes, its text, its place (PLACE bits: first window, 8 bits the anchor's place in it, 8 bits how many windows follow),
#: how often it occurs in its text, and where more than once all bytes that it covers there, as pairs of numbers.
STRETCH = "anchor long, one long, two long, tid binary, pos long, times long, all binary"


def _runs(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The maximal runs of bytes that the spans cover, as pairs; the spans come in order."""
    upto = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > upto[:-1]))
    return np.stack((begin[new], upto[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]), axis=1)


def _kinds(raw: bytes, length: int, gram: int) -> list[np.ndarray | list]:
    """The columns of STRETCH but tid of one text: a row for each kind of stretch in it."""
    blocks = list(stretches(np.frombuffer(raw, np.uint8), length, gram))
    anchor, first, last, at = (np.concatenate(c) for c in zip(*blocks, strict=True))
    digests = [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)]
    whole = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    pos = first << 16 | (at - first) << 8 | last - first
    times, every = np.ones(len(first), np.int64), [None] * len(first)
    if len(set(digests)) < len(digests):
        by: dict[bytes, list[int]] = {}
        for i, d in enumerate(digests):
            by.setdefault(d, []).append(i)
        one = np.array([x[0] for x in by.values()])
        times = np.array([len(x) for x in by.values()])
        every = [_runs(first[x], last[x] + length).tobytes() if len(x) > 1 else None for x in by.values()]
        anchor, whole, pos = anchor[one], whole[one], pos[one]
    return [anchor.view(np.int64), whole[:, 0], whole[:, 1], pos, times, every]


def _scan(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """STRETCH of texts(tid, text). Copies of a text within a task add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names = ["anchor", "one", "two", "tid", "pos", "times", "all"]

        def batch_of(held: list[list]) -> pa.RecordBatch:
            tid, *rest, every = zip(*held, strict=True)
            n = [len(x) for x in every]
            anchor, one, two, pos, times = (pa.array(np.concatenate(c)) for c in rest)
            tids = pa.array(tid, pa.binary()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            return pa.RecordBatch.from_arrays([anchor, one, two, tids, pos, times, pa.array([x for e in every for x in e], pa.binary())], names=names)

        for b in batches:
            held, rows = [], 0
            for tid, text in zip(b.column(0).to_pylist(), values(b.column(1)), strict=True):
                if not fresh(seen, tid, SEEN):
                    continue
                held.append([tid, *_kinds(text.encode(), length, gram)])
                rows += len(held[-1][1])
                if rows > 100_000:
                    yield batch_of(held)
                    held, rows = [], 0
            if held:
                yield batch_of(held)

    return texts.mapInArrow(run, STRETCH)


#: An example of a kind of stretch, or of some windows of one: the key that those share that may hold equal windows (two digests and the range of the anchor's
#: places in them), the digest of its bytes, the kind (anchor and digest) with its number of places, and the example: its text, its first window, how far that is
#: into the kind, the anchor's place in it, and the bytes.
PART = "k1 long, k2 long, low int, high int, one long, two long, anchor long, w1 long, w2 long, n long, tid binary, first long, skip int, at int, part binary"
FIELDS = [x.split()[0] for x in PART.split(", ")]
KEY, CLASS = FIELDS[:4], FIELDS[:6]


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    long, small = pa.int64(), pa.int32()
    kinds = (long, long, small, small, long, long, long, long, long, long, pa.binary(), long, small, small, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


def _cut(asked: DataFrame, length: int, gram: int) -> DataFrame:
    """PART of asked(tid, text, stretches): the bytes of the stretches that are asked for."""
    span = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for tid, text, wanted in zip(*map(values, b.columns), strict=True):
                if not fresh(seen, tid, SEEN):
                    continue
                raw = text.encode()
                for x in wanted:
                    first, at, more = x["pos"] >> 16, x["pos"] >> 8 & 255, x["pos"] & 255
                    kind = (x["anchor"], x["one"], x["two"])
                    out.append((x["anchor"], 0, 0, span, *kind[1:], *kind, x["n"], tid, first, 0, at, raw[first : first + more + length]))
                if len(out) > 20_000:
                    yield _part_batch(out)
                    out = []
            if out:
                yield _part_batch(out)

    return asked.mapInArrow(run, PART)


def _halved(parts: DataFrame, length: int) -> DataFrame:
    """PART of parts: the windows of each in two, by the anchor's place, under the bytes that all windows of a half share."""
    names = ("low", "high", "anchor", "w1", "w2", "n", "tid", "first", "skip", "at", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 10_000):
            out: list[tuple] = []
            for low, high, *kind, tid, first, skip, at, part in zip(*(b.column(k).to_pylist() for k in names), strict=True):
                least = at - (len(part) - length)  # the anchor's place in the last window
                middle = (low + high) // 2
                for x, y in ((low, middle), (middle, high)):
                    a, z = min(at, y - 1), max(least, x)  # in the first window of the half, and in the last
                    if a < z:
                        continue
                    own = part[at - a : at - z + length]
                    digests = xxhash.xxh3_128_digest(part[at - x : at - y + 1 + length]) + xxhash.xxh3_128_digest(own)
                    k1, k2, one, two = np.frombuffer(digests, np.int64).tolist()
                    out.append((k1, k2, x, y, one, two, *kind, tid, first + at - a, skip + at - a, a, own))
            if out:
                yield _part_batch(out)

    return parts.mapInArrow(run, PART)


def _levels(parts: DataFrame, length: int, group: int) -> list[DataFrame]:
    """Tables of PART with m (parts of the class) and kinds (classes of the key, at least two unless the class has several parts): one for each halving, until no key has more than `group`."""
    levels = []
    while True:
        classes = parts.groupBy(*CLASS).agg(F.count("*").alias("m"))
        sizes = classes.groupBy(*KEY).agg(F.count("*").alias("kinds"), F.sum("m").alias("rows")).filter("rows > 1").drop("rows")
        levels.append(written(parts.join(classes.join(sizes, KEY), CLASS), "crowd"))
        crowded = levels[-1].filter(F.col("kinds") > group)
        if not crowded.head(1):
            return levels
        parts = written(_halved(crowded, length), "halves")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of batches in tables of about GATHERED bytes that hold whole keys."""
    held: list[pa.RecordBatch] = []
    for b in small(batches, 1_000):
        held.append(b)
        if sum(x.nbytes for x in held) > GATHERED:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.searchsorted(t["k1"].to_numpy(), t["k1"][-1].as_py()))
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _covered(parts: DataFrame, length: int) -> DataFrame:
    """(tid, begin, end): of each place of a maximal repeat in the parts with n = m = 1 the longest one; equal strings have equal keys, so an array takes whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            part, first = t["part"].to_pylist(), t["first"].to_numpy()
            base = np.cumsum([0, *map(len, part)])
            longest = np.zeros(base[-1], np.int64)
            for size, of, place in repeats_of(part, length):
                at = base[of] + place
                longest[at] = np.maximum(longest[at], size)
            at = np.flatnonzero(longest)
            of = np.searchsorted(base, at, "right") - 1
            ok = t["alone"].to_numpy()[of]
            at, of = at[ok], of[ok]
            begin = first[of] + at - base[of]
            yield pa.RecordBatch.from_arrays([t["tid"].take(pa.array(of)).combine_chunks(), pa.array(begin), pa.array(begin + longest[at])], names=["tid", "begin", "end"])

    dealt = parts.select("k1", "tid", "first", "part", F.expr("n = 1 and m = 1").alias("alone")).repartition("k1").sortWithinPartitions("k1")
    return dealt.mapInArrow(run, "tid binary, begin long, end long")


def _listed(parts: DataFrame, length: int) -> DataFrame:
    """(r1, r2, size, *CLASS, place) of the maximal repeats in the parts: a digest of the repeat, its bytes, and all its places."""
    names = ["r1", "r2", "size", *CLASS, "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            part = t["part"].to_pylist()
            for size, of, place in repeats_of(part, length):
                p = int(place[0])
                r1, r2 = np.frombuffer(xxhash.xxh3_128_digest(part[int(of[0])][p : p + size]), np.int64)
                own = t.select(CLASS).take(pa.array(of)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(of), x)) for x in (r1, r2, size)), *(own[c].combine_chunks() for c in CLASS), pa.array(place)], names=names)

    dealt = parts.select(*CLASS, "part").repartition("k1").sortWithinPartitions("k1")
    return dealt.mapInArrow(run, "r1 long, r2 long, size long, k1 long, k2 long, low int, high int, one long, two long, place long")


class Found:
    """What one search leaves in the shared folder, and what can be asked of it.

    The texts(tid, text) have no nulls, and rows with equal tid have equal text: they are copies of one text.
    """

    def __init__(self, texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP):
        if not 0 < gram <= length or length - gram > 255:
            raise ValueError("an anchor has at least one byte, and at most 255 less than a repeat")
        if group < 2:
            raise ValueError("an array takes two kinds at least")
        self.length, self.group = length, group
        self.texts = texts.filter(F.octet_length("text") >= length)
        found = _scan(self.texts, length, gram)
        twice = found.groupBy("anchor").agg(F.sum("times").alias("total")).filter("total > 1").select("anchor")
        self.shared = written(found.join(twice, "anchor"), "stretches")
        kinds = self.shared.groupBy("anchor", "one", "two").agg(F.sum("times").alias("n"), F.first("tid").alias("tid"), F.first("pos").alias("pos"))
        self.kinds = written(kinds, "kinds")
        mixed = self.kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
        wanted = self.kinds.join(mixed, "anchor").groupBy("tid").agg(F.collect_list(F.struct("anchor", "one", "two", "n", "pos")).alias("stretches"))
        parts = _cut(self.texts.join(wanted, "tid").select("tid", "text", "stretches"), length, gram)
        # copies of a text that different tasks cut
        self.levels = _levels(written(parts.dropDuplicates(CLASS), "parts"), length, group)

    def _examples(self) -> DataFrame:
        """What the arrays take: one part of each class, of the keys that have at most `group` classes."""
        return _union([x.filter(F.col("kinds").between(2, self.group)).dropDuplicates(CLASS) for x in self.levels])

    def _again(self) -> DataFrame:
        """The stretches whose kind has more than one place."""
        return self.shared.join(self.kinds.filter("n > 1").select("anchor", "one", "two"), ["anchor", "one", "two"])

    def spans(self) -> DataFrame:
        """(tid, begin, end, all): the spans [begin, end) of a text's bytes that a repeat covers; all: several spans of one kind, as pairs of numbers."""
        none = F.lit(None).cast("binary").alias("all")
        first = F.shiftright("pos", 16)
        whole = self._again().select("tid", first.alias("begin"), (first + F.col("pos").bitwiseAND(F.lit(255)) + self.length).alias("end"), "all")
        # kinds of several places are covered as a whole, and so are classes of several parts
        rest = _covered(self._examples(), self.length).withColumn("all", F.lit(None).cast("binary"))
        classes = _union([x.filter("n = 1 and m > 1") for x in self.levels]).select("tid", F.col("first").alias("begin"), (F.col("first") + F.length("part")).alias("end"), none)
        copies = self.texts.groupBy("tid").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).alias("size")).filter("n > 1")
        return _union([whole, rest, classes, copies.select("tid", F.lit(0).cast("long").alias("begin"), F.col("size").cast("long").alias("end"), none)])

    def groups(self) -> DataFrame:
        """(repeat, size, tid, begin, times): the maximal repeats with all their places.

        repeat is a digest of the repeated bytes, size their number; begin is the first place in the text, and times
        how often the stretch around it occurs there. A text and its copies are one. Repeats end at the rims of their
        anchor's stretch; a longer one is a chain of groups that overlap. Groups nest, so that a place is listed under
        each repeat that stands there: the list can be longer than the texts. spans() reads only the longest ones.
        """
        name = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))).alias("repeat")
        first = F.shiftright("pos", 16)
        size = (F.col("pos").bitwiseAND(F.lit(255)) + self.length).cast("long").alias("size")
        whole = self._again().select(name("one", "two"), size, "tid", first.alias("begin"), "times")
        members = _union(self.levels).select(*CLASS, "m", "anchor", "w1", "w2", "skip", F.length("part").cast("long").alias("bytes"))
        classes = members.filter("m > 1").select(name("one", "two"), F.col("bytes").alias("size"), "anchor", "w1", "w2", F.col("skip").cast("long").alias("shift"))
        part = _listed(self._examples(), self.length).join(members, CLASS).select(name("r1", "r2"), "size", "anchor", "w1", "w2", (F.col("skip") + F.col("place")).alias("shift"))
        places = self.shared.select("anchor", F.col("one").alias("w1"), F.col("two").alias("w2"), "tid", first.alias("low"), "times")
        rims = classes.union(part).join(places, ["anchor", "w1", "w2"]).select("repeat", "size", "tid", (F.col("low") + F.col("shift")).alias("begin"), "times")
        return whole.union(rims).distinct()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def repeat_groups(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Found.groups() of the texts of docs; tid is text_id() of a text. Null texts hold none; an empty table gives no rows."""
    text = F.col(f"`{text_col}`")
    return Found(docs.filter(text.isNotNull()).select(text_id(text).alias("tid"), text.alias("text")), length, gram, group).groups()


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    flat = [(s["begin"], s["end"]) for s in spans or () if not s["all"]]
    for s in spans or ():
        if s["all"]:
            flat += map(tuple, np.frombuffer(s["all"], np.int64).reshape(-1, 2).tolist())
    for b, e in sorted(flat):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, new_text: bool = False) -> DataFrame:
    """Every row of docs with n_bytes, n_removed, n_spans and kept_sha256, as its text is without repeated bytes.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the same text or another;
    all occurrences go. Null text is empty. Repeated rows are repeats of each other and each keep their row. Texts
    shorter than `length` stay as they are. Other columns pass through; those named like the results are replaced.
    new_text replaces the text by what is left; a character goes only with all its bytes, so that the rest is text.
    """
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    keep = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tid, own = unused("tid", keep), unused("spans", keep)
    found = Found(docs.select(text_id(text).alias("tid"), text.alias("text")), length, gram, group)
    spans = found.spans().groupBy("tid").agg(F.collect_set(F.struct("begin", "end", "all")).alias(own)).withColumnRenamed("tid", tid)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_id(text).alias(tid)).join(spans, tid, "left").select(*[f"`{c}`" for c in keep], own)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            facts: list[list] = [[], [], [], []]
            texts: list[str | None] = []
            for text, spans in zip(values(b.column(at)), values(b.column(len(keep))), strict=True):
                raw = (text or "").encode()
                runs = merged(spans)
                kept, done = [], 0
                for x, y in runs:
                    kept.append(raw[done:x])
                    done = y
                kept.append(raw[done:])
                for c, x in zip(facts, (len(raw), sum(y - x for x, y in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                    c.append(x)
                texts.append(_whole_characters(raw, runs).decode() if new_text and runs else text)
            columns = list(b.columns[: len(keep)])
            if new_text:
                columns[at] = pa.array(texts, pa.string())
            arrays = [pa.array(c, k) for c, k in zip(facts, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*keep, *new])

    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields])
    return rows.mapInArrow(run, schema)


def _whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """raw without the runs, each narrowed to whole characters."""
    kept, done = [], 0
    for x, y in runs:
        while x < len(raw) and raw[x] & 0xC0 == 0x80:
            x += 1
        while y < len(raw) and raw[y] & 0xC0 == 0x80:
            y -= 1
        if x < y:
            kept.append(raw[done:x])
            done = y
    return b"".join([*kept, raw[done:]])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that occur twice."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
