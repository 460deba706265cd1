"""Periodic runs of words by a suffix automaton.

Each state of the automaton of a word sequence stands for strings that end at the same positions. Going from long
states to short ones, the sets of end positions are merged along the suffix links, the smaller into the larger. Two
positions that become neighbours in a state's set at a distance d of at most the state's length seed a repetition of
period d, which is then extended to its run. The distance between neighbours is the smallest period: a smaller one
would put another end position between them. And no run is missed: its part without the last period occurs twice, a
period apart, with no occurrence between, in a state at least as long as that part.

Runs of at least e periods also bound what has to be looked at: each three consecutive words of one occur in it at
least e - 1 times. Stretches whose triples are rarer in their text hold no such run and get no automaton.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, small, table

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Bytes of text whose words are held at once; a longer text comes alone.
SLICE = 4_000_000
RUN = "array<struct<start:long,length:long,period:long>>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, end position or -1 for copies) of the states of the suffix automaton; state 0 is the empty string."""
    length, link, end = [0], [-1], [-1]
    # most states have one way on, kept in two lists; further ones are in dicts
    by, to, more = [-1], [-1], {}
    last = 0
    for i, c in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        by.append(-1)
        to.append(-1)
        p, q = last, -1
        while p >= 0:
            if by[p] == c:
                q = to[p]
                break
            ways = more.get(p)
            if ways is not None:
                q = ways.get(c, -1)
                if q >= 0:
                    break
                ways[c] = new
            elif by[p] < 0:
                by[p], to[p] = c, new
            else:
                more[p] = {c: new}
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                by.append(by[q])
                to.append(to[q])
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0:
                    if by[p] == c and to[p] == q:
                        to[p] = copy
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def seeds(words: list[int], min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, period) of stretches that repeat with the period at least min_exponent times; each run holds one, and some come often."""
    length, link, end = automaton(words)
    parts: dict[int, list[list[int]]] = {}
    for v in np.argsort(-np.array(length, np.int64), kind="stable").tolist():
        sets = parts.pop(v, [])
        if end[v] >= 0:
            sets.append([-end[v]])  # negated: in periodic texts the next position then goes to the end of a list
        most = length[v] // (min_exponent - 1)
        if not most:
            break  # this state and all that follow are too short to seed
        whole = max(sets, key=len)
        new = sorted(chain.from_iterable(x for x in sets if x is not whole))
        if len(new) * 8 < len(whole):
            for x in new:
                insort(whole, x)
        elif new:
            whole = sorted(whole + new)
        for x in new:
            k = bisect_left(whole, x)
            if k and x - whole[k - 1] <= most:
                yield -x - length[v] + 1, -whole[k - 1], x - whole[k - 1]
            if k + 1 < len(whole) and whole[k + 1] - x <= most:
                yield -whole[k + 1] - length[v] + 1, -x, whole[k + 1] - x
        parts.setdefault(link[v], []).append(whole)


def _same(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on are equal, going by step (1 or -1); b is the larger."""
    n, block = 0, 16
    while True:
        size = min(block, len(words) - b - n if step > 0 else a - n + 1)
        if size <= 0:
            return n
        lo_a, lo_b = (a + n, b + n) if step > 0 else (a - n - size + 1, b - n - size + 1)
        differ = words[lo_a : lo_a + size] != words[lo_b : lo_b + size]
        if differ.any():
            return n + int((differ if step > 0 else differ[::-1]).argmax())
        n, block = n + size, block * 4


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least min_words words and min_exponent periods, by start and period."""
    found: dict[int, tuple[list[int], list[int]]] = {}  # period -> first and last words of its runs
    out = []
    for first, last, d in seeds(words.tolist(), min_exponent):
        starts, ends = found.setdefault(d, ([], []))
        k = bisect_left(starts, first + 1) - 1
        if k >= 0 and ends[k] >= last:
            continue
        first -= _same(words, first - 1, first - 1 + d, -1)
        last += _same(words, last + 1 - d, last + 1, 1)
        k = bisect_left(starts, first)
        starts.insert(k, first)
        ends.insert(k, last)
        if last - first + 1 >= max(min_words, min_exponent * d):
            out.append((first, last - first + 1, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, text: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """(from, to) of stretches of the joined texts outside which no run lies; a triple counts within its text, then within its stretch."""
    n, least = len(ids), min(min_exponent - 1, max(min_words, min_exponent) - 2)
    bounds = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    parts = np.stack((bounds[:-1], bounds[1:]), axis=1) if n else np.empty((0, 2), np.int64)
    if least < 2:
        return [(a, b) for a, b in parts.tolist() if b - a >= min_words]
    x = ids.astype(np.uint64)
    triple = np.zeros(n, np.uint64)
    triple[: max(0, n - 2)] = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] if n > 2 else 0
    for _ in range(8):  # any number of rounds is right; each only drops what holds no run
        size = parts[:, 1] - parts[:, 0] - 2
        parts, size = parts[size >= max(min_words, min_exponent) - 2], size[size >= max(min_words, min_exponent) - 2]
        if not len(parts):
            break
        total = int(size.sum())
        of = np.repeat(np.arange(len(parts)), size)
        at = np.arange(total) + np.repeat(parts[:, 0] - (np.cumsum(size) - size), size)
        h = (triple[at] ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        bits = max(10, (8 * total - 1).bit_length())
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)  # triples that share a slot only keep more
        often = np.bincount(slot, minlength=1 << bits)[slot] >= least
        edge = np.flatnonzero(np.diff(np.where(often, of, -1), prepend=-1, append=-1))
        a, b = edge[:-1], edge[1:]
        a, b = a[often[a]], b[often[a]]
        new = np.stack((at[a], at[b - 1] + 3), axis=1)
        if len(new) == len(parts) and (new == parts).all():
            break
        parts = new
    return [(a, b) for a, b in parts.tolist() if b - a >= min_words]


def text_runs(words: list[list[bytes]], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ids = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for a, b in _stretches(ids, text, min_words, min_exponent):
        i = int(text[a])
        shift = a - int(begin[i])
        out[i] += [(s + shift, n, p) for s, n, p in runs_of(ids[a:b], min_words, min_exponent)]
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, n, period in runs:
            change[start + period] += 1
            change[start + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode()


def periodic_runs(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """df with n_words, runs (by start, then period; words count from 0) and collapsed, the text without repetitions.

    A run is a maximal stretch of words with smallest period q, of at least min_words words and min_exponent periods
    (an integer of 2 at least). collapsed drops each word that some run holds after its first q words, and joins the
    others by one space. Words are parted by space and the bytes 9 to 13. Null text has no words, and an empty
    collapsed text; so has a text of white space. Repeated rows stay as they are, each with its own result; an empty
    table gives no rows. Extra columns pass through, and the columns made here replace any of the same name. Each
    text is handled by itself, so copies in any number cost no more than other texts; nothing is shuffled, and a lost
    task is simply run again. A very long text needs memory for its words, and an automaton of its periodic parts.
    """
    if min_exponent < 2 or min_words < 1:
        raise ValueError("min_exponent has to be 2 at least, and min_words 1")
    new = {"n_words": "long", "runs": RUN, "collapsed": "string"}
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c == text or c not in new])
    if text in new:
        raise ValueError(f"{text}: the text's column has the name of a result")
    schema = StructType(list(rows.schema.fields) + StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields)
    position = rows.columns.index(text)
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            low, size = 0, 0
            bytes_ = pc.binary_length(b.column(position)).fill_null(0).to_pylist()
            for i, n in enumerate([*bytes_, SLICE]):
                if i > low and size + n > SLICE or i == b.num_rows:
                    part = b.slice(low, i - low)
                    words = [x.encode().split() if x else [] for x in part.column(position).to_pylist()]
                    runs = text_runs(words, min_words, min_exponent)
                    arrays = [
                        pa.array(map(len, words), pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], struct),
                        pa.array([_collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.string()),
                    ]
                    if part.num_rows:
                        yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*b.schema.names, *new])
                    low, size = i, 0
                size += n

    return rows.mapInArrow(run, schema)


def with_repetitions(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df whose texts of every tenth document repeat themselves from a word on: the query's input.

    h is the CRC-32 of the decimal id and g a tenth of it. If h % 10 is 0, the words from a = g % n on repeat the
    first 1 + (n - a) div (3 + g % 8) of them. A null id, and a text without words, leave the text as it is.
    """
    words, h = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), F.crc32(F.col(doc_id).cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = F.pmod(g, n)
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return df.withColumn(text, F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col(text)))


def longest(runs: Column) -> Column:
    """The run of the greatest exact exponent, of equal ones the first; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(more(a, r), r).otherwise(a))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of four periods and six words at least, after every tenth document was made to repeat itself."""
    docs = with_repetitions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = periodic_runs(docs).select("doc_id", "runs", "collapsed", longest(F.col("runs")).alias("top"))
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
