"""Byte-level BPE on padded matrices.

Pre-tokens of like length form a matrix of ids. In each round every row merges its leftmost pair of least rank;
ranks come from a hash table of pairs, kept from round to round but for the two pairs beside the merge. Rows
without a pair left leave the matrix, and columns that no row needs any more are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import pretokens
from .common import small, table

NONE = np.int32(2**31 - 1)
#: Longer pre-tokens each have a matrix of their own, of one row.
WIDEST = 256
#: Characters handled at once; bounds a worker's memory.
SLICE = 500_000


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing over arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slot, self.reach = self._slot(keys), 0
        while len(keys):
            # of the keys that want a free slot, one gets it; the others try the next
            free = self.keys[slot] < 0
            _, winner = np.unique(np.where(free, slot, -1), return_index=True)
            winner = winner[free[winner]]
            self.keys[slot[winner]], self.values[slot[winner]] = keys[winner], values[winner]
            rest = np.ones(len(keys), bool)
            rest[winner] = False
            keys, values, slot = keys[rest], values[rest], slot[rest] + 1
            self.reach += 1
            if len(slot) and slot.max() >= len(self.keys):
                more = len(self.keys)
                self.keys = np.concatenate((self.keys, np.full(more, -1, np.int64)))
                self.values = np.concatenate((self.values, np.full(more, NONE, np.int32)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair has no token; negative ids (padding) never have."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(keys), NONE, np.int32)
        slot = self._slot(keys)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for step in range(self.reach):
            if not len(todo):
                break
            at = slot[todo] + step
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Ranks of byte strings; the rank is the id. Each single byte must have one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for t, r in ranks.items():
            tokens[r] = t
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_begin = np.cumsum(self.token_length) - self.token_length
        words = [f"{i} ".encode() for i in range(top)]
        self.word_bytes = np.frombuffer(b"".join(words), np.uint8)
        self.word_length = np.array([len(w) for w in words], np.int64)
        self.word_begin = np.cumsum(self.word_length) - self.word_length
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = r
        self.pairs = PairTable(pairs)

    def encode_bytes(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte strings data[begin:begin+length], one after the other, and how many each has."""
        count = np.zeros(len(begin), np.int64)
        rows: list[tuple[np.ndarray, np.ndarray]] = []  # (numbers of the strings, their ids one after the other)
        widths = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, WIDEST]
        low = 0
        for width in widths:
            who = np.flatnonzero((length > low) & (length <= width))
            low = width
            for part in np.array_split(who, max(1, len(who) * width // 4_000_000 + 1)):
                if len(part):
                    self._matrix(data, begin, length, part, width, count, rows)
        for i in np.flatnonzero(length > WIDEST):
            ids = self._row(self.of_byte[data[begin[i] : begin[i] + length[i]]])
            count[i] = len(ids)
            rows.append((np.array([i]), ids))
        flat = np.empty(int(count.sum()), np.int32)
        at = np.cumsum(count) - count
        for who, ids in rows:
            n = count[who]
            flat[np.repeat(at[who] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, count

    def _matrix(self, data, begin, length, who, width, count, rows) -> None:
        column = np.arange(width)
        real = column < length[who][:, None]
        ids = np.where(real, self.of_byte[data[np.minimum(begin[who][:, None] + column, len(data) - 1)]], np.int32(-1))
        left = length[who].copy()
        if width > 1:
            rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(who), width - 1)
        else:
            rank = np.full((len(who), 1), NONE, np.int32)
        while len(who):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            open_ = best != NONE
            if not open_.all():
                done = ~open_
                n = left[done]
                count[who[done]] = n
                rows.append((who[done], ids[done][np.arange(ids.shape[1]) < n[:, None]]))
                who, ids, rank, left, at, best = who[open_], ids[open_], rank[open_], left[open_], at[open_], best[open_]
                if not len(who):
                    return
            left -= 1
            keep = int(left.max())
            column = np.arange(keep)
            ids[np.arange(len(who)), at] = best
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            ids[column >= left[:, None]] = -1
            if keep > 1:
                pair = column[:-1]
                rank = np.take_along_axis(rank, np.minimum(pair + (pair > at[:, None]), rank.shape[1] - 1), axis=1)
                rank[pair >= left[:, None] - 1] = NONE
                line = np.arange(len(who))
                for side in (at - 1, at):
                    ok = np.flatnonzero((side >= 0) & (side < left - 1))
                    rank[line[ok], side[ok]] = self.pairs.get(ids[line[ok], side[ok]], ids[line[ok], side[ok] + 1])
            else:
                rank = np.full((len(who), 1), NONE, np.int32)

    def _row(self, ids: np.ndarray) -> np.ndarray:
        """A matrix of one row. A round makes the merges that the next rounds would, from the left: those of the same pair, up to the first after which another pair ranks lower."""
        rank = np.append(self.pairs.get(ids[:-1], ids[1:]), NONE)
        while (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # of pairs that overlap, the first, third and so on
            run = np.cumsum(np.concatenate(([True], at[1:] != at[:-1] + 1))) - 1
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            if len(at) > 1:
                merged, end = np.full(len(at), best, np.int32), np.append(ids, np.int32(-1))
                before = np.where(at > 0, ids[at - 1], np.int32(-1))
                before[1:][at[1:] == at[:-1] + 2] = best
                lower = np.minimum(self.pairs.get(before, merged), self.pairs.get(merged, end[at + 2])) < best
                if lower.any():
                    at = at[: lower.argmax() + 1]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            rank[-1] = NONE
            at = at - np.arange(len(at))
            for side in (at - 1, at):
                side = side[(side >= 0) & (side < len(ids) - 1)]
                rank[side] = self.pairs.get(ids[side], ids[side + 1])
        return ids


@cache
def vocabulary(path: str) -> Vocabulary:
    """From a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_texts(v: Vocabulary, texts: list[str], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the texts, ids, number of ids of each) by slices of the texts, in order; a long text comes in several."""
    for number, group in pretokens.slices(texts, most):
        s = pretokens.split(group)
        rep, which = pretokens.distinct(s)
        data = np.frombuffer(s.joined.encode(), np.uint8)
        wide = 1 + (s.codes >= 0x80) + (s.codes >= 0x800).astype(np.int64) + (s.codes >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(wide)))
        begin, end = byte_at[s.start[rep]], byte_at[s.end[rep]]
        flat, count = v.encode_bytes(data, begin, end - begin)
        ids = pretokens.gather(flat, (np.cumsum(count) - count)[which], count[which]) if len(which) else flat
        yield number, ids, np.bincount(s.text, weights=count[which], minlength=len(group)).astype(np.int64)


def decode_ids(v: Vocabulary, ids: np.ndarray) -> bytes:
    return pretokens.gather(v.token_bytes, v.token_begin[ids], v.token_length[ids]).tobytes()


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every row with n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 and, if asked for, ids.

    Narrow: one pass over whole texts, without a shuffle. Null text is empty and has no ids. Long texts are cut
    where a match always ends, so that memory doesn't grow with them. Other columns pass through; those named
    like the results are replaced. path: the rank file, readable on every worker (part of an installed package).
    """
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {})
    rest = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in small(batches):
            texts = [x or "" for x in b.column(at).to_pylist()]
            total = np.zeros(len(texts), np.int64)
            hashes = [None] * len(texts)
            kept: list[list[np.ndarray]] = [[] for _ in texts] if keep_ids else []
            for number, ids, counts in encode_texts(v, texts):
                words = pretokens.gather(v.word_bytes, v.word_begin[ids], v.word_length[ids]).tobytes()
                plain = decode_ids(v, ids)
                upto = np.cumsum(counts)
                word_at = np.concatenate(([0], np.cumsum(v.word_length[ids])))
                plain_at = np.concatenate(([0], np.cumsum(v.token_length[ids])))
                for i, n, e in zip(number.tolist(), counts.tolist(), upto.tolist(), strict=True):
                    w, p = words[word_at[e - n] : word_at[e]], plain[plain_at[e - n] : plain_at[e]]
                    if hashes[i] is None:
                        hashes[i] = (sha256(w[:-1]), sha256(p))
                    else:  # a later slice of a long text
                        hashes[i][0].update((b" " if total[i] and n else b"") + w[:-1])
                        hashes[i][1].update(p)
                    total[i] += n
                    if keep_ids:
                        kept[i].append(ids[e - n : e])
            empty = (sha256(), sha256())
            hashes = [h or empty for h in hashes]
            arrays = [*b.columns, pa.array(total), pa.array([h[0].hexdigest() for h in hashes]), pa.array([h[1].hexdigest() for h in hashes])]
            if keep_ids:
                arrays.append(pa.array([np.concatenate(k) if k else np.empty(0, np.int32) for k in kept], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, *new])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields) + StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public byte-level vocabulary and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")
