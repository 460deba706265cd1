"""Token ids of documents as Parquet files that can be read in parts.

A table of token files has the documents in ascending order of their ids, dealt by ranges, so that file k holds those
before file k + 1. Ids are a list column, delta encoded or by a dictionary; row groups and pages have set sizes, and
pages have an index. Each row says how many ids its file holds before it, and a small table beside the files how many
all files before them hold. A reader of some documents, of a stretch of ids or of the columns without ids is thus
served by the row groups and pages that have them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import pretokens, token_counts
from .common import shared_path, small, table

END = 2
#: Characters split at once, rows of a slice, and distinct pre-tokens whose ids a worker keeps.
SLICE, ROWS, KEPT = 2_000_000, 1000, 500_000
ROW_GROUP, PAGE, PAGE_ROWS = 64 << 20, 256 << 10, 1000
OWN = ("part", "at", "n_tokens", "ids")


@cache
def letters() -> np.ndarray:
    """The character by which the library's byte-level vocabularies write each byte: visible ones of Latin-1 stand for themselves, the others follow from 256 on."""
    seen = np.zeros(256, bool)
    for a, b in ((33, 126), (161, 172), (174, 255)):
        seen[a : b + 1] = True
    return np.where(seen, np.arange(256), 255 + np.cumsum(~seen)).astype(np.uint32)


class Encoder:
    """The library's ids of texts. Each pre-token goes through the library's model once while the worker keeps it."""

    def __init__(self, path: str):
        self.library, self.added = token_counts.tokenizer(path)
        self.model = self.library.model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _known(self, words: list[str]) -> np.ndarray:
        """The numbers of the words, of which those not kept are encoded first."""
        if len(self.number) > KEPT:
            self._forget()
        new = [w for w in words if w not in self.number]
        if new:
            tokenize = self.model.tokenize
            found = [[t.id for t in tokenize(w)] for w in new]
            length = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(length.sum()))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(length) - length))
            self.length, self.ids = np.concatenate((self.length, length)), np.concatenate((self.ids, flat))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        # the library cuts its added tokens out of a text first; texts that hold one go through it whole
        whole = [any(a in t for a in self.added) for t in texts]
        for i in np.flatnonzero(whole):
            out[i].append(np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32))
        for number, group in pretokens.slices(["" if w else t for t, w in zip(texts, whole, strict=True)], SLICE):
            s = pretokens.split(group)
            first, which = distinct(s)
            known = self._known(written_words(s, first))[which]
            n = self.length[known]
            ids = pretokens.gather(self.ids, self.begin[known], n)
            count = np.bincount(s.text, weights=n, minlength=len(group)).astype(np.int64)
            for i, part in zip(number.tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=True):
                out[i].append(part)
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]


def written_words(s: pretokens.Split, which: np.ndarray) -> list[str]:
    """The pre-tokens of these numbers, a letter a byte."""
    wide = 1 + (s.codes >= 0x80) + (s.codes >= 0x800) + (s.codes >= 0x10000).astype(np.int32)
    at = np.concatenate(([0], np.cumsum(wide)))
    begin, length = at[s.start[which]], at[s.end[which]] - at[s.start[which]]
    data = letters()[pretokens.gather(np.frombuffer(s.joined.encode(), np.uint8), begin, length)]
    text, end = data.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(length)
    return [text[a:b] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]


def distinct(s: pretokens.Split) -> tuple[np.ndarray, np.ndarray]:
    """pretokens.distinct by a hash table in place of sorting; where the hashes don't tell all pre-tokens apart, by that one."""
    n = len(s.codes)
    pw = pretokens.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((s.codes.astype(np.uint64) + np.uint64(0x51ED270B)) * pw[:n], out=total[1:])
    length = (s.end - s.start).astype(np.int32)
    h = (total[s.end] - total[s.start]) * pw[n - s.start]
    which, kinds = pd.factorize((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + length.astype(np.uint64))
    first = np.empty(len(kinds), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    # pre-tokens follow each other without gaps but for the line ends between texts, so the characters are compared in place
    own = np.repeat((s.start[first][which] - s.start).astype(np.int32), length)
    at = np.repeat((s.start - (np.cumsum(length, dtype=np.int64) - length)).astype(np.int32), length)
    at += np.arange(len(at), dtype=np.int32)
    if np.array_equal(length, length[first][which]) and np.array_equal(s.codes[at], s.codes[at + own]):
        return first, which
    return pretokens.distinct(s)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = END, encoding: str = "delta", metadata: tuple[str, ...] = (), row_group: int = ROW_GROUP, page: int = PAGE,
    page_rows: int = PAGE_ROWS, files: int | None = None,
) -> None:
    """Writes docs(doc_id, text, metadata...) as token files below path, and the table of the files beside them.

    tokenizer is a byte-level file of the tokenizers library; strings of its added tokens within a text become these
    tokens, and `end` follows each document. encoding is delta or dictionary, of the ids; row_group and page are
    bytes, page_rows a page's rows at most, files their number (else by the session's shuffle partitions). Null text
    is empty and has the end id alone. Null doc_ids come last; rows of one doc_id follow by their texts, so repeated
    rows come one after the other with equal ids. An empty table makes no rows. Columns other than metadata aren't
    written, and metadata can't have a name of a column made here, in any letter case.

    Texts are shuffled once, by ranges of doc_id; a task sorts its range, encodes it and writes one file.
    """
    if clash := {c.lower() for c in metadata} & {"doc_id", *OWN}:
        raise ValueError(f"{sorted(clash)}: names of the token files' own columns")
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"{encoding}: neither delta nor dictionary")
    spark = docs.sparkSession
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in metadata], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = keep.repartitionByRange(files, *order) if files else keep.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order, "text")
    schema = StructType([*dealt.drop("text").schema.fields, *StructType.fromDDL("part int, at long, n_tokens long, ids array<int>").fields])
    last = np.array([] if end is None else [end], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in small(batches, ROWS):
            ids = [np.concatenate((x, last)) for x in e.encode(b.column(b.num_columns - 1).to_pylist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate(([0], np.cumsum(n)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, last[:0]]), pa.int32()))
            arrays = [*b.columns[:-1], pa.array(np.full(len(ids), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(n), lists]
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], *OWN])

    # version 2 writes integers without a dictionary as deltas in packed blocks
    plain = ("doc_id", "at", "n_tokens") if encoding == "dictionary" else ("doc_id", "at", "n_tokens", "ids.list.element")
    options = {f"parquet.enable.dictionary#{c}": "false" for c in plain} | {
        "parquet.writer.version": "v2", "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.row.count.limit": str(page_rows),
        "parquet.page.size.row.check.min": "10", "parquet.page.size.row.check.max": "50", "parquet.block.size.row.check.min": "10", "parquet.block.size.row.check.max": "50", "compression": "zstd",
    }
    dealt.mapInArrow(run, schema).write.options(**options).parquet(f"{path}/tokens")
    rows = spark.read.schema(schema).parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    rows.withColumn("file_start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/files")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(part, rows, tokens, first_doc, last_doc, file_start): a row for each file, in the order of part."""
    return spark.read.schema("part int, rows long, tokens long, first_doc long, last_doc long, file_start long").parquet(f"{path}/files")


def _placed(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """rows with start, the number of ids of all documents before: a file's share joins its rows."""
    f = files(spark, path).select(F.col("part").alias("f_part"), "file_start")
    return rows.join(f, F.col("part") == F.col("f_part")).withColumn("start", F.col("file_start") + F.col("at")).drop("f_part", "file_start", "part", "at")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns but the ids, with start: the ids' pages aren't read."""
    return _placed(spark, spark.read.parquet(f"{path}/tokens").drop("ids"), path)


def read_documents(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of doc_id from low to high, both included: row groups and pages of others are skipped by their statistics."""
    rows = spark.read.parquet(f"{path}/tokens")
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return _placed(spark, rows, path)


def read_stretch(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): the ids from place start to before stop of all documents' ids one after the other, by document. The first and last file that hold some are looked up, and the scan skips others."""
    inside = (F.col("file_start") < stop) & (F.col("file_start") + F.col("tokens") > start)
    low, high = files(spark, path).filter(inside).agg(F.min("part"), F.max("part")).first()
    rows = spark.read.parquet(f"{path}/tokens").filter(F.col("part").between(F.lit(low), F.lit(high)))
    x = _placed(spark, rows, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    begin = F.greatest(F.col("start"), F.lit(start))
    ids = F.slice("ids", (begin - F.col("start") + 1).cast("int"), (F.least(F.col("start") + F.col("n_tokens"), F.lit(stop)) - begin).cast("int"))
    return x.select(begin.alias("start"), ids.alias("ids"))


def digests(rows: DataFrame) -> DataFrame:
    """rows(..., ids) with the ids' CRC-32 as little-endian unsigned 32-bit integers, and their number as read, in place of them. Null ids count as none."""
    at, names = rows.columns.index("ids"), [c for c in rows.columns if c not in ("ids", "n_tokens", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, ROWS):
            ids = b.column(at)
            n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            stop = np.cumsum(n) * 4
            sums = [zlib.crc32(flat[a:z]) for a, z in zip((stop - 4 * n).tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n), pa.array(sums, pa.int64())], names=[*names, "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, StructType([*rows.select(*names).schema.fields, *StructType.fromDDL("n_tokens long, ids_crc32 long").fields]))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as token files with language and source, and read back."""
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), metadata=("lang", "source"))
    rows = digests(spark.read.parquet(f"{path}/tokens").select("doc_id", "part", "at", "ids"))
    return _placed(spark, rows, path).select("doc_id", "start", "n_tokens", "ids_crc32")
