"""Token counts without token ids.

Two passes split the texts into pre-tokens. The first gathers the distinct ones, and the library counts the pieces
of each once. The second gives, for each batch of documents, every pre-token with the documents that hold it and
how often; joined to the counts, these add up to the documents' token counts. Entries are three bytes, so that
even a pre-token of nearly all documents is a small part of the rows, and the join can be split by Spark where
it is skewed, since the counts have one row a pre-token. The sums go back to their batch as a block a task.

Pre-tokens that are entries of the vocabulary, which is of fixed size, are counted once where the texts are split
and take no part in the join; the most frequent ones are among them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from . import pretokens
from .common import table

#: Characters split at once, and rows of a slice (their numbers take 16 bits).
SLICE, ROWS = 2_000_000, 50_000
ENTRY = np.dtype([("row", "<u2"), ("times", "u1")])
SUM = np.dtype([("row", "<u2"), ("tokens", "<u4")])
#: Sums that a task holds before it hands them on.
HELD = 1_000_000
LIMIT = 512


@cache
def tokenizer(path: str):
    """The library's tokenizer, and its added tokens' strings: it cuts those out of a text first."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec.get("normalizer") or any((spec.get("pre_tokenizer") or {}).get(k) != x for k, x in plain.items()):
        raise ValueError(f"{path}: only byte-level vocabularies without a normalizer or prefix space are supported")
    added = spec.get("added_tokens", [])
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
        raise ValueError(f"{path}: added tokens that strip or need word bounds are not supported")
    t.no_truncation()
    t.no_padding()
    return t, sorted((x["content"] for x in added), key=len, reverse=True)


@cache
def known(path: str) -> tuple[pa.StringArray, np.ndarray]:
    """The vocabulary's entries that are pre-tokens, and how many pieces each has."""
    t = tokenizer(path)[0]
    words = sorted({t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size(with_added_tokens=False))})
    words = [w for w in words if w and "\ufffd" not in w and "\n" not in w]
    s = pretokens.split(words)
    whole = np.bincount(s.text, minlength=len(words)) == 1
    words = [w for w, ok in zip(words, whole.tolist(), strict=True) if ok]
    return pa.array(words, pa.string()), np.array([len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)], np.int64)


def _parts(texts: list[str], added: list[str]) -> tuple[list[int], list[str], np.ndarray]:
    """The texts between added tokens, whose text each is of, and how many added tokens each text has."""
    import re

    special = np.zeros(len(texts), np.int64)
    pattern = re.compile("|".join(map(re.escape, added))) if added else None
    number, parts = [], []
    for i, text in enumerate(texts):
        found = pattern.split(text) if pattern and any(a in text for a in added) else [text]
        special[i] = len(found) - 1
        number += [i] * len(found)
        parts += found
    return number, parts, special


def _strings(s: pretokens.Split, which: np.ndarray) -> pa.StringArray:
    """The pre-tokens of these numbers."""
    data = np.frombuffer(s.joined.encode(), np.uint8)
    wide = 1 + (s.codes >= 0x80) + (s.codes >= 0x800).astype(np.int64) + (s.codes >= 0x10000)
    at = np.concatenate(([0], np.cumsum(wide)))
    begin, end = at[s.start[which]], at[s.end[which]]
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(pretokens.gather(data, begin, end - begin)))


def _batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        for low in range(0, b.num_rows, ROWS):
            part = b.slice(low, ROWS)
            yield part, [x or "" for x in part.column(at).to_pylist()]


def piece_counts(texts: DataFrame, path: str) -> DataFrame:
    """(pretoken, pieces): every distinct pre-token of the texts, counted once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = tokenizer(path)[1]
        for _, group in _batches(batches, 0):
            found, entries = pa.array([], pa.string()), known(path)[0]
            for _, part in pretokens.slices(_parts(group, added)[1], SLICE):
                s = pretokens.split(part)
                words = _strings(s, pretokens.distinct(s)[0])
                found = pa.concat_arrays([found, words.filter(pc.invert(pc.is_in(words, entries)))]).unique()
                if len(found) > HELD:
                    yield pa.RecordBatch.from_arrays([found], names=["pretoken"])
                    found = found[:0]
            yield pa.RecordBatch.from_arrays([found], names=["pretoken"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)[0]
        for b in batches:
            words = b.column(0).to_pylist()
            pieces = [len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.int32())], names=["pretoken", "pieces"])

    return texts.mapInArrow(gather, "pretoken string").distinct().mapInArrow(count, "pretoken string, pieces int")


def _postings(docs: DataFrame, path: str, first_partition: int = 0) -> DataFrame:
    """Per batch of rows: (pretoken, batch, entries), and one row with the rows' ids, sizes and what is counted already.

    That row's pre-token is a NUL and a number, which is no match of the pattern, so it spreads over the join's
    partitions and meets no count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, (entry_words, entry_pieces) = tokenizer(path)[1], known(path)
        batch = (TaskContext.get().partitionId() + first_partition) << 32
        names = ["pretoken", "batch", "entries", "rows"]
        for b, texts in _batches(batches, 1):
            number, parts, counted = _parts(texts, added)
            number = np.array(number, np.int64)
            words, pairs, held = [], [], 0

            def merged() -> pa.RecordBatch:
                """A row for each unknown pre-token of the slices held, with its entries one after the other; the known ones are counted."""
                both = pa.concat_arrays(words).dictionary_encode()
                code = both.indices.to_numpy()
                shift = np.cumsum([0, *map(len, words[:-1])])
                word = np.concatenate([code[w + k] for k, (w, _) in zip(shift, pairs, strict=True)])
                entries = np.concatenate([e for _, e in pairs])
                place = pc.index_in(both.dictionary, entry_words).fill_null(-1).to_numpy()
                of = place[word]
                here = of >= 0
                counted[:] += np.bincount(entries["row"][here], weights=entry_pieces[of[here]] * entries["times"][here], minlength=len(counted)).astype(np.int64)
                rest = np.flatnonzero(place < 0)
                renumbered = np.full(len(place), -1)
                renumbered[rest] = np.arange(len(rest))
                word, entries = renumbered[word[~here]], entries[~here]
                entries = entries[np.argsort(word, kind="stable")]
                upto = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(rest))))) * ENTRY.itemsize
                blobs = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(entries.tobytes())])
                return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(rest)), pa.array(np.full(len(rest), batch)), blobs, pa.nulls(len(rest), rows_type)], names=names)

            rows_type = pa.list_(pa.struct([("id", b.schema.field(0).type), ("n_bytes", pa.int64()), ("counted", pa.int64())]))
            for of, part in pretokens.slices(parts, SLICE):
                s = pretokens.split(part)
                rep, which = pretokens.distinct(s)
                if not len(rep):
                    continue
                pair, times = np.unique(which.astype(np.int64) * ROWS + number[of][s.text], return_counts=True)
                more = -(-times // 255)  # entries for a count
                pair, last = np.repeat(pair, more), np.cumsum(more) - 1
                entries = np.empty(len(pair), ENTRY)
                entries["row"], entries["times"] = pair % ROWS, 255
                entries["times"][last] = times - (more - 1) * 255
                words.append(_strings(s, rep))
                pairs.append((pair // ROWS, entries))
                held += len(pair)
                if held > HELD * 3:
                    yield merged()
                    words, pairs, held = [], [], 0
            if words:
                yield merged()
            facts = pa.StructArray.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counted)], names=["id", "n_bytes", "counted"])
            rows = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), facts)
            yield pa.RecordBatch.from_arrays([pa.array([f"\0{batch}"]), pa.array([batch]), pa.array([None], pa.binary()), rows], names=names)
            batch += 1

    facts = StructType().add("id", docs.schema["id"].dataType).add("n_bytes", LongType()).add("counted", LongType())
    return docs.mapInArrow(run, StructType().add("pretoken", StringType()).add("batch", LongType()).add("entries", BinaryType()).add("rows", ArrayType(facts)))


def _sums(joined: DataFrame) -> DataFrame:
    """(batch, sums, rows) of (pieces, batch, entries, rows): a block of SUM for each batch, and the rows' own facts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        numbers: dict[int, int] = {}  # of the batches held, so that a batch and a row fit one word whatever the batch is called
        held, kind, names = 0, None, ["batch", "sums", "rows"]

        def folded() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)

        def blocks(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], key[1:] >> 16 != key[:-1] >> 16)))
            out = np.empty(len(key), SUM)
            out["row"], out["tokens"] = key & 0xFFFF, total
            of_batch = [out[a:z].tobytes() for a, z in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True)]
            batch = np.array(list(numbers), np.int64)[key[first] >> 16]
            return pa.RecordBatch.from_arrays([pa.array(batch), pa.array(of_batch, pa.binary()), pa.nulls(len(first), kind)], names=names)

        for b in batches:
            kind = b.schema.field("rows").type
            heads = b.filter(b.column("rows").is_valid())
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([heads.column("batch"), pa.nulls(heads.num_rows, pa.binary()), heads.column("rows")], names=names)
            b = b.filter(b.column("entries").is_valid())
            if not b.num_rows:
                continue
            blobs = b.column("entries")
            offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + b.num_rows + 1].astype(np.int64)
            data = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(ENTRY)
            n = np.diff(offsets) // ENTRY.itemsize
            number = np.array([numbers.setdefault(x, len(numbers)) for x in b.column("batch").to_pylist()], np.int64)
            keys.append(np.repeat(number << 16, n) | data["row"])
            sums.append(np.repeat(b.column("pieces").to_numpy().astype(np.int64), n) * data["times"])
            held += len(data)
            if held > 2 * HELD:
                key, total = folded()
                if len(key) > HELD:
                    yield blocks(key, total)
                    keys, sums, held = [], [], 0
                    numbers.clear()
                else:
                    keys, sums, held = [key], [total], len(key)
        if keys:
            yield blocks(*folded())

    schema = StructType().add("batch", LongType()).add("sums", BinaryType()).add("rows", joined.schema["rows"].dataType)
    return joined.select("pieces", "batch", "entries", "rows").mapInArrow(run, schema)


def _totals(blocks: DataFrame) -> DataFrame:
    """(id, n_bytes, n_tokens) of each row, a batch after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, facts = None, np.zeros(0, np.int64), None

        def done() -> pa.RecordBatch:
            tokens = facts.field("counted").to_numpy() + total[: len(facts)]
            return pa.RecordBatch.from_arrays([facts.field("id"), facts.field("n_bytes"), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

        for b in batches:
            for batch, sums, rows in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if batch != now:
                    if now is not None:
                        yield done()
                    now, total = batch, np.zeros(ROWS, np.int64)
                if sums.is_valid:
                    x = np.frombuffer(sums.as_buffer(), SUM)
                    total[x["row"]] += x["tokens"]  # a block has each row once
                else:
                    facts = rows.values
        if now is not None:
            yield done()

    facts = blocks.schema["rows"].dataType.elementType
    schema = StructType().add("id", facts["id"].dataType).add("n_bytes", LongType()).add("n_tokens", LongType())
    return blocks.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, first_partition: int = 0) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text is empty: no bytes, no tokens. Rows are told apart by their place, so repeated rows and null ids
    each keep a row. Strings of added tokens inside a text count as one token, as the library takes them by
    default. Long texts are cut where a match always ends. Other columns are left out and can't clash.
    Batches are named by the number of their partition, counted from first_partition.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    joined = _postings(docs, path, first_partition).join(piece_counts(docs.select("text"), path), "pretoken", "left")
    return _totals(_sums(joined)).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the public byte-level vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
