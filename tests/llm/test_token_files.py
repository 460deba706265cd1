"""Token files against the library, and what their readers touch."""

import random
import zlib
from functools import cache

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "x" * 3000, "it's we'll I'd they'RE 's ''s", "a <|endoftext|>  b  <|endoftext|>", " tail  ", "é漢😀 ñ\u0085　z", "\x00 123 \n\n  foo", "ab " * 500]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_query_against_the_library(spark, sf_dir):
    from tracelode.llm import token_files

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, start = [], 0
    for (i, _), e in zip(docs, library().encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.op12_token_files(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_odd_rows_and_parts_of_files(spark, tmp_path, monkeypatch, encoding):
    import glob

    import pyarrow.parquet as pq

    from tracelode.llm import token_files

    monkeypatch.setattr(token_files, "KEPT", 20)
    rng = random.Random(4)
    texts = [*ODD, *ODD[4:7], *[" ".join(str(rng.randint(0, 10**9)) for _ in range(200)) for _ in range(300)]]
    rows = [(i if i != 3 else None, t, "s", i % 7) for i, t in enumerate(texts)]
    rows += rows[8:12]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `ids` int").repartition(5)
    path = f"{tmp_path}/{encoding}"
    token_files.write(df, path, PATH, encoding=encoding, metadata=("source",), row_group=30_000, page=4096, page_rows=20, files=3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    ids = [library_ids(t) for _, t, *_ in order]
    flat = [x for y in ids for x in y]
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.source, r.ids, r.n_tokens) for r in got] == [(r[0], "s", x, len(x)) for r, x in zip(order, ids, strict=True)]
    assert [r.start for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    assert sorted(r.ids_crc32 for r in token_files.digests(token_files.read_documents(spark, path)).collect()) == sorted(map(crc, ids))
    # parts: documents, a stretch of ids over several files, metadata
    some = token_files.read_documents(spark, path, 100, 102)
    assert {r.doc_id: r.ids for r in some.collect()} == {r[0]: x for r, x in zip(order, ids, strict=True) if r[0] in (100, 101, 102)}
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().toString()
    for a, b in ((0, 1), (5, 5000), (len(flat) // 3, 2 * len(flat) // 3), (len(flat) - 3, len(flat) + 9), (7, 7)):
        assert [x for r in sorted(token_files.read_stretch(spark, path, a, b).collect(), key=lambda r: r.start) for x in r.ids] == flat[a:b]
    m = token_files.read_metadata(spark, path)
    assert m.count() == len(rows) and "ids" not in m.columns and "ids:array" not in m._jdf.queryExecution().executedPlan().toString()
    # the files: encodings, several row groups and pages, page indexes, one range a file
    of = sorted(glob.glob(f"{path}/tokens/*.parquet"), key=lambda f: pq.read_table(f, columns=["part"]).column(0)[0].as_py())
    assert len(of) == 3 == token_files.files(spark, path).count()
    last = -1
    for f in of:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 1
        column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        tokens = column["ids.list.element"]
        assert tokens.has_offset_index and column["doc_id"].has_column_index and "DELTA_BINARY_PACKED" in column["doc_id"].encodings
        assert ("DELTA_BINARY_PACKED" in tokens.encodings) == (encoding == "delta") and ("RLE_DICTIONARY" in tokens.encodings) == (encoding == "dictionary")
        known = [x for x in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist() if x is not None]
        assert known == sorted(known) and known[0] >= last
        last = known[-1]


def test_empty_tables_and_wrong_arguments(spark, tmp_path):
    from tracelode.llm import token_files

    df = spark.createDataFrame([], "doc_id long, text string, ids string")
    token_files.write(df, f"{tmp_path}/none", PATH)
    assert token_files.read_documents(spark, f"{tmp_path}/none").count() == 0 == token_files.read_stretch(spark, f"{tmp_path}/none", 0, 9).count()
    with pytest.raises(ValueError, match="own columns"):
        token_files.write(df, f"{tmp_path}/clash", PATH, metadata=("ids",))
    with pytest.raises(ValueError, match="neither"):
        token_files.write(df, f"{tmp_path}/kind", PATH, encoding="gzip")


def test_distinct_is_that_of_pretokens():
    import numpy as np

    from tracelode.llm import pretokens, token_files

    rng = random.Random(8)
    s = pretokens.split([" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(2000)), "", "x"])
    first, which = token_files.distinct(s)
    words = [s.joined[a:b] for a, b in zip(s.start, s.end, strict=True)]
    assert [words[first[k]] for k in which] == words and len(first) == len(set(words)) and np.array_equal(which[first], np.arange(len(first)))
