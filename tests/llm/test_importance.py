"""Importance resampling against plain Python, and its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n):
    words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def expected(docs, target, n, buckets, least_words, percent, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, n)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, f = grams(text, n)
        gain = sum(math.floor(1000 * math.log(((t[bucket(g)] + 1.0) * (all_s + buckets)) / ((s[bucket(g)] + 1.0) * (all_t + buckets)))) for g in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def test_query_against_sql_and_python(spark, sf_dir):
    from tracelode.llm import importance

    out = importance.op13_importance(spark, sf_dir)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.execute(importance.SQL)
    assert [x[0] for x in want.description] == out.columns
    assert got == sorted(want.fetchall(), key=str)
    docs = c.execute("select doc_id, text from documents").fetchall()
    plain = expected(docs, [t for (t,) in c.execute("select text from benchmark").fetchall()], 1, 10_000, 20, 10, "2024")
    assert got == sorted(((r[0], *r[2:]) for r in plain), key=str) and sum(r[4] is not None for r in got) == sum(r[1] >= 20 for r in plain) // 10


@pytest.mark.parametrize(("n", "chunk"), [(1, 4), (2, 3), (3, 1), (4, 50)])
def test_chunks_and_odd_rows(spark, n, chunk):
    from tracelode.llm import importance

    rng = random.Random(n)
    texts = [None, "", " .,!", "one", "Äb ÄB äb É", "A-b c_d 'e' 12", "x\x00y\x7fz", "é漢😀 a", *[" ".join(rng.choice(["a", "Bc", "d", "e", "fg", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]]
    rows = [(i if i != 5 else None, t, 9, "w") for i, t in enumerate(texts)]
    rows += rows[20:30]
    df = spark.createDataFrame(rows, "doc_id long, text string, own int, weight string").repartition(4)
    target = ["a Bc d", None, "d d d é"]
    got = importance.importance(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, least_words=5, percent=33, seed="s", chunk=chunk, long=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected([r[:2] for r in rows], target, n, 97, 5, 33, "s")


def test_empty_tables_and_the_drawn_rows(spark):
    from tracelode.llm import importance

    docs = spark.createDataFrame([(i, "w " * i) for i in range(30, 50)] + [(None, "w " * 30)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.importance(none, docs).count() == 0
    scores = importance.importance(docs, none)
    assert scores.filter("rank is not null").count() == 2
    ids = {r.doc_id for r in scores.filter("rank is not null").collect()}
    assert {r.doc_id for r in importance.drawn(docs, scores).collect()} == ids - {None}
