"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest


def every_run(words, min_words, min_exponent):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        at = 0
        while at + q < len(words):
            to = at
            while to + q < len(words) and words[to] == words[to + q]:
                to += 1
            if to - at + q >= max(min_words, min_exponent * q) and (at, to + q) not in found:
                found[at, to + q] = q  # the smallest period comes first
            at = max(to, at + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


@pytest.mark.parametrize(("min_words", "min_exponent"), [(6, 4), (2, 2), (1, 3), (5, 2), (9, 4)])
def test_all_runs(min_words, min_exponent):
    from tracelode.llm import runs

    rng = random.Random(min_words * 10 + min_exponent)
    texts = [[], [b"a"], [b"a"] * 3, [b"a"] * 50, [b"a", b"b"] * 20 + [b"a"]]
    for _ in range(400):
        letters = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        text = []
        for _ in range(rng.randint(0, 4)):
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            text += piece * rng.randint(1, 7) + piece[: rng.randint(0, len(piece))]
        texts.append(text)
    assert runs.text_runs(texts, min_words, min_exponent) == [every_run(t, min_words, min_exponent) for t in texts]


def test_a_very_long_text():
    from tracelode.llm import runs

    one = np.zeros(100_000, np.int64)
    assert runs.runs_of(one) == [(0, 100_000, 1)]
    text = [str(i).encode() for i in range(5000)] + [str(i % 300).encode() for i in range(60_000)] + [b"end"]
    assert runs.text_runs([text]) == [[(5000, 60_000, 300)]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = every_run(words, 6, 4)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest())


def test_query_against_brute_force(spark, sf_dir):
    from tracelode.llm import runs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in runs.op11_periodic_runs(spark, sf_dir).collect()}
    short = [d for d in docs if len((d.text or "").split()) < 400]
    assert len(got) == len(docs) and len(short) > 100 and sum(r[1] > 0 for r in got.values()) > 2
    for d in short:
        assert got[d.doc_id] == expected(d.doc_id, d.text)


def test_odd_rows(spark, monkeypatch):
    from tracelode.llm import runs

    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "x " * 40, "a\x0bb\x0ca b a b a b", "é 漢 " * 9, "go home " * 7 + "go", " ".join(rng.choice("abc") for _ in range(3000))]
    rows = [(i if i != 2 else None, t, 5, "own") for i, t in enumerate([*texts, *texts[3:6]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, `an other` string").repartition(3)
    monkeypatch.setattr(runs, "SLICE", 50)
    got = runs.periodic_runs(df).collect()
    assert len(got) == len(rows) and got[0]["an other"] == "own"
    for r in got:
        words = (r.text or "").encode().split()
        want = every_run(words, 6, 4)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words) and r.collapsed == b" ".join(kept(words, want)).decode()
    assert runs.periodic_runs(df.limit(0)).count() == 0
    more = [(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(100)]
    got = runs.with_repetitions(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert all(r.text.encode().split() == planted(r.doc_id, dict(more)[r.doc_id]) for r in got)
