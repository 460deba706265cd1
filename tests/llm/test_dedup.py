"""Deduplication, archives, search and mixing against brute force."""

import base64
import collections
import hashlib
import itertools
import random

import numpy as np
import xxhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(items, linked):
    parent = list(range(len(items)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i], items[j]):
            parent[top(j)] = top(i)
    return [top(i) for i in range(len(items))]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, sf_dir):
    from tracelode.llm import simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "one Word"), (9004, "ONE word"), (None, None), (9001, None)], "doc_id long, text string")
    rows = docs.union(extra).collect()
    fps = [fingerprint(r.text) for r in rows]
    top = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for r, t in zip(rows, top, strict=True):
        if r.doc_id is not None:
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    got = sorted(((r.id, r.fp, r.component_id) for r in simhash.near_groups(docs.union(extra)).collect()), key=str)
    assert got == sorted(((r.doc_id, signed(f), least.get(t)) for r, f, t in zip(rows, fps, top, strict=True)), key=str)
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_links_in_dense_and_sparse_buckets(spark):
    from tracelode.llm import components, simhash

    rng = random.Random(3)
    found = {0, (1 << 64) - 1, 1 << 63}
    base = rng.getrandbits(64)
    for _ in range(250):
        x = base if rng.random() < 0.5 else rng.choice(sorted(found))
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    found = sorted(found)
    df = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    top = groups(found, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for x, t in zip(found, top, strict=True):
        least[t] = min(least.get(t, signed(x)), signed(x))
    for dense in (1, 64):
        root = {r.node: r.root for r in components.components(simhash.links(df, 2, dense)).collect()}
        assert [root.get(signed(x), signed(x)) for x in found] == [least[t] for t in top]


def test_similar_texts_meet(spark):
    from tracelode.llm import simhash

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for g in range(40):
        base = [word() for _ in range(300)]
        for c in range(2):
            copy = list(base)
            for _ in range(3 * c):
                copy[rng.randrange(300)] = word()
            rows.append((n, g, " ".join(copy)))
            n += 1
    rows += [(n, -1, None), (n + 1, -1, ""), (n, -1, None), (None, -2, "short")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, g int, text string")).collect()
    assert {r.g for r in kept} == {r[1] for r in rows}
    assert len(kept) <= 42 + 1 and all(r.doc_id % 2 == 0 for r in kept if r.g >= 0 and [k.g for k in kept].count(r.g) == 1)


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracelode.llm import simhash

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(40)), "k") for i in range(30)] + [(90, None, "k"), (91, "", "k")]
    rows += [(50 + i, t, "k") for i, t, _ in rows[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT_ID string")
    want = sorted(r.doc_id for r in simhash.deduplicated(df).collect())
    assert want == [*range(30), 90]
    monkeypatch.setattr(simhash, "text_hash", lambda text: F.xxhash64(text) % 3)
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == want


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_groups_are_exact_in_a_crowd(spark):
    """Groups of a hot template, isolated pairs at 0.8 to 0.85 and texts at 0.6 to 0.75, against all pairs."""
    from tracelode.llm import simhash

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def changed(base, n):
        copy, at = list(base), rng.randrange(300 // n)
        for i in range(n):
            copy[(at + i * (300 // n)) % 300] = word()
        return copy

    fresh = lambda: [word() for _ in range(300)]
    texts, template = [], fresh()
    for _ in range(120):  # all of them about 0.7 similar, every second one has a near copy
        x = changed(template, 5)
        texts.append(x)
        if len(texts) % 3 == 1:
            texts.append(changed(x, 4))
    for n in (5, 6):
        for _ in range(40):
            x = fresh()
            texts += [x, changed(x, n)]
    for n in (9, 10, 11):
        for _ in range(40):
            x = fresh()
            texts += [x, changed(x, n)]
    texts = [" ".join(x) for x in texts]
    sets = [shingles(x) for x in texts]
    linked = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    top = groups(list(range(len(texts))), lambda i, j: (i, j) in linked)
    df = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    root = {r.tid: r.root for r in simhash.similar_groups(df).collect()}
    together = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if root.get(i, i) == root.get(j, j)}
    expected = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if top[i] == top[j]}
    assert together <= expected  # nothing is merged that no chain of similar pairs joins
    assert len(linked) > 100 and len(linked & together) >= 0.93 * len(linked)


def test_a_bucket_compares_all_its_pairs(spark):
    """Two near copies under a value whose first text is a third one, in one block and in several."""
    from tracelode.llm import simhash

    rng = np.random.default_rng(7)
    bits = rng.integers(-(2**63), 2**63 - 1, (60, simhash.LANES), np.int64)
    bits[1::2] = bits[::2] ^ 1  # each even one is near the one after it
    rows = [(9, i, i, 60, *map(int, x)) for i, x in enumerate(bits)]
    df = spark.createDataFrame(rows, "key long, tid long, root long, n long, " + ", ".join(f"s{i} long" for i in range(simhash.LANES)))
    keep = simhash.CROWD
    try:
        for simhash.CROWD in (keep, 7):
            assert {(r.a, r.b) for r in simhash._crowded_pairs(df, 20).collect()} == {(i + 1, i) for i in range(0, 60, 2)}
    finally:
        simhash.CROWD = keep


def test_a_bucket_tells_differences_in_a_sign_bit(spark):
    """Texts one bit apart, the highest of a lane; of a group with values, those that share one."""
    from tracelode.llm import simhash

    bits = [[0] * simhash.LANES, [-(2**63)] + [0] * (simhash.LANES - 1), [0] * (simhash.LANES - 1) + [-2]]
    schema = "key long, tid long, root long, n long, " + ", ".join(f"s{i} long" for i in range(simhash.LANES))
    rows = [(9, i, i, 3, *x) for i, x in enumerate(bits)]
    assert {(r.a, r.b) for r in simhash._crowded_pairs(spark.createDataFrame(rows, schema), 1).collect()} == {(1, 0)}
    shared = [[5, 6], [7], [6, 7]]
    df = spark.createDataFrame([(*r, v) for r, v in zip(rows, shared, strict=True)], schema + ", values array<long>")
    assert {(r.a, r.b) for r in simhash._crowded_pairs(df, 640).collect()} == {(2, 0), (2, 1)}


def test_a_crowd_has_a_row_for_each_text_met(spark, monkeypatch):
    """Texts of a template that share many values with few leaders: the rows compared are by leader, not by value."""
    from tracelode.llm import simhash

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    template, texts = [word() for _ in range(300)], []
    for _ in range(60):
        copy = list(template)
        for i in rng.sample(range(300), 8):
            copy[i] = word()
        texts.append(" ".join(copy))
    tables, written = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, what: tables.setdefault(what, []).append(written(df, what)) or tables[what][-1])
    simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "tid long, text string"))
    met = tables["met"][0].filter("n > 2 and tid <> leader")
    pairs = met.select("leader", "tid").distinct().count()
    assert tables["rest"][0].count() == pairs < met.count()


def test_later_links_join_components(spark):
    """Links between components, to texts in none, and among such, beside components that stay."""
    from tracelode.llm import simhash

    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "tid long, root long")
    more = spark.createDataFrame([(6, 3), (12, 6), (21, 20), (2, 1)], "a long, b long")
    got = sorted(map(tuple, simhash._joined(roots, more).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (8, 8), (9, 8), (12, 1), (20, 20), (21, 20)]
    assert sorted(map(tuple, simhash._joined(roots, more.limit(0)).collect())) == sorted(map(tuple, roots.collect()))


def without(texts, size):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                mark[i : i + size] = b"\1" * size
        kept = bytes(x for x, m in zip(r, mark, strict=True) if not m)
        yield len(r), sum(mark), sum(1 for i in range(len(r)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()


def some_texts():
    rng = random.Random(5)
    words = ["ab", "bc", "cab", "é", "x", "the", "foo"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [some(30) for _ in range(5)]
    texts = [None, "", "a" * 100, "é" * 60, "\0" * 90, "ab " * 80]
    for _ in range(40):
        t = some(rng.randint(0, 30))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            i = rng.randint(0, len(p) // 2)
            t += p[i : rng.randint(i, len(p))] + some(rng.randint(0, 9))
        texts.append(t)
    return texts + texts[8:14] + [passages[0]] * 20 + [some(9) + passages[1] + some(9) for _ in range(20)]


def test_repeats(spark):
    from tracelode.llm import repeats

    texts = some_texts()
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate(texts)], "doc_id long, text string, tid string, SPANS string").repartition(4)
    for size, gram, group in ((40, 8, 4_096), (40, 8, 2), (30, 10, 3)):
        rows = repeats.without_repeats(df, length=size, gram=gram, group=group).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
        assert [got[i] for i in range(len(texts))] == list(without(texts, size)) and all(r.tid == "k" and r.SPANS == "s" for r in rows)
    left = repeats.without_repeats(df, length=40, gram=8, new_text=True).collect()
    assert all(r.text is None or r.text.encode().decode() == r.text for r in left)
    assert repeats.without_repeats(df.limit(0)).count() == 0


def test_repeats_of_long_texts(spark):
    """Texts of several blocks that share passages across the blocks' bounds."""
    from tracelode.llm import repeats

    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(repeats.BLOCK + 900))
    texts = [long, "x" + long[repeats.BLOCK - 300 : repeats.BLOCK + 300] + "y", long[:250] + "z", "q" * 700_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.without_repeats(df).collect()}
    assert got == {0: (850, 2), 1: (600, 1), 2: (250, 1), 3: (700_000, 1)}


def test_groups_name_all_places(spark):
    """Every place of a group holds the same bytes, and each repeated window lies in groups that have all its texts."""
    from tracelode.llm import repeats

    texts = [t for t in some_texts() if t]
    of = {hashlib.md5(t.encode()).digest(): t.encode() for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for group in (4_096, 2):
        rows = repeats.repeat_groups(df, length=40, gram=8, group=group).collect()
        held, windows = collections.defaultdict(set), collections.defaultdict(set)
        for r in rows:
            held[r.repeat].add(of[bytes(r.tid)][r.begin : r.begin + r.size])
            for i in range(r.begin, r.begin + r.size - 39):
                windows[of[bytes(r.tid)][i : i + 40]].add(bytes(r.tid))
        assert all(len(x) == 1 for x in held.values())
        for tid, raw in of.items():
            for i in range(len(raw) - 39):
                w = raw[i : i + 40]
                if sum(r.count(w) for r in of.values()) > 1 and sum(w in r for r in of.values()) > 1:
                    assert windows[w] == {k for k, r in of.items() if w in r}


def test_crowded_anchors_grow_in_proportion(spark):
    """Rows of all tables of a search over a passage in ever more texts, beyond what one array takes."""
    from tracelode.llm import repeats

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, rows = word(150), []
    for n in (100, 200, 400):
        df = spark.createDataFrame([(word(60) + passage + word(60),) for _ in range(n)] + [(passage * 2,)] * n, "text string")
        found = repeats.Found(df.select(repeats.text_id(df.text).alias("tid"), "text"), 40, 8, 10)
        rows.append(sum(x.count() for x in (found.shared, found.kinds, found.spans(), *found.levels)))
    assert rows[2] < 2.2 * rows[1] < 4.9 * rows[0]


def test_maximal_repeats_name_all_places():
    from tracelode.llm import repeats

    data = np.frombuffer(b"xabcdeQyabcdeRzabcdfSabcdeT", np.uint8)
    first = np.zeros(len(data), bool)
    first[0] = True
    found = {(n, tuple(sorted(p.tolist()))) for n, p in repeats.maximal_repeats(data, np.full(len(data), len(data)), first, 3)}
    assert found == {(5, (1, 8, 21)), (4, (1, 8, 15, 21))}


def test_suffix_arrays_order_all_suffixes():
    from tracelode.llm import repeats

    rng = random.Random(10)
    for least in (7, 9, 15):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(12)] + [b"abab" * 9] * 2
        found = collections.defaultdict(set)
        for size, of, place in repeats.repeats_of(parts, least):
            assert len({parts[k][p : p + size] for k, p in zip(of, place, strict=True)}) == 1
            found[parts[of[0]][place[0] : place[0] + size]] |= set(zip(of.tolist(), place.tolist(), strict=True))
        every = {}
        for k, part in enumerate(parts):
            for i in range(len(part)):
                for j in range(i + least, len(part) + 1):
                    every.setdefault(part[i:j], set()).add((k, i))
        left = lambda k, i: parts[k][i - 1] if i else (k, i)
        right = lambda k, i, n: parts[k][i + n] if i + n < len(parts[k]) else (k, i)
        maximal = {s: p for s, p in every.items() if len(p) > 1 and len({left(*x) for x in p}) > 1 and len({right(*x, len(s)) for x in p}) > 1}
        assert found == maximal


def test_archives(spark):
    from pyspark.sql import functions as F

    from tracelode.llm import warc
    from tracelode.llm.common import shared_path

    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (9, "u\r\n", "WARC/1.1\r\n\r\n\r\n\r\nx"), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\nx"), (7, "é", "é\0")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    got = warc.deduplicated(df, path, "page_id", "url", "html").collect()
    assert len(got) == len(rows)
    kinds = {(r.id, r.record_type, r.refers_to) for r in got}
    assert {("1", "revisit", "3"), ("2", "revisit", "3"), ("3", "response", None), ("4", "revisit", "5"), ("5", "response", None), (None, "response", None), ("9", "response", None)} <= kinds
    payloads = {str(i): (h or "").encode() for i, _, h in rows}
    for r in got:
        if r.record_type == "response" and r.id:
            assert bytes(r.payload) == payloads[r.id] and r.digest == base64.b32encode(hashlib.sha1(payloads[r.id]).digest()).decode()
    assert warc.deduplicated(df.limit(0), shared_path(spark, "warc"), "page_id", "url", "html").count() == 0
    back = warc.read_archives(spark, path)
    for r in warc.restored(back).collect():
        assert r.id is None or bytes(r.payload) == payloads[r.id]
    facts = warc.resolved(back).collect()
    assert len(facts) == len(rows) and all(r.intact for r in facts)
    lost = {r.id: r for r in warc.resolved(back.filter("id is null or id <> '3'")).collect()}
    assert not lost["1"].intact and lost["1"].digest is None and lost["4"].intact
    bent = back.withColumn("payload", F.expr("if(id = '3', cast('other' as binary), payload)"))
    assert {r.id for r in warc.resolved(bent).collect() if not r.intact} == {"1", "2", "3"}


def test_archives_of_pages(spark, sf_dir):
    """The query against a direct computation."""
    from tracelode.llm import warc

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    newest = {}
    for r in pages:
        newest[r.html or ""] = max(newest.get(r.html or "", -1), r.page_id)
    want = []
    for r in pages:
        raw, ref = (r.html or "").encode(), newest[r.html or ""]
        again = ref != r.page_id
        want.append((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", ref if again else None, True))
    assert sorted(map(tuple, warc.op6_warc(spark, sf_dir).collect())) == sorted(want)


def test_neighbours_of_many_lengths(spark, monkeypatch):
    """The lengths beyond the most frequent ones, of which one holds more than a group, against all pairs."""
    from tracelode.llm import ann

    rng = np.random.default_rng(3)
    monkeypatch.setattr(ann, "MAX_LENGTHS", 1)
    monkeypatch.setattr(ann, "GROUP", 7)
    monkeypatch.setattr(ann, "CALLS", 3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, d)]) for i, d in enumerate([4] * 120 + [3] * 40 + [2] * 25 + [1] * 3 + list(range(10, 80)))]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, df.filter("vec_id % 2 = 0")).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    short = {i for i, v in rows if len(v) != 4}
    for i, v in rows:
        if i % 2 == 0 and i in short:
            q = np.array(v)
            score = {j: float(ann.cosine(q[None], np.array(w)[None])[0]) for j, w in rows if len(w) == len(v) and j != i}
            assert got.get(i, []) == [(j, round(s, 12)) for j, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert {i for i in got if i not in short}


def test_neighbours(spark, sf_dir):
    from tracelode.llm import ann

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    bad = [(10001, None), (10050, [0.0] * 64), (10100, [float("nan")] * 64), (10150, [None] * 64), (None, [1.0] * 64)]
    short = [(10200, [1.0, 2.0]), (10201, [2.0, 4.0]), (10202, [2.0, 1.0])]
    copies = [(20000 + i, [0.5] * 32 + [0.25] * 32) for i in range(51)]
    df = vectors.union(spark.createDataFrame(bad + short + copies, "vec_id long, embedding array<float>"))
    got = ann.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    assert [(r.rank, r.vec_id, round(r.score, 9)) for r in sorted(got) if r.query_id == 10200] == [(1, 10201, 1.0), (2, 10202, 0.8)]
    got = [r for r in got if r.query_id != 10200]
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.vec_id not in {b[0] for b in bad + short}]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit, by = 0, collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r)
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(by) == sorted(asked)
    for q in asked:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]])
        hit += len(best & {r.vec_id for r in by[q]})
        assert [r.rank for r in by[q]] == [1, 2, 3, 4, 5]
        for r in by[q]:
            assert abs(r.score - s[ids == r.vec_id][0]) < 1e-12
    assert [r.vec_id for r in by[20000]] == [20001, 20002, 20003, 20004, 20005]
    assert hit / (5 * len(asked)) >= 0.9
    assert ann.nearest(df.limit(0), df).count() == 0


def test_clusters_take_few_lists_and_noise_takes_many():
    from tracelode.llm import ann

    rng = np.random.default_rng(1)
    for spread, low, high in ((0.05, 1, 8), (9.0, 20, 60)):
        middles = rng.standard_normal((40, 32))
        v = middles[rng.integers(0, 40, 6000)] + spread * rng.standard_normal((6000, 32))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        centres = ann.centres_of(v, 60)
        n = ann.probes_for(v, centres)
        assert low <= n <= high
        of, order = (v @ centres.T).argmax(axis=1), np.argsort(-(v[::40] @ centres.T), axis=1)
        near = v[::40] @ v.T
        near[np.arange(150), np.arange(0, 6000, 40)] = -9
        best = np.argsort(-near, axis=1)[:, :5]
        assert np.mean([of[j] in order[i, :n] for i in range(150) for j in best[i]]) >= 0.93


def test_mixing(spark):
    from tracelode.llm import mixing

    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)] + [(900, None, "a"), (901, "x", "z"), (901, "x", "z"), (None, "y", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as hash", "3 as whole")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and got == mixing.mix(df).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, total, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:  # clamp and reshare
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if total * weight[s] / w > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            open_.remove(s)
    target |= {s: total * weight[s] / w for s in open_}
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.filter("size <> 1 or hash <> 2 or whole <> 3").count() == 0
    assert mixed.count() == sum(r.copies if r.text and r.text.split() else 1 for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
