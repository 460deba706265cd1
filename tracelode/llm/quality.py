"""Document quality by co-training.

Two views of a document each train a classifier: the content of its text (words, and what it is made of: letter case,
symbols, repetitions), and its metadata (language, source, size and number of lines). They share no evidence. Over some rounds each classifier labels
the documents of an unlabelled pool that it is sure of, for the other to learn from. The views are then calibrated
on labels held out, and combined: their log odds add up, less the prior that both contain, so a view that knows
nothing of a document leaves the other's word standing. There is one such pair for quality and one for toxicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, values, written

#: Bounds of what the classifiers are fitted on: labelled rows, rows of the unlabelled pool, words for each target.
LABELLED, POOL, WORDS = 12_000, 8_000, 400
#: A word is of use if the target's share among its documents is this many deviations off.
LEAST_Z, LEAST_DOCS = 5.5, 3
#: Beside whole words, their first letters count: inflected and compound forms share them.
PREFIXES = (4, 5)
#: Rounds of exchange, how sure a pseudo-label is, and the share of the pool that a round hands over for each class.
ROUNDS, SURE, HANDED = 3, 0.98, 0.1
HELD_OUT = 5  # every fifth labelled row calibrates
TARGETS = ("low", "toxic")
#: Sources and languages that have a column of their own, the most frequent ones of the sample; all others share one.
SOURCES, LANGS = 48, 24
#: Numbers that tell a text's make-up, and its size.
FORMS, SIZES = 9, 3


def shape(text: str) -> list[float]:
    """What the text is made of, without its words, then its size."""
    raw = text.encode()
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:]))
    punctuation = int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum())
    symbols = int(h[[35, 36, 37, 38, 42]].sum())
    lines = int(h[10]) + 1
    return [
        upper / max(1, upper + lower), int(h[48:58].sum()) / n, symbols / n, int(h[33]) / n, int(h[124]) / n, (punctuation - symbols) / n,
        again / max(1, len(words)), np.log1p(n / max(1, len(words))), int(h[128:].sum()) / n, np.log1p(len(raw)), np.log1p(lines), np.log1p(n / lines),
    ]


class Features:
    """Both views of documents: numbers of known words, one array after the other, and rows of make-up and metadata."""

    def __init__(self, words: list[str], langs: list, sources: list):
        import re

        self.langs, self.sources = ({x: i for i, x in enumerate(known)} for known in (langs, sources))
        self.width = FORMS + SIZES + len(langs) + len(sources) + 2
        self.number = {w: i for i, w in enumerate(words)}
        self.known = frozenset(words)
        self.find = re.compile(r"[^\W\d_]+").findall

    def of(self, texts: Iterator, langs: Iterator, sources: Iterator, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, count = [], []
        meta = np.zeros((n, self.width), np.float32)
        for i, (text, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
            text = text or ""
            found = set(self.find(text.lower()))
            found = self.known.intersection(found.union(*({w[:n] + "*" for w in found if len(w) > n} for n in PREFIXES)))
            numbers += sorted(self.number[w] for w in found)
            count.append(len(found))
            meta[i, : FORMS + SIZES] = shape(text)
            meta[i, FORMS + SIZES + self.langs.get(lang, len(self.langs))] = 1
            meta[i, FORMS + SIZES + len(self.langs) + 1 + self.sources.get(source, len(self.sources))] = 1
        return np.array(numbers, np.int32), np.array(count, np.int64), meta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Words:
    """A bag of known words as a design matrix."""

    number: np.ndarray
    count: np.ndarray
    width: int

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.number], minlength=len(self.count))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.number, weights=r[self.row], minlength=self.width)

    def only(self, allowed: np.ndarray) -> Words:
        """Without the words that aren't allowed; the numbers stay."""
        ok = allowed[self.number]
        return Words(self.number[ok], np.bincount(self.row[ok], minlength=len(self.count)), self.width)

    def take(self, rows: np.ndarray) -> Words:
        begin = np.cumsum(self.count) - self.count
        n = self.count[rows]
        at = np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return Words(self.number[at], n, self.width)


@dataclass
class Dense:
    x: np.ndarray

    @property
    def width(self) -> int:
        return self.x.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r

    def take(self, rows: np.ndarray) -> Dense:
        return Dense(self.x[rows])


@dataclass
class Content:
    """The text's view: words, and numbers beside them."""

    bag: Words
    form: Dense

    @property
    def width(self) -> int:
        return self.bag.width + self.form.width

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self.bag @ w[: self.bag.width] + self.form @ w[self.bag.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate((self.bag.back(r), self.form.back(r)))

    def take(self, rows: np.ndarray) -> Content:
        return Content(self.bag.take(rows), self.form.take(rows))


def logistic(x, y: np.ndarray, penalty: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept, by Newton steps that conjugate gradients solve.

    penalty is that of the whole sum, not of the mean; the intercept has none.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.width + 1)
    w[-1] = np.log(share / (1 - share))
    ridge = np.append(np.full(x.width, penalty), 1e-6)

    def cost(w: np.ndarray) -> float:
        z = x @ w[:-1] + w[-1]
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * w * w).sum())

    now = cost(w)
    for _ in range(steps):
        p = _sigmoid(x @ w[:-1] + w[-1])
        gradient = np.append(x.back(p - y), (p - y).sum()) + ridge * w
        curve = p * (1 - p)
        step, rest = np.zeros_like(w), -gradient
        way, size = rest.copy(), float(rest @ rest)
        first = size
        for _ in range(40):
            if size <= 1e-6 * first:
                break
            z = curve * (x @ way[:-1] + way[-1])
            bent = np.append(x.back(z), z.sum()) + ridge * way
            far = size / max(float(way @ bent), 1e-300)
            step, rest = step + far * way, rest - far * bent
            size, before = float(rest @ rest), size
            way = rest + size / before * way
        far = 1.0
        while far > 1e-4 and cost(w + far * step) > now:
            far /= 2
        w = w + far * step
        now, before = cost(w), now
        if before - now <= 1e-6 * max(1.0, abs(now)):
            break
    return w


def _score(x, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make log odds of a score (Platt's smoothed targets)."""
    p, n = y.sum(), len(y) - y.sum()
    if not p or not n:
        return 1.0, 0.0
    scale = max(1.0, float(np.abs(score).max()))
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    w = logistic(Dense(score[:, None] / scale), t, penalty=1e-3)
    return max(0.0, w[0] / scale), w[1]


@dataclass
class Pair:
    """The two classifiers of one target with their calibrations, and the prior's log odds."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def odds(self, words: Content, meta: Dense) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of the text view, of the metadata view, and of both."""
        a = self.text_scale[0] * _score(words, self.text) + self.text_scale[1]
        b = self.meta_scale[0] * _score(meta, self.meta) + self.meta_scale[1]
        return a, b, a + b - self.prior


def co_train(words: Content, meta: Dense, y: np.ndarray, pool_words: Content, pool_meta: Dense, rounds: int = ROUNDS) -> Pair:
    """Trains both views on the labelled rows and on each other's sure labels of the pool."""
    held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    fit, test = np.flatnonzero(~held), np.flatnonzero(held)
    share = (y.sum() + 1) / (len(y) + 2)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels for the text view and for the metadata view
    views, pools = (words, meta), (pool_words, pool_meta)
    models: list[np.ndarray] = []
    for turn in range(rounds + 1):
        models = []
        for view, pool, labels in zip(views, pools, given, strict=True):
            extra = np.array(sorted(labels), np.int64)
            x = _stack(view.take(fit), pool.take(extra))
            models.append(logistic(x, np.concatenate((y[fit], [labels[i] for i in extra.tolist()]))))
        if turn == rounds or not len(pool_meta.x):
            break
        for me, other in ((0, 1), (1, 0)):
            slope, shift = calibrated(_score(views[me].take(test), models[me]), y[test])
            p = _sigmoid(slope * _score(pools[me], models[me]) + shift)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                most = max(1, int(HANDED * len(p) * (share if label else 1 - share)))
                best = np.argsort(-sure, kind="stable")
                best = [i for i in best[: most * (turn + 1)].tolist() if sure[i] >= SURE]
                given[other].update((i, label) for i in best if i not in given[other])
    scales = [calibrated(_score(v.take(test), m), y[test]) for v, m in zip(views, models, strict=True)]
    return Pair(models[0], models[1], scales[0], scales[1], float(np.log(share / (1 - share))))


def _stack(a, b):
    if isinstance(a, Content):
        return Content(_stack(a.bag, b.bag), _stack(a.form, b.form))
    if isinstance(a, Words):
        return Words(np.concatenate((a.number, b.number)), np.concatenate((a.count, b.count)), a.width)
    return Dense(np.concatenate((a.x, b.x)))


@dataclass
class Model:
    words: list[str]
    langs: list
    sources: list
    mean: np.ndarray
    spread: np.ndarray
    pairs: dict[str, Pair]


def _sample(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> DataFrame:
    """At most `labelled` labelled and `pool` other documents, by a hash of their ids, as a written table.

    The chosen ids are of bounded number and are broadcast; documents are scanned once, without a shuffle.
    """
    order = F.xxhash64("doc_id", F.lit(1))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    marks = marks.filter("q is not null or t is not null")
    chosen = marks.orderBy(order, "doc_id").limit(labelled).select("doc_id", (F.coalesce("q", F.lit(1.0)) < 0.5).cast("double").alias("low"), (F.coalesce("t", F.lit(0.0)) >= 0.5).cast("double").alias("toxic"))
    others = docs.select("doc_id").filter("doc_id is not null").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").distinct()
    others = others.orderBy(order, "doc_id").limit(pool).select("doc_id", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("toxic"))
    ids = written(chosen.unionByName(others), "sample-ids")
    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(ids), "doc_id")
    # of rows that repeat an id one is taken, the smallest, so that the sample keeps its bound
    one = rows.groupBy("doc_id", "low", "toxic").agg(F.min(F.struct("text", "lang", "source")).alias("x"))
    return written(one.select("doc_id", "x.text", "x.lang", "x.source", "low", "toxic"), "sample")


def _frequent(sample: DataFrame, column: str, most: int) -> list:
    """The column's most frequent values, null among them."""
    return [r[0] for r in sample.groupBy(column).count().orderBy(F.desc("count"), column).limit(most).collect()]


def _vocabulary(sample: DataFrame, most: int) -> dict[str, list[str]]:
    """Words whose documents' share of a target is off by LEAST_Z deviations, at most `most` for each target."""
    labelled = sample.filter("low is not null")
    n, low, toxic = labelled.agg(F.count("*"), F.sum("low"), F.sum("toxic")).first()
    whole = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    starts = [F.expr(f"transform(filter(w, x -> length(x) > {n}), x -> concat(left(x, {n}), '*'))") for n in PREFIXES]
    words = labelled.select("low", "toxic", whole.alias("w")).select("low", "toxic", F.explode(F.array_distinct(F.concat("w", *starts))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= LEAST_DOCS)
    out: dict[str, list[str]] = {t: [] for t in TARGETS}
    for target, total in (("low", low), ("toxic", toxic)):
        if not n or not total or total == n:
            continue
        p = total / n
        z = (F.col(target) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
        found = counts.withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(most).select("word").collect()
        out[target] = [r[0] for r in found]
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fits both pairs on a bounded sample; without labels, or with labels of one kind, a pair says its prior."""
    sample = _sample(docs, labels, labelled, pool)
    of_target = _vocabulary(sample, WORDS)
    words = sorted(set().union(*of_target.values()))
    langs, sources = _frequent(sample, "lang", LANGS), _frequent(sample, "source", SOURCES)
    found = sample.mapInArrow(_extract(words, langs, sources), "number array<int>, meta array<float>, low double, toxic double, h long").toArrow()
    found = found.sort_by("h")  # the rows' order is that of the hashes, however they were scanned
    number = found["number"].combine_chunks()
    count = np.asarray(number.value_lengths().fill_null(0), np.int64) if len(number) else np.empty(0, np.int64)
    flat = np.asarray(number.flatten(), np.int64) if len(number) else np.empty(0, np.int64)
    width = Features(words, langs, sources).width
    meta = np.asarray(found["meta"].combine_chunks().flatten(), np.float64).reshape(-1, width) if len(number) else np.empty((0, width))
    known = np.asarray(found["low"].is_valid().combine_chunks()) if len(number) else np.empty(0, bool)
    rows, rest = np.flatnonzero(known), np.flatnonzero(~known)
    mean, spread = (meta.mean(axis=0), meta.std(axis=0)) if len(meta) else (np.zeros(width), np.ones(width))
    spread = np.where(spread > 1e-9, spread, 1.0)
    bags, dense = Words(flat, count, len(words)), (meta - mean) / spread
    form, facts = Dense(dense[:, :FORMS]), Dense(dense[:, FORMS:])
    pairs = {}
    for target in TARGETS:
        y = np.asarray(found[target].combine_chunks().fill_null(0.0))[rows] if len(number) else np.empty(0)
        if len(y) < 2 * HELD_OUT or not y.any() or y.all():
            share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-6
            prior = float(np.log(share / (1 - share)))
            pairs[target] = Pair(np.zeros(len(words) + FORMS + 1), np.zeros(width - FORMS + 1), (1.0, prior), (1.0, prior), prior)
        else:
            bag = bags.only(np.isin(np.array(words, object), of_target[target]) if words else np.empty(0, bool))
            content = Content(bag, form)
            pairs[target] = co_train(content.take(rows), facts.take(rows), y, content.take(rest), facts.take(rest))
    return Model(words, langs, sources, mean, spread, pairs)


def _extract(words: list[str], langs: list, sources: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        features = Features(words, langs, sources)
        for b in small(batches):
            number, count, meta = features.of(*(values(b.column(k)) for k in ("text", "lang", "source")), b.num_rows)
            at = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            h = [xxhash.xxh64_intdigest(f"{i}/{t}") >> 1 for i, t in zip(b.column("doc_id").to_pylist(), values(b.column("text")), strict=True)]
            metas = pa.FixedSizeListArray.from_arrays(pa.array(meta.ravel()), meta.shape[1]).cast(pa.list_(pa.float32()))
            arrays = [pa.ListArray.from_arrays(pa.array(at), pa.array(number)), metas, b.column("low"), b.column("toxic"), pa.array(h, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["number", "meta", "low", "toxic", "h"])

    return run


#: What scoring adds: the views' probabilities of each target, the combined ones, and the decision.
SCORES = ("low_by_text", "low_by_meta", "low_score", "toxic_by_text", "toxic_by_meta", "toxic_score")


def scored(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs with SCORES and keep: neither target's combined probability reaches `limit`.

    One narrow pass. Null text is empty, null lang and source are values of their own; repeated rows score alike.
    Columns of docs named like the results are replaced, all others pass through.
    """
    new = [*SCORES, "keep"]
    keep = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.words, model.langs, model.sources)
        for b in small(batches):
            number, count, meta = features.of(*(values(b.column(keep.index(k))) for k in ("text", "lang", "source")), b.num_rows)
            dense = (meta - model.mean) / model.spread
            words, facts = Content(Words(number, count, len(model.words)), Dense(dense[:, :FORMS])), Dense(dense[:, FORMS:])
            arrays, good = [], np.ones(b.num_rows, bool)
            for target in TARGETS:
                odds = [_sigmoid(x) for x in model.pairs[target].odds(words, facts)]
                arrays += [pa.array(x) for x in odds]
                good &= odds[2] < limit
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays, pa.array(good)], names=[*keep, *new])

    from pyspark.sql.types import StructType

    schema = StructType(list(rows.schema.fields) + StructType.fromDDL(", ".join([*(f"{c} double" for c in SCORES), "keep boolean"])).fields)
    return rows.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the pairs fitted on the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).drop("text", "lang", "source")
