"""Importance resampling towards a target distribution of hashed n-grams.

Long texts are cut at word boundaries into chunks that overlap by n - 1 words. A chunk owns the n-grams that start in
its own words, so each n-gram is counted once, and chunks of a long text are dealt over all tasks. The buckets of
each chunk's n-grams are written once; the counts by bucket, and then the sums of the buckets' gains, are taken from
them, by chunk first and then by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, numbered, table, written

#: Words here: letters and digits, and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: Words that a chunk owns, and the characters from which on a text is cut.
CHUNK, LONG = 8192, 65_536


def _grams(words: Column, own: Column, n: int) -> Column:
    """The runs of 1 to n words that start in the first `own` words, joined by a space."""
    out, run = F.slice(words, F.lit(1), own), words
    for k in range(2, n + 1):
        # a run of k words is one of k - 1 with the word after it; at the end nothing follows and null comes out
        run = F.filter(F.zip_with(run, F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        out = F.concat(out, F.slice(run, F.lit(1), own))
    return out


def features(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """(row, doc_id, own, bucket list) of each chunk of docs(doc_id, text); row tells the rows of docs apart, own is the words that the chunk owns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))
    bucket = lambda w, own: F.transform(_grams(w, own, n), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    base = docs.select("doc_id", "text")
    short = base.filter(F.length(text) <= long).select((F.monotonically_increasing_id() * 2).alias("row"), "doc_id", words.alias("words"))
    short = short.select("row", "doc_id", F.size("words").alias("own"), "words")
    cut = base.filter(F.length(text) > long).select((F.monotonically_increasing_id() * 2 + 1).alias("row"), "doc_id", words.alias("words"))
    cut = cut.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(chunk))).alias("at"))
    cut = cut.select("row", "doc_id", "at", F.least(F.lit(chunk), F.size("words") - F.col("at")).alias("own"), F.slice("words", F.col("at") + 1, F.lit(chunk + n - 1)).alias("words"))
    cut = cut.repartition("row", "at").drop("at")
    return short.unionByName(cut).select("row", "doc_id", "own", bucket(F.col("words"), F.col("own")).alias("buckets"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: a thousand times the log of its share in the target over that in the source, each smoothed by one, rounded down."""
    spark = source.sparkSession
    count = lambda f, name: f.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(count(source, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = written(both, "buckets")  # one row a bucket
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    num = lambda c: F.col(c).cast("double") + 1.0
    ratio = (num("t") * F.lit(float(all_s + buckets))) / (num("s") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def importance(
    docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
    chunk: int = CHUNK, long: int = LONG,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs(doc_id, text), by target(text).

    Features are runs of 1 to n words, repeats included, hashed to buckets. weight is the mean of their gains, rounded
    down. score adds Gumbel noise that follows from the seed and doc_id, so the highest scores are a draw without
    replacement by weight. Of the documents with least_words words or more, percent of a hundred are drawn; rank says
    in which order (from 1), and is null for the others. Ties go to the smaller doc_id, null last, then to fewer
    features and the smaller weight.

    Null and empty texts, and those without words, have no features, weight 0 and no rank. A null doc_id draws its
    noise from the seed alone. Repeated rows each have a result, with equal scores; a draw that ends among them takes
    some. An empty target leaves all buckets as the smoothing has them, and an empty table gives no rows. Other
    columns of docs aren't read. docs has to be a table or a plan that gives equal rows each time it runs.
    """
    if n < 1 or buckets < 1 or chunk < 1:
        raise ValueError("n, buckets and chunk have to be 1 at least")
    source = written(features(docs, n, buckets, chunk, long), "features")
    wanted = written(features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, chunk, long), "target-features")
    gain = F.broadcast(gains(source, wanted, buckets))  # as many rows as buckets
    each = source.select("row", "doc_id", "own", F.posexplode_outer("buckets").alias("at", "bucket")).join(gain, "bucket", "left")
    once = F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).otherwise(0)
    d = each.groupBy("row", "doc_id").agg(F.sum(once).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    down = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    d = written(d.select("row", "doc_id", "n_words", "n_features", down.alias("weight")).withColumn("score", F.col("weight") + noise), "scores")
    enough = d.filter(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("row").asc())
    ranked = numbered(enough, *order).withColumn("rank", F.when(F.col("nr") < drawn, F.col("nr") + 1).cast("long")).drop("nr")
    rest = d.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("row")


def drawn(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """The rows of docs that importance() drew; rows of one doc_id come together, and null ids don't."""
    return docs.join(scores.filter("rank is not null").select(F.col("doc_id").alias("_drawn")), F.col("doc_id") == F.col("_drawn"), "left_semi")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn by how like the benchmark's their words are."""
    out = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by a table of 256 values that the SQL computes, over the distinct words.
SQL = rf"""
with crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
docs as (select row_number() over () as row, doc_id, text from documents),
words as (
  select row, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as w from docs),
wanted as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as w from benchmark),
coded as (
  select w, hex(encode(w)) as x from (select w from words union select w from wanted) u),
hashed as (
  select w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} as bucket from coded, crc_table),
s as (select bucket, count(*) as s from words join hashed using (w) group by bucket),
t as (select bucket, count(*) as t from wanted join hashed using (w) group by bucket),
totals as (select (select coalesce(sum(s), 0) from s)::double + {BUCKETS} as all_s, (select coalesce(sum(t), 0) from t)::double + {BUCKETS} as all_t),
gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * all_s) / ((s + 1)::double * all_t)))::bigint as gain from s left join t using (bucket), totals),
sums as (
  select row, count(*) as n, sum(gain)::bigint as total from words join hashed using (w) join gains using (bucket) group by row),
scored as (
  select doc_id, coalesce(n, 0) as n_features,
    case when n > 0 then (total - ((total % n) + n) % n) // n else 0 end::bigint as weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from docs left join sums using (row)),
final as (
  select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
places as (
  select *, n_features >= {LEAST_WORDS} as enough, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last, n_features, weight) as place,
    count(*) over (partition by n_features >= {LEAST_WORDS}) * {PERCENT} // 100 as most from final)
select doc_id, n_features, weight, score, case when enough and place <= most then place end as rank from places"""
