"""Mixing sources to target weights by capped water-filling.

The targets share a total by weight; a source that would exceed its number of epochs stops there, and the excess
goes to the others by weight until none is above. Each document is then repeated as often as its source's rate
says: the whole part for all documents, and the fraction for those with the smallest seeded hashes, up to the
hash at which the source's words come nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, table, unused, written

#: The query's weights, repeating over the sources by code point, null last.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Bits of the hash that each round of the cut search settles, and the hash's bits in all: 15 hex digits of MD5.
ROUND_BITS, HASH_BITS = 12, 60


def water_fill(sources: DataFrame, total_share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to (source, weight, source_size): the fixed point of clamping and resharing.

    Each round sums up the sources that the level of the round before clamps, and the weight of the others, to which
    the rest goes; it ends when no more are clamped. The sources stay a table: three numbers a round come to the
    driver. Sources of weight zero get no target; if all are clamped, each has its cap.
    """
    x = sources.withColumn("cap", max_epochs * F.col("source_size"))
    total = total_share * (x.agg(F.sum("source_size")).first()[0] or 0)
    open_ = x.filter("weight > 0").select("weight", "cap", (F.col("cap") / F.col("weight")).alias("ratio"))
    level, clamped = float("-inf"), -1
    while True:
        shut = F.col("ratio") <= F.lit(level)
        spent, weight, n = open_.agg(F.sum(F.when(shut, F.col("cap"))), F.sum(F.when(~shut, F.col("weight"))), F.count_if(shut)).first()
        if n == clamped or not weight:
            level = level if weight else float("inf")
            break
        level, clamped = (total - (spent or 0.0)) / weight, n
    target = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.col("weight") * F.lit(level), F.col("cap")))
    return x.withColumn("target", target).select("source", "weight", "source_size", "target")


def _cut(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): documents whose hash is below cut take one more repetition.

    Each round sums the words by source and the hash's next bits, which map-side sums shrink to some thousand
    rows a source, and goes on within the one bin in which the wanted number of words is passed. After the last
    round a bin is one hash value; the cut falls before or after it, whichever is nearer. The state is a table of one
    row a source; Spark broadcasts it where it is small, and joins by source where it isn't.
    """
    state = wanted.withColumn("low", F.lit(0).cast("long"))
    for done in range(0, HASH_BITS, ROUND_BITS):
        width = 1 << (HASH_BITS - done - ROUND_BITS)
        span = width << ROUND_BITS
        inside = hashed.join(state, F.expr("source <=> s_source") & (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(span)))
        bins = inside.groupBy("s_source", "low", "want", F.expr(f"(hash - low) div {width}").alias("bin")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("s_source").orderBy("bin")
        run = bins.withColumn("upto", F.sum("words").over(w)).withColumn("above", F.col("upto") - F.col("words"))
        passed = run.groupBy("s_source").agg(
            F.min(F.when(F.col("upto") >= F.col("want"), F.struct("bin", "above", "words", "low", "want"))).alias("x"),
        )
        state = passed.filter("x is not null").select(
            "s_source", (F.col("x.want") - F.col("x.above")).alias("want"), (F.col("x.low") + F.col("x.bin") * F.lit(width)).alias("low"), F.col("x.words").alias("last"),
        )
        state = written(state, "cut")
    return state.select(F.col("s_source"), (F.col("low") + F.when(F.col("want") * 2 >= F.col("last"), 1).otherwise(0)).alias("cut"))


def _taken(docs: DataFrame, weights: tuple[float, ...] | dict, total_share: float, max_epochs: float, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target and copies beside its own columns, and the names that these have there."""
    spark = docs.sparkSession
    names = {c: unused(f"mix_{c}", docs.columns) for c in ("size", "source_size", "target", "copies", "hash", "source", "whole", "cut")}
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(text)))
    base = docs.withColumns({names["size"]: n_words(F.col("text")), names["hash"]: F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")})
    # what the sums and the cut search need, without texts: they read it several times
    slim = written(base.select("source", F.col(names["hash"]).alias("hash"), F.col(names["size"]).alias("size")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, dict):
        listed = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "listed string, weight double")
        sources = sizes.join(listed, F.expr("source <=> listed"), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        values = F.array(*[F.lit(float(w)) for w in weights])
        sources = numbered(sizes, F.col("source").isNull(), F.col("source")).withColumn("weight", F.element_at(values, (F.col("nr") % len(weights) + 1).cast("int"))).drop("nr")
    filled = water_fill(written(sources, "sources"), total_share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = filled.withColumn("whole", F.floor(rate + F.lit(1e-12)).cast("long"))
    plan = plan.withColumn("want", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = written(plan.select(F.col("source").alias("s_source"), "source_size", "target", "whole", "want"), "targets")
    cuts = _cut(slim.filter("size > 0"), plan.filter("want > 0").select("s_source", "want")).withColumnRenamed("s_source", "c_source")
    plan = plan.join(cuts, F.expr("s_source <=> c_source"), "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    plan = written(plan.select("s_source", "source_size", "target", "whole", "cut"), "plan")
    plan = plan.select(*[F.col(c).alias(names[c.removeprefix("s_")]) if c == "s_source" else F.col(c).alias(names[c]) for c in plan.columns])
    size, whole, cut, h = (F.col(names[c]) for c in ("size", "whole", "cut", "hash"))
    copies = F.when(size > 0, whole + F.when(h < cut, 1).otherwise(0)).otherwise(0)
    out = base.join(plan, F.col("source").eqNullSafe(F.col(names["source"])), "left").withColumn(names["copies"], copies.cast("long"))
    return out, names


def mix(docs: DataFrame, weights: tuple[float, ...] | dict = WEIGHTS, total_share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Every row of docs(doc_id, text, source) with size, source_size, target and copies (repetitions taken).

    weights: by source name, or a tuple that repeats over the sources by code point, null last. Null text has no
    words. A null source is a source of its own. The seeded hash is of doc_id and the text, so repeated rows and
    reruns get the same copies; rows with equal hashes are taken or left together. Empty tables give no rows. A
    source without words has target 0 and its documents no copies. Extra columns pass through untouched, and the
    columns made here replace any of the same name. The sums by source stay a table of one row a source.
    """
    new = ("size", "source_size", "target", "copies")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    out, names = _taken(docs, weights, total_share, max_epochs, seed)
    return out.select(*keep, *[F.col(names[c]).alias(c) for c in new])


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] | dict = WEIGHTS, total_share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with each row as many times as the mix takes it. Documents without words take no part in the shares and stay once."""
    out, names = _taken(docs, weights, total_share, max_epochs, seed)
    times = F.when(F.col(names["size"]) > 0, F.col(names["copies"])).otherwise(1).cast("int")
    out = out.filter(times > 0).withColumn(names["copies"], F.explode(F.array_repeat(F.lit(1), times)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by WEIGHTS to SHARE of all words under MAX_EPOCHS."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


SQL = rf"""
with base as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('{SEED}/' || coalesce(cast(doc_id as varchar), '') || '/' || md5(coalesce(text, ''))), 1, {HASH_BITS // 4}) as bigint) as hash
  from documents),
sizes as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as nr from base group by source),
weighed as (
  select *, case nr % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, {MAX_EPOCHS}::double * source_size as cap from sizes),
levels as (
  select *, cap / weight as ratio,
    ({SHARE}::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, nr rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, nr rows between current row and unbounded following) as level
  from weighed),
level as (select arg_min(level, (ratio, nr)) as level from levels where ratio > level),
targets as (
  select l.source, l.source_size, least(coalesce(weight * level.level, cap), cap) as target from levels l, level),
plans as (
  select *, floor(case when source_size > 0 then target / source_size else 0 end + 1e-12)::bigint as whole from targets),
runs as (
  select b.source, b.hash, sum(b.size) as here, sum(sum(b.size)) over (partition by b.source order by b.hash) as upto
  from base b where b.size > 0 group by b.source, b.hash),
cuts as (
  select p.source, min(case when upto >= want then struct_pack(a := hash, b := upto - here, c := here) end) as x, any_value(want) as want
  from (select *, greatest(target - whole * source_size, 0) as want from plans) p join runs r on p.source is not distinct from r.source
  where want > 0 group by p.source),
cut as (
  select source, x.a + case when (want - x.b) * 2 >= x.c then 1 else 0 end as cut from cuts),
counted as (
  select b.doc_id, b.size, p.source_size, p.target,
    case when b.size > 0 then p.whole + case when b.hash < coalesce(c.cut, 0) then 1 else 0 end else 0 end::bigint as copies
  from base b join plans p on b.source is not distinct from p.source left join cut c on b.source is not distinct from c.source)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies from counted"""
