"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are cut into ranges within each source, as many as its rows need, so
that a hot source spreads over many tasks; sums of the ranges, then sums within each range, give every document the
number of words before it in its source. A source is taken as many whole times as its target allows, then from the
front up to the exact rest.

Null text: size 0, nothing is taken. Null source: a source of its own, last. Null or repeated ids: each row counts.
Keys are made of id and text, so that null ids fall apart too; only rows that repeat tie, and they are alike. Whole
texts are counted, however long. Empty table: no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACED, materialise, used_up

SEED = "mix-1"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
ROWS_A_RANGE = 1_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (skey, source_size, ...), one row a source.

    With all targets at ``level * weight``, a source stops at ``most`` times its size. Sorted by size over weight,
    the stopped sources come first, and each prefix says which level the others would get.
    """
    turn = F.row_number().over(W.orderBy("skey")) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    return s.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight"))).drop("level", "stops", "cap")


def hash_key(doc_id: str, text: str, seed: str) -> Column:
    """Hash-random and the same in every run; only rows that repeat, id and text, share one."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))


def source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def placed(spark: SparkSession, docs: DataFrame, *, text="text", source="source", doc_id="doc_id", seed=SEED, weights=WEIGHTS, share=SHARE, most=MOST, rows_a_range=ROWS_A_RANGE) -> DataFrame:
    """(doc_id, source, skey, key, size, source_size, target, turns, rest, before) of every row: its source is taken
    ``turns`` times as a whole and up to ``rest`` words once more; ``before`` words of the source come first."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(source).alias("skey"), words(F.col(text)).alias("size"), hash_key(doc_id, text, seed).alias("key"))
    base = materialise(spark, base, "mix")
    per = base.groupBy("skey").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    per = targets(per, weights, share, most).select("skey", "source_size", "target", F.ceil(F.col("n") / rows_a_range).alias("ranges"))
    turns = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long")
    per = per.withColumn("turns", turns).withColumn("rest", F.floor(F.col("target") - F.col("turns") * F.col("source_size") + 0.5).cast("long"))
    per = materialise(spark, per, "mix-sources")
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32))
    rows = base.join(per, "skey").withColumn("range", at.cast("long"))
    sums = rows.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    ahead = F.sum("range_size").over(W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("skey", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("size").over(W.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    out = rows.withColumn("inside", inside).join(sums, ["skey", "range"])
    return out.select("doc_id", "source", "skey", "key", "size", "source_size", "target", "turns", "rest", (F.col("ahead") + F.col("inside")).alias("before"))


def more() -> Column:
    """Words that a placed row gives to the last, partial turn."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``."""
    return placed(spark, docs, **options).select("doc_id", "source", "size", "source_size", "target", (F.col("turns") * F.col("size") + more()).cast("long").alias("taken"))


def mixture(spark: SparkSession, docs: DataFrame, *, text="text", source="source", doc_id="doc_id", seed=SEED, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole or partial turn, the last one cut after the words it takes.

    What a row gives follows from its key and where its source is cut: a row a source. So no text is shuffled. Rows that
    repeat at the very cut of a source share what it leaves for them.
    """
    rows = materialise(spark, placed(spark, docs, text=text, source=source, doc_id=doc_id, seed=seed, **options).select("skey", "key", "size", "turns", "rest", "before"), "placed")
    per = rows.groupBy("skey").agg(F.max("turns").alias("__turns"), F.max(F.when((F.col("size") > 0) & (F.col("before") < F.col("rest")), F.col("key"))).alias("__cut"))
    per = materialise(spark, per.withColumnRenamed("skey", "__skey"), "cuts")
    tie = rows.join(per, (F.col("skey") == F.col("__skey")) & (F.col("key") == F.col("__cut"))).groupBy("__skey").agg(F.sum(more()).alias("__left"), F.count("*").alias("__rows"))
    before, per = per, materialise(spark, per.join(tie, "__skey", "left"), "cuts")
    used_up(spark, rows, before)
    d = docs.withColumns({"__skey": source_key(source), "__key": hash_key(doc_id, text, seed), "__size": words(F.col(text))}).where("__size > 0").join(per, "__skey")
    at_cut = F.coalesce(F.col("__key") == F.col("__cut"), F.lit(False))

    def emit(d: DataFrame, taken: Column) -> DataFrame:
        d = d.withColumn("__taken", taken).where("__taken > 0")
        last = F.ceil(F.col("__taken") / F.col("__size")).cast("long") - 1
        d = d.withColumn("__words", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.least("__size", F.col("__taken") - i * F.col("__size")))))
        head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{SPACED}"), 0), 1, F.col("__words").cast("int")), "")
        return d.withColumn(text, F.when(F.col("__words") < F.col("__size"), head).otherwise(F.col(text)))

    extra = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(at_cut, F.col("__left")).otherwise(F.lit(0))
    out = emit(d.where(~at_cut | (F.col("__rows") == 1)), F.col("__turns") * F.col("__size") + extra)
    if per.where("__rows > 1").limit(1).count():
        many = d.where(at_cut & (F.col("__rows") > 1)).dropDuplicates(["__skey", "__key"])
        out = out.unionByName(emit(many, F.col("__rows") * F.col("__turns") * F.col("__size") + F.col("__left")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
p AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY skey) - 1) % 3]::DOUBLE AS weight FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, source_size, CASE WHEN cap <= level * weight THEN cap
        ELSE weight * max(CASE WHEN cap <= level * weight THEN NULL ELSE level END) OVER () END AS target FROM l),
b AS (SELECT d.*, t.source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t USING (skey)),
f AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS turns FROM b)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(turns * size + greatest(0, least(size, CAST(floor(target - turns * source_size + 0.5) AS BIGINT) - ahead)) AS BIGINT) AS taken FROM f
"""
