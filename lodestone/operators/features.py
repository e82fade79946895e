"""Token features: vocabulary, encoding, n-gram hashes, class scores, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import let
from ..storage import materialise

#: Multipliers of the n-gram hashes.
FIRST, SECOND = 14918087, 18408749


def vocabulary(docs: DataFrame, text="text", key="doc_id", *, least=1, most=10_000, by_char=False) -> DataFrame:
    """(token, id): the commonest tokens, ties by first place (row by ``key``, then position); <UNK> and <PAD> follow."""
    parts = F.split(F.btrim(text, F.lit(" \t\r\n")), "" if by_char else " ")
    t = docs.select(key, F.posexplode(parts).alias("pos", "token")).where("token <> ''")
    n = t.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first")).where(F.col("n") >= least)
    top = n.orderBy(F.desc("n"), "first").limit(most)
    ranked = top.select("token", (F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1).alias("id"))  # at most ``most`` rows
    size = ranked.agg(F.count("*").cast("int").alias("k"))
    more = size.select(F.explode(F.array(F.struct(F.lit("<UNK>").alias("token"), F.col("k").alias("id")), F.struct(F.lit("<PAD>").alias("token"), (F.col("k") + 1).alias("id")))).alias("r")).select("r.*")
    return ranked.unionByName(more)


def encode(docs: DataFrame, vocab: DataFrame, text="text", key="doc_id", *, size=32, by_char=False, pad_as_unk=False) -> DataFrame:
    """(key, ids, seq_len): the first ``size`` tokens as ids, padded. Rows must have different keys.

    Text is cut no further than it takes to find ``size`` tokens; tokens are looked up by a join, and what has no id at
    first is unknown. The vocabulary is bounded (10,000 by default) and small enough to be broadcast, which Spark checks.
    """
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    full = lambda parts: F.filter(parts, lambda x: x != "")
    # blanks in a row leave empty tokens: twice the size is nearly always enough, else the whole text is cut
    few = F.split(trimmed, "" if by_char else " ", 2 * size + 1)
    cut = lambda parts: F.when((F.size(parts) <= 2 * size) | (F.size(full(F.slice(parts, 1, 2 * size))) >= size), full(F.slice(parts, 1, 2 * size))).otherwise(full(F.split(trimmed, "" if by_char else " ")))
    tokens = docs.select(F.col(key), F.slice(let(few, cut), 1, size).alias("__t"))
    vocab = materialise(vocab.sparkSession, vocab, "vocabulary")
    marks = vocab.where(F.col("token").isin("<UNK>", "<PAD>")).agg(F.max(F.when(F.col("token") == "<UNK>", F.col("id"))).alias("__unk"), F.max(F.when(F.col("token") == "<PAD>", F.col("id"))).alias("__pad"))
    rows = tokens.select(key, F.size("__t").alias("seq_len"), F.posexplode_outer("__t").alias("__at", "token"))
    rows = rows.join(vocab.where(~F.col("token").isin("<UNK>", "<PAD>")), "token", "left")
    got = rows.groupBy(key).agg(F.max("seq_len").alias("seq_len"), F.array_sort(F.collect_list(F.struct("__at", "id"))).alias("__ids")).join(F.broadcast(marks))  # one row
    ids = F.transform(F.filter("__ids", lambda x: x["__at"].isNotNull()), lambda x: F.coalesce(x["id"], F.col("__unk")))
    pad = F.col("__unk" if pad_as_unk else "__pad")
    return got.select(key, F.concat(ids, F.array_repeat(pad, F.lit(size) - F.col("seq_len"))).alias("ids"), "seq_len")


def bigrams(ids: Column, buckets: int) -> Column:
    """Hash of the token before each place; 0 before the start."""
    before = lambda i, k: F.when(i >= k, F.get(ids, i - k)).otherwise(0).cast("long")
    return F.transform(ids, lambda _, i: F.pmod(before(i, 1) * FIRST, F.lit(buckets)))


def trigrams(ids: Column, buckets: int) -> Column:
    before = lambda i, k: F.when(i >= k, F.get(ids, i - k)).otherwise(0).cast("long")
    return F.transform(ids, lambda _, i: F.pmod(before(i, 2) * FIRST * SECOND + before(i, 1) * FIRST, F.lit(buckets)))


def softmax(scores: Column) -> Column:
    powers = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
    return let(powers(scores), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def top_classes(scores: Column, k: int) -> Column:
    """The k best as array<struct<score, label>>, ties to the smaller label."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("label")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("score"), p["label"].alias("label")))


def weighted_argmax(scores: Column, weights) -> Column:
    """Place of the largest weighted score, the first of equals."""
    return let(F.zip_with(scores, F.array(*map(F.lit, weights)), lambda a, b: a * b), lambda w: F.array_position(w, F.array_max(w)).cast("int") - 1)


def mean_pool(vectors: DataFrame, group: str, vector: str, size: int, mask: Column | None = None) -> DataFrame:
    """Mean vector of each group over the rows of the mask."""
    d = vectors if mask is None else vectors.where(mask)
    return d.groupBy(group).agg(F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(size))).alias("mean"))


def max_pool(vectors: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    return vectors.groupBy(group).agg(F.array(*(F.max(F.col(vector)[i].cast("double")) for i in range(size))).alias("max"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """batch_no of each row; the last batch may be short."""
    from .label import with_row_ids

    return with_row_ids(df, order).withColumn("batch_no", F.floor(F.col("row_id") / size)).drop("row_id")


def best_so_far(df: DataFrame, order: str, score: str, group: str | None = None) -> DataFrame:
    """The largest score up to each row. Without a group rows are numbered first, and blocks of them follow each other."""
    if group:
        return df.withColumn("best", F.max(score).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    from .label import with_row_ids

    d = with_row_ids(df, order).withColumn("__b", F.floor(F.col("row_id") / 100_000))
    tops = d.groupBy("__b").agg(F.max(score).alias("__top"))
    tops = tops.withColumn("__before", F.max("__top").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__top")  # a row a block
    inside = F.max(score).over(W.partitionBy("__b").orderBy("row_id").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("__in", inside).join(tops, "__b").withColumn("best", F.greatest("__in", "__before")).select(*df.columns, "best")
