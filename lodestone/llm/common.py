"""What the training-data operators share: the held-out folds, slices of batches, bitmaps of keys, streaming by key."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, fresh_path, materialise, shared_dir, used_up

__all__ = ["discard", "fresh_path", "materialise", "shared_dir", "used_up"]

#: A word: letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
#: A word of the contracts that count words: anything between ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Bits of a sieve: 16 MB, at any number of keys.
SIEVE_BITS = 1 << 27


def sliced(batches, rows: int = 512):
    """Arrow batches cut into slices of few rows: texts can be long, and Python objects are made a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A digest of id and text, which tells rows apart; only rows that repeat both share it."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def sieve(spark: SparkSession, keys: DataFrame, tag: str) -> DataFrame:
    """A bitmap of the hashes of ``keys`` (one column), written out: at most SIEVE_BITS bits whatever the number of keys,
    so it may always be broadcast. It keeps rows that surely have no partner out of a shuffle; where it lets others
    through (the more, the more keys there are), the join behind it decides."""
    at = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(SIEVE_BITS)).alias("x"))
    return materialise(spark, at.groupBy(F.bitmap_bucket_number("x").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits")), f"sieve-{tag}")


def sifted(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``df`` with ``__may``: false where ``key`` is surely not among the keys of the sieve ``bits``."""
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    d = df.withColumn("__bucket", F.bitmap_bucket_number(at)).withColumn("__at", F.bitmap_bit_position(at)).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.substr("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return d.withColumn("__may", F.coalesce(F.bit_get(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__at", "__bits")


def with_fields(schema: T.StructType, **more: str) -> T.StructType:
    """A schema with further columns, by name and type."""
    return T.StructType([*schema.fields, *(T.StructField(k, T.StructType.fromDDL(f"x {v}")["x"].dataType) for k, v in more.items())])


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text modulo 5; a null id counts as the empty text. 0 is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return fold(doc_id) == 0


def hash_share(key: Column, share: float | Column) -> Column:
    """True for about ``share`` of the keys, always the same ones, at any share down to 1e-18."""
    share = F.lit(share) if isinstance(share, float | int) else share
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)).cast("double") < F.least(share.cast("double"), F.lit(1.0)) * float(1 << 63)


def keyed_runs(batches, key: str):
    """From Arrow batches sorted by ``key``: (key, table of all its rows), one key in memory at a time."""
    held, at = [], None
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(1, len(col) + 1):
            if i == len(col) or col[i] != col[start]:
                if held and at != col[start]:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = col[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield at, pa.Table.from_batches(held)
