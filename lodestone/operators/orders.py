"""Orders and leases as batch algebra. Instants are parameters, never the clock."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

PATCHABLE = ("order_type", "status", "amount", "currency", "description")


def amend(orders: DataFrame, patches: DataFrame, now: Column, fields=PATCHABLE) -> DataFrame:
    """Apply sparse patches (order_id, expected_version, user_id, fields): what is not null and differs is taken over.

    One row an order, with ``result``: 'none' (no patch), 'unchanged', 'conflict' (another version), 'amended' (version +
    1, updated). Of several patches of one order one counts, as the version has moved on for the others: the first by
    user, then by its fields, of those that expect the order's version; if none does it is a conflict.
    """
    p = patches.select("order_id", F.struct("user_id", *fields, F.col("expected_version").alias("v")).alias("p"))
    p = p.groupBy("order_id", F.col("p.v").alias("v")).agg(F.min("p").alias("p")).groupBy("order_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("v", F.lit(-1)).alias("v"), "p"))).alias("__p"))  # a patch a version
    d = orders.join(p, "order_id", "left").withColumn("__own", F.coalesce(F.try_element_at("__p", F.col("version")), F.try_element_at("__p", F.lit(-1))))
    new = lambda f: F.col("__own")[f]
    changed = functools.reduce(lambda a, b: a | b, (new(f).isNotNull() & ~new(f).eqNullSafe(F.col(f)) for f in fields))
    result = F.when(F.col("__p").isNull(), "none").when(F.col("__own").isNull(), "conflict").when(changed, "amended").otherwise("unchanged")
    d = d.withColumn("result", result)
    won = F.col("result") == "amended"
    cols = {f: F.when(won & new(f).isNotNull(), new(f)).otherwise(F.col(f)) for f in fields}
    cols |= {"updated_by": F.when(won, new("user_id")).otherwise(F.col("updated_by")), "updated_at": F.when(won, now).otherwise(F.col("updated_at")), "version": F.when(won, F.col("version") + 1).otherwise(F.col("version"))}
    return d.withColumns(cols).select(*orders.columns, "result")


def active(locks: DataFrame, now: Column) -> DataFrame:
    return locks.where(F.col("is_active") & (F.col("expires_at") > now))


def expire(locks: DataFrame, now: Column) -> DataFrame:
    """Active locks from before ``now`` become inactive; at the very instant they are neither."""
    return locks.withColumn("is_active", F.col("is_active") & ~(F.col("expires_at") < now))


def purge(locks: DataFrame, now: Column) -> DataFrame:
    return locks.where(~(F.col("is_active") & (F.col("expires_at") < now)))


def validate(locks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests (token, user_id) with ``valid``: the token's lock is active, the user's, and not expired."""
    k = locks.select(F.col("lock_token").alias("token"), "locked_by", "is_active", "expires_at")
    ok = F.col("is_active") & (F.col("locked_by") == F.col("user_id")) & (F.col("expires_at") > now)
    return requests.join(k, "token", "left").withColumn("valid", F.coalesce(ok, F.lit(False))).select(*requests.columns, "valid")


def expire_count(locks: DataFrame, now: Column) -> DataFrame:
    """(expired): how many locks ``expire`` makes inactive."""
    return locks.agg(F.count_if(F.col("is_active") & (F.col("expires_at") < now)).alias("expired"))


def extend(locks: DataFrame, requests: DataFrame, now: Column, default_seconds=300) -> DataFrame:
    """Valid requests (token, user_id, seconds) push the old expiry on, each of several of one owner by its own seconds.
    One row a lock."""
    r = requests.groupBy(F.col("token").alias("lock_token"), F.col("user_id").alias("locked_by")).agg(F.sum(F.coalesce("seconds", F.lit(default_seconds))).alias("__s"))
    go = F.col("is_active") & F.col("__s").isNotNull() & (F.col("expires_at") > now)
    later = F.col("expires_at") + F.make_dt_interval(secs=F.col("__s"))
    return locks.join(r, ["lock_token", "locked_by"], "left").withColumn("expires_at", F.when(go, later).otherwise(F.col("expires_at"))).select(*locks.columns)


def release(locks: DataFrame, requests: DataFrame) -> DataFrame:
    """The owner's requests (token, user_id) make active locks inactive, expired ones too; whoever else asks changes
    nothing. One row a lock."""
    r = requests.select(F.col("token").alias("lock_token"), F.col("user_id").alias("locked_by")).distinct().withColumn("__go", F.lit(True))
    d = locks.join(r, ["lock_token", "locked_by"], "left")
    return d.withColumn("is_active", F.col("is_active") & F.col("__go").isNull()).select(*locks.columns)


def find(orders: DataFrame, **fields) -> DataFrame:
    """Orders whose fields have the given values: by id, number, client, status, or several of them."""
    return orders.where(functools.reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in fields.items())))


def with_orders(locks: DataFrame, orders: DataFrame, fields=("order_number", "client_id", "status")) -> DataFrame:
    """Locks beside the order that they are on."""
    return locks.join(orders.select("order_id", *fields), "order_id")


def delete(orders: DataFrame, locks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, locks) without the orders of ``gone`` (order_id): their locks go with them."""
    ids = gone.select("order_id").distinct()
    return orders.join(ids, "order_id", "left_anti").select(*orders.columns), locks.join(ids, "order_id", "left_anti").select(*locks.columns)


def can_amend(orders: DataFrame, locks: DataFrame, now: Column) -> DataFrame:
    """order_id of orders without an active lock, whoever holds it."""
    return orders.select("order_id").join(active(locks, now).select("order_id").distinct(), "order_id", "left_anti")


def create(orders: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Rows of ``new`` whose order number is not taken yet, with defaults; of equal new numbers the first by client. Ids
    go on from the largest order_id, in the order of the numbers."""
    from .label import with_row_ids

    first = new.groupBy("order_number").agg(F.min(F.struct("client_id", *(c for c in new.columns if c not in ("order_number", "client_id")))).alias("r")).select("order_number", "r.*")
    d = with_row_ids(first.join(orders.select("order_number"), "order_number", "left_anti"), "order_number")
    top = orders.agg(F.coalesce(F.max("order_id"), F.lit(0)).cast("long").alias("__top"))
    d = d.join(F.broadcast(top)).withColumn("order_id", F.col("__top") + F.col("row_id") + 1)  # one row
    d = d.withColumns({"status": F.coalesce("status", F.lit("PENDING")), "currency": F.coalesce("currency", F.lit("USD")), "version": F.lit(1), "created_at": now, "updated_at": now})
    return d.select("order_id", *new.columns, "version", "created_at", "updated_at")


def error_status(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in rules.ERROR_STATUS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.lit(400))


def grant(requests: DataFrame, *, lease_seconds=30, key="order_id") -> DataFrame:
    """Lease requests (key, request_id, ts) with ``granted``: in order of time, a request wins if no granted lease is
    still running. A fold, as each answer depends on the ones before; keys are independent and fold as streams of rows."""
    def run(batches):
        at, until = None, 0
        for b in batches:
            out = []
            for k, t in zip(b["__k"].to_pylist(), b["__t"].to_pylist(), strict=True):
                if k != at:
                    at, until = k, None
                ok = until is None or t >= until
                if ok:
                    until = t + lease_seconds * 1_000_000
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b[key], b["request_id"], pa.array(out, pa.bool_())], [key, "request_id", "granted"])

    d = requests.select(key, "request_id", F.col(key).cast("string").alias("__k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__t"))
    d = d.repartition("__k").sortWithinPartitions("__k", "__t", "request_id")
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, request_id {d.schema['request_id'].dataType.simpleString()}, granted boolean")
