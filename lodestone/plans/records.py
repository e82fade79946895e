"""Queries over orders, leases, events, labels and conversations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..operators import label, orders, validate
from ..sources import files
from ..streaming import leases
from .citations import sql_of, table

NOW = "TIMESTAMP_NTZ '2024-01-15 12:00:00'"
LOCKS = (
    "SELECT event_id AS id, user_id AS order_id, 'u' || CAST(event_id % 7 AS STRING) AS locked_by, ts AS locked_at, ts + INTERVAL 6 HOURS AS expires_at, 'tok' || CAST(event_id AS STRING) AS lock_token, event_type <> 'error' AS is_active FROM events"
)
ORDERS = (
    "SELECT o_orderkey AS order_id, 'ORD-' || CAST(o_orderkey AS STRING) AS order_number, CAST(o_custkey AS STRING) AS client_id, o_orderpriority AS order_type, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(15,2)) AS amount,"
    " 'USD' AS currency, CAST(NULL AS STRING) AS description, o_orderdate AS updated_at, 'system' AS updated_by, 1 AS version FROM orders"
)
PATCHES = (
    "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS expected_version, 'user' || CAST(o_custkey % 3 AS STRING) AS user_id, CAST(NULL AS STRING) AS order_type,"
    " CASE WHEN o_orderkey % 4 = 0 THEN 'F' END AS status, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_totalprice + 1 AS DECIMAL(15,2)) WHEN o_orderkey % 6 = 2 THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS amount,"
    " CAST(NULL AS STRING) AS currency, CAST(NULL AS STRING) AS description FROM orders WHERE o_orderkey % 2 = 0"
    " UNION ALL SELECT o_orderkey, 1, 'user' || CAST(o_orderkey % 4 AS STRING), CAST(NULL AS STRING), 'X', CAST(NULL AS DECIMAL(15,2)), CAST(NULL AS STRING), 'second patch' FROM orders WHERE o_orderkey % 3 = 0"
)
#: Strangers ask for every third lock, and for every sixth its owner too, twice for every twelfth.
REQUESTS = (
    "SELECT 'tok' || CAST(event_id AS STRING) AS token, 'u' || CAST(event_id % 5 AS STRING) AS user_id, CASE WHEN event_id % 2 = 0 THEN 60 END AS seconds FROM events WHERE event_id % 3 = 0"
    " UNION ALL SELECT 'tok' || CAST(event_id AS STRING), 'u' || CAST(event_id % 7 AS STRING), 30 FROM events WHERE event_id % 6 = 0"
    " UNION ALL SELECT 'tok' || CAST(event_id AS STRING), 'u' || CAST(event_id % 7 AS STRING), CAST(NULL AS INT) FROM events WHERE event_id % 12 = 0"
)
now = lambda: F.expr(NOW)


def locks(spark, sf_dir):
    return sql_of(spark, sf_dir, LOCKS, "events")


def requests(spark, sf_dir):
    return sql_of(spark, sf_dir, REQUESTS, "events")


def client_orders(spark, sf_dir):
    return sql_of(spark, sf_dir, ORDERS, "orders")


def orders_by_id(spark, sf_dir):
    return orders.find(client_orders(spark, sf_dir), order_id=7).select("order_id", "order_number", "client_id")


def orders_by_number(spark, sf_dir):
    return orders.find(client_orders(spark, sf_dir), order_number="ORD-32").select("order_id", "order_number", "status")


def orders_by_customer(spark, sf_dir):
    return orders.find(client_orders(spark, sf_dir), client_id="7").select("order_id", "client_id", "status")


def orders_of_status(spark, sf_dir):
    return orders.find(client_orders(spark, sf_dir), status="P").select("order_id", "status")


def orders_by_customer_and_status(spark, sf_dir):
    return orders.find(client_orders(spark, sf_dir), client_id="7", status="O").select("order_id", "client_id", "status")


def locks_with_orders(spark, sf_dir):
    return orders.with_orders(locks(spark, sf_dir), client_orders(spark, sf_dir)).select("lock_token", "order_id", "order_number", "status")


def _deleted(spark, sf_dir):
    return orders.delete(client_orders(spark, sf_dir), locks(spark, sf_dir), client_orders(spark, sf_dir).where("order_id % 4 = 0"))


def cascade_delete(spark, sf_dir):
    """What is left of orders and locks once every fourth order is deleted."""
    o, k = _deleted(spark, sf_dir)
    return o.select(F.lit("order").alias("what"), F.col("order_id").cast("long").alias("id")).unionByName(k.select(F.lit("lock").alias("what"), F.col("id").cast("long").alias("id")))


def expire_count(spark, sf_dir):
    return orders.expire_count(locks(spark, sf_dir), now())


def score_matches(spark, sf_dir):
    """Scores by an inner join on three keys."""
    a, b = (d.select("doc_id", (F.col("doc_id") % 10).alias("b"), F.lit("x").alias("c")) for d in _pairs(spark, sf_dir))
    return _rounded(label.f1_of_matches(a, b, ["doc_id", "b", "c"]))


def orders_by_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("total"))


def order_exists(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select("c_custkey")
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return asked.join(have, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_orders"))


def amend_patch(spark, sf_dir):
    out = orders.amend(client_orders(spark, sf_dir), sql_of(spark, sf_dir, PATCHES, "orders"), now())
    return out.select("order_id", "status", "description", F.col("amount").cast("double").alias("amount"), "updated_by", "updated_at", "version", "result")


def create_orders(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("ORD-"), (F.col("c_custkey") * 20).cast("string")).alias("order_number"), F.col("c_name").alias("client_id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("currency"))
    return orders.create(client_orders(spark, sf_dir), new, now())


def error_statuses(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("ORDER_NOT_FOUND", "INVALID_LOCK", "ORDER_ALREADY_LOCKED", "OTHER"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(orders.error_status(code).alias("status")).agg(F.count("*").alias("n"))


def active_locks(spark, sf_dir):
    return orders.active(locks(spark, sf_dir), now()).select("lock_token", "order_id", "expires_at")


def expire_locks(spark, sf_dir):
    return orders.expire(locks(spark, sf_dir), now()).select("lock_token", "is_active")


def purge_locks(spark, sf_dir):
    return orders.purge(locks(spark, sf_dir), now()).select("lock_token")


def validate_locks(spark, sf_dir):
    return orders.validate(locks(spark, sf_dir), requests(spark, sf_dir), now()).select("token", "user_id", "valid")


def extend_locks(spark, sf_dir):
    return orders.extend(locks(spark, sf_dir), requests(spark, sf_dir), now()).select("lock_token", "expires_at")


def release_locks(spark, sf_dir):
    return orders.release(locks(spark, sf_dir), requests(spark, sf_dir)).select("lock_token", "is_active")


def can_amend(spark, sf_dir):
    return orders.can_amend(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("order_id")), locks(spark, sf_dir), now())


def first_lock_wins(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("request_id"), "ts")
    return orders.grant(r, lease_seconds=86_400)


def validation_errors(spark, sf_dir):
    checks = {"name_blank": validate.not_blank(F.col("c_name")), "segment_long": F.length("c_mktsegment") <= 9, "amount_low": F.col("c_acctbal") >= 0.01}
    return table(spark, sf_dir, "customer").select("c_custkey", validate.violations(**checks).alias("errors")).where("size(errors) > 0")


def event_gap_clusters(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("new", F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) < 3_600_000_000, 0).otherwise(1))
    e = e.withColumn("cluster", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def gap_sessions(spark, sf_dir):
    return leases.gap_sessions(table(spark, sf_dir, "events"), gap="1 hour").select("user_id", "start", "n")


def json_nonblank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.where(validate.not_blank(F.col("k")) & (F.col("k").cast("int") % 2 == 0)).select("event_id", F.col("k").cast("int").alias("k"))


def json_summary(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(k > 50).alias("large"))


def conversation_chunks(spark, sf_dir):
    """Turns as chunks of one result a conversation; every fifth is blank and goes."""
    value = F.when(F.col("turn") % 5 == 4, F.lit(" ")).otherwise(F.col("role"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.lit("turn").alias("pattern_name"), F.lit("").alias("chunk_text"), value.alias("result_value"))).alias("chunks"))
    c = c.withColumn("found_items", F.array().cast("array<struct<type:string,article_id:string,identifier:string>>"))
    return files.filter_blank(c).select("conv_id", F.size("chunks").alias("n_chunks"), "original_chunks", "filtered_out_chunks")


def last_annotation_wins(spark, sf_dir):
    return files.last_wins(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn")


def group_promotion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"), F.when(F.col("l_returnflag") == "R", "Primary").otherwise("Secondary").alias("type"))
    return label.promote(li, ("l_suppkey", "y"), exempt=F.col("l_suppkey") % 10 == 0).groupBy("l_suppkey", "y", "type").agg(F.count("*").alias("n"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")


def dedupe_min_type(spark, sf_dir):
    d = _labels(spark, sf_dir).select(F.col("source").alias("article_id"), (F.col("n_chars") % 10).cast("string").alias("dataset_id"), F.when(F.col("quality") == 1, "Primary").when(F.col("toxic") == 1, "Secondary").alias("type"))
    return label.one_label(d)


def row_ids(spark, sf_dir):
    return label.with_row_ids(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


def top_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def _pairs(spark, sf_dir):
    d = _labels(spark, sf_dir)
    return d.where("quality = 1").select("doc_id"), table(spark, sf_dir, "documents").where("n_chars > 1000 AND doc_id % 3 <> 1").select("doc_id")


def score_f1(spark, sf_dir):
    return _rounded(label.f1(label.outcome(*_pairs(spark, sf_dir), ["doc_id"])))


def score_slices(spark, sf_dir):
    return _rounded(label.f1(label.outcome(*_pairs(spark, sf_dir), ["doc_id"]), F.when(F.col("doc_id") % 2 == 0, "doi").otherwise("accession")))


def _rounded(d):
    return d.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def true_minus_detected(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return label.difference(a, b, ["doc_id"])


def detected_minus_true(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return label.difference(b, a, ["doc_id"])


def without_missing(spark, sf_dir):
    t = F.when(F.col("o_orderstatus") == "P", "Missing").when(F.col("o_orderstatus") == "F", "Primary").otherwise("Secondary")
    return label.scored_labels(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.col("o_orderkey").alias("dataset_id"), t.alias("type")))


def primary_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " Data were deposited.").otherwise("")).alias("text"))
    return d.select("doc_id", label.primary_gate(F.col("text")).alias("primary"))


def confusion_matrix(spark, sf_dir):
    d = _labels(spark, sf_dir).withColumn("guess", (F.col("n_chars") > 500).cast("int"))
    c = label.confusion(d, "quality", "guess", (0, 1))
    return c.select("quality", F.col("0").alias("guess_0"), F.col("1").alias("guess_1"))


def class_report(spark, sf_dir):
    d = _labels(spark, sf_dir).withColumn("guess", (F.col("n_chars") > 500).cast("int"))
    return _rounded(label.class_report(d, "quality", "guess"))


QUERIES = {
    f.__name__: f
    for f in (
        orders_by_id, orders_by_number, orders_by_customer, orders_of_status, orders_by_customer_and_status, locks_with_orders, cascade_delete, expire_count, score_matches, orders_by_status, order_exists, amend_patch, create_orders, error_statuses, active_locks, expire_locks, purge_locks, validate_locks, extend_locks, release_locks, can_amend,
        first_lock_wins, validation_errors, event_gap_clusters, gap_sessions, json_nonblank, json_summary, conversation_chunks, last_annotation_wins, group_promotion, dedupe_min_type, row_ids, top_rows,
        value_counts, score_f1, score_slices, true_minus_detected, detected_minus_true, without_missing, primary_gate, confusion_matrix, class_report,
    )
}

# --- SQL ----------------------------------------------------------------------------------------------------------------

_N = "TIMESTAMP '2024-01-15 12:00:00'"
_K = f"k AS ({LOCKS.replace('INTERVAL 6 HOURS', 'INTERVAL 6 HOUR')})"
_R = f"r AS ({REQUESTS})"
_A = "a AS (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), b AS (SELECT doc_id FROM documents WHERE n_chars > 1000 AND doc_id % 3 <> 1)"
_F = "round(coalesce(p, 0), 9) AS precision, round(coalesce(r, 0), 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1"
_O = f"{_A}, o AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'fp' WHEN b.doc_id IS NULL THEN 'fn' ELSE 'tp' END AS outcome FROM a FULL JOIN b ON a.doc_id = b.doc_id)"
_C = "count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn"
_G = "l AS (SELECT quality, toxic, source, n_chars, CAST(n_chars > 500 AS INT) AS guess FROM labels JOIN documents USING (doc_id))"
SQL = {
    "orders_by_id": "SELECT o_orderkey AS order_id, 'ORD-' || o_orderkey AS order_number, CAST(o_custkey AS VARCHAR) AS client_id FROM orders WHERE o_orderkey = 7",
    "orders_by_number": "SELECT o_orderkey AS order_id, 'ORD-' || o_orderkey AS order_number, o_orderstatus AS status FROM orders WHERE o_orderkey = 32",
    "orders_by_customer": "SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS client_id, o_orderstatus AS status FROM orders WHERE o_custkey = 7",
    "orders_of_status": "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P'",
    "orders_by_customer_and_status": "SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS client_id, o_orderstatus AS status FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'",
    "locks_with_orders": "SELECT 'tok' || event_id AS lock_token, user_id AS order_id, 'ORD-' || o_orderkey AS order_number, o_orderstatus AS status FROM events JOIN orders ON user_id = o_orderkey",
    "cascade_delete": "SELECT 'order' AS what, CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'lock', CAST(event_id AS BIGINT) FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)",
    "expire_count": f"WITH {_K} SELECT count(*) FILTER (is_active AND expires_at < {_N}) AS expired FROM k",
    "score_matches": f"WITH {_A}, c AS (SELECT (SELECT count(*) FROM a JOIN b USING (doc_id)) AS tp, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a) AS na), q AS (SELECT tp, nb - tp AS fp, na - tp AS fn, tp / nullif(nb, 0) AS p, tp / nullif(na, 0) AS r FROM c) SELECT tp, fp, fn, {_F} FROM q",
    "orders_by_status": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus",
    "order_exists": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer",
    "amend_patch": f"""WITH o AS ({ORDERS}), p AS ({PATCHES}), u AS (SELECT * FROM p WHERE expected_version = 1 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY user_id, status NULLS FIRST, amount NULLS FIRST, description NULLS FIRST) = 1),
      j AS (SELECT o.*, o.order_id IN (SELECT order_id FROM p) AS has, u.user_id, u.status AS ps, u.amount AS pa, u.description AS pd FROM o LEFT JOIN u USING (order_id)),
      k AS (SELECT *, CASE WHEN NOT has THEN 'none' WHEN user_id IS NULL THEN 'conflict' WHEN coalesce(ps <> status, false) OR coalesce(pa <> amount, false) OR pd IS NOT NULL THEN 'amended' ELSE 'unchanged' END AS result FROM j)
      SELECT order_id, CASE WHEN result = 'amended' THEN coalesce(ps, status) ELSE status END AS status, CASE WHEN result = 'amended' THEN pd END AS description, CAST(CASE WHEN result = 'amended' THEN coalesce(pa, amount) ELSE amount END AS DOUBLE) AS amount,
        CASE WHEN result = 'amended' THEN user_id ELSE updated_by END AS updated_by, CASE WHEN result = 'amended' THEN {_N} ELSE updated_at END AS updated_at, CASE WHEN result = 'amended' THEN version + 1 ELSE version END AS version, result FROM k""",
    "create_orders": f"""WITH n AS (SELECT 'ORD-' || CAST(c_custkey * 20 AS STRING) AS order_number, c_name AS client_id FROM customer WHERE c_custkey * 20 NOT IN (SELECT o_orderkey FROM orders))
      SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY order_number) AS order_id, order_number, client_id, 'PENDING' AS status, 'USD' AS currency, 1 AS version, {_N} AS created_at, {_N} AS updated_at FROM n""",
    "error_statuses": "SELECT CASE event_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 401 WHEN 2 THEN 409 ELSE 400 END AS status, count(*) AS n FROM events GROUP BY 1",
    "active_locks": f"WITH {_K} SELECT lock_token, order_id, expires_at FROM k WHERE is_active AND expires_at > {_N}",
    "expire_locks": f"WITH {_K} SELECT lock_token, is_active AND NOT expires_at < {_N} AS is_active FROM k",
    "purge_locks": f"WITH {_K} SELECT lock_token FROM k WHERE NOT (is_active AND expires_at < {_N})",
    "validate_locks": f"WITH {_K}, {_R} SELECT token, user_id, coalesce(is_active AND locked_by = user_id AND expires_at > {_N}, false) AS valid FROM r LEFT JOIN k ON token = lock_token",
    "extend_locks": f"WITH {_K}, {_R}, g AS (SELECT token, user_id, sum(coalesce(seconds, 300)) AS seconds FROM r GROUP BY ALL) SELECT lock_token, CASE WHEN is_active AND seconds IS NOT NULL AND expires_at > {_N} THEN expires_at + to_seconds(CAST(seconds AS BIGINT)) ELSE expires_at END AS expires_at FROM k LEFT JOIN g ON token = lock_token AND user_id = locked_by",
    "release_locks": f"WITH {_K}, {_R} SELECT lock_token, is_active AND NOT EXISTS (SELECT 1 FROM r WHERE token = lock_token AND user_id = locked_by) AS is_active FROM k",
    "can_amend": f"WITH {_K} SELECT c_custkey AS order_id FROM customer WHERE c_custkey NOT IN (SELECT order_id FROM k WHERE is_active AND expires_at > {_N})",
    "first_lock_wins": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT user_id, event_id, i, true AS granted, ts + INTERVAL 1 DAY AS until FROM e WHERE i = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.i, e.ts >= f.until, CASE WHEN e.ts >= f.until THEN e.ts + INTERVAL 1 DAY ELSE f.until END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
      SELECT user_id AS order_id, event_id AS request_id, granted FROM f""",
    "validation_errors": "WITH v AS (SELECT c_custkey, list_filter([CASE WHEN NOT coalesce(len(trim(c_name)) > 0, false) THEN 'name_blank' END, CASE WHEN NOT coalesce(len(c_mktsegment) <= 9, false) THEN 'segment_long' END, CASE WHEN NOT coalesce(c_acctbal >= 0.01, false) THEN 'amount_low' END], lambda x: x IS NOT NULL) AS errors FROM customer) SELECT c_custkey, errors FROM v WHERE len(errors) > 0",
    "event_gap_clusters": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g) SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM c GROUP BY user_id, cluster""",
    "gap_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM c GROUP BY user_id, cluster""",
    "json_nonblank": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0",
    "json_summary": "WITH j AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, count(*) FILTER (k > 50) AS large FROM j GROUP BY event_type",
    "conversation_chunks": "SELECT conv_id, CAST(count(*) FILTER (turn % 5 <> 4) AS INT) AS n_chunks, CAST(count(*) AS INT) AS original_chunks, CAST(count(*) FILTER (turn % 5 = 4) AS INT) AS filtered_out_chunks FROM conversations GROUP BY conv_id",
    "last_annotation_wins": "SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id",
    "group_promotion": """WITH l AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS y, CASE WHEN l_returnflag = 'R' THEN 'Primary' ELSE 'Secondary' END AS type FROM lineitem), g AS (SELECT *, count(*) FILTER (type = 'Primary') OVER (PARTITION BY l_suppkey, y) AS n FROM l),
      p AS (SELECT l_suppkey, y, CASE WHEN n >= 10 AND l_suppkey % 10 <> 0 THEN 'Primary' ELSE type END AS type FROM g) SELECT l_suppkey, y, type, count(*) AS n FROM p GROUP BY ALL""",
    "dedupe_min_type": f"WITH {_G}, d AS (SELECT source AS article_id, CAST(n_chars % 10 AS STRING) AS dataset_id, CASE WHEN quality = 1 THEN 'Primary' WHEN toxic = 1 THEN 'Secondary' END AS type FROM l) SELECT article_id, dataset_id, min(type) AS type FROM d WHERE type IS NOT NULL GROUP BY ALL",
    "row_ids": "SELECT source, doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS row_id FROM documents",
    "top_rows": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100",
    "value_counts": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "score_f1": f"WITH {_O}, c AS (SELECT {_C} FROM o), q AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT 'overall' AS slice, tp, fp, fn, {_F} FROM q",
    "score_slices": f"WITH {_O}, c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'doi' ELSE 'accession' END AS slice, {_C} FROM o GROUP BY 1 UNION ALL SELECT 'overall', {_C} FROM o), q AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT slice, tp, fp, fn, {_F} FROM q",
    "true_minus_detected": f"WITH {_A} SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b",
    "detected_minus_true": f"WITH {_A} SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a",
    "without_missing": "SELECT o_custkey AS article_id, o_orderkey AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 'Primary' ELSE 'Secondary' END AS type FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "confusion_matrix": f"WITH {_G} SELECT quality, count(*) FILTER (guess = 0) AS guess_0, count(*) FILTER (guess = 1) AS guess_1 FROM l GROUP BY quality",
    "class_report": f"""WITH {_G}, c AS (SELECT quality AS k, count(*) AS support, count(*) FILTER (quality = guess) AS hits FROM l GROUP BY 1), g AS (SELECT guess AS k, count(*) AS claimed FROM l GROUP BY 1),
      q AS (SELECT coalesce(c.k, g.k) AS class, coalesce(support, 0) AS support, hits / nullif(claimed, 0) AS p, hits / nullif(support, 0) AS r FROM c FULL JOIN g ON c.k = g.k) SELECT class, support, {_F} FROM q""",
}

SQL["primary_gate"] = f"SELECT doc_id, regexp_matches(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' Data were deposited.' ELSE '' END, '{rules.PRIMARY_WORDS}') AS \"primary\" FROM documents"
