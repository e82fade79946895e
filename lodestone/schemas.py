"""Schemas of the engine's tables."""

MENTION = "article_id string, context string, dataset_id string, pattern_name string, section string, source string, start int, end int"
LABEL = "article_id string, dataset_id string, type string"
ORDER = (
    "id long, order_number string, client_id string, order_type string, status string, amount decimal(15,2), currency string, description string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, created_by string, updated_by string, version int"
)
LOCK = "id long, order_id long, locked_by string, locked_at timestamp_ntz, expires_at timestamp_ntz, lock_token string, is_active boolean"
SAMPLE = "ids array<int>, label int, seq_len int, bigram array<bigint>, trigram array<bigint>"


def seed_orders(spark):
    """Three orders to start with."""
    from datetime import datetime
    from decimal import Decimal

    at = datetime(2024, 1, 1)
    rows = [(k, f"ORD-{k:03d}", f"CLIENT-{k:03d}", t, "PENDING", Decimal(a), "USD", None, at, at, "system", "system", 1) for k, t, a in ((1, "BUY", "1000.00"), (2, "SELL", "2500.50"), (3, "BUY", "750.25"))]
    return spark.createDataFrame(rows, ORDER)
