"""The declared quality suite of the nine cleaned source tables, and running it over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from . import cleaning
from .data_quality import check_referential, check_table

# What each cleaned table must hold. Columns with their types, columns that are never null, the key, and bounds.
COLUMNS = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_state string",
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, order_delivered_customer_date timestamp",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double",
    "order_payments": "order_id string, payment_sequential int, payment_type string, payment_value double",
    "order_reviews": "review_id string, order_id string, review_score int",
    "products": "product_id string",
    "sellers": "seller_id string, seller_state string",
    "category_translation": "product_category_name string",
    "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double",
}
REQUIRED = {
    "customers": "customer_id customer_unique_id", "orders": "order_id customer_id order_status order_purchase_timestamp", "order_items": "order_id order_item_id product_id seller_id price",
    "order_payments": "order_id payment_sequential payment_value", "order_reviews": "review_id order_id review_score", "products": "product_id", "sellers": "seller_id",
    "category_translation": "product_category_name", "geolocation": "geolocation_zip_code_prefix",
}
BOUNDS = {
    "orders": {"in_set": {"order_status": cleaning.ORDER_STATUSES}, "a_ge_b": [("order_delivered_customer_date", "order_purchase_timestamp")]},
    "order_items": {"positive": ["price"], "non_negative": ["freight_value"]},
    "order_payments": {"non_negative": ["payment_value", "payment_installments"], "in_set": {"payment_type": cleaning.PAYMENT_TYPES}},
    "order_reviews": {"between": {"review_score": (1, 5)}},
    "products": {"non_negative": ["product_weight_g"]},
}
#: Child table and column, parent table and column.
REFERENCES = [
    ("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id"), ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"), ("order_payments", "order_id", "orders", "order_id"), ("order_reviews", "order_id", "orders", "order_id"),
]
TOLERANCE = 0.2


def rules(table: str, baseline: int | None = None, tolerance: float = TOLERANCE) -> dict:
    """A table's rule set as `data_quality.check_table` takes it; its key is that of the cleaning rules."""
    types = dict(x.split() for x in COLUMNS[table].split(", "))
    key = cleaning.RULES[table].dedup
    out = {"columns": list(types), "types": types, "not_null": REQUIRED[table].split(), **BOUNDS.get(table, {})}
    out |= {"unique": key} if len(key) == 1 else {"unique_together": [key]} if key else {}
    return out | ({"volume": (baseline, tolerance)} if baseline is not None else {})


def run_suite(frames: dict[str, DataFrame], baselines: dict[str, int] | None = None) -> DataFrame:
    """Every declared check of the tables there are, with their references; each table's rows are read in one pass, and for
    references its key columns once more."""
    checks = [check_table(df, table, rules(table, (baselines or {}).get(table))) for table, df in frames.items()]
    refs = [r for r in REFERENCES if r[0] in frames and r[2] in frames]
    return reduce(DataFrame.union, checks + ([check_referential(frames, refs)] if refs else []))
