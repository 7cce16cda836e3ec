"""Cleaning by declared rules: parse, standardise, deduplicate, and part valid rows from rejects."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import publish
from .relational import latest_per_key, lookup

Reason = tuple[str, str]  # (SQL predicate that a valid row meets, reason if it doesn't)


@dataclass
class CleanRule:
    """How a table is cleaned. types: column to type, what doesn't parse is null; expressions: column to SQL."""

    rules: list[Reason] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    expressions: dict[str, str] = field(default_factory=dict)
    dedup: list[str] = field(default_factory=list)
    dedup_ts: str = "_ingested_at"
    dedup_tie: list[str] = field(default_factory=list)


def not_null(*cols: str) -> list[Reason]:
    return [(f"{c} IS NOT NULL", f"{c} is null") for c in cols]


# The order states and payment kinds that count as valid.
ORDER_STATUSES = ["approved", "canceled", "created", "delivered", "invoiced", "processing", "shipped", "unavailable"]
PAYMENT_TYPES = ["boleto", "credit_card", "debit_card", "not_defined", "voucher"]
ORDER_TIMES = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]
_IN_STATUSES = ", ".join(f"'{s}'" for s in ORDER_STATUSES)

RULES: dict[str, CleanRule] = {
    "customers": CleanRule(not_null("customer_id", "customer_unique_id"), {}, {"customer_city": "lower(trim(customer_city))", "customer_state": "upper(trim(customer_state))"}, ["customer_id"]),
    "orders": CleanRule([*not_null("order_id", "customer_id", "order_purchase_timestamp"), (f"order_status IN ({_IN_STATUSES})", "order_status is unknown")], dict.fromkeys(ORDER_TIMES, "timestamp"), {}, ["order_id"]),
    "order_items": CleanRule([*not_null("order_id", "product_id", "seller_id"), ("price > 0", "price is not positive"), ("freight_value >= 0", "freight_value is negative")], {"shipping_limit_date": "timestamp", "price": "double", "freight_value": "double", "order_item_id": "int"}, {}, ["order_id", "order_item_id"]),
    "order_payments": CleanRule([*not_null("order_id"), ("payment_value >= 0", "payment_value is negative")], {"payment_value": "double"}, {}, ["order_id", "payment_sequential"]),
    "order_reviews": CleanRule([*not_null("review_id", "order_id"), ("review_score BETWEEN 1 AND 5", "review_score is out of range")], {"review_score": "int", "review_creation_date": "timestamp", "review_answer_timestamp": "timestamp"}, {}, ["review_id", "order_id"]),
    "products": CleanRule(not_null("product_id"), {}, {}, ["product_id"]),
    "sellers": CleanRule(not_null("seller_id"), {}, {"seller_city": "lower(trim(seller_city))", "seller_state": "upper(trim(seller_state))"}, ["seller_id"]),
    "geolocation": CleanRule(not_null("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"), {"geolocation_lat": "double", "geolocation_lng": "double"}),
    "category_translation": CleanRule(not_null("product_category_name"), {}, {}, ["product_category_name"]),
}
#: Typing of the staging layer, which checks nothing.
STAGING = {
    "order_items": CleanRule(types={"order_item_id": "int", "shipping_limit_date": "timestamp", "price": "decimal(18,2)", "freight_value": "decimal(18,2)"}),
    "order_payments": CleanRule(types={"payment_sequential": "int", "payment_installments": "int", "payment_value": "decimal(18,2)"}),
    "order_reviews": CleanRule(types={"review_score": "int", "review_creation_date": "timestamp", "review_answer_timestamp": "timestamp"}),
    "orders": CleanRule(types=dict.fromkeys(ORDER_TIMES, "timestamp")),
    "products": CleanRule(types={c: "int" for c in ("product_name_lenght", "product_description_lenght", "product_photos_qty")} | {c: "decimal(18,2)" for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")}),
    "geolocation": CleanRule(types={"geolocation_lat": "double", "geolocation_lng": "double"}),
    "customers": CleanRule(),
    "sellers": CleanRule(),
    "category_translation": CleanRule(),
}


def reject_reason(rules: list[Reason]) -> Column:
    """The first rule's reason that the row doesn't meet; a predicate that is null isn't met. Null for a valid row."""
    if not rules:
        return F.lit(None).cast("string")
    failed = lambda p: ~F.coalesce(F.expr(p), F.lit(False))
    return reduce(lambda c, r: c.when(failed(r[0]), r[1]), rules[1:], F.when(failed(rules[0][0]), rules[0][1]))


def standardise(df: DataFrame, rule: CleanRule) -> DataFrame:
    """Parses, rewrites and deduplicates; the latest row of a key stays, ties go to the largest other columns."""
    have = set(df.columns)
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in rule.types.items() if c in have})
    df = df.withColumns({c: F.expr(e) for c, e in rule.expressions.items() if c in have})
    if rule.dedup:
        ts = rule.dedup_ts if rule.dedup_ts in have else rule.dedup[0]
        df = latest_per_key(df, rule.dedup, ts, rule.dedup_tie or [c for c in df.columns if c not in rule.dedup and c != ts])
    return df


def split_valid(df: DataFrame, rules: list[Reason]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): every row is in just one of them; rejects have _reject_reason."""
    judged = df.withColumn("_reject_reason", reject_reason(rules))
    return judged.filter("_reject_reason IS NULL").drop("_reject_reason"), judged.filter("_reject_reason IS NOT NULL")


def clean(df: DataFrame, rule: CleanRule) -> tuple[DataFrame, DataFrame]:
    return split_valid(standardise(df, rule), rule.rules)


def with_english_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with the English category beside the source's own."""
    return lookup(products, translation, ["product_category_name"])


def publish_split(df: DataFrame, rule: CleanRule, path: str, reject_path: str) -> None:
    """Publishes both sides of a cleaned table; rejects are written even if there are none, so none of an older run stay."""
    kept = standardise(df, rule).withColumn("_reject_reason", reject_reason(rule.rules)).persist()
    try:
        publish(kept.filter("_reject_reason IS NULL").drop("_reject_reason"), path)
        publish(kept.filter("_reject_reason IS NOT NULL"), reject_path)
    finally:
        kept.unpersist()
