"""Registered queries on tables of the retail source's shape, which are made from the driver's tables with faults planted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import row_fingerprint, row_hash
from ..operators import cleaning, data_quality, facts, incremental, keys, layout, scd2, suite
from ..operators import relational as rel
from ..operators.feed import Feed
from ..sources import csv_blocks, files, ledger, partitions, scratch
from .queries import _ACT, _batch, _history, query
from .roles import Roles

FIRST, LATER = "DATE '2024-01-01'", "DATE '2024-02-01'"


class Raw:
    """A source table: columns by an expression that Spark and DuckDB read alike. The rows that meet `again` are ingested a second time, with other values."""

    def __init__(self, table: str, cols: dict[str, str], again: str = "false", **changed: str):
        self.table, self.again = table, again
        self.first, self.later = [*cols.items(), ("_ingested_at", FIRST)], [*(cols | changed).items(), ("_ingested_at", LATER)]

    def rows(self, r: Roles) -> DataFrame:
        df = r.table(self.table)
        pick = lambda df, cols: df.selectExpr(*(f"{e} AS {c}" for c, e in cols))
        return pick(df, self.first).union(pick(df.filter(self.again), self.later))

    def sql(self) -> str:
        pick = lambda cols: "SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols) + f" FROM {self.table}"
        return f"{pick(self.first)} UNION ALL {pick(self.later)} WHERE {self.again}"


def _time(table_date: str, fault: str, clock: str) -> str:
    return f"CASE WHEN {fault} THEN 'n/a' ELSE concat(CAST(CAST({table_date} AS DATE) AS STRING), ' {clock}') END"


CUSTOMERS = Raw("customer", {
    "customer_id": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END", "customer_unique_id": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('u', CAST(c_custkey % 100 AS STRING)) END",
    "customer_city": "concat('  ', c_mktsegment, ' ')", "customer_state": "concat(' s', CAST(c_nationkey AS STRING))",
}, "c_custkey % 3 = 0", customer_city="'Moved City'")
ORDERS = Raw("orders", {
    "order_id": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END", "customer_id": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END",
    "order_status": "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'lost' END",
    "order_purchase_timestamp": _time("o_orderdate", "o_orderkey % 23 = 0", "10:30:00"), "order_approved_at": _time("o_orderdate", "o_orderkey % 5 = 0", "11:00:05"),
    "order_delivered_carrier_date": _time("o_orderdate", "o_orderkey % 7 = 0", "12:00:00"), "order_delivered_customer_date": _time("o_orderdate", "false", "13:59:59"), "order_estimated_delivery_date": _time("o_orderdate", "o_orderkey % 2 = 0", "00:00:00"),
}, "o_orderkey % 4 = 0", order_status="'canceled'")
ITEMS = Raw("lineitem", {
    "order_id": "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END", "order_item_id": "CAST(l_linenumber AS STRING)", "product_id": "CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END", "seller_id": "CAST(l_suppkey AS STRING)",
    "shipping_limit_date": _time("l_shipdate", "l_suppkey % 9 = 0", "08:00:00"), "price": "CASE WHEN l_suppkey % 10 = 0 THEN '0' WHEN l_suppkey % 10 = 1 THEN 'free' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END",
    "freight_value": "CASE WHEN l_partkey % 10 = 0 THEN '-1.50' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) END",
})
PAYMENTS = Raw("orders", {
    "order_id": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END", "payment_sequential": "CAST(o_custkey % 3 AS STRING)", "payment_type": "o_orderpriority", "payment_installments": "CAST(o_custkey % 12 AS STRING)",
    "payment_value": "CASE WHEN o_orderkey % 10 = 3 THEN '-5.00' WHEN o_orderkey % 10 = 4 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END",
}, "o_orderkey % 6 = 0", payment_value="'1.25'")
REVIEWS = Raw("events", {
    "review_id": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS STRING) END", "order_id": "CAST(user_id AS STRING)", "review_score": "CASE WHEN event_id % 8 = 7 THEN 'good' ELSE CAST(event_id % 8 AS STRING) END",
    "review_creation_date": _time("ts", "event_id % 3 = 0", "00:00:00"), "review_answer_timestamp": _time("ts", "event_id % 4 = 0", "21:15:01"),
}, "event_id % 5 = 0", review_score="'5'")
PRODUCTS = Raw("part", {
    "product_id": "CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE CAST(p_partkey AS STRING) END", "product_category_name": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END", "product_photos_qty": "CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END",
    "product_weight_g": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) END",
})
TRANSLATION = Raw("part", {"product_category_name": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END", "product_category_name_english": "concat('English ', lower(p_type))"}, "p_partkey % 2 = 0")
SELLERS = Raw("supplier", {"seller_id": "CASE WHEN s_suppkey % 16 = 0 THEN NULL ELSE CAST(s_suppkey AS STRING) END", "seller_city": "concat(s_name, '  ')", "seller_state": "concat('st', CAST(s_nationkey AS STRING))"}, "s_suppkey % 3 = 1", seller_city="' Elsewhere'")
GEOLOCATION = Raw("events", {
    "geolocation_zip_code_prefix": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE CAST(user_id AS STRING) END", "geolocation_lat": "CASE WHEN event_id % 7 = 0 THEN 'north' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END", "geolocation_lng": "CAST(CAST(event_id % 180 AS DECIMAL(18,2)) AS STRING)",
})


# ---- cleaning rules by source table ----------------------------------------------------------


def _cleaned(r: Roles, raw: Raw, name: str) -> DataFrame:
    """Both sides of the split; times as text, so that no session's time zone shows."""
    ok, bad = cleaning.clean(raw.rows(r), cleaning.RULES[name])
    both = ok.withColumn("_reject_reason", F.lit(None).cast("string")).unionByName(bad)
    return both.withColumns({c: F.col(c).cast("string") for c, t in both.dtypes if t == "timestamp"})


def _clean_sql(raw: Raw, key: str | None, replace: str, reason: str, ties: str = "") -> str:
    """Typed and rewritten rows, the latest of each key, and the first reason that rejects them; ties: columns whose largest values decide."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["_ingested_at", *ties.split()])
    one = f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1" if key else ""
    typed = f"SELECT * REPLACE ({replace}) FROM raw" if replace else "SELECT * FROM raw"
    return f"WITH raw AS ({raw.sql()}), typed AS ({typed}), once AS (SELECT * FROM typed {one}) SELECT *, CASE {reason} END AS _reject_reason FROM once"


def _null(*cols: str) -> str:
    return " ".join(f"WHEN {c} IS NULL THEN '{c} is null'" for c in cols)


_TIMES = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]
_STATUSES = "('approved', 'canceled', 'created', 'delivered', 'invoiced', 'processing', 'shipped', 'unavailable')"


def _moment(*cols: str) -> str:
    return ", ".join(f"CAST(TRY_CAST({c} AS TIMESTAMP) AS VARCHAR) AS {c}" for c in cols)


def _double(*cols: str) -> str:
    return ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in cols)


@query(_clean_sql(
  CUSTOMERS, "customer_id", "lower(trim(customer_city)) AS customer_city, upper(trim(customer_state)) AS customer_state",
  _null("customer_id", "customer_unique_id"), "customer_unique_id customer_city customer_state"))
def clean_customers(r: Roles) -> DataFrame:
    return _cleaned(r, CUSTOMERS, "customers")


@query(_clean_sql(
  ORDERS, "order_id", _moment(*_TIMES),
  _null("order_id", "customer_id", "order_purchase_timestamp") + f" WHEN order_status IS NULL OR order_status NOT IN {_STATUSES} THEN 'order_status is unknown'",
  "customer_id order_status " + " ".join(_TIMES)))
def clean_orders(r: Roles) -> DataFrame:
    return _cleaned(r, ORDERS, "orders")


@query(_clean_sql(
  ITEMS, "order_id, order_item_id", f"TRY_CAST(order_item_id AS INTEGER) AS order_item_id, {_moment('shipping_limit_date')}, {_double('price', 'freight_value')}",
  _null("order_id", "product_id", "seller_id") + " WHEN NOT coalesce(price > 0, false) THEN 'price is not positive'"
  " WHEN NOT coalesce(freight_value >= 0, false) THEN 'freight_value is negative'", "product_id seller_id shipping_limit_date price freight_value"))  # fmt: skip
def clean_order_items(r: Roles) -> DataFrame:
    return _cleaned(r, ITEMS, "order_items")


@query(_clean_sql(
  PAYMENTS, "order_id, payment_sequential", _double("payment_value"),
  _null("order_id") + " WHEN NOT coalesce(payment_value >= 0, false) THEN 'payment_value is negative'", "payment_type payment_installments payment_value"))
def clean_order_payments(r: Roles) -> DataFrame:
    return _cleaned(r, PAYMENTS, "order_payments")


@query(_clean_sql(
  REVIEWS, "review_id, order_id", f"TRY_CAST(review_score AS INTEGER) AS review_score, {_moment('review_creation_date', 'review_answer_timestamp')}",
  _null("review_id", "order_id") + " WHEN NOT coalesce(review_score BETWEEN 1 AND 5, false) THEN 'review_score is out of range'",
  "review_score review_creation_date review_answer_timestamp"))
def clean_order_reviews(r: Roles) -> DataFrame:
    return _cleaned(r, REVIEWS, "order_reviews")


@query(f"""WITH raw AS ({PRODUCTS.sql()}), t AS (SELECT DISTINCT product_category_name AS c, product_category_name_english FROM ({TRANSLATION.sql()}) WHERE product_category_name IS NOT NULL),
  once AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY _ingested_at DESC, product_category_name DESC NULLS LAST, product_photos_qty DESC NULLS LAST, product_weight_g DESC NULLS LAST) = 1)
SELECT once.*, product_category_name_english, CASE {_null('product_id')} END AS _reject_reason FROM once LEFT JOIN t ON product_category_name = c""")
def clean_products(r: Roles) -> DataFrame:
    """Products of the cleaned table with the English category of the cleaned translation."""
    words, _ = cleaning.clean(TRANSLATION.rows(r), cleaning.RULES["category_translation"])
    products = cleaning.standardise(PRODUCTS.rows(r), cleaning.RULES["products"])
    named = cleaning.with_english_category(products, words.drop("_ingested_at"))
    ok, bad = cleaning.split_valid(named, cleaning.RULES["products"].rules)
    return ok.withColumn("_reject_reason", F.lit(None).cast("string")).unionByName(bad)


@query(_clean_sql(
  SELLERS, "seller_id", "lower(trim(seller_city)) AS seller_city, upper(trim(seller_state)) AS seller_state", _null("seller_id"), "seller_city seller_state"))
def clean_sellers(r: Roles) -> DataFrame:
    return _cleaned(r, SELLERS, "sellers")


@query(_clean_sql(GEOLOCATION, None, _double("geolocation_lat", "geolocation_lng"), _null("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng")))
def clean_geolocation(r: Roles) -> DataFrame:
    return _cleaned(r, GEOLOCATION, "geolocation")


@query(_clean_sql(
  TRANSLATION, "product_category_name", "", _null("product_category_name"), "product_category_name_english"))
def clean_category_translation(r: Roles) -> DataFrame:
    return _cleaned(r, TRANSLATION, "category_translation")


def _staged(r: Roles, raw: Raw, name: str) -> DataFrame:
    out = cleaning.clean(raw.rows(r), cleaning.STAGING[name])[0]
    return out.withColumns({c: F.col(c).cast("double" if t.startswith("decimal") else "string") for c, t in out.dtypes if t == "timestamp" or t.startswith("decimal")})


def _staged_sql(raw: Raw, replace: str) -> str:
    return f"SELECT * REPLACE ({replace}) FROM ({raw.sql()})"


def _decimal(*cols: str) -> str:
    return ", ".join(f"TRY_CAST({c} AS DECIMAL(18,2))::DOUBLE AS {c}" for c in cols)


def _int(*cols: str) -> str:
    return ", ".join(f"TRY_CAST({c} AS INTEGER) AS {c}" for c in cols)


@query(_staged_sql(ITEMS, f"{_int('order_item_id')}, {_moment('shipping_limit_date')}, {_decimal('price', 'freight_value')}"))
def stage_order_items(r: Roles) -> DataFrame:
    return _staged(r, ITEMS, "order_items")


@query(_staged_sql(PAYMENTS, f"{_int('payment_sequential', 'payment_installments')}, {_decimal('payment_value')}"))
def stage_order_payments(r: Roles) -> DataFrame:
    return _staged(r, PAYMENTS, "order_payments")


@query(_staged_sql(REVIEWS, f"{_int('review_score')}, {_moment('review_creation_date', 'review_answer_timestamp')}"))
def stage_order_reviews(r: Roles) -> DataFrame:
    return _staged(r, REVIEWS, "order_reviews")


@query(_staged_sql(PRODUCTS, f"{_int('product_photos_qty')}, {_decimal('product_weight_g')}"))
def stage_products(r: Roles) -> DataFrame:
    return _staged(r, PRODUCTS, "products")


@query(_staged_sql(ORDERS, _moment(*_TIMES)))
def stage_orders(r: Roles) -> DataFrame:
    return _staged(r, ORDERS, "orders")


@query(_staged_sql(GEOLOCATION, _double("geolocation_lat", "geolocation_lng")))
def stage_geolocation(r: Roles) -> DataFrame:
    return _staged(r, GEOLOCATION, "geolocation")


@query(f"SELECT * FROM ({CUSTOMERS.sql()})")
def stage_customers(r: Roles) -> DataFrame:
    return _staged(r, CUSTOMERS, "customers")


@query(f"SELECT * FROM ({SELLERS.sql()})")
def stage_sellers(r: Roles) -> DataFrame:
    return _staged(r, SELLERS, "sellers")


@query(f"SELECT * FROM ({TRANSLATION.sql()})")
def stage_translation(r: Roles) -> DataFrame:
    return _staged(r, TRANSLATION, "category_translation")


@query(f"SELECT side, reason, count(*) AS n FROM (SELECT CASE WHEN _reject_reason IS NULL THEN 'valid' ELSE 'reject' END AS side, _reject_reason AS reason FROM ({_clean_sql(SELLERS, 'seller_id', '', _null('seller_id'))})) GROUP BY ALL")
def publish_split(r: Roles) -> DataFrame:
    """Both sides as published: an older run's rejects are gone."""
    ok, bad = scratch.new_path(r.spark), scratch.new_path(r.spark)
    for rows in (SELLERS.rows(r).withColumn("seller_id", F.lit(None).cast("string")), SELLERS.rows(r)):
        cleaning.publish_split(rows, cleaning.RULES["sellers"], ok, bad)
    sides = r.spark.read.parquet(ok).select(F.lit("valid").alias("side"), F.lit(None).cast("string").alias("reason")).union(r.spark.read.parquet(bad).select(F.lit("reject"), "_reject_reason"))
    return sides.groupBy("side", "reason").agg(F.count("*").alias("n"))


# ---- sources and sinks -----------------------------------------------------------------------

_QUOTED = """concat('say "', c_mktsegment, '",', chr(10), c_name)"""


def _csv(df: DataFrame, path: str) -> str:
    df.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


_NOTED = """concat('line ', l_linenumber, chr(10), 'said "', l_returnflag, '", ', repeat('x', CAST(l_orderkey % 90 AS INTEGER)), CASE WHEN l_partkey % 3 = 0 THEN chr(10) ELSE '' END)"""


@query(f"SELECT l_orderkey, l_linenumber, {_NOTED} AS note, CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END AS price FROM lineitem")
def csv_by_blocks(r: Roles) -> DataFrame:
    """Files of records with quotes and line ends inside fields, read by a task for each block of them: a file for each 64 MB of
    the input, so that no task writes more, which has several blocks of text."""
    rows = r.lineitem.selectExpr("l_orderkey", "l_linenumber", f"{_NOTED} AS note", "CASE WHEN l_suppkey % 5 <> 0 THEN l_extendedprice END AS price")
    n = layout.parts_of(r.spark, r.path("lineitem"))
    few = rows.coalesce(n) if n <= rows.rdd.getNumPartitions() else rows.repartition(n)
    return csv_blocks.read_csv_blocks(r.spark, _csv(few, scratch.new_path(r.spark)), rows.schema)


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_QUOTED} AS note, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def csv_as_text(r: Roles) -> DataFrame:
    """Every column as text, with quotes, commas and line ends in the fields."""
    return files.read_csv(r.spark, _csv(r.customer.selectExpr("c_custkey", f"{_QUOTED} AS note", "c_nationkey"), scratch.new_path(r.spark)), as_text=True)


@query("SELECT c_custkey + 1 AS next_key, c_acctbal * 2 AS twice, c_name, 'int, double, string' AS types FROM customer")
def csv_inferred(r: Roles) -> DataFrame:
    df = files.read_csv(r.spark, _csv(r.customer.select("c_custkey", "c_acctbal", "c_name"), scratch.new_path(r.spark)))
    return df.select((F.col("c_custkey") + 1).cast("long").alias("next_key"), (F.col("c_acctbal") * 2).alias("twice"), "c_name", F.lit(", ".join(t for _, t in df.dtypes)).alias("types"))


@query("SELECT 'customer' AS name, 'customer.csv' AS _source_file, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'supplier', 'supplier.csv', count(*), sum(s_suppkey)::BIGINT FROM supplier")
def ingested_tables(r: Roles) -> DataFrame:
    """Two CSV tables are ingested twice by a map of names to files, and read again by layer and name."""
    root = scratch.new_path(r.spark)
    sources = {"customer": r.customer, "supplier": r.supplier}
    paths = {name: _csv(df, f"{root}/in/{name}.csv") for name, df in sources.items()}
    for _ in range(2):
        files.ingest_all(r.spark, paths, f"{root}/bronze", {name: df.schema for name, df in sources.items()})
    read = lambda name, key: files.read_table(r.spark, root, "bronze", name).groupBy("_source_file").agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("name"), "*")
    return read("customer", "c_custkey").union(read("supplier", "s_suppkey"))


def _one_csv(df: DataFrame, path: str) -> str:
    """The rows as a single CSV file of just that name."""
    folder = _csv(df.coalesce(1), scratch.new_path(df.sparkSession))
    made = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").first()[0]
    files.move(df.sparkSession, made, path)
    return path


def _day(n: int):
    return F.lit(f"2024-03-{n:02d} 06:00:00").cast("timestamp")


def _ingested(r: Roles, root: str, name: str, key: str) -> DataFrame:
    """Rows and keys by file and day, and the batches that were written in all."""
    day = F.date_format("_ingestion_date", "yyyy-MM-dd").alias("day")
    rows = ledger.table(r.spark, root, name).groupBy(F.element_at(F.split("_source_file", "/"), -1).alias("file"), day)
    return rows.agg(F.count("*").alias("n"), F.sum(key).alias("keys"), F.countDistinct("_batch").alias("batches"))


@query("""SELECT 'one.csv' AS file, '2024-03-01' AS day, count(*) AS n, sum(c_custkey)::BIGINT AS keys, 1::BIGINT AS batches FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'two.csv', '2024-03-02', count(*), sum(c_custkey)::BIGINT, 1 FROM customer WHERE c_custkey % 3 = 0""")
def ingest_next_day(r: Roles) -> DataFrame:
    """One file on the first day, a second beside it on the next, nothing new on the third: each file's rows come in once."""
    root = scratch.new_path(r.spark)
    for day, (name, cond) in enumerate([("one", "c_custkey % 3 <> 0"), ("two", "c_custkey % 3 = 0"), (None, None)], 1):
        if name:
            _one_csv(r.customer.filter(cond), f"{root}/in/{name}.csv")
        ledger.ingest_each(r.spark, {"customer": f"{root}/in/*.csv"}, f"{root}/bronze", {"customer": r.customer.schema}, _day(day))
    return _ingested(r, f"{root}/bronze", "customer", "c_custkey")


@query("""SELECT 'a.csv' AS file, '2024-03-02' AS day, count(*) AS n, sum(s_suppkey)::BIGINT AS keys, 1::BIGINT AS batches FROM supplier
UNION ALL SELECT 'b.csv', '2024-03-01', count(*), sum(s_suppkey)::BIGINT, 1 FROM supplier WHERE s_suppkey % 2 = 0""")
def ingest_changed_file(r: Roles) -> DataFrame:
    """A file that comes again under its name with more rows replaces what it had brought; the other stays as it was."""
    root = scratch.new_path(r.spark)
    _one_csv(r.supplier.filter("s_suppkey % 5 = 0"), f"{root}/in/a.csv")
    _one_csv(r.supplier.filter("s_suppkey % 2 = 0"), f"{root}/in/b.csv")
    for day in (1, 2):
        ledger.ingest_each(r.spark, {"supplier": f"{root}/in/*.csv"}, f"{root}/bronze", {"supplier": r.supplier.schema}, _day(day))
        _one_csv(r.supplier, f"{root}/in/a.csv")
    ledger.ingest_each(r.spark, {"supplier": f"{root}/in/b.csv"}, f"{root}/bronze", {"supplier": r.supplier.schema}, _day(3))
    return _ingested(r, f"{root}/bronze", "supplier", "s_suppkey")


@query("""SELECT 'customer' AS name, '2024-03-01' AS day, count(*) AS n, sum(c_custkey)::BIGINT AS keys, 1::BIGINT AS batches FROM customer
UNION ALL SELECT 'supplier', '2024-03-02', count(*), sum(s_suppkey)::BIGINT, 1 FROM supplier""")
def ingest_restart(r: Roles) -> DataFrame:
    """A run ends after the first of two tables, when the second's rows are written but not entered; the next run takes just those again."""
    root = scratch.new_path(r.spark)
    sources = {"customer": _one_csv(r.customer, f"{root}/in/customer.csv"), "supplier": _one_csv(r.supplier, f"{root}/in/supplier.csv")}
    schemas = {"customer": r.customer.schema, "supplier": r.supplier.schema}
    ledger.ingest_each(r.spark, {"customer": sources["customer"]}, f"{root}/bronze", schemas, _day(1))
    lost = files.with_lineage(files.read_csv(r.spark, sources["supplier"], schemas["supplier"]), F.col("_metadata.file_path"), _day(1))
    files.append(lost.withColumn("_batch", F.lit("lost")), f"{root}/bronze/supplier", ["_batch"])
    ledger.ingest_each(r.spark, sources, f"{root}/bronze", schemas, _day(2))
    parts = [_ingested(r, f"{root}/bronze", name, key).select(F.lit(name).alias("name"), "day", "n", "keys", "batches") for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return rel.union_all(parts)


@query("SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def sql_over_names(r: Roles) -> DataFrame:
    files.register(r.supplier, "lakeloom_supplier")
    files.register(r.nation, "lakeloom_nation")
    return r.spark.sql("SELECT n_name, count(*) AS suppliers FROM lakeloom_supplier JOIN lakeloom_nation ON s_nationkey = n_nationkey GROUP BY 1")


@query("SELECT l_returnflag AS folder, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1")
def rows_by_file(r: Roles) -> DataFrame:
    """The path that a row was read from tells the folder that it was written to."""
    path = scratch.new_path(r.spark)
    files.append(r.lineitem.select("l_orderkey", "l_returnflag"), path, ["l_returnflag"])
    folder = F.regexp_extract(files.file_of_row(), "l_returnflag=([^/]*)/", 1)
    return r.spark.read.parquet(path).withColumn("folder", folder).groupBy("folder").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""SELECT _commit_version, _change_type, count(*) AS n FROM (SELECT 2 AS _commit_version, 'delete' AS _change_type FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 3, 'insert' FROM orders WHERE o_orderkey % 21 = 0) GROUP BY ALL""")
def changes_since(r: Roles) -> DataFrame:
    """Version 1 updates, version 2 deletes, version 3 brings some back; asked are the changes from version 2 on."""
    old = r.orders.select("o_orderkey", "o_orderstatus")
    one = incremental.update_where(old, "o_orderkey % 11 = 0", {"o_orderstatus": "'X'"})
    two = incremental.delete_where(one, "o_orderkey % 7 = 0")
    three = two.union(old.filter("o_orderkey % 21 = 0"))
    states = [old, one, two, three]
    feed = rel.union_all([incremental.snapshot_diff(a, b, ["o_orderkey"]).withColumn("_commit_version", F.lit(n)) for n, (a, b) in enumerate(zip(states, states[1:]), 1)])
    return incremental.changes_since(feed, 2).groupBy("_commit_version", "_change_type").agg(F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n, max(p_size) AS largest FROM part GROUP BY 1")
def create_table_as(r: Roles) -> DataFrame:
    """A catalog table is dropped and created anew; what it held before is gone."""
    rows = r.part.groupBy("p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))
    for df in (rows.withColumn("n", F.lit(0).cast("long")), rows):
        out = files.create_as(df, "lakeloom_parts", scratch.new_path(r.spark))
    return out


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def insert_select(r: Roles) -> DataFrame:
    """Rows are inserted by name and in the target's types."""
    path = scratch.new_path(r.spark)
    files.append(r.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    files.insert_into(r.customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("id")), path)
    return r.spark.read.parquet(path)


@query("SELECT c_mktsegment, count(*) AS moved, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS of_all FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def temporary_table(r: Roles) -> DataFrame:
    """Rows that several statements of one load read are computed once and held under a name."""
    files.temp_table(r.customer.filter("c_acctbal < 0"), "lakeloom_moved")
    return r.spark.sql("SELECT c_mktsegment, count(*) AS moved, (SELECT count(*) FROM lakeloom_moved) AS of_all FROM lakeloom_moved GROUP BY 1")


# ---- gates, allocation and lookups by expression ---------------------------------------------

_GATE = {"unique": ["l_orderkey"], "unique_together": [["l_orderkey", "l_linenumber"]], "not_null": ["l_partkey"]}


@query("""SELECT false AS passed, (SELECT count(*) FROM lineitem) AS quarantined, 'l_orderkey unique' AS "check", (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) || ' failing' AS detail
UNION ALL SELECT false, (SELECT count(*) FROM lineitem), 'l_orderkey, l_linenumber unique', n || ' failing' FROM (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) WHERE n > 0""")
def quality_gate(r: Roles) -> DataFrame:
    """A batch that fails a check is held back with a report."""
    path = scratch.new_path(r.spark)
    passed = data_quality.gate(data_quality.check_table(r.lineitem, "lineitem", _GATE), r.lineitem, path)
    held = r.spark.read.parquet(f"{path}/batch").agg(F.count("*").alias("quarantined"))
    return r.spark.read.parquet(f"{path}/report").join(F.broadcast(held)).select(F.lit(passed).alias("passed"), "quarantined", "check", "detail")


_SHARE = "o_totalprice::DECIMAL(18,2)::DOUBLE * (l_extendedprice::DECIMAL(18,2)::DOUBLE / nullif(sum(l_extendedprice::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey)::DOUBLE, 0))"


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, o_totalprice::DECIMAL(18,2) AS total, floor({_SHARE} * 100 + 0.5) / 100 AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice::DECIMAL(18,2) DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) = 1 AS first, total - sum(part::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey) AS rest FROM a WHERE part IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN first THEN floor((part + rest::DOUBLE) * 100 + 0.5) / 100 ELSE part END AS allocated, first AND rest <> 0 AS given FROM b""")
def allocate_to_the_cent(r: Roles) -> DataFrame:
    """What rounding leaves over goes to an order's most expensive item, and every item says what it got."""
    items = r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    totals, by = r.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    plain = facts.allocate(items, totals, "l_orderkey", "l_extendedprice", "o_totalprice", name="plain")
    out = facts.allocate(plain, totals, "l_orderkey", "l_extendedprice", "o_totalprice", residue_order=by).join(totals.select("l_orderkey"), "l_orderkey")
    return out.filter("allocated IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "allocated", (F.col("allocated") != F.col("plain")).alias("given"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS date_key FROM orders")
def lookup_by_expression(r: Roles) -> DataFrame:
    """An order's calendar row is found by its timestamp's date."""
    lo, hi = r.orders.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    days = files.date_spine(r.spark, lo, hi).select("full_date", F.date_format("full_date", "yyyyMMdd").cast("long").alias("date_key"))
    return rel.lookup(r.orders, days, F.to_date("o_orderdate") == F.col("full_date")).select("o_orderkey", "date_key")


# ---- the declared suite ----------------------------------------------------------------------

_TABLES = {"customers": CUSTOMERS, "orders": ORDERS, "order_items": ITEMS, "order_payments": PAYMENTS, "order_reviews": REVIEWS, "products": PRODUCTS, "sellers": SELLERS, "category_translation": TRANSLATION, "geolocation": GEOLOCATION}
#: Types that the suite is run on, as the cleaned tables have them: SQL's name of each cast column's type.
_SUITE_TYPES = {
    "orders": dict.fromkeys(_TIMES, "TIMESTAMP"), "order_items": {"order_item_id": "INTEGER", "shipping_limit_date": "TIMESTAMP", "price": "DOUBLE", "freight_value": "DOUBLE"},
    "order_payments": {"payment_sequential": "INTEGER", "payment_installments": "INTEGER", "payment_value": "DOUBLE"}, "order_reviews": {"review_score": "INTEGER"},
    "products": {"product_weight_g": "DOUBLE"}, "geolocation": {"geolocation_lat": "DOUBLE", "geolocation_lng": "DOUBLE"},
}
#: Declared checks that must fail whatever the rows are: a column that the tables don't have, and one that is text.
_LACKS = {("customers", "customer_zip_code_prefix exists"), ("customers", "customer_zip_code_prefix is int"), ("geolocation", "geolocation_zip_code_prefix is int")}


def _suite_frames(r: Roles) -> dict[str, DataFrame]:
    """The source tables as they come, faults and repeated rows included, with the cleaned tables' types."""
    return {name: raw.rows(r).withColumns({c: F.col(c).try_cast(t.lower().replace("integer", "int")) for c, t in _SUITE_TYPES.get(name, {}).items()}) for name, raw in _TABLES.items()}


def _suite_sql(only: str | None = None) -> str:
    """The suite by a statement for each check, told from the declared rules."""
    typed, out = {}, []
    for name, raw in _TABLES.items():
        casts = ", ".join(f"TRY_CAST({c} AS {t}) AS {c}" for c, t in _SUITE_TYPES.get(name, {}).items())
        typed[name] = f"SELECT * REPLACE ({casts}) FROM ({raw.sql()})" if casts else raw.sql()

    def add(name: str, dimension: str, check: str, failing: str) -> None:
        out.append(f"""SELECT '{name}' AS "table", '{dimension}' AS dimension, '{check}' AS "check", n = 0 AS passed, n || ' failing' AS detail FROM ({failing}) x(n)""")

    for name, raw in _TABLES.items():
        if only and name != only:
            continue
        rules = suite.rules(name)
        for c, t in rules["types"].items():
            for check in (f"{c} exists", f"{c} is {t}"):
                add(name, "schema", check, f"SELECT {int((name, check) in _LACKS)}")
        bad = [("completeness", f"{c} not null", f"{c} IS NULL") for c in rules["not_null"]]
        bad += [("validity", f"{c} > 0", f"{c} <= 0") for c in rules.get("positive", [])] + [("validity", f"{c} >= 0", f"{c} < 0") for c in rules.get("non_negative", [])]
        bad += [("validity", f"{c} between {lo} and {hi}", f"{c} NOT BETWEEN {lo} AND {hi}") for c, (lo, hi) in rules.get("between", {}).items()]
        bad += [("validity", f"{c} in set", f"{c} NOT IN ({', '.join(repr(v) for v in vs)})") for c, vs in rules.get("in_set", {}).items()]
        bad += [("consistency", f"{a} >= {b}", f"{a} < {b}") for a, b in rules.get("a_ge_b", [])]
        for dimension, check, cond in bad:
            add(name, dimension, check, f"SELECT count(*) FROM t_{name} WHERE {cond}")
        for key in [rules[k] if k == "unique" else rules[k][0] for k in ("unique", "unique_together") if k in rules]:
            add(name, "uniqueness", f"{', '.join(key)} unique", f"SELECT count(*) FROM (SELECT 1 FROM t_{name} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in key)} GROUP BY {', '.join(key)} HAVING count(*) > 1)")
        low, high = f"(SELECT floor(count(*) * (1 - 0.2))::BIGINT FROM {raw.table})", f"(SELECT floor(count(*) * (1 + 0.2))::BIGINT FROM {raw.table})"
        out.append(f"""SELECT '{name}', 'volume', 'rows between ' || {low} || ' and ' || {high}, count(*) BETWEEN {low} AND {high}, count(*) || ' rows' FROM t_{name}""")
    for child, c, parent, p in suite.REFERENCES if not only else []:
        add(child, "consistency", f"{c} in {parent}.{p}", f"SELECT count(DISTINCT {c}) FROM t_{child} WHERE {c} NOT IN (SELECT {p} FROM t_{parent} WHERE {p} IS NOT NULL)")
    named = ", ".join(f"t_{n} AS ({sql})" for n, sql in typed.items() if not only or n == only)
    return f"WITH {named} " + " UNION ALL ".join(out)


@query(_suite_sql())
def dq_suite(r: Roles) -> DataFrame:
    """All declared checks of the nine tables over rows with faults: schema, nulls, keys, bounds, volume against the driver's tables, references."""
    baselines = {name: r.table(raw.table).count() for name, raw in _TABLES.items()}
    return suite.run_suite(_suite_frames(r), baselines)


@query(_suite_sql("order_items"))
def dq_while_writing(r: Roles) -> DataFrame:
    """The items' checks, taken while the table is written."""
    rules = suite.rules("order_items", r.lineitem.count())
    return data_quality.write_checked(_suite_frames(r)["order_items"], scratch.new_path(r.spark), "order_items", rules)


# ---- tables that are changed in part ---------------------------------------------------------


def _written(r: Roles, path: str, by: str) -> DataFrame:
    """(by, at): when each partition's files were last written."""
    return r.spark.read.parquet(path).select(by, "_metadata.file_modification_time").groupBy(by).agg(F.max("file_modification_time").alias("at"))


def _rewritten(r: Roles, path: str, by: str, before: DataFrame) -> DataFrame:
    """The table's rows with whether their partition was written since; partitions that are new count."""
    seen = _written(r, path, by).join(before.select(by, F.col("at").alias("was")), by, "left")
    flags = seen.select(by, (F.col("was").isNull() | (F.col("at") > F.col("was"))).alias("rewritten"))
    return r.spark.read.parquet(path).join(F.broadcast(flags), by)  # a row per partition


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, year(o_orderdate)::INTEGER AS year FROM orders), y AS (SELECT min(year) AS first FROM o),
 t AS (SELECT o_orderkey, CASE WHEN year = first + 1 AND o_orderkey % 5 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN year = first + 1 AND o_orderkey % 10 = 0 THEN 2050 ELSE year END AS year, first FROM o, y)
SELECT year, year IN (first + 1, 2050) AS rewritten, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'M') AS merged, sum(o_orderkey)::BIGINT AS keys FROM t GROUP BY ALL""")
def merge_touched_partitions(r: Roles) -> DataFrame:
    """A batch for one year: some rows change there, some move to a year of their own. Files of the other years stay as they are."""
    path, cols = scratch.new_path(r.spark), ["o_orderkey", "o_orderstatus", "year"]
    old = r.orders.withColumn("year", F.year("o_orderdate")).select(*cols)
    files.append(old.repartition("year"), path, ["year"])
    before, first = scratch.cut(_written(r, path, "year")), old.agg(F.min("year")).first()[0]
    batch = old.filter((F.col("year") == first + 1) & (F.col("o_orderkey") % 5 == 0)).withColumns({"o_orderstatus": F.lit("M"), "year": F.expr("IF(o_orderkey % 10 = 0, 2050, year)")})
    partitions.merge_touched(path, batch, ["o_orderkey"], ["year"], lambda rows, b: incremental.upsert(rows, b, ["o_orderkey"]))
    out = _rewritten(r, path, "year", before)
    return out.groupBy("year", "rewritten").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "M").alias("merged"), F.sum("o_orderkey").alias("keys"))


@query(f"""{_ACT}, ch AS (SELECT * FROM act WHERE (was IS NULL OR was <> h) AND o_custkey % 16 IN (3, 8)), merged AS (
 SELECT d.o_custkey, d.o_orderpriority, d.valid_from, CASE WHEN d.is_current AND ch.o_custkey IS NOT NULL THEN ch.change_ts ELSE d.valid_to END AS valid_to,
  d.is_current AND ch.o_custkey IS NULL AS is_current, d.row_hash FROM dim d LEFT JOIN ch ON d.o_custkey = ch.o_custkey
 UNION ALL SELECT o_custkey, o_orderpriority, change_ts, NULL, true, h FROM ch)
SELECT *, (o_custkey % 16)::INTEGER AS part, o_custkey % 16 IN (3, 8) AS rewritten FROM merged""")
def scd2_merge_touched_partitions(r: Roles) -> DataFrame:
    """A history in 16 partitions that the key decides; a batch of two of them leaves the files of 14 alone, and they aren't read."""
    path, part = scratch.new_path(r.spark), F.expr("CAST(o_custkey % 16 AS INT)")
    files.append(_history(r).drop("version_num").withColumn("part", part).repartition("part"), path, ["part"])
    before = scratch.cut(_written(r, path, "part"))
    batch = _batch(r).withColumn("part", part).filter("part IN (3, 8)")
    merge = lambda rows, b: scd2.scd2_merge(rows.drop("part"), b, "o_custkey", ["o_orderpriority"], "change_ts").withColumn("part", part)
    partitions.merge_touched(path, batch, ["o_custkey"], ["part"], merge, derived=True)
    return _rewritten(r, path, "part", before)


@query("SELECT l_returnflag, 6::BIGINT AS files_before, 2::BIGINT AS files, true AS big_stays, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1")
def compact_small_files(r: Roles) -> DataFrame:
    """A large file and five small ones in each partition: the small ones become one, the large one isn't touched. A flag has a
    partition for each 64 MB of the input, so that no task sorts and writes more; null where a flag's partitions differ."""
    path, n, by = scratch.new_path(r.spark), layout.parts_of(r.spark, r.path("lineitem")), ["l_returnflag", "part"]
    items = layout.with_part(r.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag"), n, ["l_orderkey", "l_linenumber"])
    files.append(items.filter("l_linenumber <= 4").repartitionById(n, "part"), path, by)
    big = scratch.cut(layout.file_sizes(r.spark, path))
    for k in range(5):
        files.append(items.filter(f"l_linenumber > 4 AND l_suppkey % 5 = {k}").repartitionById(n, "part"), path, by)
    before = scratch.cut(layout.file_sizes(r.spark, path).groupBy("folder").agg(F.count("*").alias("files_before")))
    layout.compact_small(r.spark, path, 2 * big.agg(F.min("bytes")).first()[0])
    after = layout.file_sizes(r.spark, path).join(big.select("file", F.lit(True).alias("was")), "file", "left").groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.bool_or("was"), F.lit(False)).alias("big_stays"))
    flag = F.regexp_extract("folder", "l_returnflag=([^/]*)/", 1).alias("l_returnflag")
    told = before.join(after, "folder").groupBy(flag).agg(layout.alike("files_before").alias("files_before"), layout.alike("files").alias("files"), F.bool_and("big_stays").alias("big_stays"))
    return told.join(r.spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")), "l_returnflag")


# ---- a stored change feed --------------------------------------------------------------------


def _five_versions(r: Roles) -> Feed:
    """Version 0 and five more, with a snapshot at every other: updates, deletes, some come back, updates again, one as known changes."""
    v0 = r.orders.select("o_orderkey", "o_orderstatus")
    v1 = incremental.update_where(v0, "o_orderkey % 11 = 0", {"o_orderstatus": "'X'"})
    v2 = incremental.delete_where(v1, "o_orderkey % 7 = 0")
    v3 = v2.union(v0.filter("o_orderkey % 21 = 0"))
    v4 = incremental.update_where(v3, "o_orderkey % 5 = 0", {"o_orderstatus": "'Y'"})
    v5 = incremental.delete_where(v4, "o_orderstatus = 'X'")
    feed = Feed(r.spark, scratch.new_path(r.spark), ["o_orderkey"], every=2)
    for state in (v0, v1, v2, v3, v4):
        feed.commit(state)
    feed.commit_changes(incremental.snapshot_diff(v4, v5, ["o_orderkey"]))
    return feed


_V3 = """v3 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 21 = 0),
 v4 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus FROM v3)"""


@query(f"WITH {_V3} SELECT 3 AS version, * FROM v3 UNION ALL SELECT 4, * FROM v4 UNION ALL SELECT 5, * FROM v4 WHERE o_orderstatus <> 'X'")
def feed_state_as_of(r: Roles) -> DataFrame:
    """Three versions of a stored table: from the snapshot before, from a snapshot itself, and the last one."""
    feed = _five_versions(r)
    return rel.union_all([feed.state(n).select(F.lit(n).alias("version"), "o_orderkey", "o_orderstatus") for n in (3, 4, 5)])


@query(f"""WITH {_V3} SELECT 3 AS _commit_version, 'insert' AS _change_type, count(*) AS n, true AS pruned FROM orders WHERE o_orderkey % 21 = 0
UNION ALL SELECT 4, k, count(*), true FROM v3, (VALUES ('update_preimage'), ('update_postimage')) t(k) WHERE o_orderkey % 5 = 0 GROUP BY 2
UNION ALL SELECT 5, 'delete', count(*), true FROM v4 WHERE o_orderstatus = 'X'""")
def feed_changes_since(r: Roles) -> DataFrame:
    """Changes from version 3 on; the scan hands on just as many rows as those versions' commits say."""
    feed = _five_versions(r)
    rows = feed.changes(3)
    told = feed.history().filter("version >= 3").agg(F.sum("rows")).first()[0]
    return rows.groupBy(F.col("_commit_version").cast("int").alias("_commit_version"), "_change_type").agg(F.count("*").alias("n")).withColumn("pruned", F.lit(layout.rows_scanned(rows) == told))


# ---- keys and fingerprints that last ---------------------------------------------------------


@query("""WITH old AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer WHERE c_custkey % 10 <> 0),
 reg AS (SELECT * FROM old UNION ALL SELECT (SELECT max(customer_key) FROM old) + row_number() OVER (ORDER BY c_custkey), c_custkey FROM customer WHERE c_custkey % 10 = 0)
SELECT customer_key, c_custkey, c_custkey % 20 <> 1 AS there, c_custkey % 10 <> 0 AS kept FROM reg""")
def stable_surrogate_keys(r: Roles) -> DataFrame:
    """A dimension is built anew when a tenth of its keys is new and a twentieth is gone: all keys that were given stay."""
    path = scratch.new_path(r.spark)
    first = r.customer.filter("c_custkey % 10 <> 0").select("c_custkey")
    empty = r.spark.createDataFrame([], "customer_key long, c_custkey long")
    files.publish(keys.register_keys(empty, first, ["c_custkey"], "customer_key"), path)
    old = scratch.cut(r.spark.read.parquet(path))
    batch = r.customer.filter("c_custkey % 20 <> 1").select("c_custkey")
    files.publish(keys.register_keys(r.spark.read.parquet(path), batch, ["c_custkey"], "customer_key"), path)
    registry = r.spark.read.parquet(path)
    there = rel.with_exists_flag(registry, batch, ["c_custkey"], "there")
    return there.join(old.withColumnRenamed("customer_key", "was"), "c_custkey", "left").select("customer_key", "c_custkey", "there", F.coalesce(F.col("was") == F.col("customer_key"), F.lit(False)).alias("kept"))


_LIKE = {"null and empty": ("NULL", "''"), "separator": ("concat(c_name, '|x')", "'y'"), "separator moved": ("c_name", "'x|y'"), "empty": ("''", "''"), "dash": ("'-'", "NULL"), "length": ("concat('1:', c_mktsegment)", "'1:'")}
_PIECE = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT c_custkey, '{n}' AS variant, {a} AS a, {b} AS b FROM customer" for n, (a, b) in _LIKE.items()) + f""") SELECT *, sha256({_PIECE.format('a')} || {_PIECE.format('b')}) AS fingerprint,
  count(*) OVER (PARTITION BY c_custkey, sha256({_PIECE.format('a')} || {_PIECE.format('b')})) AS exact, count(*) OVER (PARTITION BY c_custkey, sha256(coalesce(a, '') || '|' || coalesce(b, ''))) AS plain FROM v""")
def fingerprints_told_apart(r: Roles) -> DataFrame:
    """Rows that differ by a null against an empty value, or by where a separator stands: how many share a fingerprint of either form."""
    rows = rel.union_all([r.customer.selectExpr("c_custkey", f"'{n}' AS variant", f"CAST({a} AS STRING) AS a", f"CAST({b} AS STRING) AS b") for n, (a, b) in _LIKE.items()])
    rows = rows.withColumns({"fingerprint": row_fingerprint(["a", "b"]), "_plain": row_hash(["a", "b"])})
    alike = lambda c: F.count("*").over(Window.partitionBy("c_custkey", c))
    return rows.withColumns({"exact": alike("fingerprint"), "plain": alike("_plain")}).drop("_plain")


@query("""WITH p AS (SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE AS p), g AS (SELECT DISTINCT l_returnflag FROM lineitem UNION ALL SELECT 'all') SELECT l_returnflag, p, true AS within FROM g, p""")
def quantiles_by_sketch(r: Roles) -> DataFrame:
    """Sketches by flag and supplier's part of the rows are stored, merged by flag and over all, and asked; the true ranks of the answers lie within 1 %."""
    ranks, k = [0.1, 0.5, 0.9, 0.99], 400
    items = r.lineitem.select("l_returnflag", "l_suppkey", F.col("l_extendedprice").cast("double").alias("price"))
    stored = scratch.cut(rel.quantile_sketches(items.withColumn("part", F.col("l_suppkey") % 7), ["l_returnflag", "part"], "price", k))
    merged = rel.merge_sketches(stored, ["l_returnflag"], k).unionByName(rel.merge_sketches(stored, [], k).withColumn("l_returnflag", F.lit("all")))
    asked = rel.sketch_quantiles(merged, ranks).select("l_returnflag", F.posexplode("quantiles").alias("at", "value"))
    both = items.unionByName(items.withColumn("l_returnflag", F.lit("all"))).join(F.broadcast(asked), "l_returnflag")  # four rows for each flag
    true = both.groupBy("l_returnflag", "at").agg(F.count("*").alias("n"), F.count_if(F.col("price") < F.col("value")).alias("below"), F.count_if(F.col("price") <= F.col("value")).alias("upto"))
    p = F.get(F.array(*map(F.lit, ranks)), F.col("at"))
    within = (F.col("below") / F.col("n") <= p + 0.01) & (F.col("upto") / F.col("n") >= p - 0.01)
    return true.select("l_returnflag", p.alias("p"), within.alias("within"))
