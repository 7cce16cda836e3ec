"""One registered query per operator family, over whole tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import count_nulls, exact_sum, money, ratio, round_half_up, row_hash
from ..operators import analytics, asof, cleaning, data_quality, dimensions, facts, incremental, keys, layout, profiling, scd2
from ..operators import relational as rel
from ..sources import files, scratch
from .roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Roles], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- analytics -------------------------------------------------------------------------------

_MONTHLY = """SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""


@query(f"SELECT *, sum(revenue::DECIMAL(18,2)) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)::DOUBLE AS running_total FROM ({_MONTHLY})")
def monthly_revenue_running(r: Roles) -> DataFrame:
    return analytics.monthly_revenue_running(r.sales(), "o_orderdate", "l_extendedprice")


@query(f"""WITH m AS ({_MONTHLY}), p AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS previous FROM m),
  c AS (SELECT *, (revenue::DECIMAL(18,2) - previous::DECIMAL(18,2))::DOUBLE AS change FROM p)
SELECT *, 100.0::DOUBLE * change / nullif(previous, 0) AS change_pct FROM c""")
def mom_change(r: Roles) -> DataFrame:
    return analytics.mom_change(r.sales(), "o_orderdate", "l_extendedprice")


@query("""WITH s AS (SELECT p_type, l_partkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY revenue DESC, l_partkey) AS rank_in_group FROM s QUALIFY rank_in_group <= 3""")
def top_products_per_type(r: Roles) -> DataFrame:
    sold = rel.lookup(r.lineitem.select("l_partkey", "l_extendedprice"), r.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "inner")
    return analytics.top_products(sold, "p_type", "l_partkey", "l_extendedprice")


@query("""WITH s AS (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM lineitem GROUP BY 1)
SELECT *, rank() OVER (ORDER BY revenue DESC) AS revenue_rank, dense_rank() OVER (ORDER BY revenue DESC) AS revenue_dense_rank FROM s ORDER BY revenue DESC, l_suppkey LIMIT 20""")
def supplier_rank(r: Roles) -> DataFrame:
    return analytics.seller_rank(r.lineitem, "l_suppkey", "l_extendedprice")


_GEO = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _sales_geo(r: Roles) -> DataFrame:
    return rel.lookup(r.sales(), r.customer_geo(), F.col("o_custkey") == F.col("c_custkey"), "inner")


@query(f"""SELECT CASE WHEN grouping(r_name) = 1 THEN 'ALL REGIONS' ELSE r_name END AS r_name, CASE WHEN grouping(n_name) = 1 THEN 'ALL NATIONS' ELSE n_name END AS n_name,
  count(*) AS items, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM {_GEO} GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(r: Roles) -> DataFrame:
    return analytics.revenue_rollup(_sales_geo(r), ["r_name", "n_name"], "l_extendedprice", {"r_name": "ALL REGIONS", "n_name": "ALL NATIONS"})


@query(f"SELECT n_name, count(*) AS items, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM {_GEO} GROUP BY 1 ORDER BY revenue DESC, n_name LIMIT 5")
def revenue_by_nation_top5(r: Roles) -> DataFrame:
    return analytics.revenue_by_state(_sales_geo(r), "n_name", "l_extendedprice")


# ---- dimensions and keys ---------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_sk, o_orderkey, o_orderdate FROM orders")
def surrogate_key(r: Roles) -> DataFrame:
    return keys.add_surrogate_key(r.orders.select("o_orderkey", "o_orderdate"), "order_sk", ["o_orderdate", "o_orderkey"])


@query("SELECT 1000 + row_number() OVER (ORDER BY s_suppkey) AS supplier_key, s_suppkey, s_name, s_nationkey FROM supplier")
def surrogate_key_from(r: Roles) -> DataFrame:
    return keys.add_surrogate_key(r.supplier.select("s_suppkey", "s_name", "s_nationkey"), "supplier_key", ["s_suppkey"], 1000)


@query("""SELECT strftime(d, '%Y%m%d')::BIGINT AS date_key, d::DATE AS full_date, day(d) AS day_of_month, dayofweek(d)::BIGINT AS day_of_week, dayname(d) AS day_name,
  weekofyear(d) AS week_of_year, month(d) AS month_num, monthname(d) AS month_name, quarter(d) AS quarter, year(d) AS year, dayofweek(d) IN (0, 6) AS is_weekend, false AS is_holiday
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)""")
def dim_date(r: Roles) -> DataFrame:
    lo, hi = r.orders.agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    return dimensions.build_dim_date(r.spark, str(lo), str(hi))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
  m AS (SELECT user_id, event_type AS mode_event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
  a AS (SELECT user_id, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS avg_value FROM events GROUP BY 1)
SELECT row_number() OVER (ORDER BY user_id) AS user_key, user_id, floor(avg_value * 10000 + 0.5) / 10000 AS avg_value, mode_event_type FROM a JOIN m USING (user_id)""")
def dim_mode_avg(r: Roles) -> DataFrame:
    exact = r.events.withColumn("value", F.col("value").cast("decimal(18,6)"))
    out = dimensions.build_mode_avg_dim(exact, "user_id", ["value"], ["event_type"], "user_key")
    return out.withColumn("avg_value", round_half_up(F.col("avg_value").cast("double"), 4))


@query("""WITH t AS (SELECT DISTINCT p_type, 'English ' || lower(p_type) AS p_type_english FROM part WHERE p_type <> (SELECT max(p_type) FROM part))
SELECT row_number() OVER (ORDER BY p_partkey) AS part_key, p_partkey, p_name, part.p_type, p_type_english FROM part LEFT JOIN t USING (p_type)""")
def dim_part_translated(r: Roles) -> DataFrame:
    kinds = r.part.select("p_type").distinct()
    last = r.part.agg(F.max("p_type").alias("untranslated"))
    words = kinds.join(F.broadcast(last), kinds["p_type"] != F.col("untranslated")).select("p_type", F.concat(F.lit("English "), F.lower("p_type")).alias("p_type_english"))
    return dimensions.build_lookup_dim(r.part, words, "p_type", ["p_partkey", "p_name", "p_type"], ["p_partkey"], "part_key")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS supplier_key, s_suppkey, s_name, s_nationkey FROM supplier")
def dim_supplier(r: Roles) -> DataFrame:
    return dimensions.build_type1_dim(r.supplier, ["s_suppkey", "s_name", "s_nationkey"], ["s_suppkey"], "supplier_key")


@query("SELECT row_number() OVER (ORDER BY o_orderstatus) AS status_key, o_orderstatus FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def dim_order_status(r: Roles) -> DataFrame:
    return dimensions.build_distinct_dim(r.orders, "o_orderstatus", "status_key")


# ---- histories -------------------------------------------------------------------------------

_HIST = """h AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, sha256(coalesce(o_orderpriority, '')) AS row_hash FROM orders),
 l AS (SELECT *, lag(row_hash) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM h),
 dim AS (SELECT o_custkey, o_orderpriority, row_number() OVER w AS version_num, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current, row_hash
   FROM l WHERE b IS NULL OR b <> row_hash WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def _history(r: Roles) -> DataFrame:
    return scd2.scd2_build(r.priority_events(), "o_custkey", "o_orderdate", ["o_orderpriority"], ["o_orderkey"])


@query(f"WITH {_HIST} SELECT * FROM dim")
def scd2_build(r: Roles) -> DataFrame:
    return _history(r)


@query(f"""WITH {_HIST}, p AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE is_current) AS c FROM dim GROUP BY 1)
SELECT sum(n)::BIGINT AS total, sum(c)::BIGINT AS current, (sum(n) - sum(c))::BIGINT AS historical, count(*) AS entities, count(*) FILTER (WHERE n > 1) AS changed FROM p""")
def scd2_stats(r: Roles) -> DataFrame:
    return scd2.scd2_stats(_history(r), "o_custkey")


@query(f"""WITH {_HIST} SELECT o_orderkey, o.o_custkey, o_orderdate, version_num FROM orders o JOIN dim ON o.o_custkey = dim.o_custkey AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to)""")
def pit_join(r: Roles) -> DataFrame:
    return rel.pit_join(r.orders, _history(r).drop("o_orderpriority"), "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate", "version_num")


#: Half of the orders belong to entity 0, which changes every day for 1,000 days and then holds its last version.
_HOT = f"""WITH {_HIST}, f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey END AS entity, o_orderdate FROM orders),
 d AS (SELECT min(o_orderdate) AS first FROM orders),
 v AS (SELECT 0 AS entity, k AS version_num, first + to_days(k::INTEGER) AS valid_from, CASE WHEN k < 999 THEN first + to_days((k + 1)::INTEGER) END AS valid_to FROM d, range(1000) t(k)
   UNION ALL SELECT o_custkey, version_num, valid_from, valid_to FROM dim WHERE o_custkey <> 0)"""


def _hot(r: Roles) -> tuple[DataFrame, DataFrame]:
    facts = r.orders.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey END").alias("entity"), "o_orderdate")
    days = r.orders.agg(F.min("o_orderdate").alias("first")).select("first", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k"))
    day = lambda n: F.expr(f"first + make_dt_interval(k + {n})")
    daily = days.select(F.lit(0).cast("long").alias("entity"), F.col("k").cast("long").alias("version_num"), day(0).alias("valid_from"), F.when(F.col("k") < 999, day(1)).alias("valid_to"))
    others = _history(r).filter("o_custkey <> 0").select(F.col("o_custkey").alias("entity"), "version_num", "valid_from", "valid_to")
    return facts, daily.unionByName(others)


@query(f"{_HOT} SELECT o_orderkey, f.entity, o_orderdate, version_num, valid_from, valid_to FROM f LEFT JOIN v ON f.entity = v.entity AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to)")
def pit_join_hot(r: Roles) -> DataFrame:
    """The merge of facts and versions, with slices small enough for the hot entity to be dealt over many tasks."""
    facts, versions = _hot(r)
    return asof.asof_join(facts, versions, "entity", "o_orderdate", "left", slice_rows=400)


@query(f"{_HOT} SELECT version_num, count(*) AS facts, count(DISTINCT f.entity) AS entities FROM f JOIN v ON f.entity = v.entity AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to) GROUP BY 1")
def pit_join_facts_by_version(r: Roles) -> DataFrame:
    """The same at the size of slices that production has: one sort, no slice."""
    facts, versions = _hot(r)
    found = asof.asof_join(facts, versions, "entity", "o_orderdate")
    return found.groupBy("version_num").agg(F.count("*").alias("facts"), F.countDistinct("entity").alias("entities"))


@query(f"""WITH {_HIST}, q AS (SELECT o_orderkey, o_custkey, o_orderdate - INTERVAL 30 DAY AS t FROM orders)
SELECT o_orderkey, q.o_custkey, version_num FROM q LEFT JOIN dim ON q.o_custkey = dim.o_custkey AND t >= valid_from AND (valid_to IS NULL OR t < valid_to)""")
def covering_version(r: Roles) -> DataFrame:
    asked = r.orders.select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("INTERVAL 30 DAY")).alias("at"))
    return rel.pit_join(asked, _history(r), "o_custkey", "at", "left").select("o_orderkey", "o_custkey", "version_num")


@query(f"""WITH {_HIST}, bad AS (SELECT * REPLACE (CASE WHEN o_custkey % 11 = 0 AND version_num = 1 THEN valid_from - INTERVAL 1 DAY ELSE valid_to END AS valid_to, is_current AND o_custkey % 7 <> 0 AS is_current) FROM dim),
 n AS (SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from, valid_to NULLS LAST) AS nx FROM bad),
 p AS (SELECT o_custkey, count(*) FILTER (WHERE valid_to < valid_from) AS i, count(*) FILTER (WHERE nx IS NOT NULL AND valid_to IS DISTINCT FROM nx) AS u, count(*) FILTER (WHERE is_current) AS c FROM n GROUP BY 1)
SELECT sum(i)::BIGINT AS inverted, sum(u)::BIGINT AS unlinked, count(*) FILTER (WHERE c <> 1) AS not_one_current FROM p""")
def scd2_health(r: Roles) -> DataFrame:
    """With faults planted: some first versions end before they begin, some entities have no current version."""
    early = (F.col("o_custkey") % 11 == 0) & (F.col("version_num") == 1)
    bad = _history(r).withColumns({"valid_to": F.when(early, F.col("valid_from") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & (F.col("o_custkey") % 7 != 0)})
    return scd2.scd2_health(bad, "o_custkey")


@query(f"WITH {_HIST} SELECT * FROM dim WHERE o_custkey = (SELECT min(o_custkey) FROM dim)")
def history_of_first(r: Roles) -> DataFrame:
    return scd2.history_of(_history(r), "o_custkey", r.orders.agg(F.min("o_custkey")).first()[0])


@query(f"WITH {_HIST} SELECT o_custkey, version_num FROM dim WHERE o_custkey % 5 = 0 AND o_orderpriority <> '1-URGENT'")
def hash_mismatches(r: Roles) -> DataFrame:
    """With stored values planted that no longer fit their fingerprints."""
    edited = F.when(F.col("o_custkey") % 5 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return scd2.hash_mismatches(_history(r).withColumn("o_orderpriority", edited), ["o_orderpriority"]).select("o_custkey", "version_num")


# a batch of changes: every order of 1999 moves its customer to a made-up priority, a month after the last order
_BATCH = """batch AS (SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1000000 ELSE 0 END AS o_custkey,
   CASE WHEN c_custkey % 3 = 0 THEN '1-URGENT' ELSE '9-' || c_mktsegment END AS o_orderpriority, TIMESTAMP '2002-01-01' + to_days((c_custkey % 5)::INTEGER) AS change_ts FROM customer)"""
_SEGMENT = "CASE WHEN c_custkey % 3 = 0 THEN '1-URGENT' ELSE '9-' || c_mktsegment END"


def _batch(r: Roles) -> DataFrame:
    return r.customer.select(
        F.expr("c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1000000 ELSE 0 END").cast("long").alias("o_custkey"),
        F.expr(_SEGMENT).alias("o_orderpriority"),
        F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 5 AS int))").alias("change_ts"),
    )


_ACT = f"""WITH {_HIST}, {_BATCH}, act AS (SELECT b.*, sha256(b.o_orderpriority) AS h, c.row_hash AS was FROM batch b LEFT JOIN (SELECT * FROM dim WHERE is_current) c USING (o_custkey))"""


@query(f"""{_ACT} SELECT action, count(*) AS n FROM (SELECT CASE WHEN was IS NULL THEN 'new' WHEN was <> h THEN 'moved' ELSE 'unchanged' END AS action FROM act) GROUP BY 1""")
def classify_batch(r: Roles) -> DataFrame:
    return scd2.classify_batch(_history(r), _batch(r), "o_custkey", ["o_orderpriority"]).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""{_ACT}, ch AS (SELECT * FROM act WHERE was IS NULL OR was <> h)
SELECT d.o_custkey, d.o_orderpriority, d.valid_from, CASE WHEN d.is_current AND ch.o_custkey IS NOT NULL THEN ch.change_ts ELSE d.valid_to END AS valid_to,
  d.is_current AND ch.o_custkey IS NULL AS is_current, d.row_hash FROM dim d LEFT JOIN ch ON d.o_custkey = ch.o_custkey
UNION ALL SELECT o_custkey, o_orderpriority, change_ts, NULL, true, h FROM ch""")
def scd2_merge(r: Roles) -> DataFrame:
    return scd2.scd2_merge(_history(r).drop("version_num"), _batch(r), "o_custkey", ["o_orderpriority"], "change_ts")


@query(f"""{_ACT}, ch AS (SELECT * FROM act WHERE was IS NULL OR was <> h)
SELECT d.o_custkey, d.o_orderpriority, d.valid_from, CASE WHEN d.is_current AND ch.o_custkey IS NOT NULL THEN TIMESTAMP '2003-01-01' ELSE d.valid_to END AS valid_to,
  d.is_current AND ch.o_custkey IS NULL AS is_current, d.row_hash FROM dim d LEFT JOIN ch ON d.o_custkey = ch.o_custkey
UNION ALL SELECT o_custkey, o_orderpriority, TIMESTAMP '2003-01-01', NULL, true, h FROM ch""")
def scd2_snapshot_merge(r: Roles) -> DataFrame:
    return scd2.scd2_snapshot_merge(_history(r).drop("version_num"), _batch(r), "o_custkey", ["o_orderpriority"], "change_ts", F.expr("TIMESTAMP_NTZ '2003-01-01 00:00:00'"))


_LATE = """batch AS (SELECT o_custkey + CASE WHEN o_custkey % 50 = 0 THEN 1000000 ELSE 0 END AS o_custkey, '8-LATE' AS o_orderpriority,
   min(o_orderdate) + to_days(((o_custkey % 7)::INTEGER - 1) * 100) AS change_ts FROM orders GROUP BY ALL)"""


def _late(r: Roles) -> DataFrame:
    first = r.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    return first.select(
        F.expr("o_custkey + CASE WHEN o_custkey % 50 = 0 THEN 1000000 ELSE 0 END").cast("long").alias("o_custkey"),
        F.lit("8-LATE").alias("o_orderpriority"),
        F.expr("first + make_dt_interval(cast((o_custkey % 7 - 1) * 100 AS int))").alias("change_ts"),
    )


_LATE_SQL = f"""WITH {_HIST}, {_LATE.replace("FROM orders GROUP BY ALL", "FROM orders GROUP BY orders.o_custkey")},
 known AS (SELECT DISTINCT o_custkey FROM dim),
 act AS (SELECT b.*, sha256(b.o_orderpriority) AS h, k.o_custkey IS NOT NULL AS known, d.valid_from AS vf, d.valid_to AS vt, d.is_current AS cur, d.row_hash AS was
   FROM batch b LEFT JOIN known k ON b.o_custkey = k.o_custkey LEFT JOIN dim d ON b.o_custkey = d.o_custkey AND change_ts >= d.valid_from AND (d.valid_to IS NULL OR change_ts < d.valid_to)),
 a AS (SELECT *, CASE WHEN NOT known THEN 'new' WHEN vf IS NULL THEN 'before_history' WHEN was = h THEN 'unchanged' ELSE 'split' END AS action FROM act)"""


@query(f"""{_LATE_SQL}
SELECT d.o_custkey, d.o_orderpriority, d.valid_from, coalesce(a.change_ts, d.valid_to) AS valid_to, d.is_current AND a.change_ts IS NULL AS is_current, d.row_hash
FROM dim d LEFT JOIN (SELECT * FROM a WHERE action = 'split') a ON d.o_custkey = a.o_custkey AND d.valid_from = a.vf AND (d.valid_to IS NULL OR d.valid_to > a.change_ts)
UNION ALL SELECT o_custkey, o_orderpriority, change_ts, vt, coalesce(cur, true), h FROM a WHERE action IN ('split', 'new')""")
def scd2_apply_late(r: Roles) -> DataFrame:
    return scd2.scd2_apply_late(_history(r).drop("version_num"), _late(r), "o_custkey", ["o_orderpriority"], "change_ts")[0]


@query(f"""{_LATE_SQL} SELECT count(*) FILTER (WHERE action = 'new') AS new, count(*) FILTER (WHERE action = 'split') AS split,
  count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'before_history') AS before_history FROM a""")
def scd2_late_counts(r: Roles) -> DataFrame:
    return scd2.scd2_apply_late(_history(r).drop("version_num"), _late(r), "o_custkey", ["o_orderpriority"], "change_ts")[1]


@query(f"""WITH {_HIST}, {_LATE.replace("FROM orders GROUP BY ALL", "FROM orders GROUP BY orders.o_custkey")},
 e AS (SELECT o_custkey, o_orderpriority, valid_from AS t, 0 AS src FROM dim UNION ALL SELECT o_custkey, o_orderpriority, change_ts, 1 FROM batch),
 x AS (SELECT *, sha256(o_orderpriority) AS row_hash FROM e), y AS (SELECT *, lag(row_hash) OVER (PARTITION BY o_custkey ORDER BY t, src, o_orderpriority) AS b FROM x)
SELECT o_custkey, o_orderpriority, row_number() OVER w AS version_num, t AS valid_from, lead(t) OVER w AS valid_to, lead(t) OVER w IS NULL AS is_current, row_hash
FROM y WHERE b IS NULL OR b <> row_hash WINDOW w AS (PARTITION BY o_custkey ORDER BY t, src, o_orderpriority)""")
def scd2_rebuild(r: Roles) -> DataFrame:
    # ties of the built history are told apart by its version order, which is that of (start, priority) here only if starts differ
    distinct = _history(r).filter("valid_to IS NULL OR valid_to >= valid_from")
    return scd2.scd2_rebuild(distinct, _late(r), "o_custkey", ["o_orderpriority"], "change_ts")


# ---- facts -----------------------------------------------------------------------------------

_ALLOC = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  floor(o_totalprice::DECIMAL(18,2)::DOUBLE * (l_extendedprice::DECIMAL(18,2)::DOUBLE / nullif(sum(l_extendedprice::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey)::DOUBLE, 0)) * 100 + 0.5) / 100 AS allocated
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(_ALLOC)
def allocate_payment(r: Roles) -> DataFrame:
    items = r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    totals = r.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return facts.allocate(items, totals, "l_orderkey", "l_extendedprice", "o_totalprice")


_GRAIN = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def _fact(r: Roles, key: str | None = None) -> DataFrame:
    items = r.lineitem.select(*_GRAIN)
    orders = r.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus")
    # a third of the parts is missing from the dimension, so that some keys are
    part = r.part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("part_key"))
    supplier = r.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("supplier_key"))
    status = dimensions.build_distinct_dim(r.orders, "o_orderstatus", "status_key")
    cols = [*_GRAIN, "o_custkey", "version_num", "part_key", "supplier_key", "status_key"]
    return facts.build_fact(items, orders, _history(r).drop("o_orderpriority"), [(part, ["l_partkey"]), (supplier, ["l_suppkey"]), (status, ["o_orderstatus"])], "l_orderkey", "o_custkey", "o_orderdate", cols, key, _GRAIN)


_FACT = f"""WITH {_HIST}, st AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS status_key FROM (SELECT DISTINCT o_orderstatus FROM orders)),
 fact AS (SELECT {", ".join(_GRAIN)}, o.o_custkey, version_num, p_partkey AS part_key, s_suppkey AS supplier_key, status_key
  FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN dim ON o.o_custkey = dim.o_custkey AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to)
  LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 3 <> 0 LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN st ON o.o_orderstatus = st.o_orderstatus)"""


@query(f"{_FACT} SELECT row_number() OVER (ORDER BY {', '.join(_GRAIN)}) AS item_key, *, true AS loaded_now FROM fact")
def fact_order_items(r: Roles) -> DataFrame:
    now = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("_loaded_at")) < 3600
    return _fact(r, "item_key").withColumn("loaded_now", now).drop("_loaded_at")


@query(f"""{_FACT} SELECT count(*) AS total, count(*) FILTER (WHERE part_key IS NULL) AS missing_part_key, count(*) FILTER (WHERE supplier_key IS NULL) AS missing_supplier_key,
  count(DISTINCT l_orderkey) AS orders, (SELECT count(*) FROM (SELECT 1 FROM fact GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_grain FROM fact""")
def fact_completeness(r: Roles) -> DataFrame:
    return facts.fact_completeness(_fact(r), ["part_key", "supplier_key"], "l_orderkey", ["l_orderkey", "l_linenumber"])


@query(f"{_FACT} SELECT DISTINCT p_brand FROM fact JOIN part ON l_partkey = p_partkey WHERE part_key IS NULL")
def unmatched_keys(r: Roles) -> DataFrame:
    return facts.unmatched_keys(_fact(r), r.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"], "part_key", "p_brand")


@query("""SELECT name, n AS actual, CASE WHEN name = 'nation' THEN 26 WHEN name = 'orders' THEN n ELSE 5 END::BIGINT AS expected, CASE WHEN name = 'nation' THEN 'MISMATCH' ELSE 'OK' END AS status
FROM (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region)""")
def check_counts(r: Roles) -> DataFrame:
    actual = profiling.row_counts({"orders": r.orders, "nation": r.nation, "region": r.region})
    expected = r.orders.agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n").union(files.inline_rows(r.spark, [("nation", 26), ("region", 5)], "name string, n long"))
    return facts.check_counts(actual, expected)


@query(f"""WITH {_HIST}, f AS (SELECT o_orderkey, o_custkey, o_orderdate, 0::BIGINT AS version_num FROM orders)
SELECT f.o_orderkey, f.o_custkey, f.o_orderdate, CASE WHEN f.o_custkey % 4 = 0 THEN dim.version_num ELSE 0 END AS version_num
FROM f LEFT JOIN dim ON f.o_custkey % 4 = 0 AND f.o_custkey = dim.o_custkey AND f.o_orderdate >= valid_from AND (valid_to IS NULL OR f.o_orderdate < valid_to)""")
def repoint_fact(r: Roles) -> DataFrame:
    fact = r.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.lit(0).cast("long").alias("version_num"))
    changed = r.customer.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return facts.repoint_fact(fact, _history(r), changed, "o_custkey", "o_orderdate", "version_num")


# ---- incremental tables ----------------------------------------------------------------------

_NEW = """n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 <> 0
   UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 17 = 0)"""


def _old_orders(r: Roles) -> DataFrame:
    return r.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _new_orders(r: Roles) -> DataFrame:
    old = _old_orders(r)
    changed = incremental.update_where(incremental.delete_where(old, "o_orderkey % 13 = 0"), "o_orderkey % 11 = 0", {"o_orderstatus": "'X'"})
    return changed.union(old.filter("o_orderkey % 17 = 0").withColumn("o_orderkey", (F.col("o_orderkey") + 100_000_000).cast("long")))


_DIFF = f"""WITH {_NEW}, o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
 d AS (SELECT n.*, 'insert' AS _change_type FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT o.*, 'delete' FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
  UNION ALL SELECT o.*, 'update_preimage' FROM o JOIN n USING (o_orderkey) WHERE o.o_orderstatus <> n.o_orderstatus UNION ALL SELECT n.*, 'update_postimage' FROM o JOIN n USING (o_orderkey) WHERE o.o_orderstatus <> n.o_orderstatus)"""


@query(f"{_DIFF} SELECT * FROM d")
def snapshot_diff(r: Roles) -> DataFrame:
    return incremental.snapshot_diff(_old_orders(r), _new_orders(r), ["o_orderkey"])


@query(f"{_DIFF} SELECT _change_type, count(*) AS n FROM d GROUP BY 1")
def diff_counts(r: Roles) -> DataFrame:
    return incremental.diff_counts(incremental.snapshot_diff(_old_orders(r), _new_orders(r), ["o_orderkey"]))


@query(f"{_DIFF} SELECT * FROM d WHERE _change_type <> 'update_preimage'")
def diff_downstream(r: Roles) -> DataFrame:
    return incremental.downstream(incremental.snapshot_diff(_old_orders(r), _new_orders(r), ["o_orderkey"]))


@query(f"WITH {_NEW} SELECT * FROM n")
def apply_changes(r: Roles) -> DataFrame:
    old = _old_orders(r)
    return incremental.apply_changes(old, incremental.snapshot_diff(old, _new_orders(r), ["o_orderkey"]), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def state_as_of(r: Roles) -> DataFrame:
    """Version 1 updates, version 2 deletes, version 3 inserts; asked is version 2."""
    old, v = _old_orders(r), lambda df, n: df.withColumn("_commit_version", F.lit(n))
    one = incremental.update_where(old, "o_orderkey % 11 = 0", {"o_orderstatus": "'X'"})
    two = incremental.delete_where(one, "o_orderkey % 7 = 0")
    diff = lambda a, b, n: v(incremental.snapshot_diff(a, b, ["o_orderkey"]), n)
    feed = diff(old, one, 1).union(diff(one, two, 2)).union(diff(two, _new_orders(r), 3))
    return incremental.state_as_of(old, feed, ["o_orderkey"], 2)


@query(f"WITH {_NEW} SELECT (SELECT count(*) FROM n WHERE o_orderkey >= 100000000) AS inserted, (SELECT count(*) FROM n JOIN orders USING (o_orderkey) WHERE n.o_orderstatus <> orders.o_orderstatus) AS updated, (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0) AS deleted")
def merge_metrics(r: Roles) -> DataFrame:
    return incremental.merge_metrics(_old_orders(r), _new_orders(r), ["o_orderkey"])


@query("""WITH s AS (SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 100000000 END AS o_orderkey, o_custkey, 'S' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 = 0)
SELECT * FROM s UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""")
def upsert(r: Roles) -> DataFrame:
    source = _old_orders(r).filter("o_orderkey % 5 = 0").withColumns({"o_orderkey": F.expr("o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 100000000 END").cast("long"), "o_orderstatus": F.lit("S")})
    return incremental.upsert(_old_orders(r), source, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN l_extendedprice * 1.1::DOUBLE ELSE l_extendedprice END AS l_extendedprice FROM lineitem")
def update_where(r: Roles) -> DataFrame:
    return incremental.update_where(r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_linenumber = 1", {"l_extendedprice": "l_extendedprice * 1.1D"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE coalesce(NOT (nullif(l_discount, 0.05) < 0.03), true)")
def delete_where(r: Roles) -> DataFrame:
    return incremental.delete_where(r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), "nullif(l_discount, 0.05D) < 0.03D")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + n ELSE c_acctbal END AS c_acctbal FROM customer JOIN (SELECT c_custkey, (c_custkey % 10)::DOUBLE AS n FROM customer) USING (c_custkey)")
def update_from_join(r: Roles) -> DataFrame:
    source = r.customer.filter("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + (F.col("c_custkey") % 10).cast("double")).alias("balance"))
    return rel.update_from(r.customer.select("c_custkey", "c_acctbal"), source, ["c_custkey"], {"c_acctbal": "balance"})


# ---- cleaning --------------------------------------------------------------------------------

_DIRTY = """dirty AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 5 = 0 THEN -value WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)"""
_REASON = "CASE WHEN event_type IS NULL THEN 'event_type is null' WHEN NOT coalesce(value >= 0, false) THEN 'value is negative' END"
_RULES = [*cleaning.not_null("event_type"), ("value >= 0", "value is negative")]


def _dirty(r: Roles) -> DataFrame:
    return r.events.select("event_id", "user_id", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END").alias("event_type"), F.expr("CASE WHEN event_id % 5 = 0 THEN -value WHEN event_id % 9 = 0 THEN NULL ELSE value END").alias("value"))


@query(f"WITH {_DIRTY} SELECT * FROM dirty WHERE {_REASON} IS NULL")
def split_valid(r: Roles) -> DataFrame:
    return cleaning.split_valid(_dirty(r), _RULES)[0]


@query(f"WITH {_DIRTY} SELECT *, {_REASON} AS _reject_reason FROM dirty WHERE {_REASON} IS NOT NULL")
def split_rejects(r: Roles) -> DataFrame:
    return cleaning.split_valid(_dirty(r), _RULES)[1]


@query("SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(r: Roles) -> DataFrame:
    return rel.latest_per_key(r.events.drop("props"), ["user_id", "event_type"], "ts", ["event_id"])


@query("SELECT conv_id, turn, lower(trim(role)) AS customer_city, upper(trim(role)) AS customer_state FROM conversations")
def normalise_text(r: Roles) -> DataFrame:
    raw = r.conversations.select("conv_id", "turn", F.concat(F.lit(" "), "role").alias("customer_city"), F.concat("role", F.lit(" ")).alias("customer_state"))
    rule = cleaning.CleanRule(expressions=cleaning.RULES["customers"].expressions)
    return cleaning.standardise(raw, rule)


@query("SELECT event_id, TRY_CAST(event_type AS INTEGER) AS event_type, value::DECIMAL(18,2)::DOUBLE AS value, (ts::DATE) AS ts FROM events")
def typed_projection(r: Roles) -> DataFrame:
    out = rel.cast_columns(r.events.select("event_id", "event_type", "value", "ts"), {"event_type": "int", "value": "decimal(18,2)", "ts": "date"})
    return out.withColumn("value", F.col("value").cast("double"))


# ---- data quality ----------------------------------------------------------------------------

_DQ = {"columns": ["l_orderkey"], "types": {"l_orderkey": "bigint"}, "not_null": ["l_partkey"], "unique": ["l_orderkey"], "unique_together": [["l_orderkey", "l_linenumber"]], "positive": ["l_quantity"], "non_negative": ["l_discount"], "between": {"l_tax": (0.0, 0.05)}, "in_set": {"l_returnflag": ["A", "N"]}, "a_ge_b": [("l_extendedprice", "l_quantity")]}


def _line_checks(r: Roles) -> DataFrame:
    return data_quality.check_table(r.lineitem, "lineitem", _DQ)


def _row(dimension: str, check: str, failing: str) -> str:
    return f"SELECT 'lineitem' AS \"table\", '{dimension}' AS dimension, '{check}' AS \"check\", ({failing}) = 0 AS passed, ({failing}) || ' failing' AS detail"


_DQ_SQL = " UNION ALL ".join([
    _row("schema", "l_orderkey exists", "0"), _row("schema", "l_orderkey is bigint", "0"),
    _row("completeness", "l_partkey not null", "SELECT count(*) FROM lineitem WHERE l_partkey IS NULL"),
    _row("uniqueness", "l_orderkey unique", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"),
    _row("uniqueness", "l_orderkey, l_linenumber unique", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    _row("validity", "l_quantity > 0", "SELECT count(*) FROM lineitem WHERE l_quantity <= 0"),
    _row("validity", "l_discount >= 0", "SELECT count(*) FROM lineitem WHERE l_discount < 0"),
    _row("validity", "l_tax between 0.0 and 0.05", "SELECT count(*) FROM lineitem WHERE NOT l_tax BETWEEN 0 AND 0.05::DOUBLE"),
    _row("validity", "l_returnflag in set", "SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN (''A'', ''N'')".replace("''", "'")),
    _row("consistency", "l_extendedprice >= l_quantity", "SELECT count(*) FROM lineitem WHERE l_extendedprice < l_quantity"),
])


@query(_DQ_SQL)
def dq_results(r: Roles) -> DataFrame:
    return _line_checks(r)


@query(f"SELECT dimension, count(*) AS checks, count(*) FILTER (WHERE passed) AS passed, 100.0::DOUBLE * count(*) FILTER (WHERE passed) / count(*) AS pass_rate FROM ({_DQ_SQL}) GROUP BY 1")
def dq_summary(r: Roles) -> DataFrame:
    return data_quality.summarise(_line_checks(r))


@query("""SELECT 'lineitem' AS "table", 'consistency' AS dimension, 'l_orderkey in orders.o_orderkey' AS "check", n = 0 AS passed, n || ' failing' AS detail FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'orders', 'consistency', 'o_orderkey in lineitem.l_orderkey', n = 0, n || ' failing' FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""")
def dq_referential(r: Roles) -> DataFrame:
    return data_quality.check_referential({"lineitem": r.lineitem, "orders": r.orders}, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])


@query("""SELECT 'nation' AS "table", 'volume' AS dimension, 'rows between 17 and 26' AS "check", count(*) BETWEEN 17 AND 26 AS passed, count(*) || ' rows' AS detail FROM nation
UNION ALL SELECT 'region', 'volume', 'rows between 8 and 12', count(*) BETWEEN 8 AND 12, count(*) || ' rows' FROM region""")
def dq_volume(r: Roles) -> DataFrame:
    return data_quality.check_volume(r.nation, "nation", 22).union(data_quality.check_volume(r.region, "region", 10))


# ---- profiling -------------------------------------------------------------------------------


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def row_counts(r: Roles) -> DataFrame:
    return profiling.row_counts({t: r.table(t) for t in _TABLES})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def duplicate_keys(r: Roles) -> DataFrame:
    return profiling.duplicate_keys(r.lineitem, ["l_orderkey", "l_linenumber"])


_RELATIONS = [("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("customer", "c_custkey", "events", "user_id")]


@query(" UNION ALL ".join(f"SELECT '{a}.{x} in {b}.{y}' AS relation, {x} AS id FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b})" for a, x, b, y in _RELATIONS))
def orphans(r: Roles) -> DataFrame:
    return rel.union_all([rel.orphans(r.table(a), r.table(b), {x: y}).select(F.lit(f"{a}.{x} in {b}.{y}").alias("relation"), F.col(x).alias("id")) for a, x, b, y in _RELATIONS])


@query(f"WITH {_DIRTY} SELECT 'event_type' AS \"column\", count(*) FILTER (WHERE event_type IS NULL) AS nulls, count(*) AS rows FROM dirty UNION ALL SELECT 'value', count(*) FILTER (WHERE value IS NULL), count(*) FROM dirty")
def null_profile(r: Roles) -> DataFrame:
    return profiling.null_profile(_dirty(r), ["event_type", "value"])


@query("SELECT min(o_orderdate) AS least, max(o_orderdate) AS greatest FROM orders")
def date_range(r: Roles) -> DataFrame:
    return profiling.value_range(r.orders, "o_orderdate")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def distribution(r: Roles) -> DataFrame:
    return profiling.distribution(r.events, "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def heavy_keys(r: Roles) -> DataFrame:
    return profiling.heavy_keys(r.events, "user_id")


@query("SELECT o_custkey, o_orderdate, count(DISTINCT o_orderpriority) AS states FROM orders GROUP BY ALL HAVING states > 1")
def version_ties(r: Roles) -> DataFrame:
    return profiling.version_ties(r.orders, "o_custkey", "o_orderdate", ["o_orderpriority"])


@query("""WITH t AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS event_type FROM events)
SELECT user_id, count(DISTINCT event_type) AS raw_versions, count(DISTINCT lower(trim(event_type))) AS norm_versions FROM t GROUP BY 1 HAVING raw_versions > norm_versions""")
def norm_effect(r: Roles) -> DataFrame:
    mixed = r.events.select("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END").alias("event_type"))
    return profiling.norm_effect(mixed, "user_id", "event_type")


@query(f"WITH {_DIRTY} SELECT count(*) FILTER (WHERE event_type IS NULL) AS null_event_type, count(*) FILTER (WHERE user_id IS NULL) AS null_user_id, (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM dirty WHERE event_type IS NOT NULL AND user_id IS NOT NULL)) AS distinct_tuples FROM dirty")
def null_and_distinct(r: Roles) -> DataFrame:
    return profiling.null_and_distinct(_dirty(r), ["event_type", "user_id"])


@query("""WITH t AS (SELECT DISTINCT CASE WHEN event_id % 21 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, user_id FROM events)
SELECT md5(coalesce(event_type, '') || '|' || coalesce(user_id::VARCHAR, '')) AS row_hash, count(*) AS tuples FROM t GROUP BY 1 HAVING tuples > 1""")
def hash_collisions(r: Roles) -> DataFrame:
    """A null and an empty text have the same fingerprint: users that have both collide."""
    mixed = r.events.select(F.expr("CASE WHEN event_id % 21 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE event_type END").alias("event_type"), "user_id")
    return profiling.hash_collisions(mixed, ["event_type", "user_id"], "md5")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def ids_without_events(r: Roles) -> DataFrame:
    return profiling.ids_without_events(r.customer, r.events, "c_custkey", "user_id").select("c_custkey", "c_name")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS versions FROM orders GROUP BY 1")
def version_counts(r: Roles) -> DataFrame:
    return rel.version_counts(r.orders, "o_custkey", ["o_orderpriority"])


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders")
def checksum(r: Roles) -> DataFrame:
    return profiling.checksum(r.orders, "o_orderkey")


# ---- relational primitives -------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, upper(o_orderstatus) AS status, o_totalprice * 2 + 1 AS doubled, 'x' AS tag, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size_class,
 md5(o_orderpriority || '|' || o_orderstatus) AS fingerprint, dayofweek(o_orderdate)::BIGINT AS dow, o_orderdate + INTERVAL 1 MINUTE AS later, coalesce(nullif(o_orderstatus, 'F'), 'none') AS not_f FROM orders
WHERE (o_orderstatus IN ('F', 'O') OR o_totalprice BETWEEN 1000 AND 50000) AND o_orderpriority IS NOT NULL AND NOT o_custkey = 7""")
def projections_and_filters(r: Roles) -> DataFrame:
    c = F.col
    kept = r.orders.filter((c("o_orderstatus").isin("F", "O") | c("o_totalprice").between(1000, 50000)) & c("o_orderpriority").isNotNull() & ~(c("o_custkey") == 7))
    return rel.select_as(kept, {
        "id": "o_orderkey", "status": F.upper("o_orderstatus"), "doubled": c("o_totalprice") * 2 + 1, "tag": F.lit("x"),
        "size_class": F.when(c("o_totalprice") > 200000, "big").when(c("o_totalprice") > 100000, "middle").otherwise("small"),
        "fingerprint": row_hash(["o_orderpriority", "o_orderstatus"], "md5"), "dow": (F.dayofweek("o_orderdate") - 1).cast("long"),
        "later": c("o_orderdate") + F.expr("INTERVAL 1 MINUTE"), "not_f": F.coalesce(F.nullif(c("o_orderstatus"), F.lit("F")), F.lit("none")),
    })


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) FILTER (WHERE o_orderpriority IS NULL) AS no_priority, count(DISTINCT o_custkey) AS customers,
 sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1 HAVING n > 100""")
def aggregates_having(r: Roles) -> DataFrame:
    aggs = {
        "n": F.count("*"), "big": F.count_if(F.col("o_totalprice") > 100000), "no_priority": count_nulls("o_orderpriority"), "customers": F.count_distinct("o_custkey"),
        "total": exact_sum("o_totalprice"), "mean": exact_sum("o_totalprice") / F.count("*"), "first_day": F.min("o_orderdate"), "last_day": F.max("o_orderdate"),
    }
    return rel.having(r.orders, ["o_orderstatus"], aggs, "n > 100")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS running,
 sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey)::DOUBLE AS of_customer, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_day, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_functions(r: Roles) -> DataFrame:
    w, whole = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey")
    return r.orders.select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"),
        rel.running_sum(money("o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).cast("double").alias("running"),
        F.sum(money("o_totalprice")).over(whole).cast("double").alias("of_customer"), F.min("o_orderdate").over(whole).alias("first_day"), F.row_number().over(w).cast("long").alias("rn"),
    )


@query("SELECT c_custkey, c_custkey IN (SELECT user_id FROM events) AS is_known FROM customer")
def exists_flag(r: Roles) -> DataFrame:
    return rel.with_exists_flag(r.customer.select("c_custkey"), r.events.select(F.col("user_id").alias("c_custkey")), ["c_custkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name, p_type, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def star_join(r: Roles) -> DataFrame:
    c = F.col
    dims = [
        (r.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"), "inner"), (r.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"), "inner"),
        (r.nation.select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"), "left"), (r.part.select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey"), "left"), (r.supplier.select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"), "left"),
    ]
    return rel.star_join(r.lineitem, dims).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_name", "p_type", "s_name")


@query("SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, o_totalprice, sum(l_quantity::DECIMAL(18,2))::DOUBLE / nullif(o_totalprice, 0) AS per_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_totalprice")
def preaggregated_join(r: Roles) -> DataFrame:
    sums = r.lineitem.groupBy("l_orderkey").agg(exact_sum("l_quantity").alias("quantity"))
    both = sums.join(r.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey", "left")
    return both.withColumn("per_price", ratio("quantity", "o_totalprice"))


@query("SELECT 'c' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier UNION ALL SELECT DISTINCT 'n', n_nationkey::BIGINT, n_name FROM nation")
def union_by_name(r: Roles) -> DataFrame:
    n = r.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"), F.lit("n").alias("kind")).distinct()
    return rel.union_all([r.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), r.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), n])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def top_k(r: Roles) -> DataFrame:
    return rel.top_k(r.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 25)


@query("SELECT quantile_disc(o_orderkey, 0.25) AS quarter, quantile_disc(o_orderkey, 0.5) AS half, quantile_disc(o_orderkey, 0.99) AS most FROM orders")
def quantile_inside(r: Roles) -> DataFrame:
    return rel.quantiles(r.orders, "o_orderkey", {"quarter": 0.25, "half": 0.5, "most": 0.99})


# ---- sources, sinks and layout ---------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(r: Roles) -> DataFrame:
    path = scratch.new_path(r.spark)
    r.customer.write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(r.spark, path, r.customer.schema)


@query("SELECT 'customer.csv' AS _source_file, count(*) AS n FROM customer")
def append_once(r: Roles) -> DataFrame:
    """The same batch twice is appended once."""
    path = scratch.new_path(r.spark)
    batch = files.with_lineage(r.customer, "customer.csv")
    for _ in range(2):
        files.append_once(batch, path, ["_source_file", "_ingestion_date"], ["_ingestion_date"])
    return r.spark.read.parquet(path).groupBy("_source_file").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, 'P' AS o_orderstatus FROM orders")
def publish_over_itself(r: Roles) -> DataFrame:
    path = scratch.new_path(r.spark)
    files.publish(r.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    files.publish(incremental.update_where(r.spark.read.parquet(path), "true", {"o_orderstatus": "'P'"}), path, same_schema=True)
    return r.spark.read.parquet(path)


@query("SELECT 12 AS before, 1 AS after, count(*) AS rows, sum(l_orderkey)::BIGINT AS keys FROM lineitem")
def compact_report(r: Roles) -> DataFrame:
    """Files of every partition before and after compaction, and what the compacted table holds. There is a partition for each 64 MB
    of the input, so that no task writes more; null where partitions differ."""
    many, few = scratch.new_path(r.spark), scratch.new_path(r.spark)
    n = layout.parts_of(r.spark, r.path("lineitem"))
    layout.rewrite(layout.with_part(r.lineitem, n, ["l_orderkey", "l_linenumber"]), many, 12, "part", n)
    layout.compact(r.spark, many, few, target_bytes=1 << 40, by=["part"])
    counts = [layout.file_sizes(r.spark, p).groupBy("folder").agg(F.count("*").alias("n")).agg(layout.alike("n").alias(name)) for p, name in ((many, "before"), (few, "after"))]
    held = r.spark.read.parquet(few).agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"))
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(held))


@query("""WITH m AS (SELECT quantile_disc(l_partkey, 0.5) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, true AS skips FROM lineitem, m WHERE l_partkey = k""")
def cluster_skipping(r: Roles) -> DataFrame:
    """A point lookup in rows that lie in Z-order of two keys: it finds the same rows, and its scan passes over most."""
    path = scratch.new_path(r.spark)
    layout.cluster(r.lineitem, ["l_partkey", "l_suppkey"], path, 8)
    middle = rel.quantile(r.lineitem, "l_partkey", 0.5).first()[0]
    found = r.spark.read.parquet(path).filter(F.col("l_partkey") == middle).select("l_orderkey", "l_linenumber", "l_suppkey")
    return found.withColumn("skips", F.lit(layout.rows_scanned(found) < r.lineitem.count()))