from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.functions import row_hash
from lakeloom.operators import asof, cleaning, data_quality, dimensions, facts, incremental, keys, layout, profiling, scd2
from lakeloom.operators import relational as rel
from lakeloom.sources import files

DAY = datetime(2020, 1, 1)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def day(n):
    return DAY + timedelta(days=n)


def versions(df):
    return sorted(((r["id"], r["v"], r["valid_from"], r["valid_to"], r["is_current"]) for r in df.collect()), key=str)


def build(spark, events):
    return scd2.scd2_build(spark.createDataFrame(events, "id long, ts timestamp, n long, v string"), "id", "ts", ["v"], ["n"]).drop("version_num")


def healthy(dim):
    h = scd2.scd2_health(dim, "id").first()
    return (h["inverted"], h["unlinked"], h["not_one_current"]) == (0, 0, 0)


def test_split_keeps_rows_whose_predicate_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id long, price double")
    ok, bad = cleaning.split_valid(df, [("price > 0", "price is not positive")])
    assert [r["id"] for r in ok.collect()] == [1]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_unparseable_values_become_null_and_are_rejected(spark):
    raw = spark.createDataFrame([("o1", "c", "delivered", "2020-01-01 00:00:00"), ("o2", "c", "delivered", "soon"), ("o3", "c", "lost", "2020-01-01 00:00:00")], "order_id string, customer_id string, order_status string, order_purchase_timestamp string")
    ok, bad = cleaning.clean(raw, cleaning.RULES["orders"])
    assert [r["order_id"] for r in ok.collect()] == ["o1"]
    assert {r["order_id"]: r["_reject_reason"] for r in bad.collect()} == {"o2": "order_purchase_timestamp is null", "o3": "order_status is unknown"}


@pytest.mark.parametrize("name", sorted(cleaning.RULES))
def test_every_rule_parts_its_table(spark, name):
    cols = sorted({p.split()[0] for p, _ in cleaning.RULES[name].rules} | set(cleaning.RULES[name].dedup))
    df = spark.createDataFrame([tuple("1" for _ in cols), tuple(None for _ in cols)], ", ".join(f"{c} string" for c in cols))
    ok, bad = cleaning.clean(df, cleaning.RULES[name])
    assert ok.count() + bad.count() == cleaning.standardise(df, cleaning.RULES[name]).count()


def test_publish_split_clears_old_rejects(spark, tmp_path):
    rule = cleaning.CleanRule(rules=[("x > 0", "not positive")])
    for rows, n in (([(1,), (-1,)], 1), ([(1,)], 0)):
        cleaning.publish_split(spark.createDataFrame(rows, "x int"), rule, f"{tmp_path}/ok", f"{tmp_path}/bad")
        assert spark.read.parquet(f"{tmp_path}/bad").count() == n


def test_latest_per_key_breaks_ties(spark):
    df = spark.createDataFrame([(1, DAY, "a"), (1, DAY, "b"), (1, None, "c")], "k long, ts timestamp, v string")
    assert [r["v"] for r in rel.latest_per_key(df, ["k"], "ts", ["v"]).collect()] == ["b"]


def test_row_hash_keeps_the_place_of_nulls(spark):
    df = spark.createDataFrame([(1, None, "SP"), (1, "SP", None)], "a long, b string, c string")
    assert df.select(row_hash(["a", "b", "c"])).distinct().count() == 2


def test_mode_ties_give_the_smallest_and_ignore_nulls(spark):
    df = spark.createDataFrame([("z", "b", 1.0), ("z", "a", 3.0), ("z", None, 2.0), ("z", None, 2.0)], "zip string, city string, lat double")
    r = dimensions.build_mode_avg_dim(df, "zip", ["lat"], ["city"]).first()
    assert (r["mode_city"], r["avg_lat"]) == ("a", 2.0)


def test_returning_value_is_a_version_of_its_own(spark):
    dim = build(spark, [(1, day(0), 1, "A"), (1, day(1), 2, "B"), (1, day(2), 3, "A"), (1, day(3), 4, "A")])
    assert {(r["v"], r["valid_from"], r["valid_to"]) for r in dim.collect()} == {("A", day(0), day(1)), ("B", day(1), day(2)), ("A", day(2), None)}
    assert healthy(dim)


def test_changes_at_one_instant_follow_the_tie_break(spark):
    dim = build(spark, [(1, day(0), 2, "B"), (1, day(0), 1, "A"), (1, day(1), 3, "B")])
    assert {(r["v"], r["valid_from"], r["valid_to"]) for r in dim.collect()} == {("A", day(0), day(0)), ("B", day(0), None)}


def test_merge_moves_inserts_and_is_idempotent(spark):
    dim = build(spark, [(1, day(0), 1, "A"), (2, day(0), 1, "X")])
    batch = spark.createDataFrame([(1, "B", day(9)), (2, "X", day(9)), (3, "N", day(9))], "id long, v string, change_ts timestamp")
    once = scd2.scd2_merge(dim, batch, "id", ["v"], "change_ts")
    assert once.count() == 4 and healthy(once)
    assert versions(scd2.scd2_merge(once, batch, "id", ["v"], "change_ts")) == versions(once)


def test_merge_numbers_new_versions_after_the_largest_key(spark):
    dim = keys.add_surrogate_key(build(spark, [(1, day(0), 1, "A")]), "customer_key", ["id"])
    batch = spark.createDataFrame([(1, "B", day(9)), (3, "N", day(9))], "id long, v string, change_ts timestamp")
    assert sorted(r["customer_key"] for r in scd2.scd2_merge(dim, batch, "id", ["v"], "change_ts", "customer_key").collect()) == [1, 2, 3]


def test_naive_merge_breaks_on_a_late_change_and_the_late_merge_does_not(spark):
    dim = build(spark, [(1, day(0), 1, "A"), (1, day(10), 2, "B")])
    late = spark.createDataFrame([(1, "L", day(5))], "id long, v string, change_ts timestamp")
    assert not healthy(scd2.scd2_merge(dim, late, "id", ["v"], "change_ts"))
    fixed, counts = scd2.scd2_apply_late(dim, late, "id", ["v"], "change_ts")
    assert fixed.count() == 3 and healthy(fixed) and counts.first()["split"] == 1
    assert versions(scd2.scd2_apply_late(fixed, late, "id", ["v"], "change_ts")[0]) == versions(fixed)


def test_change_before_history_is_skipped_and_counted(spark):
    dim = build(spark, [(1, day(0), 1, "A")])
    early = spark.createDataFrame([(1, "L", day(-5))], "id long, v string, change_ts timestamp")
    out, counts = scd2.scd2_apply_late(dim, early, "id", ["v"], "change_ts")
    assert versions(out) == versions(dim) and counts.first()["before_history"] == 1


def test_rebuild_takes_all_late_changes(spark):
    dim = build(spark, [(1, day(0), 1, "A"), (1, day(10), 2, "B")])
    late = spark.createDataFrame([(1, "L", day(5)), (1, "M", day(6)), (1, "E", day(-3))], "id long, v string, change_ts timestamp")
    out = scd2.scd2_rebuild(dim, late, "id", ["v"], "change_ts")
    assert out.count() == 5 and healthy(out)


def test_health_sees_an_entity_without_a_current_version(spark):
    dim = build(spark, [(1, day(0), 1, "A")]).withColumn("is_current", F.lit(False))
    assert scd2.scd2_health(dim, "id").first()["not_one_current"] == 1


def test_point_in_time_join_is_half_open(spark):
    dim = build(spark, [(1, day(0), 1, "A"), (1, day(10), 2, "B")])
    fact = spark.createDataFrame([(1, day(10)), (1, day(9)), (1, day(-1)), (2, day(1))], "id long, at timestamp")
    assert sorted((r["at"], r["v"]) for r in rel.pit_join(fact, dim, "id", "at").collect()) == [(day(9), "A"), (day(10), "B")]
    assert rel.pit_join(fact, dim, "id", "at", "left").count() == 4


def test_allocation_zero_weight_missing_payment_and_residue(spark):
    items = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 10.0), ("b", 2, 10.0), ("b", 3, 10.0), ("c", 1, 5.0)], "order_id string, n int, price double")
    paid = spark.createDataFrame([("a", 9.0), ("b", 6.0), ("b", 4.0)], "order_id string, amount double")
    got = {(r["order_id"], r["n"]): r["allocated"] for r in facts.allocate(items, paid, "order_id", "price", "amount").collect()}
    assert got == {("a", 1): None, ("b", 1): 3.33, ("b", 2): 3.33, ("b", 3): 3.33, ("c", 1): 0.0}
    exact = facts.allocate(items, paid, "order_id", "price", "amount", residue_order=["n"]).filter("order_id = 'b'")
    assert sorted((r["n"], r["allocated"]) for r in exact.collect()) == [(1, 3.34), (2, 3.33), (3, 3.33)]


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(0, 20)), max_size=40), st.sampled_from([0, 10_000]))
def test_surrogate_key_equals_global_row_number(spark, values, few):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(keys, "FEW_ROWS", few)  # by ranges, and by one window
        got = keys.add_surrogate_key(df, "k", ["v", "i"], 5).collect()
    want = df.withColumn("k", F.row_number().over(Window.orderBy("v", "i")) + 5).collect()
    assert {r["i"]: r["k"] for r in got} == {r["i"]: r["k"] for r in want}


def test_upsert_refuses_repeated_source_keys_and_never_matches_nulls(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    with pytest.raises(ValueError):
        incremental.upsert(target, spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string"), ["k"])
    out = incremental.upsert(target, spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string"), ["k"])
    assert sorted(r["v"] for r in out.collect()) == ["b", "x", "y"]


TABLE = st.dictionaries(st.integers(1, 8), st.one_of(st.none(), st.integers(0, 2)), max_size=8)


@FEW
@given(TABLE, TABLE)
def test_applying_a_diff_gives_the_new_table(spark, old, new):
    frame = lambda d: spark.createDataFrame(list(d.items()), "k int, v int")
    diff = incremental.snapshot_diff(frame(old), frame(new), ["k"])
    assert dict(incremental.apply_changes(frame(old), diff, ["k"]).collect()) == new
    kinds = {r["_change_type"] for r in diff.collect()}
    assert kinds <= set(incremental.KINDS) and (kinds or old == new)


def test_delete_where_keeps_rows_with_a_null_condition(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 1.0)], "k long, x double")
    assert sorted(r["k"] for r in incremental.delete_where(df, "x = 0").collect()) == [2, 3]


def test_rollup_labels_subtotals_and_not_null_keys(spark):
    df = spark.createDataFrame([("SP", 1.0), (None, 2.0)], "state string, x double")
    got = {r["state"]: r["n"] for r in rel.rollup(df, ["state"], {"n": F.count("*")}, {"state": "ALL STATES"}).collect()}
    assert got == {"SP": 1, None: 1, "ALL STATES": 2}


def test_calendar_conventions(spark):
    dense = dimensions.build_dim_date(spark, "2016-01-01", "2019-12-31", "dense")
    assert dense.count() == 1461 and dense.agg(F.max("date_key")).first()[0] == 1461
    sunday = dimensions.build_dim_date(spark, "2016-01-03", "2016-01-03", sunday=1).first()
    assert (sunday["date_key"], sunday["day_of_week"], sunday["day_name"], sunday["is_weekend"]) == (20160103, 1, "Sunday", True)


def test_quality_gate_quarantines(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, -1.0)], "k long, x double")
    results = data_quality.check_table(df, "t", {"positive": ["x"], "unique": ["k"], "types": {"k": "bigint"}})
    assert {r["check"]: r["passed"] for r in results.collect()} == {"x > 0": False, "k unique": True, "k is bigint": True}
    assert not data_quality.gate(results, df, f"{tmp_path}/q") and spark.read.parquet(f"{tmp_path}/q/batch").count() == 2
    assert data_quality.gate(results.filter("passed"), df)


def test_csv_with_line_ends_in_quotes_and_text_types(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,zip,note\n1,01310,"two\nlines, ""quoted"""\n')
    r = files.read_csv(spark, f"{tmp_path}/r.csv", as_text=True).first()
    assert (r["zip"], r["note"]) == ("01310", 'two\nlines, "quoted"')


def test_ingesting_twice_appends_once(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id\n1\n2\n")
    for _ in range(2):
        files.ingest_all(spark, {"c": f"{tmp_path}/c.csv"}, f"{tmp_path}/bronze")
    assert spark.read.parquet(f"{tmp_path}/bronze/c").count() == 2


def test_publish_swaps_and_guards_the_schema(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.publish(spark.range(3), path)
    files.publish(spark.read.parquet(path).filter("id > 0"), path, same_schema=True)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        files.publish(spark.range(3).withColumnRenamed("id", "x"), path, same_schema=True)
    files.insert_into(spark.range(5, 6), path)
    assert spark.read.parquet(path).count() == 3
    assert layout.file_report(spark, path).first()["files"] >= 2


def test_hash_collisions_are_found(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert profiling.hash_collisions(df, ["x", "y"]).count() == 1


def test_publish_that_was_ended_between_its_renames_is_recovered(spark, tmp_path):
    path = f"{tmp_path}/gold/t"
    files.publish(spark.range(3), path)
    (tmp_path / "gold" / "t").rename(tmp_path / "gold" / "t.previous")
    assert files.read_table(spark, str(tmp_path), "gold", "t").count() == 3
    (tmp_path / "gold" / "t").rename(tmp_path / "gold" / "t.previous")
    files.publish(spark.range(5), path, same_schema=True)
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("slice_rows", [1_000_000, 40, 8])
def test_merge_join_equals_range_join(spark, slice_rows):
    """Hot entities in slices of time and instants that hold many facts, long histories, gaps, versions of no length, nulls."""
    dim = [(1, 0, 5, "a"), (1, 5, 5, "none"), (1, 5, None, "b"), (2, 0, 3, "c"), (2, 6, 8, "d"), (None, 0, None, "n"), (4, 2, None, "e"), (5, None, None, "f")]
    dim += [(9, t, t + 1 if t < 299 else None, f"v{t}") for t in range(300)]
    fact = [(1, t % 10, k) for k, t in enumerate(range(200))] + [(1, 5, k) for k in range(150)] + [(2, t, 0) for t in range(10)] + [(3, 1, 0), (None, 2, 0), (4, 1, 0), (4, 2, 0), (5, 1, 0), (9, None, 0)]
    fact += [(9, t % 320, k) for k, t in enumerate(range(-5, 700))]
    d = spark.createDataFrame(dim, "id int, valid_from int, valid_to int, v string")
    f = spark.createDataFrame(fact, "id int, at int, k int").repartition(3)
    key = lambda r: tuple(map(str, r))
    for how in ("inner", "left"):
        plain, merged = rel.pit_join(f, d, "id", "at", how), asof.asof_join(f, d, "id", "at", how, slice_rows=slice_rows)
        assert merged.columns == plain.columns
        assert sorted(merged.collect(), key=key) == sorted(plain.collect(), key=key)
    assert merged.count() == len(fact)


def test_slices_of_a_hot_entity_are_even_and_dealt(spark):
    keys = spark.range(20_000).selectExpr("IF(id % 10 < 8, 1, id) AS _entity", "CAST(pow(id / 20000.0, 6) * 1e9 AS LONG) AS _at")
    edges = asof._edges(keys, 1_000)
    assert [r["_entity"] for r in edges.collect()] == [1]
    sizes = [r["count"] for r in keys.filter("_entity = 1").join(edges, "_entity").withColumn("s", asof._slice("_at")).groupBy("s").count().collect()]
    assert sum(sizes) == 16_000 and len(sizes) > 10 and max(sizes) < 3_000
    one = asof._edges(spark.range(5_000).selectExpr("1 AS _entity", "7 AS _at"), 500).first()["_edges"]
    assert len(one) == 1 and one[0]["times"] > 5


def test_merge_join_makes_no_row_that_it_does_not_return(spark):
    d = spark.range(1_000).selectExpr("1 AS id", "id AS valid_from", "id + 1 AS valid_to")
    f = spark.range(3_000).selectExpr("1 AS id", "id % 1000 AS at")
    out = asof.asof_join(f, d, "id", "at")
    assert out.count() == 3_000 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        asof.asof_join(f.withColumn("valid_to", F.lit(1)), d, "id", "at")


def test_lookup_of_a_wide_dimension_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rel, "LOOKUP_BYTES", 1000)
    wide = spark.range(5).withColumn("text", F.repeat(F.lit("x"), 1000))
    plan = rel.lookup(spark.range(9), wide, ["id"])._jdf.queryExecution().analyzed().toString()
    narrow = rel.lookup(spark.range(9), spark.range(5), ["id"])._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in plan and "strategy=broadcast" in narrow


def test_scratch_is_refused_on_a_cluster_and_can_be_discarded(spark, tmp_path):
    from types import SimpleNamespace

    from lakeloom.sources import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(cluster)
    df = scratch.cut(spark.range(4))
    assert df.count() == 4
    scratch.discard(df)
    assert not files.exists(spark, df._lakeloom_path)


def test_quantiles_are_exact_with_ties_and_nulls(spark):
    df = spark.range(400_000).selectExpr("id * 7919 % 400009 AS v", "IF(id % 5 = 0, NULL, id % 3) AS few", "CAST(NULL AS INT) AS none")
    values = sorted(i * 7919 % 400009 for i in range(400_000))
    for p in (0.0, 0.001, 0.25, 0.5, 0.77777, 1.0):
        assert rel.quantile(df, "v", p).first()[0] == values[max(1, round(p * 400_000)) - 1]
    few = sorted(i % 3 for i in range(400_000) if i % 5)
    assert rel.quantiles(df, "few", {"a": 0.1, "b": 0.5, "c": 0.9}).first() == (few[32_000 - 1], few[160_000 - 1], few[288_000 - 1])
    assert rel.quantiles(df, "none", {"a": 0.1, "b": 0.5}).first() == (None, None)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orphans_take_distinct_keys_of_parents(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k long, v string")
    parent = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, w string")
    got = rel.orphans(child, parent, {"k": "k"})
    assert got.columns == ["k", "v"] and sorted(r["v"] for r in got.collect()) == ["b", "c", "d"]
    assert "Aggregate" in optimized(got)


def test_completeness_makes_the_fact_once(spark):
    fact = spark.range(7).selectExpr("IF(id = 6, NULL, id div 3) AS o", "IF(id = 1, 0, id) % 3 AS line", "IF(id % 4 = 0, NULL, id) AS part", "id AS other")
    got = facts.fact_completeness(fact, ["part"], "o", ["o", "line"])
    assert got.first().asDict() == {"total": 7, "missing_part": 2, "orders": 2, "duplicate_grain": 1}
    assert facts.fact_completeness(fact, ["part"], "o", ["other"]).first().asDict() == {"total": 7, "missing_part": 2, "orders": 2, "duplicate_grain": 0}
    assert optimized(got).count("Range (") == 1


def test_versions_and_dimensions_meet_orders_before_items(spark):
    items = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10), (3, 1, 12)], "o long, line long, p long")
    orders = spark.createDataFrame([(1, 7, 5, "F"), (2, 8, 6, None), (4, 7, 9, "F")], "o long, c long, at long, s string")
    history = spark.createDataFrame([(7, 1, 0, 5), (7, 2, 5, None), (8, 1, 7, None)], "c long, version_num long, valid_from long, valid_to long")
    parts, states = spark.createDataFrame([(10, 100)], "p long, part_key long"), spark.createDataFrame([("F", 1)], "s string, state_key long")
    of = lambda **k: facts.build_fact(items, orders, history, [(parts, ["p"]), (states, ["s"])], "o", "c", "at", ["o", "line", "c", "version_num", "part_key", "state_key"], **k).drop("_loaded_at")
    assert sorted(map(tuple, of().collect())) == [(1, 1, 7, 2, 100, 1), (1, 2, 7, 2, None, 1)]
    assert sorted(map(tuple, of(pit="left").collect()), key=str) == [(1, 1, 7, 2, 100, 1), (1, 2, 7, 2, None, 1), (2, 1, 8, None, 100, None)]
    first = next(x for x in optimized(of()).splitlines() if "Join " in x)
    assert "o#" in first and "valid_from" not in first
