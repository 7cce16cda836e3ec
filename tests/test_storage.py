"""Tables that are written in part: ingest ledger, merges by partition, change feed, key registry."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import row_fingerprint, row_hash
from lakeloom.operators import data_quality, incremental, keys, layout, scd2, suite
from lakeloom.operators import relational as rel
from lakeloom.operators.feed import Feed
from lakeloom.plans import retail  # noqa: F401  adds its queries
from lakeloom.plans.queries import ORACLE, QUERIES
from lakeloom.sources import csv_blocks, files, ledger, partitions, scratch
from tests.compare import assert_same, connect


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


# ---- scratch tables


def folders(spark, path):
    return {p.name for p in path.iterdir()}


def test_a_scope_leaves_only_what_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda s: str(tmp_path))
    outer = scratch.cut(spark.range(2))
    with scratch.scope():
        with scratch.scope():
            numbered = keys.add_surrogate_key(spark.range(30_000), "k", ["id"])
            result = scratch.keep(scratch.cut(numbered.filter("k % 10 = 0")))
            assert len(folders(spark, tmp_path)) == 4
        assert len(folders(spark, tmp_path)) == 2 and result.count() == 3_000
    assert folders(spark, tmp_path) == {outer._lakeloom_path.rsplit("/", 1)[-1]} and outer.count() == 2
    with pytest.raises(ValueError), scratch.scope():
        scratch.cut(spark.range(1))
        raise ValueError
    assert len(folders(spark, tmp_path)) == 1


# ---- ledger


def test_a_file_comes_in_once_and_again_when_it_changed(spark, tmp_path):
    root, src = f"{tmp_path}/bronze", tmp_path / "in"
    take = lambda: ledger.ingest(spark, "t", f"{src}/*.csv", root, "id int, v string")
    put(src / "a.csv", "id,v\n1,x\n2,y\n")
    assert take() == 1 and take() == 0
    put(src / "b c+%41é.csv", 'id,v\n3,"two\nlines"\n')
    assert take() == 1 and take() == 0
    assert rows_of(ledger.table(spark, root, "t"), "id", "v") == [(1, "x"), (2, "y"), (3, "two\nlines")]
    put(src / "a.csv", "id,v\n1,x\n2,changed\n9,new\n")
    assert take() == 1 and take() == 0
    assert rows_of(ledger.table(spark, root, "t"), "id", "v") == [(1, "x"), (2, "changed"), (3, "two\nlines"), (9, "new")]
    (src / "b c+%41é.csv").unlink()  # what a file brought stays when it goes
    assert take() == 0 and ledger.table(spark, root, "t").count() == 4
    assert spark.read.parquet(f"{root}/t").count() == 6


def test_rows_of_a_run_that_ended_before_its_entry_do_not_count(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/bronze"
    for name in ("a", "b"):
        put(tmp_path / f"in/{name}.csv", "id\n1\n2\n")
    sources = {name: f"{tmp_path}/in/{name}.csv" for name in ("a", "b")}
    real, calls = ledger.append, []

    def ends_early(df, path, by=None):
        calls.append(path)
        if len(calls) == 4:  # a's rows and entry, b's rows, then b's entry
            raise OSError("ended")
        real(df, path, by)

    monkeypatch.setattr(ledger, "append", ends_early)
    with pytest.raises(OSError):
        ledger.ingest_each(spark, sources, root)
    assert ledger.table(spark, root, "b").count() == 0 and spark.read.parquet(f"{root}/b").count() == 2
    monkeypatch.setattr(ledger, "append", real)
    assert ledger.ingest_each(spark, sources, root) == {"a": 0, "b": 1}
    assert [ledger.table(spark, root, x).count() for x in "ab"] == [2, 2]


def test_listing_files_does_not_read_them(spark, tmp_path):
    put(tmp_path / "in/a.csv", "id\n1\n")
    got = ledger.listed(spark, f"{tmp_path}/in").first()
    assert got["_source_file"].endswith("/in/a.csv") and got["_size"] == 5
    assert "content" not in ledger.listed(spark, f"{tmp_path}/in")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


# ---- merges by partition


def names_by(spark, path, by):
    return {r[0]: r[1] for r in spark.read.parquet(path).groupBy(by).agg(F.sort_array(F.collect_set("_metadata.file_path"))).collect()}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = [(i, f"v{i}", "abc"[i % 3] if i % 7 else None) for i in range(60)]
    files.append(spark.createDataFrame(old, "id long, v string, p string"), path, ["p"])
    before = names_by(spark, path, "p")
    batch = spark.createDataFrame([(1, "new", "b"), (4, "moved", "d"), (100, "more", "b")], "id long, v string, p string")
    done = partitions.merge_touched(path, batch, ["id"], ["p"], lambda rows, b: incremental.upsert(rows, b, ["id"]))
    assert sorted(done) == [("b",), ("d",)]
    want = {i: (v, p) for i, v, p in old} | {1: ("new", "b"), 4: ("moved", "d"), 100: ("more", "b")}
    assert {r["id"]: (r["v"], r["p"]) for r in spark.read.parquet(path).collect()} == want
    after = names_by(spark, path, "p")
    assert all(after[p] == before[p] for p in ("a", "c", None)) and after["b"] != before["b"]
    again = partitions.merge_touched(path, batch, ["id"], ["p"], lambda rows, b: incremental.upsert(rows, b, ["id"]))
    assert sorted(again) == [("b",), ("d",)] and {r["id"]: (r["v"], r["p"]) for r in spark.read.parquet(path).collect()} == want


def test_a_partition_that_ends_up_empty_goes(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.append(spark.createDataFrame([(1, "a", 1), (2, "b b", 1), (3, "b b", 2)], "id long, p string, q int"), path, ["p", "q"])
    batch = spark.createDataFrame([(2, "b b", 2)], "id long, p string, q int")
    partitions.merge_touched(path, batch, ["id"], ["p", "q"], lambda rows, b: incremental.upsert(rows, b, ["id"]))
    assert rows_of(spark.read.parquet(path), "id", "p", "q") == [(1, "a", 1), (2, "b b", 2), (3, "b b", 2)]
    assert not (tmp_path / "t/p=b b/q=1").exists() and (tmp_path / "t/p=a/q=1").exists()
    assert partitions.merge_touched(path, batch.limit(0), ["id"], ["p", "q"], None) == []


def test_rows_outside_the_touched_partitions_are_refused(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.append(spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string"), path, ["p"])
    batch = spark.createDataFrame([(1, "a")], "id long, p string")
    with pytest.raises(ValueError):
        partitions.merge_touched(path, batch, ["id"], ["p"], lambda rows, b: rows.withColumn("p", F.lit("z")))
    assert rows_of(spark.read.parquet(path), "id", "p") == [(1, "a"), (2, "b")]


def test_partitions_that_the_key_decides_are_pruned(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.range(1_000).withColumn("b", partitions.bucket(["id"], 20)).withColumn("v", F.lit("old"))
    files.append(table.repartition("b"), path, ["b"])
    batch = spark.createDataFrame([(5,), (77,)], "id long").withColumn("b", partitions.bucket(["id"], 20)).withColumn("v", F.lit("new"))
    seen = []

    def merge(rows, b):
        seen.append(layout.rows_scanned(rows))
        return incremental.upsert(rows, b, ["id"])

    partitions.merge_touched(path, batch, ["id"], ["b"], merge, derived=True)
    assert seen[0] < 200 and spark.read.parquet(path).filter("v = 'new'").count() == 2 and spark.read.parquet(path).count() == 1_000


# ---- compaction


def small_table(spark, path):
    for k in range(7):
        files.append(spark.range(k * 40, k * 40 + 40).selectExpr("id", "IF(id % 4 = 0, NULL, 'a b') AS p").repartition(1), path, ["p"])
    files.append(spark.range(1_000, 40_000).selectExpr("id", "'a b' AS p").repartition(1), path, ["p"])


def test_small_files_are_packed_by_partition(spark, tmp_path):
    path = f"{tmp_path}/t"
    small_table(spark, path)
    want, before = rows_of(spark.read.parquet(path), "id", "p"), {r["file"]: r["bytes"] for r in layout.file_sizes(spark, path).collect()}
    big = max(before, key=before.get)
    assert layout.compact_small(spark, path, 64 << 10) == 2
    after = {r["file"]: r["folder"] for r in layout.file_sizes(spark, path).collect()}
    assert len(after) == 3 and big in after and not set(after) & set(before) - {big}
    assert rows_of(spark.read.parquet(path), "id", "p") == want
    assert layout.compact_small(spark, path, 64 << 10) == 0 and set(after) == {r["file"] for r in layout.file_sizes(spark, path).collect()}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["p=__HIVE_DEFAULT_PARTITION__", "p=a b"]


@pytest.mark.parametrize("most", [1, 5, 8])
def test_small_files_beyond_a_round_are_packed_by_the_next(spark, tmp_path, monkeypatch, most):
    path = f"{tmp_path}/t"
    small_table(spark, path)
    want = rows_of(spark.read.parquet(path), "id", "p")
    monkeypatch.setattr(layout, "MAX_FILES", most)
    assert layout.compact_small(spark, path, 64 << 10) == 2
    assert layout.file_sizes(spark, path).count() == 3 and rows_of(spark.read.parquet(path), "id", "p") == want
    assert layout.compact_small(spark, path, 64 << 10) == 0


def test_rounds_take_whole_bins(spark):
    rng = random.Random(3)
    files_of = {("d%d" % (k % 4), k): rng.randint(2, 9) for k in range(60)}
    plan = [(f"f{k}_{i}", folder, 1, k) for (folder, k), n in files_of.items() for i in range(n)]
    got = layout.in_rounds(spark.createDataFrame(plan, "file string, folder string, bytes long, bin long"), 20).collect()
    assert sorted(r["file"] for r in got) == sorted(f for f, *_ in plan)
    rounds = {}
    for r in got:
        rounds.setdefault(r["round"], {}).setdefault(r["slot"], []).append(r["file"])
    assert len(rounds) > 10 and all(sorted(slots) == list(range(len(slots))) for slots in rounds.values())
    assert all(sum(map(len, slots.values())) < 20 + 9 for slots in rounds.values())
    bins = [sorted(x) for slots in rounds.values() for x in slots.values()]
    assert sorted(bins) == sorted(sorted(f"f{k}_{i}" for i in range(n)) for (_, k), n in files_of.items())


def test_a_compaction_that_was_broken_off_in_a_later_round_is_ended(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    small_table(spark, path)
    want, real, lists = rows_of(spark.read.parquet(path), "id", "p"), layout.move, []

    def breaks(session, old, new):
        lists.extend([new] * new.endswith(layout.OLD))
        if len(lists) == 2:
            raise OSError("ended")
        real(session, old, new)

    monkeypatch.setattr(layout, "MAX_FILES", 5)
    monkeypatch.setattr(layout, "move", breaks)
    with pytest.raises(OSError):
        layout.compact_small(spark, path, 64 << 10)
    assert rows_of(spark.read.parquet(path), "id", "p") == want and layout.file_sizes(spark, path).count() == 9
    monkeypatch.setattr(layout, "move", real)
    assert layout.compact_small(spark, path, 64 << 10) == 1
    assert rows_of(spark.read.parquet(path), "id", "p") == want and layout.file_sizes(spark, path).count() == 3


def test_a_round_keeps_the_names_of_folders_and_all_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    for p in ("01", "01", "1.50", "1.50"):
        files.append(spark.range(10).selectExpr("id", f"'{p}' AS p").repartition(1), path, ["p"])
    files.append(spark.range(10).selectExpr("id", "id * 2 AS v", "'01' AS p").repartition(1), path, ["p"])
    files.append(spark.range(50_000).selectExpr("id", "'a' AS p").repartition(1), path, ["p"])
    table = lambda: spark.read.option("mergeSchema", True).parquet(path)
    want = rows_of(table(), "id", "v", "p")
    assert layout.compact_small(spark, path, 64 << 10) == 2
    assert rows_of(table(), "id", "v", "p") == want and {r["p"] for r in table().select("p").distinct().collect()} == {"01", "1.50", "a"}


@pytest.mark.parametrize("ends_at", ["list", "swap"])
def test_a_compaction_that_was_broken_off_is_ended(spark, tmp_path, monkeypatch, ends_at):
    path = f"{tmp_path}/t"
    small_table(spark, path)
    want = rows_of(spark.read.parquet(path), "id", "p")
    real, calls = layout.move, []

    def breaks(session, old, new):
        calls.append(new)
        if ends_at == "list" or len(calls) > 2:
            raise OSError("ended")
        real(session, old, new)

    monkeypatch.setattr(layout, "move", breaks)
    with pytest.raises(OSError):
        layout.compact_small(spark, path, 64 << 10)
    monkeypatch.setattr(layout, "move", real)
    layout.recover_compaction(spark, path)
    assert rows_of(spark.read.parquet(path), "id", "p") == want
    layout.compact_small(spark, path, 64 << 10)
    assert rows_of(spark.read.parquet(path), "id", "p") == want and layout.file_sizes(spark, path).count() == 3


def test_bins_hold_about_the_target(spark):
    rng = random.Random(2)
    sizes = [(f"f{k:04d}", f"d{k % 3}", rng.randint(1, 120)) for k in range(300)]
    plan = layout.packing_plan(spark.createDataFrame(sizes, "file string, folder string, bytes long"), 100).collect()
    assert all(r["bytes"] < 50 for r in plan) and len(plan) >= sum(b < 50 for *_, b in sizes) - 3
    bins = {}
    for r in plan:
        bins.setdefault((r["folder"], r["bin"]), []).append(r["bytes"])
    assert all(sum(b) < 150 and len(b) > 1 for b in bins.values())
    assert sum(sum(b) >= 70 for b in bins.values()) >= len(bins) - 3


# ---- change feed


def test_every_version_of_a_random_table_comes_back(spark, tmp_path):
    rng = random.Random(5)
    feed, state, states = Feed(spark, f"{tmp_path}/f", ["id"], every=3), {}, []
    for n in range(8):
        for i in rng.sample(range(30), 12):
            if rng.random() < 0.3:
                state.pop(i, None)
            else:
                state[i] = rng.choice([None, "a", "b"])
        df = spark.createDataFrame(sorted(state.items()), "id long, v string")
        assert feed.commit(df) == n if n % 2 == 0 else feed.commit_changes(incremental.snapshot_diff(feed.state(), df, ["id"])) == n
        states.append(sorted(state.items()))
    for n, want in enumerate(states):
        assert sorted(map(tuple, feed.state(n).select("id", "v").collect())) == want
    assert [r["version"] for r in feed.history().orderBy("version").collect()] == list(range(8))
    assert sorted(p.name for p in (tmp_path / "f/snapshots").iterdir() if p.is_dir()) == ["_version=0", "_version=3", "_version=6"]
    with pytest.raises(ValueError):
        feed.state(8)


def test_a_feed_reads_the_partitions_that_it_needs(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/f", ["id"], every=4)
    feed.commit(spark.range(100).withColumn("v", F.lit(0)))
    for n in range(1, 7):
        feed.commit(spark.range(100).withColumn("v", F.lit(n)))
    assert layout.rows_scanned(feed.changes(6)) == 200 and layout.rows_scanned(feed.changes(2, 3)) == 400
    plan = feed.state(5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_commit_version", plan)
    assert all("_version=4/" in f for f in feed.state(4).inputFiles())
    assert [r["_commit_version"] for r in feed.rows_of({"id": 3}).collect()] == [n for n in range(1, 7) for _ in (0, 1)]


def test_a_version_without_its_commit_is_written_over(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/f", ["id"])
    assert feed.version() == -1
    feed.commit(spark.range(5).withColumn("v", F.lit("a")))
    spark.createDataFrame([(9, "half", "insert")], "id long, v string, _change_type string").write.parquet(f"{tmp_path}/f/changes/_commit_version=1")
    assert feed.version() == 0 and feed.state().count() == 5 and feed.changes(0).count() == 0
    feed.commit(spark.range(6).withColumn("v", F.lit("a")))
    assert rows_of(feed.changes(1), "id", "_change_type") == [(5, "insert")]


# ---- keys, fingerprints, sketches


def test_registered_keys_stay(spark):
    reg = spark.createDataFrame([], "k long, a string, b int")
    one = spark.createDataFrame([("x", 1), ("y", None), (None, 2), ("x", 1)], "a string, b int")
    reg = keys.register_keys(reg, one, ["a", "b"], "k")
    assert sorted(r["k"] for r in reg.collect()) == [1, 2, 3]
    old = {(r["a"], r["b"]): r["k"] for r in reg.collect()}
    two = spark.createDataFrame([("a", 0), (None, 2), (None, None), ("y", None)], "a string, b int")
    new = {(r["a"], r["b"]): r["k"] for r in keys.register_keys(reg, two, ["a", "b"], "k").collect()}
    assert new == old | {(None, None): 4, ("a", 0): 5}
    keyed = keys.with_registered_key(two.withColumn("v", F.lit(1)), reg, ["a", "b"], "k")
    assert keyed.columns == ["k", "a", "b", "v"] and sorted(map(str, (r["k"] for r in keyed.collect()))) == sorted(map(str, (None, old[(None, 2)], None, old[("y", None)])))


def test_fingerprints_are_alike_only_for_equal_rows(spark):
    values = [None, "", "-", "|", "a", "a|", "|a", "1:a", "0:", "é", "a|a"]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    assert df.select(row_fingerprint(["a", "b"])).distinct().count() == len(values) ** 2
    assert df.select(row_hash(["a", "b"], "exact")).distinct().count() == len(values) ** 2 > df.select(row_hash(["a", "b"])).distinct().count()


def test_exact_fingerprints_see_a_value_that_became_empty(spark):
    events = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "")], "id long, at long, v string")
    assert scd2.scd2_build(events, "id", "at", ["v"], []).count() == 2
    assert scd2.scd2_build(events, "id", "at", ["v"], [], "exact").count() == 3


def test_a_merge_with_a_null_id_changes_nothing_the_second_time(spark):
    dim = spark.createDataFrame([], "id long, v string, valid_from long, valid_to long, is_current boolean, row_hash string")
    batch = spark.createDataFrame([(None, "a", 1), (2, "b", 1)], "id long, v string, at long")
    one = scd2.scd2_merge(dim, batch, "id", ["v"], "at")
    assert one.count() == 2
    one = spark.createDataFrame(one.collect(), one.schema)
    assert rows_of(scd2.scd2_merge(one, batch, "id", ["v"], "at"), *one.columns) == rows_of(one, *one.columns)
    moved = scd2.scd2_merge(one, spark.createDataFrame([(None, "c", 5)], batch.schema), "id", ["v"], "at")
    assert moved.count() == 3 and moved.filter("id IS NULL AND is_current AND v = 'c'").count() == 1


@pytest.mark.parametrize("k", [200, 1_000])
def test_merged_sketches_keep_their_rank_error(spark, k):
    df = spark.range(60_000).selectExpr("id % 3 AS g", "id % 40 AS part", "CAST((id * 7919) % 60000 AS DOUBLE) AS x").union(spark.createDataFrame([(0, 0, None)], "g long, part long, x double"))
    stored = rel.quantile_sketches(df, ["g", "part"], "x", k)
    ranks = [0.01, 0.25, 0.5, 0.75, 0.99]
    for row in rel.sketch_quantiles(rel.merge_sketches(stored, ["g"], k), ranks).collect():
        for p, value in zip(ranks, row["quantiles"]):
            assert abs(value / 60_000 - p) <= 1.65 / k**0.9 * 1.5
    assert rel.sketch_quantiles(rel.merge_sketches(stored, [], k), [0.5]).count() == 1


def test_update_from_refuses_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a")], "id long, v string")
    with pytest.raises(ValueError):
        rel.update_from(target, spark.createDataFrame([(1, "b"), (1, "c")], "id long, w string"), ["id"], {"v": "w"})


# ---- CSV by blocks


def csv_field(rng):
    text = "".join(rng.choice(["a", "b", " ", '"', '""', ",", "\n", "\n\n", "é", "\r\n", "x" * 30]) for _ in range(rng.randint(0, 6)))
    return rng.choice([text, "plain", "", "long " * rng.randint(0, 30)])


def csv_text(rows, end):
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') else x
    return end.join(",".join(map(quoted, r)) for r in [("id", "a", "b"), *rows]) + end


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_csv_by_blocks_equals_the_plain_reader(spark, tmp_path, small_blocks, seed, end):
    rng = random.Random(seed)
    for k in range(3):
        rows = [(str(i), csv_field(rng), csv_field(rng)) for i in range(60)]
        if k == 2:
            rows[20] = ("20", "over\nmany\nblocks\n" * 40, '"')
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            f.write(csv_text(rows, end) + ("\n\n" if k == 1 else ""))
    schema = "id int, a string, b string"
    got = csv_blocks.read_csv_blocks(spark, str(tmp_path), schema)
    assert csv_blocks._lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 60
    if end == "\r\n":
        got = got.withColumns({c: F.regexp_replace(c, "\r\n", "\n") for c in "ab"})
    assert rows_of(got, "id", "a", "b") == rows_of(files.read_csv(spark, str(tmp_path), schema), "id", "a", "b")


def test_csv_by_blocks_without_rows_or_header(spark, tmp_path, small_blocks):
    put(tmp_path / "a/none.csv", "id,a\n")
    put(tmp_path / "b/some.csv", '1,x\n"2","y\nz"\n')
    put(tmp_path / "c/quoted.csv", '"id","name\nof"\n7,q\n')
    read = lambda p, **k: rows_of(csv_blocks.read_csv_blocks(spark, f"{tmp_path}/{p}", "id int, a string", **k), "id", "a")
    assert read("a") == [] and read("b", header=False) == [(1, "x"), (2, "y\nz")] and read("c") == [(7, "q")]


# ---- tests of layouts on larger tables


@pytest.mark.parametrize("name, kind", [("compact_report", "parquet"), ("csv_by_blocks", "csv"), ("compact_small_files", "parquet")])
def test_no_task_writes_a_whole_table(spark, tmp_path, monkeypatch, name, kind):
    sf_dir = "/root/testdata/sf0.01"
    monkeypatch.setattr(layout, "TASK_BYTES", 200 << 10)
    monkeypatch.setattr(scratch, "shared_dir", lambda session: str(tmp_path))
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])
    for folder in tmp_path.iterdir():
        sizes = [f.stat().st_size for f in folder.rglob(f"part-*.{kind}")]
        assert sum(sizes) < 100 << 10 or max(sizes) < sum(sizes) / 2


def test_compaction_within_partitions(spark, tmp_path):
    path, out = f"{tmp_path}/t", f"{tmp_path}/out"
    small_table(spark, path)
    assert layout.compact(spark, path, out, 1 << 40, by=["p"]) == 2
    assert sorted(r["count"] for r in layout.file_sizes(spark, out).groupBy("folder").count().collect()) == [1, 1]
    assert rows_of(spark.read.parquet(out), "id", "p") == rows_of(spark.read.parquet(path), "id", "p")
    n = layout.compact(spark, path, out, 32 << 10, by=["p"])
    assert n > 3 and layout.file_sizes(spark, out).count() == n and rows_of(spark.read.parquet(out), "id", "p") == rows_of(spark.read.parquet(path), "id", "p")


# ---- the declared suite


def test_the_suite_has_its_checks_and_reads_each_table_once(spark):
    assert sum(len(r.get(k, [])) for t in suite.COLUMNS for r in [suite.rules(t, 1)] for k in ("columns", "types", "not_null", "unique", "unique_together", "positive", "non_negative", "between", "in_set", "a_ge_b")) + len(suite.COLUMNS) + len(suite.REFERENCES) == 111
    rows = spark.createDataFrame([("o1", 1, "p", "s", 1.0, 0.0), ("o1", 1, "p", "s", 0.0, -1.0), (None, 1, None, "s", None, None), (None, 1, "p", "s", 2.0, 3.0)], suite.COLUMNS["order_items"])
    out = data_quality.check_table(rows, "order_items", suite.rules("order_items", 4))
    failed = {r["check"]: r["detail"] for r in out.filter("NOT passed").collect()}
    assert failed == {"order_id not null": "2 failing", "product_id not null": "1 failing", "price not null": "1 failing", "price > 0": "1 failing", "freight_value >= 0": "1 failing", "order_id, order_item_id unique": "1 failing"}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_checks_while_writing_equal_those_of_a_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (1, None, -1), (2, "z", 7)], "id int, v string, n int")
    rules = {"columns": ["id", "gone"], "types": {"id": "int", "v": "int"}, "not_null": ["v", "gone"], "unique": ["id"], "unique_together": [["id", "v"]], "between": {"n": (0, 6)}, "in_set": {"v": ["a"]}, "a_ge_b": [("n", "id")], "volume": (10, 0.2)}
    for df in (rows, rows.limit(0)):
        scanned = data_quality.check_table(df, "t", rules)
        assert rows_of(data_quality.write_checked(df, f"{tmp_path}/t", "t", rules), *data_quality.COLUMNS) == rows_of(scanned, *data_quality.COLUMNS)
        assert spark.read.parquet(f"{tmp_path}/t").count() == df.count()
    assert {r["check"]: r["passed"] for r in data_quality.check_table(rows, "t", rules).collect()}["gone not null"] is False


def test_a_suite_over_some_tables_checks_what_is_there(spark):
    sellers = spark.createDataFrame([("s", "SP")], "seller_id string, seller_state string")
    assert suite.run_suite({"sellers": sellers}).filter("NOT passed").isEmpty()
