"""Declared data-quality checks: rules as plain data, results as one DataFrame.

A rule set is a dict with any of: columns [names], types {column: type}, not_null [columns],
unique [columns], unique_together [[columns]], positive [columns], non_negative [columns],
between {column: (low, high)}, in_set {column: values}, a_ge_b [(a, b)]. Nulls pass all value checks;
not_null alone looks at them. A value check of a column that isn't there fails on every row. volume (baseline,
tolerance) bounds the number of rows. All checks of single rows and the uniqueness of one key are evaluated in one pass
over the table; `write_checked` takes the checks of single rows while the table is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.files import publish

DIMENSIONS = {"columns": "schema", "types": "schema", "not_null": "completeness", "unique": "uniqueness", "unique_together": "uniqueness", "positive": "validity", "non_negative": "validity", "between": "validity", "in_set": "validity", "a_ge_b": "consistency", "volume": "volume", "referential": "consistency"}
COLUMNS = ["table", "dimension", "check", "passed", "detail"]


def dimension_of(kind: str) -> str:
    return DIMENSIONS[kind]


def _row_checks(rules: dict) -> list[tuple[str, str, Column]]:
    """(kind, label, condition of a failing row) of the checks that look at one row at a time."""
    c, out = F.col, []
    out += [("not_null", f"{x} not null", c(x).isNull()) for x in rules.get("not_null", [])]
    out += [("positive", f"{x} > 0", c(x) <= 0) for x in rules.get("positive", [])]
    out += [("non_negative", f"{x} >= 0", c(x) < 0) for x in rules.get("non_negative", [])]
    out += [("between", f"{x} between {lo} and {hi}", ~c(x).between(lo, hi)) for x, (lo, hi) in rules.get("between", {}).items()]
    out += [("in_set", f"{x} in set", ~c(x).isin(*values)) for x, values in rules.get("in_set", {}).items()]
    out += [("a_ge_b", f"{a} >= {b}", c(a) < c(b)) for a, b in rules.get("a_ge_b", [])]
    return out


def _detail(table: str, kind: str, check: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(table).alias("table"), F.lit(DIMENSIONS[kind]).alias("dimension"), F.lit(check).alias("check"), passed.alias("passed"), detail.alias("detail"))


def _result(table: str, kind: str, check: str, failures: Column) -> Column:
    n = failures.cast("long")
    return _detail(table, kind, check, n == 0, F.concat(n.cast("string"), F.lit(" failing")))


def _volume(table: str, baseline: int, tolerance: float, n: Column) -> Column:
    lo, hi = int(baseline * (1 - tolerance)), int(baseline * (1 + tolerance))
    return _detail(table, "volume", f"rows between {lo} and {hi}", n.between(lo, hi), F.concat(n.cast("string"), F.lit(" rows")))


def _schema_results(types: dict[str, str], table: str, rules: dict) -> list[Column]:
    known = [("columns", f"{x} exists", x in types) for x in rules.get("columns", [])]
    known += [("types", f"{x} is {t}", types.get(x) == t) for x, t in rules.get("types", {}).items()]
    return [_result(table, k, label, F.lit(0 if ok else 1)) for k, label, ok in known]


def _measures(df: DataFrame, rules: dict) -> tuple[list[tuple[str, str]], dict[str, Column]]:
    """Kinds and labels of the checks of single rows, and the aggregates that count the rows (n) and each check's failures (c0, c1, ...)."""
    checks, there = _row_checks(rules), set(df.columns)
    ok = lambda label: all(x in there for x in _columns_of(rules)[label])
    counts = {f"c{i}": F.count_if(bad if ok(label) else F.lit(True)) for i, (_, label, bad) in enumerate(checks)}
    return [(kind, label) for kind, label, _ in checks], {"n": F.count("*")} | counts


def _columns_of(rules: dict) -> dict[str, list[str]]:
    """Columns that a check of single rows looks at, by its label."""
    one = lambda x: [x] if isinstance(x, str) else list(x)
    names = [one(x) for kind in ("not_null", "positive", "non_negative", "between", "in_set", "a_ge_b") for x in rules.get(kind, [])]
    return {label: cols for (_, label, _), cols in zip(_row_checks(rules), names)}


def _keys_of(rules: dict) -> list[tuple[str, list[str]]]:
    return [("unique", [x]) for x in rules.get("unique", [])] + [("unique_together", list(ks)) for ks in rules.get("unique_together", [])]


def _repeated(df: DataFrame, table: str, kind: str, keys: list[str]) -> DataFrame:
    again = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    return again.select(F.inline(F.array(_result(table, kind, f"{', '.join(keys)} unique", F.col("n")))))


def check_table(df: DataFrame, table: str, rules: dict) -> DataFrame:
    """(table, dimension, check, passed, detail): a row per check."""
    schema, (checks, measures), keys = _schema_results(dict(df.dtypes), table, rules), _measures(df, rules), _keys_of(rules)
    results = schema + [_result(table, k, label, F.col(f"c{i}")) for i, (k, label) in enumerate(checks)]
    if "volume" in rules:
        results.append(_volume(table, *rules["volume"], F.col("n")))
    if len(keys) == 1 and set(keys[0][1]) <= set(df.columns):
        (kind, key), whole = keys[0], reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys[0][1]))
        per = df.groupBy(*key).agg(*(m.alias(c) for c, m in measures.items()))
        one = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measures), F.count_if(whole & (F.col("n") > 1)).alias("again"))
        return one.select(F.inline(F.array(*results, _result(table, kind, f"{', '.join(key)} unique", F.col("again")))))
    frames = [df.agg(*(m.alias(c) for c, m in measures.items())).select(F.inline(F.array(*results)))] if results else []
    return reduce(DataFrame.union, frames + [_repeated(df, table, kind, ks) for kind, ks in keys])


def write_checked(df: DataFrame, path: str, table: str, rules: dict) -> DataFrame:
    """Publishes the table and returns its checks. Rows are counted and judged on their way into the files, so only
    the columns of keys that must be unique are read again, from what was written."""
    checks, measures = _measures(df, rules)
    seen = Observation(f"checks of {table}")
    publish(df.observe(seen, *(m.alias(c) for c, m in measures.items())), path)
    got = {c: F.lit(int(n)).cast("long") for c, n in seen.get.items()}
    results = _schema_results(dict(df.dtypes), table, rules) + [_result(table, k, label, got[f"c{i}"]) for i, (k, label) in enumerate(checks)]
    if "volume" in rules:
        results.append(_volume(table, *rules["volume"], got["n"]))
    spark = df.sparkSession
    frames = [spark.range(1).select(F.inline(F.array(*results)))] if results else []
    return reduce(DataFrame.union, frames + [_repeated(spark.read.parquet(path), table, kind, ks) for kind, ks in _keys_of(rules)])


def check_volume(df: DataFrame, table: str, baseline: int, tolerance: float = 0.2) -> DataFrame:
    """The row count lies within the tolerance around the baseline; both bounds are cut to integers."""
    return df.agg(F.count("*").alias("n")).select(F.inline(F.array(_volume(table, baseline, tolerance, F.col("n")))))


def check_referential(frames: dict[str, DataFrame], refs: list[tuple[str, str, str, str]]) -> DataFrame:
    """refs: (child, column, parent, column). Distinct non-null child keys that no parent has."""
    out = []
    for child, c, parent, p in refs:
        keys = frames[child].select(F.col(c).alias("k")).dropna().distinct()
        lost = keys.join(frames[parent].select(F.col(p).alias("k")), "k", "left_anti").agg(F.count("*").alias("n"))
        out.append(lost.select(F.inline(F.array(_result(child, "referential", f"{c} in {parent}.{p}", F.col("n"))))))
    return reduce(DataFrame.union, out)


def summarise(results: DataFrame) -> DataFrame:
    """Per dimension: checks, passed ones and the pass rate in percent."""
    return results.groupBy("dimension").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed")).withColumn("pass_rate", 100.0 * F.col("passed") / F.col("checks"))


def gate(results: DataFrame, batch: DataFrame, quarantine: str | None = None) -> bool:
    """True if all checks passed. Else the batch and its failed checks are written below the quarantine path."""
    failed = results.filter("NOT passed")
    if failed.isEmpty():
        return True
    if quarantine:
        publish(batch, f"{quarantine}/batch")
        publish(failed, f"{quarantine}/report")
    return False
