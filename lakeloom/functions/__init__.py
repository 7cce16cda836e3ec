"""Column expressions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_fingerprint(cols: list[ColumnLike]) -> Column:
    """SHA-256 over the values in order, each as its length in bytes, a colon and itself, a null as a dash: different
    rows have different texts, also where values hold separators or one is null and the other empty."""
    values = [col(c).cast("string") for c in cols]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def row_hash(cols: list[ColumnLike], algo: str = "sha256", null_token: str = "", sep: str = "|") -> Column:
    """Fingerprint of the values in order. A null is `null_token` in its own place, so (a, null, b) and (a, b, null) differ;
    but a null and an empty value, or values that hold the separator, can be alike. With algo "exact" they never are."""
    if algo == "exact":
        return row_fingerprint(cols)
    text = F.concat_ws(sep, *(F.coalesce(col(c).cast("string"), F.lit(null_token)) for c in cols))
    return {"sha256": lambda: F.sha2(text, 256), "md5": lambda: F.md5(text)}[algo]()


def money(c: ColumnLike) -> Column:
    """An amount as an exact decimal, whatever numeric type it comes in."""
    return col(c).cast("decimal(18,2)")


def exact_sum(c: ColumnLike) -> Column:
    """Sum of amounts that doesn't depend on the order of rows, as a double."""
    return F.sum(money(c)).cast("double")


def round_half_up(c: Column, scale: int = 2) -> Column:
    """Rounds a double by its binary value: floor(x * 10^scale + 1/2)."""
    f = float(10**scale)
    return F.floor(c * f + 0.5) / f


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b in doubles; null where b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def day_of_week(c: ColumnLike, sunday: int = 0) -> Column:
    """Weekday with Sunday as `sunday`, so 0..6 or 1..7."""
    return F.dayofweek(col(c)) - 1 + sunday


def clean_text(c: ColumnLike, case: str = "lower") -> Column:
    return {"lower": F.lower, "upper": F.upper, "keep": lambda x: x}[case](F.trim(col(c)))


def row_bytes(df: DataFrame) -> Column:
    """Bytes that a row takes in a hash table, about: its texts' lengths, 8 for each other column, and 40 besides."""
    of = lambda c, t: F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if t in ("string", "binary") else F.lit(8)
    return reduce(lambda a, b: a + b, (of(c, t) for c, t in df.dtypes), F.lit(40)).cast("long")


def count_nulls(c: ColumnLike) -> Column:
    return F.count_if(col(c).isNull())
