"""Data-quality profiling and migration validation (Q1-Q8, V1-V9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# The value patterns that profiling recognises, by name.
PATTERNS = {
    "Email": r"^[\w.-]+@[\w.-]+\.\w+$",
    "Phone": r"^[\d\s\-()]+$",
    "Date (YYYYMMDD)": r"^\d{8}$",
    "Date (YYYY-MM-DD)": r"^\d{4}-\d{2}-\d{2}$",
    "SSN": r"^\d{3}-?\d{2}-?\d{4}$",
    "ZIP Code": r"^\d{5}(-\d{4})?$",
    "Numeric": r"^-?\d+\.?\d*$",
    "Alpha": r"^[A-Za-z]+$",
    "Alphanumeric": r"^[A-Za-z0-9]+$",
}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Q1: rows of each table."""
    return union_all([df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def column_profile(df: DataFrame, columns: list[str] | None = None, empty_is_null: bool = False, error: float | None = None) -> DataFrame:
    """Q2, Q4: total, nulls and distinct values of every column, in one aggregate.

    ``empty_is_null`` also counts empty strings as null and a null as one value.
    Exact distinct counts expand every row by the number of columns; with
    ``error``, a relative deviation, sketches of fixed size take their place.
    """
    columns = columns or df.columns

    def null(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c).cast("string") == "") if empty_is_null else F.col(c).isNull()

    def distinct(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("string"), F.lit("null")) if empty_is_null else F.col(c)
        return F.count_distinct(value) if error is None else F.approx_count_distinct(value, error)

    wide = df.agg(F.count("*").alias("total"), *[x for k, c in enumerate(columns) for x in (F.count_if(null(c)).alias(f"n{k}"), distinct(c).alias(f"d{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{k}").alias("null_count"), F.col(f"d{k}").alias("distinct_count")) for k, c in enumerate(columns)]))
    return wide.select("total", rows.alias("x")).select("x.column_name", "total", "x.null_count", "x.distinct_count")


def column_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q4: null and unique rates; an empty string is null, a null counts as a value."""
    profile = column_profile(df, columns, empty_is_null=True)
    return profile.select("column_name", F.try_divide("null_count", "total").alias("null_rate"), F.try_divide("distinct_count", "total").alias("unique_rate"))


def key_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(part in c.lower() for part in ("id", "key", "code"))]


def duplicate_keys(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """Q3: values of a key column that repeat, most frequent first."""
    counts = df.groupBy(F.col(column).cast("string").alias("key_value")).agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    return counts.select(F.lit(column).alias("column_name"), "key_value", "occurrences").orderBy(F.desc("occurrences"), "key_value").limit(limit)


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that follows from the parts alone, in 32 bits of MD5, which any database has."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def detect_patterns(df: DataFrame, columns: list[str], patterns: dict[str, str] = PATTERNS, least: float = 0.5, examples: int = 3) -> DataFrame:
    """Q5: value patterns that more than ``least`` of a column's non-empty values match, highest first, with the smallest few values that match."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = df.select(values.alias("x")).select("x.*").where("value IS NOT NULL AND value <> ''")
    wide = long.groupBy("column_name").agg(F.count("*").alias("n"), *[F.count_if(F.col("value").rlike(p)).alias(name) for name, p in patterns.items()])
    matched = wide.unpivot(["column_name", "n"], list(patterns), "pattern", "matches")
    found = matched.withColumn("match_rate", F.col("matches") / F.col("n")).where(F.col("match_rate") > least).select("column_name", "pattern", "match_rate")
    test = F.lit(None).cast("boolean")
    for name, p in patterns.items():
        test = F.when(F.col("pattern") == name, F.col("value").rlike(p)).otherwise(test)
    hits = long.distinct().join(F.broadcast(found.select("column_name", "pattern")), "column_name").where(test)  # a row for each column and pattern
    first = hits.withColumn("_r", F.expr("row_number() OVER (PARTITION BY column_name, pattern ORDER BY value)")).where(F.col("_r") <= examples)
    texts = first.groupBy("column_name", "pattern").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return found.join(texts, ["column_name", "pattern"]).orderBy(F.desc("match_rate"), "column_name", "pattern")


def quality_issues(rates: DataFrame) -> DataFrame:
    """Q6: issues from the rates of Q4."""
    issue = F.when(F.col("null_rate") > 0.1, F.lit("high-null-rate")).when((F.col("unique_rate") > 0) & (F.col("unique_rate") < 0.01), F.lit("low-cardinality"))
    severity = F.when(F.col("null_rate") > 0.5, F.lit("critical")).when(F.col("null_rate") > 0.1, F.lit("warning")).otherwise(F.lit("info"))
    return rates.withColumn("issue", issue).where("issue IS NOT NULL").select("column_name", "issue", severity.alias("severity"))


def table_score(rates: DataFrame) -> Column | DataFrame:
    """Q7: 100 less 50 for each unit of null rate above a tenth, at least 0."""
    penalty = F.sum(F.greatest(F.col("null_rate") - 0.1, F.lit(0.0)) * 50)
    return rates.agg(F.greatest(F.lit(100.0) - F.coalesce(penalty, F.lit(0.0)), F.lit(0.0)).alias("score"))


def orphan_count(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Q8, V6: non-null keys of ``child`` without a row in ``parent``; a left-anti join."""
    keys = child.where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
    return keys.join(parent.select(F.col(parent_column).alias("k")), "k", "left_anti").agg(F.count("*").alias("orphan_count"))


def referential_integrity(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Q8: orphans of every named relationship (name, child, column, parent, parent column)."""
    return union_all([orphan_count(c, cc, p, pc).select(F.lit(name).alias("relationship"), "orphan_count") for name, c, cc, p, pc in checks])


def null_checks(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """V1: nulls in the first ``most`` columns that must not be null."""
    profile = column_profile(df, columns[:most])
    return profile.select("column_name", "null_count", (F.col("null_count") == 0).alias("passed"))


def count_match(source: DataFrame, target: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """V2, V7: row counts of both sides and whether they differ by at most ``tolerance`` of the source's."""
    a, b = source.agg(F.count("*").alias("source_value")), target.agg(F.count("*").alias("target_value"))
    delta = F.abs(F.col("source_value") - F.col("target_value"))
    # Both sides are one row each.
    return a.join(b).select("source_value", "target_value", delta.alias("delta"), (delta <= F.col("source_value") * tolerance).alias("passed"))


def concatenated(columns: list[Column]) -> Column:
    """The checksum's text of a row: values between bars, null as empty."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def checksum(df: DataFrame, columns: list[Column], method: str = "md5", most: int = 10) -> DataFrame:
    """V3, V8: an order-free checksum of rows: md5 (first 60 bits), crc32, xxhash64 or length."""
    text = concatenated(columns[:most])
    value = {
        "md5": lambda: F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)"),
        "crc32": lambda: F.crc32(text.cast("binary")).cast("decimal(38,0)"),
        "xxhash64": lambda: F.xxhash64(text).cast("decimal(38,0)"),
        "length": lambda: F.length(text).cast("decimal(38,0)"),
    }[method]()
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def checksum_match(source: DataFrame, target: DataFrame, columns: list[Column], method: str = "md5") -> DataFrame:
    """V3: checksums of both sides, as text, and whether they agree."""
    a, b = checksum(source, columns, method), checksum(target, columns, method)
    return a.select(F.col("checksum").cast("string").alias("source_value")).join(b.select(F.col("checksum").cast("string").alias("target_value"))).withColumn(
        "passed", F.col("source_value") == F.col("target_value")
    )


def sample_compare(source: DataFrame, target: DataFrame, key: str, modulus: int, columns: list[str]) -> DataFrame:
    """V4: a deterministic sample by key hash of both sides, joined by key and compared."""
    pick = F.pmod(F.xxhash64(key), F.lit(modulus)) == 0
    a = source.where(pick).select(key, F.struct(*columns).alias("a"))
    b = target.where(pick).select(key, F.struct(*columns).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("different")
    return a.join(b, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def numeric_ranges(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """V5: minimum, maximum and mean of the first ``most`` numeric columns, in one aggregate."""
    columns = columns[:most]
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}_{k}") for k, c in enumerate(columns) for f in (F.min, F.max, F.avg)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{f}_{k}").alias(f"{f}_value") for f in ("min", "max", "avg")]) for k, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def range_match(source: DataFrame, target: DataFrame, columns: list[str], tolerance: float = 0.001) -> DataFrame:
    """V5: whether ranges of both sides agree within ``tolerance``."""
    a, b = numeric_ranges(source, columns), numeric_ranges(target, columns)
    joined = a.alias("a").join(b.alias("b"), "column_name")
    near = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance for c in ("min_value", "max_value", "avg_value")]
    return joined.select("column_name", *[c.alias(n) for c, n in zip(near, ("min_ok", "max_ok", "avg_ok"), strict=True)], (near[0] & near[1] & near[2]).alias("passed"))


def validation_report(results: DataFrame) -> DataFrame:
    """V9: passed and failed checks, by whether they are critical."""
    return results.groupBy("critical").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
