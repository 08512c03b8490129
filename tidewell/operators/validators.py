"""Validators.  Each returns violations: rule, column, severity, n_bad (and more where said); a clean table gives no rows.

Rules of one shape are compiled into one aggregate over all columns, so a table is read once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import agg_row, corr, is_float, numeric_columns, share, value
from tidewell.functions.quantiles import quantiles

SCHEMA = "rule string, column string, severity string, n_bad long"
SEVERITIES = ["CRITICAL", "ERROR", "WARNING"]


def counted(df: DataFrame, rules: Iterable[tuple[str, str, str, Column]]) -> DataFrame:
    """Violations of (rule, column, severity, condition) rules: the rows for which a condition is true, in one aggregate."""
    rules = list(rules)
    if not rules:
        return df.sparkSession.createDataFrame([], SCHEMA)
    wide = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(f"r{i}") for i, (*_, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.lit(s).alias("severity"), F.col(f"r{i}").cast("long").alias("n_bad")) for i, (r, c, s, _) in enumerate(rules)])
    return wide.select(F.explode(rows).alias("v")).select("v.*").where("n_bad > 0")


def listed(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Violations known from metadata alone (at most one a column or rule)."""
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def check_required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    return listed(df, [("required_column", c, "CRITICAL", 1) for c in required if c not in df.columns])


def check_types(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns of another type; a whole-numbered float where an integer is expected is a warning only."""
    kinds = dict(df.dtypes)
    wrong = {c: k for c, k in expected.items() if c in kinds and kinds[c] != k}
    soft = [c for c, k in wrong.items() if k in ("int", "bigint") and is_float(df, c)]
    whole = agg_row(df, {c: F.sum((value(df, c) % 1 != 0).cast("long")) for c in soft}) if soft else {}
    return listed(df, [("type", c, "WARNING" if c in soft and not whole[c] else "ERROR", 1) for c in wrong])


def check_schema_drift(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    kinds = dict(df.dtypes)
    rows = [("column_missing", c, "ERROR", 1) for c in expected if c not in kinds] + [("column_added", c, "WARNING", 1) for c in kinds if c not in expected]
    return listed(df, rows + [("type_changed", c, "ERROR", 1) for c, k in expected.items() if c in kinds and kinds[c] != k])


def check_timestamps(df: DataFrame, column: str, now: str) -> DataFrame:
    ts = F.col(column).try_cast("timestamp_ntz")
    end = F.lit(now).cast("timestamp_ntz")
    return counted(df, [("unparseable", column, "ERROR", F.col(column).isNotNull() & ts.isNull()), ("future", column, "WARNING", ts > end), ("before_1970", column, "WARNING", ts < F.lit("1970-01-01").cast("timestamp_ntz"))])


def check_unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_bad counts all members of repeated keys."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad"))
    return bad.select(F.lit("unique_key").alias("rule"), F.lit(",".join(keys)).alias("column"), F.lit("CRITICAL").alias("severity"), "n_bad").where("n_bad > 0")


def check_ranges(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """column, min, max, ok of the columns with declared bounds."""
    from tidewell.functions.columns import long_form

    out = long_form(df, {c: [F.min(value(df, c)).cast("double"), F.max(value(df, c)).cast("double"), F.lit(None if lo is None else float(lo)), F.lit(None if hi is None else float(hi))] for c, (lo, hi) in bounds.items()}, ["min", "max", "lo", "hi"])
    return out.select("column", "min", "max", (~(F.coalesce(F.col("min") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("max") > F.col("hi"), F.lit(False)))).alias("ok"))


def check_bounds(df: DataFrame, bounds: dict[str, tuple], severity: str = "ERROR") -> DataFrame:
    rules = [("below_min", c, severity, value(df, c) < lo) for c, (lo, _) in bounds.items() if lo is not None]
    return counted(df, rules + [("above_max", c, severity, value(df, c) > hi) for c, (_, hi) in bounds.items() if hi is not None])


manual_threshold_check = check_bounds


def check_positivity(df: DataFrame, strict: list[str] = (), loose: list[str] = ()) -> DataFrame:
    return counted(df, [("positive", c, "ERROR", value(df, c) <= 0) for c in strict] + [("non_negative", c, "ERROR", value(df, c) < 0) for c in loose])


COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}


def check_logical(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``left op right``; pairs with a null are skipped."""
    return counted(df, [("logical", f"{a} {op} {b}", "ERROR", ~COMPARE[op](value(df, a), value(df, b))) for a, op, b in rules])


def check_auto_iqr(df: DataFrame, columns: list[str] | None = None, k: float = 3.0, least: int = 20) -> DataFrame:
    own = columns or numeric_columns(df)
    got, n = quantiles(df, {c: (value(df, c), [0.25, 0.75]) for c in own}), agg_row(df, {c: F.count(value(df, c)) for c in own}) if own else {}
    ends = {c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c, q in got.items() if q and n[c] >= least}
    return counted(df, [("auto_iqr", c, "WARNING", (value(df, c) < lo) | (value(df, c) > hi)) for c, (lo, hi) in ends.items()])


def check_nulls(df: DataFrame, critical: list[str] = (), limits: dict[str, float] | None = None, error: float = 0.10, warning: float = 0.05) -> DataFrame:
    """rule, column, severity, null_rate; infinities count as null; worst first."""
    from tidewell.functions.columns import long_form

    limits = limits or {}
    rates = long_form(df, {c: [F.avg(value(df, c, infinite=False).isNull().cast("int")), F.lit(c in critical), F.lit(float(limits.get(c, error)))] for c in df.columns}, ["null_rate", "critical", "limit"])
    severity = F.when(F.col("critical") & (F.col("null_rate") > 0), "CRITICAL").when(F.col("null_rate") > F.col("limit"), "ERROR").when(F.col("null_rate") > warning, "WARNING")
    out = rates.withColumn("severity", severity).where("severity IS NOT NULL")
    return sort_violations(out.select(F.lit("null_rate").alias("rule"), "column", "severity", "null_rate"))


def sort_violations(df: DataFrame) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "column")


def check_zeros(df: DataFrame, columns: list[str] | None = None, mandatory: list[str] = (), error: float = 0.5, warning: float = 0.2) -> DataFrame:
    """rule, column, severity, zero_rate; columns with two values or fewer are skipped unless mandatory."""
    own = columns or numeric_columns(df)
    got = agg_row(df, {f"{k}|{c}": e for c in own for k, e in (("z", F.avg((value(df, c) == 0).cast("int"))), ("d", F.count_distinct(c)), ("n", F.count(value(df, c))))})
    rows = []
    for c in own:
        z, d, n = got[f"z|{c}"] or 0.0, got[f"d|{c}"], got[f"n|{c}"]
        severity = "CRITICAL" if c in mandatory and z > 0 else None if d == 2 else "ERROR" if z > error or z == 1 and n >= 10 else "WARNING" if z > warning else None
        if severity:
            rows.append(("zero_rate", c, severity, float(z)))
    return df.sparkSession.createDataFrame(rows, "rule string, column string, severity string, zero_rate double")


def check_duplicate_rows(df: DataFrame) -> DataFrame:
    extra = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"))
    return extra.select(F.lit("duplicate_rows").alias("rule"), F.lit("*").alias("column"), F.lit("WARNING").alias("severity"), "n_bad").where("n_bad > 0")


def check_referential(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that the reference table lacks."""
    bad = anti_join_invalid(df.where(F.col(column).isNotNull()), column, reference, key).agg(F.count("*").alias("n_bad"))
    return bad.select(F.lit("referential").alias("rule"), F.lit(column).alias("column"), F.lit("ERROR").alias("severity"), "n_bad").where("n_bad > 0")


def semi_join_allowed(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(F.col(key).alias("_ref")), F.col(column) == F.col("_ref"), "left_semi")


def anti_join_invalid(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    return df.join(reference.select(F.col(key).alias("_ref")), F.col(column) == F.col("_ref"), "left_anti")


NEEDS = {"not_null": lambda c: c.isNull(), "is_null": lambda c: c.isNotNull(), "positive": lambda c: c <= 0, "non_negative": lambda c: c < 0}


def check_cross_column(df: DataFrame, rules: list[tuple[str, object, str, str]]) -> DataFrame:
    """(A, v, B, need): where A = v, B must be not_null, is_null, positive or non_negative."""
    return counted(df, [(f"if_{a}={v}_then_{need}", b, "ERROR", (F.col(a) == v) & NEEDS[need](F.col(b))) for a, v, b, need in rules])


def check_cardinality(df: DataFrame, columns: list[str], ids: list[str] = ()) -> DataFrame:
    """column, issue: CONSTANT, NEAR_CONSTANT (one value over 99 %), FULLY_UNIQUE and not declared an id."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p")).select("p.*").where("v IS NOT NULL")
    sums = pairs.groupBy("column", "v").agg(F.count("*").alias("n")).groupBy("column").agg(F.count("*").alias("d"), F.max("n").alias("top"), F.sum("n").alias("n"))
    issue = F.when(F.col("d") <= 1, "CONSTANT").when(F.col("top") > 0.99 * F.col("n"), "NEAR_CONSTANT").when((F.col("d") == F.col("n")) & ~F.col("column").isin(list(ids) or [""]), "FULLY_UNIQUE")
    return sums.select("column", issue.alias("issue")).where("issue IS NOT NULL")


def check_categories(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """column, unexpected: the distinct values outside the allowed ones."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(F.lit(column).alias("column"), F.col(column).alias("unexpected")).distinct()


def check_business_rules(df: DataFrame) -> DataFrame:
    """Rules by column name: amounts and the like are positive, ages at most 150, percentages within 0-100."""
    rules = []
    for c in numeric_columns(df):
        name = c.lower()
        if any(t in name for t in ("price", "amount", "quantity", "salary", "revenue")):
            rules.append(("negative", c, "ERROR", value(df, c) < 0))
        if "age" in name.split("_"):
            rules.append(("age", c, "ERROR", (value(df, c) < 0) | (value(df, c) > 150)))
        if any(t in name for t in ("pct", "percent")):
            rules.append(("percentage", c, "ERROR", (value(df, c) < 0) | (value(df, c) > 100)))
    return counted(df, rules) if rules else listed(df, [])


def detect_leakage(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """column, r, severity: numeric columns whose |r| to the target is at least 0.98 (CRITICAL) or 0.90 (WARNING)."""
    from tidewell.functions.columns import long_form

    r = long_form(df, {c: [corr(value(df, c), value(df, target))] for c in columns}, ["r"])
    return r.withColumn("severity", F.when(F.abs("r") >= 0.98, "CRITICAL").when(F.abs("r") >= 0.90, "WARNING")).where("severity IS NOT NULL")


def detect_model_leakage(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """column, reason: nearly unique values (ID), a name that tells the future, or a near-perfect correlation."""
    import re

    from tidewell.functions.columns import long_form

    numeric = set(numeric_columns(df))
    # Name parts that tell the outcome.
    future = re.compile(r"(^|_)(outcome|result|flag|label|target|pred|score|won|lost|churn|default)($|_)", re.I)
    got = long_form(df, {c: [F.try_divide(F.count_distinct(c), F.count("*")), corr(value(df, c), value(df, target)) if c in numeric else F.lit(None).cast("double"), F.lit(bool(future.search(c)))] for c in columns}, ["unique", "r", "future"])
    return got.select("column", F.when(F.col("unique") >= 0.99, "ID").when(F.col("future"), "FUTURE_NAME").when(F.abs("r") >= 0.95, "CORRELATION").alias("reason")).where("reason IS NOT NULL")


def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(predicate)


def classify_soft_hard(df: DataFrame, condition: Column, score: str, limit: float) -> DataFrame:
    """Rows that meet ``condition`` with kind HARD (their anomaly score reaches ``limit``) or SOFT."""
    return df.where(condition).withColumn("kind", F.when(F.col(score) >= limit, "HARD").otherwise("SOFT"))


def null_share(df: DataFrame) -> Column:
    return sum((share(value(df, c).isNull()) for c in df.columns), F.lit(0.0)) / len(df.columns)
