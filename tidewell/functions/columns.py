"""Column expressions and column lists that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that stand for a missing value, compared after trim and lower().
NULL_STRINGS = ["null", "none", "n/a", "na", "nan", "nil", "#n/a", "#na", "-", ".", "—", "undefined", ""]
# Sentinels compared as they are.
STRING_SENTINELS = ["N/A", "NA", "n/a", "na", "NULL", "null", "None", "none", "NaN", "nan", "#N/A", "#NULL!", "?", ".", " ", "--", "---", "UNKNOWN", "unknown", "missing", "MISSING", "TBD", "tbd", "N.A.", "N.A", "Not Available", "not available", "(blank)", "", "undefined", "Undefined", "NIL", "nil", "empty", "EMPTY"]
NUMERIC_SENTINELS = [-1, -99, -999, -9999, -99999, 9999, 99999, 999999]

TRUE_WORDS, FALSE_WORDS = ["true", "yes", "1", "t"], ["false", "no", "0", "f"]

#: Aggregates are dealt over several selects beyond this many expressions: very wide ones leave whole-stage codegen.
CHUNK = 80


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def value(df: DataFrame, name: str, infinite: bool = True) -> Column:
    """The column with NaN (and, if ``infinite`` is False, +-inf) as null."""
    c = F.col(name)
    if not is_float(df, name):
        return c
    gone = F.isnan(c) if infinite else F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(~gone, c)


def share(condition: Column) -> Column:
    """Share of rows for which a condition is true."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def agg_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """One row of aggregates as a dict, in as few passes as codegen allows; its size is the number of expressions."""
    out: dict = {}
    items = list(exprs.items())
    for at in range(0, len(items), CHUNK):
        out |= df.agg(*[c.alias(k) for k, c in items[at : at + CHUNK]]).first().asDict()
    return out


def corr(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows in which both are given; null where one of them is constant, which ``F.corr`` fails on."""
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: by zero it is infinite, or NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def long_form(df: DataFrame, parts: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """Aggregates of many columns in one pass, as one row a column: parts[column] are its aggregate expressions."""
    wide = df.agg(*[e.alias(f"{i}_{j}") for i, es in enumerate(parts.values()) for j, e in enumerate(es)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{j}").alias(n) for j, n in enumerate(names)]) for i, c in enumerate(parts)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def skewness_adjusted(n: Column, g1: Column) -> Column:
    """Sample skewness G1 from the population's g1."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_adjusted(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis G2 from the population's g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; every second digit from the right is doubled."""
    at = F.sequence(F.lit(1), F.length(digits))
    d = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    term = F.transform(at, lambda i: F.when(i % 2 == 1, d(i)).otherwise(F.when(d(i) > 4, d(i) * 2 - 9).otherwise(d(i) * 2)))
    return F.when(digits.rlike("^[0-9]+$"), F.aggregate(term, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(False)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
