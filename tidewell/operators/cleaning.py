"""Projections that clean and reshape (names, nulls, types, nested values, imputation, outliers).

Thresholded operators take two steps: one aggregate over all columns at once, then one projection.  Operators that depend on
row order take ``order`` (and ``by``) explicitly.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewell.functions.columns import FALSE_WORDS, NULL_STRINGS, NUMERIC_SENTINELS, STRING_SENTINELS, TRUE_WORDS, agg_row, any_of, numeric_columns, share, string_columns, value
from tidewell.functions.quantiles import quantiles
from tidewell.functions.stages import stash
from tidewell.operators.halo import as_number, split
from tidewell.operators.neighbours import nearest


def normalise_column_names(df: DataFrame) -> DataFrame:
    """snake_case names without specials; repeated names get _1, _2, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = re.sub(r"[^0-9a-zA-Z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c)).strip("_").lower() or "column"
        seen[n] = seen.get(n, -1) + 1
        names.append(f"{n}_{seen[n]}" if seen[n] else n)
    return df.toDF(*names)


def unify_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    own = columns or string_columns(df)
    return df.withColumns({c: F.when(~F.lower(F.trim(c)).isin(NULL_STRINGS), F.col(c)) for c in own})


def replace_sentinels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    own = columns or string_columns(df) + numeric_columns(df)
    text = set(string_columns(df))
    return df.withColumns({c: F.when(~F.col(c).isin(STRING_SENTINELS if c in text else NUMERIC_SENTINELS), F.col(c)) for c in own})


def sentinel_rate_filter(df: DataFrame, columns: list[str], sentinels: list[float], min_rate: float = 0.05) -> DataFrame:
    """A sentinel becomes null only where it fills more than ``min_rate`` of rows; two-valued columns are exempt."""
    rates = agg_row(df, {f"{c}|{s}": share(F.col(c) == s) for c in columns for s in sentinels} | {f"{c}|n": F.count_distinct(c) for c in columns})
    out = {}
    for c in columns:
        gone = [s for s in sentinels if rates[f"{c}|n"] > 2 and rates[f"{c}|{s}"] > min_rate]
        if gone:
            out[c] = F.when(~F.col(c).isin(gone), F.col(c))
    return df.withColumns(out) if out else df


def zero_to_null_impute(df: DataFrame, columns: list[str], min_rate: float = 0.5, how: str = "median") -> DataFrame:
    rates = agg_row(df, {c: share(F.col(c) == 0) for c in columns})
    hit = [c for c in columns if rates[c] is not None and rates[c] > min_rate]
    return impute_simple(df.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in hit}), dict.fromkeys(hit, how)) if hit else df


def stringify_complex(df: DataFrame) -> DataFrame:
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def encode_binary_base64(df: DataFrame) -> DataFrame:
    """Binary columns become base64 text on one line; Spark may break lines after 76 characters."""
    raw = [f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)]
    return df.withColumns({c: F.translate(F.base64(c), "\r\n", "") for c in raw}) if raw else df


def flatten_struct(df: DataFrame, depth: int = 3, sep: str = ".") -> DataFrame:
    """Structs become columns ``a.b`` down to ``depth`` levels; deeper ones become JSON, arrays text joined by ", "."""

    def parts(c: Column, kind: T.DataType, name: str, left: int) -> list[Column]:
        if isinstance(kind, T.StructType) and left:
            return [p for f in kind for p in parts(c[f.name], f.dataType, f"{name}{sep}{f.name}", left - 1)]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.AtomicType):
            return [F.array_join(c.cast("array<string>"), ", ").alias(name)]
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            return [F.to_json(c).alias(name)]
        return [c.alias(name)]

    return df.select(*[p for f in df.schema for p in parts(F.col(f"`{f.name}`"), f.dataType, f.name, depth)])


def expand_json_strings(df: DataFrame, column: str, schema: str, min_share: float = 0.7, prefix: str = "") -> DataFrame:
    """A text column that parses in at least ``min_share`` of its values becomes the fields of ``schema``."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    ok = agg_row(df, {"ok": F.avg(F.when(F.col(column).isNotNull(), (F.get_json_object(column, "$").isNotNull()).cast("int")))})["ok"]
    if ok is None or ok < min_share:
        return df
    fields = T._parse_datatype_string(schema).names
    return df.withColumn("_j", parsed).select(*[c for c in df.columns if c != column], *[F.col("_j")[f].alias(prefix + f) for f in fields])


def split_single_column(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """One text column is split by the separator that gives the most even number of fields above one."""
    marks = [",", "\t", "|", ";", "  "]
    fields = {m: F.size(F.split(column, re.escape(m))) for m in marks}
    seen = agg_row(df, {f"{k}{i}": f(fields[m]) for i, m in enumerate(marks) for k, f in (("lo", F.min), ("hi", F.max))})
    good = [(seen[f"lo{i}"], m) for i, m in enumerate(marks) if seen[f"lo{i}"] == seen[f"hi{i}"] and (seen[f"lo{i}"] or 0) > 1]
    if not good:
        return df
    n, mark = max(good)
    parts = F.split(column, re.escape(mark))
    return df.select(*[F.trim(parts[i]).alias(names[i] if names else f"field_{i}") for i in range(n)])


def coerce_types(df: DataFrame, numeric: float = 0.9, stamp: float = 0.85) -> DataFrame:
    """Text columns become double, timestamp or boolean where enough of their values can be cast."""
    own = string_columns(df)
    if not own:
        return df
    ok = lambda c, e: F.avg(F.when(F.col(c).isNotNull(), e.isNotNull().cast("int")))
    words = lambda c: F.when(F.lower(F.trim(c)).isin(TRUE_WORDS + FALSE_WORDS), F.lower(F.trim(c)).isin(TRUE_WORDS))
    num, ts = (lambda c: F.col(c).try_cast("double")), (lambda c: F.col(c).try_cast("timestamp_ntz"))
    got = agg_row(df, {f"{k}|{c}": ok(c, e(c)) for c in own for k, e in (("n", num), ("t", ts), ("b", words))})
    out = {}
    for c in own:
        rates = {k: got[f"{k}|{c}"] or 0 for k in "ntb"}
        if rates["n"] >= numeric:
            out[c] = num(c)
        elif rates["t"] >= stamp:
            out[c] = ts(c)
        elif rates["b"] == 1:
            out[c] = words(c)
    return df.withColumns(out) if out else df


def coerce_mixed_numeric(df: DataFrame, column: str, max_loss: float = 0.15, buckets: int = 1000) -> DataFrame:
    """Numeric with little loss; else currency marks stripped and the first number taken; else a hash bucket."""
    plain = F.col(column).try_cast("double")
    stripped = F.regexp_extract(F.regexp_replace(column, r"[$€£¥₹,\s]", ""), r"-?\d+\.?\d*", 0).try_cast("double")
    loss = agg_row(df, {k: F.avg(F.when(F.col(column).isNotNull(), e.isNull().cast("int"))) for k, e in (("plain", plain), ("stripped", stripped))})
    if (loss["plain"] or 0) <= max_loss:
        return df.withColumn(column, plain)
    if (loss["stripped"] or 0) <= max_loss:
        return df.withColumn(column, stripped)
    return df.withColumn(column, F.pmod(F.xxhash64(column), F.lit(buckets)).cast("double"))


def coerce_epochs(df: DataFrame, columns: list[str], min_share: float = 0.8) -> DataFrame:
    """Whole numbers that mostly fall in 2000-2050 as seconds or milliseconds become timestamps."""
    lo, hi = 946_684_800, 2_524_608_000
    got = agg_row(df, {f"{k}|{c}": F.avg(F.when(F.col(c).isNotNull(), F.col(c).between(lo * f, hi * f).cast("int"))) for c in columns for k, f in (("s", 1), ("ms", 1000))})
    out = {c: F.timestamp_seconds(F.col(c).cast("long")) for c in columns if (got[f"s|{c}"] or 0) >= min_share}
    out |= {c: F.timestamp_millis(F.col(c).cast("long")) for c in columns if c not in out and (got[f"ms|{c}"] or 0) >= min_share}
    return df.withColumns(out) if out else df


DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "MM-dd-yyyy", "yyyyMMdd"]


def coerce_date_strings(df: DataFrame, columns: list[str], min_share: float = 0.7, formats: list[str] = DATE_FORMATS) -> DataFrame:
    parsed = {c: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]) for c in columns}
    got = agg_row(df, {c: F.avg(F.when(F.col(c).isNotNull(), e.isNotNull().cast("int"))) for c, e in parsed.items()})
    out = {c: e for c, e in parsed.items() if (got[c] or 0) >= min_share}
    return df.withColumns(out) if out else df


def standardise_timestamps(df: DataFrame, columns: list[str], zone: str = "UTC") -> DataFrame:
    return df.withColumns({c: F.date_format(F.to_utc_timestamp(F.col(c).cast("timestamp"), zone), "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in columns})


def strip_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in string_columns(df)})


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Configured casts; what can't be cast becomes null."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def normalise_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    word = lambda c: F.lower(F.trim(c))
    return df.withColumns({c: F.when(word(c).isin("yes", "y", "true", "1"), 1).when(word(c).isin("no", "n", "false", "0"), 0) for c in columns})


def null_rates(df: DataFrame) -> dict[str, float]:
    return agg_row(df, {c: F.avg(value(df, c).isNull().cast("int")) for c in df.columns})


def drop_high_null_columns(df: DataFrame, limit: float = 0.9, inclusive: bool = False) -> DataFrame:
    rates = null_rates(df)
    return df.drop(*[c for c, r in rates.items() if r is not None and (r > limit or inclusive and r == limit)])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    ends = agg_row(df, {f"{k}|{c}": f(c) for c in df.columns for k, f in (("lo", F.min), ("hi", F.max))})
    return df.drop(*[c for c in df.columns if ends[f"lo|{c}"] == ends[f"hi|{c}"]])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Later columns that equal an earlier one of the same type in every row; candidates are found by a hash sum first."""
    sums = agg_row(df, {c: F.sum((F.xxhash64(c) % 1_000_003).cast("long")) for c in df.columns})
    kinds = dict(df.dtypes)
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :] if sums[a] == sums[b] and kinds[a] == kinds[b]]
    if not pairs:
        return df
    same = agg_row(df, {f"{a}|{b}": F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")) for a, b in pairs})
    return df.drop(*{b for a, b in pairs if same[f"{a}|{b}"]})


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def modes(df: DataFrame, columns: list[str]) -> dict:
    """The most frequent value of each column, the least one on ties; counted in one pass, combined before its shuffle."""
    numeric, kinds = set(numeric_columns(df)), dict(df.dtypes)
    # numbers are compared as numbers, all else as text
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("o")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL").groupBy("c", "v", "o").agg(F.count("*").alias("n"))
    best = {r["c"]: r["v"] for r in counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "o", "v")).alias("v")).collect()}  # one row a column
    return {c: F.lit(best[c]).cast(kinds[c]) for c in columns if c in best}


def impute_simple(df: DataFrame, how: dict[str, str | float]) -> DataFrame:
    """``how``: column -> mean, median, mode, or a constant."""
    named = {h: [c for c in how if how[c] == h] for h in ("mean", "median", "mode")}
    fills = agg_row(df, {c: F.avg(value(df, c)) for c in named["mean"]}) if named["mean"] else {}
    fills |= {c: q[0] for c, q in quantiles(df, {c: (value(df, c), [0.5]) for c in named["median"]}).items() if q}
    fills |= modes(df, named["mode"]) if named["mode"] else {}
    fills |= {c: h for c, h in how.items() if h not in named}
    return df.withColumns({c: F.coalesce(value(df, c), v if isinstance(v, Column) else F.lit(v)) for c, v in fills.items() if v is not None})


def impute_tiered(df: DataFrame, order: list[str] | None = None, by: list[str] | None = None, high: float = 0.9, low: float = 0.25) -> DataFrame:
    """Over ``high`` nulls: dropped.  From ``low``: median or mode, or forward/backward fill if ``order`` is given.  Under: left."""
    rates = null_rates(df)
    df = df.drop(*[c for c, r in rates.items() if (r or 0) > high])
    mid = [c for c in df.columns if low <= (rates[c] or 0) <= high]
    if order:
        return impute_ffill_bfill(df, mid, order, by)
    numeric = set(numeric_columns(df))
    return impute_simple(df, {c: "median" if c in numeric else "mode" for c in mid}) if mid else df


def impute_ffill_bfill(df: DataFrame, columns: list[str], order: list[str], by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Last value before a row, else the first one after it, within ``by``.

    Large keys (or the whole table, without ``by``) are split by ranges of the first order column: a range's first and last values
    are carried over to the key's other ranges, so no task sees more than a range.  A whole table needs a number, date or time
    there.
    """
    own, names, keys = {c: value(df, c) for c in columns}, df.columns, list(by or [])
    if not keys and as_number(df, order[0]) is None:
        raise ValueError(f"{order[0]} is {dict(df.dtypes)[order[0]]}: give by, or a number, date or time as the first of order")
    if not keys and ranges is None:
        ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts, cuts = split(df, order[0], keys, ranges)
    edges = [[], []]
    if cuts:
        place = F.struct(*order)
        ends = parts.groupBy(*keys, "_p").agg(*[f(own[c], F.when(own[c].isNotNull(), place)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("_first", F.min_by), ("_last", F.max_by))])
        w = W.partitionBy(*keys).orderBy("_p")  # one row a range
        past, later = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
        carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), *[F.last(f"_last{i}", ignorenulls=True).over(past).alias(f"_from{i}") for i in range(len(columns))], *[F.first(f"_first{i}", ignorenulls=True).over(later).alias(f"_next{i}") for i in range(len(columns))])
        same = reduce(lambda a, i: a & F.col(keys[i]).eqNullSafe(F.col(f"_k{i}")), range(len(keys)), F.col("_p") == F.col("_q"))
        parts = parts.join(carried if keys else F.broadcast(carried), same)
        edges = [[F.col(f"_from{i}") for i in range(len(columns))], [F.col(f"_next{i}") for i in range(len(columns))]]
    w = W.partitionBy(*keys, "_p").orderBy(*order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)

    def fill(i: int, c: str) -> Column:
        last, following = F.last(own[c], ignorenulls=True).over(back), F.first(own[c], ignorenulls=True).over(ahead)
        return F.coalesce(last, *edges[0][i : i + 1], following, *edges[1][i : i + 1])

    return parts.withColumns({c: fill(i, c) for i, c in enumerate(columns)}).select(*names)


def add_null_indicators(df: DataFrame, columns: list[str] | None = None, min_rate: float = 0.0, suffix: str = "_was_null") -> DataFrame:
    own = columns or df.columns
    if min_rate:
        rates = null_rates(df.select(*own))
        own = [c for c in own if (rates[c] or 0) > min_rate]
    return df.withColumns({c + suffix: value(df, c).isNull().cast("int") for c in own}) if own else df


def null_fraction(df: DataFrame, columns: list[str] | None = None) -> Column:
    own = columns or df.columns
    return sum((value(df, c).isNull().cast("int") for c in own), F.lit(0)) / len(own)


def quarantine_rows(df: DataFrame, limit: float = 0.8, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): rows with at least ``limit`` of their columns null are quarantined."""
    bad = null_fraction(df, columns) >= limit
    return df.where(~bad), df.where(bad)


def cap_outliers(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    """Clip to Tukey fences (iqr), mean +- k deviations (zscore) or the 1st and 99th percentile (winsorise); ``flag`` adds
    ``<c>_outlier`` by Tukey fences instead."""
    spec = {"iqr": [0.25, 0.75], "flag": [0.25, 0.75], "winsorise": [0.01, 0.99]}
    if method == "zscore":
        got = agg_row(df, {f"{s}|{c}": f(value(df, c)) for c in columns for s, f in (("m", F.avg), ("s", F.stddev_samp))})
        ends = {c: (got[f"m|{c}"] - k * got[f"s|{c}"], got[f"m|{c}"] + k * got[f"s|{c}"]) for c in columns if got[f"s|{c}"] is not None}
    else:
        got = quantiles(df, {c: (value(df, c), spec[method]) for c in columns})
        ends = {c: q if method == "winsorise" else (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c, q in got.items() if q}
    if method == "flag":
        return df.withColumns({f"{c}_outlier": ((F.col(c) < lo) | (F.col(c) > hi)).cast("int") for c, (lo, hi) in ends.items()})
    return df.withColumns({c: F.greatest(F.least(value(df, c).cast("double"), F.lit(hi)), F.lit(lo)) for c, (lo, hi) in ends.items()})


def schema_relax(df: DataFrame) -> DataFrame:
    """Text columns of which over half can be cast become double, others stay text."""
    own = string_columns(df)
    got = agg_row(df, {c: F.avg(F.when(F.col(c).isNotNull(), F.col(c).try_cast("double").isNotNull().cast("int"))) for c in own}) if own else {}
    out = {c: F.col(c).try_cast("double") for c in own if (got[c] or 0) > 0.5}
    return df.withColumns(out) if out else df


def auto_correct(df: DataFrame, high_null: float = 0.9, skew: float = 2.0) -> DataFrame:
    """Drop null and constant columns, impute the rest, log1p (non-negative) or sqrt-free copy of skewed columns."""
    df = drop_constant_columns(drop_high_null_columns(df, high_null))
    numeric = numeric_columns(df)
    rates = null_rates(df)
    df = impute_simple(df, {c: "median" if c in numeric else "mode" for c in df.columns if rates[c]})
    if not numeric:
        return df
    got = agg_row(df, {f"{k}|{c}": f(value(df, c)) for c in numeric for k, f in (("g", F.skewness), ("lo", F.min))})
    hit = [c for c in numeric if got[f"g|{c}"] is not None and abs(got[f"g|{c}"]) > skew and got[f"lo|{c}"] >= 0]
    return df.withColumns({c: F.log1p(c) for c in hit}) if hit else df


def clean_pipeline(df: DataFrame, null_limit: float = 0.9) -> DataFrame:
    """Strip, unify nulls, de-duplicate, drop empty and constant columns, impute."""
    rows = stash(drop_duplicates(unify_nulls(strip_strings(df))), "distinct")  # shuffled once, read by every step
    df = drop_constant_columns(drop_high_null_columns(rows, null_limit))
    numeric = set(numeric_columns(df))
    return impute_simple(df, {c: "median" if c in numeric else "mode" for c in df.columns if c in numeric or c in string_columns(df)})


def triage_pipeline(df: DataFrame) -> DataFrame:
    return impute_tiered(drop_constant_columns(coerce_types(unify_nulls(df))))


def missing_data_pipeline(df: DataFrame, limit: float = 0.8) -> DataFrame:
    kept, _ = quarantine_rows(replace_sentinels(df), limit)
    return clean_pipeline(add_null_indicators(drop_high_null_columns(kept), min_rate=0.2, suffix="_is_missing"))


def impute_knn(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Nulls become the mean of the ``k`` nearest complete rows; distances go over the standardised columns that a row has.

    Exact: rows are reduced to distinct vectors, which are met by :func:`neighbours.nearest` once a pattern of gaps.  Donors at
    the distance of the k-th share its place.  With fewer than ``k`` complete rows all of them count; with none the columns'
    medians are taken.
    """
    spread = agg_row(df, {c: F.stddev_pop(value(df, c)) for c in columns})
    raw = lambda c: value(df, c).cast("double")
    mask = sum((F.when(raw(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    # a position without a value is 0 on both sides and adds nothing to a distance
    keyed = df.withColumns({"_mask": mask, "_q": F.array(*[F.coalesce(raw(c), F.lit(0.0)) for c in columns])})
    needy = keyed.where("_mask > 0").select(F.col("_mask").alias("mask"), F.col("_q").alias("q")).distinct()
    masks = [r["mask"] for r in needy.select("mask").distinct().collect()]  # patterns of gaps in these columns
    if not masks:
        return df
    whole = keyed.where("_mask = 0").groupBy(*columns, "_q").agg(F.count("*").alias("n"))
    dealt = whole.select(F.explode(F.array(*map(F.lit, masks))).alias("mask"), "_q", "n", F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    seen = F.transform("_q", lambda x, i: F.when(F.call_function("getbit", F.col("mask"), i) == 0, x).otherwise(0.0))
    dealt = dealt.select("mask", seen.alias("x"), "n", "v").groupBy("mask", "x").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i] * F.col("n")).alias(f"s{i}") for i in range(len(columns))])
    near = nearest(needy, dealt.select("mask", "x", "n", F.array(*[f"s{i}" for i in range(len(columns))]).alias("s")), k, [1 / (spread[c] or 1.0) ** 2 for c in columns])
    # the last entry fills up what is left of k
    before = lambda i: F.aggregate(F.slice("near", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    taken = F.transform("near", lambda x, i: F.struct((F.least(x["n"], k - before(i)) / x["n"]).alias("share"), F.least(x["n"], k - before(i)).alias("w"), x["s"].alias("s")))
    total = F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    mean = lambda i: F.aggregate("taken", F.lit(0.0), lambda a, x: a + x["share"] * F.get(x["s"], F.lit(i))) / total
    fills = near.select(F.col("mask").alias("_m"), F.col("q").alias("_v"), taken.alias("taken")).select("_m", "_v", *[mean(i).alias(f"_f{i}") for i in range(len(columns))])
    out = keyed.join(fills, (F.col("_mask") == F.col("_m")) & (F.col("_q") == F.col("_v")), "left")
    out = out.withColumns({c: F.coalesce(raw(c), F.col(f"_f{i}")) for i, c in enumerate(columns)}).select(*df.columns)
    return impute_simple(out, dict.fromkeys(columns, "median")) if whole.isEmpty() else out


def impute_iterative(df: DataFrame, columns: list[str], rounds: int = 10, tol: float = 1e-3) -> DataFrame:
    """Chained equations: each round regresses every column with gaps on the others and refills its gaps, until no filling
    moves by more than ``tol`` of its column's greatest value, for ``rounds`` at most.

    A regression is one aggregate of means and covariances; only those (columns x columns) reach the driver.
    """
    import numpy as np

    first = agg_row(df, {f"{f}|{c}": e(value(df, c)) for c in columns for f, e in (("n", F.count), ("m", F.avg), ("top", lambda v: F.max(F.abs(v))))})
    rows = agg_row(df, {"n": F.count("*")})["n"]
    gaps = [c for c in columns if 0 < first[f"n|{c}"] < rows]
    if not gaps or len(columns) < 2:
        return impute_simple(df, dict.fromkeys(gaps, "mean")) if gaps else df
    own = [c for c in columns if first[f"n|{c}"]]
    out = df.withColumns({f"_g_{c}": value(df, c).isNull() for c in gaps}).withColumns({c: F.coalesce(value(df, c).cast("double"), F.lit(first[f"m|{c}"])) for c in own})
    for turn in range(rounds):
        out = out.withColumns({f"_o_{c}": F.col(c) for c in gaps})
        for c in gaps:
            x = [o for o in own if o != c]
            known = out.where(~F.col(f"_g_{c}"))
            pairs = {f"{a}|{b}": F.covar_pop(a, b) for i, a in enumerate(x) for b in [*x[i:], c]}
            got = agg_row(known, {**pairs, **{f"m|{a}": F.avg(a) for a in [*x, c]}})
            m = np.array([[got.get(f"{a}|{b}", got.get(f"{b}|{a}")) for b in x] for a in x], float)
            beta = np.linalg.pinv(m + 1e-12 * np.diag(np.diag(m))) @ np.array([got[f"{a}|{c}"] for a in x], float)
            fit = sum((float(b) * (F.col(a) - got[f"m|{a}"]) for a, b in zip(x, beta)), F.lit(got[f"m|{c}"]))
            out = out.withColumn(c, F.when(F.col(f"_g_{c}"), fit).otherwise(F.col(c)))
        if turn + 1 < rounds:
            moved = agg_row(out, {c: F.max(F.abs(F.col(c) - F.col(f"_o_{c}"))) for c in gaps})
            if all(moved[c] <= tol * (first[f"top|{c}"] or 1.0) for c in gaps):
                break
    return out.select(*df.columns)
