"""File sources and sinks.  Every scan is a Spark reader, so projections and filters reach the files where the format allows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: list[str] = (), compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Rows of a partition value are gathered first, so that each task writes few files; AQE splits large values."""
    writer = (df.hint("rebalance", *[F.col(c) for c in by]) if by else df).write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def guess_delimiter(spark: SparkSession, path: str) -> str:
    """The separator with most fields, and the same number of them, in the first 20 lines."""
    lines = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    counts = {d: [x.count(d) for x in lines] for d in (",", "\t", "|", ";")}
    good = {d: c[0] for d, c in counts.items() if c and min(c) == max(c) and c[0]}
    return max(good, key=good.get) if good else ","


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None, header: bool = True, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines as ``value``): malformed lines are set apart, rows of nulls dropped.

    With a schema and UTF-8, each line is one record.  Otherwise Spark's CSV reader is used, and nothing is set apart.
    """
    sep = sep or guess_delimiter(spark, path)
    lines = spark.read.text(path)
    if not schema or encoding.upper() not in ("UTF-8", "UTF8"):
        reader = spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
        return (reader.schema(schema) if schema else reader).csv(path).dropna("all"), lines.where("false")
    head = lines.first() if header else None
    lines = lines.where(F.col("value") != head["value"]) if head else lines
    parsed = F.from_csv("value", f"{schema}, _bad STRING", {"sep": sep, "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    both = lines.select("value", parsed.alias("r"))
    return both.where("r._bad IS NULL").select("r.*").drop("_bad").dropna("all"), both.where("r._bad IS NOT NULL").select("value")


def scan_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return scan_csv(spark, path, schema, sep="\t")[0]


def scan_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Array or object documents (or one a line), nested ones flattened."""
    from tidewell.operators.cleaning import flatten_struct

    reader = spark.read.option("multiLine", not lines)
    return flatten_struct((reader.schema(schema) if schema else reader).json(path))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line JSON; a cut-off line is tried again with closing brackets added."""
    line = F.col("value")
    tries = [F.from_json(F.concat(line, F.lit(s)), f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}) for s in ("", "}", "\"}", "]}", "}}")]
    parsed = F.coalesce(*[F.when(t["_bad"].isNull(), t) for t in tries])
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("j")).where("j IS NOT NULL").select("j.*").drop("_bad")


def scan_xml(spark: SparkSession, path: str, row: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema else reader).load(path)


def scan_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def scan_avro(spark: SparkSession, path: str) -> DataFrame:
    """Needs the spark-avro package on the cluster."""
    return spark.read.format("avro").load(path)


def scan_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """level, message, form of lines that are JSON, key=value pairs or ``host - - [time] "request" status size``."""
    v = F.col("value")
    pairs = F.str_to_map(F.regexp_replace(v, r"\s*(\w+)=", "\u0001$1="), F.lit("\u0001"), F.lit("="))
    common = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)'
    is_json, is_common, is_pairs = v.startswith("{"), v.rlike(common), v.rlike(r"^\w+=")
    level = F.when(is_json, F.get_json_object(v, "$.level")).when(is_common, F.regexp_extract(v, common, 4)).when(is_pairs, F.trim(pairs["level"]))
    message = F.when(is_json, F.get_json_object(v, "$.message")).when(is_common, F.regexp_extract(v, common, 3)).when(is_pairs, F.trim(pairs["message"])).otherwise(v)
    return spark.read.text(path).select(level.alias("level"), message.alias("message"), F.when(is_json, "json").when(is_common, "common").when(is_pairs, "pairs").otherwise("text").alias("form"))


def scan_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """(name, start from 1, length, type) fields; gzip files are read as they are."""
    return spark.read.text(path).select(*[F.trim(F.substring("value", s, n)).try_cast(k).alias(c) for c, s, n, k in fields])


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html", row: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """key, row, cell, text: the cells of all tables in each page (tags within cells removed).

    ``row`` and ``cell`` are tag patterns: ul and li take lists apart instead.
    """
    rows = pages.select(key, F.posexplode(F.expr(f"regexp_extract_all({html}, '(?is)<{row}[^>]*>(.*?)</{row}>', 1)")).alias("row", "r"))
    cells = rows.select(key, "row", F.posexplode(F.expr(f"regexp_extract_all(r, '(?is)<{cell}[^>]*>(.*?)</{cell}>', 1)")).alias("cell", "c"))
    return cells.select(key, "row", "cell", F.trim(F.regexp_replace("c", r"<[^>]+>", "")).alias("text"))


def scan_binary_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).drop("content")


def file_batch_sink(df: DataFrame, path: str, fmt: str = "csv") -> None:
    df.write.mode("errorifexists").option("header", True).format(fmt).save(path)


def partition_scan(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.isTemporary) for t in spark.catalog.listTables()], "name string, temporary boolean")


def extract_schema(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def preview_table(df: DataFrame, search: str | None, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of the rows of which any column contains ``search``, with the number of all such rows."""
    from tidewell.functions.columns import any_of

    if search:
        df = df.where(any_of([F.contains(F.lower(F.col(c).cast("string")), F.lit(search.lower())) for c in df.columns]))
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total))


def batch_ingest(spark: SparkSession, jobs: list[dict], target: str) -> DataFrame:
    """name, status, n, error: each job {name, format, path, options} is written to ``target``; a failing one stops no other."""
    out = []
    for job in jobs:
        try:
            path = f"{target}/{re.sub(r'[^A-Za-z0-9_]', '_', job['name'])}"
            spark.read.format(job["format"]).options(**job.get("options", {})).load(job["path"]).write.mode(job.get("mode", "overwrite")).parquet(path)
            out.append((job["name"], "ok", spark.read.parquet(path).count(), None))
        except Exception as e:
            out.append((job["name"], "failed", None, str(e)[:200]))
    return spark.createDataFrame(out, "name string, status string, n long, error string")
