"""Queries of file sources: each writes rows of the given tables in a format and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.registry import query, read
from tidewell.plans.streams import shared
from tidewell.sources import files as I

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
DDL = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"


def orders(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def scan_parquet(spark, sf):
    return I.scan_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_totalprice > 400000")


@query(ORDERS)
def write_parquet_partitioned(spark, sf):
    path = shared(spark)
    I.write_parquet(orders(spark, sf), path, ["o_orderstatus"])
    return spark.read.schema(DDL).parquet(path)


@query(ORDERS)
def scan_csv(spark, sf):
    path = shared(spark)
    orders(spark, sf).write.option("header", True).option("sep", "|").csv(path)
    return I.scan_csv(spark, path, DDL)[0]


@query(ORDERS)
def scan_tsv(spark, sf):
    path = shared(spark)
    orders(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return I.scan_tsv(spark, path, DDL)


@query("SELECT o_orderkey, o_custkey AS \"who.key\", o_orderstatus AS \"who.status\" FROM orders")
def scan_json(spark, sf):
    path = shared(spark)
    orders(spark, sf).select("o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("who")).write.json(path)
    return I.scan_json(spark, path, "o_orderkey BIGINT, who STRUCT<key: BIGINT, status: STRING>", lines=True)


@query("SELECT o_orderkey, o_custkey FROM orders")
def scan_jsonl(spark, sf):
    path = shared(spark)
    line = F.to_json(F.struct("o_orderkey", "o_custkey"))
    cut = F.when(F.col("o_orderkey") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    read(spark, sf, "orders").select(cut.alias("value")).write.text(path)
    return I.scan_jsonl(spark, path, "o_orderkey BIGINT, o_custkey BIGINT")


@query(ORDERS)
def scan_xml(spark, sf):
    path = shared(spark)
    orders(spark, sf).write.format("xml").option("rowTag", "order").save(path)
    return I.scan_xml(spark, path, "order", DDL)


@query(ORDERS)
def scan_orc(spark, sf):
    path = shared(spark)
    orders(spark, sf).write.orc(path)
    return I.scan_orc(spark, path)


@query("SELECT CASE o_orderkey % 3 WHEN 1 THEN '200' ELSE o_orderstatus END AS level, CASE o_orderkey % 3 WHEN 1 THEN 'GET /' || o_orderkey ELSE 'order ' || o_orderkey END AS message, CASE o_orderkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'common' ELSE 'pairs' END AS form FROM orders")
def scan_log_lines(spark, sf):
    path = shared(spark)
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"level":"'), s, F.lit('","message":"order '), k, F.lit('"}'))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('h - - [t] "GET /'), k, F.lit('" 200 5'))).otherwise(F.concat(F.lit("level="), s, F.lit(" message=order "), k))
    read(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return I.scan_log_lines(spark, path)


def _fixed(spark, sf, **options):
    path = shared(spark)
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.lpad(F.col("o_custkey").cast("string"), 10, " "), "o_orderstatus")
    read(spark, sf, "orders").select(line.alias("value")).write.options(**options).text(path)
    return I.scan_fixed_width(spark, path, [("o_orderkey", 1, 12, "bigint"), ("o_custkey", 13, 10, "bigint"), ("o_orderstatus", 23, 1, "string")])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_fixed_width(spark, sf):
    return _fixed(spark, sf)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_compressed(spark, sf):
    return _fixed(spark, sf, compression="gzip")


@query(r"""WITH u AS (SELECT page_id, unnest(range(len(r))) AS "row", unnest(r) AS r FROM (SELECT page_id, regexp_extract_all(html, '(?is)<ul[^>]*>(.*?)</ul>', 1) AS r FROM pages)),
l AS (SELECT page_id, "row", unnest(range(len(c))) AS cell, unnest(c) AS c FROM (SELECT page_id, "row", regexp_extract_all(r, '(?is)<li[^>]*>(.*?)</li>', 1) AS c FROM u)) SELECT page_id, "row"::INT AS "row", cell::INT AS cell, trim(regexp_replace(c, '<[^>]+>', '', 'g')) AS text FROM l""")
def scan_html_tables(spark, sf):
    return I.html_cells(read(spark, sf, "pages"), row="ul", cell="li")


@query()
def scan_binary_metadata(spark, sf):
    return I.scan_binary_metadata(spark, f"{sf}/orders.parquet").select("length")


@query("SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def incremental_scan(spark, sf):
    from tidewell.operators.metadata import incremental_scan as scan

    return scan(read(spark, sf, "events"), "ts", "2024-01-20 00:00:00")[0].select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def partition_scan(spark, sf):
    return I.partition_scan(read(spark, sf, "events"), "event_type", ["click", "view"]).select("event_id")


@query("SELECT 'orders' AS name, 'ok' AS status, count(*) AS n FROM orders UNION ALL SELECT 'gone', 'failed', NULL")
def batch_ingest(spark, sf):
    jobs = [{"name": "orders", "format": "parquet", "path": f"{sf}/orders.parquet"}, {"name": "gone", "format": "parquet", "path": f"{sf}/no_such_table.parquet"}]
    return I.batch_ingest(spark, jobs, shared(spark)).drop("error")


@query("SELECT * FROM (VALUES ('orders', true), ('customer', true)) t(name, temporary)")
def list_tables(spark, sf):
    for t in ("orders", "customer"):
        read(spark, sf, t).createOrReplaceTempView(t)
    return I.list_tables(spark).where("name IN ('orders', 'customer')")


@query("SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(\"column\", dtype)")
def extract_schema(spark, sf):
    return I.extract_schema(read(spark, sf, "events"))


@query("WITH f AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderkey::VARCHAR), 'urgent') OR contains(lower(o_orderpriority), 'urgent')) SELECT *, (SELECT count(*) FROM f)::INT AS total FROM f ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def preview_table(spark, sf):
    return I.preview_table(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "URGENT", ["o_orderkey"], 20, 20)


@query(ORDERS)
def file_batch_sink(spark, sf):
    path = shared(spark)
    I.file_batch_sink(orders(spark, sf), path, "json")
    return spark.read.schema(DDL).json(path)
