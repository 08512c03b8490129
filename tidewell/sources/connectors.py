"""Databases and services: one options builder each over Spark's connectors, and a paginated REST source.

The vendors' packages are not part of this repository; the builders are plain functions, tested on their own.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# JDBC URLs and drivers.
JDBC = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "mariadb": ("jdbc:mariadb://{host}:{port}/{database}", "org.mariadb.jdbc.Driver", 3306),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", 0),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}/{database}", "oracle.jdbc.OracleDriver", 1521),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", "com.clickhouse.jdbc.ClickHouseDriver", 8123),
}


def jdbc_options(kind: str, database: str, table: str | None = None, query: str | None = None, host: str = "localhost", port: int | None = None, user: str | None = None, password: str | None = None, fetch: int = 50_000, split: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """``split``: (column, lower, upper, partitions) for a parallel read of a table."""
    url, driver, default = JDBC[kind]
    out = {"url": url.format(host=host, port=port or default, database=database), "driver": driver, "fetchsize": str(fetch)}
    if bool(table) == bool(query):
        raise ValueError("give a table or a query")
    out |= {"dbtable": table} if table else {"query": query}
    out |= {k: v for k, v in (("user", user), ("password", password)) if v}
    if split:
        if query:
            raise ValueError("only a table can be split")
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split)))
    return out


def scan_jdbc(spark: SparkSession, kind: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, **options)).load()


# Spark formats and the option names of the place read.
STORES = {
    "mongo": ("mongodb", {"uri": "connection.uri", "database": "database", "table": "collection"}),
    "elasticsearch": ("org.elasticsearch.spark.sql", {"uri": "es.nodes", "table": "es.resource", "filter": "es.query"}),
    "cassandra": ("org.apache.spark.sql.cassandra", {"uri": "spark.cassandra.connection.host", "database": "keyspace", "table": "table"}),
    "dynamodb": ("dynamodb", {"table": "tableName", "uri": "region"}),
    "bigquery": ("bigquery", {"table": "table", "filter": "filter", "database": "parentProject"}),
    "redis": ("org.apache.spark.sql.redis", {"uri": "host", "table": "table"}),
    "neo4j": ("org.neo4j.spark.DataSource", {"uri": "url", "filter": "query", "table": "labels"}),
    "couchdb": ("org.apache.bahir.cloudant", {"uri": "cloudant.host", "database": "database"}),
}


def store_options(store: str, **places: str) -> tuple[str, dict[str, str]]:
    """(format, options) of a document store, from uri, database, table and filter."""
    fmt, names = STORES[store]
    unknown = set(places) - set(names)
    if unknown:
        raise ValueError(f"{store} takes no {', '.join(sorted(unknown))}")
    return fmt, {names[k]: v for k, v in places.items()}


def connector_read(spark: SparkSession, store: str, **places: str) -> DataFrame:
    """A collection, table or index with nested documents flattened."""
    from tidewell.operators.cleaning import flatten_struct

    fmt, options = store_options(store, **places)
    return flatten_struct(spark.read.format(fmt).options(**options).load())


class Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


def record_path(body, path: str) -> list:
    """The records at a dotted path of a decoded body."""
    for part in filter(None, path.split(".")):
        body = body[int(part)] if isinstance(body, list) else body.get(part, [])
    return body if isinstance(body, list) else [body]


def next_link(header: str | None) -> str | None:
    """The rel="next" URL of a Link header."""
    for part in (header or "").split(","):
        url, _, rest = part.partition(";")
        if 'rel="next"' in rest.replace(" ", ""):
            return url.strip().strip("<>")
    return None


class RestReader(DataSourceReader):
    """Pages of a REST service as JSON text, one record a row.

    Modes page and offset are read in parallel, one partition a page; link and cursor follow the service from page to page
    in a single partition, since each page names the next.
    """

    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[Page]:
        mode, url, n = self.o.get("mode", "page"), self.o["url"], int(self.o.get("pages", "1"))
        mark = "&" if "?" in url else "?"
        if mode == "page":
            first = int(self.o.get("first", "1"))
            return [Page(f"{url}{mark}page={first + i}") for i in range(n)]
        if mode == "offset":
            size = int(self.o.get("size", "100"))
            return [Page(f"{url}{mark}offset={i * size}&limit={size}") for i in range(n)]
        return [Page(url)]

    def read(self, page: Page) -> Iterator[tuple[str]]:
        url, left = page.url, int(self.o.get("pages", "1000000"))
        while url and left:
            with urllib.request.urlopen(url, timeout=float(self.o.get("timeout", "30"))) as answer:
                link, body = answer.headers.get("Link"), json.load(answer)
            for record in record_path(body, self.o.get("records", "")):
                yield (json.dumps(record),)
            mode, left, url = self.o.get("mode", "page"), left - 1, None
            if mode == "link":
                url = next_link(link)
            elif mode == "cursor" and isinstance(body, dict) and body.get(self.o.get("cursor", "next")):
                url = f"{page.url}{'&' if '?' in page.url else '?'}cursor={body[self.o.get('cursor', 'next')]}"


class RestSource(DataSource):
    """``spark.dataSource.register(RestSource)``, then ``spark.read.format("tidewell_rest").options(url=..., ...)``."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_rest"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)


def scan_rest_api(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    from pyspark.sql import functions as F

    spark.dataSource.register(RestSource)
    return spark.read.format("tidewell_rest").options(**options).load().select(F.from_json("record", schema).alias("r")).select("r.*")


class PollReader(DataSourceStreamReader):
    """Polls device gateways: one partition a device, offsets count polls."""

    def __init__(self, options: dict[str, str]):
        self.o = options

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        self.polls = getattr(self, "polls", 0) + 1
        return {"poll": min(self.polls, int(self.o.get("polls", "1000000000")))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(u.strip()) for u in self.o["urls"].split(",")] if end["poll"] > start["poll"] else []

    def read(self, page: Page) -> Iterator[tuple[str, str]]:
        with urllib.request.urlopen(page.url, timeout=float(self.o.get("timeout", "30"))) as answer:
            for record in record_path(json.load(answer), self.o.get("records", "")):
                yield page.url, json.dumps(record)

    def commit(self, end: dict) -> None:
        """Polls can't be asked for again, so there is nothing to release."""


class PollSource(DataSource):
    """``spark.dataSource.register(PollSource)``, then ``spark.readStream.format("tidewell_poll").option("urls", "a,b")``."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_poll"

    def schema(self) -> str:
        return "device string, record string"

    def streamReader(self, schema) -> PollReader:
        return PollReader(self.options)
