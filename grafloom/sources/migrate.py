"""Readers of other systems.  Rows come back as a DataFrame; Spark decides how they are partitioned."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import register


def settings(config: dict[str, Any] | None, config_path: str = "") -> dict[str, Any]:
    """config, over what a JSON file has."""
    base = {}
    if config_path:
        with open(config_path, encoding="utf-8") as f:
            base = json.load(f)
    return base | (config or {})


def is_table(text: str) -> bool:
    return len(text.split()) == 1


def bound(sql: str, params: dict[str, Any] | list[Any] | None) -> str:
    """sql with named (%(a)s, :a) or positional (?, %s) parameters as literals."""

    def literal(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    if isinstance(params, dict):
        return re.sub(r"%\((\w+)\)s|(?<!:):(\w+)", lambda m: literal(params[m[1] or m[2]]) if (m[1] or m[2]) in params else m[0], sql)
    if params:
        left = iter(params)
        return re.sub(r"\?|%s", lambda m: literal(next(left)), sql)
    return sql


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times and dates as ISO text, bytes as text (base64 where that isn't UTF-8)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType | T.DayTimeIntervalType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.coalesce(F.try_validate_utf8(c.cast("string")), F.base64(c))
        out.append(c.alias(f.name))
    return df.select(*out)


def _jdbc(spark: SparkSession, url: str, table_or_sql: str, config: dict[str, Any], params: Any, driver: str) -> DataFrame:
    """partitionColumn, lowerBound, upperBound and numPartitions of config split the read."""
    sql = f"SELECT * FROM {table_or_sql}" if is_table(table_or_sql) else bound(table_or_sql, params)
    options = {"url": url, "driver": driver, "fetchsize": str(config.get("fetchsize", 1000)), "user": config.get("user", config.get("username", "")), "password": config.get("password", "")}
    split = {k: str(config[k]) for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if k in config}
    options |= split | ({"dbtable": f"({sql}) AS q"} if split else {"query": sql})
    return plain(spark.read.format("jdbc").options(**options).load())


def _where(c: dict[str, Any], port: int) -> str:
    return f"{c.get('host', c.get('server', 'localhost'))}:{c.get('port', port)}"


@register("migrate.mysql", kind="batch")
def mysql(spark: SparkSession, table_or_sql: str, config: dict, config_path: str = "", params: Any = None) -> DataFrame:
    c = settings(config, config_path)
    return _jdbc(spark, f"jdbc:mysql://{_where(c, 3306)}/{c.get('database', '')}", table_or_sql, c, params, "com.mysql.cj.jdbc.Driver")


@register("migrate.sql_server", kind="batch")
def sql_server(spark: SparkSession, table_or_sql: str, config: dict, config_path: str = "", params: Any = None) -> DataFrame:
    c = settings(config, config_path)
    return _jdbc(spark, f"jdbc:sqlserver://{_where(c, 1433)};databaseName={c.get('database', '')}", table_or_sql, c, params, "com.microsoft.sqlserver.jdbc.SQLServerDriver")


@register("migrate.oracle_db", kind="batch")
def oracle_db(spark: SparkSession, table_or_sql: str, config: dict, config_path: str = "", params: Any = None) -> DataFrame:
    c = settings(config, config_path)
    return _jdbc(spark, f"jdbc:oracle:thin:@//{_where(c, 1521)}/{c.get('service_name', c.get('database', ''))}", table_or_sql, c, params, "oracle.jdbc.OracleDriver")


@register("migrate.postgresql", kind="batch")
def postgresql(spark: SparkSession, table_or_sql: str, config: dict, config_path: str = "", params: Any = None) -> DataFrame:
    c = settings(config, config_path)
    return _jdbc(spark, f"jdbc:postgresql://{_where(c, 5432)}/{c.get('database', c.get('dbname', ''))}", table_or_sql, c, params, "org.postgresql.Driver")


@register("migrate.s3", kind="batch")
def s3(spark: SparkSession, file_path: str, config: dict | None = None, config_path: str = "") -> DataFrame:
    """CSV with a header, all strings; s3:// is read through s3a, other paths as they are."""
    c = settings(config, config_path)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, name in (("aws_access_key_id", "access.key"), ("aws_secret_access_key", "secret.key"), ("aws_session_token", "session.token"), ("endpoint_url", "endpoint")):
        if c.get(key):
            hadoop.set(f"fs.s3a.{name}", str(c[key]))
    return spark.read.csv(re.sub("^s3://", "s3a://", file_path), header=True, inferSchema=False)


def graph_query(label_or_rel_or_query: str) -> str:
    """(:L) and [:T] are short for all such nodes or relationships."""
    text = label_or_rel_or_query.strip()
    if m := re.fullmatch(r"\(\s*:\s*([\w`]+)\s*\)", text):
        return f"MATCH (n:{m[1]}) RETURN labels(n) AS labels, properties(n) AS properties"
    if m := re.fullmatch(r"\[\s*:\s*([\w`]+)\s*\]", text):
        return f"MATCH (n)-[r:{m[1]}]->(m) RETURN labels(n) AS from_labels, properties(n) AS from_properties, type(r) AS edge_type, properties(r) AS edge_properties, labels(m) AS to_labels, properties(m) AS to_properties"
    return text


def _rows(spark: SparkSession, rows: Iterator[dict], chunk: int = 10_000) -> DataFrame:
    """Rows of a service that one client reads, as a variant column row; chunk by chunk to the shared folder."""
    from ..plans.lineage import shared_dir

    path, some, n = f"{shared_dir(spark)}/rows-{id(rows)}", [], 0
    schema = "text string"

    def flush() -> None:
        spark.createDataFrame([(json.dumps(r, default=str),) for r in some], schema).write.mode("append").parquet(path)

    for r in rows:
        some.append(r)
        if len(some) >= chunk:
            flush()
            some, n = [], n + chunk
    if some or not n:
        flush()
    return spark.read.schema(schema).parquet(path).select(F.parse_json("text").alias("row"))


def _bolt(spark: SparkSession, query: str, config: dict, config_path: str, params: Any, port: int) -> DataFrame:
    try:
        from neo4j import GraphDatabase
    except ImportError as e:
        raise RuntimeError("reading over Bolt needs a driver package, which isn't installed") from e
    c = settings(config, config_path)

    def read() -> Iterator[dict]:
        with GraphDatabase.driver(c.get("uri", f"bolt://{_where(c, port)}"), auth=(c.get("username", ""), c.get("password", ""))) as d, d.session() as s:
            for r in s.run(graph_query(query), params or {}):
                yield r.data()

    return _rows(spark, read())


@register("migrate.neo4j", kind="batch")
def neo4j_(spark: SparkSession, label_or_rel_or_query: str, config: dict, config_path: str = "", params: Any = None) -> DataFrame:
    return _bolt(spark, label_or_rel_or_query, config, config_path, params, 7687)


@register("migrate.bolt", kind="batch")
def bolt(spark: SparkSession, label_or_rel_or_query: str, config: dict, config_path: str = "", params: Any = None) -> DataFrame:
    return _bolt(spark, label_or_rel_or_query, config, config_path, params, 7687)


@register("migrate.arrow_flight", kind="batch")
def arrow_flight(spark: SparkSession, query: str, config: dict, config_path: str = "") -> DataFrame:
    """Every endpoint of the flight is a task."""
    try:
        from pyarrow import flight
    except ImportError as e:
        raise RuntimeError("this build of pyarrow has no Flight") from e
    c = settings(config, config_path)
    uri = f"grpc://{_where(c, 32010)}"
    client = flight.FlightClient(uri)
    options = flight.FlightCallOptions(headers=[client.authenticate_basic_token(c["username"], c["password"])] if c.get("username") else [])
    info = client.get_flight_info(flight.FlightDescriptor.for_command(query.encode()), options)
    schema = T.StructType.fromJson(json.loads(spark.createDataFrame(info.schema.empty_table()).schema.json()))
    tickets = spark.createDataFrame([(e.ticket.ticket,) for e in info.endpoints], "ticket binary").repartition(max(1, len(info.endpoints)))

    def run(batches):
        for b in batches:
            for t in b.column("ticket").to_pylist():
                yield from flight.FlightClient(uri).do_get(flight.Ticket(t), options).to_table().to_batches()

    return plain(tickets.mapInArrow(run, schema))


@register("migrate.duckdb", kind="batch")
def duckdb_(spark: SparkSession, query: str, setup_queries: list[str] | None = None) -> DataFrame:
    """A query of an in-memory database after its setup queries."""
    import duckdb

    db = duckdb.connect()
    for q in setup_queries or []:
        db.execute(q)
    return plain(spark.createDataFrame(db.sql(query).to_arrow_table()))


@register("migrate.servicenow", kind="batch")
def servicenow(spark: SparkSession, endpoint: str, config: dict, config_path: str = "", params: dict | None = None) -> DataFrame:
    """(row: variant) of a REST table's result; an empty one raises."""
    import base64
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    c = settings(config, config_path)
    url = endpoint + ("?" + urlencode(params) if params else "")
    auth = base64.b64encode(f"{c.get('username', '')}:{c.get('password', '')}".encode()).decode()
    with urlopen(Request(url, headers={"Accept": "application/json", "Authorization": f"Basic {auth}"})) as r:
        found = json.load(r).get("result", [])
    if not found:
        raise ValueError("the endpoint has no result")
    return _rows(spark, iter(found if isinstance(found, list) else [found]))
