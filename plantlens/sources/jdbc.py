"""Relational databases through Spark's JDBC source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.operators.identity import DataError

# Supported systems and their default ports.
SYSTEMS = ("sqlserver", "mysql", "sqlite", "oracle", "postgresql")
PORTS = {"sqlserver": 1433, "mysql": 3306, "oracle": 1521, "postgresql": 5432}
DRIVERS = {"sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "mysql": "com.mysql.cj.jdbc.Driver",
           "sqlite": "org.sqlite.JDBC", "oracle": "oracle.jdbc.OracleDriver", "postgresql": "org.postgresql.Driver"}
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class JdbcConfig:
    """Connection settings; `url` overrides the one built from the parts."""

    system: str = "sqlserver"
    host: str = ""
    port: int | None = None
    database: str = ""
    user: str = ""
    password: str = ""
    file: str = ""
    schema: str = ""
    url: str = ""
    options: dict = field(default_factory=dict)

    def checked(self) -> JdbcConfig:
        if self.url:
            return self
        if self.system not in SYSTEMS:
            raise DataError(f"unsupported database system {self.system!r}")
        needed = {"file": self.file} if self.system == "sqlite" else {
            "host": self.host, "database": self.database, "user": self.user, "password": self.password}
        missing = [k for k, v in needed.items() if not str(v or "").strip()]
        if missing:
            raise DataError(f"missing connection settings: {', '.join(missing)}")
        return self

    def jdbc_url(self) -> str:
        self.checked()
        if self.url:
            return self.url
        port = self.port or PORTS.get(self.system)
        if self.system == "sqlite":
            return f"jdbc:sqlite:{self.file}"
        if self.system == "sqlserver":
            return f"jdbc:sqlserver://{self.host}:{port};databaseName={self.database};trustServerCertificate=true"
        if self.system == "oracle":
            return f"jdbc:oracle:thin:@//{self.host}:{port}/{self.database}"
        return f"jdbc:{self.system}://{self.host}:{port}/{self.database}"

    def default_schema(self) -> str | None:
        if self.schema:
            return self.schema
        return {"sqlserver": "dbo", "postgresql": "public", "oracle": self.user.upper() or None}.get(self.system)


def _reader(spark: SparkSession, cfg: JdbcConfig):
    reader = spark.read.format("jdbc").option("url", cfg.jdbc_url())
    if not cfg.url:
        reader = reader.option("driver", DRIVERS[cfg.system])
    if cfg.user:
        reader = reader.option("user", cfg.user).option("password", cfg.password)
    return reader.options(**{k: str(v) for k, v in cfg.options.items()})


def read_jdbc(spark: SparkSession, cfg: JdbcConfig, query: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 32,
              fetch_size: int = 10_000) -> DataFrame:
    """The result of a query.

    With a partition column and its bounds the query is read as that many slices
    side by side; the bounds place the slices and drop no rows. Without them one
    connection reads everything.
    """
    text = (query or "").strip().rstrip(";")
    if not text:
        raise DataError("the SQL query is empty")
    reader = _reader(spark, cfg).option("fetchsize", fetch_size)
    if partition_column is None:
        return reader.option("query", text).load()
    if lower is None or upper is None:
        raise DataError("a partition column needs its lower and upper bound")
    return (reader.option("dbtable", f"({text}) q").option("partitionColumn", partition_column)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions).load())


def catalog_query(cfg: JdbcConfig) -> str:
    """The query that lists schema and table names."""
    schema = (cfg.default_schema() or "").replace("'", "''")
    if cfg.system == "sqlite":
        return "SELECT '' AS table_schema, name AS table_name FROM sqlite_master WHERE type = 'table'"
    if cfg.system == "oracle":
        return f"SELECT owner AS table_schema, table_name FROM all_tables WHERE owner = '{schema}'"
    where = f"table_schema = '{schema}'" if schema else "table_schema = DATABASE()"
    return ("SELECT table_schema, table_name FROM information_schema.tables "
            f"WHERE table_type = 'BASE TABLE' AND {where}")


def jdbc_tables(spark: SparkSession, cfg: JdbcConfig, query: str | None = None) -> DataFrame:
    """Sorted `schema.table` names; `query` replaces the catalogue query of other systems."""
    rows = _reader(spark, cfg).option("query", query or catalog_query(cfg)).load()
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    named = bool(cfg.url) or cfg.default_schema() is not None
    full = F.concat_ws(".", F.nullif(F.trim("table_schema"), F.lit("")), F.trim("table_name")) if named else F.trim("table_name")
    return rows.select(full.alias("table")).distinct().orderBy("table")


def quoted_table(cfg: JdbcConfig, table: str) -> str:
    """`schema.table` with each part quoted the way the system wants it."""
    parts = [p for p in re.sub(r'[\[\]`"]', "", str(table or "").strip()).split(".") if p]
    if not parts:
        raise DataError("the table name is empty")
    if len(parts) > 2:
        parts = [parts[0], ".".join(parts[1:])]
    left, right = {"sqlserver": ("[", "]"), "mysql": ("`", "`")}.get("" if cfg.url else cfg.system, ('"', '"'))
    return ".".join(f"{left}{p}{right}" for p in parts)


def jdbc_sample(spark: SparkSession, cfg: JdbcConfig, table: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first n rows of a table; the limit is pushed into the database."""
    return _reader(spark, cfg).option("dbtable", quoted_table(cfg, table)).load().limit(max(int(n), 1))
