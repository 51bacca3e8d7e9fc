"""Tables by name, with the warehouse's ways of naming and typing them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import column_name

# Fixed value: what a table's name looks like, perhaps with its owner; names of files with hyphens or blanks don't.
_OBJECT = re.compile(r"^[A-Za-z][A-Za-z0-9_$#]*(\.[A-Za-z][A-Za-z0-9_$#]*)?$")
# Kinds of declared types.
CHARACTER = ("VARCHAR2", "CHAR", "NVARCHAR2", "NCHAR", "STRING", "VARCHAR")
NUMERIC = ("NUMBER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE", "TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "DOUBLE", "DECIMAL")


def parse_dsn(dsn: str) -> dict[str, str]:
    """``user:password@host:port/service``; the password may hold an @."""
    login, at, rest = dsn.rpartition("@")
    user, colon, password = login.partition(":")
    if not at or not colon or not rest:
        raise ValueError("a DSN is user:password@host:port/service")
    return {"user": user, "password": password, "address": rest}


def source_dsn(data_source: str, settings: Mapping[str, str], prefix: str = "PLUMBLINE") -> str:
    """Where a data source is: its own DSN among the settings (such as the environment), else the catalog's."""
    for name in (f"{prefix}_{data_source.upper()}_DSN", f"{prefix}_CATALOG_DSN"):
        if settings.get(name):
            return settings[name]
    raise KeyError(f"neither a DSN for {data_source} nor one for the catalog is set")


def first_catalog(makers: list[Callable[[], Catalog]]) -> Catalog:
    """The first catalog that can be made; the last error if none can."""
    error: Exception = ValueError("no catalog")
    for make in makers:
        try:
            return make()
        except Exception as found:  # noqa: BLE001  the next one is tried
            error = found
    raise error


def read_jdbc(spark: SparkSession, dsn: str, table: str, **options: str) -> DataFrame:
    """A warehouse table over JDBC, where a driver is on the class path. Give partitionColumn and its bounds for a
    table of any size: without them one task reads it."""
    at = parse_dsn(dsn)
    url = options.pop("url", f"jdbc:oracle:thin:@//{at['address']}")
    return spark.read.format("jdbc").options(url=url, dbtable=table, user=at["user"], password=at["password"], **options).load()


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, json or csv (with a header); give a schema where the format has none, to read once."""
    reader = spark.read.options(**({"header": "true"} | options if kind == "csv" else options))
    if schema:
        reader = reader.schema(schema)
    return reader.format(kind).load(path)


def is_object_name(name: str | None) -> bool:
    """A table's name, perhaps with its owner; names of files are none."""
    return bool(name and _OBJECT.match(name.strip()))


def object_name_filter(c: Column) -> Column:
    """The same as an expression over rows."""
    return F.coalesce(F.trim(c).rlike(_OBJECT.pattern), F.lit(False))


def qualified(table: str, schema: str | None) -> str:
    return table if "." in table or not schema else f"{schema}.{table}"


class Catalog:
    """Registered tables; a name is looked up as it is, then without underscores."""

    def __init__(self, tables: Mapping[str, DataFrame], schemas: Mapping[str, str] | None = None):
        self.tables = {k.upper(): v for k, v in tables.items()}
        self.plain = {k.replace("_", ""): v for k, v in self.tables.items()}
        self.schemas = dict(schemas or {})

    @classmethod
    def of_directory(cls, spark: SparkSession, path: str, names: list[str]) -> Catalog:
        return cls({n: spark.read.parquet(f"{path}/{n}.parquet") for n in names})

    def find(self, name: str | None, stage: str | None = None) -> DataFrame | None:
        if not is_object_name(name):
            return None
        full = qualified(name.strip(), self.schemas.get(stage or "")).upper()
        for key in (full, full.split(".")[-1]):
            if key in self.tables:
                return self.tables[key]
            if key.replace("_", "") in self.plain:
                return self.plain[key.replace("_", "")]
        return None

    def types(self, name: str, stage: str | None = None) -> dict[str, str]:
        df = self.find(name, stage)
        return {} if df is None else {f.name.upper(): f.dataType.simpleString().upper() for f in df.schema}


def type_class(declared: str) -> str:
    """TEXT, NUMBER, DATE or LOB, from a declared type in Spark's or the warehouse's words."""
    kind = declared.upper().split("(")[0].strip()
    if kind.startswith(("DATE", "TIMESTAMP")):
        return "DATE"
    if kind in NUMERIC:
        return "NUMBER"
    if kind in CHARACTER or kind == "BOOLEAN":
        return "TEXT"
    return "LOB"


def snapshots(spark: SparkSession, path: str, keys: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables of a folder, read only, each in the order of its key. Sorting is done when, and only as far as, rows are
    fetched: a limit takes the first ones without sorting the whole."""
    return {n: spark.read.parquet(f"{path}/{n}.parquet").orderBy(key) for n, key in keys.items()}


def limited(df: DataFrame, rows: int) -> DataFrame:
    """At most so many rows, any ones; 0 for all."""
    return df.limit(rows) if rows > 0 else df


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(column_name(c) for c in df.columns))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold nothing and those that a spreadsheet left unnamed; one pass."""
    named = [c for c in df.columns if not c.lower().startswith("unnamed")]
    if not named:
        return df.select()
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(named))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(named) if counts[i]))


def with_aliases(df: DataFrame, aliases: Mapping[str, list[str]]) -> DataFrame:
    """Canonical columns, each from the first of its names that is there, else empty; all of them text."""
    df = with_clean_names(df)
    pick = lambda names: next((F.col(n) for n in names if n in df.columns), F.lit(None))
    return df.select(*(pick([name, *names]).cast("string").alias(name) for name, names in aliases.items()))


def first_sheet(sheets: Mapping[str, DataFrame], wanted: list[str]) -> DataFrame | None:
    """The first sheet whose name is wanted, whatever its case."""
    by_name = {k.strip().lower(): v for k, v in sheets.items()}
    return next((by_name[w.lower()] for w in wanted if w.lower() in by_name), None)


def freshness(df: DataFrame, loaded_at: str, as_of: datetime, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """The latest load, its age in hours and PASS, WARN or FAIL; an empty table fails."""
    last = F.max(F.col(loaded_at).cast("timestamp_ntz"))
    age = F.timestamp_diff("SECOND", F.col("last_loaded"), F.lit(as_of).cast("timestamp_ntz")) / F.lit(3600.0)
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "FAIL").when(F.col("age_hours") > warn_hours, "WARN").otherwise("PASS")
    return df.agg(last.alias("last_loaded")).withColumn("age_hours", age).withColumn("status", status)
