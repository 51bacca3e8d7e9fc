"""How queries are registered, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str, types: str) -> str:
    """Inline rows as SQL, typed like the DataFrame made of the same rows."""
    names, kinds = columns.split(), types.split()
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds))
    return f"(SELECT {casts} FROM (VALUES {body}) v({', '.join(names)}))"


def frame(spark: SparkSession, rows: list[tuple], columns: str, types: str) -> DataFrame:
    kinds = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[k]}" for n, k in zip(columns.split(), types.split())))
