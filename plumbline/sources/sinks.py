"""Where results go: tables, run status, exports, reports."""

from __future__ import annotations

import csv
import hashlib
import html
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.xlsx import write_xlsx

# Rows and characters that a report shows.
FAILING_ROWS, DATASET_ROWS, FAILING_CELL, DATASET_CELL = 200, 500, 80, 60
ERROR_TEXT = 1900
RUN_EVENTS = "run_id string, data_source string, run_type string, step string, status string, at timestamp, rows_scanned long, cols_profiled long, sql_hash string, error_text string"


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's results, in a folder of its own."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def record_run(spark: SparkSession, path: str, run_id: str, status: str, at: datetime, step: str = "", data_source: str = "", run_type: str = "", rows_scanned: int | None = None, cols_profiled: int | None = None, sql_hash: str | None = None, error: str | None = None) -> None:
    """Appends a run's event; a status is never overwritten."""
    row = (run_id, data_source, run_type, step, status, at, rows_scanned, cols_profiled, sql_hash, error[:ERROR_TEXT] if error else None)
    spark.createDataFrame([row], RUN_EVENTS).write.mode("append").parquet(path)


def plan_digest(frames: list[DataFrame]) -> str:
    """16 hex digits of what was run: the analysed plans as texts, without the numbers that differ from run to run."""
    texts = (re.sub(r"#\d+L?|plan_id=\d+|\[id=.*?\]", "", df._jdf.queryExecution().analyzed().toString()) for df in frames)
    return hashlib.sha256("\n".join(texts).encode()).hexdigest()[:16]


def latest_status(events: DataFrame) -> DataFrame:
    """A row per run: its last event."""
    last = Window.partitionBy("run_id").orderBy(F.desc("at"), F.desc("step"), F.desc("status"))
    return events.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def audit(entries: DataFrame) -> DataFrame:
    """action, n_entries, first_at, last_at of an audit log of (at, action, details)."""
    return entries.groupBy("action").agg(F.count(F.lit(1)).alias("n_entries"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _flat(df: DataFrame) -> DataFrame:
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({n: F.to_json(n) for n in nested})


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """csv with a header, json lines or parquet. Nested columns become JSON in csv."""
    if kind == "csv":
        _flat(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def export_file(df: DataFrame, path: str, kind: str = "records") -> None:
    """One file for people, row by row through the driver: records (one JSON array), csv (UTF-8 with its mark, as
    spreadsheets want it) or xlsx. For logs, mappings and entities; tables of any size go through export()."""
    if kind == "xlsx":
        write_xlsx({Path(path).stem: _flat(df)}, path)
    elif kind == "csv":
        with open(path, "w", encoding="utf-8-sig", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(df.columns)
            writer.writerows(_flat(df).toLocalIterator())
    else:
        with open(path, "w", encoding="utf-8") as out:
            for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()):
                out.write(("[" if i == 0 else ",\n") + r[0])
            out.write("]" if df.columns and out.tell() else "[]")


def _table(columns: list[str], rows: list, width: int) -> str:
    cell = lambda v: html.escape("" if v is None else str(v)[:width])
    head = "".join(f"<th>{cell(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def report(results: DataFrame, failing: dict[str, DataFrame], datasets: dict[str, DataFrame], title: str, at: datetime) -> str:
    """An HTML page: totals, a line per check, at most FAILING_ROWS rows of each that fails, and DATASET_ROWS of each
    dataset. What is fetched is bounded by these limits."""
    rows = results.orderBy("table_name", "category", "check_name").collect()  # a row per check
    total, passed = len(rows), sum(r["status"] == "PASS" for r in rows)
    share = int(1000.0 * passed / max(total, 1) + 0.5) / 10
    parts = [f"<h1>{html.escape(title)}</h1><p>{at:%Y-%m-%d %H:%M:%S}: {passed} of {total} checks passed ({share} %)</p>"]
    parts.append(_table(results.columns, rows, FAILING_CELL))
    for name, df in failing.items():
        try:
            shown = _table(df.columns, df.limit(FAILING_ROWS).collect(), FAILING_CELL)
        except Exception as error:  # noqa: BLE001  rows that can't be shown don't spoil the report
            shown = f"<p>{html.escape(str(error)[:DATASET_CELL])}</p>"
        parts.append(f"<h2>{html.escape(name)}</h2>" + shown)
    for name, df in datasets.items():
        parts.append(f"<h2>{html.escape(name)}</h2>" + _table(df.columns, df.limit(DATASET_ROWS).collect(), DATASET_CELL))
    return "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>" + "".join(parts) + "</body></html>"


def save_report(page: str, folder: str, at: datetime) -> list[Path]:
    """Writes the page twice, by its time and as the latest."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = [Path(folder, f"report_{at:%Y%m%d_%H%M%S}.html"), Path(folder, "report_latest.html")]
    for p in out:
        p.write_text(page, encoding="utf-8")
    return out


def exit_code(results: DataFrame) -> int:
    """1 if any check failed or couldn't be run."""
    return int(not results.filter(F.col("status").isin("FAIL", "ERROR")).isEmpty())
