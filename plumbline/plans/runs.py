"""Whole runs: profile and variance of a data source, and a suite with its report."""

from __future__ import annotations

import html
from collections import defaultdict
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.masks import assembled, usable
from plumbline.operators import profile as pf
from plumbline.operators import variance as va
from plumbline.operators.checks import Check, failing_rows, run, summary
from plumbline.sources import sinks
from plumbline.sources.tables import Catalog, is_object_name, limited

ANALYSES = ("DTYPE", "STAGE", "BOTH")
MEASURED = "stage string, table_name string, column_name string, metric string, value_num double, value_str string"


def _columns(chains: DataFrame) -> dict[tuple[str, str], set[str]]:
    """{(stage, table): lineage columns}; as many as the mapping has, which is metadata."""
    out: dict[tuple[str, str], set[str]] = defaultdict(set)
    for r in va.by_stage(chains).select("stage", "table_name", "column_name").distinct().collect():
        if is_object_name(r["table_name"]) and r["column_name"]:
            out[r["stage"], r["table_name"]].add(r["column_name"].upper())
    return dict(sorted(out.items()))


def _batches(columns: list[str]) -> list[list[str]]:
    return [columns[at : at + pf.BATCH] for at in range(0, len(columns), pf.BATCH)]


def run_profile(
    spark: SparkSession, catalog: Catalog, lineage: DataFrame, dictionary: DataFrame, data_source: str, out: str, run_id: str, at: datetime, table: str | None = None, analysis: str = "BOTH", sample_rows: int = 0, type_drift: bool = False
) -> DataFrame | None:
    """Profiles every physical column of every table that the mapping names, measures the mapped ones at each stage, and
    says where they first differ. Writes dtype_profile, profile, summary and run events below ``out``; returns the
    summary, or None if only types were asked for.

    dictionary: column_name, date_format, is_pii. A table that isn't there, and a batch of up to BATCH columns that fails,
    is noted in the run's events and left out; the others go on. sample_rows limits what types are judged by, never the metrics."""
    if analysis not in ANALYSES:
        raise ValueError(f"analysis is one of {ANALYSES}")
    note = lambda status, **k: sinks.record_run(spark, f"{out}/runs", run_id, status, at, data_source=data_source, run_type=analysis, **k)
    note("RUNNING", step="START")
    try:
        chains = va.load_chains(lineage, data_source, table)
        masks = assembled([r[0] for r in dictionary.select("date_format").filter("date_format is not null").distinct().orderBy("date_format").collect()])
        masks = usable(spark, masks)
        measured: list[tuple] = []
        scanned = profiled = 0
        ran: list[DataFrame] = []
        for (stage, name), columns in _columns(chains).items():
            df = catalog.find(name, stage)
            if df is None:
                note("RUNNING", step=f"{stage}.{name}", error="no such table")
                continue
            kinds: dict[str, str] = {}
            if analysis != "STAGE":
                seen = limited(df, sample_rows)
                ran.append(seen)
                rows = 0
                for some in _batches(df.columns):
                    try:
                        found = pf.profile_table(seen.select(*map(pf.quoted, some)), masks, stage, name, dictionary, type_drift)
                        judged = found.select("column_name", "inferred_type", "total_rows").collect()  # a row per column
                        sinks.append_results(found.withColumn("data_source", F.lit(data_source)), f"{out}/dtype_profile", run_id)
                        kinds |= {r["column_name"]: r["inferred_type"] for r in judged}
                        profiled, rows = profiled + len(judged), max(rows, *(r["total_rows"] for r in judged))
                    except Exception as error:  # noqa: BLE001  a batch that fails is an event of the run
                        note("RUNNING", step=f"{stage}.{name}: {some[0]} to {some[-1]}", error=str(error))
                scanned += rows
            if analysis != "DTYPE":
                mapped = {f.name: pf.metric_class(f.dataType.simpleString(), kinds.get(f.name)) for f in df.schema if f.name.upper() in columns}
                for some in _batches(list(mapped)):
                    try:
                        part = pf.stage_metrics(df, {c: mapped[c] for c in some})
                        ran.append(part)
                        measured += [(stage, name, *r) for r in part.select("column_name", "metric", "value_num", "value_str").collect()]  # some rows per column
                    except Exception as error:  # noqa: BLE001
                        note("RUNNING", step=f"{stage}.{name}: {some[0]} to {some[-1]}", error=str(error))
            note("RUNNING", step=f"{stage}.{name}")
        result = None
        if measured:
            long, m = va.by_stage(chains).alias("c"), spark.createDataFrame(measured, MEASURED).alias("m")
            same = (F.col("c.stage") == F.col("m.stage")) & (F.col("c.table_name") == F.col("m.table_name")) & (F.upper("c.column_name") == F.upper("m.column_name"))
            rows = long.join(m, same).select("lineage_id", "c.stage", "c.table_name", "c.column_name", "metric", "value_num", "value_str")
            sinks.append_results(rows.withColumn("data_source", F.lit(data_source)), f"{out}/profile", run_id)
            profile = spark.read.parquet(f"{out}/profile").filter(F.col("run_id") == run_id)
            made = va.summarize(chains, profile, run_id, data_source).drop("run_id")
            ran.append(made)
            sinks.append_results(made, f"{out}/summary", run_id)
            result = spark.read.parquet(f"{out}/summary").filter(F.col("run_id") == run_id)
        note("COMPLETE", step="END", rows_scanned=scanned, cols_profiled=profiled, sql_hash=sinks.plan_digest(ran))
        return result
    except Exception as error:
        note("FAILED", step="END", error=str(error))
        raise


def run_suite(df: DataFrame, checks: list[Check], table: str, folder: str, at: datetime) -> tuple[DataFrame, list[Path], int]:
    """Results of a suite, its report's files, and the exit code."""
    results = run(df, checks, table).cache()
    bad = {r["check_name"] for r in results.filter("status in ('FAIL', 'WARN')").collect()}
    failing = {c.name: failing_rows(df, c) for c in checks if c.name in bad}
    page = sinks.report(results, failing, {"summary": summary(results)}, table, at)
    return results, sinks.save_report(page, folder, at), sinks.exit_code(results)


def run_checkpoint(suites: list[tuple[str, DataFrame, list[Check]]], name: str, folder: str, at: datetime) -> tuple[DataFrame, Path, int]:
    """Runs several suites and keeps what they found: a report per suite, the results as records, and a page that leads
    to them. Returns all results, the page, and the exit code."""
    parts, lines = [], []
    for title, df, checks in suites:
        results, pages, code = run_suite(df, checks, title, f"{folder}/{title}", at)
        parts.append(results)
        lines.append(f"<li><a href='{html.escape(title)}/{pages[0].name}'>{html.escape(title)}</a>: {'failed' if code else 'passed'}</li>")
    every = reduce(DataFrame.unionByName, parts)
    sinks.export_file(every.withColumn("checkpoint", F.lit(name)).withColumn("at", F.lit(f"{at:%Y-%m-%d %H:%M:%S}")), f"{folder}/validations.json")
    index = Path(folder, "index.html")
    index.write_text(f"<!DOCTYPE html><html><body><h1>{html.escape(name)}</h1><p>{at:%Y-%m-%d %H:%M:%S}</p><ul>{''.join(lines)}</ul></body></html>", encoding="utf-8")
    return every, index, sinks.exit_code(every)
