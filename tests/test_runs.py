import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main, parsed
from plumbline.operators import checks as ck
from plumbline.plans.runs import run_profile, run_suite
from plumbline.sources.sinks import latest_status
from plumbline.sources.tables import Catalog

LINEAGE = "lineage_id int, functional_group string, src_source_table string, src_source_column string, stg1_source_table string, stg1_source_column string, stg2_source_table string, stg2_source_column string, dwh_target_table string, dwh_target_column string, lineage_status string, data_source string"
AT = datetime(2024, 1, 1)


@pytest.fixture
def parts(spark):
    src = spark.range(100).select(F.col("id").cast("string").alias("CODE"), (F.col("id") * 2).alias("AMOUNT"))
    catalog = Catalog({"SRC_T": src, "STG_T": src, "ALL_T": src.filter("AMOUNT >= 20"), "MART": src.filter("AMOUNT >= 20")})
    row = lambda i, c: (i, "g", "SRC_T", c, "STG_T", c, "all_t", c, "MART", c, "mapped", None)
    lineage = spark.createDataFrame([row(1, "CODE"), row(2, "amount"), (3, "g", "feed-1.dat", "x", "NONE_T", "y", "all_t", "CODE", "MART2", "z", "exists", "MAIN")], LINEAGE)
    dictionary = spark.createDataFrame([("CODE", "dd/mm/yyyy", "N")], "column_name string, date_format string, is_pii string")
    return catalog, lineage, dictionary


def test_run(spark, parts, tmp_path):
    out = f"file://{tmp_path}"
    got = {r.table_name: r for r in run_profile(spark, *parts, "MAIN", out, "r1", AT).collect()}
    assert (got["MART"].status, got["MART"].fields_total, got["MART"].fields_variant, got["MART"].worst_hop) == ("RED", 2, 2, "STG1->STG2")
    assert got["MART2"].status == "GREEN"
    types = {(r.stage, r.column_name): r.inferred_type for r in spark.read.parquet(f"{out}/dtype_profile").collect()}
    assert types["SRC", "CODE"] == "INTEGER" and types["SRC", "AMOUNT"] == "AS_DECLARED"
    events = spark.read.parquet(f"{out}/runs")
    assert latest_status(events.filter("status <> 'RUNNING'")).first().status == "COMPLETE"
    assert sorted(r.step for r in events.filter("error_text is not null").collect()) == ["DWH.MART2", "STG1.NONE_T"]
    assert run_profile(spark, *parts, "MAIN", out, "r2", AT, analysis="DTYPE", sample_rows=10) is None
    assert run_profile(spark, *parts, "MAIN", out, "r3", AT, table="mart", analysis="STAGE").count() == 1


def test_failed_run(spark, parts, tmp_path):
    out = f"file://{tmp_path}"
    with pytest.raises(ValueError):
        run_profile(spark, *parts, "MAIN", out, "r", AT, analysis="X")
    catalog, lineage, dictionary = parts
    with pytest.raises(Exception):  # noqa: B017
        run_profile(spark, catalog, spark.createDataFrame([(1,)], "lineage_id int"), dictionary, "MAIN", out, "r", AT)
    last = latest_status(spark.read.parquet(f"{out}/runs").filter("status <> 'RUNNING'")).first()
    assert last.status == "FAILED" and "lineage_status" in last.error_text


def test_suite_and_command_line(spark, tmp_path):
    df = spark.range(10).withColumn("s", F.when(F.col("id") > 3, "A"))
    results, pages, code = run_suite(df, [ck.not_null("s"), ck.unique("id")], "t", str(tmp_path / "r"), AT)
    assert code == 1 and all(p.exists() for p in pages) and results.count() == 2 and "not_null_s" in pages[0].read_text()
    df.write.parquet(f"{tmp_path}/t.parquet")
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps([{"check": "not_null", "args": ["s"], "severity": "warn"}, {"check": "between", "args": ["id", 0, 5], "where": "id < 4"}, {"check": "accepted", "args": ["s", ["B"]], "mostly": 0}]))
    assert main([f"{tmp_path}/t.parquet", str(rules), str(tmp_path / "out")]) == 0 and main([]) == 2
    with pytest.raises(ValueError):
        parsed([{"check": "exec", "args": []}])
