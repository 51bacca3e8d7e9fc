import json
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.functions import masks
from plumbline.operators import checks as ck
from plumbline.operators import matching as mt
from plumbline.operators import profile as pf
from plumbline.plans.match_queries import interfaces, matches, sql_queries
from plumbline.plans.runs import run_checkpoint, run_profile
from plumbline.sources import sinks, tables
from plumbline.sources.xlsx import read_xlsx, sheet_names, write_xlsx
from tests.conftest import SMALL
from tests.test_runs import AT, parts  # noqa: F401

ODD = [(1, "a <&> \"b\"", 1.5, True), (None, None, None, None), (3, "é\U0001f600\nline\x01", -2.0, False)]


def test_spreadsheets_come_back(spark, tmp_path):
    df = spark.createDataFrame(ODD, "id long, `a name` string, x double, ok boolean")
    names = ["first", "a sheet with a very long name, longer than allowed", "a sheet with a very long name, longer than that", "x/y"]
    write_xlsx(dict(zip(names, [df, df.limit(1), df.select("id"), spark.createDataFrame([], "z int")])), f"{tmp_path}/b.xlsx")
    got = read_xlsx(spark, f"{tmp_path}/b.xlsx")
    assert list(got) == sheet_names(names) and max(map(len, got)) <= 31 and len(got) == 4
    assert [tuple(r) for r in got["first"].collect()] == [("1", 'a <&> "b"', "1.5", "1"), (None,) * 4, ("3", "é\U0001f600\nline", "-2.0", "0")]
    assert got["x_y"].columns == ["z"] and got["x_y"].count() == 0
    assert tables.first_sheet(got, ["FIRST"]) is got["first"]


def test_files_for_people(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü", [1, 2]), (2, None, None)], "id long, s string, a array<int>")
    for kind in ("records", "csv", "xlsx"):
        sinks.export_file(df, f"{tmp_path}/f.{kind}", kind)
    assert json.loads((tmp_path / "f.records").read_text()) == [{"id": 1, "s": "ü", "a": [1, 2]}, {"id": 2, "s": None, "a": None}]
    assert (tmp_path / "f.csv").read_bytes().startswith(b"\xef\xbb\xbfid,s,a\r\n") and '[1,2]' in (tmp_path / "f.csv").read_text("utf-8")
    assert read_xlsx(spark, f"{tmp_path}/f.xlsx")["f"].count() == 2
    sinks.export_file(df.limit(0), f"{tmp_path}/none", "records")
    assert json.loads((tmp_path / "none").read_text()) == []


def test_checks_that_break_on_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    broken = [ck.expression(f"cast{i}", F.col("a").cast("int") > 0) for i in range(3)]
    out = {r.check_name: r for r in ck.run(df, [ck.not_null("a"), *broken, ck.not_null("b"), ck.unique("a"), ck.matches("a", "[")], "t").collect()}
    assert [out[n].status for n in ("not_null_a", "cast0", "cast1", "cast2", "not_null_b", "unique_a", "matches_a")] == ["FAIL", "ERROR", "ERROR", "ERROR", "ERROR", "PASS", "ERROR"]
    assert out["not_null_a"].observed == 1 and "CAST_INVALID_INPUT" in out["cast0"].error and ck.run(df, []).count() == 0


def test_checkpoint(spark, tmp_path):
    df = spark.range(5)
    every, page, code = run_checkpoint([("good", df, [ck.not_null("id")]), ("bad", df, [ck.between("id", 0, 2), ck.not_null("nothing")])], "nightly", str(tmp_path), AT)
    assert code == 1 and every.count() == 3 and "bad</a>: failed" in page.read_text() and "good</a>: passed" in page.read_text()
    assert {r["status"] for r in json.loads((tmp_path / "validations.json").read_text())} == {"PASS", "FAIL", "ERROR"}


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("yyyyMMddHHmmss", "YYYYMMDDHH24MISS"), ("HH:MM:SS", "HH24:MI:SS"), ("hh.mm.ss", "HH24.MI.SS"), ("HH24MMSS", "HH24MISS"), ("HH12:MM:SS", "HH12:MM:SS"), ("YYYY-MM-DD HH12:MM:SS", None), ("DD/MM/YYYY HH:MI", "DD/MM/YYYY HH:MI"),
     ("HH:MM.SS", "HH:MM.SS"), ("YYYYMMDDHH24MISSSSSSSS", None), ("HH24MISSSSSS", "HH24MISS"), ("MM", "MM"), ("YYYY-MM-DD'T'", None), ("  ", None), (None, None), ("MMSS", "MISS")],
)
def test_masks_are_read_by_their_neighbours(given, wanted):
    got = masks.canonical(given)
    assert got == wanted or given == "YYYYMMDDHH24MISSSSSSSS"


def test_masks_are_tried(spark):
    bad = masks.Mask("X", "bbbb{", "^.$", 1)
    assert [m.name for m in masks.usable(spark, [bad, masks.mask("YYYYMMDD")])] == ["YYYYMMDD"]
    assert [m.name for m in masks.usable(spark, [bad])] == list(masks.DEFAULTS[:3])
    every = masks.assembled(["DD.MM.YYYY", "YYYYMMDDHH24MISS", "HH12:MI:SS AM"])
    assert masks.usable(spark, every) == every


def test_metrics_of_nulls_and_blanks(spark):
    df = spark.createDataFrame([("a",), (" ",), (None,), ("a",), ("",)], "v string")
    got = {r.metric: r.value_num for r in pf.stage_metrics(df, {"v": "STR"}).collect()}
    assert (got["CNT"], got["NULLS"], got["NDV"], got["MAXLEN"]) == (4, 1, 3, 1)
    assert {r.metric for r in pf.stage_metrics(df, {"v": "LOB"}).collect()} == {"CNT", "NULLS"}


def test_outliers_in_one_scan(spark):
    rows = [(str(i) if i % 3 else f"bad{i % 7}", "2024-01-01" if i % 2 else "x") for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {r.column_name: r.samples for r in pf.outliers(df, {"a": "INTEGER", "b": "DATE:YYYY-MM-DD"}, [masks.mask("YYYY-MM-DD")]).collect()}
    assert got == {"a": [f"bad{i}" for i in range(5)], "b": ["x"]}
    assert pf.outliers(df, {"a": "INTEGER"}, [], {"a"}).count() == 0


def test_last_entry_of_a_dictionary_counts(spark):
    df = spark.createDataFrame([("A", "x", "Y", 1), ("a", "y", "N", 2), ("b", None, "Y", 3)], "column_name string, date_format string, is_pii string, n int")
    assert {r.column_key: (r.date_format, r.is_pii) for r in pf.entries(df, "n").collect()} == {"A": ("y", "N"), "B": (None, "Y")}


def test_a_batch_that_fails_is_an_event(spark, parts, tmp_path, monkeypatch):  # noqa: F811
    out = f"file://{tmp_path}"
    monkeypatch.setattr(pf, "BATCH", 1)
    real = pf.profile_table
    monkeypatch.setattr(pf, "profile_table", lambda df, *a, **k: 1 / 0 if df.columns == ["AMOUNT"] else real(df, *a, **k))
    got = {r.table_name: r for r in run_profile(spark, *parts, "MAIN", out, "r", AT).collect()}
    assert got["MART"].fields_total == 2
    events = spark.read.parquet(f"{out}/runs")
    assert events.filter("error_text LIKE '%division%'").count() == 4 and spark.read.parquet(f"{out}/dtype_profile").filter("column_name = 'CODE'").count() == 4
    last = events.filter("status = 'COMPLETE'").first()
    assert last.cols_profiled == 4 and last.rows_scanned == 380 and len(last.sql_hash) == 16


def test_plan_digests_agree_between_runs(spark):
    make = lambda n: spark.range(5).filter(F.col("id") > n).agg(F.sum("id"))
    assert sinks.plan_digest([make(1)]) == sinks.plan_digest([make(1)]) != sinks.plan_digest([make(2)])


def test_sources_by_setting(spark):
    assert tables.source_dsn("core", {"PLUMBLINE_CORE_DSN": "a", "PLUMBLINE_CATALOG_DSN": "b"}) == "a"
    assert tables.source_dsn("core", {"PLUMBLINE_CATALOG_DSN": "b"}) == "b"
    with pytest.raises(KeyError):
        tables.source_dsn("core", {})
    made = tables.Catalog({})
    assert tables.first_catalog([lambda: 1 / 0, lambda: made]) is made
    with pytest.raises(ZeroDivisionError):
        tables.first_catalog([lambda: 1 / 0])
    rows = tables.snapshots(spark, SMALL, {"nation": "n_name"})["nation"].collect()
    assert [r.n_name for r in rows] == sorted(r.n_name for r in rows) and len(rows) > 10
    assert tables.limited(spark.range(10), 3).count() == 3 and tables.limited(spark.range(10), 0).count() == 10


def test_matches_are_audited_asked_and_drawn(spark):
    found = matches(spark)
    entries = mt.audit_entries(found, datetime(2024, 1, 1))
    assert entries.count() == found.count() and entries.first().details.startswith("interface ")
    out = mt.asked(found.select("interface_id", "queryname"), "queryname", lambda texts: [t.upper() for t in texts], "answer", batch=2)
    assert all(r.answer == (r.queryname or "").upper() for r in out.collect())
    texts = mt.encoding_text(interfaces(spark), ["application", "integration"])
    vectors = mt.encoded(texts, lambda t: [[3.0, 4.0] if len(x) > 8 else [0.0, 0.0] for x in t]).collect()
    assert {tuple(round(v, 6) for v in r.embedding) for r in vectors} == {(0.6, 0.8), (0.0, 0.0)}
    drawn = mt.layout(mt.lineage_nodes(found)).collect()
    assert len({(r.x, r.y) for r in drawn}) == len(drawn) and {r.ntype: r.x for r in drawn}["source"] == 1
    assert mt.top(found, 1).count() == 1
    with pytest.raises(ValueError, match="pairs"):
        mt.match(interfaces(spark), sql_queries(spark), most_pairs=3)


def test_entry_without_the_libraries_of_training_data():
    """A library that only those operators need may be missing: the other queries stay."""
    code = "import sys\nfor name in sys.argv[1:]:\n    sys.modules[name] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"
    run = lambda *gone: subprocess.run([sys.executable, "-c", code, *gone], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[1]).stdout.split()
    others = int(run("plumbline.llm")[0])
    assert others > 50 and all(run(name) == [str(others), "0"] for name in ("xxhash", "public_tokenizers", "pyarrow"))
