"""Operators on small tables with known violations, and every query against its SQL."""

import json
from datetime import date, datetime

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import masks
from plumbline.functions import text as tx
from plumbline.operators import checks as ck
from plumbline.operators import extraction as ex
from plumbline.operators import mapping as mp
from plumbline.operators import matching as mt
from plumbline.operators import profile as pf
from plumbline.operators import relational as rl
from plumbline.operators import variance as va
from plumbline.plans import profile_queries, suites
from plumbline.plans.registry import ORACLE_SQL, QUERIES
from plumbline.sources import sinks, tables
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return float(f"{float(v):.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# Functions


def test_numbers(spark):
    texts = ["10", "+7", "-1.25", ".5", "1.", "1e5", "NaN", "1d", " 12 ", "", "abc", None, "0.5", "007", "-07", "1.2.3"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = {r.v: (r.n, r.i, r.z) for r in df.select("v", tx.is_number(F.col("v")).alias("n"), tx.is_integer(F.col("v")).alias("i"), tx.has_leading_zero(F.col("v")).alias("z")).collect()}
    assert [t for t in texts if t and got[t][0]] == ["10", "+7", "-1.25", ".5", "1.", "1e5", "0.5", "007", "-07"]
    assert [t for t in texts if t and got[t][1]] == ["10", "+7", "1e5", "007", "-07"]
    assert [t for t in texts if t and got[t][2]] == ["007"] and got[None] == (None, None, None)


def test_texts(spark):
    lit = F.lit
    r = one(spark, tx.content(lit("  ")).alias("a"), tx.normal(lit(" Ab_c-D e\n")).alias("b"), tx.safe(lit("nan"), "x").alias("c"), tx.pascal(lit("customer master-data 2x")).alias("d"), tx.pascal(lit("—")).alias("e"), tx.hash32(lit("abc")).alias("f"), tx.page_label(F.array(lit(2), lit(5))).alias("g"), tx.page_label(F.array(lit(3))).alias("h"), tx.comma_list(lit("a, b,,c")).alias("i"), tx.rounded(lit(0.125), 2).alias("j"), tx.keyword_class(lit("Trade account")).alias("k"), tx.looks_numeric(lit("1.2-3 4")).alias("l"))
    assert list(r) == [None, "abcde", "x", "CustomerMasterData2x", "Entity", 2416005272, "2-5", "3", ["a", "b", "c"], 0.13, "customer", True]


@pytest.mark.parametrize(
    "given_, wanted",
    [("yyyymmdd", "YYYYMMDD"), ("dd-mon-yyyy", "DD-MON-YYYY"), ("YYYYMMDDHHMMSS", "YYYYMMDDHH24MISS"), ("YYYY-MM-DD HH:MM:SS", "YYYY-MM-DD HH24:MI:SS"), ("YYYY-MM-DD HH24:MI:SS", "YYYY-MM-DD HH24:MI:SS"), ("MM/DD/YYYY HH:MM", None), ("YYYY-MM-DD'T'", None), ("", None), (None, None), ("YYYYMMDDHH24MMSS", "YYYYMMDDHH24MISS"), ("HHMMSSSSSS", None)],
)
def test_masks(given_, wanted):
    got = masks.canonical(given_)
    assert got == wanted or (given_ == "HHMMSSSSSS" and got in (None, "HH24MISS"))


def test_mask_matches(spark):
    cases = [("YYYYMMDD", "20240115", True), ("YYYYMMDD", "20240230", False), ("YYYY-MM-DD", "2024-1-5", False), ("DD-MON-YYYY", "15-JAN-2024", True), ("MM/DD/YYYY", "13/01/2024", False), ("YYYY-MM-DD HH24:MI:SS", "2024-01-15 23:59:59", True), ("YYYYMMDD", None, None)]
    for name, text, wanted in cases:
        assert one(spark, masks.mask(name).matches(F.lit(text).cast("string")).alias("x")).x is wanted
    assert len(masks.assembled(["dd/mm/yyyy", "junk", "YYYYMMDD", "DD.MM.YYYY", "YYYY/MM/DD", "DDMMYYYY", "YYMMDD"])) == masks.MOST


# Sources


def test_catalog(spark):
    df = spark.createDataFrame([(1, "x")], "id int, some_name string")
    cat = tables.Catalog({"OWNER.BIG_TABLE": df, "plain": df}, {"STG1": "OWNER"})
    assert cat.find("BIGTABLE", "STG1") is df and cat.find("owner.big_table") is df and cat.find("Plain", "DWH") is df
    assert cat.find("no-such file.csv") is None and cat.types("plain") == {"ID": "INT", "SOME_NAME": "STRING"} and cat.types("none") == {}
    names = spark.createDataFrame([("A.B",), ("x y",), (None,), ("F-1.dat",)], "n string")
    assert [r.ok for r in names.select(tables.object_name_filter(F.col("n")).alias("ok")).collect()] == [True, False, False, False]
    assert tables.parse_dsn("u:p@ss@host:1/x") == {"user": "u", "password": "p@ss", "address": "host:1/x"}
    assert [tables.type_class(t) for t in ("VARCHAR2(10)", "NUMBER(3,1)", "TIMESTAMP(6)", "CLOB", "decimal(3,1)", "timestamp_ntz", "binary")] == ["TEXT", "NUMBER", "DATE", "LOB", "NUMBER", "DATE", "LOB"]


def test_sheets(spark):
    df = spark.createDataFrame([("a", None, "x", 1)], "`App Name` string, `Empty` string, `Unnamed: 3` string, `Owner (#)` int")
    clean = tables.without_empty_columns(df)
    assert clean.columns == ["App Name", "Owner (#)"] and tables.with_clean_names(clean).columns == ["app_name", "owner_num"]
    out = tables.with_aliases(clean, {"application": ["app_name", "app"], "owner": ["owner_num"], "type": []})
    assert out.columns == ["application", "owner", "type"] and tuple(out.first()) == ("a", "1", None)
    assert tables.first_sheet({" Interfaces ": df}, ["x", "interfaces"]) is df and tables.first_sheet({}, ["x"]) is None


@pytest.mark.parametrize("hours, status", [(1, "PASS"), (24, "PASS"), (25, "WARN"), (49, "FAIL"), (None, "FAIL")])
def test_freshness(spark, hours, status):
    now = datetime(2024, 1, 10)
    data = [(datetime.fromtimestamp(now.timestamp() - hours * 3600),)] if hours is not None else []
    assert tables.freshness(spark.createDataFrame(data, "t timestamp_ntz"), "t", now).first().status == status


def test_sinks(spark, tmp_path):
    at = datetime(2024, 1, 1)
    path = f"file://{tmp_path}/runs"
    sinks.record_run(spark, path, "r", "START", at)
    sinks.record_run(spark, path, "r", "FAILED", datetime(2024, 1, 2), error="x" * 5000)
    last = sinks.latest_status(spark.read.parquet(path)).first()
    assert last.status == "FAILED" and len(last.error_text) == sinks.ERROR_TEXT
    results = ck.run(spark.range(3), [ck.not_null("id"), ck.between("id", 0, 1)], "t")
    page = sinks.report(results, {"bad <rows>": spark.range(1000)}, {"data": spark.range(3)}, "Title", at)
    assert "1 of 2 checks passed (50.0 %)" in page and "bad &lt;rows&gt;" in page and page.count("<tr>") == 3 + 1 + sinks.FAILING_ROWS + 4
    assert [p.name for p in sinks.save_report(page, str(tmp_path / "out"), at)] == ["report_20240101_000000.html", "report_latest.html"]
    assert sinks.exit_code(results) == 1 and sinks.exit_code(results.filter("status = 'PASS'")) == 0
    sinks.export(spark.createDataFrame([([1, 2], "a")], "x array<int>, y string"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv").first().x == "[1,2]"
    sinks.append_results(spark.range(2), f"file://{tmp_path}/res", "r1")
    sinks.append_results(spark.range(3), f"file://{tmp_path}/res", "r2")
    assert spark.read.parquet(f"file://{tmp_path}/res").groupBy("run_id").count().count() == 2


# Checks


def test_checks_and_nulls(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "b", None), (2, None, 5.0), (None, "A", -1.0), (None, "A", 2.0)], "k int, s string, x double")
    found = [ck.not_null("k"), ck.accepted("s", ["A"]), ck.length_is("s", 1), ck.matches("s", "^[A-Z]$"), ck.between("x", 0, 5), ck.unique("k"), ck.duplicate_excess("k"), ck.between("x", 0, 5).tolerating(0.75), ck.between("x", 0, 5).warn(), ck.expression("x_positive", F.col("x") > 0), ck.matches("s", "^A").given(F.col("k") == 1), ck.accepted("no_such", ["A"])]
    got = [(r.observed, r.status) for r in ck.run(df, found, "t").collect()]
    assert got == [(2, "FAIL"), (1, "FAIL"), (0, "PASS"), (1, "FAIL"), (1, "FAIL"), (1, "FAIL"), (3, "FAIL"), (1, "PASS"), (1, "WARN"), (2, "FAIL"), (1, "FAIL"), (None, "ERROR")]
    assert [tuple(r) for r in ck.failing_rows(df, ck.unique("k")).collect()] == [(1, 2)] and ck.failing_rows(df, ck.not_null("k")).count() == 2
    assert sorted(r.check_name for r in ck.captured(df, found[:5]).collect()) == ["accepted_values_s", "between_x", "matches_s", "not_null_k", "not_null_k"]


def test_checks_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k int, m string")
    found = [ck.not_null("k"), ck.unique("k"), ck.unique_share("k", 0.99), ck.share_at_most("f", F.col("m") == "F", 0.2), ck.row_count_between(1, None), ck.has_type(df, "k", "varchar"), ck.column_exists(df, "K")]
    assert [r.status for r in ck.run(df, found).collect()] == ["PASS", "PASS", "PASS", "PASS", "FAIL", "FAIL", "PASS"]


def test_many_checks_run_in_parts(spark):
    out = ck.run(spark.range(5), [ck.between("id", 0, n) for n in range(230)])
    assert out.count() == 230 and out.filter("status = 'FAIL'").count() == 4


def test_mixed_sets(spark):
    df = spark.createDataFrame([("true",), ("Y",), ("0",), ("maybe",), (None,)], "a string")
    assert ck.run(df, [ck.accepted("a", suites.ACTIVE)]).first().observed == 1


@pytest.fixture(scope="session")
def securities(spark):
    """A mart with one violation of each kind, and what it is compared with."""
    good = dict(SECURITY_ID="S1", CUSIP="ABCDEF123", ISIN="US0123456789", SEDOL="ABC1234", TICKER_SYMBOL="T", SECURITY_NAME="Name", SECURITY_DESCRIPTION="d", ISSUER_NAME="i", ASSET_CLASS_CODE="EQD", ASSET_CLASS="Equity", STRATEGY_CODE="EQ_DOM", STRATEGY_DESCRIPTION="Domestic", SECURITY_TYPE="EQUITY", BASE_CURRENCY="USD", COUNTRY_CODE="US", MATURITY_DATE=date(2030, 1, 1), COUPON_RATE=0.1, PRICE=1.0, PRICE_DATE=date(2024, 1, 1), MARKET_CAP=1.0, STATUS="A", _L1_MAPPING_METHOD="DIRECT", _L2_MAPPING_METHOD="DIRECT", _SOURCE_CLASS_CODE="E", _TRANSFORMATION_TS=datetime(2024, 1, 1))
    changes = [{}, dict(SECURITY_ID="S1"), dict(SECURITY_ID=None), dict(CUSIP="short"), dict(BASE_CURRENCY="usd"), dict(ASSET_CLASS_CODE="XX"), dict(STATUS=None), dict(ASSET_CLASS="EQXDOM leak"), dict(PRICE=-1.0), dict(COUPON_RATE=1.2), dict(MATURITY_DATE=date(1899, 1, 1)), dict(PRICE_DATE=date(2024, 1, 4)), dict(_L1_MAPPING_METHOD="FALLBACK"), dict(STRATEGY_CODE="OTHR_DEF")]
    data = [{**good, "SECURITY_ID": f"S{i}", **c} for i, c in enumerate(changes, 1)]
    schema = ", ".join(f"{k} {'date' if isinstance(v, date) and not isinstance(v, datetime) else 'timestamp' if isinstance(v, datetime) else 'double' if isinstance(v, float) else 'string'}" for k, v in good.items())
    mart = spark.createDataFrame([tuple(r[k] for k in good) for r in data], schema)
    staging = spark.createDataFrame([(f"S{i}",) for i in range(1, 16)], "security_id string")
    return {
        "mart": mart,
        "staging": staging,
        "securities": spark.createDataFrame([(i,) for i in range(1, 15)], "n int").select(F.concat(F.lit("S"), F.col("n")).alias("sec_id")),
        "class_crosswalk": spark.createDataFrame([("EQD", "Equity")], "target_class_code string, target_class string"),
        "strategy_crosswalk": spark.createDataFrame([("EQ_DOM", "Domestic"), ("OTHR_DEF", "x")], "target_strategy_code string, target_strategy_desc string"),
        "class_mapping": spark.createDataFrame([("E",)], "source_class_code string"),
    }


def test_mart_suite(securities):
    out = suites.run_mart_suite(securities, date(2024, 1, 2)).collect()
    bad = {(r.table_name, r.check_name): r.status for r in out if r.status != "PASS"}
    assert set(bad) == {
        ("mart", "security_id_given"), ("mart", "unique_combination_SECURITY_ID"), ("mart", "unique_SECURITY_ID"), ("mart", "not_null_SECURITY_ID"), ("mart", "length_CUSIP"), ("mart", "matches_CUSIP"),
        ("mart", "accepted_values_ASSET_CLASS_CODE"), ("mart", "matches_BASE_CURRENCY"), ("mart", "in_set_BASE_CURRENCY"), ("mart", "between_MATURITY_DATE"), ("mart", "between_COUPON_RATE"), ("mart", "between_PRICE"), ("mart", "between_PRICE_DATE"),
        ("mart", "reference_ASSET_CLASS_CODE"), ("mart", "reference_ASSET_CLASS"), ("mart", "rows_equal_staging"), ("mart", "no_source_row_missing"),
        ("mart in process", "not_null_SECURITY_ID"), ("mart in process", "duplicate_excess_SECURITY_ID"), ("mart in process", "accepted_values_ASSET_CLASS_CODE"), ("mart in process", "no_code_leakage"),
        ("mart expectations", "unique_SECURITY_ID"), ("mart expectations", "not_null_SECURITY_ID"), ("mart expectations", "not_null_STATUS"), ("mart expectations", "length_CUSIP"), ("mart expectations", "between_PRICE"), ("mart expectations", "between_COUPON_RATE"), ("mart expectations", "matches_BASE_CURRENCY"), ("mart expectations", "row_count_between"), ("mart expectations", "unique_share_SECURITY_ID"),
    }
    assert {k for k, v in bad.items() if v == "WARN"} == {("mart", c) for c in ("in_set_BASE_CURRENCY", "between_COUPON_RATE", "between_PRICE", "between_PRICE_DATE")}
    assert len(suites.mart_checks(securities["mart"], date(2024, 1, 1))) + len(suites.MART_REFERENCES) + 1 == 57
    assert sum(map(len, suites.source_checks(date(2024, 1, 1)).values())) + len(suites.SOURCE_REFERENCES) == 47 and len(suites.expectations()) == 22


def test_type_rules(securities):
    got = sorted((r.id or "", r.field) for r in rl.rule_violations(securities["mart"], "SECURITY_ID", suites.type_rules(date(2024, 1, 2))).collect())
    assert got == [("S10", "COUPON_RATE"), ("S11", "MATURITY_DATE"), ("S12", "PRICE_DATE"), ("S9", "PRICE")]


# Relations


def test_orphans_of_mixed_types(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([("2",), ("x",), (None,)], "k string")
    assert sorted(map(tuple, rl.orphans(a, b, "k", "k").collect())) == [("1", "MISSING_IN_TARGET"), ("x", "MISSING_IN_SOURCE")]


def test_null_code_silences_parents(spark):
    seed = spark.createDataFrame([("A",)], "c string")
    some = [("A", None), ("B", "P"), ("C", "P")]
    classes = lambda r: rl.seed_gaps(spark.createDataFrame(r, "code string, up string"), "code", "up", seed, "c").collect()
    assert sorted(map(tuple, classes(some))) == [("MISSING_CODE", "B", 1), ("MISSING_CODE", "C", 1), ("MISSING_PARENT", "P", 2)]
    assert {r.issue for r in classes([*some, (None, "Q")])} == {"MISSING_CODE"}


def test_fallback_shares(spark):
    df = spark.createDataFrame([("FALLBACK",)] * 2 + [("DIRECT",)] * 8, "m string")
    pick = lambda d, **k: rl.fallback_shares(d, {"L1": ("m", 20.0)}, **k).first()
    assert (pick(df).fallback_pct, pick(df).status, pick(df, warn={"L1": 10.0}).status) == (20.0, "PASS", "WARN")
    assert (pick(df.limit(0)).fallback_pct, pick(df.limit(0)).status) == (None, "PASS")


def test_hierarchies(spark):
    tree = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(6)] + [("x", "x"), ("y", "gone"), (None, "n1")]
    got = {r.code: (r.top_code, r.level) for r in mp.top_levels(spark.createDataFrame(tree, "c string, p string"), "c", "p").collect()}
    assert got == {f"n{i}": ("n0", i + 1) for i in range(6)} | {"x": ("x", 2), "y": ("y", 1)} or got["n5"] == ("n0", 6)


# Profiles


@pytest.mark.parametrize(
    "values, kind, risk",
    [
        ([None, "", "  "], "EMPTY", ""), (["10", "+7", "1e5"], "INTEGER", ""), (["1.25", ".5", "2"], "DECIMAL", ""), (["00123", "45"], "STRING_NUMERICLOOK", "IDENTIFIER_LEADING_ZERO"), (["20240115", "20231231"], "DATE:YYYYMMDD", ""),
        (["2024-01-15"], "DATE:YYYY-MM-DD", ""), (["Y", "n", "T"], "BOOLEAN_FLAG", ""), (["0", "1"], "INTEGER", ""), (["1"] * 60 + ["x"] * 40, "MIXED", ""), (["a", "b"], "STRING", ""),
        (["1"] * 99 + ["x"], "INTEGER", "CAST_UNSAFE"), (["1"] * 98 + ["x"] * 2, "INTEGER", "CAST_UNSAFE"), (["1"] * 97 + ["x"] * 3, "MIXED", ""), (["x", "y", "1", "2"], "STRING", ""),
    ],
)
def test_classes(spark, values, kind, risk):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    r = pf.classified(pf.composition(df, profile_queries.MASKS), profile_queries.MASKS).first()
    assert (r.inferred_type, r.risk) == (kind, risk)


def test_type_drift_is_optional(spark):
    df = spark.createDataFrame([("12.5",), ("3",)], "v string")
    probes = pf.composition(df, profile_queries.MASKS)
    assert pf.classified(probes, profile_queries.MASKS).first().risk == ""
    r = pf.classified(probes, profile_queries.MASKS, type_drift=True).first()
    assert (r.risk, r.verdict) == ("TYPE_DRIFT", "safe cast -> NUMBER(3,1)")


def test_profile_keeps_personal_samples_back(spark):
    df = spark.createDataFrame([(str(i), str(i), i) for i in range(99)] + [("secret", "seen", 1)], "a string, b string, n int")
    pii = spark.createDataFrame([("A", "Y"), ("a", "N")], "column_name string, is_pii string")
    got = {r.column_name: r for r in pf.profile_table(df, profile_queries.MASKS, "SRC", "t", pii).collect()}
    assert got["a"].samples_json is None and got["a"].pii_suppressed and json.loads(got["b"].samples_json) == ["seen"] and got["n"].inferred_type == "AS_DECLARED"


def test_metric_classes():
    assert [pf.metric_class(*x) for x in (("NUMBER", None), ("DATE", "STRING"), ("CLOB", None), ("VARCHAR2", "INTEGER"), ("string", "DATE:YYYYMMDD"), ("string", None))] == ["RAWNUM", "RAWDATE", "LOB", "NUM", "STR", "STR"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["a", "bb", "", None, "7"])), min_size=2, max_size=30))
def test_metrics_of_parts_add_up(spark, data):
    df = spark.createDataFrame(data, "p int, v string")
    chain = lambda i, t: (i, "g", None, None, t, "v", "all", "v", "d", "v")
    chains = spark.createDataFrame([chain(1, "one"), chain(2, "two")], profile_queries.CHAIN_COLUMNS.replace(" ", " string, ").replace("lineage_id string", "lineage_id int") + " string")
    parts = {"one": df.filter("p = 0"), "two": df.filter("p = 1"), "all": df, "d": df}
    out = None
    for name, part in parts.items():
        x = pf.stage_metrics(part.select("v"), {"v": "STR"}).withColumn("table_name", F.lit(name))
        out = x if out is None else out.unionByName(x)
    profile = va.by_stage(chains).join(out, ["table_name", "column_name"]).select("lineage_id", "stage", "metric", "value_num", "value_str")
    assert va.hop_breaks(chains, profile).count() == 0


def test_tolerance(spark):
    n = lambda x: F.lit(x).cast("double")
    t = F.lit(None).cast("string")
    r = one(spark, va.differs(n(10000.0), t, n(10001.0), t).alias("a"), va.differs(n(10000.0), t, n(10001.1), t).alias("b"), va.differs(n(None), F.lit("x"), n(None), F.lit("y")).alias("c"), va.differs(n(0.0), t, n(0.00005), t).alias("d"))
    assert list(r) == [False, True, True, False]


def test_chains(spark):
    cols = "lineage_id int, functional_group string, src_source_table string, src_source_column string, stg1_source_table string, stg1_source_column string, stg2_source_table string, stg2_source_column string, dwh_target_table string, dwh_target_column string, lineage_status string, data_source string"
    row = lambda i, status, source: (i, "g", "s", "c", "a", "c", "b", "c", "D", "c", status, source)
    df = spark.createDataFrame([row(1, " Mapped", None), row(2, "exists", "MAIN"), row(3, "gap", "MAIN"), row(4, None, "MAIN"), row(5, "mapped", "X")], cols)
    assert [r.lineage_id for r in va.load_chains(df, "MAIN").orderBy("lineage_id").collect()] == [1, 2]
    assert va.load_chains(df, "MAIN", "other").count() == 0 and va.by_stage(va.load_chains(df, "MAIN", "d")).count() == 8


# Matching


@pytest.mark.parametrize("similarity, points", [(0.85, 25), (0.8499, 20), (0.75, 20), (0.65, 15), (0.55, 10), (0.45, 5), (0.4499, 0)])
def test_bands(spark, similarity, points):
    assert one(spark, tx.banded(F.lit(similarity), mt.BANDS).alias("x")).x == points


def test_step_one(spark):
    def score(i, q, tokenized=False):
        a = spark.createDataFrame([tuple(i.get(c) for c in mt.INTERFACE)], ", ".join(f"{c} string" for c in mt.INTERFACE)).alias("i")
        b = spark.createDataFrame([tuple(q.get(c) for c in mt.QUERY)], ", ".join(f"{c} string" for c in mt.QUERY)).alias("q")
        return a.join(b, F.lit(True)).select(mt.text_score("i", "q", tokenized)[0].alias("x")).first().x

    assert score({}, {}) == 0 and score({"application": "Led ger"}, {"system": "ledger_sys"}) == 15
    assert score({"integration": "a b"}, {"queryname": "x_ab"}) == 15 and score({"integration": "ab"}, {"file": "ab.sql"}) == 5
    assert score({"source_system": "core"}, {"tables": "x,CORE.y"}) == 10 and score({"type": "ext"}, {"type": "Extract"}) == 5
    assert score({"description": "same"}, {"queryname": "Same"}) == 2 and score({"description": "x y z"}, {"queryname": "z y q"}) == 0
    assert score({"description": "x y z"}, {"queryname": "z y q"}, True) == 4
    assert score({"integration": "trade data load"}, {"queryname": "load trade"}, True) == 8


def test_sql_analysis(spark):
    case = "select case when a then 1 end, case when b then 2 end, CASE when c then 3 END, case when d then 4 end from t, u join v on 1=1 group by x"
    rows_ = spark.createDataFrame([(case,), (None,), ("",)], "q string")
    a, b, c = mt.sql_analysis(rows_, "q").collect()
    assert len(a.case_blocks) == 3 and a.sql_tables == ["T", "V"] and (a.n_joins, a.has_group_by, a.sql_score, a.complexity) == (1, True, 17, "Medium")
    assert b.sql_tables == c.sql_tables == [] and b.complexity == c.complexity == "Low"


def test_encoding_text(spark):
    df = spark.createDataFrame([("a", None, "x" * 10), (None, "nan", "")], "p string, q string, r string")
    assert [r.encoding_text for r in mt.encoding_text(df, ["p", "q", "r"], {"r": 3}).collect()] == ["a xxx", "unknown"]


# Extraction


def test_answers():
    cols = ["A", "B"]
    assert ex.parse_attributes('[{"attribute": "A", "description": "d"}]', cols) == [("A", "d")]
    assert ex.parse_attributes('well: [{"attribute": "A"}] ok', cols) == [("A", "")]
    assert ex.parse_attributes("no list", cols) == ex.parse_attributes(None, cols) == [("A", ""), ("B", "")]


def test_continuation_limits():
    on = lambda top, above: ex.goes_on(["a", "b"], [["1", "2"]], [{"text": above, "top": 1.0, "bottom": 2.0}] if above else [], top, 100.0)[0]
    assert on(35.0, None) and not on(35.01, None) and on(10.0, "fifteen chars..") and not on(10.0, "sixteen chars...") and on(10.0, "12 34 567890 1234567890") and on(10.0, "A B A B A B A B A B")
    assert not ex.goes_on(["a"], [["1", "2"]], [], 1.0, 100.0)[0]


def test_model_hook_and_page_range(spark):
    from plumbline.plans.match_queries import PAGE_SCHEMA, PAGES

    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    found = ex.entities(pages, "1-3")
    assert found.count() == 3 and ex.page_range(pages, "x").count() == ex.page_range(pages, "9-1").count() == len(PAGES)
    asked = ex.attributes(found.filter("doc_id = 1"), lambda name, columns, rows_: json.dumps([{"attribute": c, "description": f"{name} {len(rows_)}"} for c in columns]))
    assert {(r.attribute, r.description) for r in asked.collect()} == {("Id", "CustomerMaster 3"), ("Name", "CustomerMaster 3")}
