"""The declarative suites over a securities mart and its sources that are made of the driver's parts and nations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import checks as ck
from plumbline.operators import variance as va
from plumbline.plans import suites
from plumbline.plans.base import frame, query, table, values

AS_OF = date(2024, 1, 1)
#: Both engines run this text; every kind of fault occurs at some keys.
MART = """SELECT CASE WHEN p_partkey % 501 = 0 THEN NULL WHEN p_partkey % 307 = 0 THEN 'S1' ELSE concat('S', CAST(p_partkey AS VARCHAR(20))) END AS SECURITY_ID,
 CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 401 = 0 THEN 'short' ELSE lpad(CAST(p_partkey AS VARCHAR(20)), 9, 'A') END AS CUSIP,
 CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '123456789012' ELSE concat('US', lpad(CAST(p_partkey AS VARCHAR(20)), 10, '0')) END AS ISIN,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lpad(CAST(p_partkey AS VARCHAR(20)), 7, 'b') END AS SEDOL,
 CASE WHEN p_partkey % 13 = 0 THEN '' ELSE substr(p_name, 1, 5) END AS TICKER_SYMBOL,
 CASE WHEN p_partkey % 601 = 0 THEN NULL ELSE p_name END AS SECURITY_NAME, p_type AS SECURITY_DESCRIPTION, p_brand AS ISSUER_NAME,
 CASE WHEN p_partkey % 17 = 0 THEN 'EQ1' WHEN p_partkey % 2 = 0 THEN 'EQD' ELSE 'CASH' END AS ASSET_CLASS_CODE,
 CASE WHEN p_partkey % 19 = 0 THEN 'EQ_DOM x' WHEN p_partkey % 23 = 0 THEN NULL ELSE 'Equity' END AS ASSET_CLASS,
 CASE WHEN p_partkey % 29 = 0 THEN 'OTHR_DEF' WHEN p_partkey % 31 = 0 THEN 'bad' ELSE 'EQD_LC' END AS STRATEGY_CODE,
 CASE WHEN p_partkey % 37 = 0 THEN '' ELSE 'large caps' END AS STRATEGY_DESCRIPTION,
 CASE WHEN p_partkey % 41 = 0 THEN 'BOND' WHEN p_partkey % 43 = 0 THEN NULL ELSE 'EQUITY' END AS SECURITY_TYPE,
 CASE WHEN p_partkey % 47 = 0 THEN 'usd' WHEN p_partkey % 53 = 0 THEN 'EURO' WHEN p_partkey % 59 = 0 THEN NULL ELSE 'USD' END AS BASE_CURRENCY,
 CASE WHEN p_partkey % 1201 = 0 THEN 'USA' ELSE 'US' END AS COUNTRY_CODE,
 CASE WHEN p_partkey % 61 = 0 THEN DATE '1850-01-01' WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '2030-01-01' END AS MATURITY_DATE,
 CAST(CASE WHEN p_partkey % 67 = 0 THEN 0.4 WHEN p_partkey % 71 = 0 THEN -0.1 ELSE 0.05 END AS DECIMAL(9, 6)) AS COUPON_RATE,
 CASE WHEN p_partkey % 73 = 0 THEN -p_retailprice ELSE p_retailprice END AS PRICE,
 CASE WHEN p_partkey % 79 = 0 THEN DATE '2025-01-01' ELSE DATE '2023-06-01' END AS PRICE_DATE,
 CAST(CASE WHEN p_partkey % 83 = 0 THEN 20000000000000 ELSE 1000000 END AS DECIMAL(20, 2)) AS MARKET_CAP,
 CASE WHEN p_partkey % 89 = 0 THEN 'X' WHEN p_partkey % 97 = 0 THEN NULL ELSE 'A' END AS STATUS,
 CASE WHEN p_partkey % 4 = 0 THEN 'FALLBACK' WHEN p_partkey % 101 = 0 THEN 'GUESS' ELSE 'DIRECT' END AS _L1_MAPPING_METHOD,
 CASE WHEN p_partkey % 103 = 0 THEN 'NO' ELSE 'ASSET_CLASS_DEFAULT' END AS _L2_MAPPING_METHOD,
 CASE WHEN p_partkey % 107 = 0 THEN NULL ELSE 'EQ' END AS _SOURCE_CLASS_CODE, TIMESTAMP '2024-01-01 00:00:00' AS _TRANSFORMATION_TS FROM part"""
SOURCES = {
    "securities": """SELECT CASE WHEN p_partkey % 307 = 0 THEN '1' ELSE CAST(p_partkey AS VARCHAR(20)) END AS sec_id, CASE WHEN p_partkey % 601 = 0 THEN NULL ELSE p_name END AS sec_name,
 CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 401 = 0 THEN 'short' ELSE lpad(CAST(p_partkey AS VARCHAR(20)), 9, 'a') END AS cusip_num, lpad(CAST(p_partkey AS VARCHAR(20)), 12, '0') AS isin_code,
 CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lpad(CAST(p_partkey AS VARCHAR(20)), 7, '0') END AS sedol_code, substr(p_name, 1, 5) AS ticker_sym, CASE WHEN p_partkey % 43 = 0 THEN 'E' ELSE 'EQ' END AS sec_type_code,
 CASE WHEN p_partkey % 47 = 0 THEN NULL ELSE 'EQ' END AS asset_cls_code, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '' END AS sub_asset_cls_code, CASE WHEN p_partkey % 53 = 0 THEN 'usd' ELSE 'USD' END AS currency_code,
 CASE WHEN p_partkey % 59 = 0 THEN 'USA' ELSE 'US' END AS country_code, p_brand AS issuer_name, CASE WHEN p_partkey % 61 = 0 THEN DATE '1850-01-01' ELSE DATE '2030-01-01' END AS maturity_dt,
 CAST(CASE WHEN p_partkey % 67 = 0 THEN 0.6 ELSE 0.05 END AS DECIMAL(9, 6)) AS coupon_rate, p_retailprice AS price_amt, CASE WHEN p_partkey % 79 = 0 THEN DATE '2025-01-01' ELSE DATE '2023-06-01' END AS price_dt,
 CAST(1000000 AS DECIMAL(20, 2)) AS mkt_cap_amt, p_brand AS sector_code, CASE WHEN p_partkey % 89 = 0 THEN 'X' ELSE 'A' END AS status_flag FROM part""",
    "asset_classes": """SELECT CASE WHEN n_nationkey = 7 THEN 'A' ELSE concat('C', CAST(n_nationkey AS VARCHAR(20))) END AS asset_cls_code, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_name END AS asset_cls_name,
 CASE WHEN n_nationkey % 5 = 0 THEN 11 ELSE 2 END AS hierarchy_level, CASE WHEN n_nationkey % 6 = 0 THEN 'maybe' ELSE 'Y' END AS is_active FROM nation""",
    "security_classifications": "SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR(20)) END AS sec_id, p_brand AS classification_code, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'GICS' END AS classification_type FROM part",
}


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    source = sql.rsplit(" ", 1)[-1]
    return spark.sql(sql.removesuffix(source) + "{df}", df=table(spark, sf_dir, source))


# What the checks say, in SQL: (name, category, severity, observed, base, whether it passes).


def _quoted(values_: list | tuple) -> str:
    return ", ".join(f"'{v}'" for v in values_)


def _row(name: str, category: str, ok: str, column: str, given: str = "true", severity: str = "error", mostly: float | None = None) -> tuple:
    """ok: what a row must satisfy; null passes."""
    base = f"count(*) FILTER (WHERE ({given}) AND {column} IS NOT NULL)"
    bad = f"count(*) FILTER (WHERE ({given}) AND NOT ({ok}))"
    return name, category, severity, bad, base, f"{bad} <= {(1 - mostly)!r} * {base} + 1e-9" if mostly is not None else f"{bad} = 0"


def _filled(c: str) -> tuple:
    return f"not_null_{c}", "Completeness", "error", f"count(*) - count({c})", "count(*)", f"count(*) = count({c})"


def _long(c: str, low: int, high: int, **k) -> tuple:
    return _row(f"length_between_{c}", "Format", f"length({c}) BETWEEN {low} AND {high}", c, **k)


def _exact(c: str, n: int, **k) -> tuple:
    return _row(f"length_{c}", "Format", f"length({c}) = {n}", c, **k)


def _shaped(c: str, pattern: str, **k) -> tuple:
    return _row(f"matches_{c}", "Format", f"regexp_matches({c}, '{pattern}')", c, **k)


def _ranged(c: str, low: str, high: str, **k) -> tuple:
    return _row(f"between_{c}", "Range", f"{c} BETWEEN {low} AND {high}", c, **k)


def _listed(c: str, allowed, kind: str = "accepted_values", **k) -> tuple:
    return _row(f"{kind}_{c}", "Validity", f"{c}::VARCHAR IN ({_quoted(allowed)})", c, **k)


def _whole(name: str, category: str, observed: str, passes: str, severity: str = "error") -> tuple:
    return name, category, severity, observed, "count(*)", passes


def _distinct(name: str, c: str) -> tuple:
    return _whole(name, "Uniqueness", f"count({c}) - count(DISTINCT {c})", f"count({c}) = count(DISTINCT {c})")


def _typed(c: str) -> tuple:
    return _whole(f"type_{c}", "Schema", "0", "true")


def _sql(source: str, title: str, specs: list[tuple]) -> str:
    lines = (
        f"SELECT '{title}' AS table_name, '{name}' AS check_name, '{category}' AS category, '{severity}' AS severity, ({observed})::DOUBLE AS observed, ({base})::BIGINT AS base_rows, CASE WHEN {passes} THEN 'PASS' ELSE '{'WARN' if severity == 'warn' else 'FAIL'}' END AS status FROM ({source})"
        for name, category, severity, observed, base, passes in specs
    )
    return " UNION ALL ".join(lines)


_DAYS = "DATE '1900-01-01'", "DATE '2100-12-31'"
_PRICED = "DATE '2020-01-01'", "DATE '2024-01-01'"
_MART_SPECS = [
    ("security_id_given", "Expression", "error", "count(*) - count(SECURITY_ID)", "count(*)", "count(*) = count(SECURITY_ID)"),
    _distinct("unique_combination_SECURITY_ID", "SECURITY_ID"), _distinct("unique_SECURITY_ID", "SECURITY_ID"), _filled("SECURITY_ID"), _typed("SECURITY_ID"), _long("SECURITY_ID", 1, 50),
    _exact("CUSIP", 9), _shaped("CUSIP", "^[A-Z0-9]{9}$"), _exact("ISIN", 12), _shaped("ISIN", "^[A-Z]{2}[A-Z0-9]{10}$"), _exact("SEDOL", 7), _shaped("SEDOL", "^[A-Z0-9]{7}$"), _long("TICKER_SYMBOL", 1, 20),
    _filled("SECURITY_NAME"), _long("SECURITY_NAME", 1, 100), _long("SECURITY_DESCRIPTION", 0, 255), _long("ISSUER_NAME", 0, 100),
    _filled("ASSET_CLASS_CODE"), _listed("ASSET_CLASS_CODE", suites.CLASS_CODES), _shaped("ASSET_CLASS_CODE", "^[A-Z]{2,6}$"), _filled("ASSET_CLASS"), _long("ASSET_CLASS", 1, 100),
    _filled("STRATEGY_CODE"), _shaped("STRATEGY_CODE", "^[A-Z]{2,10}_[A-Z]{2,5}$", given="STRATEGY_CODE <> 'OTHR_DEF'"), _long("STRATEGY_CODE", 1, 20), _filled("STRATEGY_DESCRIPTION"), _long("STRATEGY_DESCRIPTION", 1, 255),
    _filled("SECURITY_TYPE"), _listed("SECURITY_TYPE", suites.SECURITY_TYPES), _exact("BASE_CURRENCY", 3), _shaped("BASE_CURRENCY", "^[A-Z]{3}$"), _listed("BASE_CURRENCY", suites.CURRENCIES, "in_set", severity="warn"),
    _exact("COUNTRY_CODE", 2), _shaped("COUNTRY_CODE", "^[A-Z]{2}$"), _typed("MATURITY_DATE"), _ranged("MATURITY_DATE", *_DAYS), _ranged("COUPON_RATE", "0", "0.3", severity="warn"), _ranged("PRICE", "0", "1000000", severity="warn"),
    _typed("PRICE_DATE"), _ranged("PRICE_DATE", *_PRICED, severity="warn"), _ranged("MARKET_CAP", "0", "10000000000000", severity="warn"), _listed("STATUS", suites.MART_STATUS), _listed("STATUS", suites.MART_STATUS, "in_set"),
    _listed("_L1_MAPPING_METHOD", suites.L1_METHODS), _long("_L1_MAPPING_METHOD", 6, 20), _listed("_L2_MAPPING_METHOD", suites.L2_METHODS), _long("_L2_MAPPING_METHOD", 6, 25), _filled("_SOURCE_CLASS_CODE"), _filled("_TRANSFORMATION_TS"), _typed("_TRANSFORMATION_TS"),
]


@query(_sql(MART, "mart", _MART_SPECS))
def mart_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = made(spark, sf_dir, MART)
    return ck.run(mart, suites.mart_checks(mart, AS_OF), "mart").drop("error")


_ROWS = [_whole("has_rows", "Expression", "count(*)", "count(*) >= 1")]
_SOURCE_SPECS = {
    "securities": [
        *_ROWS, _whole("row_count_between", "Volume", "count(*)", "count(*) BETWEEN 100 AND 1000000", "warn"), _whole("has_active_rows", "Expression", "count(*) FILTER (WHERE status_flag = 'A')", "count(*) FILTER (WHERE status_flag = 'A') >= 1"),
        _distinct("unique_sec_id", "sec_id"), _filled("sec_id"), _long("sec_id", 1, 50), _filled("sec_name"), _long("sec_name", 1, 200), _exact("cusip_num", 9), _shaped("cusip_num", "^[A-Z0-9]{9}$"), _exact("isin_code", 12), _exact("sedol_code", 7),
        _long("ticker_sym", 1, 20), _filled("sec_type_code"), _long("sec_type_code", 2, 20), _filled("asset_cls_code"), _long("sub_asset_cls_code", 1, 50), _exact("currency_code", 3), _shaped("currency_code", "^[A-Z]{3}$"), _exact("country_code", 2),
        _shaped("country_code", "^[A-Z]{2}$"), _long("issuer_name", 1, 200), _ranged("maturity_dt", *_DAYS), _ranged("coupon_rate", "0", "0.5", severity="warn"), _ranged("price_amt", "0", "1000000", severity="warn"), _ranged("price_dt", *_PRICED, severity="warn"),
        _ranged("mkt_cap_amt", "0", "10000000000000", severity="warn"), _long("sector_code", 1, 50), _listed("status_flag", suites.SOURCE_STATUS), _listed("status_flag", suites.SOURCE_STATUS, "in_set"),
    ],
    "asset_classes": [
        *_ROWS, _whole("row_count_between", "Volume", "count(*)", "count(*) BETWEEN 10 AND 1000", "warn"), _distinct("unique_asset_cls_code", "asset_cls_code"), _filled("asset_cls_code"), _long("asset_cls_code", 1, 50), _filled("asset_cls_name"),
        _long("asset_cls_name", 1, 200), _filled("hierarchy_level"), _ranged("hierarchy_level", "1", "10"), _listed("is_active", ("true", "false", "Y", "N", "1", "0")),
    ],
    "security_classifications": [*_ROWS, _filled("sec_id"), _long("classification_code", 1, 50), _long("classification_type", 1, 50)],
}


@query(" UNION ALL ".join(_sql(SOURCES[t], t, specs) for t, specs in _SOURCE_SPECS.items()))
def source_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, checks in suites.source_checks(AS_OF).items():
        part = ck.run(made(spark, sf_dir, SOURCES[name]), checks, name).drop("error")
        out = part if out is None else out.unionByName(part)
    return out


_SHARE = "count(DISTINCT SECURITY_ID)::DOUBLE / nullif(count(SECURITY_ID), 0)"
_EXPECTED = [
    _distinct("unique_SECURITY_ID", "SECURITY_ID"), _filled("SECURITY_ID"), *map(_filled, ("SECURITY_NAME", "ASSET_CLASS_CODE", "ASSET_CLASS", "STRATEGY_CODE", "STRATEGY_DESCRIPTION", "SECURITY_TYPE", "STATUS")),
    _exact("BASE_CURRENCY", 3, mostly=0.99), _exact("COUNTRY_CODE", 2, mostly=0.99), _exact("CUSIP", 9, mostly=0.99), _listed("STATUS", suites.MART_STATUS, "in_set"), _listed("SECURITY_TYPE", suites.SECURITY_TYPES, "in_set"),
    _listed("_L1_MAPPING_METHOD", suites.L1_METHODS, "in_set"), _listed("_L2_MAPPING_METHOD", suites.L2_METHODS, "in_set"), _ranged("PRICE", "0", "1000000", mostly=0.99), _ranged("COUPON_RATE", "0", "0.5", mostly=0.99),
    _shaped("BASE_CURRENCY", "^[A-Z]{3}$", mostly=0.99), _shaped("COUNTRY_CODE", "^[A-Z]{2}$", mostly=0.99), _whole("row_count_between", "Volume", "count(*)", "count(*) BETWEEN 100 AND 1000000"), _whole("unique_share_SECURITY_ID", "Uniqueness", _SHARE, f"{_SHARE} BETWEEN 0.99 AND 1.0"),
]


@query(_sql(MART, "expectations", _EXPECTED))
def expectation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.run(made(spark, sf_dir, MART), suites.expectations(), "expectations").drop("error")


_FALLBACK = "coalesce(count(*) FILTER (WHERE _L1_MAPPING_METHOD = 'FALLBACK')::DOUBLE / nullif(count(*), 0), 0)"
_IN_PROCESS = [
    *(_whole(f"exists_{c}", "Schema", "0", "true") for c in ("SECURITY_ID", "STRATEGY_CODE", "STRATEGY_DESCRIPTION", "_L1_MAPPING_METHOD", "_L2_MAPPING_METHOD")),
    *map(_filled, ("SECURITY_ID", "SECURITY_NAME", "ASSET_CLASS_CODE", "ASSET_CLASS", "STRATEGY_CODE", "STRATEGY_DESCRIPTION", "SECURITY_TYPE")),
    _whole("duplicate_excess_SECURITY_ID", "Uniqueness", "count(*) - count(DISTINCT SECURITY_ID)", "count(*) = count(DISTINCT SECURITY_ID)"),
    _listed("ASSET_CLASS_CODE", suites.CLASS_CODES), _listed("SECURITY_TYPE", suites.SECURITY_TYPES), _listed("STATUS", suites.MART_STATUS), _listed("_L1_MAPPING_METHOD", suites.L1_METHODS), _listed("_L2_MAPPING_METHOD", suites.L2_METHODS),
    _exact("BASE_CURRENCY", 3), _exact("COUNTRY_CODE", 2), _row("no_code_leakage", "Business Rule", " AND ".join(f"ASSET_CLASS NOT LIKE '%{c}%'" for c in suites.LEAKED), "ASSET_CLASS"),
    _whole("l1_fallback_share", "Business Rule", _FALLBACK, f"{_FALLBACK} <= 0.2"), ("has_strategy", "Business Rule", "error", "count(*) - count(STRATEGY_CODE)", "count(*)", "count(*) = count(STRATEGY_CODE)"),
]


@query(_sql(MART, "in process", _IN_PROCESS))
def in_process_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = made(spark, sf_dir, MART)
    return ck.run(mart, suites.in_process_checks(mart), "in process").drop("error")


_ERRORS_SQL = "SELECT * FROM (VALUES ('spoilt', 'unknown', 'Expression', 'ERROR'), ('spoilt', 'refused', 'Expression', 'ERROR')) v(table_name, check_name, category, status)"


@query(f"{_ERRORS_SQL} UNION ALL SELECT 'spoilt', 'not_null_p_name', 'Completeness', CASE WHEN count(*) = count(p_name) THEN 'PASS' ELSE 'FAIL' END FROM part UNION ALL SELECT 'spoilt', 'positive', 'Expression', CASE WHEN count(*) FILTER (WHERE p_size <= 0) = 0 THEN 'PASS' ELSE 'FAIL' END FROM part")
def failing_checks_are_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check of a column that isn't there, and one that breaks on the rows, beside two that run."""
    checks = [ck.not_null("p_name"), ck.expression("unknown", F.col("no_such_column") > 0), ck.expression("refused", F.col("p_brand").cast("int") > 0), ck.expression("positive", F.col("p_size") > 0)]
    return ck.run(table(spark, sf_dir, "part"), checks, "spoilt").select("table_name", "check_name", "category", "status")


LINEAGE = [
    (1, "money", "src", "price", "eod", "price", "all", "price", "DWH", "price", " Mapped ", None), (2, "money", "src", "price", "eod", "price", "all", "price", "dwh", "price", "exists", "MAIN"),
    (3, "x", "src", "a", "eod", "a", "all", "a", "dwh", "a", "missing", "MAIN"), (4, "x", "src", "a", "eod", "a", "all", "a", "dwh", "a", None, "MAIN"), (5, "x", "src", "a", "eod", "a", "all", "a", "dwh", "a", "mapped", "OTHER"), (6, "x", "src", "a", "eod", "a", "all", "a", "dwh2", "a", "mapped", "MAIN"),
]
LINEAGE_COLUMNS = "lineage_id functional_group src_source_table src_source_column stg1_source_table stg1_source_column stg2_source_table stg2_source_column dwh_target_table dwh_target_column lineage_status data_source"
LINEAGE_TYPES = "INTEGER" + " VARCHAR" * 11


@query(f"SELECT lineage_id, functional_group AS fgroup, src_source_table AS src_table, dwh_target_table AS dwh_table FROM {values(LINEAGE, LINEAGE_COLUMNS, LINEAGE_TYPES)} WHERE lower(trim(coalesce(lineage_status, 'x'))) IN ('mapped', 'exists') AND coalesce(data_source, 'MAIN') = 'MAIN' AND upper(dwh_target_table) = 'DWH'")
def lineage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = va.load_chains(frame(spark, LINEAGE, LINEAGE_COLUMNS, LINEAGE_TYPES), "MAIN", "Dwh")
    return found.select("lineage_id", "fgroup", "src_table", "dwh_table")
