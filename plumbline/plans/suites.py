"""The declarative suites for a securities mart and its sources, as lists of checks.

Limits are per suite, as suites disagree on some of them on purpose. Dates are compared with a given day, so that a run
can be repeated.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks as ck
from plumbline.operators import relational as rl
from plumbline.operators.checks import Check

# Codes that are accepted.
CLASS_CODES = ("EQD", "EQI", "EQEM", "EQSM", "EQLG", "FIG", "FIC", "FIM", "FIHY", "FIIG", "FIMB", "FIAB", "FITIP", "FIIN", "FIEM", "AHFN", "APRE", "ARET", "ACOM", "AINF", "CASH", "CONV", "PREF", "MLTB", "OTHR")
SECURITY_TYPES = ("EQUITY", "FIXED_INCOME", "OPTION", "FUTURE", "CASH_EQUIV", "CONVERTIBLE", "PREFERRED", "ALTERNATIVE", "OTHER")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "CNY", "HKD", "SGD", "INR", "BRL", "MXN", "KRW", "ZAR", "SEK", "NOK", "DKK", "NZD", "PLN")
MART_STATUS, SOURCE_STATUS = ["A", "I", "U"], ["A", "I", "P", "D"]
L1_METHODS, L2_METHODS = ["DIRECT", "PARENT_ROLLUP", "FALLBACK"], ["DIRECT", "ASSET_CLASS_DEFAULT", "FALLBACK"]
ACTIVE = [True, False, "Y", "N", 1, 0]
# Codes of the source that must not show; as in LIKE, an underscore stands for any character.
LEAKED = ["EQ_DOM", "FI_GOV", "ALT_HF"]
SOURCE_CLASS = "_SOURCE_CLASS_CODE"

MART_REFERENCES = [
    ("SECURITY_ID", "staging", "security_id"),
    ("ASSET_CLASS_CODE", "class_crosswalk", "target_class_code"),
    ("ASSET_CLASS", "class_crosswalk", "target_class"),
    ("STRATEGY_CODE", "strategy_crosswalk", "target_strategy_code"),
    ("STRATEGY_DESCRIPTION", "strategy_crosswalk", "target_strategy_desc"),
    (SOURCE_CLASS, "class_mapping", "source_class_code"),
]
SOURCE_REFERENCES = [("securities", "asset_cls_code", "asset_classes", "asset_cls_code"), ("asset_classes", "parent_cls_code", "asset_classes", "asset_cls_code"), ("security_classifications", "sec_id", "securities", "sec_id")]


def _given(check: Check) -> Check:
    return check.given(F.col(check.columns[0]).isNotNull())


def mart_checks(mart: DataFrame, as_of: date, source_class: str = SOURCE_CLASS) -> list[Check]:
    """The mart's declarative tests, but for references and the row count of staging. source_class: the mart's column that
    keeps the source's class code, whatever it is called there."""
    lengths = lambda c, a, b: ck.length_between(c, a, b)
    return [
        ck.expression("security_id_given", F.col("SECURITY_ID").isNotNull()),
        ck.unique_together(["SECURITY_ID"]),
        ck.unique("SECURITY_ID"),
        ck.not_null("SECURITY_ID"),
        ck.has_type(mart, "SECURITY_ID", "varchar"),
        lengths("SECURITY_ID", 1, 50),
        _given(ck.length_is("CUSIP", 9)),
        _given(ck.matches("CUSIP", "^[A-Z0-9]{9}$")),
        _given(ck.length_is("ISIN", 12)),
        _given(ck.matches("ISIN", "^[A-Z]{2}[A-Z0-9]{10}$")),
        _given(ck.length_is("SEDOL", 7)),
        _given(ck.matches("SEDOL", "^[A-Z0-9]{7}$")),
        _given(lengths("TICKER_SYMBOL", 1, 20)),
        ck.not_null("SECURITY_NAME"),
        lengths("SECURITY_NAME", 1, 100),
        _given(lengths("SECURITY_DESCRIPTION", 0, 255)),
        _given(lengths("ISSUER_NAME", 0, 100)),
        ck.not_null("ASSET_CLASS_CODE"),
        ck.accepted("ASSET_CLASS_CODE", CLASS_CODES),
        ck.matches("ASSET_CLASS_CODE", "^[A-Z]{2,6}$"),
        ck.not_null("ASSET_CLASS"),
        lengths("ASSET_CLASS", 1, 100),
        ck.not_null("STRATEGY_CODE"),
        ck.matches("STRATEGY_CODE", "^[A-Z]{2,10}_[A-Z]{2,5}$").given(F.col("STRATEGY_CODE") != "OTHR_DEF"),
        lengths("STRATEGY_CODE", 1, 20),
        ck.not_null("STRATEGY_DESCRIPTION"),
        lengths("STRATEGY_DESCRIPTION", 1, 255),
        ck.not_null("SECURITY_TYPE"),
        ck.accepted("SECURITY_TYPE", SECURITY_TYPES),
        _given(ck.length_is("BASE_CURRENCY", 3)),
        _given(ck.matches("BASE_CURRENCY", "^[A-Z]{3}$")),
        _given(ck.in_set("BASE_CURRENCY", CURRENCIES)).warn(),
        _given(ck.length_is("COUNTRY_CODE", 2)),
        _given(ck.matches("COUNTRY_CODE", "^[A-Z]{2}$")),
        ck.has_type(mart, "MATURITY_DATE", "date"),
        _given(ck.between("MATURITY_DATE", date(1900, 1, 1), date(2100, 12, 31))),
        _given(ck.between("COUPON_RATE", 0, 0.30)).warn(),
        _given(ck.between("PRICE", 0, 1_000_000)).warn(),
        ck.has_type(mart, "PRICE_DATE", "date"),
        _given(ck.between("PRICE_DATE", date(2020, 1, 1), as_of)).warn(),
        _given(ck.between("MARKET_CAP", 0, 10_000_000_000_000)).warn(),
        ck.accepted("STATUS", MART_STATUS),
        ck.in_set("STATUS", MART_STATUS),
        ck.accepted("_L1_MAPPING_METHOD", L1_METHODS),
        lengths("_L1_MAPPING_METHOD", 6, 20),
        ck.accepted("_L2_MAPPING_METHOD", L2_METHODS),
        lengths("_L2_MAPPING_METHOD", 6, 25),
        ck.not_null(source_class),
        ck.not_null("_TRANSFORMATION_TS"),
        ck.has_type(mart, "_TRANSFORMATION_TS", "timestamp"),
    ]


def source_checks(as_of: date) -> dict[str, list[Check]]:
    """The sources' declarative tests by table, but for references and freshness."""
    rows = ck.measure_between("has_rows", F.count(F.lit(1)), 1, None)
    lengths = lambda c, a, b: ck.length_between(c, a, b)
    return {
        "securities": [
            rows,
            ck.row_count_between(100, 1_000_000).warn(),
            ck.measure_between("has_active_rows", F.count_if(F.col("status_flag") == "A"), 1, None),
            ck.unique("sec_id"),
            ck.not_null("sec_id"),
            lengths("sec_id", 1, 50),
            ck.not_null("sec_name"),
            lengths("sec_name", 1, 200),
            _given(ck.length_is("cusip_num", 9)),
            _given(ck.matches("cusip_num", "^[A-Z0-9]{9}$")),
            _given(ck.length_is("isin_code", 12)),
            _given(ck.length_is("sedol_code", 7)),
            _given(lengths("ticker_sym", 1, 20)),
            ck.not_null("sec_type_code"),
            lengths("sec_type_code", 2, 20),
            ck.not_null("asset_cls_code"),
            _given(lengths("sub_asset_cls_code", 1, 50)),
            _given(ck.length_is("currency_code", 3)),
            _given(ck.matches("currency_code", "^[A-Z]{3}$")),
            _given(ck.length_is("country_code", 2)),
            _given(ck.matches("country_code", "^[A-Z]{2}$")),
            _given(lengths("issuer_name", 1, 200)),
            _given(ck.between("maturity_dt", date(1900, 1, 1), date(2100, 12, 31))),
            _given(ck.between("coupon_rate", 0, 0.50)).warn(),
            _given(ck.between("price_amt", 0, 1_000_000)).warn(),
            _given(ck.between("price_dt", date(2020, 1, 1), as_of)).warn(),
            _given(ck.between("mkt_cap_amt", 0, 10_000_000_000_000)).warn(),
            _given(lengths("sector_code", 1, 50)),
            ck.accepted("status_flag", SOURCE_STATUS),
            ck.in_set("status_flag", SOURCE_STATUS),
        ],
        "asset_classes": [
            rows,
            ck.row_count_between(10, 1000).warn(),
            ck.unique("asset_cls_code"),
            ck.not_null("asset_cls_code"),
            lengths("asset_cls_code", 1, 50),
            ck.not_null("asset_cls_name"),
            lengths("asset_cls_name", 1, 200),
            ck.not_null("hierarchy_level"),
            ck.between("hierarchy_level", 1, 10),
            ck.accepted("is_active", ACTIVE),
        ],
        "security_classifications": [rows, ck.not_null("sec_id"), _given(lengths("classification_code", 1, 50)), _given(lengths("classification_type", 1, 50))],
    }


def expectations() -> list[Check]:
    """The expectation suite, with its tolerances."""
    return [
        ck.unique("SECURITY_ID"),
        ck.not_null("SECURITY_ID"),
        *(ck.not_null(c) for c in ("SECURITY_NAME", "ASSET_CLASS_CODE", "ASSET_CLASS", "STRATEGY_CODE", "STRATEGY_DESCRIPTION", "SECURITY_TYPE", "STATUS")),
        ck.length_is("BASE_CURRENCY", 3).tolerating(0.99),
        ck.length_is("COUNTRY_CODE", 2).tolerating(0.99),
        ck.length_is("CUSIP", 9).tolerating(0.99),
        ck.in_set("STATUS", MART_STATUS),
        ck.in_set("SECURITY_TYPE", SECURITY_TYPES),
        ck.in_set("_L1_MAPPING_METHOD", L1_METHODS),
        ck.in_set("_L2_MAPPING_METHOD", L2_METHODS),
        ck.between("PRICE", 0, 1_000_000).tolerating(0.99),
        ck.between("COUPON_RATE", 0, 0.5).tolerating(0.99),
        ck.matches("BASE_CURRENCY", "^[A-Z]{3}$").tolerating(0.99),
        ck.matches("COUNTRY_CODE", "^[A-Z]{2}$").tolerating(0.99),
        ck.row_count_between(100, 1_000_000),
        ck.unique_share("SECURITY_ID", 0.99, 1.0),
    ]


def in_process_checks(mart: DataFrame) -> list[Check]:
    """The in-process checks of the mart alone."""
    leak = reduce(lambda a, b: a | b, (F.col("ASSET_CLASS").like(f"%{code}%") for code in LEAKED))
    return [
        *(ck.column_exists(mart, c) for c in ("SECURITY_ID", "STRATEGY_CODE", "STRATEGY_DESCRIPTION", "_L1_MAPPING_METHOD", "_L2_MAPPING_METHOD")),
        *(ck.not_null(c) for c in ("SECURITY_ID", "SECURITY_NAME", "ASSET_CLASS_CODE", "ASSET_CLASS", "STRATEGY_CODE", "STRATEGY_DESCRIPTION", "SECURITY_TYPE")),
        ck.duplicate_excess("SECURITY_ID"),
        ck.accepted("ASSET_CLASS_CODE", CLASS_CODES),
        ck.accepted("SECURITY_TYPE", SECURITY_TYPES),
        ck.accepted("STATUS", MART_STATUS),
        ck.accepted("_L1_MAPPING_METHOD", L1_METHODS),
        ck.accepted("_L2_MAPPING_METHOD", L2_METHODS),
        _given(ck.length_is("BASE_CURRENCY", 3)),
        _given(ck.length_is("COUNTRY_CODE", 2)),
        Check("no_code_leakage", "Business Rule", ("ASSET_CLASS",), ok=~leak),
        ck.share_at_most("l1_fallback_share", F.col("_L1_MAPPING_METHOD") == "FALLBACK", 0.2),
        Check("has_strategy", "Business Rule", (), ok=F.col("STRATEGY_CODE").isNotNull()),
    ]


def run_mart_suite(tables: dict[str, DataFrame], as_of: date, source_class: str = SOURCE_CLASS) -> DataFrame:
    """All of the mart's results: declarative tests, references, reconciliation with source and staging."""
    mart = tables["mart"]
    out = ck.run(mart, mart_checks(mart, as_of, source_class), "mart").unionByName(ck.run(mart, in_process_checks(mart), "mart in process")).unionByName(ck.run(mart, expectations(), "mart expectations"))
    out = out.unionByName(ck.run(tables["staging"], [ck.duplicate_excess("security_id")], "staging"))

    def line(name: str, category: str, counted: DataFrame, observed: str) -> DataFrame:
        seen = F.col(observed).cast("double")
        return counted.select(F.lit("mart").alias("table_name"), F.lit(name).alias("check_name"), F.lit(category).alias("category"), F.lit("error").alias("severity"), seen.alias("observed"), F.lit(None).cast("bigint").alias("base_rows"), F.when(seen == 0, "PASS").otherwise("FAIL").alias("status"), F.lit(None).cast("string").alias("error"))

    for key, parent, parent_key in MART_REFERENCES:
        key = source_class if key == SOURCE_CLASS else key
        lost = rl.missing_references(mart, key, tables[parent], parent_key).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(line(f"reference_{key}", "Integrity", lost, "n"))
    for other in ("securities", "staging"):
        out = out.unionByName(line(f"rows_equal_{other}", "Reconciliation", rl.count_difference(mart, tables[other]), "difference"))
    missing = rl.orphans(tables["securities"], mart, "sec_id", "SECURITY_ID").filter("issue = 'MISSING_IN_TARGET'").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(line("no_source_row_missing", "Integrity", missing, "n"))


def type_rules(as_of: date) -> list:
    """Range rules for the mart's numbers and dates: (field, issue, broken, value)."""
    c, late = F.col, F.lit(as_of + timedelta(days=1))
    return [
        ("PRICE", "negative", c("PRICE") < 0, c("PRICE")),
        ("COUPON_RATE", "out of range", (c("COUPON_RATE") < 0) | (c("COUPON_RATE") > 1), c("COUPON_RATE")),
        ("MARKET_CAP", "negative", c("MARKET_CAP") < 0, c("MARKET_CAP")),
        ("MATURITY_DATE", "out of range", (c("MATURITY_DATE") < F.lit(date(1900, 1, 1))) | (c("MATURITY_DATE") > F.lit(date(2100, 12, 31))), c("MATURITY_DATE")),
        ("PRICE_DATE", "in the future", c("PRICE_DATE") > late, c("PRICE_DATE")),
        ("BASE_CURRENCY", "not three characters", F.length("BASE_CURRENCY") != 3, c("BASE_CURRENCY")),
    ]
