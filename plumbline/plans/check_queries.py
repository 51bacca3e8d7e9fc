"""Checks, reconciliation and mapping over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import rounded
from plumbline.operators import checks as ck
from plumbline.operators import mapping as mp
from plumbline.operators import relational as rl
from plumbline.plans.base import frame, query, table, values
from plumbline.sources.tables import freshness

# Orders with some values taken away or spoilt, so that checks have something to find.
SPOILT_SQL = """SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 53 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority FROM orders"""


def spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "*",
        F.when(key % 97 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 89 == 0, None).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(key % 53 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"),
    )


@query(
    f"""WITH o AS ({SPOILT_SQL}),
k AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d, count(o_orderkey) AS nn FROM o),
r AS (
 SELECT 'not_null_status' AS check_name, 'Completeness' AS category, 'error' AS severity, count(*) FILTER (WHERE status IS NULL) AS observed, count(*) AS base_rows, 0.0 AS allowed FROM o
 UNION ALL SELECT 'not_null_o_custkey', 'Completeness', 'error', count(*) FILTER (WHERE o_custkey IS NULL), count(*), 0 FROM o
 UNION ALL SELECT 'accepted_values_status', 'Validity', 'error', count(*) FILTER (WHERE status NOT IN ('F', 'O', 'P')), count(status), 0 FROM o
 UNION ALL SELECT 'in_set_priority', 'Validity', 'warn', count(*) FILTER (WHERE priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')), count(priority), 0 FROM o
 UNION ALL SELECT 'length_status', 'Format', 'error', count(*) FILTER (WHERE length(status) <> 1), count(status), 0 FROM o
 UNION ALL SELECT 'matches_priority', 'Format', 'error', count(*) FILTER (WHERE NOT regexp_matches(priority, '^[1-5]-[A-Z ]+$')), count(priority), 0.05 * count(priority) + 1e-9 FROM o
 UNION ALL SELECT 'between_price', 'Range', 'warn', count(*) FILTER (WHERE NOT price BETWEEN 1000 AND 400000), count(price), 0 FROM o)
SELECT 'orders' AS table_name, check_name, category, severity, observed::DOUBLE AS observed, base_rows,
  CASE WHEN observed <= allowed THEN 'PASS' WHEN severity = 'warn' THEN 'WARN' ELSE 'FAIL' END AS status FROM r
UNION ALL SELECT 'orders', 'unique_o_orderkey', 'Uniqueness', 'error', (nn - d)::DOUBLE, n, CASE WHEN nn - d = 0 THEN 'PASS' ELSE 'FAIL' END FROM k
UNION ALL SELECT 'orders', 'row_count_between', 'Volume', 'error', n::DOUBLE, n, CASE WHEN n BETWEEN 100 AND 1000000 THEN 'PASS' ELSE 'FAIL' END FROM k
UNION ALL SELECT 'orders', 'unique_share_o_orderkey', 'Uniqueness', 'error', d::DOUBLE / nn, n, CASE WHEN d::DOUBLE / nn BETWEEN 0.99 AND 1.0 THEN 'PASS' ELSE 'FAIL' END FROM k"""
)
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.run(spoilt(spark, sf_dir), order_checks(), "orders").drop("error")


def order_checks() -> list[ck.Check]:
    return [
        ck.not_null("status"),
        ck.not_null("o_custkey"),
        ck.accepted("status", ["F", "O", "P"]),
        ck.in_set("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).warn(),
        ck.length_is("status", 1),
        ck.matches("priority", "^[1-5]-[A-Z ]+$").tolerating(0.95),
        ck.between("price", 1000, 400000).warn(),
        ck.unique("o_orderkey"),
        ck.row_count_between(100, 1_000_000),
        ck.unique_share("o_orderkey", 0.99),
    ]


@query(
    f"""WITH o AS ({SPOILT_SQL}), n AS (SELECT count(*) AS rows_, count(*) FILTER (WHERE status IS NULL) AS a, count(*) FILTER (WHERE priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) AS b,
 count(*) FILTER (WHERE NOT price BETWEEN 1000 AND 400000) AS c, count(*) FILTER (WHERE NOT regexp_matches(priority, '^[1-5]-[A-Z ]+$')) AS d, count(*) - count(DISTINCT o_orderkey) AS e FROM o),
s AS (SELECT 10 AS n_checks, (a > 0)::INT + (d > 0.05 * rows_)::INT + (e > 0)::INT + (rows_ NOT BETWEEN 100 AND 1000000)::INT AS n_fail, (b > 0)::INT + (c > 0)::INT AS n_warn FROM n)
SELECT n_checks::BIGINT AS n_checks, (n_checks - n_fail - n_warn)::BIGINT AS n_pass, n_warn::BIGINT AS n_warn, n_fail::BIGINT AS n_fail,
 floor((n_checks - n_fail - n_warn) * 100.0::DOUBLE / n_checks * 10 + 0.5) / 10 AS pass_pct FROM s"""
)
def check_suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.summary(ck.run(spoilt(spark, sf_dir), order_checks(), "orders"))


@query(
    f"""WITH o AS ({SPOILT_SQL})
SELECT 'accepted' AS rule, o_orderkey AS key FROM o WHERE status NOT IN ('F', 'O')
UNION ALL SELECT 'not_null_price', o_orderkey FROM o WHERE price IS NULL AND status = 'F'
UNION ALL SELECT 'priority', o_orderkey FROM o WHERE NOT regexp_matches(priority, '^[1-5]-[A-Z ]+$')"""
)
def failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing records of three checks, found in one scan."""
    checks = [
        ck.Check("accepted", "Validity", ("status",), ok=F.col("status").isin("F", "O")),
        ck.Check("not_null_price", "Completeness", ("price",), ok=F.col("price").isNotNull(), where=F.col("status") == "F"),
        ck.Check("priority", "Format", ("priority",), ok=F.col("priority").rlike("^[1-5]-[A-Z ]+$")),
    ]
    rows = ck.captured(spoilt(spark, sf_dir), checks)
    return rows.select(F.col("check_name").alias("rule"), F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("key"))


@query(
    f"""WITH o AS ({SPOILT_SQL})
SELECT column_name, count(*) AS total_rows, count(*) FILTER (WHERE v IS NULL) AS null_rows FROM (
 SELECT unnest(['status', 'price', 'priority', 'o_custkey']) AS column_name, unnest([status, price::VARCHAR, priority, o_custkey::VARCHAR]) AS v FROM o) GROUP BY column_name"""
)
def not_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["status", "price", "priority", "o_custkey"]
    wide = spoilt(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_rows"), *(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), "total_rows", F.col(f"n_{c}").alias("null_rows")) for c in cols))))


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS key_excess, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS pair_excess FROM lineitem")
def unique_key_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    keys = df.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    per_order = keys.groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    total = F.sum("n")
    return per_order.agg((total - F.count(F.lit(1))).alias("key_excess"), (total - F.sum("pairs")).alias("pair_excess"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT 'part' AS table_name, count(*) FILTER (WHERE length(p_brand) <> 8)::BIGINT AS bad_length, count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#[1-4]?[0-9]$'))::BIGINT AS bad_pattern,
 count(*) FILTER (WHERE p_size < 40 AND length(p_name) NOT BETWEEN 5 AND 12)::BIGINT AS bad_conditional FROM part"""
)
def length_and_regex_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(
        F.lit("part").alias("table_name"),
        F.count_if(F.length("p_brand") != 8).alias("bad_length"),
        F.count_if(~F.col("p_brand").rlike("^Brand#[1-4]?[0-9]$")).alias("bad_pattern"),
        F.count_if((F.col("p_size") < 40) & ~F.length("p_name").between(5, 12)).alias("bad_conditional"),
    )


@query(
    """WITH n AS (SELECT count(*) FILTER (WHERE NOT o_totalprice BETWEEN 2000 AND 450000) AS bad, count(o_totalprice) AS base FROM orders),
 m AS (SELECT count(*) FILTER (WHERE NOT regexp_matches(p_type, '^[A-Z ]+$')) AS bad, count(p_type) AS base FROM part)
 SELECT 'between_o_totalprice' AS check_name, bad::DOUBLE AS observed, base AS base_rows, CASE WHEN bad <= (1 - 0.99) * base + 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM n
 UNION ALL SELECT 'matches_p_type', bad::DOUBLE, base, CASE WHEN bad <= (1 - 0.99) * base + 1e-9 THEN 'PASS' ELSE 'FAIL' END FROM m"""
)
def mostly_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ck.run(table(spark, sf_dir, "orders"), [ck.between("o_totalprice", 2000, 450000).tolerating(0.99)])
    b = ck.run(table(spark, sf_dir, "part"), [ck.matches("p_type", "^[A-Z ]+$").tolerating(0.99)])
    return a.unionByName(b).select("check_name", "observed", "base_rows", "status")


@query("SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS right_rows, abs((SELECT count(*) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) AS difference")
def equal_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.count_difference(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey").distinct())


@query(
    """SELECT 'lineitem_part' AS relation, count(*) AS missing_rows, count(DISTINCT l_partkey) AS missing_keys FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'lineitem_supplier', count(*), count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'lineitem_orders', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
)
def relationships_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return rl.reference_summary(
        t("lineitem"),
        [
            ("lineitem_part", "l_partkey", t("part").filter("p_size > 5"), "p_partkey"),
            ("lineitem_supplier", "l_suppkey", t("supplier").filter("s_acctbal > 0"), "s_suppkey"),
            ("lineitem_orders", "l_orderkey", t("orders").filter("o_orderstatus <> 'P'"), "o_orderkey"),
        ],
    )


@query(
    """SELECT o_orderkey::VARCHAR AS key, 'MISSING_IN_TARGET' AS issue FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)
UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, 'MISSING_IN_SOURCE' FROM lineitem WHERE l_quantity > 10 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def orphans_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_quantity > 10"), "o_orderkey", "l_orderkey")


# Crosswalks

SEED = [("STANDARD", "EQ", "Equity"), ("SMALL", "EQ", "Equity"), ("MEDIUM", "FI", "Fixed income"), ("LARGE", "ALT", "Alternatives"), ("LARGE", "RE", "Real estate")]
SEED_COLUMNS, SEED_TYPES = "src_code l1_code l1_name", "VARCHAR VARCHAR VARCHAR"
DEFAULTS = [("EQ", "EQ_DEF"), ("ALT", "ALT_DEF")]
TREE = [("A", None), ("B", "A"), ("C", "B"), ("D", "C"), ("E", "X"), ("F", "F"), ("STANDARD", "TOP"), ("G", "H"), ("H", "G"), ("I", "SMALL")]


@query(
    f"""SELECT p.p_partkey, split_part(p.p_type, ' ', 1) AS fine, p.coarse, s.l1_code AS expected FROM (SELECT *, CASE WHEN p_size > 25 THEN 'EQ' ELSE 'FI' END AS coarse FROM part) p
JOIN {values(SEED, SEED_COLUMNS, SEED_TYPES)} s ON split_part(p.p_type, ' ', 1) = s.src_code WHERE p.coarse <> s.l1_code"""
)
def l1_l2_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("fine"), F.when(F.col("p_size") > 25, "EQ").otherwise("FI").alias("coarse"))
    out = rl.pair_inconsistencies(rows, frame(spark, SEED, SEED_COLUMNS, SEED_TYPES), "fine", "coarse", "src_code", "l1_code")
    return out.select("p_partkey", "fine", "coarse", "expected")


@query(
    """WITH p AS (SELECT p_partkey, p_brand, replace(p_name, ' ', CASE WHEN p_size % 10 = 0 THEN '_' ELSE ' ' END) AS kind FROM part)
SELECT p_partkey AS id, 'p_brand' AS field, 'contains #17' AS issue, p_brand AS value FROM p WHERE contains(lower(p_brand), '#17')
UNION ALL SELECT p_partkey, 'kind', 'contains Widget', kind FROM p WHERE contains(lower(kind), 'widget')
UNION ALL SELECT p_partkey, 'kind', 'contains marker', kind FROM p WHERE contains(kind, '_')"""
)
def code_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 10 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name")).alias("kind"))
    out = rl.code_leakage(rows, "p_partkey", ["kind"], ["Widget"])
    return out.unionByName(rl.code_leakage(rows, "p_partkey", ["p_brand"], ["#17"], marker=None))


MAPPED_SQL = f"""k AS (SELECT src_code, min(l1_code) AS l1 FROM {values(SEED, SEED_COLUMNS, SEED_TYPES)} GROUP BY src_code),
d AS (SELECT * FROM {values(DEFAULTS, 'class_code strategy', 'VARCHAR VARCHAR')}),
p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS code, CASE WHEN p_size % 2 = 0 THEN 'LARGE' ELSE 'NONE' END AS top, p_brand FROM part),
m1 AS (SELECT p.*, coalesce(a.l1, b.l1, 'OTHR') AS l1_code, CASE WHEN a.l1 IS NOT NULL THEN 'DIRECT' WHEN b.l1 IS NOT NULL THEN 'PARENT_ROLLUP' ELSE 'FALLBACK' END AS l1_method
       FROM p LEFT JOIN k a ON p.code = a.src_code LEFT JOIN k b ON p.top = b.src_code),
m AS (SELECT m1.*, coalesce(CASE WHEN p_brand = 'Brand#11' THEN 'B_ONE' END, d.strategy, 'OTHR_DEF') AS l2_code,
       CASE WHEN p_brand = 'Brand#11' THEN 'DIRECT' WHEN d.strategy IS NOT NULL THEN 'ASSET_CLASS_DEFAULT' ELSE 'FALLBACK' END AS l2_method FROM m1 LEFT JOIN d ON m1.l1_code = d.class_code)"""


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("code"), F.when(F.col("p_size") % 2 == 0, "LARGE").otherwise("NONE").alias("top"), "p_brand")
    out = mp.map_class(rows, "code", "top", frame(spark, SEED, SEED_COLUMNS, SEED_TYPES), "src_code", "l1_code")
    strategies = frame(spark, [("Brand#11", "B_ONE")], "brand strategy", "VARCHAR VARCHAR")
    return mp.map_strategy(out, "p_brand", "l1_code", strategies, "brand", "strategy", frame(spark, DEFAULTS, "class_code strategy", "VARCHAR VARCHAR"), "class_code", "strategy")


@query(f"WITH {MAPPED_SQL} SELECT p_partkey, l1_code, l1_method, l2_code, l2_method FROM m")
def tiered_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).select("p_partkey", "l1_code", "l1_method", "l2_code", "l2_method")


@query(f"WITH {MAPPED_SQL} SELECT l1_code, l2_code, count(*) AS n_rows FROM m GROUP BY ALL")
def mapping_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.distribution(mapped(spark, sf_dir), ["l1_code", "l2_code"])


@query(
    f"""WITH {MAPPED_SQL}, n AS (SELECT count(*) AS t, count(*) FILTER (WHERE l1_method = 'FALLBACK') AS a, count(*) FILTER (WHERE l2_method = 'FALLBACK') AS b FROM m)
SELECT 'L1' AS level, a AS fallback_rows, t AS total_rows, floor(a * 100.0::DOUBLE / t * 100 + 0.5) / 100 AS fallback_pct, CASE WHEN floor(a * 100.0::DOUBLE / t * 100 + 0.5) / 100 > 20 THEN 'FAIL' ELSE 'PASS' END AS status FROM n
UNION ALL SELECT 'L2', b, t, floor(b * 100.0::DOUBLE / t * 100 + 0.5) / 100, CASE WHEN floor(b * 100.0::DOUBLE / t * 100 + 0.5) / 100 > 25 THEN 'FAIL' ELSE 'PASS' END FROM n"""
)
def fallback_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.fallback_shares(mapped(spark, sf_dir), {"L1": ("l1_method", 20.0), "L2": ("l2_method", 25.0)})


@query(
    f"""WITH c AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS code, upper(split_part(p_name, ' ', 1)) AS up FROM part), s AS (SELECT DISTINCT src_code FROM {values(SEED, SEED_COLUMNS, SEED_TYPES)})
SELECT 'MISSING_CODE' AS issue, code, count(DISTINCT code) AS affected FROM c WHERE code NOT IN (SELECT src_code FROM s) GROUP BY code
UNION ALL SELECT 'MISSING_PARENT', up, count(DISTINCT code) FROM c WHERE up NOT IN (SELECT src_code FROM s) AND up NOT IN (SELECT code FROM c) GROUP BY up"""
)
def seed_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("code"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("up"))
    return rl.seed_gaps(rows, "code", "up", frame(spark, SEED, SEED_COLUMNS, SEED_TYPES), "src_code")


@query(
    f"""WITH RECURSIVE t AS (SELECT * FROM {values(TREE, 'code parent', 'VARCHAR VARCHAR')}),
r(code, top_code, level) AS (SELECT code, code, 1 FROM t UNION ALL
 SELECT r.code, t.parent, r.level + 1 FROM r JOIN t ON r.top_code = t.code JOIN t u ON u.code = t.parent WHERE t.parent <> t.code AND r.level < 10)
SELECT code, arg_max(top_code, level) AS top_code, max(level)::INTEGER AS level FROM r WHERE code NOT IN ('F', 'G', 'H') GROUP BY code"""
)
def hierarchy_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mp.top_levels(frame(spark, TREE, "code parent", "VARCHAR VARCHAR"), "code", "parent")
    return out.filter(~F.col("code").isin("F", "G", "H"))


@query(f"SELECT code, parent FROM {values(TREE, 'code parent', 'VARCHAR VARCHAR')} t WHERE parent IS NOT NULL AND parent NOT IN (SELECT code FROM {values(TREE, 'code parent', 'VARCHAR VARCHAR')} u)")
def self_hierarchy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = frame(spark, TREE, "code parent", "VARCHAR VARCHAR")
    return rl.missing_references(tree, "parent", tree, "code")


@query(
    """SELECT id, field, issue, value FROM (
 SELECT l_orderkey::VARCHAR AS id, 'l_discount' AS field, 'out of range' AS issue, l_discount::DECIMAL(10, 2)::VARCHAR AS value FROM lineitem WHERE l_discount > 0.09
 UNION ALL SELECT l_orderkey::VARCHAR, 'l_shipdate', 'too late', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-11-01'
 UNION ALL SELECT l_orderkey::VARCHAR, 'l_quantity', 'not positive', l_quantity::BIGINT::VARCHAR FROM lineitem WHERE l_quantity < 2)"""
)
def type_consistency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three range rules in one scan."""
    df = table(spark, sf_dir, "lineitem")
    return rl.rule_violations(
        df,
        "l_orderkey",
        [
            ("l_discount", "out of range", F.col("l_discount") > 0.09, F.col("l_discount").cast("decimal(10,2)")),
            ("l_shipdate", "too late", F.col("l_shipdate") > F.lit("1998-11-01").cast("timestamp_ntz"), F.date_format("l_shipdate", "yyyy-MM-dd")),
            ("l_quantity", "not positive", F.col("l_quantity") < 2, F.col("l_quantity").cast("bigint")),
        ],
    )


@query(
    """WITH m AS (SELECT max(ts) AS last FROM events), a AS (SELECT strftime(last, '%Y-%m-%d %H:%M:%S') AS last_loaded, floor(epoch(TIMESTAMP '2030-01-01 00:00:00' - last) / 3600.0) AS age FROM m)
SELECT last_loaded, age::BIGINT AS age_hours, CASE WHEN age > 48 THEN 'FAIL' WHEN age > 24 THEN 'WARN' ELSE 'PASS' END AS status FROM a"""
)
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = freshness(table(spark, sf_dir, "events"), "ts", datetime(2030, 1, 1))
    return out.select(F.date_format("last_loaded", "yyyy-MM-dd HH:mm:ss").alias("last_loaded"), F.floor("age_hours").alias("age_hours"), "status")


@query(
    """SELECT o_orderpriority, count(*) AS n_rows, floor(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () * 100 + 0.5) / 100 AS pct FROM orders GROUP BY o_orderpriority"""
)
def priority_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a few groups of all rows: the total is that of the groups, not a second scan."""
    groups = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"))
    total = groups.agg(F.sum("n_rows").alias("t"))
    return groups.join(total, F.lit(True)).select("o_orderpriority", "n_rows", rounded(F.col("n_rows") * 100.0 / F.col("t"), 2).alias("pct"))
