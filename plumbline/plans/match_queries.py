"""Matching, SQL-text analysis, lineage and extraction: on inline metadata, embeddings and documents."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import extraction as ex
from plumbline.operators import matching as mt
from plumbline.plans.base import frame, query, table, values
from plumbline.sources.sinks import audit, latest_status

INTERFACES = [
    (1, "Ledger", "Daily Positions", "holdings by account", "Extract", "CORE", "WAREHOUSE", "Inbound", "1,0"),
    (2, "Ledger", "Trade Feed", "trades", "Extract", "CORE", "RISK", "Outbound", "0.6,0.8"),
    (3, "CRM", "customer-master", "customers", "Report", "CRM_DB", "MDM", "Inbound", "0,1"),
    (4, "Pricing", None, "prices", "Load", "VENDOR", "WAREHOUSE", None, "1,0"),
    (5, "nan", "x", None, "None", "", "", "Outbound", "0.8,0.6"),
]
QUERIES = [
    (10, "ledger_system", "daily_positions.sql", "daily positions", "core.positions, core.accounts", "select a from core.positions join core.accounts on 1 = 1 where b > 1 group by a", "extract job", "1,0"),
    (11, "Ledger", "trade.sql", "get trade feed", "CORE.trades", "WITH t AS (SELECT case when x then 1 end FROM trades) SELECT * FROM t UNION SELECT * FROM (SELECT 1)", "Extract", "0.6,0.8"),
    (12, "MDM", "customermaster.sql", "customers", "crmdb.customer", "select * from crm_db.customer\nwhere name like 'a%' order by 1", "report", "0,1"),
    (13, "Pricing", None, None, "vendor_prices", None, "load", "1,0"),
]
FEEDS = [("core banking", "warehouse", "Outbound", None), ("core", "risk", None, "Outbound"), ("crm_db", "mdm", "Inbound", "Outbound"), (None, "x", "Inbound", None)]
I_COLUMNS, I_TYPES = "interface_id application integration description type source_system target_system inbound_outbound vec", "INTEGER VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR"
Q_COLUMNS, Q_TYPES = "query_id system file queryname tables sqltext type vec", "INTEGER VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR"
F_COLUMNS, F_TYPES = "source_system target_system direction_to_hub direction_to_app", "VARCHAR VARCHAR VARCHAR VARCHAR"


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.transform(F.split("vec", ","), lambda x: x.cast("double"))).drop("vec")


def interfaces(spark: SparkSession) -> DataFrame:
    return _vectors(frame(spark, INTERFACES, I_COLUMNS, I_TYPES))


def sql_queries(spark: SparkSession) -> DataFrame:
    return _vectors(frame(spark, QUERIES, Q_COLUMNS, Q_TYPES))


def feeds(spark: SparkSession) -> DataFrame:
    return frame(spark, FEEDS, F_COLUMNS, F_TYPES)


def _safe(c: str) -> str:
    return f"coalesce(CASE WHEN trim({c}) NOT IN ('nan', 'None', '') THEN trim({c}) END, '')"


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({_safe(c)}), '[_ -]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _match_sql() -> str:
    either = lambda a, b: f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"
    i = ", ".join(f"{_norm(c)} AS n_{c}" for c in ("application", "integration", "description", "type", "source_system"))
    q = ", ".join(f"{_norm(c)} AS m_{c}" for c in ("system", "file", "queryname", "tables", "type"))
    return f"""i AS (SELECT *, {i} FROM {values(INTERFACES, I_COLUMNS, I_TYPES)}), q AS (SELECT *, {q} FROM {values(QUERIES, Q_COLUMNS, Q_TYPES)}),
s1 AS (SELECT i.*, q.query_id, q.system AS sql_system, q.file AS sql_file, q.queryname, q.tables, q.sqltext, least(60,
 CASE WHEN {either("n_application", "m_system")} THEN 15 ELSE 0 END
 + CASE WHEN {either("n_integration", "m_queryname")} THEN 15 WHEN n_integration <> '' AND n_integration = m_queryname THEN 4 ELSE 0 END
 + CASE WHEN {either("n_integration", "m_file")} THEN 5 WHEN n_integration <> '' AND n_integration = m_file THEN 2 ELSE 0 END
 + CASE WHEN n_source_system <> '' AND m_tables <> '' AND contains(m_tables, n_source_system) THEN 10 ELSE 0 END
 + CASE WHEN n_type <> '' AND m_type <> '' AND contains(m_type, n_type) THEN 5 ELSE 0 END
 + CASE WHEN n_description <> '' AND n_description = m_queryname THEN 2 ELSE 0 END) AS step1_score,
 list_dot_product(string_split(i.vec, ',')::DOUBLE[], string_split(q.vec, ',')::DOUBLE[]) AS similarity FROM i, q),
f AS (SELECT lower({_safe("source_system")}) AS fs, lower({_safe("target_system")}) AS ft, coalesce(nullif(lower({_safe("direction_to_hub")}), ''), lower({_safe("direction_to_app")})) AS fd FROM {values(FEEDS, F_COLUMNS, F_TYPES)}),
a AS (SELECT interface_id, lower({_safe("source_system")}) AS s, lower({_safe("target_system")}) AS t, lower({_safe("inbound_outbound")}) AS d FROM i),
s2 AS (SELECT a.interface_id, CASE WHEN bool_or((contains(d, 'inbound') AND contains(fd, 'outbound')) OR (contains(d, 'outbound') AND contains(fd, 'inbound'))) THEN -10 ELSE 0 END AS step2_score
 FROM a LEFT JOIN f ON (s <> '' AND contains(fs, s)) OR (t <> '' AND contains(ft, t)) GROUP BY a.interface_id),
s3 AS (SELECT s1.*, s2.step2_score, CASE WHEN similarity >= 0.85 THEN 25 WHEN similarity >= 0.75 THEN 20 WHEN similarity >= 0.65 THEN 15 WHEN similarity >= 0.55 THEN 10 WHEN similarity >= 0.45 THEN 5 ELSE 0 END AS step3_score FROM s1 JOIN s2 USING (interface_id)),
m AS (SELECT *, greatest(0, least(100, step1_score + step2_score + step3_score)) AS final_score FROM s3),
r AS (SELECT *, CASE WHEN step1_score >= 30 AND final_score >= 70 THEN 'HIGH' WHEN step1_score >= 15 AND final_score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m WHERE final_score >= 20)"""


def matches(spark: SparkSession) -> DataFrame:
    return mt.match(interfaces(spark), sql_queries(spark), feeds(spark), min_score=20)


@query(f"WITH {_match_sql()} SELECT interface_id, query_id, step1_score, step2_score, step3_score, final_score, confidence FROM r")
def match_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark).select("interface_id", "query_id", "step1_score", "step2_score", "step3_score", "final_score", "confidence")


@query(f"WITH {_match_sql()} SELECT confidence, count(*) AS n_matches FROM r GROUP BY confidence")
def match_confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confidence_counts(matches(spark))


@query(f"WITH {_match_sql()} SELECT interface_id, step2_score FROM s2")
def match_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.feed_penalties(interfaces(spark), feeds(spark), "interface_id").select("interface_id", "step2_score")


def _edge_sql() -> str:
    return f"""e AS (SELECT coalesce(nullif({_safe("integration")}, ''), '?') AS i, coalesce(nullif({_safe("source_system")}, ''), '?src') AS s, coalesce(nullif({_safe("target_system")}, ''), '?tgt') AS t, {_safe("queryname")} AS q, {_safe("tables")} AS tb FROM r),
l AS (SELECT q, trim(x) AS x FROM (SELECT q, unnest(string_split(tb, ',')[1:5]) AS x FROM e WHERE q <> '') WHERE trim(x) NOT IN ('', 'nan'))"""


@query(f"WITH {_match_sql()}, {_edge_sql()} SELECT i AS src, s AS dst FROM e UNION SELECT i, t FROM e UNION SELECT CASE WHEN t <> '?tgt' THEN t ELSE s END, q FROM e WHERE q <> '' UNION SELECT q, x FROM l")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.lineage_edges(matches(spark))


@query(f"WITH {_match_sql()}, {_edge_sql()} SELECT id, arg_max(k, o) AS ntype FROM (SELECT i AS id, 'interface' AS k, 0 AS o FROM e UNION ALL SELECT s, 'source', 1 FROM e UNION ALL SELECT t, 'target', 2 FROM e UNION ALL SELECT q, 'sql', 3 FROM e WHERE q <> '' UNION ALL SELECT x, 'table', 4 FROM l) GROUP BY id")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.lineage_nodes(matches(spark))


@query(
    f"""WITH q AS (SELECT query_id, coalesce(sqltext, '') AS raw, upper(coalesce(sqltext, '')) AS up FROM {values(QUERIES, Q_COLUMNS, Q_TYPES)}),
a AS (SELECT query_id, list_sort(list_distinct(list_concat(regexp_extract_all(up, 'FROM\\s+([^\\s,;()]+)', 1), regexp_extract_all(up, 'JOIN\\s+([^\\s,;()]+)', 1)))) AS t, len(regexp_extract_all(up, '\\bJOIN\\b')) AS n_joins,
 contains(up, '(SELECT') OR starts_with(trim(up), 'WITH ') AS has_subquery, contains(up, 'UNION') AS has_union, contains(up, 'GROUP BY') AS has_group_by, contains(up, 'CASE') AND contains(up, 'WHEN') AS has_case_when FROM q),
s AS (SELECT *, len(t) * 2 + n_joins * 3 + has_subquery::INT * 10 + has_group_by::INT * 5 + has_union::INT * 5 + has_case_when::INT * 5 AS score FROM a)
SELECT query_id, array_to_string(t, ',') AS sql_tables, n_joins::INTEGER AS n_joins, has_subquery, has_union, has_group_by, has_case_when, score::INTEGER AS sql_score, CASE WHEN score >= 25 THEN 'High' WHEN score >= 10 THEN 'Medium' ELSE 'Low' END AS complexity FROM s"""
)
def sql_text_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.sql_analysis(sql_queries(spark), "sqltext")
    return out.select("query_id", F.array_join("sql_tables", ",").alias("sql_tables"), "n_joins", "has_subquery", "has_union", "has_group_by", "has_case_when", "sql_score", "complexity")


def _explained_sql() -> str:
    """Sentences by rule, from the analysed text of each match's query."""
    yes = lambda p: f"contains(up, {p})"
    return f"""WITH {_match_sql()}, x AS (SELECT *, coalesce(sqltext, '') AS raw, upper(coalesce(sqltext, '')) AS up, lower(concat_ws(' ', queryname, description)) AS said FROM r),
y AS (SELECT *, len(list_distinct(list_concat(regexp_extract_all(up, 'FROM\\s+([^\\s,;()]+)', 1), regexp_extract_all(up, 'JOIN\\s+([^\\s,;()]+)', 1)))) AS n_tables, len(regexp_extract_all(up, '\\bJOIN\\b')) AS n_joins,
 {yes("'(SELECT'")} OR starts_with(trim(up), 'WITH ') AS sub, {yes("'UNION'")} AS uni, {yes("'GROUP BY'")} AS grp, {yes("'CASE'")} AND {yes("'WHEN'")} AS cas FROM x),
z AS (SELECT *, n_tables * 2 + n_joins * 3 + sub::INT * 10 + grp::INT * 5 + uni::INT * 5 + cas::INT * 5 AS score, concat_ws(', ', CASE WHEN sub THEN 'subqueries' END, CASE WHEN uni THEN 'unions' END, CASE WHEN grp THEN 'grouping' END, CASE WHEN cas THEN 'case rules' END) AS flags FROM y)
SELECT interface_id, query_id, coalesce(nullif({_safe("integration")}, ''), 'The interface') || ' moves '
 || CASE WHEN regexp_matches(said, 'customer|client|account') THEN 'customer or account data' WHEN regexp_matches(said, 'transaction|trade|payment') THEN 'transactions' WHEN regexp_matches(said, 'position|holding|portfolio') THEN 'positions and holdings'
 WHEN regexp_matches(said, 'balance|reconciliation') THEN 'balances to be reconciled' ELSE 'business data' END
 || ' from ' || coalesce(nullif({_safe("source_system")}, ''), 'an unknown source') || ' to ' || coalesce(nullif({_safe("target_system")}, ''), 'an unknown target') AS business_text,
 coalesce(nullif({_safe("queryname")}, ''), 'The query') || ' reads ' || n_tables || ' tables with ' || n_joins || ' joins; ' || coalesce(nullif(flags, ''), 'no special constructs') || '; complexity ' || CASE WHEN score >= 25 THEN 'High' WHEN score >= 10 THEN 'Medium' ELSE 'Low' END AS technical_text,
 substr(regexp_extract(up, '(?s)WHERE\\s+(.+?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|$)', 1), 1, 300) AS where_conditions,
 '[' || array_to_string(list_transform(regexp_extract_all(raw, '(?is)CASE\\s+.*?END')[1:3], lambda b: to_json(b)::VARCHAR), ',') || ']' AS case_blocks FROM z"""


@query(_explained_sql())
def match_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.explanations(mt.sql_analysis(matches(spark), "sqltext"))
    return out.select("interface_id", "query_id", "business_text", "technical_text", "where_conditions", F.to_json("case_blocks").alias("case_blocks"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT list_dot_product(a.v, b.v) AS x FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT CASE WHEN x >= 0.85 THEN 25 WHEN x >= 0.75 THEN 20 WHEN x >= 0.65 THEN 15 WHEN x >= 0.55 THEN 10 WHEN x >= 0.45 THEN 5 ELSE 0 END AS points, count(*) AS n_pairs FROM s GROUP BY ALL"""
)
def semantic_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the vectors whose id is divisible by 20 against all others."""
    e = table(spark, sf_dir, "embeddings")
    return mt.band_counts(e.filter("vec_id % 20 = 0"), e)


@query(
    """SELECT CASE WHEN regexp_matches(lower(text), 'customer|client|account') THEN 'customer' WHEN regexp_matches(lower(text), 'transaction|trade|payment') THEN 'transaction'
 WHEN regexp_matches(lower(text), 'position|holding|portfolio') THEN 'position' WHEN regexp_matches(lower(text), 'balance|reconciliation') THEN 'balance' ELSE 'general' END AS class, count(*) AS n_docs FROM documents GROUP BY ALL"""
)
def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.coalesce(tx.keyword_class("text"), F.lit("general")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_docs"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'mach')")
def row_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(tx.row_contains(["c_name", "c_mktsegment"], "MACH")).select("c_custkey", "c_mktsegment")


@query("SELECT c_mktsegment, count(*) AS n_rows FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3) GROUP BY ALL")
def global_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mt.filtered(table(spark, sf_dir, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3], "c_name": []})
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"))


RUNS = [("r1", "START", "2024-01-01 00:00:00"), ("r1", "COMPLETE", "2024-01-01 01:00:00"), ("r2", "START", "2024-01-02 00:00:00"), ("r2", "FAILED", "2024-01-02 00:10:00"), ("r3", "START", "2024-01-03 00:00:00")]


@query(f"SELECT run_id, arg_max(status, happened) AS status FROM {values(RUNS, 'run_id status happened', 'VARCHAR VARCHAR VARCHAR')} GROUP BY run_id")
def latest_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, RUNS, "run_id status at", "VARCHAR VARCHAR VARCHAR").withColumn("step", F.lit(""))
    return latest_status(events).select("run_id", "status")


@query("SELECT event_type AS action, count(*) AS n_entries, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY event_type")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("ts").alias("at"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return audit(log).select("action", "n_entries", shown("first_at"), shown("last_at"))


# Page tables: a table that goes on over pages, a new one, one without a header, and a page without any.

W = "array<struct<text:string,top:double,bottom:double>>"
PAGE_SCHEMA = f"doc_id long, page_num int, page_height double, table_idx int, top double, words {W}, text_lines array<string>, cells array<array<string>>"


def word(text: str, top: float) -> tuple:
    return (text, top, top + 10)


PAGES = [
    (1, 1, 800.0, 1, 200.0, [word("Customer", 101.0), word("master", 102.0), word("below", 500.0)], ["Customer master"], [["Id", "Name"], ["1", "a"]]),
    (1, 2, 800.0, 1, 100.0, [word("2", 20.0)], ["2"], [["id", "NAME"], ["2", "b"]]),
    (1, 3, 800.0, 1, 280.0, [], [], [["3", "c"]]),
    (1, 4, 800.0, 1, 281.0, [], ["last line"], [["4", "d"]]),
    (1, 4, 800.0, 2, 600.0, [word("Customer", 400.0), word("master", 402.0)], [], [["A", None, "C"], ["x", "y", "z"]]),
    (1, 5, 800.0, None, None, [], [], None),
    (1, 6, 800.0, 1, 50.0, [], [], [["p", "q", "r"]]),
    (2, 1, 800.0, 1, 50.0, [], [], [["only", "header"]]),
    (2, 2, 800.0, 1, 50.0, [word("A heading of more than fifteen", 10.0)], [], [["k", "v"]]),
]
ENTITY_ROWS = [
    (1, "CustomerMaster", "1-3", "Id"), (1, "CustomerMaster", "1-3", "Name"), (1, "LastLine", "4", "col_0"), (1, "LastLine", "4", "col_1"), (1, "CustomerMaster_P4T2", "4", "A"), (1, "CustomerMaster_P4T2", "4", "col_1"),
    (1, "CustomerMaster_P4T2", "4", "C"), (1, "Unknownentity", "6", "p"), (1, "Unknownentity", "6", "q"), (1, "Unknownentity", "6", "r"), (2, "Unknownentity", "1", "only"), (2, "Unknownentity", "1", "header"),
    (2, "AHeadingOfMoreThanFifteen", "2", "k"), (2, "AHeadingOfMoreThanFifteen", "2", "v"),
]


@query(f"SELECT * FROM {values(ENTITY_ROWS, 'doc_id entity pages_label attribute', 'BIGINT VARCHAR VARCHAR VARCHAR')}")
def entity_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ex.entities(spark.createDataFrame(PAGES, PAGE_SCHEMA))
    return ex.attributes(found).select("doc_id", "entity", "pages_label", "attribute")


@query("SELECT * FROM (VALUES (1::BIGINT, 'CustomerMaster', 3), (1, 'LastLine', 1), (1, 'CustomerMaster_P4T2', 1), (1, 'Unknownentity', 0), (2, 'Unknownentity', 0), (2, 'AHeadingOfMoreThanFifteen', 0)) v(doc_id, entity, n_rows)")
def entity_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.entities(spark.createDataFrame(PAGES, PAGE_SCHEMA)).select("doc_id", "entity", F.size("data_rows").alias("n_rows"))


