"""Column composition, masks, stage metrics and variance over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.masks import assembled, mask
from plumbline.operators import profile as pf
from plumbline.operators import variance as va
from plumbline.plans.base import frame, query, table, values

# Order lines as texts, of every kind of contents.
TEXTS_SQL = """t AS (SELECT l_linenumber::VARCHAR AS whole, l_extendedprice::DECIMAL(12, 2)::VARCHAR AS money, strftime(l_shipdate, '%Y%m%d') AS compact_day, strftime(l_shipdate, '%Y-%m-%d') AS day,
 CASE WHEN l_orderkey % 200 = 0 THEN 'n/a' ELSE l_partkey::VARCHAR END AS spoilt, CASE WHEN l_orderkey % 5 < 3 THEN l_suppkey::VARCHAR ELSE 'text' END AS mixed,
 CASE WHEN l_linenumber % 2 = 0 THEN 'Y' ELSE 'n' END AS flag, lpad(l_partkey::VARCHAR, 8, '0') AS padded, l_returnflag AS word, CASE WHEN l_orderkey % 2 = 0 THEN ' ' END AS nothing,
 CASE WHEN l_orderkey % 3 = 0 THEN '  ' ELSE '.5' END AS fraction FROM lineitem)"""
TEXT_COLUMNS = ["whole", "money", "compact_day", "day", "spoilt", "mixed", "flag", "padded", "word", "nothing", "fraction"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MASKS = [mask("YYYYMMDD"), mask("YYYY-MM-DD")]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col, lambda x: F.col(x).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        s("l_linenumber").alias("whole"),
        c("l_extendedprice").cast("decimal(12,2)").cast("string").alias("money"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("compact_day"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(c("l_orderkey") % 200 == 0, "n/a").otherwise(s("l_partkey")).alias("spoilt"),
        F.when(c("l_orderkey") % 5 < 3, s("l_suppkey")).otherwise("text").alias("mixed"),
        F.when(c("l_linenumber") % 2 == 0, "Y").otherwise("n").alias("flag"),
        F.lpad(s("l_partkey"), 8, "0").alias("padded"),
        c("l_returnflag").alias("word"),
        F.when(c("l_orderkey") % 2 == 0, " ").alias("nothing"),
        F.when(c("l_orderkey") % 3 == 0, "  ").otherwise(".5").alias("fraction"),
    )


def _composition_sql() -> str:
    one = lambda n: (
        f"SELECT '{n}' AS column_name, nullif(trim({n}), '') AS v FROM t"
    )
    long = " UNION ALL ".join(map(one, TEXT_COLUMNS))
    return f"""{TEXTS_SQL}, v AS ({long}),
w AS (SELECT column_name, v, regexp_matches(v, '{NUMBER}') AS num, NOT contains(v, '.') AS plain FROM v),
p AS (SELECT column_name, count(*) AS total, count(v) AS nonnull, count(*) FILTER (WHERE num) AS num_ok, count(*) FILTER (WHERE num AND plain) AS int_ok,
 max(length(regexp_replace(v, '[-+.]', '', 'g'))) FILTER (WHERE num)::BIGINT AS prec_max,
 max(CASE WHEN num AND instr(v, '.') > 0 THEN length(v) - instr(v, '.') ELSE 0 END)::BIGINT AS scale_max,
 count(*) FILTER (WHERE num AND length(v) > 1 AND v[1] = '0' AND v[2] <> '.') AS lead_zero,
 count(*) FILTER (WHERE upper(v) IN ('Y', 'N', 'T', 'F', '0', '1')) AS bool_ok, max(length(v))::BIGINT AS max_len,
 count(*) FILTER (WHERE regexp_matches(v, '^[0-9]{{8}}$') AND try_strptime(v, '%Y%m%d') IS NOT NULL) AS date_0,
 count(*) FILTER (WHERE regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL) AS date_1
 FROM w GROUP BY column_name)"""


@query(f"WITH {_composition_sql()} SELECT *, 'string' AS declared_type FROM p")
def composition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.composition(texts(spark, sf_dir), MASKS)


CLASSES_SQL = f"""{_composition_sql()},
q AS (SELECT *, coalesce(num_ok * 100.0::DOUBLE / nullif(nonnull, 0), 0) AS num, coalesce(int_ok * 100.0::DOUBLE / nullif(nonnull, 0), 0) AS whole_pct,
 coalesce(greatest(date_0, date_1) * 100.0::DOUBLE / nullif(nonnull, 0), 0) AS date_pct, coalesce(bool_ok * 100.0::DOUBLE / nullif(nonnull, 0), 0) AS flag_pct,
 CASE WHEN date_0 > 0 AND date_0 >= date_1 THEN 'YYYYMMDD' WHEN date_1 > 0 THEN 'YYYY-MM-DD' END AS m FROM p),
r AS (SELECT *, CASE WHEN nonnull = 0 THEN 'EMPTY' WHEN flag_pct >= 98 AND num < 98 THEN 'BOOLEAN_FLAG' WHEN date_pct >= 98 AND whole_pct < 98 THEN 'DATE:' || m
 WHEN whole_pct >= 98 AND lead_zero > 0 THEN 'STRING_NUMERICLOOK' WHEN whole_pct >= 98 AND date_pct >= 98 THEN 'DATE:' || m WHEN whole_pct >= 98 THEN 'INTEGER' WHEN num >= 98 THEN 'DECIMAL'
 WHEN greatest(num, date_pct, flag_pct) > 50 THEN 'MIXED' ELSE 'STRING' END AS kind FROM q),
s AS (SELECT *, CASE WHEN kind IN ('EMPTY', 'STRING_NUMERICLOOK') THEN 100.0 WHEN kind = 'BOOLEAN_FLAG' THEN flag_pct WHEN kind LIKE 'DATE:%' THEN date_pct WHEN kind = 'INTEGER' THEN whole_pct
 WHEN kind = 'DECIMAL' THEN num WHEN kind = 'MIXED' THEN greatest(num, date_pct) ELSE 100.0 - greatest(num, date_pct) END::DOUBLE AS conf FROM r),
u AS (SELECT *, CASE WHEN conf < 100 THEN floor(nonnull * (100 - conf) / 100 + 0.5) ELSE 0 END::BIGINT AS bad,
 CASE WHEN kind = 'STRING_NUMERICLOOK' THEN 'IDENTIFIER_LEADING_ZERO' WHEN (kind IN ('INTEGER', 'DECIMAL', 'BOOLEAN_FLAG') OR kind LIKE 'DATE:%') AND conf < 100 THEN 'CAST_UNSAFE' ELSE '' END AS risk FROM s)"""


@query(
    f"""WITH {CLASSES_SQL} SELECT column_name, kind AS inferred_type, floor(conf * 100 + 0.5) / 100 AS conformance_pct, total AS total_rows, nonnull AS nonnull_rows,
 floor((num - whole_pct) * 100 + 0.5) / 100 AS pct_decimal, floor(whole_pct * 100 + 0.5) / 100 AS pct_integer, floor(date_pct * 100 + 0.5) / 100 AS pct_date, floor(flag_pct * 100 + 0.5) / 100 AS pct_bool,
 floor(coalesce((total - nonnull) * 100.0::DOUBLE / total, 0) * 100 + 0.5) / 100 AS pct_blank, floor(coalesce(bad * 100.0::DOUBLE / nullif(nonnull, 0), 0) * 100 + 0.5) / 100 AS pct_bad, bad AS bad_rows,
 CASE WHEN kind LIKE 'DATE:%' OR kind = 'MIXED' THEN m END AS date_mask FROM u"""
)
def classified_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pf.classified(pf.composition(texts(spark, sf_dir), MASKS), MASKS)
    return out.select("column_name", "inferred_type", "conformance_pct", "total_rows", "nonnull_rows", "pct_decimal", "pct_integer", "pct_date", "pct_bool", "pct_blank", "pct_bad", "bad_rows", "date_mask")


@query(
    f"""WITH {CLASSES_SQL} SELECT column_name, risk, CASE risk WHEN 'IDENTIFIER_LEADING_ZERO' THEN 'NEVER cast to NUMBER — leading zeros would be lost; keep VARCHAR2'
 WHEN 'CAST_UNSAFE' THEN format('cast fails ~{{:,}} rows — cleanse before cast', bad) ELSE CASE WHEN kind = 'STRING' THEN 'genuine string' ELSE '' END END AS verdict FROM u"""
)
def risk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.classified(pf.composition(texts(spark, sf_dir), MASKS), MASKS).select("column_name", "risk", "verdict")


@query(
    f"""WITH {_composition_sql()} SELECT column_name, CASE WHEN greatest(date_0, date_1) * 2 >= nonnull AND nonnull > 0 THEN CASE WHEN date_0 > 0 AND date_0 >= date_1 THEN 'YYYYMMDD' WHEN date_1 > 0 THEN 'YYYY-MM-DD' END END AS date_mask,
 greatest(date_0, date_1) AS hits FROM p"""
)
def mask_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.mask_selection(texts(spark, sf_dir), MASKS)


@query(f"WITH {TEXTS_SQL} SELECT 'spoilt' AS column_name, '[\"n/a\"]' AS samples")
def outlier_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pf.outliers(texts(spark, sf_dir), {"spoilt": "INTEGER"}, MASKS)
    return out.select("column_name", F.to_json("samples").alias("samples"))


@query(
    f"""WITH {TEXTS_SQL}, o AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 11 <> 0 THEN l_shipdate END AS shipped FROM lineitem)
SELECT 'quantity' AS column_name, unnest(['CNT', 'NULLS', 'NDV', 'SUM', 'MIN', 'MAX']) AS metric, unnest([count(quantity), count(*) FILTER (WHERE quantity IS NULL), count(DISTINCT quantity), sum(quantity::DECIMAL(18, 6)), min(quantity), max(quantity)]::DOUBLE[]) AS value_num, NULL::VARCHAR AS value_str FROM o
UNION ALL SELECT 'shipped', unnest(['CNT', 'NULLS', 'NDV', 'MIN_D', 'MAX_D']), unnest([count(shipped), count(*) FILTER (WHERE shipped IS NULL), count(DISTINCT shipped), NULL, NULL]::DOUBLE[]), unnest([NULL, NULL, NULL, strftime(min(shipped), '%Y-%m-%d %H:%M:%S'), strftime(max(shipped), '%Y-%m-%d %H:%M:%S')]) FROM o
UNION ALL SELECT 'spoilt', unnest(['CNT', 'NULLS', 'NDV', 'SUM', 'MIN', 'MAX']), unnest([count(spoilt), count(*) FILTER (WHERE spoilt IS NULL), count(DISTINCT spoilt), sum(try_cast(spoilt AS DECIMAL(18, 6))), min(try_cast(spoilt AS DECIMAL(18, 6))), max(try_cast(spoilt AS DECIMAL(18, 6)))]::DOUBLE[]), NULL FROM t
UNION ALL SELECT 'fraction', unnest(['CNT', 'NULLS', 'NDV', 'SUM', 'MIN', 'MAX']), unnest([count(fraction), count(*) FILTER (WHERE fraction IS NULL), count(DISTINCT fraction), sum(try_cast(trim(fraction) AS DECIMAL(18, 6))), min(try_cast(trim(fraction) AS DECIMAL(18, 6))), max(try_cast(trim(fraction) AS DECIMAL(18, 6)))]::DOUBLE[]), NULL FROM t
UNION ALL SELECT c.n, unnest(['CNT', 'NULLS', 'NDV', 'MAXLEN', 'HASHSUM']), unnest([count(v), count(*) FILTER (WHERE v IS NULL), count(DISTINCT v), max(length(nullif(trim(v), ''))), sum(('0x' || substr(md5(nullif(trim(v), '')), 1, 8))::BIGINT)]::DOUBLE[]), NULL
 FROM (SELECT unnest(['word', 'nothing']) AS n, unnest([word, nothing]) AS v FROM t) c GROUP BY c.n"""
)
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of metrics, over columns with nulls and blanks among them."""
    key = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.when(key % 7 != 0, F.col("l_quantity")).alias("quantity"), F.when(key % 11 != 0, F.col("l_shipdate")).alias("shipped"))
    raw = pf.stage_metrics(lines, {"quantity": "RAWNUM", "shipped": "RAWDATE"}, approximate=False)
    return raw.unionByName(pf.stage_metrics(texts(spark, sf_dir), {"spoilt": "NUM", "fraction": "NUM", "word": "STR", "nothing": "STR"}, approximate=False))


@query("SELECT unnest(['l_orderkey', 'l_partkey', 'l_comment', 'l_quantity', 'l_shipdate']) AS column_name, true AS within_a_tenth")
def approximate_ndv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values by sketches, as metrics have them by default, held against exact ones."""
    names = {"l_orderkey": "RAWNUM", "l_partkey": "RAWNUM", "l_comment": "STR", "l_quantity": "RAWNUM", "l_shipdate": "RAWDATE"}
    lines = table(spark, sf_dir, "lineitem").withColumn("l_comment", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    near, exact = (pf.stage_metrics(lines, names, approximate=a).filter("metric = 'NDV'").select("column_name", F.col("value_num").alias(n)) for a, n in ((True, "a"), (False, "b")))
    return near.join(exact, "column_name").select("column_name", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("within_a_tenth"))


# Chains: order lines flow from a source through two feeds that converge, and lose or change something on the way.

CHAINS = [
    (1, "money", "src", "price", "eod", "price", "all", "price", "dwh", "price"),
    (2, "money", "src", "price", "intraday", "price", "all", "price", "dwh", "price"),
    (3, "volume", "src", "quantity", "eod", "quantity", "all", "quantity", "dwh", "quantity"),
    (4, "volume", "src", "quantity", "intraday", "quantity", "all", "quantity", "dwh", "quantity"),
    (5, "flags", "src", "flag", "src", "flag", "all", "flag", "dwh", "flag"),
    (6, "flags", None, None, "src", "flag", "all", "flag", "dwh2", "flag"),
]
CHAIN_COLUMNS = "lineage_id fgroup src_table src_column stg1_table stg1_column stg2_table stg2_column dwh_table dwh_column"
CHAIN_TYPES = "INTEGER VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR"
KINDS = {"price": "RAWNUM", "quantity": "RAWNUM", "flag": "STR"}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), "l_linestatus", "l_orderkey")
    all_ = li.filter("l_orderkey % 10 <> 0")
    dwh = all_.withColumn("flag", F.when(F.col("l_orderkey") % 100 == 1, "Z").otherwise(F.col("flag"))).withColumn("quantity", F.when(F.col("l_orderkey") % 50 != 3, F.col("quantity")))
    return {"src": li, "eod": li.filter("l_linestatus = 'O'"), "intraday": li.filter("l_linestatus = 'F'"), "all": all_, "dwh": dwh, "dwh2": dwh}


def chains(spark: SparkSession) -> DataFrame:
    return frame(spark, CHAINS, CHAIN_COLUMNS, CHAIN_TYPES)


def chain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineage_id, stage, metric, value_num, value_str of all chains: each table's columns are measured once."""
    out = None
    for name, df in _tables(spark, sf_dir).items():
        part = pf.stage_metrics(df, KINDS, approximate=False).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return va.by_stage(chains(spark)).join(out, ["table_name", "column_name"]).select("lineage_id", "stage", "metric", "value_num", "value_str")


VARIANCE_SQL = f"""li AS (SELECT l_extendedprice::DECIMAL(18, 6) AS price, l_quantity::DECIMAL(18, 6) AS quantity, l_returnflag AS flag, l_linestatus, l_orderkey FROM lineitem),
tb AS (SELECT 'src' AS tn, price, quantity, flag FROM li UNION ALL SELECT CASE WHEN l_linestatus = 'O' THEN 'eod' ELSE 'intraday' END, price, quantity, flag FROM li
 UNION ALL SELECT 'all', price, quantity, flag FROM li WHERE l_orderkey % 10 <> 0
 UNION ALL SELECT unnest(['dwh', 'dwh2']), price, CASE WHEN l_orderkey % 50 <> 3 THEN quantity END, CASE WHEN l_orderkey % 100 = 1 THEN 'Z' ELSE flag END FROM li WHERE l_orderkey % 10 <> 0),
me AS (SELECT tn, 'price' AS cn, unnest(['CNT', 'NULLS', 'NDV', 'SUM', 'MIN', 'MAX']) AS metric, unnest([count(price), count(*) - count(price), count(DISTINCT price), sum(price), min(price), max(price)]::DOUBLE[]) AS v FROM tb GROUP BY tn
 UNION ALL SELECT tn, 'quantity', unnest(['CNT', 'NULLS', 'NDV', 'SUM', 'MIN', 'MAX']), unnest([count(quantity), count(*) - count(quantity), count(DISTINCT quantity), sum(quantity), min(quantity), max(quantity)]::DOUBLE[]) FROM tb GROUP BY tn
 UNION ALL SELECT tn, 'flag', unnest(['CNT', 'NULLS', 'NDV', 'MAXLEN', 'HASHSUM']), unnest([count(flag), count(*) - count(flag), count(DISTINCT flag), max(length(flag)), sum(('0x' || substr(md5(flag), 1, 8))::BIGINT)]::DOUBLE[]) FROM tb GROUP BY tn),
ch AS (SELECT * FROM {values(CHAINS, CHAIN_COLUMNS, CHAIN_TYPES)}),
st AS (SELECT DISTINCT dwh_table, dwh_column, stg2_table, stg2_column, unnest(['SRC', 'STG1', 'STG2', 'DWH']) AS stage, unnest([src_table, stg1_table, stg2_table, dwh_table]) AS tn, unnest([src_column, stg1_column, stg2_column, dwh_column]) AS cn FROM ch),
co AS (SELECT dwh_table, dwh_column, stg2_table, stg2_column, stage, metric, CASE WHEN count(*) = 1 THEN max(v) WHEN metric IN ('CNT', 'NULLS', 'SUM', 'HASHSUM') THEN sum(v) WHEN metric IN ('MAX', 'MAXLEN') THEN max(v) WHEN metric = 'MIN' THEN min(v) END AS value_num
 FROM st JOIN me ON st.tn = me.tn AND st.cn = me.cn GROUP BY dwh_table, dwh_column, stg2_table, stg2_column, stage, metric),
mu AS (SELECT dwh_table, dwh_column, stg2_table, stg2_column, count(DISTINCT (stg1_table, stg1_column)) > 1 AS multi FROM ch GROUP BY ALL),
br AS (SELECT a.dwh_table, a.dwh_column, a.stg2_table, a.stg2_column, h.hop, h.a || '->' || h.b AS hop_name, a.metric FROM (VALUES (0, 'SRC', 'STG1'), (1, 'STG1', 'STG2'), (2, 'STG2', 'DWH')) h(hop, a, b)
 JOIN co a ON a.stage = h.a JOIN co b ON b.stage = h.b AND a.metric = b.metric AND a.dwh_table = b.dwh_table AND a.dwh_column = b.dwh_column AND a.stg2_table = b.stg2_table AND a.stg2_column = b.stg2_column
 JOIN mu ON mu.dwh_table = a.dwh_table AND mu.dwh_column = a.dwh_column AND mu.stg2_table = a.stg2_table AND mu.stg2_column = a.stg2_column
 WHERE a.metric IN ('CNT', 'NULLS', 'NDV', 'SUM', 'MAXLEN', 'HASHSUM') AND NOT (multi AND a.metric = 'NDV') AND abs(a.value_num - b.value_num) / greatest(abs(a.value_num), abs(b.value_num), 1.0) > 1e-4),
fb AS (SELECT * FROM br QUALIFY hop = min(hop) OVER (PARTITION BY dwh_table, dwh_column, stg2_table, stg2_column))"""


@query(f"WITH {VARIANCE_SQL} SELECT dwh_table, dwh_column, stg2_table, stg2_column, stage, metric, value_num, NULL::VARCHAR AS value_str FROM co")
def metric_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.combined(chains(spark), chain_profile(spark, sf_dir))


@query(f"WITH {VARIANCE_SQL} SELECT dwh_table, dwh_column, stg2_table, stg2_column, metric, hop, hop_name FROM fb")
def hop_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.hop_breaks(chains(spark), chain_profile(spark, sf_dir))


@query(
    f"""WITH {VARIANCE_SQL}, fi AS (SELECT DISTINCT dwh_table, dwh_column, stg2_table, stg2_column FROM ch),
pf AS (SELECT dwh_table, dwh_column, sum(CASE metric WHEN 'CNT' THEN 3 WHEN 'SUM' THEN 3 WHEN 'HASHSUM' THEN 2 ELSE 1 END) AS w, count(*) FILTER (WHERE hop = 0) AS h0, count(*) FILTER (WHERE hop = 1) AS h1, count(*) FILTER (WHERE hop = 2) AS h2, count(*) FILTER (WHERE metric = 'CNT') AS c FROM fb GROUP BY ALL),
tt AS (SELECT fi.dwh_table, count(*) AS n, count(w) AS nv, coalesce(sum(w), 0) AS w, coalesce(sum(h0), 0) AS h0, coalesce(sum(h1), 0) AS h1, coalesce(sum(h2), 0) AS h2, coalesce(sum(c), 0) AS c FROM fi LEFT JOIN pf ON fi.dwh_table = pf.dwh_table AND fi.dwh_column = pf.dwh_column GROUP BY ALL),
dm AS (SELECT dwh_table, arg_min(metric, (-n, o)) AS dominant FROM (SELECT dwh_table, metric, count(*) AS n, list_position(['CNT', 'NULLS', 'NDV', 'SUM', 'MAXLEN', 'HASHSUM'], metric) AS o FROM fb GROUP BY ALL) GROUP BY dwh_table)
SELECT 'run' AS run_id, 'MAIN' AS data_source, (SELECT arg_max(fgroup, lineage_id) FROM ch WHERE ch.dwh_table = tt.dwh_table) AS functional_group, tt.dwh_table AS table_name, n AS fields_total, nv AS fields_variant, floor(w * 100.0::DOUBLE / n * 10 + 0.5) / 10 AS variance_score,
 CASE WHEN greatest(h0, h1, h2) = 0 THEN NULL WHEN h0 = greatest(h0, h1, h2) THEN 'SRC->STG1' WHEN h1 = greatest(h0, h1, h2) THEN 'STG1->STG2' ELSE 'STG2->DWH' END AS worst_hop, h0::BIGINT AS breaks_src_stg1, h1::BIGINT AS breaks_stg1_stg2, h2::BIGINT AS breaks_stg2_dwh, dominant AS dominant_metric,
 CASE WHEN floor(w * 100.0::DOUBLE / n * 10 + 0.5) / 10 >= 10 OR c > 0 THEN 'RED' WHEN floor(w * 100.0::DOUBLE / n * 10 + 0.5) / 10 >= 3 THEN 'AMBER' ELSE 'GREEN' END AS status FROM tt LEFT JOIN dm ON dm.dwh_table = tt.dwh_table"""
)
def variance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.summarize(chains(spark), chain_profile(spark, sf_dir), "run", "MAIN")


@query(
    f"""WITH {CLASSES_SQL} SELECT column_name, 'SRC' AS stage, 'lineitem' AS table_name, kind AS inferred_type, floor(conf * 100 + 0.5) / 100 AS conformance_pct, total AS total_rows, nonnull AS nonnull_rows, bad AS bad_rows,
 prec_max AS num_prec_max, scale_max AS num_scale_max, max_len, lead_zero AS lead_zero_rows, CASE WHEN kind LIKE 'DATE:%' OR kind = 'MIXED' THEN m END AS date_mask, risk, column_name = 'mixed' AS pii_suppressed,
 CASE WHEN risk = 'CAST_UNSAFE' AND column_name <> 'mixed' AND kind IN ('INTEGER', 'DECIMAL') THEN (SELECT to_json(list(x ORDER BY x))::VARCHAR FROM (SELECT DISTINCT substr(v, 1, 80) AS x FROM w WHERE w.column_name = u.column_name AND v IS NOT NULL AND NOT num ORDER BY x LIMIT 5)) END AS samples_json FROM u"""
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of a table, samples included, personal columns kept back. None of the other masks fits anything."""
    pii = frame(spark, [("mixed", "Y"), ("spoilt", "N")], "column_name is_pii", "VARCHAR VARCHAR")
    out = pf.profile_table(texts(spark, sf_dir), assembled(["dd/MM/yyyy", "HH:mm"]), "SRC", "lineitem", pii)
    return out.select("column_name", "stage", "table_name", "inferred_type", "conformance_pct", "total_rows", "nonnull_rows", "bad_rows", "num_prec_max", "num_scale_max", "max_len", "lead_zero_rows", "date_mask", "risk", "pii_suppressed", "samples_json")
