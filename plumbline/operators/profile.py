"""Composition of columns: what their contents are, whatever they were declared as.

A scan turns each row into one short row for each of up to BATCH columns, flags every value once, and counts the flags by
column: one small aggregate, whatever the number of columns, combined on the map side. Masks are probed in the same scan;
a value's length rules most of them out, so none has to be chosen on a sample first.
"""

from __future__ import annotations

from collections.abc import Container
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.masks import Mask
from plumbline.sources.tables import type_class

#: Columns in one pass; per cent from which contents are of a class.
BATCH, ENOUGH = 30, 98.0
#: Samples of a risky column, and their length.
SAMPLES, SAMPLE_LENGTH = 5, 80


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _flagged(cells: DataFrame) -> DataFrame:
    """cells (i, v) with what several probes need."""
    v = F.col("v")
    return cells.select("i", "v", tx.is_number(v).alias("num"), F.instr(v, ".").alias("point"), F.length(v).alias("n"))


def text_probes(masks: list[Mask]) -> dict[str, Column]:
    """Aggregates over a column's flagged values."""
    v, num, point, n = (F.col(c) for c in ("v", "num", "point", "n"))
    out = {
        "total": F.count(F.lit(1)),
        "nonnull": F.count(v),
        "num_ok": F.count_if(num),
        "int_ok": F.count_if(num & (point == 0)),
        "prec_max": F.max(F.when(num, F.length(F.translate(v, "-+.", "")))),
        "scale_max": F.max(F.when(num & (point > 0), n - point).otherwise(F.lit(0))),
        "lead_zero": F.count_if(num & (n > 1) & v.startswith("0") & (F.substring(v, 2, 1) != ".")),
        "bool_ok": F.count_if((n == 1) & tx.is_flag(v)),
        "max_len": F.max(n),
    }
    return out | {f"date_{i}": F.count_if(m.matches(v)) for i, m in enumerate(masks)}


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row (i, v) for each row and column: the column's number and its content."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), tx.content(quoted(n)).alias("v")) for i, n in enumerate(columns)))))


def composition(df: DataFrame, masks: list[Mask], columns: list[str] | None = None) -> DataFrame:
    """column_name, declared_type, and the probes as columns: a row per column. Columns that aren't text have counts only."""
    kinds = dict(df.dtypes)
    names = columns or df.columns
    probes = text_probes(masks)
    maxima = ("prec_max", "scale_max", "max_len")
    parts = []
    for at in range(0, len(names), BATCH):
        some = names[at : at + BATCH]
        texts = [n for n in some if type_class(kinds[n]) == "TEXT"]
        others = [n for n in some if n not in texts]
        if texts:
            listed = df.sparkSession.createDataFrame([(i, n, kinds[n]) for i, n in enumerate(texts)], "i int, column_name string, declared_type string")
            counted = _flagged(_cells(df, texts)).groupBy("i").agg(*(x.cast("bigint").alias(k) for k, x in probes.items()))
            filled = ((F.col(k) if k in maxima else F.coalesce(k, F.lit(0).cast("bigint"))).alias(k) for k in probes)
            parts.append(listed.join(counted, "i", "left").select("column_name", "declared_type", *filled))
        if others:
            wide = df.agg(F.count(F.lit(1)).alias("total"), *(F.count(quoted(n)).alias(f"c{i}") for i, n in enumerate(others)))
            none = [F.lit(None).cast("bigint").alias(k) for k in probes if k not in ("total", "nonnull")]
            rows = (F.struct(F.lit(n).alias("column_name"), F.lit(kinds[n]).alias("declared_type"), F.col("total"), F.col(f"c{i}").alias("nonnull"), *none) for i, n in enumerate(others))
            parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def best_mask(masks: list[Mask]) -> tuple[Column, Column]:
    """(name, hits) of the mask with the most hits; the earlier one where two have as many; none without hits."""
    most = F.greatest(*(F.col(f"date_{i}") for i in range(len(masks))), F.lit(0).cast("bigint")) if masks else F.lit(0)
    name = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(masks))):
        name = F.when(F.col(f"date_{i}") == most, m.name).otherwise(name)
    return F.when(most > 0, name), most


def mask_selection(df: DataFrame, masks: list[Mask], columns: list[str] | None = None) -> DataFrame:
    """column_name, date_mask, hits: a column's best mask, where it fits half of the contents or more."""
    found = composition(df, masks, columns)
    name, hits = best_mask(masks)
    keep = (F.col("nonnull") > 0) & (hits * 2 >= F.col("nonnull"))
    return found.select("column_name", F.when(keep, name).alias("date_mask"), F.coalesce(hits, F.lit(0)).alias("hits"))


def classified(probes: DataFrame, masks: list[Mask], type_drift: bool = False) -> DataFrame:
    """The composition with shares in per cent, inferred_type, conformance, mask, risk and verdict.

    type_drift: also report text columns whose contents would fit a stronger type; off by default."""
    name, hits = best_mask(masks)
    base = F.col("nonnull")
    pct = lambda n: F.coalesce(tx.ratio(n * 100.0, base), F.lit(0.0))
    p = probes.withColumn("date_mask", name).withColumn("date_hits", hits)
    p = p.withColumn("pct_num", pct(F.col("num_ok"))).withColumn("pct_int", pct(F.col("int_ok"))).withColumn("pct_date", pct(F.col("date_hits"))).withColumn("pct_flag", pct(F.col("bool_ok")))
    p = p.withColumn("pct_blank", F.coalesce(tx.ratio((F.col("total") - base) * 100.0, F.col("total")), F.lit(0.0)))
    num, whole, date, flag = (F.col(c) for c in ("pct_num", "pct_int", "pct_date", "pct_flag"))
    date_name = F.concat(F.lit("DATE:"), F.col("date_mask"))
    kind = (
        F.when(base == 0, "EMPTY")
        .when(F.col("num_ok").isNull(), "AS_DECLARED")
        .when((flag >= ENOUGH) & (num < ENOUGH), "BOOLEAN_FLAG")
        .when((date >= ENOUGH) & (whole < ENOUGH), date_name)
        .when((whole >= ENOUGH) & (F.col("lead_zero") > 0), "STRING_NUMERICLOOK")
        .when((whole >= ENOUGH) & (date >= ENOUGH), date_name)
        .when(whole >= ENOUGH, "INTEGER")
        .when(num >= ENOUGH, "DECIMAL")
        .when((num > 50) | (date > 50) | (flag > 50), "MIXED")
        .otherwise("STRING")
    )
    p = p.withColumn("inferred_type", kind)
    t = F.col("inferred_type")
    conf = (
        F.when(t.isin("EMPTY", "AS_DECLARED", "STRING_NUMERICLOOK"), 100.0)
        .when(t == "BOOLEAN_FLAG", flag)
        .when(t.startswith("DATE:"), date)
        .when(t == "INTEGER", whole)
        .when(t == "DECIMAL", num)
        .when(t == "MIXED", F.greatest(num, date))
        .otherwise(100.0 - F.greatest(num, date))
    )
    p = p.withColumn("conformance", conf)
    bad = F.when(F.col("conformance") < 100, F.floor(base * (100 - F.col("conformance")) / 100 + 0.5)).otherwise(0).cast("bigint")
    p = p.withColumn("bad_rows", bad).withColumn("pct_bad", F.coalesce(tx.ratio(bad * 100.0, base), F.lit(0.0)))
    typed = t.isin("INTEGER", "DECIMAL", "BOOLEAN_FLAG") | t.startswith("DATE:")
    number = F.format_string("safe cast -> NUMBER(%d,%d)", F.coalesce("prec_max", F.lit(18)), F.coalesce("scale_max", F.lit(0)))
    text = F.upper("declared_type").rlike("CHAR|STRING") & F.lit(type_drift)
    unsafe = typed & (F.col("conformance") < 100)
    drift = ~unsafe & text & (t.isin("INTEGER", "DECIMAL") | t.startswith("DATE:"))
    # Names of risks and the sentences that go with them.
    p = p.withColumn("risk", F.when(t == "STRING_NUMERICLOOK", "IDENTIFIER_LEADING_ZERO").when(unsafe, "CAST_UNSAFE").when(drift, "TYPE_DRIFT").otherwise(""))
    verdict = (
        F.when(F.col("risk") == "IDENTIFIER_LEADING_ZERO", "NEVER cast to NUMBER — leading zeros would be lost; keep VARCHAR2")
        .when(F.col("risk") == "CAST_UNSAFE", F.format_string("cast fails ~%,d rows — cleanse before cast", F.col("bad_rows")))
        .when((F.col("risk") == "TYPE_DRIFT") & t.startswith("DATE:"), "safe cast -> DATE")
        .when(F.col("risk") == "TYPE_DRIFT", number)
        .when(t == "STRING", "genuine string")
        .otherwise(F.lit(""))
    )
    out = p.withColumn("verdict", verdict)
    shown = {"conformance_pct": "conformance", "pct_decimal": None, "pct_integer": "pct_int", "pct_date": "pct_date", "pct_bool": "pct_flag", "pct_blank": "pct_blank", "pct_bad": "pct_bad"}
    two = lambda n, s: tx.rounded(F.col("pct_num") - F.col("pct_int") if s is None else F.col(s), 2).alias(n)
    return out.select(
        "column_name",
        "declared_type",
        "inferred_type",
        two("conformance_pct", "conformance"),
        F.col("total").alias("total_rows"),
        F.col("nonnull").alias("nonnull_rows"),
        *(two(n, s) for n, s in list(shown.items())[1:]),
        "bad_rows",
        F.col("prec_max").alias("num_prec_max"),
        F.col("scale_max").alias("num_scale_max"),
        "max_len",
        F.col("lead_zero").alias("lead_zero_rows"),
        F.when(t.startswith("DATE:") | (t == "MIXED"), F.col("date_mask")).alias("date_mask"),
        "risk",
        "verdict",
    )


def _unfit(v: Column, inferred: str, masks: list[Mask]) -> Column:
    if inferred in ("INTEGER", "DECIMAL"):
        return ~tx.is_number(v)
    if inferred.startswith("DATE:"):
        return ~next(m for m in masks if m.name == inferred[5:]).matches(v)
    return F.lit(False)


def outliers(df: DataFrame, inferred: dict[str, str], masks: list[Mask], suppressed: Container[str] = ()) -> DataFrame:
    """column_name, samples: a row for each column with contents that don't fit its inferred type, and the smallest
    distinct ones of them; none where suppressed. One scan for all columns; tasks keep the smallest few of each column."""
    shown = {c: kind for c, kind in inferred.items() if c not in suppressed}
    kind = "column_name string, samples array<string>"
    if not shown:
        return df.sparkSession.createDataFrame([], kind)
    cells = []
    for c, k in shown.items():
        v = tx.content(quoted(c))
        cells.append(F.struct(F.lit(c).alias("column_name"), F.when(_unfit(v, k, masks), F.substring(v, 1, SAMPLE_LENGTH)).alias("v")))
    rows = df.select(F.inline(F.array(*cells))).filter("v IS NOT NULL").distinct()
    first = F.row_number().over(Window.partitionBy("column_name").orderBy("v"))
    return rows.withColumn("k", first).filter(F.col("k") <= SAMPLES).groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("samples"))


def entries(dictionary: DataFrame, order_col: str | None = None) -> DataFrame:
    """A dictionary (column_name, date_format, is_pii) with one entry, column_key, per column, whatever its case. Of several,
    the last by ``order_col`` counts, else the one with the largest values."""
    kept = [c for c in dictionary.columns if c != "column_name"]
    by = F.struct(*([order_col] if order_col else []), *sorted(kept))
    return dictionary.groupBy(F.upper("column_name").alias("column_key")).agg(F.max_by(F.struct(*kept), by).alias("e")).select("column_key", "e.*")


def profile_table(df: DataFrame, masks: list[Mask], stage: str, table: str, dictionary: DataFrame | None = None, type_drift: bool = False) -> DataFrame:
    """The classified columns of a table with samples_json of risky ones; a column that the dictionary (column_name,
    is_pii) marks as personal shows none."""
    found = classified(composition(df, masks), masks, type_drift).withColumn("stage", F.lit(stage)).withColumn("table_name", F.lit(table))
    if dictionary is not None:
        pii = entries(dictionary).select(F.col("column_key").alias("__c"), (F.upper("is_pii") == "Y").alias("__pii"))
        found = found.join(pii, F.upper("column_name") == F.col("__c"), "left").drop("__c")
    else:
        found = found.withColumn("__pii", F.lit(False))
    found = found.withColumn("pii_suppressed", F.coalesce("__pii", F.lit(False))).drop("__pii")
    found = df.sparkSession.createDataFrame(found.collect(), found.schema)  # a row per column: the probes are run once
    risky = {r["column_name"]: r["inferred_type"] for r in found.filter("risk = 'CAST_UNSAFE'").collect()}
    hidden = {r["column_name"] for r in found.filter("pii_suppressed").select("column_name").collect()}
    samples = outliers(df, risky, masks, hidden)
    return found.join(samples.select("column_name", F.to_json("samples").alias("samples_json")), "column_name", "left")


# Metrics of a stage


def metric_class(declared: str, inferred: str | None) -> str:
    """RAWNUM, RAWDATE and LOB by the declared type; text as NUM or STR by its contents."""
    kind = type_class(declared)
    if kind != "TEXT":
        return {"NUMBER": "RAWNUM", "DATE": "RAWDATE"}.get(kind, "LOB")
    return "NUM" if inferred in ("INTEGER", "DECIMAL") else "STR"


def metrics(c: Column, kind: str) -> dict[str, Column]:
    """Metrics of one column but for NDV; numbers as doubles from exact sums, dates and texts as texts. CNT counts values,
    NULLS is raw: a blank is a value. Lengths, numbers and hashes are of the trimmed content."""
    out = {"CNT": F.count(c), "NULLS": F.count_if(c.isNull())}
    if kind == "LOB":
        return out
    if kind in ("RAWNUM", "NUM"):
        n = c.cast("decimal(38,6)") if kind == "RAWNUM" else tx.to_number(tx.content(c), 6)
        return out | {"SUM": F.sum(n), "MIN": F.min(n), "MAX": F.max(n)}
    if kind == "RAWDATE":
        shown = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        return out | {"MIN_D": shown(F.min(c)), "MAX_D": shown(F.max(c))}
    v = tx.content(c)
    return out | {"MAXLEN": F.max(F.length(v)), "HASHSUM": F.sum(tx.hash32(v).cast("decimal(38,0)"))}


def stage_metrics(df: DataFrame, kinds: dict[str, str], approximate: bool = True) -> DataFrame:
    """column_name, metric, value_num, value_str: one scan for every BATCH columns. NDV is approximate, a sketch per column
    in the same scan; exact on request, which takes a scan and a shuffle for each column."""
    parts, names = [], list(kinds)

    def line(n: str, m: str, value: Column) -> Column:
        text = m in ("MIN_D", "MAX_D")
        number, shown = (F.lit(None), F.substring(value, 1, 200)) if text else (value, F.lit(None))
        return F.struct(F.lit(n).alias("column_name"), F.lit(m).alias("metric"), number.cast("double").alias("value_num"), shown.cast("string").alias("value_str"))

    for at in range(0, len(names), BATCH):
        exprs, rows = [], []
        for i, n in enumerate(names[at : at + BATCH]):
            found = metrics(quoted(n), kinds[n])
            if approximate and kinds[n] != "LOB":
                found["NDV"] = F.approx_count_distinct(quoted(n))
            for m, x in found.items():
                exprs.append(x.alias(f"m{i}_{m}"))
                rows.append(line(n, m, F.col(f"m{i}_{m}")))
        parts.append(df.agg(*exprs).select(F.inline(F.array(*rows))))
    if not approximate:
        for n in (n for n in names if kinds[n] != "LOB"):
            parts.append(df.agg(F.count_distinct(quoted(n)).alias("ndv")).select(F.inline(F.array(line(n, "NDV", F.col("ndv"))))))
    return reduce(DataFrame.unionByName, parts)
