"""Where, along chains of stages, a field's metrics first differ; and how bad that is for each target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import relative_difference, rounded

STAGES = ("SRC", "STG1", "STG2", "DWH")
HOPS = tuple(zip(STAGES, STAGES[1:]))
# Metrics that are compared, in the order in which ties are broken, what each weighs, and how feeds merge.
COMPARED = ("CNT", "NULLS", "NDV", "SUM", "MAXLEN", "HASHSUM")
WEIGHTS = {"CNT": 3, "SUM": 3, "HASHSUM": 2}
ADDED, HIGHEST, LOWEST = ("CNT", "NULLS", "SUM", "HASHSUM"), ("MAX", "MAXLEN", "MAX_D"), ("MIN", "MIN_D")
TOLERANCE = 1e-4
GROUP = ["dwh_table", "dwh_column", "stg2_table", "stg2_column"]


def load_chains(lineage: DataFrame, data_source: str, table: str | None = None, accepted: tuple[str, ...] = ("mapped", "exists"), default_source: str = "MAIN") -> DataFrame:
    """The lineage rows of a data source that count, with one table and column per stage."""
    status = F.lower(F.trim(F.coalesce("lineage_status", F.lit("x"))))
    rows = lineage.filter(status.isin(*accepted) & (F.coalesce("data_source", F.lit(default_source)) == data_source))
    if table:
        rows = rows.filter(F.upper("dwh_target_table") == table.upper())
    return rows.select(
        "lineage_id",
        F.col("functional_group").alias("fgroup"),
        F.col("src_source_table").alias("src_table"),
        F.col("src_source_column").alias("src_column"),
        F.col("stg1_source_table").alias("stg1_table"),
        F.col("stg1_source_column").alias("stg1_column"),
        F.col("stg2_source_table").alias("stg2_table"),
        F.col("stg2_source_column").alias("stg2_column"),
        F.col("dwh_target_table").alias("dwh_table"),
        F.col("dwh_target_column").alias("dwh_column"),
    )


def by_stage(chains: DataFrame) -> DataFrame:
    """A row per chain and stage: lineage_id, the group's key, stage, table_name, column_name. Order: lineage_id."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"{s.lower()}_table").alias("table_name"), F.col(f"{s.lower()}_column").alias("column_name")) for s in STAGES))
    return chains.select("lineage_id", *GROUP, F.inline(stages))


def combined(chains: DataFrame, profile: DataFrame) -> DataFrame:
    """One value per group, stage and metric: value_num, value_str.

    profile: lineage_id, stage, metric, value_num, value_str. Chains that share a stage's column count once there, the
    first of them; several feeds are added, or their extremes taken; other metrics of several feeds can't be merged and
    are null, and of texts the first stays."""
    first = Window.partitionBy(*GROUP, "stage", "table_name", "column_name").orderBy("lineage_id")
    rows = by_stage(chains).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    values = rows.join(profile, ["lineage_id", "stage"]).filter(F.coalesce(F.col("value_num").cast("string"), F.col("value_str")).isNotNull())
    text = F.count_if(F.col("value_num").isNull() & F.col("value_str").try_cast("double").isNull())
    number = F.coalesce("value_num", F.col("value_str").try_cast("double"))
    merged = (
        F.when(F.col("metric").isin(*ADDED), F.col("added")).when(F.col("metric").isin(*HIGHEST), F.col("highest")).when(F.col("metric").isin(*LOWEST), F.col("lowest"))
    )
    out = values.groupBy(*GROUP, "stage", "metric").agg(
        F.count(F.lit(1)).alias("feeds"),
        text.alias("texts"),
        F.min_by(F.struct("value_num", "value_str"), "lineage_id").alias("one"),
        F.sum(number).alias("added"),
        F.max(number).alias("highest"),
        F.min(number).alias("lowest"),
    )
    alone = (F.col("feeds") == 1) | (F.col("texts") > 0)
    return out.select(*GROUP, "stage", "metric", F.when(alone, F.col("one.value_num")).otherwise(merged).alias("value_num"), F.when(alone, F.col("one.value_str")).alias("value_str"))


def differs(a_num: Column, a_text: Column, b_num: Column, b_text: Column) -> Column:
    a, b = (F.coalesce(n, t.try_cast("double")) for n, t in ((a_num, a_text), (b_num, b_text)))
    shown = lambda n, t: F.coalesce(n.cast("string"), t)
    return F.when(a.isNotNull() & b.isNotNull(), relative_difference(a, b) > TOLERANCE).otherwise(shown(a_num, a_text) != shown(b_num, b_text))


def hop_breaks(chains: DataFrame, profile: DataFrame) -> DataFrame:
    """The group's key, hop (0 to 2), hop_name, metric: every metric that differs at the group's first hop with any.

    A metric that one side lacks is skipped. Counts of distinct values aren't compared where feeds converge."""
    values = combined(chains, profile).filter(F.col("metric").isin(*COMPARED))
    multi = chains.groupBy(*GROUP).agg((F.count_distinct(F.struct("stg1_table", "stg1_column")) > 1).alias("multi"))
    sides = values.groupBy(*GROUP, "metric").agg(*(F.max(F.when(F.col("stage") == s, F.struct("value_num", "value_str"))).alias(s) for s in STAGES))
    same = [sides[c].eqNullSafe(multi[c]) for c in GROUP]
    sides = sides.join(multi, same).select(*(sides[c] for c in GROUP), "metric", "multi", *STAGES).filter(~(F.col("multi") & (F.col("metric") == "NDV")))
    hops = F.array(
        *(
            F.when(
                F.coalesce(F.coalesce(F.col(f"{a}.value_num").cast("string"), F.col(f"{a}.value_str")).isNotNull() & F.coalesce(F.col(f"{b}.value_num").cast("string"), F.col(f"{b}.value_str")).isNotNull() & differs(F.col(f"{a}.value_num"), F.col(f"{a}.value_str"), F.col(f"{b}.value_num"), F.col(f"{b}.value_str")), F.lit(False)),
                F.struct(F.lit(i).alias("hop"), F.lit(f"{a}->{b}").alias("hop_name")),
            )
            for i, (a, b) in enumerate(HOPS)
        )
    )
    broken = sides.select(*GROUP, "metric", F.inline(F.array_compact(hops)))
    first = F.min("hop").over(Window.partitionBy(*GROUP))
    return broken.withColumn("__first", first).filter("hop = __first").drop("__first")


def _most(counts: dict[str, Column]) -> Column:
    """The name with the largest count, the earlier one where two have as many; null if all are 0."""
    most = F.greatest(*counts.values())
    out = F.lit(None).cast("string")
    for name, c in reversed(counts.items()):
        out = F.when(c == most, name).otherwise(out)
    return F.when(most > 0, out)


def summarize(chains: DataFrame, profile: DataFrame, run_id: str, data_source: str) -> DataFrame:
    """A row per target table: fields, fields that vary, score, worst hop, breaks per hop, dominant metric, status."""
    fields = chains.groupBy(*GROUP).agg(F.max_by("fgroup", "lineage_id").alias("fgroup"), F.max("lineage_id").alias("__last"))
    breaks = hop_breaks(chains, profile)
    weight = F.lit(1)
    for metric, w in WEIGHTS.items():
        weight = F.when(F.col("metric") == metric, w).otherwise(weight)
    per_field = breaks.groupBy(*GROUP).agg(
        F.sum(weight).alias("weight"),
        *(F.count_if(F.col("hop") == i).alias(f"h{i}") for i in range(len(HOPS))),
        *(F.count_if(F.col("metric") == m).alias(f"m_{m}") for m in COMPARED),
    )
    counts = [f"h{i}" for i in range(len(HOPS))] + [f"m_{m}" for m in COMPARED]
    both = fields.join(per_field, [fields[c].eqNullSafe(per_field[c]) for c in GROUP], "left").select(fields["dwh_table"], "fgroup", "__last", "weight", *counts)
    tables = both.groupBy("dwh_table").agg(
        F.max_by("fgroup", "__last").alias("functional_group"),
        F.count(F.lit(1)).alias("fields_total"),
        F.count("weight").alias("fields_variant"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),
    )
    score = rounded(F.col("weight") * 100.0 / F.greatest("fields_total", F.lit(1)), 1)
    status = F.when((score >= 10) | (F.col("m_CNT") > 0), "RED").when(score >= 3, "AMBER").otherwise("GREEN")
    return tables.select(
        F.lit(run_id).alias("run_id"),
        F.lit(data_source).alias("data_source"),
        "functional_group",
        F.col("dwh_table").alias("table_name"),
        "fields_total",
        "fields_variant",
        score.alias("variance_score"),
        _most({f"{a}->{b}": F.col(f"h{i}") for i, (a, b) in enumerate(HOPS)}).alias("worst_hop"),
        F.col("h0").alias("breaks_src_stg1"),
        F.col("h1").alias("breaks_stg1_stg2"),
        F.col("h2").alias("breaks_stg2_dwh"),
        _most({m: F.col(f"m_{m}") for m in COMPARED}).alias("dominant_metric"),
        status.alias("status"),
    )
