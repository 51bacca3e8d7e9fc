"""Checks between tables: references, orphans, crosswalks, leakage, ranges.

Seeds and crosswalks are dimensions; whether one is broadcast is left to the optimiser, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import ratio, rounded


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, where: Column | None = None) -> DataFrame:
    """Child rows whose key isn't null and isn't among the parent's."""
    rows = child.filter(F.col(key).isNotNull() if where is None else where & F.col(key).isNotNull())
    keys = parent.select(F.col(parent_key).alias("__parent")).distinct()
    return rows.join(keys, F.col(key) == F.col("__parent"), "left_anti")


def reference_summary(child: DataFrame, references: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """relation, missing_rows, missing_keys for each (name, key, parent, parent key)."""
    out = None
    for name, key, parent, parent_key in references:
        lost = missing_references(child.select(key), key, parent, parent_key)
        part = lost.agg(F.count(F.lit(1)).alias("missing_rows"), F.count_distinct(key).alias("missing_keys")).select(F.lit(name).alias("relation"), "missing_rows", "missing_keys")
        out = part if out is None else out.unionByName(part)
    return out


def orphans(source: DataFrame, target: DataFrame, source_key: str, target_key: str, lost: str = "MISSING_IN_TARGET", extra: str = "MISSING_IN_SOURCE") -> DataFrame:
    """key, issue: keys of either side that the other lacks. Keys are compared as texts; null keys have no partner and
    are left out. Both sides are reduced to distinct keys before they meet, so hot keys don't matter."""
    a = source.select(F.col(source_key).cast("string").alias("key")).filter("key is not null").distinct()
    b = target.select(F.col(target_key).cast("string").alias("key")).filter("key is not null").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "key", "full_outer")
    return both.filter("a is null or b is null").select("key", F.when(F.col("b").isNull(), lost).otherwise(extra).alias("issue"))


def count_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of both and the absolute difference."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return count(a, "left_rows").join(count(b, "right_rows"), F.lit(True)).withColumn("difference", F.abs(F.col("left_rows") - F.col("right_rows")))


def pair_inconsistencies(rows: DataFrame, seed: DataFrame, fine: str, coarse: str, seed_fine: str, seed_coarse: str) -> DataFrame:
    """rows whose coarse code isn't the one the seed gives for their fine code. A fine code with several coarse ones
    meets each of them, as in the plain join."""
    known = seed.select(F.col(seed_fine).alias("__fine"), F.col(seed_coarse).alias("expected"))
    return rows.join(known, F.col(fine) == F.col("__fine")).filter(F.col(coarse) != F.col("expected")).drop("__fine")


def code_leakage(rows: DataFrame, id_col: str, fields: list[str], codes: list[str], marker: str | None = "_") -> DataFrame:
    """id, field, issue, value: text fields that hold a source system's code (any case), or the marker character.

    One scan: the violations of a row are exploded from it."""
    found = []
    for f in fields:
        value, text = F.col(f).cast("string"), F.lower(F.col(f).cast("string"))
        for code in codes:
            found.append(F.when(text.contains(code.lower()), F.struct(F.lit(f).alias("field"), F.lit(f"contains {code}").alias("issue"), value.alias("value"))))
        if marker:
            found.append(F.when(text.contains(marker), F.struct(F.lit(f).alias("field"), F.lit("contains marker").alias("issue"), value.alias("value"))))
    return rows.select(F.col(id_col).alias("id"), F.inline(F.array_compact(F.array(*found))))


def rule_violations(rows: DataFrame, id_col: str, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """id, field, issue, value for each (field, issue, broken, offending value) that holds; one scan."""
    found = [F.when(broken, F.struct(F.lit(f).alias("field"), F.lit(i).alias("issue"), v.cast("string").alias("value"))) for f, i, broken, v in rules]
    return rows.select(F.col(id_col).cast("string").alias("id"), F.inline(F.array_compact(F.array(*found))))


def fallback_shares(rows: DataFrame, methods: dict[str, tuple[str, float]], fallback: str = "FALLBACK", warn: dict[str, float] | None = None) -> DataFrame:
    """level, fallback_rows, total_rows, fallback_pct (two places), status for each level: (method column, most per cent).

    An empty table has no percentage and passes. With warn, a lower threshold gives WARN."""
    total = F.count(F.lit(1))
    wide = rows.agg(total.alias("total_rows"), *(F.count_if(F.col(c) == fallback).alias(f"n{i}") for i, (c, _) in enumerate(methods.values())))
    structs = []
    for i, (level, (_, most)) in enumerate(methods.items()):
        pct = rounded(ratio(F.col(f"n{i}") * 100.0, F.col("total_rows")), 2)
        status = F.when(pct > most, "FAIL")
        if warn and level in warn:
            status = status.when(pct > warn[level], "WARN")
        structs.append(F.struct(F.lit(level).alias("level"), F.col(f"n{i}").alias("fallback_rows"), F.col("total_rows"), pct.alias("fallback_pct"), status.otherwise("PASS").alias("status")))
    return wide.select(F.inline(F.array(*structs)))


def seed_gaps(classes: DataFrame, code: str, parent: str, seed: DataFrame, seed_code: str) -> DataFrame:
    """issue, code, affected: codes the seed lacks, and parents that the seed lacks and that are no codes themselves.

    ``affected`` counts distinct codes for the first kind, which is 1, and a parent's distinct children for the second.
    As with NOT IN, a null code silences the second kind."""
    known = seed.select(F.col(seed_code).alias("__known")).distinct()
    codes = classes.select(F.col(code).alias("code")).distinct()
    lost = codes.filter("code is not null").join(known, F.col("code") == F.col("__known"), "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("affected"))
    parents = classes.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("up"), F.col(code).alias("child"))
    parents = parents.join(known, F.col("up") == F.col("__known"), "left_anti")
    nulls = codes.agg(F.count_if(F.col("code").isNull()).alias("nulls"))
    parents = parents.join(codes, F.col("up") == F.col("code"), "left_anti").join(nulls, F.lit(True)).filter("nulls = 0")
    up = parents.groupBy(F.col("up").alias("code")).agg(F.count_distinct("child").alias("affected"))
    return lost.select(F.lit("MISSING_CODE").alias("issue"), "code", "affected").unionByName(up.select(F.lit("MISSING_PARENT").alias("issue"), "code", "affected"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))
