"""Tiered mapping of codes through crosswalks, and the top level of a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(seed: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """One row per key, the smallest values where a seed has several."""
    picked = F.min(F.struct(*(F.col(c).alias(n) for n, c in values.items())))
    return seed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(picked.alias("__v")).select("__key", *(F.col(f"__v.{n}").alias(f"__{n}") for n in values))


def map_class(rows: DataFrame, code: str, top_code: str, seed: DataFrame, seed_code: str, seed_target: str, fallback: str = "OTHR") -> DataFrame:
    """rows with l1_code and l1_method: DIRECT by the code, PARENT_ROLLUP by its top level, else FALLBACK."""
    known = _first(seed, seed_code, {"code": seed_target})
    a = known.select(F.col("__key").alias("__a"), F.col("__code").alias("__direct"))
    b = known.select(F.col("__key").alias("__b"), F.col("__code").alias("__parent"))
    out = rows.join(a, F.col(code) == F.col("__a"), "left").join(b, F.col(top_code) == F.col("__b"), "left")
    method = F.when(F.col("__direct").isNotNull(), "DIRECT").when(F.col("__parent").isNotNull(), "PARENT_ROLLUP").otherwise("FALLBACK")
    return out.withColumn("l1_code", F.coalesce("__direct", "__parent", F.lit(fallback))).withColumn("l1_method", method).drop("__a", "__b", "__direct", "__parent")


def map_strategy(rows: DataFrame, code: str, class_code: str, seed: DataFrame, seed_code: str, seed_target: str, defaults: DataFrame, default_class: str, default_target: str, fallback: str = "OTHR_DEF") -> DataFrame:
    """rows with l2_code and l2_method: DIRECT by the code, ASSET_CLASS_DEFAULT by the class, else FALLBACK."""
    a = _first(seed, seed_code, {"code": seed_target}).select(F.col("__key").alias("__a"), F.col("__code").alias("__direct"))
    b = _first(defaults, default_class, {"code": default_target}).select(F.col("__key").alias("__b"), F.col("__code").alias("__default"))
    out = rows.join(a, F.col(code) == F.col("__a"), "left").join(b, F.col(class_code) == F.col("__b"), "left")
    method = F.when(F.col("__direct").isNotNull(), "DIRECT").when(F.col("__default").isNotNull(), "ASSET_CLASS_DEFAULT").otherwise("FALLBACK")
    return out.withColumn("l2_code", F.coalesce("__direct", "__default", F.lit(fallback))).withColumn("l2_method", method).drop("__a", "__b", "__direct", "__default")


def top_levels(nodes: DataFrame, code: str, parent: str, deepest: int = 10) -> DataFrame:
    """code, top_code, level: each code's topmost ancestor and its distance + 1.

    A parent that isn't there ends the climb below it; a circle, or anything deeper than ``deepest``, ends there. A code
    that stands in several rows takes its smallest parent."""
    own = nodes.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min(parent).alias("up"))
    there = own.select(F.col("code").alias("__c"), F.col("up").alias("__u"))
    now = own.join(own.select(F.col("code").alias("__p")), F.col("up") == F.col("__p"), "left").select("code", F.coalesce("__p", "code").alias("top_code"), F.when(F.col("__p").isNotNull(), 2).otherwise(1).alias("level"))
    exists = own.select(F.col("code").alias("__e"))
    for _ in range(deepest - 2):
        step = there.join(exists, F.col("__u") == F.col("__e"), "left_semi")
        now = now.join(step, (F.col("top_code") == F.col("__c")) & (F.col("__u") != F.col("__c")), "left")
        now = now.select("code", F.coalesce("__u", "top_code").alias("top_code"), (F.col("level") + F.when(F.col("__u").isNotNull(), 1).otherwise(0)).alias("level"))
    return now
