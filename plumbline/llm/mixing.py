"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents stand in the order of their keys; token counts are
summed per range of keys. The ranges form a tree: at each level the sums of at most FAN ranges of a source are added up to
find the one that holds its budget, and only the documents of the last one are sorted to find the one at which the budget
ends. A budget beyond its source's size repeats whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Documents in a range of keys, about, and bits by which ranges are cut further at each level (FAN = 2 ** LEVEL).
RANGE, LEVEL = 64, 8
KEY_BITS = 60
#: Sources up to which their budgets are broadcast (about 100 bytes each).
MOST_SOURCES = 100_000
_WORD = "[^ \\t-\\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def mixing_key(seed: str, id_: Column) -> Column:
    """A number of 60 bits that is random in the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")).cast("string")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (source, source_size) with their target: shares of all sizes by weight, at most ``most`` times the size.

    What is above goes to the others by weight: sources are filled in the order of size to weight, as long as the next
    one can't take its share. One row per source, in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    given = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast("decimal(38,0)")
    rows = sources.withColumn("weight", given.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("all_size"),
        F.coalesce(F.sum("source_size").over(before) * most, F.lit(0)).alias("c"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("w"),
    )
    full = exact(F.col("source_size")) * most * F.col("w") < exact(F.col("all_size") - F.col("c")) * F.col("weight")
    rows = rows.withColumn("full", full)
    # of those that can take their share, the first one's rest and weights hold for all
    first = Window.orderBy(F.col("full"), F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    rows = rows.withColumn("rest", F.first(F.col("all_size") - F.col("c")).over(first)).withColumn("shares", F.first("w").over(first))
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("shares"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def budgets(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per source: its target, whole epochs, and the place (cut_key, cut_id, cut_size) where its last epoch ends, with
    ``part`` words of each document there."""
    narrow = docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col).cast("string")).alias("size")
    ).withColumn("key", mixing_key(seed, F.col("doc_id")))
    narrow = written(narrow, "mixing-sizes")
    rows = narrow.count()
    bits = max(0, math.ceil(math.log2(rows / RANGE + 1)))
    narrow = narrow.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    sums = written(narrow.groupBy("source", "range").agg(F.sum("size").alias("size")), "mixing-ranges")
    aims = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = F.floor("target").cast("long")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long"))
    aims = written(aims.withColumn("rest", goal - F.col("epochs") * F.col("source_size")), "mixing-targets")
    small = lambda df: F.broadcast(df) if aims.count() <= MOST_SOURCES else df
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    at = aims.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest")
    done = 0
    while done < bits:
        cut = min(LEVEL, bits - done)
        below = sums.alias("s").join(small(at).alias("a"), same("s", "a") & (F.shiftright("s.range", bits - done) == F.col("a.prefix")))
        level = below.groupBy("s.source", F.shiftright("s.range", bits - done - cut).alias("next"), "before", "rest").agg(F.sum("s.size").alias("size"))
        ahead = Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)  # of 2 ** LEVEL rows
        level = level.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        level = level.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size")))
        at = written(level.select("source", F.col("next").alias("prefix"), F.col("start").alias("before"), "rest"), "mixing-level")
        done += cut
    inside = narrow.alias("n").join(small(at).alias("h"), same("n", "h") & (F.col("n.range") == F.col("h.prefix"))).select("n.source", "key", "doc_id", "n.size", "before", "rest")
    peers = inside.groupBy("source", "key", "doc_id", "size", "before", "rest").agg(F.count(F.lit(1)).alias("copies"))
    ordered = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    peers = peers.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(ordered), F.lit(0)))
    cut = peers.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size") * F.col("copies")))
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.expr("(rest - start) div copies").alias("part"))
    return aims.alias("a").join(cut.alias("c"), same("a", "c"), "left").select("a.source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "part")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """docs with the columns size (words), source_size, target (double, its source's), epochs (whole passes), taken
    (words of the row that the mix takes, repeats counted) added; one row for each row.

    Sources in the order of their code points, null last, weigh ``weights``, repeating. Together they get as many words
    as there are, by weight, none more than ``most`` times its size. A source's words are taken to its target exactly,
    rounded down; the document at which its last pass ends gives only its first words. Rows that repeat with the same id
    and size are taken alike. Null and empty texts have size 0 and give nothing; null ids are one id; columns of docs
    that have one of the added names are replaced, others pass unchanged; an empty table stays empty. One row per source
    is handled in one task; documents are never sorted as a whole, and reruns agree.
    """
    added = ["size", "source_size", "target", "epochs", "taken"]
    plan = written(budgets(docs, weights, most, seed, id_col, text_col, source_col), "mixing-budgets")
    plan = F.broadcast(plan) if plan.count() <= MOST_SOURCES else plan
    others = [c for c in docs.columns if c not in added]
    base = docs.select(F.struct(*others).alias("row"), F.col(source_col).cast("string").alias("s"), F.col(id_col).cast("long").alias("i"), word_count(F.col(text_col).cast("string")).alias("size"))
    base = base.withColumn("key", mixing_key(seed, F.col("i")))
    out = base.join(plan, F.col("s").eqNullSafe(F.col("source")))
    here, there = F.struct("key", "i", "size"), F.struct(F.col("cut_key"), F.col("cut_id"), F.col("cut_size"))
    extra = F.when(F.col("cut_key").isNull(), F.lit(0)).when(here < there, F.col("size")).when(here == there, F.col("part")).otherwise(F.lit(0))
    fields = [F.col("row").getField(c).alias(c) for c in others]
    return out.select(*fields, "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + extra).alias("taken"))


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix's documents: each row as often as it is taken, the last time with its first words only if need be. Copies
    come from a short list of numbers; only the rows at which a budget ends, one for each source, are cut into words."""
    rest = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + F.when(rest > 0, 1).otherwise(0)
    cut = (F.col("__copy") > F.col("epochs")) & (rest < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit("[ \\t-\\r]*[^ \\t-\\r]+"), F.lit(0)), F.lit(1), F.greatest(rest, F.lit(0)).cast("int")), "")
    rows = mixed.filter(copies > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))).alias("__copy"))
    return rows.withColumn(text_col, F.when(cut, head).otherwise(F.col(text_col))).drop("__copy")
