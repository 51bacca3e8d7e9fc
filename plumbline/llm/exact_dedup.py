"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks, which sorting brings together, get one integer name;
then adjacent names are named pair by pair, until each document has a single name. Two documents have the same name at
the same level exactly if their texts are equal: no hash decides anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

BLOCK = 4096
#: Blocks that occur more often than this are named without bringing their copies together.
OFTEN = 10_000
#: Names of such blocks up to which they are broadcast (16 bytes each).
MOST_NAMES = 1_000_000
_NONE = -(1 << 63)


def _named_often(blocks: DataFrame) -> DataFrame | None:
    """Names below 0 for blocks whose mark, a hash, occurs often: mark, fixed, and the block itself (``which``) only if
    several blocks have the mark. One block in OFTEN at most."""
    marks = blocks.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > OFTEN)
    marks = written(marks.select("mark"), "block-marks")
    found = marks.count()
    if not found:
        return None
    hot = blocks.join(F.broadcast(marks) if found <= MOST_NAMES else marks, "mark").groupBy("mark", "block").agg(F.count(F.lit(1)).alias("times"))
    hot = written(hot.select("mark", "block", (-1 - F.monotonically_increasing_id()).alias("fixed")), "block-kinds")
    kinds = hot.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds"))
    which = F.when(F.col("kinds") > 1, F.col("block"))
    return written(hot.join(kinds, "mark").select("mark", "fixed", which.alias("which")), "block-names")


def _first_names(rows: DataFrame, block: int) -> DataFrame:
    """A row per block: row, pos, n (blocks of its text), name, and at pos 0 doc_id and text_sha256."""
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(body, i * {block} + 1, {block}))")
    blocks = rows.select("row", "doc_id", "text_sha256", "n", F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.withColumn("doc_id", F.when(F.col("pos") == 0, F.col("doc_id"))).withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
    kept = [c for c in blocks.columns if c != "block"]
    marked = blocks.withColumn("mark", F.xxhash64("block"))
    often = _named_often(marked)
    fixed = None
    if often is not None:
        names = often.withColumnRenamed("mark", "m")
        names = F.broadcast(names) if names.count() <= MOST_NAMES else names
        both = marked.join(names, (F.col("mark") == F.col("m")) & (F.col("which").isNull() | (F.col("which") == F.col("block"))), "left")
        fixed = both.filter(F.col("fixed").isNotNull()).select(*kept, F.col("fixed").alias("name"))
        blocks = both.filter(F.col("fixed").isNull()).select(*kept, "block")
    places = blocks.withColumn("place", F.monotonically_increasing_id())
    groups = places.groupBy("block").agg(F.min("place").alias("name"), F.collect_list(F.struct(*kept)).alias("held"))  # OFTEN at most
    named = groups.select("name", F.explode("held").alias("held")).select("held.*", "name")
    return named if fixed is None else named.unionByName(fixed)


def _paired(names: DataFrame) -> DataFrame:
    """Adjacent names become one name for each different pair; a last one without a partner is paired with nothing."""
    left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
    pairs = names.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
        F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"),
        F.max("doc_id").alias("doc_id"),
        F.max("text_sha256").alias("text_sha256"),
        F.max(F.when(left, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(_NONE)).alias("b"),
    )
    pairs = written(pairs.withColumn("place", F.monotonically_increasing_id()), "block-pairs")
    new = written(pairs.groupBy("a", "b").agg(F.min("place").alias("name")), "block-names")  # so that the join may split a frequent pair
    return pairs.join(new, ["a", "b"]).select("row", "doc_id", "text_sha256", "n", "pos", "name")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, keep_id (of equal texts, the row with the largest id stays), group_size, kept,
    text_sha256 (lowercase hex, UTF-8).

    Null counts as empty; nothing is normalised. Of equal rows with the same id one is kept; null ids are the smallest.
    Other columns are ignored; an empty table gives an empty result. The number of levels is the logarithm of the
    longest text's blocks. Names are the first of the places where a block stands in the scan, so groups are equal in
    any rerun.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        text.cast("binary").alias("body"),
        F.unhex(F.sha2(text, 256)).alias("text_sha256"),
        F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(block))).cast("int").alias("n"),
    )
    level, now = 0, written(_first_names(rows, block), "blocks")
    done = now.filter("n = 1").withColumn("level", F.lit(0))
    longest = now.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        now = written(_paired(now.filter("n > 1")), "blocks")
        done = done.unionByName(now.filter("n = 1").withColumn("level", F.lit(level)))
    groups = done.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "block-groups")
    out = done.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))
