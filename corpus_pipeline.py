"""A corpus from documents: five stages, each written and read again as the next one's documents.

Language ID drops what is in no known language; line dedup removes lines that other documents have; the n-gram Jaccard
join leaves one document of each group of near copies; sources are mixed to their weights; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.language_id import identify, train
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.mixing import mix_sources, repeated
from plumbline.llm.ngram_join import ngram_components
from plumbline.llm.packing import pack
from plumbline.llm.shared import written

#: Rows up to which a list of documents to drop is broadcast (16 bytes each).
MOST = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST else df


def _without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return docs.join(_small(gone), on, "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known well enough.

    Rejects are found by id and a hash of the text: null and repeated ids are judged row by row, equal rows alike. Null,
    empty and blank texts have no language and go; long ones are judged whole. Other columns pass unchanged; an empty
    table stays empty."""
    none = F.lit(-(1 << 63))
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    judged = identify(marked, train(docs), keep=["doc_id", "__mark"], host_col="source")
    gone = written(judged.filter("rejected").select(F.coalesce("doc_id", none).alias("__gone"), "__mark").distinct(), "language-rejects")
    return _without(marked.withColumn("__gone", F.coalesce("doc_id", none)), gone, ["__gone", "__mark"]).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document of which nothing is left goes, others keep their columns.

    Rows with one id, and those without any, count as one document each and keep their lines among themselves; of several
    documents the smallest id keeps a line. Null and empty texts have no line to lose and stay, null as empty. Other
    columns pass unchanged; an empty table stays empty."""
    out = dedup_lines(docs)
    left = F.length(F.trim(F.col("kept_text"))) > 0
    columns = [{"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}.get(c, F.col(c)) for c in docs.columns]
    return out.filter((F.col("n_dropped") == 0) | left).select(*columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each group that links connect: one with the smallest id, nulls last.

    Rows are found by a hash of id and text, so that an id's other texts and rows without one are judged for themselves;
    of equal rows one is left. Texts without words are linked with nothing and stay. Other columns pass unchanged; an
    empty table stays empty."""
    named = docs.withColumn("__name", F.xxhash64("doc_id", "text"))
    found = ngram_components(named, id_col="__name").filter("n_shingles > 0")
    found = written(found.select(F.col("doc_id").alias("__name"), "component_id"), "near-components")
    several = written(found.groupBy("component_id").count().filter("count > 1").select("component_id"), "near-groups")
    copies = written(found.join(_small(several), "component_id").select("__name", "component_id").distinct(), "near-names")
    copies = written(named.select("__name", "doc_id").join(_small(copies), "__name").distinct(), "near-copies")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__name")).alias("least")
    kept = written(copies.groupBy("component_id").agg(least).select("least.__name"), "near-kept")
    one = named.join(_small(kept), "__name").groupBy("__name").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return _without(named, copies.select("__name").distinct(), ["__name"]).select(docs.columns).unionByName(one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at which a source's budget ends keeps its first words.

    Null, empty and blank texts have no words and are taken no time; ties are broken by a random key of the id, rows with
    one id and size are taken alike; a null source is a source. Other columns pass unchanged, but for ones named like what
    the mix adds, which are put back; an empty table stays empty."""
    added = {"size", "source_size", "target", "epochs", "taken"} & set(docs.columns)
    held = docs.withColumnsRenamed({c: f"__{c}" for c in added})
    out = repeated(mix_sources(held)).drop(*added).withColumnsRenamed({f"__{c}": c for c in added})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. Null and empty texts are one piece with the end alone; repeated
    rows are packed row by row; other columns are left out; an empty table gives an empty result."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: Trained likelihoods, 64-bit shingles and tokenizers can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
