"""Token counts through a digest cache: only texts that the cache doesn't know are encoded, each once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, new_path, small_batches, streamed, written
from .tokens import WordCounts, drops_white_space, loaded

_CACHE = "digest binary, n_tokens long, tokenizer string"
_MEMO: dict[str, WordCounts] = {}
_SLICE = 400
#: Missing digests up to which they are broadcast (32 bytes each).
MOST_MISSING = 1_000_000


def tokenizer_version(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _sentences(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def _encoded(batches: Iterator[pa.RecordBatch], version: str, content, kind: str, spaced: bool) -> Iterator[pa.RecordBatch]:
    if kind == ".model":
        model = _sentences(content.value)
        count = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
    else:
        made = loaded(version, content.value.decode("utf-8"))
        if spaced:
            memo = _MEMO.setdefault(version, WordCounts(made))
            count = lambda texts: memo.of([t.encode("utf-8") for t in texts])
        else:
            count = lambda texts: list(map(len, made.encode_batch_fast(texts, add_special_tokens=False)))
    for batch in batches:
        found: list[int] = []
        for at in range(0, batch.num_rows, _SLICE):
            found += count(batch.column(1).slice(at, _SLICE).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.array([version] * len(found), pa.string())], names=["digest", "n_tokens", "tokenizer"])


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than limit).

    tokenizer_path: a public tokenizer's .json or .model file, read on the driver. cache_path: a Parquet table of
    (digest, n_tokens, tokenizer) in a folder that all executors share, read first and appended to; None: a new one.
    Only digests are compared with the cache; texts are moved only if their digest isn't known, one for each. Where the
    file says that the tokenizer drops white space and never joins what it separates, texts that differ only in it share
    a digest, and words are encoded once a worker. No begin, end or added special tokens; special strings in texts are
    handled as the library's default; nothing is truncated or padded. Null counts as empty; repeated rows and ids are
    counted row by row; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    raw = Path(tokenizer_path).read_bytes()
    version, kind = tokenizer_version(raw), Path(tokenizer_path).suffix
    spaced = kind == ".json" and drops_white_space(raw.decode("utf-8"))
    content = spark.sparkContext.broadcast(raw)  # a vocabulary file of a few MB
    path = cache_path or new_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    normal = F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " ")) if spaced else text
    digest = F.unhex(F.sha2(normal, 256)).alias("digest")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest), "token-digests")
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(path)
    cache = spark.read.schema(_CACHE).parquet(path).filter(F.col("tokenizer") == version)
    missing = written(rows.select("digest").distinct().join(cache, "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        wanted = docs.select(digest, normal.alias("text"))
        if not cache.isEmpty():
            wanted = wanted.join(F.broadcast(missing) if n <= MOST_MISSING else missing, "digest", "left_semi")
        texts = wanted.groupBy("digest").agg(F.any_value("text").alias("text"))
        texts.mapInArrow(streamed(_encoded, version, content, kind, spaced), _CACHE).write.mode("append").parquet(path)
    dropped(missing)
    known = spark.read.schema(_CACHE).parquet(path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = written(known, "token-counts")  # so that the join may split a digest that many rows have
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
