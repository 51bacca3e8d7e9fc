"""Removes lines that several documents hold, except from the document with the smallest id.

Two Bloom filters, for hashes seen once and hashes seen twice, are cut into shards by the hash. Tasks send each shard its
lines' digests, once a flush and with a mark if several documents of the flush hold the line; a shard's filters are filled
and asked in one task, and there are as many shards as the lines need. Only what the second filter knows, and what was
marked, is shuffled again: a grouped minimum and maximum confirms repeats exactly and chooses the first document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grouped, parts_of, small_batches, streamed, written

_BLANKS = b" \t\n\x0b\x0c\r"
#: Lines in a shard, about, and bits of a filter for each; keys of a flush; bytes of a line, to begin with.
LINES, BITS, FLUSH, LINE = 2_000_000, 16, 500_000, 64
_CHUNK = 250_000
_LAST = (1 << 63) - 1


def line_key(line: bytes, least: int) -> bytes | None:
    """What lines are compared by; None if it has fewer than ``least`` code points."""
    key = line.strip(_BLANKS).lower()
    if len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _keys(text: str | None, least: int) -> list[bytes]:
    """Digests of a text's distinct keys."""
    lines = set((text or "").encode("utf-8", "surrogatepass").split(b"\n"))
    return [xxhash.xxh3_128_digest(k) for k in {line_key(x, least) for x in lines} if k is not None]


def _numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


_FILED = [("part", pa.int32()), ("docs", pa.binary()), ("texts", pa.binary()), ("keys", pa.binary()), ("marked", pa.binary())]


def _filed(batches: Iterator[pa.RecordBatch], shards: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each flush's keys by shard, once each, with the smallest document that holds them there, marked if another one
    does. Who holds a marked key goes to parts below 0, which are dealt evenly: so a shard gets a key once a flush."""
    owners: list[tuple[int, int]] = []
    times: list[int] = []
    held: list[bytes] = []

    def flush() -> pa.RecordBatch:
        keys = _numbers(held)
        docs, texts = (np.repeat(np.array(x, np.int64), times) for x in zip(*owners))
        order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
        keys, docs, texts = keys[order], docs[order], texts[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]).any(1)
        starts = np.flatnonzero(first)
        marked = docs[starts] != docs[np.r_[starts[1:], len(docs)] - 1]
        rows: list[tuple] = []
        again = np.repeat(marked, np.diff(np.r_[starts, len(docs)]))
        if again.any():
            rows.append((-1 - xxhash.xxh3_64_intdigest(str(owners[0])) % (4 * shards), docs[again].tobytes(), texts[again].tobytes(), keys[again].tobytes(), None))
        keys, docs, texts = keys[starts], docs[starts], texts[starts]
        shard = (keys[:, 0] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(ends)):
            at = order[ends[s] : ends[s + 1]]
            rows.append((int(s), docs[at].tobytes(), texts[at].tobytes(), keys[at].tobytes(), marked[at].tobytes()))
        for part in (owners, times, held):
            part.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FILED)], names=[n for n, _ in _FILED])

    size = 0
    for batch in batches:
        for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if found := _keys(text.as_py(), least):
                owners.append((doc_id, mark))
                times.append(len(found))
                held.extend(found)
                size += len(found)
        if size >= FLUSH:
            yield flush()
            size = 0
    if held:
        yield flush()


def twice_seen(keys: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which keys the second of two Bloom filters knows after all of them went through: those that come twice or are
    marked, and a few others."""
    bits = 1 << max(10, math.ceil(math.log2(len(keys) * BITS + 1)))
    mask = np.uint64(bits - 1)
    places = [keys[:, 1] & mask, (keys[:, 1] >> np.uint64(32)) & mask]
    out = np.ones(len(keys), bool)
    for place in places:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for at in range(0, len(keys), _CHUNK):
            some, times = np.unique(place[at : at + _CHUNK], return_counts=True)
            twice[some] |= once[some] | (times > 1)
            once[some] = True
        twice[place[marked]] = True
        out &= twice[place]
    return out


def _suspected(table: pa.Table) -> pa.Table:
    """A shard's keys that may be repeats and haven't been told of yet, with the documents that hold them; what is in
    parts below 0 is known to be."""
    docs, texts, keys = (np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in (("docs", "<i8"), ("texts", "<i8"), ("keys", "<u8")))
    keys = keys.reshape(-1, 2)
    if table.column("part")[0].as_py() >= 0:
        marked = np.frombuffer(b"".join(table.column("marked").to_pylist()), bool)
        some = twice_seen(keys, marked) & ~marked
        docs, texts, keys = docs[some], texts[some], keys[some]
    return pa.table([pa.array(docs), pa.array(texts), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())], names=["doc_id", "mark", "key"])


def _rebuilt(batches: Iterator[pa.RecordBatch], least: int, text_col: str) -> Iterator[pa.RecordBatch]:
    names = ["row", "kept_text", "n_lines", "n_dropped"]
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, drops in zip(batch.column(0).field(text_col), batch.column(1)):
            text, drops = text.as_py() or "", drops.as_py()
            if not drops:
                texts.append(text)
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                continue
            gone = set(drops)
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            kept = [x for x in lines if (k := line_key(x, least)) is None or xxhash.xxh3_128_digest(k) not in gone]
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """docs with the columns kept_text, n_lines (before) and n_dropped (long) added, one row for each row.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of ``least`` code points or more that
    two or more documents hold lose all their lines, except those in the document with the smallest id. Null and empty
    texts have one empty line. Rows with the same id count as one document, and so do rows with a null id, which comes
    last. Columns of docs that have one of the added names are replaced; others pass unchanged; an empty table stays
    empty. Keys are confirmed by their 128-bit digests.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    text = F.col(text_col).cast("string")
    row = [text.alias(text_col) if c == text_col else F.col(c) for c in others]
    # rows without an id are one document, and many: what they drop is gathered by text
    who = [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0)).alias("mark")]
    source = docs.select(F.struct(*row).alias("row"), *who)
    told = docs.select(*who, text.alias("text"))
    total = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = parts_of(docs.sparkSession, total / LINE / LINES)
    filed = told.mapInArrow(streamed(_filed, shards, least), "part int, docs binary, texts binary, keys binary, marked binary")
    suspects = written(filed.groupBy("part").applyInArrow(grouped(_suspected), "doc_id long, mark long, key binary"), "line-suspects")
    repeated = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    repeated = written(repeated, "line-repeats")  # so that the join below may split a key that many documents have
    drops = suspects.join(repeated, "key").filter("doc_id <> first").groupBy("doc_id", "mark").agg(F.collect_set("key").alias("drops"))
    made = source.join(drops, ["doc_id", "mark"], "left").select("row", "drops")
    out = made.mapInArrow(streamed(_rebuilt, least, text_col), f"row {source.schema['row'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long")
    kept = [F.col("row").getField(c).cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in others]
    return out.select(*kept, "kept_text", "n_lines", "n_dropped")
