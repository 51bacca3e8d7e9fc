"""Set-similarity self-join of documents on word shingles, by vertical partitioning.

The global n-gram order (64-bit shingle hashes, ascending) is cut into fragments. Each fragment is counted on its own:
which shingles of a document some other document has too, and how often. These partial counts, summed per document,
leave only documents that can have a partner; partial overlaps of candidate pairs, counted per fragment of the order and
summed per pair, decide.

Why nothing is lost. Let need(n) = ceil(0.75 n). A and B link only if |A & B| >= need(max(|A|, |B|)). By the prefix
principle the first |A| - need(|A|) + k shingles of A and the first |B| - need(|B|) + k of B, in any common order, share
at least k. So each document sends only that part of its shingles to the fragments. Among them it must share ``least``
ones, whatever partner of admissible length it has; with shingles ordered by their counts, rarest first, the prefix
principle then applies a second time, and shingles of one document only need not be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, grouped, parts_of, small_batches, streamed, written

#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: A flush of the map side: that many shingles at most, or one document.
FLUSH = 600_000
#: Shingles that so many different documents of one flush hold are sent as counted, without their documents.
HOT = 64
#: Shingles a fragment should hold, and candidate documents a bucket should hold.
FRAGMENT, BUCKET = 1_200_000, 600_000
#: Sets to be looked at whole up to which their names are broadcast (32 bytes each).
MOST_FOUND = 200_000
_COMMON = 0xFFFFFFFF


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; with fewer words, of its whole sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    k = min(words, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += each[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(_mixed(out))


class Rule:
    """The lengths that follow from a similarity of per_cent / 100, for the first prefixes and for whole sets."""

    def __init__(self, per_cent: int, whole: bool = False):
        self.per_cent, self.whole = per_cent, whole

    def need(self, n):
        return -(-n * self.per_cent // 100)

    def wanted(self, n):
        """k of the first prefix; it may differ between partners, as the smaller k holds for both."""
        return np.maximum(1, n // 10)

    def prefix(self, n):
        return n if self.whole else np.minimum(n, n - self.need(n) + self.wanted(n))

    def least(self, n):
        """Shared shingles with any partner; in a first prefix, with the shortest one, of need(n) shingles."""
        return self.need(n) if self.whole else self.wanted(self.need(n))


def _pairs_of(column: list[bytes]) -> np.ndarray:
    """16-byte names of sets as two numbers each."""
    return np.frombuffer(b"".join(x for x in column if x), "<u8").reshape(-1, 2)


def _coded(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different names, and which of them each one is."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    sorted_ = names[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = (sorted_[1:] != sorted_[:-1]).any(1)
    code = np.empty(len(names), np.int64)
    code[order] = np.cumsum(fresh) - 1
    return sorted_[fresh], code


_FIRST = "part int, doc_id long, n int, key binary, classes binary, sizes binary, counts binary, tokens binary, hot binary"
_SECOND = "part int, doc_id long, n int, key binary, classes binary, sizes binary, counts binary, tokens binary, seen binary"


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in schema], names=[n for n, _ in schema])


_FIRST_ARROW = [("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), *((x, pa.binary()) for x in ("classes", "sizes", "counts", "tokens", "hot"))]
_SECOND_ARROW = [*_FIRST_ARROW[:-1], ("seen", pa.binary())]


def _fragment_of(tokens: np.ndarray, fragments: int) -> np.ndarray:
    """Ranges of the order: the first prefixes lie in its first two fifths, so half of the fragments are cut from these."""
    low = np.uint64(int((1 << 64) * 0.4))
    half = fragments // 2
    first = tokens // (low // np.uint64(half) + np.uint64(1))
    rest = (np.maximum(tokens, low) - low) // (np.uint64((1 << 64) - 1 - int(low)) // np.uint64(fragments - half) + np.uint64(1)) + np.uint64(half)
    return np.where(tokens < low, first, rest).astype(np.int64)


def _packed(classes, sizes, counts, tokens) -> dict:
    return {"classes": np.ascontiguousarray(classes).tobytes(), "sizes": sizes.astype("<u4").tobytes(), "counts": counts.astype("<u4").tobytes(), "tokens": tokens.astype("<u8").tobytes()}


def _deal(entries: list[tuple[bytes, int, np.ndarray]], fragments: int) -> list[dict]:
    """(a set's name, its size, shingles) to a row for each fragment. Shingles that HOT of the entries hold are only
    named there; their holders go to parts below 0, which are dealt evenly."""
    classes = _pairs_of([c for c, _, _ in entries])
    sizes = np.fromiter((n for _, n, _ in entries), np.int64, len(entries))
    counts = np.fromiter((len(t) for _, _, t in entries), np.int64, len(entries))
    tokens = np.concatenate([t for _, _, t in entries])
    owner = np.repeat(np.arange(len(entries)), counts)
    part = _fragment_of(tokens, fragments)
    values, times = np.unique(tokens, return_counts=True)
    hot = values[times >= HOT]
    common = np.isin(tokens, hot) if len(hot) else np.zeros(len(tokens), bool)
    out = []
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(fragments + 1))
    hot_part = _fragment_of(hot, fragments)
    for f in range(fragments):
        at = order[bounds[f] : bounds[f + 1]]
        at = at[~common[at]]
        mine = hot[hot_part == f]
        if len(at) or len(mine):
            own, times_of = np.unique(owner[at], return_counts=True)
            out.append({"part": f, "hot": mine.astype("<u8").tobytes()} | _packed(classes[own], sizes[own], times_of, tokens[at]))
    if len(hot):
        own, times_of = np.unique(owner[common], return_counts=True)
        out.append({"part": -1 - int(classes[0, 0] % np.uint64(4 * fragments))} | _packed(classes[own], sizes[own], times_of, tokens[common]))
    return out


def _cut(batches: Iterator[pa.RecordBatch], rule: Rule, words: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """Documents to prefixes, dealt out by fragment; copies within a flush go once."""
    held: dict[bytes, tuple[bytes, int, np.ndarray]] = {}
    size = 0
    for batch in batches:
        docs = []
        for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            found = shingles(text.as_py(), words)
            n = len(found)
            key = xxhash.xxh3_128_digest(found.tobytes()) if n else None
            docs.append({"part": -1 - i % (4 * fragments), "doc_id": doc_id, "n": n, "key": key})
            if n and key not in held:
                held[key] = (key, n, found[: int(rule.prefix(n))].copy())
                size += len(held[key][2])
        yield _rows(_FIRST_ARROW, docs)
        if size >= FLUSH:
            yield _rows(_FIRST_ARROW, _deal(list(held.values()), fragments))
            held.clear()
            size = 0
    if held:
        yield _rows(_FIRST_ARROW, _deal(list(held.values()), fragments))


def _recut(batches: Iterator[pa.RecordBatch], fragments: int) -> Iterator[pa.RecordBatch]:
    """The candidates' whole sets, dealt out by fragment."""
    held: list[tuple[bytes, int, np.ndarray]] = []
    size = 0
    for batch in batches:
        for node, n, grams in zip(*(c.to_pylist() for c in batch.columns)):
            found = np.frombuffer(grams, "<u8")
            if len(found):
                held.append((node.to_bytes(16, "little"), n, found))
                size += len(found)
        if size >= FLUSH:
            yield _rows(_FIRST_ARROW, _deal(held, fragments))
            held, size = [], 0
    if held:
        yield _rows(_FIRST_ARROW, _deal(held, fragments))


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _counted(table: pa.Table, buckets: int) -> pa.Table:
    """One fragment: the shingles that several documents hold, with how many, dealt out by document."""
    none = pa.table({n: pa.array([], t) for n, t in _SECOND_ARROW})
    part = table.column("part")[0].as_py()
    if part < 0:  # documents, and shingles that are known to be common
        rows = []
        for r in table.select(["doc_id", "n", "key"]).filter(pa.compute.is_valid(table.column("n"))).to_pylist():
            rows.append({"part": -1} | r)
        got = table.filter(pa.compute.is_valid(table.column("classes")))
        if not len(got):
            return pa.Table.from_batches([_rows(_SECOND_ARROW, rows)]) if rows else none
        keep_all = True
    else:
        rows, got, keep_all = [], table, False
    kinds, code = _coded(_pairs_of(got.column("classes").to_pylist()))
    sizes, counts, tokens = (_joined(got.column(x), k) for x, k in (("sizes", "<u4"), ("counts", "<u4"), ("tokens", "<u8")))
    own, token_size = np.repeat(code, counts), np.repeat(sizes, counts)
    order = np.lexsort((own, tokens))
    own, tokens, token_size = own[order], tokens[order], token_size[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (tokens[1:] != tokens[:-1])
    own, tokens, token_size = own[fresh], tokens[fresh], token_size[fresh]
    if keep_all:
        seen = np.full(len(own), _COMMON, np.int64)
        keep = np.ones(len(own), bool)
    else:
        _, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
        seen = times[at]
        common = np.isin(tokens, _joined(got.column("hot"), "<u8"))
        seen = np.where(common, _COMMON, seen)
        keep = seen >= 2
    own, tokens, token_size, seen = own[keep], tokens[keep], token_size[keep], seen[keep]
    bucket = (kinds[:, 0] % np.uint64(buckets)).astype(np.int64)[own]
    order = np.lexsort((own, bucket))
    own, tokens, token_size, seen, bucket = own[order], tokens[order], token_size[order], seen[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        s = slice(bounds[b], bounds[b + 1])
        if s.stop > s.start:
            c, first, times = np.unique(own[s], return_index=True, return_counts=True)
            rows.append({"part": b, "seen": seen[s].astype("<u4").tobytes()} | _packed(kinds[c], token_size[s][first], times, tokens[s]))
    return pa.Table.from_batches([_rows(_SECOND_ARROW, rows)]) if rows else none


def _summed(table: pa.Table, rule: Rule) -> pa.Table:
    """Partial counts summed per document; those that can have a partner, with their rarest shared shingles, before
    which ``skip`` of their own stand in the order."""
    kinds, code = _coded(_pairs_of(table.column("classes").to_pylist()))
    sizes, counts, tokens, seen = (_joined(table.column(x), k) for x, k in (("sizes", "<u4"), ("counts", "<u4"), ("tokens", "<u8"), ("seen", "<u4")))
    own, n = np.repeat(code, counts), np.repeat(sizes, counts).astype(np.int64)
    order = np.lexsort((tokens, seen, own))
    own, n, tokens = own[order], n[order], tokens[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (tokens[1:] != tokens[:-1])
    own, n, tokens = own[fresh], n[fresh], tokens[fresh]
    ids, first, shared = np.unique(own, return_index=True, return_counts=True)
    n = n[first]
    prefix, least = rule.prefix(n), rule.least(n)
    take = np.minimum(shared, prefix - least + 1 - (prefix - shared))
    ok = (take > 0) & (shared >= least)
    ids, first, n, take, skip = ids[ok], first[ok], n[ok], take[ok], (prefix - shared)[ok]
    values = np.concatenate([tokens[a : a + t] for a, t in zip(first, take)]) if len(ids) else np.empty(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
    keys = pa.array([kinds[i].tobytes() for i in ids], pa.binary())
    return pa.table([keys, pa.array(n.astype(np.int32)), pa.array(skip.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], names=["key", "n", "skip", "tokens"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names that were made of nodes, as nodes again."""
    for batch in batches:
        node = _pairs_of(batch.column(0).to_pylist())[:, 0].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), *batch.columns[1:]], names=["node", "n", "skip", "tokens"])


def _whole(batches: Iterator[pa.RecordBatch], words: int, cuts: int) -> Iterator[pa.RecordBatch]:
    """Candidates' whole sets, a row for each fragment of the order."""
    names = ["node", "n", "cut", "grams"]
    for batch in batches:
        rows = ([], [], [], [])
        for node, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = shingles(text.as_py(), words)
            if not len(found) or xxhash.xxh3_128_digest(found.tobytes()) != key:
                continue
            at = np.searchsorted(found, np.arange(1, cuts, dtype=np.uint64) * np.uint64((1 << 64) // cuts))
            for c, piece in enumerate(np.split(found, at)):
                for out, x in zip(rows, (node, len(found), c, piece.astype("<u8").tobytes())):
                    out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=names)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["u", "v", "both"])


def _linked(pairs: DataFrame, sets: DataFrame, per_cent: int, cuts: int) -> DataFrame:
    """Those of the pairs (u, v, un, vn) whose partial overlaps sum up to the similarity."""
    cut = pairs.select("u", "v", F.explode(F.array(*map(F.lit, range(cuts)))).alias("cut"))
    left = cut.join(sets.select(F.col("node").alias("u"), "cut", F.col("grams").alias("a")), ["u", "cut"])
    both = left.join(sets.select(F.col("node").alias("v"), "cut", F.col("grams").alias("b")), ["v", "cut"])
    parts = both.select("u", "v", "a", "b").mapInArrow(streamed(_overlaps), "u long, v long, both long")
    total = parts.groupBy("u", "v").agg(F.sum("both").alias("both")).join(pairs, ["u", "v"])
    return total.filter(F.col("both") * 100 >= (F.col("un") + F.col("vn") - F.col("both")) * per_cent).select("u", "v")


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per_cent: int = 75, cuts: int = 4, star_rounds: int = 4
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of per_cent / 100 or more.

    Returns one row per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach, its own
    included). Documents with equal sets, by 128-bit digests, are one node; links between different sets are found without
    loss, apart from collisions of shingles' 64-bit hashes. Pairs within a component that is already known are not tested again, so a group of
    near copies costs rows in proportion to its size. Nulls, empty and blank texts have an empty set and are linked with
    nothing; ids that repeat count as one document whose rows share their links; other columns are ignored; an empty
    table gives an empty result; a null id is kept and never the smallest.
    """
    small_batches(docs.sparkSession)
    rule = Rule(per_cent)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = size / 6 * (1 - per_cent / 100 + 0.1)
    fragments = max(4, parts_of(docs.sparkSession, 2 * tokens / FRAGMENT))
    buckets = parts_of(docs.sparkSession, tokens / BUCKET)
    first = source.mapInArrow(streamed(_cut, rule, words, fragments), _FIRST)
    counted = written(first.groupBy("part").applyInArrow(grouped(_counted, buckets), _SECOND), "ngram-fragments")
    ids = counted.filter(F.col("n").isNotNull()).select("doc_id", "n", "key")
    nodes = ids.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    first_names = written(_candidates(counted, rule).select("key"), "ngram-first")
    found = nodes.join(first_names, "key", "left_semi").select(F.col("first_id").alias("found_id"), "node", "key")
    if first_names.count() <= MOST_FOUND:
        found = F.broadcast(found)
    whole = source.join(found, F.col("doc_id").eqNullSafe(F.col("found_id"))).select("node", "key", "text").mapInArrow(streamed(_whole, words, cuts), "node long, n int, cut int, grams binary")
    sets = written(whole.dropDuplicates(["node", "cut"]), "ngram-sets")
    again = sets.select("node", "n", "grams").mapInArrow(streamed(_recut, fragments), _FIRST)
    second = again.groupBy("part").applyInArrow(grouped(_counted, buckets), _SECOND)
    cands = _candidates(second, Rule(per_cent, whole=True))
    cands = written(cands.mapInArrow(streamed(_numbered), "node long, n int, skip int, tokens array<long>"), "ngram-candidates")
    links = _all_links(cands, sets, per_cent, cuts, star_rounds)
    for df in (first_names, sets, cands):  # what is left is read by the answer
        dropped(df)
    return _answer(ids, nodes, links)


def _candidates(counted: DataFrame, rule: Rule) -> DataFrame:
    packed = counted.filter(F.col("classes").isNotNull()).select("part", "classes", "sizes", "counts", "tokens", "seen")
    return packed.groupBy("part").applyInArrow(grouped(_summed, rule), "key binary, n int, skip int, tokens array<long>")


def _answer(ids: DataFrame, nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    named = nodes.select("key", "node", "first_id")
    if comps is not None:
        named = named.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        named = named.withColumn("component", F.col("node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(least, "component").select("key", "component_id")
    out = ids.join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _all_links(cands: DataFrame, sets: DataFrame, per_cent: int, cuts: int, star_rounds: int) -> DataFrame | None:
    """Components of the candidates.

    Each round tests, for every shingle's list of documents, a hub (after the first round, another one for each shingle)
    against the others, as many pairs as postings, and merges what links; lists within one component are done. When the pairs between different components are few beside
    the postings (places and lengths rule most of them out as they meet), or after star_rounds, all of them are tested.
    """
    place = (F.col("skip") + F.col("i")).alias("place")
    listed = written(cands.select("node", "n", "skip", F.posexplode("tokens").alias("i", "token")).select("token", "node", "n", place), "ngram-lists")
    postings = listed.count()
    edges = tested = comps = None

    def fits(a: str, b: str):
        """Lengths, and what can follow in both after a first common shingle at these places."""
        (an, ap), (bn, bp) = ((F.col(f"{x}n"), F.col(f"{x}place")) for x in (a, b))
        return (F.least(an, bn) * 100 >= F.greatest(an, bn) * per_cent) & (F.least(an - ap, bn - bp) * (100 + per_cent) >= (an + bn) * per_cent)

    open_ = listed.withColumn("component", F.col("node"))
    for turn in range(star_rounds + 1):
        if comps is not None:
            before, open_ = open_, open_.drop("component").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spans = open_.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        spans = written(spans.filter("low <> high").select("token"), "ngram-spans")  # so that joins may split hot shingles
        open_ = written(open_.join(spans, "token", "left_semi"), "ngram-open")
        dropped(before if comps is not None else listed)
        groups = open_.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
        left = groups.groupBy("token").agg((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))).alias("p")).agg(F.sum("p") / 2, F.count(F.lit(1))).first()
        if not left[1]:
            break
        full = turn == star_rounds or left[0] <= max(20_000, (1, 8, 256)[min(turn, 2)] * postings)
        if full:
            a, b = open_.alias("a"), open_.alias("b")
            pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.node") < F.col("b.node")) & fits("a.", "b."))
            pairs = pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("un"), F.col("b.n").alias("vn"))
        else:
            pick = F.xxhash64(F.lit(turn), F.col("token") if turn else F.lit(0), "node")
            pick = F.struct("place", pick) if turn % 2 else pick  # most can follow after an early place
            hubs = open_.groupBy("token").agg(F.min_by(F.struct("node", "n", "place", "component"), pick).alias("hub"))
            hubs = written(hubs, "ngram-hubs")
            pairs = open_.join(hubs, "token").filter((F.col("hub.component") != F.col("component")) & fits("", "hub."))
            swap = F.col("hub.node") < F.col("node")
            pairs = pairs.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"), F.when(swap, F.col("hub.n")).otherwise(F.col("n")).alias("un"), F.when(swap, F.col("n")).otherwise(F.col("hub.n")).alias("vn"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "ngram-pairs")
        new = written(_linked(pairs, sets, per_cent, cuts), "ngram-links")
        tested = pairs.select("u", "v") if tested is None else tested.unionByName(pairs.select("u", "v"))
        edges = new if edges is None else edges.unionByName(new)
        if not new.isEmpty():
            comps = components(edges)
        if full:
            break
    return comps
