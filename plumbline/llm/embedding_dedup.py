"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c lie within a squared distance of 2 - 2c. After a rotation, vectors are cut into blocks; of two
such vectors, at least one block's squared distance is within that block's share. So each block is range-joined alone,
on a grid over its first coordinates: only ids and a few of the block's coordinates travel. What a join proposes fetches
its whole vectors and is verified on them; vectors that no join proposes are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, grouped, small_batches, streamed, written

BLOCKS, GRID, SEED = 8, 3, 7
#: Coordinates of a block that travel to its cells; a distance over them is never more than over the whole block.
SENT = 8
#: Homes and guests in a cell beyond which its rows and columns are split; entries and vectors' components that a task
#: should get; vectors of a flush.
CELL, BUCKET, COMPONENTS, FLUSH = 20_000, 2_000_000, 1 << 24, 20_000
#: Whole vectors that a task should verify, if they aren't long.
VERIFIED = 5_000
#: What rounding may take from a squared distance, over doubles and over the floats that travel.
_SLACK, _SLACK_SENT = 1e-9, 1e-5


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))[0]


def _cells(x: np.ndarray, label: np.ndarray, radius: float, grid: int, halo: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cell ids) of the cells in which the rows of one block's coordinates stand, or with halo those of all cells
    that a ball around each may reach: cells are twice as wide as its radius, so two in each direction."""
    radius *= 1 + 1e-6
    width = 2 * radius
    at = np.floor(x[:, :grid] / width).astype(np.int64)
    if not halo:
        yield np.arange(len(x)), _hashed(at, label)
        return
    side = np.where(x[:, :grid] - at * width < radius, -1, 1)
    for step in product((0, 1), repeat=at.shape[1]):
        yield np.arange(len(x)), _hashed(at + side * np.array(step), label)


def _hashed(at: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(at.shape[1]):
        out = (out ^ at[:, k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _vectors(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Plan:
    """What follows from the dimension and the least cosine."""

    def __init__(self, dim: int, cosine: float, blocks: int, grid: int):
        self.dim, self.cosine = dim, cosine
        self.blocks = min(blocks, dim)
        self.ends = [dim * (i + 1) // self.blocks for i in range(self.blocks)]
        self.grid = grid
        budget = 2 - 2 * cosine + _SLACK
        self.limits = [budget * (to - at) / dim for at, to in zip([0, *self.ends], self.ends)]

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(self.dim), self.ends[:-1], axis=1)


#: Cells that are split, in order, and into how many slices of homes and of guests.
Crowded = tuple[np.ndarray, np.ndarray, np.ndarray]


def _crowd(batches: Iterator[pa.RecordBatch], plan: Plan, heavy) -> Iterator[pa.RecordBatch]:
    """Vectors per cell, by batch: homes, or the guests that come from the cells ``heavy``."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(label):
            continue
        ids = []
        for b, x in enumerate(plan.cut(_vectors(batch, 0, plan.dim))):
            place = label * plan.blocks + b, plan.limits[b] ** 0.5, plan.grid
            home = next(_cells(x, *place, False))[1]
            if heavy is None:
                ids.append(home)
            elif (some := np.isin(home, heavy.value)).any():
                ids += [c for _, c in _cells(x[some], place[0][some], *place[1:], True)]
        cells, times = np.unique(np.concatenate([np.empty(0, np.uint64), *ids]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(times)], names=["cell", "times"])


def _crowded(vectors: DataFrame, plan: Plan) -> tuple[Crowded, int]:
    """Which cells are split, and how many entries that adds. vectors: columns vector, place (a label's number).

    A cell's guests come from the 3 ** grid cells around it. Those from cells of few homes are fewer than ``most``
    together; only the others are counted."""
    most = max(1, min(CELL, COMPONENTS // (8 * plan.dim)))

    def counted(least: int, heavy=None) -> dict[int, int]:
        crowd = vectors.select("vector", "place").mapInArrow(streamed(_crowd, plan, heavy), "cell long, times long")
        crowd = crowd.groupBy("cell").agg(F.sum("times").alias("times")).filter(F.col("times") > least).collect()
        return {r["cell"] % (1 << 64): r["times"] for r in crowd}

    homes = counted(most // 3**plan.grid)  # at most blocks rows in so many vectors
    send = vectors.sparkSession.sparkContext.broadcast  # 8 bytes for each of these rows
    guests = counted(most // 3**plan.grid, send(np.array(sorted(homes), np.uint64))) if homes else {}
    marks, rows, columns, more = [], [], [], 0
    for mark in sorted({*homes, *guests}):
        h, g = homes.get(mark, 0), guests.get(mark, 0) + most
        s, t = max(1, -(-h // most)), -(-g // most) if g > 2 * most else 1
        if s > 1 or t > 1:
            marks.append(mark)
            rows.append(s)
            columns.append(t)
            more += max(h, most) * (t - 1) + g * (s - 1)
    return (np.array(marks, np.uint64), np.array(rows, np.int64), np.array(columns, np.int64)), more


def _slice(ids: np.ndarray, slices: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % slices.astype(np.uint64)).astype(np.int64)


def _split(ids: np.ndarray, cells: np.ndarray, at: np.ndarray, crowded: Crowded, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries of split cells, as positions in ids and cells of their own: a home in its slice is compared with each slice
    of guests, a guest in its own with each slice of homes, so that any two of them meet in one."""
    slices, others = (crowded[1][at], crowded[2][at]) if own else (crowded[2][at], crowded[1][at])
    mine = np.repeat(np.arange(len(ids)), others)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(others) - others, others)
    first = _slice(ids, slices)[mine]
    both = np.stack([first, other] if own else [other, first], axis=1)
    return mine, _hashed(both, cells[mine])


def _dealt(batches: Iterator[pa.RecordBatch], plan: Plan, buckets: int, sent) -> Iterator[pa.RecordBatch]:
    """Ids and some coordinates to the buckets of their cells: home in one cell of each block, a guest in those nearby. A
    crowded cell is split into slices of homes times slices of guests, each of which is dealt to a bucket of its own."""
    crowded: Crowded = sent.value
    marks = crowded[0]
    flush = max(100, FLUSH // int(max([1, *crowded[1], *crowded[2]])))
    names = ["bucket", "ids", "coordinates", "owners", "cells", "blocks", "home"]
    for whole in batches:
        for start in range(0, whole.num_rows, flush):
            batch = whole.slice(start, flush)
            ids = batch.column(0).to_numpy().astype(np.int64)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, cell, block, home, parts = [], [], [], [], []
            for b, part in enumerate(plan.cut(_vectors(batch, 2, plan.dim))):
                few = np.zeros((len(ids), SENT), "<f4")
                few[:, : part.shape[1]] = part[:, :SENT]
                parts.append(few)
                for own in (True, False):
                    for rows, cells in _cells(part, label * plan.blocks + b, plan.limits[b] ** 0.5, plan.grid, not own):
                        if len(marks):
                            at = np.minimum(np.searchsorted(marks, cells), len(marks) - 1)
                            hit = marks[at] == cells
                            if hit.any():
                                some = rows[hit]
                                mine, split = _split(ids[some], cells[hit], at[hit], crowded, own)
                                rows, cells = np.concatenate([rows[~hit], some[mine]]), np.concatenate([cells[~hit], split])
                        owner.append(rows * plan.blocks + b)
                        cell.append(cells)
                        block.append(np.full(len(rows), b))
                        home.append(np.full(len(rows), own))
            owner, cell, block, home = (np.concatenate(v) for v in (owner, cell, block, home))
            coordinates = np.stack(parts, axis=1).reshape(-1, SENT)
            bucket = ((cell >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            owner, cell, block, home, bucket = owner[order], cell[order], block[order], home[order], bucket[order]
            out: dict[str, list] = {n: [] for n in names}
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            for s, e in zip(starts, [*starts[1:], len(bucket)]):
                rows, local = np.unique(owner[s:e], return_inverse=True)
                packed = (int(bucket[s]), ids[rows // plan.blocks].tobytes(), coordinates[rows].tobytes(), local.astype("<u4").tobytes(), cell[s:e].tobytes(), block[s:e].astype(np.uint8).tobytes(), home[s:e].tobytes())
                for n, v in zip(names, packed):
                    out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in names[1:])], names=names)


def _buckets(vectors: int, more: int, plan: Plan) -> int:
    """Buckets of so many vectors, whose entries are ``more`` by split cells."""
    entries = vectors * plan.blocks * (1 + 2**plan.grid) + more
    return max(4, -(-entries // BUCKET))


def _runs(cell: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal cells begins and ends."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])


def _proposed(table: pa.Table, plan: Plan) -> pa.Table:
    """One bucket: the homes and guests of cells that are near another one by the coordinates that were sent."""
    ids, coordinates, owners, base = [], [], [], 0
    for i, c, o in zip(*(table.column(n).to_pylist() for n in ("ids", "coordinates", "owners"))):
        ids.append(np.frombuffer(i, "<i8"))
        coordinates.append(np.frombuffer(c, "<f4").reshape(-1, SENT))
        owners.append(np.frombuffer(o, "<u4").astype(np.int64) + base)
        base += len(ids[-1])
    ids, x, owner = np.concatenate(ids), np.concatenate(coordinates), np.concatenate(owners)
    cell, block, home = (np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in (("cells", "<u8"), ("blocks", np.uint8), ("home", bool)))
    square = (x**2).sum(1)
    order = np.lexsort((~home, cell))
    owner, cell, block, home = owner[order], cell[order], block[order], home[order]
    found: list[tuple[np.ndarray, int, int, bool]] = []
    for s, e in _runs(cell):
        n_home = int(home[s:e].sum())
        own, guests = owner[s : s + n_home], owner[s + n_home : e]
        if not n_home or not len(guests):
            continue
        limit = np.float32(plan.limits[block[s]] + _SLACK_SENT)
        step = max(1, 2_000_000 // len(guests))
        far = np.zeros(n_home, bool)
        seen = np.zeros(len(guests), bool)
        for at in range(0, n_home, step):
            mine = own[at : at + step]
            near = square[mine][:, None] + square[guests][None] - 2 * x[mine] @ x[guests].T <= limit
            near &= ids[mine][:, None] != ids[guests][None]
            far[at : at + step] = near.any(1)
            seen |= near.any(0)
        if seen.any():
            found += [(ids[own[far]], int(cell[s]), int(block[s]), True), (ids[guests[seen]], int(cell[s]), int(block[s]), False)]
    size = [len(f[0]) for f in found]
    node = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    columns = [np.repeat(np.array([f[k] for f in found], t), size) for k, t in ((1, np.uint64), (2, np.int32), (3, bool))]
    return pa.table([pa.array(node), pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2])], names=["node", "cell", "block", "home"])


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b):
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(table: pa.Table, plan: Plan) -> pa.Table:
    """Some cells' homes and guests with their whole vectors: per vector the weight of the others linked, each pair counted
    in the first block that proposes it, and enough links to connect what is connected here."""
    table = table.sort_by([("cell", "ascending"), ("home", "descending"), ("node", "ascending")]).combine_chunks()
    ids, weights, cell, block = (table.column(n).to_numpy() for n in ("node", "weight", "cell", "block"))
    home = table.column("home").to_numpy(zero_copy_only=False)
    label = table.column("label").dictionary_encode().combine_chunks().indices.to_numpy()
    x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, plan.dim)
    norm = np.linalg.norm(x, axis=1)
    parts = plan.cut(x)
    count = np.zeros(len(ids), np.int64)
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    for s, e in _runs(cell):
        n_home = int(home[s:e].sum())
        own, guests = np.arange(s, s + n_home), np.arange(s + n_home, e)
        if not n_home or not len(guests):
            continue
        b = int(block[s])
        step = max(1, 2_000_000 // len(guests))
        near_a, near_b = [], []
        for at in range(0, n_home, step):
            mine = own[at : at + step]
            far = (parts[b][mine] ** 2).sum(1)[:, None] + (parts[b][guests] ** 2).sum(1)[None] - 2 * parts[b][mine] @ parts[b][guests].T
            i, j = np.nonzero(far <= plan.limits[b] + _SLACK)
            i, j = mine[i], guests[j]
            ok = (ids[i] != ids[j]) & (label[i] == label[j])
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 500_000):
                p, q = i[k : k + 500_000], j[k : k + 500_000]
                ok = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= plan.cosine
                for k_block in range(b + 1):
                    ok &= (((parts[k_block][p] - parts[k_block][q]) ** 2).sum(1) <= plan.limits[k_block]) == (k_block == b)
                p, q = p[ok], q[ok]
                np.add.at(count, p, weights[q])
                near_a.append(p)
                near_b.append(q)
        if near_a and len(a := np.concatenate(near_a)):
            c = np.concatenate(near_b)
            nodes, local = np.unique(np.concatenate([ids[a], ids[c]]), return_inverse=True)
            root = _least_labels(len(nodes), local[: len(a)], local[len(a) :])
            moved = root != np.arange(len(nodes))
            forest.append((nodes[moved], nodes[root[moved]]))
    some = np.flatnonzero(count)
    none = np.empty(0, np.int64)
    u = np.concatenate([ids[some], *(f[0] for f in forest), none])
    v = np.concatenate([np.full(len(some), -1), *(f[1] for f in forest), none])
    n = np.concatenate([count[some], *(np.zeros(len(f[0]), np.int64) for f in forest), none])
    return pa.table([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], names=["u", "v", "n"])


def embedding_components(
    table: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = BLOCKS, grid: int = GRID
) -> DataFrame:
    """Per row of table: vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that links
    reach, its own included), kept (vec_id = component_id).

    Rows link when their labels are equal and not null, their vectors equally long and their cosine, in double precision
    over the components as stored, is ``cosine`` or more. Labels are of any type that can be compared. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing. Equal vectors of a label are compared once,
    with their number; ids that repeat are rows of their own with one component id in common; null ids never are the
    smallest; other columns are ignored; an empty table gives an empty result. n_links needs every linked pair looked at,
    so time grows with the square of a group of different near copies; a crowded cell's vectors go to each slice that
    they meet, so that no task holds more than a slice.
    """
    spark = table.sparkSession
    small_batches(spark)
    vector = F.col("vector")
    kind = table.schema[vector_col].dataType
    stored = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(stored).alias("vector"))
    rows = rows.withColumn("good", F.coalesce(good & F.col("label").isNotNull(), F.lit(False))).withColumn("mark", F.xxhash64("label", "vector"))
    valid = rows.filter("good")
    classes = valid.groupBy("mark", "label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "embedding-classes")
    found = None
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):  # one or a few model dimensions
        plan = Plan(dim, cosine, blocks, grid)
        mine = classes.filter(F.col("dim") == dim).withColumn("place", F.xxhash64("label"))
        crowded, more = _crowded(mine, plan)
        sent = spark.sparkContext.broadcast(crowded)
        dealt = mine.select("node", "place", "vector").mapInArrow(
            streamed(_dealt, plan, _buckets(mine.count(), more, plan), sent), "bucket int, ids binary, coordinates binary, owners binary, cells binary, blocks binary, home binary"
        )
        near = written(dealt.groupBy("bucket").applyInArrow(grouped(_proposed, plan), "node long, cell long, block int, home boolean"), "embedding-near")
        whole = near.join(mine.select("node", "label", "weight", "vector"), "node")
        tasks = max(4, -(-near.count() // min(VERIFIED, max(1, COMPONENTS // dim))))
        part = whole.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int")).groupBy("bucket").applyInArrow(grouped(_verified, plan), "u long, v long, n long")
        part = written(part, "embedding-links")
        dropped(near)
        found = part if found is None else found.unionByName(part)
    keys = ["mark", "label", "vector"]
    if found is None:
        nodes = classes.select(*keys, "weight", F.lit(0).cast("long").alias("n"), F.col("first_id").alias("component_id"))
    else:
        counts = found.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "node")
        comps = components(found.filter("v >= 0").select("u", "v"))
        nodes = classes.join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
        nodes = nodes.join(least, "component").select(*keys, "weight", F.coalesce("n", F.lit(0)).alias("n"), "component_id")
    out = rows.join(nodes.withColumn("good", F.lit(True)), [*keys, "good"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("weight") - 1 + F.col("n"), F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
