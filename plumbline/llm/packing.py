"""Packing of token sequences by local search: pieces move and are exchanged between underfull bins until bins empty."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grouped, small_batches, streamed, written
from .tokens import ByteIds, forget, loaded

#: Pieces packed together.
GROUP = 20_000


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: pieces over capacity - t stand alone, those of t or more fill what the larger ones leave."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = count * np.arange(capacity + 1)
    above = lambda a: count[a:].sum()
    best = -(-int(mass.sum()) // capacity)
    half = capacity // 2
    for t in range(1, half + 1):
        big, mid = int(above(capacity - t + 1)), slice(half + 1, capacity - t + 1)
        free = capacity * int(count[mid].sum()) - int(mass[mid].sum())
        small = int(mass[t : half + 1].sum())
        best = max(best, big + int(count[mid].sum()) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit, longest first: each piece's bin. Open bins are found by the free room they have left."""
    bins = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            left, b, made = capacity, made, made + 1
        bins[i] = b
        left -= size
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins


def next_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Longest first, a new bin whenever one doesn't fit: each piece's bin. Cheap, with much room left."""
    bins = np.empty(len(lengths), np.int64)
    b, left = -1, -1
    for i in np.argsort(-lengths, kind="stable").tolist():
        if lengths[i] > left:
            b, left = b + 1, capacity
        bins[i] = b
        left -= int(lengths[i])
    return bins


class Search:
    """Local search over bins that are not full. Each step makes the bin that is being emptied, u, lighter and one that
    is heavier after it than u was before: so the sum of squared fills rises with every step, and the search ends.

    What a bin v can give for S tokens is a piece shorter than S which, with v's room, is S or longer. So underfull bins
    are kept by their room, for moves, and their pieces by length plus room, their ``end``, for exchanges: of all ends
    from S on, up to those that would leave v lighter than u, the shortest piece is wanted.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.capacity = capacity
        self.lengths, self.bins = lengths.tolist(), bins.tolist()
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64).tolist()
        self.held: list[set[int]] = [set() for _ in self.fill]
        for i, b in enumerate(self.bins):
            self.held[b].add(i)
        self.rooms = 0  # a bit for each room that some open bin has
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.by_end: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]  # heaps; old versions go when met
        self.shortest = np.full(capacity + 1, capacity + 1, np.int64)
        self.version = [0] * len(self.fill)
        self.moves = self.swaps = self.doubles = 0
        for b in range(len(self.fill)):
            self._note(self._opened(b))

    def _opened(self, b: int) -> set[int]:
        """b takes part; the ends that this concerns."""
        room = self.capacity - self.fill[b]
        if not room or not self.held[b]:
            return set()
        self.by_room[room].add(b)
        self.rooms |= 1 << room
        kinds = {self.lengths[i]: i for i in self.held[b]}
        for size, i in kinds.items():
            heapq.heappush(self.by_end[size + room], (size, b, self.version[b], i))
        return {size + room for size in kinds}

    def _closed(self, b: int) -> set[int]:
        room = self.capacity - self.fill[b]
        if not room or not self.held[b]:
            return set()
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        self.version[b] += 1
        return {self.lengths[i] + room for i in self.held[b]}

    def _note(self, ends: set[int]) -> None:
        for end in ends:
            heap = self.by_end[end]
            while heap and self.version[heap[0][1]] != heap[0][2]:
                heapq.heappop(heap)
            self.shortest[end] = heap[0][0] if heap else self.capacity + 1

    def _exchanged(self, v: int, given: tuple[int, ...], taken: tuple[int, ...], u: int) -> None:
        """The pieces ``given`` go from u to v, those ``taken`` from v to u."""
        ends = self._closed(v)
        for pieces, to, other in ((taken, u, v), (given, v, u)):
            for i in pieces:
                self.held[other].discard(i)
                self.held[to].add(i)
                self.fill[other] -= self.lengths[i]
                self.fill[to] += self.lengths[i]
                self.bins[i] = to
        self._note(ends | self._opened(v))

    def _moved(self, u: int) -> int:
        """Pieces of u, longest first, to the fullest bin that has room."""
        before = self.moves
        for i in sorted(self.held[u], key=lambda i: (-self.lengths[i], i)):
            fits = self.rooms >> self.lengths[i]
            left = (fits & -fits).bit_length() - 1
            if fits and left < self.capacity - self.fill[u]:
                self._exchanged(next(iter(self.by_room[self.lengths[i] + left])), (i,), (), u)
                self.moves += 1
        return self.moves - before

    def _best(self, u: int, offers: dict[int, tuple[int, ...]]) -> bool:
        """The exchange of one of the offers, by tokens, that makes u lightest; False if there is none."""
        most, found = 0, None
        for size, pieces in offers.items():
            ends = self.shortest[size : size + self.capacity - self.fill[u]]
            if len(ends):
                at = int(ends.argmin())
                if size - ends[at] > most:
                    most, found = size - int(ends[at]), (pieces, size + at)
        if found is None:
            return False
        _, v, _, i = self.by_end[found[1]][0]
        self._exchanged(v, found[0], (i,), u)
        return True

    def _swapped(self, u: int) -> bool:
        """One piece of u for one, else two for one."""
        one: dict[int, tuple[int, ...]] = {}
        two: dict[int, tuple[int, ...]] = {}
        for i in sorted(self.held[u]):
            for size, (j,) in one.items():
                if size + self.lengths[i] <= self.capacity:
                    two.setdefault(size + self.lengths[i], (i, j))
            one.setdefault(self.lengths[i], (i,))
        if self._best(u, one):
            self.swaps += 1
            return True
        if self._best(u, two):
            self.doubles += 1
            return True
        return False

    def lightened(self, u: int) -> bool:
        """Everything that can be taken out of u; whether anything could."""
        before = self.moves + self.swaps + self.doubles
        self._note(self._closed(u))
        while self._moved(u) or self.held[u] and self._swapped(u):
            pass
        self._note(self._opened(u))
        return self.moves + self.swaps + self.doubles > before

    def run(self, bound: int) -> np.ndarray:
        """Goes through the underfull bins, lightest first, again and again, until ``bound`` bins are left or no bin has
        an improving step; each piece's bin."""
        used, going = sum(map(bool, self.held)), True
        while used > bound and going:
            going = False
            queue = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            heapq.heapify(queue)
            while queue and used > bound:
                f, b = heapq.heappop(queue)
                if f != self.fill[b]:  # heavier since
                    if 0 < self.fill[b] < self.capacity:
                        heapq.heappush(queue, (self.fill[b], b))
                elif self.lightened(b):
                    going = True
                    used -= not self.held[b]
        return np.array(self.bins, np.int64)


def searched(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, dict[str, int]]:
    """Each piece's bin, from 0 without gaps, and the steps taken. Starts from next fit. last: where bins are left above
    the lower bound, the search is tried from best fit as well, and the result with fewer bins stays."""
    bound = least_bins(lengths, capacity)
    search = Search(lengths, next_fit(lengths, capacity), capacity)
    bins = np.unique(search.run(bound), return_inverse=True)[1]
    if last and len(bins) and bins.max() + 1 > bound:
        other = Search(lengths, best_fit(lengths, capacity), capacity)
        tried = np.unique(other.run(bound), return_inverse=True)[1]
        if tried.max() < bins.max():
            search, bins = other, tried
    return bins, {"moves": search.moves, "swaps": search.swaps, "doubles": search.doubles}


def _pieces(batches: Iterator[pa.RecordBatch], version: str, content, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """Each document's pieces. What encodes is made anew by each task, in 0.2 s: a worker that waits for others holds none."""
    made = content.value.decode("utf-8")
    memo = ByteIds(loaded(version, made), made)
    forget(version)
    tail = end.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = memoryview(memo.of(text.as_py() or "") + tail)
            n = len(ids) // 4
            at, to, piece = 0, n % capacity or capacity, 0
            while at < n:
                for out, x in zip(rows, (doc_id, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to]))):
                    out.append(x)
                at, to, piece = to, to + capacity, piece + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)


def _packed(table: pa.Table, capacity: int, level: int, last: bool) -> pa.Table:
    """One group's pieces in sequences. Unless it is the last one, the lightest underfull sequences, up to a tenth of the
    pieces, are left open: their pieces are packed again, with those of other groups."""
    order = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
    lengths = order.column("length").to_numpy().astype(np.int64)
    bins, _ = searched(lengths, capacity, last)
    at = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[at])
    first = np.ones(len(at), bool)
    first[1:] = bins[at][1:] != bins[at][:-1]
    base = np.maximum.accumulate(np.where(first, ends - lengths[at], 0))
    offset = np.empty(len(at), np.int64)
    offset[at] = ends - lengths[at] - base
    fill, held = np.bincount(bins, weights=lengths), np.bincount(bins)
    lightest = np.argsort(fill, kind="stable")
    lightest = lightest[(fill[lightest] < capacity) & (np.cumsum(held[lightest]) <= len(at) / 10)]
    open_ = np.zeros(len(fill), bool)
    open_[[] if last else lightest] = True
    number = (level << 56) + order.column("part").to_numpy().astype(np.int64) * (1 << 32) + bins
    out = order.select(["doc_id", "piece", "start", "length", "ids_crc32", "row"])
    return out.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("open", pa.array(open_[bins]))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0, group: int = GROUP) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens, as few as it can.

    A document is its ids without added special tokens, then ``end``; longer ones are cut so that only the first piece
    may be shorter. Full pieces are sequences of their own; the others are dealt at random into groups of about
    ``group``, each packed by local search from a cheap start. The lightest sequences of all groups, at most a tenth of
    the pieces, are then packed again, in a tenth of the groups, until one group is left. Returns per piece: doc_id, piece
    int, start, length, ids_crc32, sequence_id, offset (long). Null and empty texts are one piece with the end alone;
    repeated rows and ids are packed row by row; a null id stays null; other columns are ignored; an empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    raw = Path(tokenizer_path).read_bytes()
    version = hashlib.sha256(raw).hexdigest()
    content = docs.sparkSession.sparkContext.broadcast(raw)  # a vocabulary file of a few MB
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = source.mapInArrow(streamed(_pieces, version, content, capacity, end), schema)
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    rest, level, groups = pieces.filter(F.col("length") < capacity), 0, 1 << 62
    while groups > 1:
        groups = max(1, min(round(rest.count() / group), groups // 2))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int"))
        packed = dealt.groupBy("part").applyInArrow(grouped(_packed, capacity, level, groups == 1), schema + ", row long, sequence_id long, offset long, open boolean")
        packed = packed if groups == 1 else written(packed, "sequences")
        out = out.unionByName(packed.filter(~F.col("open")).drop("open", "row"))
        rest, level = packed.filter("open").drop("sequence_id", "offset", "open"), level + 1
    return out
