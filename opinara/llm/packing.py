"""Packing of token sequences into as few sequences of fixed capacity as can be found.

Pieces are dealt evenly to groups of bounded size. Each group is packed by best fit, longest first, and then improved
by local search: a piece is moved, or one or two shorter pieces are exchanged for it, whenever that makes the squared
fill larger, which drains the emptiest sequence until it can go. The search ends when no underfull sequence has such an
exchange left, or when the group fills as few sequences as its tokens need. The sequences that a group leaves underfull are taken
apart and packed again together with those of the other groups.

Defined cases: a null text is empty and holds the end id only; an empty table gives no pieces; repeated rows and null
ids are packed like any others; other columns are not carried; equal lengths are told apart by their place only.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.common import measured
from opinara.llm.tokens import encoder

CAPACITY = 4096
#: Most pieces that meet in one task, on average of the groups.
GROUP_PIECES = 40_000
PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])


def pieces(
    df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode every text, add the end id and cut what is longer than the capacity: one row per piece."""
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def task(batches):
        enc = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = enc.ids(content.as_py() or "") + end
                for k, low in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[low:low + 4 * capacity]
                    row = (doc, k, low // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(task, out)


class Bins:
    """Sequences of one group: the places and sorted lengths in each, and which rooms are left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # (length, place), ascending
        self.fill: list[int] = []
        self.rooms: dict[int, set[int]] = {}
        self.bits = 0  # bit r: some sequence has room r

    def put(self, b: int, change: int) -> None:
        old, new = self.capacity - self.fill[b], self.capacity - self.fill[b] - change
        self.drop(b, old)
        self.fill[b] += change
        self.rooms.setdefault(new, set()).add(b)
        self.bits |= 1 << new

    def drop(self, b: int, room: int) -> None:
        held = self.rooms.get(room)
        if held and b in held:
            held.remove(b)
            if not held:
                del self.rooms[room]
                self.bits &= ~(1 << room)

    def tightest(self, length: int, other_than: int = -1) -> int | None:
        """The sequence with the least room that takes this length."""
        above = self.bits >> length
        while above:
            room = length + (above & -above).bit_length() - 1
            for b in self.rooms[room]:
                if b != other_than:
                    return b
            above = self.bits >> (room + 1) << (room + 1 - length)
        return None

    def add(self, length: int, place: int) -> None:
        b = self.tightest(length)
        if b is None:
            b = len(self.items)
            self.items.append([])
            self.fill.append(0)
        insort(self.items[b], (length, place))
        self.put(b, length)

    def trade(self, item: tuple[int, int], a: int, b: int, back: tuple[tuple[int, int], ...] = ()) -> None:
        """Move a piece from a to b, and others back."""
        self.items[a].remove(item)
        for other in back:
            self.items[b].remove(other)
            insort(self.items[a], other)
        insort(self.items[b], item)
        gain = item[0] - sum(n for n, _ in back)
        self.put(a, -gain)
        self.put(b, gain)


class Index:
    """What every underfull sequence could give back, so that partners are looked up instead of tried one by one.

    A sequence of room r gives back the sum s of none, one or two of its pieces. A piece of length n then goes there from
    a sequence of room q, and the sum of squared fills grows, just when s < n <= r + s < n + q. So the least s is kept
    for each r + s; and for each length, the widest sequence found without a partner, to look at it again once a changed
    sequence could take that length. Entries are numbers that hold a version, and outdated ones are dropped when met.
    """

    def __init__(self, bins: Bins):
        self.bins, self.capacity = bins, bins.capacity
        self.version = [0] * len(bins.items)
        self.sums: dict[int, np.ndarray] = {}
        self.none = self.capacity + 1
        self.waiting: list[list[int]] = [[] for _ in range(self.none)]
        self.widest = np.full(self.none, -1)
        self.lengths = np.arange(self.none)
        self.waits: set[int] = set()
        self.rebuild()

    def rebuild(self) -> None:
        self.heaps: list[list[int]] = [[] for _ in range(self.none)]
        self.least = np.full(self.none, self.none)
        self.entries = 0
        for b in range(len(self.bins.items)):
            self.enter(b)
        self.most = 4 * self.entries + 200_000

    def code(self, first: int, b: int) -> int:
        return first << 64 | b << 32 | self.version[b]

    def top(self, heap: list[int]) -> int | None:
        while heap and self.version[heap[0] >> 32 & 0xFFFFFFFF] != heap[0] & 0xFFFFFFFF:
            heappop(heap)
        return heap[0] if heap else None

    def enter(self, b: int) -> None:
        room = self.capacity - self.bins.fill[b]
        if not 0 < room < self.capacity:
            return
        sums = self.sums.get(b)
        if sums is None:
            held, times = np.unique([n for n, _ in self.bins.items[b]], return_counts=True)
            i, j = np.triu_indices(len(held), 1)
            sums = self.sums[b] = np.unique(np.concatenate([[0], held, 2 * held[times > 1], held[i] + held[j]]))
        self.least[room + sums] = np.minimum(self.least[room + sums], sums)
        for s in sums.tolist():
            heappush(self.heaps[room + s], self.code(s, b))
        self.entries += len(sums)

    def changed(self, *changed: int) -> list[int]:
        """Take note of changed sequences; gives the waiting ones that could now send them a piece."""
        for b in changed:
            self.version[b] += 1
            self.sums.pop(b, None)
            self.waits.discard(b)
        for b in changed:
            self.enter(b)
        if self.entries > self.most:
            self.rebuild()
        again = []
        for b in changed:
            room, sums = self.capacity - self.bins.fill[b], self.sums.get(b)
            if sums is None:
                continue
            at = np.searchsorted(sums, self.lengths - room)
            back = np.append(sums, self.none)[at]
            # The sender needs this much room for the squared fill to grow.
            needed = np.maximum(1, room - (self.lengths - 1 - back))
            for n in np.flatnonzero((back < self.lengths) & (self.widest >= needed)).tolist():
                heap = self.waiting[n]
                while (t := self.top(heap)) is not None and (wide := self.capacity - (t >> 64)) >= needed[n]:
                    c = heappop(heap) >> 32 & 0xFFFFFFFF
                    if c in self.waits:
                        self.waits.remove(c)
                        again.append(c)
                self.widest[n] = -1 if t is None else wide
        return again

    def wait(self, a: int) -> None:
        room = self.capacity - self.bins.fill[a]
        self.waits.add(a)
        for n in {n for n, _ in self.bins.items[a]}:
            heappush(self.waiting[n], self.code(self.capacity - room, a))
            self.widest[n] = max(self.widest[n], room)

    def partner(self, a: int) -> tuple[tuple[int, int], int, tuple[tuple[int, int], ...]] | None:
        """A piece of ``a``, the sequence it goes to, and the pieces that come back for it; the longest piece first."""
        room = self.capacity - self.bins.fill[a]
        self.version[a] += 1  # no partner of itself
        before = 0
        for item in reversed(self.bins.items[a]):
            length = item[0]
            if length == before:
                continue
            before = length
            while True:
                part = self.least[length:length + room]
                k = int(part.argmin()) if len(part) else 0
                if not len(part) or part[k] >= length:
                    break
                heap = self.heaps[length + k]
                t = self.top(heap)
                if t is not None and t >> 64 == part[k]:
                    b = t >> 32 & 0xFFFFFFFF
                    return item, b, self.given(b, t >> 64)
                self.least[length + k] = self.none if t is None else t >> 64
        self.enter(a)
        return None

    def given(self, b: int, total: int) -> tuple[tuple[int, int], ...]:
        """None, one or two pieces of ``b`` of this total."""
        held = self.bins.items[b]
        if not total:
            return ()
        at = bisect_left(held, (total, -1))
        if at < len(held) and held[at][0] == total:
            return (held[at],)
        low, high = 0, len(held) - 1
        while (both := held[low][0] + held[high][0]) != total:
            low, high = (low + 1, high) if both < total else (low, high - 1)
        return held[low], held[high]


def exchange(bins: Bins, a: int, index: Index | None = None) -> list[int] | None:
    """One move or exchange that fills another sequence at the cost of ``a`` and makes the sum of squared fills larger.

    Gives the sequences to look at next, or None when ``a`` has no exchange left.
    """
    index = index or Index(bins)
    found = index.partner(a)
    if found is None:
        index.wait(a)
        return None
    item, b, back = found
    bins.trade(item, a, b, back)
    return [a, b, *index.changed(a, b)]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, exchanges: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; every length is between 1 and the capacity.

    The search ends when no underfull sequence has an exchange left, or when no fewer sequences could hold the lengths;
    ``exchanges`` ends it earlier.
    """
    bins = Bins(capacity)
    for place in np.argsort(-lengths, kind="stable"):
        bins.add(int(lengths[place]), int(place))
    least = -(-int(lengths.sum()) // capacity) if len(lengths) else 0
    used, made = len(bins.fill), 0
    if used > least and exchanges != 0:
        index = Index(bins)
        ready = [(f, b) for b, f in enumerate(bins.fill) if f < capacity]
        heapify(ready)
        while used > least and ready and made != exchanges:
            fill, a = heappop(ready)
            if fill != bins.fill[a] or a in index.waits:
                continue
            again = exchange(bins, a, index)
            if again is None:
                continue
            made += 1
            used -= not bins.fill[a]
            for b in again:
                if 0 < bins.fill[b] < capacity:
                    heappush(ready, (bins.fill[b], b))
    sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    for b, held in enumerate(bins.items):
        at = 0
        for length, place in held:
            sequence[place], offset[place] = b, at
            at += length
    return sequence, offset


def assigned(rows: DataFrame, length: str, capacity: int, group_pieces: int, exchanges: int | None, round_: int) -> DataFrame:
    """Pack the rows of each group; ``rows`` is written already and has a unique ``_row``."""
    groups = max(1, -(-rows.count() // group_pieces))
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("sequence_id bigint, offset bigint, _fill bigint").fields])

    def task(key, table):
        # Arrow keeps every column as it is; a data frame would turn whole numbers beside a null into doubles.
        table = table.drop_columns("_group").sort_by("_row")
        lengths = table[length].to_numpy().astype("int64")
        sequence, offset = pack(lengths, capacity, exchanges)
        fill = np.bincount(sequence, weights=lengths).astype("int64")
        number = (np.int64(round_) << 60) + (np.int64(key[0].as_py()) << 24) + sequence
        for name, values in (("sequence_id", number), ("offset", offset), ("_fill", fill[sequence])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(task, schema)


def packed(
    rows: DataFrame, length: str = "length", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
    exchanges: int | None = None,
) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; each length must be between 1 and the capacity."""
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    numbered = measured(rows.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    first = measured(assigned(numbered, length, capacity, group_pieces, exchanges, 0), "packed")
    full = first.where(F.col("_fill") == capacity)
    rest = first.where(F.col("_fill") < capacity).drop("sequence_id", "offset", "_fill")
    again = assigned(rest, length, capacity, group_pieces, exchanges, 1)
    return full.unionByName(again).select(*columns, "sequence_id", "offset")
