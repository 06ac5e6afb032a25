"""Long byte strings that occur more than once in the corpus, by longest previous factors in suffix order.

Every window of ``length`` bytes is owned by the least-hashed stretch of ``ANCHOR`` bytes inside it, so equal windows
are owned by equal stretches at the same place. Neighbouring windows of one owner form a run. Counts of owners, and of
whole runs, settle nearly all windows without moving a text: an owner seen once has no repeated window, and a whole
run seen twice has only repeated ones. The rest, the runs around the ends of a repeated passage, are gathered by owner
in groups of bounded size, as no factor of ``length`` bytes can lead out of its owner. In each group, the windows whose
hash occurs twice are put in suffix order. The previous and the next smaller position in this order give the longest
previous factor of each, and windows whose factor reaches ``length`` are later copies. Longer factors need no number, so
the order goes to the depth of ``length`` bytes. Owners with more runs than a group holds are settled by counts of
window digests.

``keep_first`` leaves the first copy by (id, place) and drops the later ones; otherwise all copies go. Bytes covered by
a dropped window are removed. Windows never cross documents, and are judged on the input alone.

Defined cases: a null text is empty and loses nothing, as does one shorter than ``length``; rows equal in id and text
are copies of each other, and with ``keep_first`` all of them stay, as they cannot be told apart; null ids are ids like
any other; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import equal_rows, measured, text_key
from opinara.llm.hashing import BASE, U, Rolling, mix

LENGTH, ANCHOR = 200, 50
#: Windows worked on at a time; also the range of places inside a sort key.
STRETCH = 1 << 20
#: Bytes of text that are put in suffix order together, on average, and the most runs of one owner among them.
GROUP_BYTES, OWNER_RUNS = 1_000_000, 2_000
KEYS = ["_id", "_key"]


def runs(data: np.ndarray, length: int, anchor: int):
    """(owner, whole, start, windows) of the runs of one text: hash of the owning stretch, hash of all bytes that the
    run's windows cover, first window and number of windows."""
    out = []
    width = length - anchor + 1  # stretches in a window
    for low in range(0, len(data) - length + 1, STRETCH - length + 1):
        part = data[low:low + STRETCH]
        if len(part) < length:
            break
        rolling = Rolling(part)
        place = np.arange(len(part) - anchor + 1)
        hashes = rolling.of(place, place + anchor)
        # Hash above, place below: the least key is the leftmost of the least hashes.
        least = (hashes & ~U(STRETCH - 1)) | place.astype(U)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[:size - width], least[width - size:])
        start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.concatenate((start[1:], [len(least)]))
        at = (least[start] & U(STRETCH - 1)).astype(np.int64)
        whole = mix(rolling.of(start, end - 1 + length) + (at - start).astype(U) * U(BASE))
        out.append((hashes[at], whole, start + low, end - start))
        if len(part) < STRETCH:
            break
    if not out:
        return tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def run_rows(docs: DataFrame, length: int, anchor: int, counted: bool) -> DataFrame:
    """Runs of all texts: counted by (owner, whole) within each batch, or one by one with their place.

    A place is the first window times 256 plus the number of windows, which is below 256.
    """
    if length - anchor >= 255 or anchor >= length:
        raise ValueError("the anchor must be shorter than the length by 1 to 254 bytes")

    def task(batches):
        for batch in batches:
            found, rows = [], []
            for i, content in enumerate(batch.column(2)):
                data = np.frombuffer((content.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                if len(data) >= length:
                    found.append(runs(data, length, anchor))
                    rows.append(np.full(len(found[-1][0]), i))
            if not found:
                continue
            owner, whole, start, windows = (np.concatenate(x) for x in zip(*found))
            owner, whole = owner.view(np.int64), whole.view(np.int64)
            if counted:
                order = np.lexsort((whole, owner))
                owner, whole = owner[order], whole[order]
                first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1]))))
                n = np.diff(np.concatenate((first, [len(owner)])))
                yield pa.record_batch([pa.array(owner[first]), pa.array(whole[first]), pa.array(n)], names=["owner", "whole", "n"])
            else:
                index = pa.array(np.concatenate(rows))
                yield pa.record_batch([batch.column(0).take(index), batch.column(1).take(index), pa.array(owner), pa.array(whole),
                                       pa.array((start << 8) | windows)], names=[*KEYS, "owner", "whole", "place"])

    if counted:
        return docs.mapInArrow(task, "owner bigint, whole bigint, n bigint")
    return docs.mapInArrow(task, "_id bigint, _key bigint, owner bigint, whole bigint, place bigint")


def suffix_ranks(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Rank of every position by the next ``length`` bytes (8 at least), and (n, what tells the next n bytes apart) for
    each power of two up to ``length``."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    packed = np.zeros(len(data), dtype=U)
    for i in range(8):
        packed = (packed << U(8)) | padded[i:i + len(data)].astype(U)
    levels = [(n, packed >> U(64 - 8 * n)) for n in (1, 2, 4)]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    levels.append((8, rank))

    def joined(rank, step):
        after = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))[:len(rank)]
        return np.unique(rank * np.int64(len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)

    size = 8
    while size * 2 <= length:
        rank = joined(rank, size)
        size *= 2
        levels.append((size, rank))
    return joined(rank, length - size) if size < length else rank, levels


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes agree from ``a`` and from ``b`` on, ``length`` at most, which the data must still hold there."""
    agreed = np.zeros(len(a), np.int64)
    for size, tells in levels[::-1]:
        asked = np.flatnonzero(agreed + size <= length)
        at = agreed[asked]
        agreed[asked] += size * (tells[a[asked] + at] == tells[b[asked] + at])
    return agreed


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the order, the nearest before and after it that holds a smaller position, else -1."""
    before, after, open_ = [-1] * len(order), [-1] * len(order), []
    positions = order.tolist()
    for i, position in enumerate(positions):
        while open_ and positions[open_[-1]] > position:
            after[open_.pop()] = i
        if open_:
            before[i] = open_[-1]
        open_.append(i)
    return np.array(before, np.int64), np.array(after, np.int64)


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of every window at ``starts`` (ascending), and the index of an earlier window that has it.

    The windows are put in suffix order, to the depth of ``length`` bytes; longer factors count as ``length``. The longest
    match with any earlier window is that with the previous or the next smaller position in this order. -1: no match.
    """
    rank, levels = suffix_ranks(data, length)
    order = np.lexsort((starts, rank[starts]))
    factor, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for near in smaller_neighbours(order):
        has = np.flatnonzero(near >= 0)
        own, other = order[has], order[near[has]]
        agreed = common_prefix(levels, starts[own], starts[other], length)
        longer = agreed > factor[own]
        factor[own[longer]], source[own[longer]] = agreed[longer], other[longer]
    return factor, source


def spans(flags: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches of bytes covered by the flagged windows; starts ascend."""
    at = starts[flags]
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.concatenate((cut, [len(at) - 1]))] + length).tolist()))


def settle(table: pa.Table, length: int, keep_first: bool) -> pa.Table:
    """Copied stretches among the runs of one group: rows of (_id, _key, start, end)."""
    listed = sorted(
        zip(*(table[c].to_pylist() for c in (*KEYS, "place", "bytes"))), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    segments = [np.frombuffer(r[3], np.uint8) for r in listed]
    # A first look by hash leaves only windows that may be copies; what is equal is then decided in suffix order.
    hashes = [Rolling(s).of(np.arange(len(s) - length + 1), np.arange(length, len(s) + 1)) for s in segments]
    unique, n = np.unique(np.concatenate(hashes), return_counts=True)
    twice = unique[n > 1]
    texts, starts, owner, moved, at = [], [], [], [], 0
    for i, (s, h) in enumerate(zip(segments, hashes)):
        near = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
        maybe = np.flatnonzero(twice[near] == h) if len(twice) else near[:0]
        if not len(maybe):
            continue
        low, high = int(maybe[0]), int(maybe[-1]) + length
        texts.append(s[low:high])
        starts.append(maybe - low + at)
        owner.append(np.full(len(maybe), i))
        moved.append(maybe + (listed[i][2] >> 8))
        at += high - low
    rows = []
    if texts:
        factor, source = previous_factors(np.concatenate(texts), np.concatenate(starts), length)
        flags = factor >= length
        if not keep_first:
            # The second of equal windows has the first as its source, so every window of a repeat is reached.
            flags[source[flags]] = True
        owner, moved = np.concatenate(owner), np.concatenate(moved)
        edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            doc, key = listed[owner[a]][:2]
            rows += [(doc, key, *span) for span in spans(flags[a:b], moved[a:b], length)]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=[*KEYS, "start", "end"])


def hot_spans(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for owners with too many runs for one group: every window is a row, counted by its digest."""

    def task(batches):
        for batch in batches:
            for doc, key, place, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in (*KEYS, "place", "bytes"))):
                data, low = data.as_py(), place.as_py() >> 8
                n = len(data) - length + 1
                digests = [hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n)]
                yield pa.record_batch([pa.array([doc.as_py()] * n, pa.int64()), pa.array([key.as_py()] * n, pa.int64()),
                                       pa.array(np.arange(low, low + n)), pa.array(digests, pa.binary())], names=[*KEYS, "start", "window"])

    windows = segments.mapInArrow(task, "_id bigint, _key bigint, start bigint, window binary")
    counts = windows.groupBy("window").agg(F.count("*").alias("_n"), F.min(F.struct(*KEYS, "start")).alias("_first")).where("_n > 1")
    copies = windows.join(counts, "window")
    if keep_first:
        copies = copies.where(F.struct(*KEYS, "start") != F.col("_first"))
    return copies.select(*KEYS, "start", (F.col("start") + length).alias("end"))


def copied_spans(
    docs: DataFrame, length: int, anchor: int, keep_first: bool, group_bytes: int = GROUP_BYTES, owner_runs: int = OWNER_RUNS,
) -> DataFrame:
    """(_id, _key, start, end): stretches of bytes covered by copies. ``docs`` has (_id, _key, _text)."""
    kinds = run_rows(docs, length, anchor, counted=True).groupBy("owner", "whole").agg(F.sum("n").alias("n"))
    owners = kinds.groupBy("owner").agg(F.count("*").alias("n_kinds"), F.min("n").alias("_least"), F.sum("n").alias("_all"))
    repeated = owners.where("_all > 1").select("owner", "n_kinds", "_least")
    state = measured(kinds.join(repeated, "owner"), "runs")
    # Runs to look into: of an owner with several kinds. Where all copies go, an owner whose kinds all repeat is settled.
    open_ = F.col("n_kinds") > 1
    if not keep_first:
        open_ = open_ & (F.col("_least") == 1)
    size = state.where(open_).count() * (length + (length - anchor) // 2)
    groups = max(1, -(-size // group_bytes))

    placed = measured(run_rows(docs, length, anchor, counted=False).join(
        state.select("owner", "whole", "n", "n_kinds", open_.alias("_open")), ["owner", "whole"]), "repeated_runs")
    # One run stands for its kind; of kinds seen once it is the run itself.
    firsts = placed.groupBy("owner", "whole").agg(
        F.first("n").alias("n"), F.first("n_kinds").alias("n_kinds"), F.first("_open").alias("_open"),
        F.min(F.struct(*KEYS, "place")).alias("_first"))
    first, number = F.shiftright("place", 8), F.col("place").bitwiseAND(F.lit(255))
    whole_runs = placed.where("n > 1")
    if keep_first:
        whole_runs = equal_rows(whole_runs, firsts.where("n > 1").select("owner", "whole", "_first.*", F.lit(1).alias("_is_first")),
                                ["owner", "whole", *KEYS, "place"], "left").where("_is_first IS NULL")
    marks = whole_runs.select(*KEYS, first.alias("start"), (first + number - 1 + length).alias("end"))

    wanted = firsts.where("_open").select("owner", "n_kinds", "_first.*").groupBy(*KEYS).agg(
        F.collect_list(F.struct("owner", "n_kinds", "place")).alias("_runs"))
    texts = equal_rows(docs, wanted, KEYS, "inner")

    def cut(batches):
        for batch in batches:
            for doc, key, content, listed in zip(*(batch.column(batch.schema.get_field_index(c)) for c in (*KEYS, "_text", "_runs"))):
                data, listed = content.as_py().encode("utf-8", "surrogatepass"), listed.as_py()
                places = [r["place"] for r in listed]
                yield pa.record_batch([
                    pa.array([doc.as_py()] * len(listed), pa.int64()), pa.array([key.as_py()] * len(listed), pa.int64()),
                    pa.array([r["owner"] for r in listed], pa.int64()), pa.array([r["n_kinds"] for r in listed], pa.int64()),
                    pa.array(places, pa.int64()),
                    pa.array([data[p >> 8:(p >> 8) + (p & 255) - 1 + length] for p in places], pa.binary()),
                ], names=[*KEYS, "owner", "n_kinds", "place", "bytes"])

    segments = texts.select(*KEYS, "_text", "_runs").mapInArrow(
        cut, "_id bigint, _key bigint, owner bigint, n_kinds bigint, place bigint, bytes binary")
    some = segments.where(F.col("n_kinds") <= owner_runs).withColumn("_group", F.pmod(F.xxhash64("owner"), F.lit(groups)))
    settled = some.groupBy("_group").applyInArrow(
        lambda table: settle(table, length, keep_first), "_id bigint, _key bigint, start bigint, end bigint")
    found = marks.unionByName(settled)
    if state.where(open_ & (F.col("n_kinds") > owner_runs)).take(1):
        found = found.unionByName(hot_spans(segments.where(F.col("n_kinds") > owner_runs), length, keep_first))
    return found


def merged(listed: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(listed):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    keep_first: bool = True, with_bytes: bool = True, group_bytes: int = GROUP_BYTES, owner_runs: int = OWNER_RUNS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes ``kept``."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("_id"), text_key(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    found = copied_spans(keyed, length, anchor, keep_first, group_bytes, owner_runs)
    packed = found.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    joined = equal_rows(keyed, packed, KEYS, "left").select("_id", "_text", "_spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_bytes else "")
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_bytes
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        for batch in batches:
            rows = []
            for doc, content, listed in zip(*(batch.column(i) for i in range(3))):
                data = (content.as_py() or "").encode("utf-8", "surrogatepass")
                gone = merged([(s["start"], s["end"]) for s in listed.as_py() or ()])
                edges = [0, *[x for span in gone for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (doc.as_py(), len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_bytes else row)
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return joined.mapInArrow(task, schema)
