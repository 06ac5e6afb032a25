"""Near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct shingles of ``SHINGLE`` words. One hash of each shingle fills the bins of its
signature; a bin that stays empty takes the value of the first filled bin in a fixed random order of its own (optimal
densification). Bands of bins make buckets. Only one document per distinct word sequence goes on. In each bucket all
members are paired with the smallest one: a star, so pairs grow with members, not with their square. Pairs are
confirmed on the full sets and links are closed to components. Two members of a bucket may be similar although neither
is to the smallest, so the members paired with one centre are compared once more where they still lie in several
components: those outside the centre's largest component against all, in blocks of bounded size from which only links
come out.

With ``BANDS`` bands of ``ROWS`` bins, a pair of similarity 0.8 shares no bucket once in two million times; a more
similar one more rarely.

Defined cases: a null text, or one without words, has an empty set and is its own component; with fewer words than a
shingle the whole sequence is the one shingle; a null id belongs to no component but the row is kept; rows equal in
id and text are one document; rows of one id and different texts share the links of that id; other columns are not
carried; an empty table gives an empty result. Only A-Z are lower-cased.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import measured
from opinara.llm.hashing import BASE, U, Rolling, mix

SHINGLE, SIMILARITY = 5, 80
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Members of a star that are checked in one place; larger stars get copies of their centre.
STAR_PART = 500
#: Documents of each side of a block in which components are compared.
BLOCK = 250
#: Words hashed at a time.
STRETCH = 500_000


def words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased, cut at the six ASCII white space bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(tokens: list[bytes], size: int) -> set[tuple]:
    if len(tokens) < size:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[i:] for i in range(size))))


def shingle_hashes(tokens: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    parts = []
    for low in range(0, max(1, len(tokens) - size + 1), STRETCH):
        some = tokens[low:low + STRETCH + size - 1]
        data = np.frombuffer(b" ".join(some), dtype=np.uint8)
        # Words hold no space, so the spaces are the cuts.
        cuts = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(data)]))
        span = min(size, len(some))
        parts.append(Rolling(data).of(starts[:len(starts) - span + 1], ends[span - 1:]))
    return np.unique(np.concatenate(parts))


@cache
def probes() -> np.ndarray:
    """For each bin the order in which it looks for a filled one."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


@cache
def multipliers() -> np.ndarray:
    return mix(np.arange(1, BINS + 1, dtype=U) * U(BASE)).reshape(BANDS, ROWS) | U(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins filled from others. ``hashes`` are sorted, so a bin is a stretch."""
    bins = ((hashes >> U(32)) * U(BINS)) >> U(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    values, filled = np.zeros(BINS, dtype=U), np.zeros(BINS, dtype=bool)
    place = bins[first].astype(np.int64)
    values[place], filled[place] = hashes[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = probes()[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    rows = (mix(values.reshape(BANDS, ROWS)) * multipliers()).sum(axis=1, dtype=U)
    return mix(rows + np.arange(BANDS, dtype=U) * U(BASE)).view(np.int64)


def signed(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of every document; no bands where there are no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def task(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(content.as_py())
                digest = blake2b(b" ".join(tokens), digest_size=16).digest()
                if tokens:
                    hashes = shingle_hashes(tokens, size)
                    rows.append((doc, len(hashes), digest, bands(signature(hashes))))
                else:
                    rows.append((doc, 0, digest, None))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        task, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A text that many pairs share is copied to parts of them."""
    texts = texts.select(F.col("node").alias("_doc"), "_text")
    stars = measured(pairs.groupBy("a").agg(F.floor((F.count("*") - 1) / STAR_PART).cast("int").alias("_last")), "stars")
    left = stars.join(texts, stars["a"] == texts["_doc"]).select(
        "a", F.explode(F.sequence(F.lit(0), "_last")).alias("_part"), F.col("_text").alias("_ta"))
    dealt = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_last") + 1).cast("int").alias("_part"))
    right = dealt.join(texts, dealt["b"] == texts["_doc"]).select("a", "b", "_part", F.col("_text").alias("_tb"))
    both = right.join(left, ["a", "_part"]).select("a", "b", "_ta", "_tb")

    def task(batches):
        known, mine = None, set()
        for batch in batches:
            links = ([], [])
            for a, b, ta, tb in zip(*(batch.column(i) for i in range(4))):
                ta = ta.as_py()
                if ta != known:
                    known, mine = ta, shingle_set(words(ta), size)
                other = shingle_set(words(tb.as_py()), size)
                if similar(len(mine), len(other), len(mine & other), similarity):
                    links[0].append(a.as_py())
                    links[1].append(b.as_py())
            yield pa.record_batch([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return both.mapInArrow(task, "a bigint, b bigint").distinct()


def similar(first: int, second: int, common: int, similarity: int) -> bool:
    return common > 0 and 100 * common >= similarity * (first + second - common)


def compare(rows: list[tuple], size: int, similarity: int) -> list[tuple[int, int]]:
    """Links between components among the documents of one block, as few as join what is similar.

    ``rows``: (node, component, role, text). Role 0 is compared with all of the block, role 1 only with role 0. The
    overlaps of one document with all others are counted at once, through lists of the documents that hold a shingle.
    """
    ids: dict[tuple, int] = {}
    sets = [np.array([ids.setdefault(s, len(ids)) for s in shingle_set(words(r[3]), size)], dtype=np.int64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    holders = np.repeat(np.arange(len(rows)), sizes)
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    holders, low = holders[order], np.searchsorted(shingles[order], np.arange(len(ids) + 1))
    group = {r[1]: r[1] for r in rows}

    def root(c):
        while group[c] != c:
            c = group[c]
        return c

    links = []
    for i, row in enumerate(rows):
        if row[2] or not sizes[i]:
            continue
        common = np.bincount(np.concatenate([holders[low[s]:low[s + 1]] for s in sets[i]]), minlength=len(rows))
        near = np.flatnonzero((common > 0) & (100 * common >= similarity * (sizes[i] + sizes - common)))
        for j in near:
            mine, other = root(row[1]), root(rows[j][1])
            if mine != other:
                group[mine] = other
                links.append((row[0], rows[j][0]))
    return links


def across(tested: DataFrame, placed: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Links (a, b) that the stars have missed: between components of the members of one centre.

    ``tested``: the pairs (a, b) of centres and members, ``placed``: (node, component). The largest component of a
    centre is dealt to parts, and so is the rest; each part of the rest meets every part.
    """
    stars = tested.select("a", F.col("b").alias("node")).unionByName(tested.select("a", F.col("a").alias("node"))).distinct()
    members = measured(stars.join(placed, "node"), "members")
    sizes = members.groupBy("a", "component").agg(F.count("*").alias("n")).groupBy("a").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.max("n").alias("_m"), F.sum("n").alias("_all"))
    parts = sizes.where(F.col("_all") > F.col("_m")).select(
        "a", "main", (F.col("_all") <= BLOCK).alias("one"), F.floor((F.col("_m") - 1) / BLOCK + 1).cast("int").alias("pm"),
        F.floor((F.col("_all") - F.col("_m") - 1) / BLOCK + 1).cast("int").alias("ps"))
    met = members.join(measured(parts, "parts"), "a").withColumn("_rest", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("_rest"), F.col("ps")).otherwise(F.col("pm"))).cast("int")
    met = met.withColumn("_own", own)

    def place(i, j, role):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))

    def others(upto, make):
        return F.transform(F.sequence(F.lit(0), upto - 1), make)

    # Column j: parts of the rest, looking; row i: parts of the largest component, then parts of the rest.
    looked_at = F.filter(others(F.col("ps"), lambda j: place(F.col("pm") + F.col("_own"), j, 1)), lambda p: p["j"] < F.col("_own"))
    looking = others(F.col("pm"), lambda i: place(i, F.col("_own"), 0))
    blocks = (
        F.when(F.col("one"), F.array(place(F.lit(0), F.lit(0), 0)))
        .when(~F.col("_rest"), others(F.col("ps"), lambda j: place(F.col("_own"), j, 1)))
        .otherwise(F.concat(looking, looked_at, others(F.col("ps") - F.col("_own"), lambda k: place(F.col("pm") + F.col("_own") + k, F.col("_own"), 0))))
    )
    dealt = met.select("a", "node", "component", F.explode(blocks).alias("_b")).select("a", "node", "component", "_b.*")
    full = dealt.join(texts, "node").select("a", "i", "j", "node", "component", "role", "_text")

    def task(table):
        rows = list(zip(*(table[c].to_pylist() for c in ("node", "component", "role", "_text"))))
        links = compare(rows, size, similarity)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return full.groupBy("a", "i", "j").applyInArrow(task, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, the component named by its smallest node.

    Each round takes the least label among neighbours and then the label of that label, so long chains shrink by
    halves. Rounds are written to the shared folder; the driver sees only how many labels changed.
    """
    edges = measured(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = measured(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = edges.join(now, edges["b"] == now["node"]).groupBy("a").agg(F.min("component").alias("_near"))
        met = now.join(near, now["node"] == near["a"]).select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        label = now.select(F.col("node").alias("_n"), F.col("component").alias("_root"))
        met = met.join(label, met["_new"] == label["_n"], "left").select(
            "node", "_old", F.least("_new", F.coalesce("_root", "_new")).alias("component"))
        met = measured(met, "labels")
        changed = met.where(F.col("_old") != F.col("component")).count()
        now = met.select("node", "component")
        if not changed:
            return now


def link(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable) and kept."""
    found = measured(signed(docs, doc_id, text, size), "signed")
    real = found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # One node for each word sequence, whatever the number of its copies.
    nodes = measured(real.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("_c"), F.max("node").alias("_last"))
    centres = centres.where(F.col("_c.node") != F.col("_last")).select("bucket", F.col("_c.node").alias("centre"), F.col("_c.n").alias("_n"))
    star = members.join(centres, "bucket").where(F.col("node") != F.col("centre"))
    # Sets whose sizes differ too much cannot be similar; their texts need not meet.
    may = 100 * F.least("n", "_n") >= similarity * F.greatest("n", "_n")
    tested = measured(star.select(F.col("centre").alias("a"), F.col("node").alias("b"), may.alias("may")).distinct(), "pairs")
    # Only texts that share a bucket with another move; they are picked and written once.
    met = measured(tested.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("_text"))
    texts = measured(texts.join(met, "node", "left_semi"), "texts")
    links = measured(confirmed(tested.where("may").select("a", "b"), texts, size, similarity), "links")
    closed = components(links)
    placed = nodes.select("node").distinct().join(closed, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    more = measured(across(tested, placed, texts, size, similarity), "links")
    if more.take(1):
        closed = components(links.unionByName(more))

    classes = nodes.select("digest", "node").join(closed, "node", "left").select(
        F.col("digest").alias("_d"), F.coalesce("component", "node").alias("_c"))
    rows = found.select("doc_id", "n_shingles", "digest")
    joined = rows.join(classes, (rows["digest"] == classes["_d"]) & (rows["n_shingles"] > 0) & rows["doc_id"].isNotNull(), "left")
    component = F.coalesce("_c", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: the one of smallest id of each component, once; rows without an id all stay."""
    rows = measured(link(docs, doc_id, text, size, similarity), "components")
    dropped = measured(rows.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "dropped")
    stay = docs.join(dropped, F.col(doc_id) == F.col("_gone"), "left_anti")
    again = measured(rows.groupBy(F.col("doc_id").alias("_again")).count().where("count > 1 AND _again IS NOT NULL").select("_again"), "repeated")
    if not again.take(1):
        return stay
    on = F.col(doc_id) == F.col("_again")
    return stay.join(again, on, "left_anti").unionByName(stay.join(again, on, "left_semi").dropDuplicates([doc_id]))
