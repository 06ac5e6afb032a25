"""Counts of words and of neighbouring words in texts.

Tasks read texts by batches: words are numbered, neighbours are pairs of numbers, and a sort of the numbers counts them.
Spark sums the counts of batches by term. What a word is stays with Spark's own functions where it takes more than ASCII:
``spaced`` leaves no character beyond ASCII that is none of a word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import WORD_CHARS

#: Bytes of text that a task numbers at a time.
SLICE_BYTES = 8 << 20
#: Counts that a task holds before it hands them on.
HELD_ROWS = 2_000_000
#: Frequent words that tasks are sent, for each one asked for; where more share a count, all pairs are counted.
TIES = 4


def spaced(c: Column) -> Column:
    """A text with blanks for the characters beyond ASCII that belong to no word."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(c, rf"[^{WORD_CHARS}\x00-\x7F]", " ")).otherwise(c)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right"))
        yield low, (high := max(high, low + 1))
        low = high


def numbered(texts: pa.Array, apostrophes: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number and text of every word in order, and the words by number.

    Words have two characters or more. With ``apostrophes`` they may hold some, not in front; possessive endings and
    words that are numbers are dropped.
    """
    lists = pc.split_pattern_regex(texts, r"[^A-Za-z0-9_%s\x{80}-\x{10FFFF}]+" % ("'" if apostrophes else ""))
    coded = pc.list_flatten(lists).dictionary_encode()
    at, docs, words = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy(), coded.dictionary
    if apostrophes:
        words = pc.utf8_ltrim(words, "'")
    good = pc.greater_equal(pc.utf8_length(words), 2)
    if apostrophes:
        words = pc.replace_substring_regex(words, "'s$", "")
        good = pc.and_(good, pc.invert(pc.match_substring_regex(words, r"^\p{N}*$")))
        again = words.dictionary_encode()
        words, number = again.dictionary, again.indices.to_numpy()
    else:
        number = np.arange(len(words))
    kept = good.to_numpy(zero_copy_only=False)[at]
    return number[at[kept]].astype(np.int64), docs[kept].astype(np.int64), words


def runs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and in how many texts."""
    if not len(keys):
        return keys, keys, keys
    width = int(docs.max()) + 1
    if int(keys.max()) < (2**63 - 1) // width - 1:
        both = np.sort(keys * width + docs)
        keys = both // width
    else:
        order = np.lexsort((docs, keys))
        keys = keys[order]
        both = docs[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (both[1:] != both[:-1])))
    return keys[new], np.diff(np.append(new, len(keys))), np.add.reduceat(fresh.astype(np.int64), new)


def _texts(df: DataFrame, text: Column, by: str | None) -> tuple[DataFrame, str]:
    """(_by, _text) of every row, and the type of the group."""
    kind = df.schema[by].dataType.simpleString() if by else "string"
    lower = df.select((F.col(by) if by else F.lit(None).cast("string")).alias("_by"), text.alias("_lower"))
    return lower.select("_by", spaced(F.col("_lower")).alias("_text")), kind


def counted(
    df: DataFrame, text: Column, by: str | None = None, stop_words: list[str] = (), apostrophes: bool = False, words: bool = True,
    pairs: bool = False, across: bool = False,
) -> DataFrame:
    """(by, first, second, n, n_docs): how often words, and pairs of neighbours, occur, and in how many texts.

    ``second`` is NULL for a word. Neighbours are those of the text without stop words, or with ``across`` those of the
    whole text of which none is a stop word. A count comes in parts, to be summed. NULL is a group, too.
    """
    stop = list(stop_words)
    texts, kind = _texts(df, text, by)

    def rows(groups: pa.Array, values: pa.Array) -> pa.RecordBatch:
        at, docs, known = numbered(values, apostrophes)
        v = len(known)
        stopped = pc.is_in(known, value_set=pa.array(stop, known.type)).to_numpy(zero_copy_only=False)
        left = ~stopped[at]
        if not across:
            at, docs = at[left], docs[left]
        found = []
        if words:
            single = at[left] if across else at
            found.append((single * (v + 1) + v, docs[left] if across else docs))
        if pairs and len(at):
            here = (docs[1:] == docs[:-1]) & ~stopped[at[1:]] & ~stopped[at[:-1]]
            found.append((at[:-1][here] * (v + 1) + at[1:][here], docs[:-1][here]))
        coded = groups.dictionary_encode(null_encoding="encode")
        group = coded.indices.to_numpy().astype(np.int64)
        keys = [key + group[doc] * (v * (v + 1)) for key, doc in found]
        keys, n, n_docs = runs(np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*(doc for _, doc in found), np.zeros(0, np.int64)]))
        group, rest = np.divmod(keys, max(1, v * (v + 1)))
        first, second = np.divmod(rest, v + 1)
        return pa.record_batch([
            coded.dictionary.take(pa.array(group)), known.take(pa.array(first)),
            known.take(pa.array(second, mask=second == v)), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64()),
        ], names=["_by", "first", "second", "n", "n_docs"])

    def task(batches):
        for batch in batches:
            values = batch.column(1)
            for low, high in slices(values):
                yield rows(batch.column(0).slice(low, high - low), values.slice(low, high - low))

    return texts.mapInArrow(task, f"_by {kind}, first string, second string, n bigint, n_docs bigint")


def counted_among(df: DataFrame, text: Column, among: list[str], by: str | None = None, stop_words: list[str] = (), apostrophes: bool = False) -> DataFrame:
    """(by, first, second, n, n_docs) of the pairs, in texts without stop words, of which both words are ``among`` the given.

    All tasks number those words alike, so counts of a task's batches and of all tasks are summed by numbers.
    """
    stop, known, size = list(stop_words), sorted(set(among)), len(set(among))
    texts, kind = _texts(df, text, by)

    def summed(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by(["_by", "pair"]).aggregate([("n", "sum"), ("n_docs", "sum")])
        return found.select(["_by", "pair", "n_sum", "n_docs_sum"]).rename_columns(["_by", "pair", "n", "n_docs"])

    def table(groups: pa.Array, values: pa.Array) -> pa.Table:
        at, docs, words = numbered(values, apostrophes)
        left = ~pc.is_in(words, value_set=pa.array(stop, words.type)).to_numpy(zero_copy_only=False)[at]
        number = pc.fill_null(pc.index_in(words, value_set=pa.array(known, words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, docs = number[at[left]], docs[left]
        here = (docs[1:] == docs[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
        coded = groups.dictionary_encode(null_encoding="encode")
        group = coded.indices.to_numpy().astype(np.int64)
        docs = docs[1:][here]
        keys, n, n_docs = runs(at[:-1][here] * size + at[1:][here] + group[docs] * size * size, docs)
        group, keys = np.divmod(keys, max(1, size * size))
        return pa.table([coded.dictionary.take(pa.array(group)), pa.array(keys), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())],
                        names=["_by", "pair", "n", "n_docs"])

    def task(batches):
        held, rows = [], 0
        for batch in batches:
            values = batch.column(1)
            for low, high in slices(values):
                held.append(table(batch.column(0).slice(low, high - low), values.slice(low, high - low)))
                rows += held[-1].num_rows
                if rows > HELD_ROWS:
                    held = [summed(held)]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches()
                        rows = 0
        if held:
            yield from summed(held).to_batches()

    found = texts.mapInArrow(task, f"_by {kind}, pair bigint, n bigint, n_docs bigint")
    sums = found.groupBy("_by", "pair").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    # One literal for all words; it is read once, when the plan is made.
    word = F.from_json(F.lit(json.dumps(known, ensure_ascii=False)), "array<string>")
    first, second = F.floor(F.col("pair") / F.lit(size)), F.pmod("pair", F.lit(size))
    return sums.select("_by", F.get(word, first.cast("int")).alias("first"), F.get(word, second.cast("int")).alias("second"), "n", "n_docs")


def frequent(counts: DataFrame, k: int) -> list[str] | None:
    """Words that the k most frequent terms of any group can hold, or None where that rules nothing out.

    ``counts`` has (_by, term, n, eligible) of all words. A pair occurs no oftener than either of its words, so with k
    eligible words of some count it takes as many of both to be among the first k.
    """
    from opinara.operators.limits import ranked_per_group

    last = ranked_per_group(counts.where("eligible"), ["_by"], [F.desc("n")], k).where(F.col("rank") == k)
    least = {r["_by"]: r["n"] for r in last.select("_by", "n").collect()}
    groups = [r["_by"] for r in counts.select("_by").distinct().collect()]
    if any(g not in least for g in groups):
        return None
    bound = F.coalesce(*[F.when(F.col("_by").eqNullSafe(F.lit(g)), F.lit(least[g])) for g in groups], F.lit(0)) if groups else F.lit(0)
    limit = TIES * k * max(1, len(groups))
    rows = counts.where(F.col("n") >= bound).select("term").distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [r["term"] for r in rows]
