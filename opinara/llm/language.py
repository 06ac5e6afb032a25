"""Language of a text by rank-order profiles.

The most frequent letter n-grams of each language, by rank, are its profile. A document's own ranking is compared
with each: every n-gram adds the difference of its two ranks, or the length of the profile when the language lacks
it. The language with the least sum wins.

N-grams of one to three characters are counted inside words; a word is a run of letters, lower-cased, with a mark
before and after it.

Defined cases: a text without letters, or a null one, is ``und`` with score 0, as is every text when nothing could be
learned; training rows without a language or letters teach nothing; equal counts rank by character code, equal sums
go to the language first by name; repeated rows are judged alike; other columns pass through, save ``lang_pred`` and
``score``, which are replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.common import widened

PROFILE = 400
#: N-grams that a task holds per language before it adds up equal ones.
HELD = 2_000_000
GAP = 32
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point: its lower-case letter, or the gap for everything that is no letter."""
    table = np.full(0x110000, GAP, dtype="uint32")
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str) -> np.ndarray:
    """Keys of all n-grams: three times 21 bits, the last character lowest."""
    codes = letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype("int64")
    gap = codes == GAP
    keep = ~(gap & np.concatenate(([False], gap[:-1])))
    codes, gap = codes[keep], gap[keep]
    if len(codes) < 3:
        return codes[:0]
    pairs = (codes[:-1] << 21) | codes[1:]
    threes = (pairs[:-1] << 21) | codes[2:]
    return np.concatenate((codes[~gap], pairs, threes[~gap[1:-1]]))


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the counts of equal keys."""
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(place, weights=np.concatenate(counts)).astype("int64")


def learn(rows: DataFrame, text: str, lang: str, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of each language over all rows, rank from 0."""

    def task(batches):
        held: dict[str, tuple[list, list]] = {}
        sizes: dict[str, int] = {}

        def add_up(name):
            keys, counts = counted(*held[name])
            held[name], sizes[name] = ([keys], [counts]), len(keys)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = np.unique(ngrams(content.as_py()), return_counts=True)
                mine = held.setdefault(name, ([], []))
                mine[0].append(keys)
                mine[1].append(counts)
                sizes[name] = sizes.get(name, 0) + len(keys)
                if sizes[name] > HELD:
                    add_up(name)
        for name in held:
            add_up(name)
            keys, counts = held[name][0][0], held[name][1][0]
            yield pa.record_batch([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())],
                                  names=["lang", "gram", "n"])

    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    totals = known.mapInArrow(task, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Every task keeps its own first ranks of a language, so few rows of it meet in one task.
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("rank", rank - 1).where(F.col("rank") < size).drop("n")


class Profiles:
    """Ranks of all languages side by side: (languages, sorted n-grams, rank per language and n-gram)."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.names = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), dtype="int64")
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype="int64")
        for name, gram, rank in rows:
            self.ranks[self.names.index(name), np.searchsorted(self.grams, gram)] = rank

    def judge(self, text: str | None) -> tuple[str, float]:
        keys = ngrams(text) if text else self.grams[:0]
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        grams, counts = np.unique(keys, return_counts=True)
        grams = grams[np.argsort(-counts, kind="stable")[:self.size]]
        place = np.searchsorted(self.grams, grams)
        place[self.grams[np.minimum(place, len(self.grams) - 1)] != grams] = len(self.grams)
        theirs = self.ranks[:, place]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(grams)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.names[best], 1 - float(apart[best]) / (self.size * len(grams))


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``lang_pred`` and ``score``; only the text is looked at."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    read = kept if text in kept else [*kept, text]
    schema = widened(df, kept, "lang_pred string, score double")
    at = read.index(text)

    def task(batches):
        for batch in batches:
            judged = [profiles.judge(t.as_py()) for t in batch.column(at)]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())],
                names=[*kept, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(task, schema)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of the languages in ``rows``: at most ``size`` rows per language come to the driver."""
    return Profiles([tuple(r) for r in learn(rows, text, lang, size).select("lang", "gram", "rank").collect()], size)
