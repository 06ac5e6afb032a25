"""Word frequencies per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.counts import counted, counted_among, frequent
from opinara.operators.limits import ranked_per_group
from opinara.operators.sizing import measured

#: Score that a pair of words must exceed to count as one term.
PAIR_SCORE = 30


def with_pairs(words: Column) -> Column:
    """Words followed by pairs of neighbours."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def word_frequencies(df: DataFrame, by: str, text: str, stop_words: list[str], k: int = 100, pairs: bool = False) -> DataFrame:
    """The k most frequent words of each class, ties by word.

    Words have two characters or more, apostrophes inside kept, without numbers, possessives and stop words. Pairs are
    neighbours among those; only such are counted whose words both occur as often as the k-th word.
    """
    known, lower = df.where(F.col(by).isNotNull()), F.lower(text)

    def total(found: DataFrame) -> DataFrame:
        return found.groupBy("_by", F.concat_ws(" ", "first", "second").alias("term")).agg(F.sum("n").alias("n"))

    counts = total(counted(known, lower, by, stop_words, True))
    if pairs:
        counts = measured(counts, "words")
        among = frequent(counts.withColumn("eligible", F.lit(True)), k)
        if among is None:
            found = total(counted(known, lower, by, stop_words, True, words=False, pairs=True))
        else:
            found = counted_among(known, lower, among, by, stop_words, True).select("_by", F.concat_ws(" ", "first", "second").alias("term"), "n")
        counts = counts.unionByName(found)
    return ranked_per_group(counts.select(F.col("_by").alias(by), F.col("term").alias("word"), "n"), [by], [F.desc("n"), F.asc("word")], k)


def pair_score(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Likelihood ratio of two words following one another, against independence, from their counts."""

    def likelihood(k, n, x):
        return F.log(F.greatest(x, F.lit(1e-10))) * k + F.log(F.greatest(1 - x, F.lit(1e-10))) * (n - k)

    chance, after, elsewhere = second / total, both / first, (second - both) / (total - first)
    ratio = (likelihood(both, first, chance) + likelihood(second - both, total - first, chance)
             - likelihood(both, first, after) - likelihood(second - both, total - first, elsewhere))
    return F.when((total <= first) | (total <= second), 0.0).otherwise(-2 * ratio)


def cloud_frequencies(df: DataFrame, by: str, text: str, stop_words: list[str], k: int = 100, threshold: float = PAIR_SCORE) -> DataFrame:
    """The k most frequent terms of each class, as a word cloud counts them.

    Plurals, terms that end in a single s, count as their singular where it occurs. Neighbours, neither of them a stop
    word, whose score exceeds the threshold are a term of their own and are taken off the counts of their words. Texts
    are read once, for the counts of words and pairs; a term and its plural share a row from the first sum on.
    """
    found = counted(df.where(F.col(by).isNotNull()), F.lower(text), by, stop_words, apostrophes=True, pairs=True, across=True)
    last = F.coalesce("second", "first")
    plural = last.endswith("s") & ~last.endswith("ss")
    stem = F.when(plural, F.substring(last, F.lit(1), F.char_length(last) - 1)).otherwise(last)
    pair = F.col("second").isNotNull()
    sums = found.select("_by", F.when(pair, F.col("first")).alias("before"), stem.alias("stem"), plural.alias("plural"), "n")
    sums = sums.groupBy("_by", "before", "stem").agg(
        F.sum("n").alias("n"), F.max(~F.col("plural")).alias("single"), F.max("plural").alias("plural"))
    form = F.when(F.col("single"), F.col("stem")).otherwise(F.concat("stem", F.lit("s")))
    counts = measured(sums.select("_by", "before", form.alias("form"), "n", (F.col("single") & F.col("plural")).alias("both")), "terms")

    words = counts.where("before IS NULL").select("_by", "form", "n", "both")
    totals = words.groupBy("_by").agg(F.sum("n").alias("_total"))
    written = F.when(F.col("both"), F.array("form", F.concat("form", F.lit("s")))).otherwise(F.array("form"))
    singles = measured(words.select("_by", F.explode(written).alias("term"), "form", "n"), "words")

    pairs = counts.where("before IS NOT NULL").select("_by", F.col("before").alias("_first"), F.col("form").alias("_second"), "n")
    for side in ("_first", "_second"):
        pairs = pairs.join(singles.select("_by", F.col("term").alias(side), F.col("form").alias(f"{side}_form"), F.col("n").alias(f"{side}_n")), ["_by", side])
    score = pair_score(F.col("n"), F.col("_first_n"), F.col("_second_n"), F.col("_total"))
    strong = pairs.join(totals, "_by").where(score > threshold)
    strong = measured(strong.select("_by", F.concat_ws(" ", "_first", "_second").alias("pair"), "n", "_first_form", "_second_form"), "pairs")

    taken = strong.select("_by", F.explode(F.array("_first_form", "_second_form")).alias("form"), (-F.col("n")).alias("n"))
    left = words.select("_by", "form", "n").unionByName(taken).unionByName(strong.select("_by", F.col("pair").alias("form"), "n"))
    final = left.groupBy("_by", "form").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    return ranked_per_group(final.select(F.col("_by").alias(by), F.col("form").alias("word"), "n"), [by], [F.desc("n"), F.asc("word")], k)
