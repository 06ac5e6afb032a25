"""Lexicon polarity as a token-level job.

Each text is cut into tokens in place and only tokens found in the lexicon become rows, carrying the three
tokens before them and the one after. The rules are column expressions over that row, so the whole scoring
runs in the scan stage; the sums per text are combined there too, since a text's tokens sit together.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara import vocab
from opinara.functions import scores
from opinara.operators.sizing import measured
from opinara.functions.text import collapse_whitespace, count_char, once, word_count

#: Words that a lexicon may have. Published ones have some ten thousand.
MAX_LEXICON = 100_000
LEXICON_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False), T.StructField("valence", T.DoubleType(), False)
])


def load_lexicon(spark, path: str) -> DataFrame:
    """Tab-separated ``token, valence`` table; further columns of the file are ignored."""
    return spark.read.schema(LEXICON_SCHEMA).csv(path, sep="\t", quote="")


def sized_lexicon(lexicon: DataFrame) -> DataFrame:
    """The lexicon with its size known to the planner, which broadcasts it when it is small."""
    table = lexicon.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence"))
    return measured(table, "lexicon")


def lexicon_words(table: DataFrame) -> list[str]:
    """The words of a lexicon, which every task gets with its plan as a set."""
    found = [r["token"] for r in table.select("token").distinct().limit(MAX_LEXICON + 1).collect()]
    if len(found) > MAX_LEXICON:
        raise ValueError(f"a lexicon of more than {MAX_LEXICON} words does not fit a plan")
    return found


def _is_upper(word: Column) -> Column:
    """Some letter with case, and none of them lower."""
    return word.rlike(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$")


def _stripped(word: Column) -> Column:
    bare = F.trim(word, F.lit(vocab.PUNCTUATION))
    return F.when(F.length(bare) <= 2, word).otherwise(bare)


def _negated(word: Column) -> Column:
    return F.coalesce(word.isin(vocab.NEGATIONS) | F.contains(word, F.lit("n't")), F.lit(False))


def _one_of(word: Column, *values: str) -> Column:
    return F.coalesce(word.isin(list(values)), F.lit(False))


def _booster(word: Column, valence: Column, mixed_case: Column) -> Column:
    """What a preceding booster or dampener adds to the valence."""
    low = F.lower(word)
    sign = F.when(valence < 0, -1.0).otherwise(1.0)
    caps = F.when(_is_upper(word) & mixed_case, F.when(valence > 0, vocab.CAPS_BOOST).otherwise(-vocab.CAPS_BOOST)).otherwise(0.0)
    return (
        F.when(low.isin(vocab.BOOSTERS), sign * vocab.BOOST + caps)
        .when(low.isin(vocab.DAMPENERS), -sign * vocab.BOOST + caps)
        .otherwise(0.0)
    )


def emphasis(text) -> Column:
    """Extra weight of exclamation and question marks."""
    marks = F.least(count_char(text, "!"), F.lit(4)) * vocab.EXCLAMATION_STEP
    asks = count_char(text, "?")
    return marks + F.when(asks <= 1, 0.0).when(asks <= 3, asks * vocab.QUESTION_STEP).otherwise(vocab.QUESTION_MAX)


# A text of mixed case has a word all in capitals and a word that is not.
_ALL_CAPS_WORD = r"(?<![^ ])[^ \p{Ll}\p{Lt}\p{Lu}]*+\p{Lu}[^ \p{Ll}\p{Lt}]*+(?![^ ])"
_OTHER_WORD = r"(?<![^ ])(?:[^ \p{Ll}\p{Lt}]*+[\p{Ll}\p{Lt}]|[^ \p{Lu}]++(?![^ ]))"


def _hit_rows(df: DataFrame, row_id: str, text: str, words: list[str]) -> DataFrame:
    """One row per token that is in the lexicon, with the tokens around it; those keep their punctuation.

    Tokens are tested in the array of their text, and only hits leave it. The array of a text is split once; capitals
    and "but" are looked for only in texts that can have them. Boosters carry no valence themselves.
    """
    prepared = df.select(F.col(row_id).alias("_id"), collapse_whitespace(text).alias("_even"))
    mixed = F.col("_even").rlike(_ALL_CAPS_WORD) & F.col("_even").rlike(_OTHER_WORD)
    prepared = prepared.select(
        "_id", F.coalesce(mixed, F.lit(False)).alias("_mixed"),
        F.contains(F.lower("_even"), F.lit("but")).alias("_has_but"),
        F.array_remove(F.split("_even", " "), "").alias("_words"),
    )
    plain = F.transform("_words", lambda w: F.lower(_stripped(w)))
    wanted = sorted(set(words) - {*vocab.BOOSTERS, *vocab.DAMPENERS})

    def found(low: Column) -> Column:
        def hit(w, i):
            around = {"w1": i - 1, "w2": i - 2, "w3": i - 3, "after": i + 1, "after2": i + 2}
            return F.when(w.isin(wanted), F.struct(
                i.alias("_at"), _stripped(F.get("_words", i)).alias("word"), *[F.get("_words", at).alias(n) for n, at in around.items()]))

        but_at = F.when(F.col("_has_but"), F.nullif(F.array_position(low, "but"), F.lit(0)) - 1).cast("int")
        return F.struct(but_at.alias("_but"), F.filter(F.transform(low, hit), lambda h: h.isNotNull()).alias("_hits"))

    prepared = prepared.select("_id", "_mixed", once(plain, found).alias("_f"))
    rows = prepared.select("_id", "_mixed", F.col("_f._but").alias("_but"), F.explode_outer("_f._hits").alias("_h"))
    return rows.where(F.col("_h").isNotNull()).select("_id", "_mixed", "_but", "_h.*")


def emoji_words(text, descriptions: dict[str, str]) -> Column:
    """The text with each listed character replaced by its description, set off by spaces."""
    if not descriptions:
        return F.col(text)
    named = F.create_map(*[F.lit(x) for pair in descriptions.items() for x in pair])
    spelled = F.transform(F.split(F.col(text), ""), lambda c: F.coalesce(
        F.concat(F.lit(" "), F.try_element_at(named, c), F.lit(" ")), c))
    return F.when(F.col(text).rlike("[" + "".join(descriptions) + "]"), F.array_join(spelled, "")).otherwise(F.col(text))


def _expressions(v: Column, idioms: dict[str, float], phrases: list[str]) -> Column:
    """Fixed expressions around a hit set its valence; dampening phrases before it then lower it."""
    words = [F.lower(c) for c in ("w3", "w2", "w1", "word", "after", "after2")]

    def said(first: int, last: int) -> Column:
        part = words[first:last + 1]
        return F.when(reduce(and_, [w.isNotNull() for w in part]), F.concat_ws(" ", *part))

    if idioms:
        table = F.create_map(*[F.lit(x) for pair in idioms.items() for x in pair])
        # The later ones win over the earlier: what follows the hit first.
        order = (said(3, 5), said(3, 4), said(2, 3), said(1, 3), said(1, 2), said(0, 2), said(0, 1))
        v = F.coalesce(*[F.try_element_at(table, s) for s in order], v)
    for s in (said(0, 2), said(0, 1), said(1, 2)):
        v = v - F.when(s.isin(phrases), vocab.BOOST).otherwise(0.0)
    return v


def token_valences(
    df: DataFrame, row_id: str, text: str, lexicon: DataFrame, idioms: dict[str, float] | None = None,
    phrases: list[str] | None = None,
) -> DataFrame:
    """One row per lexicon token of each text with its valence after all token rules.

    ``idioms`` and ``phrases`` replace the fixed expressions and the dampening phrases of the rule set; both look at
    hits with at least three words before them, the third of which is not in the lexicon.
    """
    idioms = vocab.IDIOMS if idioms is None else idioms
    phrases = vocab.DAMPENING_PHRASES if phrases is None else phrases
    table = sized_lexicon(lexicon)
    members = lexicon_words(table)
    rows = _hit_rows(df, row_id, text, members).join(table, F.lower("word") == F.col("token"))
    # "kind" in "kind of" carries no valence.
    rows = rows.withColumns({name: _stripped(F.col(name)) for name in ("w1", "w2", "w3", "after", "after2")})
    rows = rows.where(~((F.col("token") == "kind") & _one_of(F.lower("after"), "of")))
    rows = rows.withColumns({f"in_{name}": F.coalesce(F.lower(name).isin(members), F.lit(False)) for name in ("w1", "w2", "w3", "after")})

    l1, l2, l3 = F.lower("w1"), F.lower("w2"), F.lower("w3")
    mixed = F.col("_mixed")
    base = F.when((F.col("token") == "no") & F.col("in_after"), 0.0).otherwise(F.col("valence"))
    no_before = _one_of(l1, "no") | _one_of(l2, "no") | (_one_of(l3, "no") & _one_of(l1, "or", "nor"))
    rows = rows.withColumn("v", F.when(no_before, F.col("valence") * vocab.NEGATION_SCALE).otherwise(base))
    caps = F.when(F.col("v") > 0, vocab.CAPS_BOOST).otherwise(-vocab.CAPS_BOOST)
    rows = rows.withColumn("v", F.when(_is_upper(F.col("word")) & mixed, F.col("v") + caps).otherwise(F.col("v")))

    def step(rows: DataFrame, name: str, damping: float, negation) -> DataFrame:
        """One look back: booster first, then negation on the boosted valence."""
        active = F.col(name).isNotNull() & ~F.col(f"in_{name}")
        rows = rows.withColumn("v", F.when(active, F.col("v") + damping * _booster(F.col(name), F.col("v"), mixed)).otherwise(F.col("v")))
        return rows.withColumn("v", F.when(active, negation(F.col("v"))).otherwise(F.col("v")))

    intensifies = _one_of(l1, "so", "this")
    rows = step(rows, "w1", 1.0, lambda v: F.when(_negated(l1), v * vocab.NEGATION_SCALE).otherwise(v))
    rows = step(rows, "w2", 0.95, lambda v: F.when(_one_of(l2, "never") & intensifies, v * 1.25)
                .when(_one_of(l2, "without") & _one_of(l1, "doubt"), v)
                .when(_negated(l2), v * vocab.NEGATION_SCALE).otherwise(v))
    rows = step(rows, "w3", 0.9, lambda v: F.when((_one_of(l3, "never") & _one_of(l2, "so", "this")) | intensifies, v * 1.25)
                .when(_one_of(l3, "without") & (_one_of(l2, "doubt") | _one_of(l1, "doubt")), v)
                .when(_negated(l3), v * vocab.NEGATION_SCALE).otherwise(v))
    third = F.col("w3").isNotNull() & ~F.col("in_w3")
    rows = rows.withColumn("v", F.when(third, _expressions(F.col("v"), idioms, phrases)).otherwise(F.col("v")))
    least = _one_of(l1, "least") & ~F.col("in_w1") & ~_one_of(l2, "at", "very")
    rows = rows.withColumn("v", F.when(least, F.col("v") * vocab.NEGATION_SCALE).otherwise(F.col("v")))
    around_but = F.when(F.col("_at") < F.col("_but"), 0.5).when(F.col("_at") > F.col("_but"), 1.5).otherwise(1.0)
    return rows.select(F.col("_id").alias(row_id), F.col("_at").alias("position"), "token", (F.col("v") * around_but).alias("valence"))


def polarity(
    df: DataFrame, row_id: str, text: str, lexicon: DataFrame, idioms: dict[str, float] | None = None,
    phrases: list[str] | None = None, emoji: dict[str, str] | None = None,
) -> DataFrame:
    """Compound, positive, negative and neutral score per text; all zero for an empty text.

    ``emoji`` maps characters to the words that stand for them.
    """
    df = df.withColumn(text, emoji_words(text, emoji or {}))
    hits = token_valences(df, row_id, text, lexicon, idioms, phrases).groupBy(row_id).agg(
        F.sum("valence").alias("_sum"),
        F.sum(F.when(F.col("valence") > 0, F.col("valence") + 1)).alias("_pos"),
        F.sum(F.when(F.col("valence") < 0, F.col("valence") - 1)).alias("_neg"),
        F.count_if(F.col("valence") != 0).alias("_charged"),
    )
    docs = df.select(row_id, word_count(text).alias("_words"), emphasis(text).alias("_emphasis"))
    joined = docs.join(hits, row_id, "left").fillna(0, ["_sum", "_pos", "_neg", "_charged"])
    extra = F.col("_emphasis")
    total = F.col("_sum") + F.when(F.col("_sum") > 0, extra).when(F.col("_sum") < 0, -extra).otherwise(0.0)
    pos = F.col("_pos") + F.when(F.col("_pos") > F.abs("_neg"), extra).otherwise(0.0)
    neg = F.abs(F.col("_neg")) + F.when(F.col("_pos") < F.abs("_neg"), extra).otherwise(0.0)
    neutral = F.col("_words") - F.col("_charged")
    mass = pos + neg + neutral
    compound = total / F.sqrt(total * total + vocab.NORMALISE_ALPHA)

    def part(c: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(c, mass), 3), F.lit(0.0))

    return joined.select(
        row_id,
        F.coalesce(F.round(F.greatest(F.least(compound, F.lit(1.0)), F.lit(-1.0)), 4), F.lit(0.0)).alias("compound"),
        part(pos).alias("positive"), part(neg).alias("negative"), part(neutral).alias("neutral"),
    )


def with_scores(df: DataFrame, row_id: str, text: str, lexicon: DataFrame, **rules) -> DataFrame:
    """The table with its four polarity columns, subjectivity and label; polarity is computed once."""
    scored = polarity(df, row_id, text, lexicon, **rules).select(
        row_id, F.col("compound").alias("sentiment_polarity"), F.col("positive").alias("sentiment_positive"),
        F.col("negative").alias("sentiment_negative"), F.col("neutral").alias("sentiment_neutral"),
    )
    return df.join(scored, row_id).withColumns({
        "sentiment_subjectivity": scores.subjectivity(text, "sentiment_polarity"),
        "sentiment_label": scores.sentiment_label("sentiment_polarity"),
    })
