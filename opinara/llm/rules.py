"""Quality rules as a ledger: measurements and one failure bit per rule, judged by versioned policies.

Every rule is evaluated once per document. What a policy rejects, and what each of its rules rejects alone, follows
from the stored bits without touching a text again.

Defined cases: a null or empty text has no words and fails the length rule; rows are judged one by one, so repeated
rows, null ids and ties need no care; other columns pass through unless ``ledger`` makes a column of that name, which
then replaces them; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import once, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the struct of measurements."""

    name: str
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    """A document is rejected when it fails a rule named in ``reject``."""

    version: str
    reject: tuple[str, ...]


# A rule's place is its bit. New rules are appended, never inserted, so that stored bits keep their meaning.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("many_symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base": Policy("base", BASE),
    "1": Policy("1", (*BASE, "many_symbols", "long_words", "repeated_lines")),
}
CURRENT = "1"


def repeat_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found twice or more, the first one included."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (size - 1)),
        lambda p: F.concat_ws(" ", F.slice(tokens, p, F.lit(size))),
    )

    def repeated_starts(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

        def again(rows: Column) -> Column:
            def same(row, i):
                return F.coalesce(row["w"] == F.get(rows, i - 1)["w"], F.lit(False)) | F.coalesce(
                    row["w"] == F.get(rows, i + 1)["w"], F.lit(False)
                )

            return F.sort_array(F.transform(F.filter(rows, same), lambda row: row["p"]))

        return once(placed, again)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    counted = once(windows, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(
        once(repeated_starts(found), covered)
    ))
    return F.when(F.size(tokens) > size, counted).otherwise(0).cast("long")


def measurements(text: Column) -> Column:
    """Struct of what the rules look at, from a whole text; each part of the text is taken apart once."""
    content = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.struct(words(text).alias("w"), lines.alias("l"))

    def measured(p: Column) -> Column:
        return F.struct(
            F.size(p["w"]).cast("long").alias("n_words"),
            F.char_length(F.array_join(p["w"], "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(content, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            F.size(p["l"]).cast("long").alias("n_lines"),
            (F.size(p["l"]) - F.size(F.array_distinct(p["l"]))).cast("long").alias("n_dup_lines"),
            once(p["w"], lambda w: repeat_words(w)).alias("n_repeat_words"),
        )

    return once(parts, measured)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` with measurements and ``failure_bits`` (bit i: rule i fails), in place and without a shuffle.

    All of it is one expression, so a filter on the bits that the planner moves below evaluates it a single time.
    """

    def entry(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for i, rule in enumerate(rules):
            bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[c].alias(c) for c in MEASURES], bits.alias("failure_bits"))

    kept = [c for c in df.columns if c not in (*MEASURES, "failure_bits")]
    whole = df.withColumn("_entry", once(measurements(F.col(text)), entry))
    return whole.select(*kept, "_entry.*")


def failing(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(names, rules)).cast("long")) != 0


def judged(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Apply a policy to a ledger: columns ``kept`` and ``policy``."""
    return entries.withColumns({"kept": ~failing(policy.reject, rules), "policy": F.lit(policy.version)})


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail nothing else, and that pass once it is left out.

    The ledger is reduced to one row per distinct bit pattern; everything else is bit arithmetic on those rows.
    """
    whole = F.lit(mask(policy.reject, rules)).cast("long")
    patterns = entries.groupBy(F.col("failure_bits").bitwiseAND(whole).alias("_bits")).agg(F.count("*").alias("_n"))
    listed = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(mask((n,), rules)).cast("long").alias("bit")) for n in policy.reject
    ])
    rows = patterns.select("_bits", "_n", F.explode(listed).alias("_r")).select("_bits", "_n", "_r.*")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    fails = F.col("_bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        total(fails).alias("n_failing"), total(F.col("_bits") == F.col("bit")).alias("n_only"),
        total((F.col("_bits") == 0) | (F.col("_bits") == F.col("bit"))).alias("n_kept_without"),
        total(F.col("_bits") == 0).alias("n_kept"),
    )
