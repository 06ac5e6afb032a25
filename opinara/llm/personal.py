"""Personal data in texts: generators propose overlapping spans, boosted trees score them, thresholds choose.

The base kinds report every match that passes its check. Around them, wider generators propose anything of a similar
shape: addresses written with ``(at)``, digits in groups, account codes, colon addresses, and base matches that fail
their check. Each candidate gets features of its format and its context, cut to a few values each; ``company`` is how many
candidates its generator has in the text. The check itself is no feature: candidates that touch a verified span are the positive cases, all others the negative ones, and boosted
trees learn how verified data look and what stands around them.

Training reads every candidate. Those with equal features are first counted together, and each level of a tree is one
aggregate of gradients by feature value; the driver sees only these histograms, whose size is set by the features. A
third of the texts, by hash, is held out: each generator's threshold is the lowest score from which on at least
``PRECISION`` of the held-out candidates are verified. Where a generator has fewer than ``LEAST`` of them, all generators
together set it. A candidate apart from all verified spans is reported when its score reaches the threshold, so
it looks like what is verified almost always; of candidates that overlap, the one of highest score is reported.

Defined cases: a null text is empty; rows equal in id and text are one document and get the same spans; a null id is an
id like any other; runs of candidates that overlap one another count as touching, and a run with verified spans
reports just these; of equal scores in a run the longest, then the first span is reported; without verified or without
other candidates nothing is learned and only the base is reported; an empty table gives an empty result; other columns
pass through, save those named like a column added here, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.llm.common import equal_rows, measured, once, running, text_key

ADDED = ("spans", "n_spans")
CONTEXT = 40
ROUNDS, DEPTH, RATE, SMOOTH = 10, 3, 0.4, 1.0
#: Share of verified candidates from a threshold on, and candidates needed to tell.
PRECISION, LEAST = 0.97, 30


@dataclass(frozen=True)
class Generator:
    """``check`` verifies a match; wider generators have none and never report by themselves."""

    name: str
    pattern: str
    check: object = None


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""

    def step(total, i):
        digit = (F.ascii(F.substring(number, i, F.lit(1))) - 48) * (1 + F.pmod(F.char_length(number) - i, F.lit(2)))
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), step) % 10 == 0


def within(value: Column, low: int, high: int, also=None) -> Column:
    """The number of digits lies between two bounds, and they fit ``also``."""
    return once(digits(value), lambda d: F.when(F.char_length(d).between(low, high), also(d) if also else F.lit(True)).otherwise(False))


BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
# Matches are pinned to the start of a run, or to the end of the match before, and runs are never given back, so that
# long runs cost one pass; what matches is the same as without.
# --- fixed values: the base kinds ------------------------------------------------------------------------
GENERATORS = (
    Generator("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True)),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
    Generator("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", lambda v: within(v, 16, 19, luhn)),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: within(v, 8, 15)),
    # -----------------------------------------------------------------------------------------------------
    Generator("handle", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[a-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[a-z0-9-]++)++"),
    Generator("number", r"(?<![0-9])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+"),
    Generator("code", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    Generator("colons", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
)
# Words near a candidate, the first that is found counts.
CUES = (
    r"phone|tel|telephone|call|mobile|cell|fax|sms|whatsapp", r"mail|e-mail|email|contact|write|reply|inbox",
    r"card|visa|mastercard|amex|credit|debit|payment", r"ssn|passport|iban|account|tax|licence|license|insurance|born|birth",
    r"ip|host|server|address|login|from", r"order|invoice|ref|reference|version|isbn|page|serial|sku|build|ticket|item|total|price",
)


def steps(value: Column, *uppers: int) -> Column:
    """The number of bounds that a value exceeds."""
    return reduce(add, [(value > u).cast("int") for u in uppers])


def kind_of(char: Column) -> Column:
    """0 blank or none, 1 letter, 2 digit, 3 sign of money or number, 4 anything else.

    A plus counts as none: it is part of a check, so it would tell verified candidates from others.
    """
    return (F.when(char.isNull() | (char == "") | char.rlike(r"^[\s+]"), 0).when(char.rlike(r"^\p{L}"), 1).when(char.rlike("^[0-9]"), 2)
            .when(char.rlike("^[$#€£¥]"), 3).otherwise(4))


def cue(before: Column) -> Column:
    low = F.lower(before)
    found = F.when(low.rlike(rf"\b(?:{CUES[0]})\b"), 1)
    for i, words in enumerate(CUES[1:], 2):
        found = found.when(low.rlike(rf"\b(?:{words})\b"), i)
    return found.otherwise(0)


def features() -> dict[str, Column]:
    """Small whole numbers from the columns of a candidate."""
    value, n_digits = F.col("value"), F.char_length(digits(F.col("value")))
    longest = F.array_max(F.transform(F.split(value, "[^0-9]+"), F.char_length))
    return {
        "generator": F.col("place"),
        "digits": steps(n_digits, 0, 6, 7, 8, 9, 10, 11, 13, 15, 16, 19),
        "breaks": steps(F.char_length(value) - F.char_length(F.regexp_replace(value, r"[\x20().:@/-]", "")), 0, 1, 2, 3, 5),
        "longest": steps(longest, 0, 2, 3, 4, 6, 9, 15),
        "letters": steps(F.char_length(F.regexp_replace(value, r"\P{L}", "")), 0, 2, 5, 15),
        "first": kind_of(F.substring(value, 1, 1)),
        "left": kind_of(F.right("before", F.lit(1))),
        "right": kind_of(F.col("after")),
        "cue": cue(F.col("before")),
        "company": steps(F.col("company"), 1, 2, 4, 8),
    }


FEATURES = ("generator", "digits", "breaks", "longest", "letters", "first", "left", "right", "cue", "company")


def proposed(text: Column, generator: Generator, place: int) -> Column:
    """Spans of one generator: (start, end, place, value, before, after, company), in code points, the end exclusive."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(0)).alias("h"), F.split(text, generator.pattern, -1).alias("g"))

    def placed(p: Column) -> Column:
        lengths = F.transform(p["h"], lambda h, i: (F.char_length(h) + F.char_length(F.get(p["g"], i))).cast("long"))
        return once(running(lengths), lambda ends: F.transform(p["h"], lambda h, i: F.struct(
            (F.get(ends, i) + F.char_length(F.get(p["g"], i))).alias("start"),
            (F.get(ends, i) + F.char_length(F.get(p["g"], i)) + F.char_length(h)).alias("end"),
            F.lit(place).alias("place"), h.alias("value"),
            F.right(F.get(p["g"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(p["g"], i + 1), F.lit(1)).alias("after"),
            F.size(p["h"]).alias("company"),
        )))

    none = F.array().cast("array<struct<start:bigint,end:bigint,place:int,value:string,before:string,after:string,company:int>>")
    return F.when(text.rlike(generator.pattern), once(parts, placed)).otherwise(none)


def candidates(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per candidate of each document: (_id, _key, start, end, place, sure) and the features."""
    content = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[proposed(content, g, i) for i, g in enumerate(GENERATORS)])
    rows = df.select(F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), found.alias("_found"))
    rows = rows.where(F.size("_found") > 0).select("_id", "_key", F.explode("_found").alias("_s")).select("_id", "_key", "_s.*")
    sure = F.lit(False)
    for i, g in enumerate(GENERATORS):
        if g.check:
            sure = F.when(F.col("place") == i, g.check(F.col("value"))).otherwise(sure)
    return rows.select("_id", "_key", "start", "end", "place", sure.alias("sure"), *[c.cast("int").alias(n) for n, c in features().items()])


def in_runs(found: DataFrame) -> DataFrame:
    """Candidates of each document once, with the ``run`` of overlapping ones they lie in and whether it is verified."""
    once_each = found.dropDuplicates(["_id", "_key", "start", "place"])
    by_start = W.partitionBy("_id", "_key").orderBy("start", "end", "place")
    before = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    begins = once_each.withColumn("_begins", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    placed = begins.withColumn("run", F.sum("_begins").over(by_start.rowsBetween(W.unboundedPreceding, 0))).drop("_begins")
    return placed.withColumn("verified", F.max("sure").over(W.partitionBy("_id", "_key", "run")))


# A tree is a leaf (its value) or (feature, bound, tree where the feature is at most the bound, tree where it is more).
Tree = tuple | float


def value_of(tree: Tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, bound, low, high = tree
    return F.when(F.col(feature) <= bound, value_of(low)).otherwise(value_of(high))


@dataclass(frozen=True)
class Model:
    """Margin to start with, trees to add, and the score from which on each generator reports (None: never)."""

    base: float
    trees: tuple[Tree, ...]
    thresholds: tuple[float | None, ...] = ()

    def margin(self) -> Column:
        return reduce(add, [value_of(t) for t in self.trees], F.lit(self.base))

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def counted(runs: DataFrame) -> DataFrame:
    """Candidates of equal features counted together: ``n`` of them, ``pos`` verified, a third of the texts held out."""
    held = (F.pmod("_key", F.lit(3)) == 1).alias("held")
    rows = runs.groupBy(*FEATURES, held).agg(F.count("*").alias("n"), F.sum(F.col("verified").cast("int")).alias("pos"))
    return measured(rows, "features")


def best_split(cells: list[tuple[str, int, float, float]]) -> tuple[str, int] | None:
    """Feature and bound that lower the loss most, from (feature, value, gradient, weight); None if nothing does."""
    best, chosen = 1e-6, None
    by: dict[str, list] = {}
    for f, value, g, h in sorted(cells):
        by.setdefault(f, []).append((value, g, h))
    for f in FEATURES:
        row = by.get(f, [])
        all_g, all_h = sum(c[1] for c in row), sum(c[2] for c in row)
        left_g = left_h = 0.0
        for value, g, h in row[:-1]:
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
            if gain > best * (1 + 1e-9):  # sums differ in their last digits from run to run
                best, chosen = gain, (f, value)
    return chosen


def boosted(rows: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> Model | None:
    """Trees on counted candidates; None if all are verified or none is."""
    n, pos = rows.agg(F.sum("n"), F.sum("pos")).first()
    if not n or not pos or n == pos:
        return None
    model = Model(log(pos / (n - pos)), ())
    for _ in range(rounds):
        tree = grown(rows, model, depth)
        if not isinstance(tree, tuple):
            break
        model = Model(model.base, (*model.trees, tree))
    return model


def grown(rows: DataFrame, model: Model, depth: int) -> Tree:
    """One tree, level by level: each level is one aggregate over the features of all its nodes."""
    chance = model.score()
    graded = rows.select(*FEATURES, (F.col("pos") - F.col("n") * chance).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h"))
    splits: dict[int, tuple[str, int]] = {}
    sums: dict[int, tuple[float, float]] = {}

    def node_of(node: int) -> Column:
        """The node of the last level that a row falls into, -1 where a branch has ended."""
        if node not in splits:
            return F.lit(node if node >= 2**level - 1 else -1)
        f, bound = splits[node]
        return F.when(F.col(f) <= bound, node_of(2 * node + 1)).otherwise(node_of(2 * node + 2))

    for level in range(depth):
        cells = graded.select(node_of(0).alias("node"), "g", "h", F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("c")).where("node >= 0")
        found = cells.groupBy("node", "c.f", "c.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r["node"], []).append((r["f"], r["v"], r["g"], r["h"]))
        for node, node_cells in by.items():
            split = best_split(node_cells)
            if split:
                splits[node] = split
                for child, side in ((2 * node + 1, lambda v: v <= split[1]), (2 * node + 2, lambda v: v > split[1])):
                    own = [(g, h) for f, v, g, h in node_cells if f == split[0] and side(v)]
                    sums[child] = (sum(x[0] for x in own), sum(x[1] for x in own))
        if not any(n >= 2**level - 1 for n in splits):
            break

    def build(node: int) -> Tree:
        if node in splits:
            return (*splits[node], build(2 * node + 1), build(2 * node + 2))
        g, h = sums.get(node, (0.0, 0.0))
        return RATE * g / (h + SMOOTH)

    return build(0)


def calibrated(rows: DataFrame, model: Model, precision: float = PRECISION, least: int = LEAST) -> Model:
    """The model with a threshold for each generator, from counted candidates it has not learned from."""
    scored = rows.select("generator", F.floor(model.score() * 1000).alias("s"), "n", "pos")
    cells = scored.groupBy("generator", "s").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()

    def lowest(some) -> float | None:
        n = pos = 0
        found = None
        by: dict[int, list] = {}
        for r in some:
            by.setdefault(r["s"], []).append(r)
        for s in sorted(by, reverse=True):
            n, pos = n + sum(r["n"] for r in by[s]), pos + sum(r["pos"] for r in by[s])
            if n >= least and pos >= precision * n:
                found = s / 1000
        return found

    pooled = lowest(cells)
    thresholds = []
    for i in range(len(GENERATORS)):
        own = [r for r in cells if r["generator"] == i]
        thresholds.append(lowest(own) if sum(r["n"] for r in own) >= least else pooled)
    return Model(model.base, model.trees, tuple(thresholds))


def fit(runs: DataFrame) -> Model | None:
    """Learn from two thirds of the candidates of ``in_runs``, set thresholds on the other third."""
    rows = counted(runs)
    model = boosted(rows.where(~F.col("held")))
    return model and calibrated(rows.where("held"), model)


def chosen(runs: DataFrame, model: Model | None) -> DataFrame:
    """(_id, _key, start, end, place, base, score) of what is reported."""
    columns = ["_id", "_key", "start", "end", "place"]
    base = runs.where("sure").select(*columns, F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    if model is None or all(t is None for t in model.thresholds):
        return base
    reaches = reduce(or_, [(F.col("place") == i) & (F.col("score") >= t) for i, t in enumerate(model.thresholds) if t is not None])
    more = runs.where(~F.col("verified")).withColumn("score", model.score()).where(reaches)
    first = W.partitionBy("_id", "_key", "run").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "place")
    more = more.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return base.unionByName(more.select(*columns, F.lit(False).alias("base"), "score"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of ``df`` with ``spans``: array of (place, start, end, kind, base, score), by kind and start.

    The texts are searched once; candidates, narrow and without their text, are written. Without a ``model`` one is
    learned from them.
    """
    runs = measured(in_runs(candidates(df, doc_id, text)), "candidates")
    model = model or fit(runs)
    names = F.array(*[F.lit(g.name) for g in GENERATORS])
    spans = chosen(runs, model).groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct(
        "place", "start", "end", F.get(names, F.col("place")).alias("kind"), "base", "score"))).alias("spans"))
    plain = df.drop(*[c for c in ADDED if c in df.columns]).withColumns({"_id": F.col(doc_id), "_key": text_key(F.col(text))})
    joined = equal_rows(plain, spans, ["_id", "_key"], "left").drop("_id", "_key")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast(joined.schema["spans"].dataType)))
    return joined.withColumn("n_spans", F.size("spans").cast("long"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
