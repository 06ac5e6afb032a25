"""Secrets in texts, weighed by how many owners hold the same value.

Patterns give candidate spans. The hash of each candidate value is counted by distinct repositories and owners over
the whole corpus, and both counts decide: a value is a copied example when it stands in more than ``MAX_REPOS``
repositories of more than ``MAX_OWNERS`` owners, or in more than ``MANY_REPOS`` repositories whoever owns them; any other
value belongs to few and looks live. Repositories whose text is the same count once, so a copied document makes no
example of the key inside it. The listed base kinds are reported either way, with their verdict; the looser kind is
reported only when it looks live.

Defined cases: a null text is empty; rows equal in id and text are one document and get the same spans; a null owner
or repository counts as one further owner or repository; overlapping kinds are all reported; an empty table gives an
empty result; other columns pass through, save those named like a column added here, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import equal_rows, measured, once, running, text_key

ADDED = ("spans", "n_spans", "n_live")


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters and fits all of ``also``."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    also: tuple[str, ...] = ()


# --- fixed values: the base kinds ------------------------------------------------------------------------
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# ---------------------------------------------------------------------------------------------------------
KINDS = (
    Kind("assign", ASSIGN, 2, 12),
    Kind("access", ACCESS, 0, 18),
    # Runs are maximal, so short ones can be passed over by the pattern itself.
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
    Kind("random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 0, 20, base=False, also=("[A-Z]", "[a-z]", "[0-9]")),
)
#: A value of more owners and more repositories than this is a copied example,
MAX_OWNERS, MAX_REPOS = 2, 3
#: and so is one of more repositories than this, whatever their owners.
MANY_REPOS = 20


def matches(text: Column, kind: Kind, place: int) -> Column:
    """Spans of one kind as (start, end, place, value), in code points, the end exclusive."""
    pattern = F.lit(kind.pattern)
    hits, values = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (0, kind.group))
    # What lies between the matches gives their places.
    between = F.transform(F.split(text, kind.pattern, -1), F.char_length)

    def placed(parts: Column) -> Column:
        steps = F.transform(parts["h"], lambda h, i: (F.char_length(h) + F.get(parts["g"], i)).cast("long"))
        return once(running(steps), lambda before: F.transform(parts["h"], lambda h, i: F.struct(
            (F.get(before, i) + F.get(parts["g"], i)).alias("start"),
            (F.get(before, i) + F.get(parts["g"], i) + F.char_length(h)).alias("end"),
            F.lit(place).alias("place"), F.get(parts["v"], i).alias("value"),
        )))

    def fits(span: Column) -> Column:
        good = F.char_length(span["value"]) >= kind.least
        for p in kind.also:
            good = good & span["value"].rlike(p)
        return good

    spans = once(F.struct(hits.alias("h"), values.alias("v"), between.alias("g")), placed)
    none = F.array().cast("array<struct<start:bigint,end:bigint,place:int,value:string>>")
    return F.when(text.rlike(kind.pattern), F.filter(spans, fits)).otherwise(none)


def candidates(df: DataFrame, doc_id: str, text: str, owner: str, repo: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per candidate span: (_id, _key, _owner, _repo, start, end, place, value_hash). One pass over the texts."""
    content = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[matches(content, k, i) for i, k in enumerate(kinds)])
    rows = df.select(
        F.col(doc_id).alias("_id"), text_key(F.col(text)).alias("_key"), F.col(owner).cast("string").alias("_owner"),
        F.col(repo).cast("string").alias("_repo"), F.explode_outer(found).alias("_s"),
    ).where(F.col("_s").isNotNull())
    return rows.select("_id", "_key", "_owner", "_repo", "_s.start", "_s.end", "_s.place",
                       F.unhex(F.sha2("_s.value", 256)).alias("value_hash"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories per value, counted in steps that combine before each shuffle."""
    owners = found.groupBy("value_hash", "_owner").agg(F.lit(1).alias("_one")).groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    texts = found.groupBy("value_hash", "_key").agg(F.min("_repo").alias("_repo"))
    repos = texts.groupBy("value_hash", "_repo").agg(F.lit(1).alias("_one")).groupBy("value_hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value_hash")


def scan(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
    kinds: tuple[Kind, ...] = KINDS, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, many_repos: int = MANY_REPOS,
) -> DataFrame:
    """The rows of ``df`` with ``spans``: array of (start, end, place, kind, n_owners, n_repos, live), by start and kind.

    A value that a third of all rows hold is counted by partial sums; its spans are joined to the counts as narrow rows,
    which adaptive execution can split. Rows that no pattern touches, most of a corpus, get no spans where they stand;
    only the others are joined, so their texts alone may move.
    """
    found = measured(candidates(df, doc_id, text, owner, repo, kinds), "candidates")
    names = F.array(*[F.lit(k.name) for k in kinds])
    base = F.array(*[F.lit(k.base) for k in kinds])
    copied = ((F.col("n_owners") > max_owners) & (F.col("n_repos") > max_repos)) | (F.col("n_repos") > many_repos)
    rated = found.join(ownership(found), "value_hash").withColumn("live", ~copied)
    kept = rated.where(F.get(base, F.col("place")) | F.col("live"))
    spans = kept.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct(
        "start", "place", "end", F.get(names, F.col("place")).alias("kind"), F.get(base, F.col("place")).alias("base"),
        "n_owners", "n_repos", "live",
    ))).alias("spans"))
    spans = measured(spans, "spans")
    plain = df.drop(*[c for c in ADDED if c in df.columns])
    touched = F.coalesce(reduce(or_, [F.col(text).rlike(k.pattern) for k in kinds]), F.lit(False))
    keyed = plain.where(touched).withColumns({"_id": F.col(doc_id), "_key": text_key(F.col(text))})
    joined = equal_rows(keyed, spans, ["_id", "_key"], "left").drop("_id", "_key")
    joined = joined.unionByName(plain.where(~touched), allowMissingColumns=True)
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast(joined.schema["spans"].dataType)))
    return joined.withColumns({
        "n_spans": F.size("spans").cast("long"),
        "n_live": F.size(F.filter("spans", lambda s: s["live"])).cast("long"),
    })


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def join_up(done, span):
        last = F.element_at(done, -1)
        merged = F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))
        return F.when(F.size(done) == 0, F.array(span)).when(
            span["s"] < last["e"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))
        ).otherwise(F.concat(done, F.array(span)))

    def cut(runs):
        def piece(run, i):
            before = F.coalesce(F.get(runs, i - 1)["e"], F.lit(0).cast("long"))
            return F.concat(F.substring(text, (before + 1).cast("int"), (run["s"] - before).cast("int")), F.lit(mark))

        rest = F.substring(text, (F.element_at(runs, -1)["e"] + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(F.transform(runs, piece), ""), rest)

    return F.when(F.size(spans) > 0, once(F.aggregate(ordered, empty, join_up), cut)).otherwise(text)
