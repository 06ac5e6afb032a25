"""Queries for lexicon polarity and the findings built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara import vocab
from opinara.operators import aggregates, polarity, trends
from opinara.queries import tables as t
from opinara.queries.registry import query, rounded

_P = t.q(vocab.PUNCTUATION)
_BOOST = t.in_list(vocab.BOOSTERS)
_DAMP = t.in_list(vocab.DAMPENERS)


def _negated(w: str) -> str:
    return f"coalesce({w} IN ({t.in_list(vocab.NEGATIONS)}) OR contains({w}, 'n''t'), false)"


def _upper(w: str) -> str:
    return f"(upper({w}) = {w} AND lower({w}) <> {w})"


def _booster(w: str, v: str) -> str:
    caps = f"(CASE WHEN {_upper(w)} AND mixed THEN CASE WHEN {v} > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END)"
    sign = f"(CASE WHEN {v} < 0 THEN -1 ELSE 1 END)"
    return f"(CASE WHEN lower({w}) IN ({_BOOST}) THEN {sign} * 0.293 + {caps} WHEN lower({w}) IN ({_DAMP}) THEN -{sign} * 0.293 + {caps} ELSE 0 END)::DOUBLE"


def _back(source: str, name: str, out: str, damping: str, negation: str) -> str:
    """Two steps of the look back: booster, then negation, on the rows of ``source``."""
    active = f"({name} IS NOT NULL AND lower({name}) NOT IN (SELECT token FROM lexicon))"
    return (
        f"{out}_b AS (SELECT * REPLACE (CASE WHEN {active} THEN v + {damping} * {_booster(name, 'v')} ELSE v END AS v) FROM {source}), "
        f"{out} AS (SELECT * REPLACE (CASE WHEN {active} THEN {negation} ELSE v END AS v) FROM {out}_b)"
    )


_LEXICON = "lexicon(token, valence) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in t.LEXICON) + ")"
_SAID = ["lower(w) || ' ' || lower(wn) || ' ' || lower(wn2)", "lower(w) || ' ' || lower(wn)", "l1 || ' ' || lower(w)",
         "l2 || ' ' || l1 || ' ' || lower(w)", "l2 || ' ' || l1", "l3 || ' ' || l2 || ' ' || l1", "l3 || ' ' || l2"]
_IDIOM = "CASE " + " ".join(f"WHEN {s} = '{k}' THEN {v}::DOUBLE" for s in _SAID for k, v in t.IDIOMS.items()) + " ELSE v END"
_PHRASES = "(" + " + ".join(f"CASE WHEN {_SAID[i]} IN ({t.in_list(t.PHRASES)}) THEN 0.293::DOUBLE ELSE 0 END" for i in (5, 6, 4)) + ")"
_RULES = {"idioms": t.IDIOMS, "phrases": t.PHRASES}
_SO_THIS = "coalesce(l1 IN ('so', 'this'), false)"
_TOKENS_SQL = f"""WITH {_LEXICON},
docs AS (SELECT doc_id, text, list_transform({t.s_tokens('text')}, lambda w: CASE WHEN length(trim(w, {_P})) <= 2 THEN w ELSE trim(w, {_P}) END) AS words FROM documents),
marked AS (SELECT *, len(list_filter(words, lambda w: {_upper('w')})) AS ups, coalesce(list_position(list_transform(words, lambda w: lower(w)), 'but'), 0) AS but_at FROM docs),
tok AS (SELECT doc_id, ups > 0 AND ups < len(words) AS mixed, but_at, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM marked),
near AS (SELECT *, lag(w, 1) OVER d AS w1, lag(w, 2) OVER d AS w2, lag(w, 3) OVER d AS w3, lead(w) OVER d AS wn, lead(w, 2) OVER d AS wn2 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
hit AS (SELECT near.*, lexicon.valence AS v0, lexicon.token, lower(w1) AS l1, lower(w2) AS l2, lower(w3) AS l3 FROM near JOIN lexicon ON lower(w) = lexicon.token
  WHERE lower(w) NOT IN ({_BOOST}, {_DAMP}) AND NOT (lower(w) = 'kind' AND coalesce(lower(wn), '') = 'of')),
r0 AS (SELECT *, CASE WHEN coalesce(l1 = 'no', false) OR coalesce(l2 = 'no', false) OR (coalesce(l3 = 'no', false) AND coalesce(l1 IN ('or', 'nor'), false)) THEN v0 * -0.74::DOUBLE
  WHEN token = 'no' AND lower(wn) IN (SELECT token FROM lexicon) THEN 0.0::DOUBLE ELSE v0 END AS v FROM hit),
r1 AS (SELECT * REPLACE (CASE WHEN {_upper('w')} AND mixed THEN v + CASE WHEN v > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END ELSE v END AS v) FROM r0),
{_back('r1', 'w1', 'r2', '1.0::DOUBLE', f"CASE WHEN {_negated('l1')} THEN v * -0.74::DOUBLE ELSE v END")},
{_back('r2', 'w2', 'r3', '0.95::DOUBLE', f"CASE WHEN coalesce(l2 = 'never', false) AND {_SO_THIS} THEN v * 1.25::DOUBLE WHEN coalesce(l2 = 'without' AND l1 = 'doubt', false) THEN v WHEN {_negated('l2')} THEN v * -0.74::DOUBLE ELSE v END")},
{_back('r3', 'w3', 'r4', '0.9::DOUBLE', f"CASE WHEN coalesce(l3 = 'never' AND l2 IN ('so', 'this'), false) OR {_SO_THIS} THEN v * 1.25::DOUBLE WHEN coalesce(l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt'), false) THEN v WHEN {_negated('l3')} THEN v * -0.74::DOUBLE ELSE v END")},
r4i AS (SELECT * REPLACE (CASE WHEN l3 IS NOT NULL AND l3 NOT IN (SELECT token FROM lexicon) THEN {_IDIOM} - {_PHRASES} ELSE v END AS v) FROM r4),
r5 AS (SELECT doc_id, pos, token, CASE WHEN coalesce(l1 = 'least', false) AND l1 NOT IN (SELECT token FROM lexicon) AND NOT coalesce(l2 IN ('at', 'very'), false) THEN v * -0.74::DOUBLE ELSE v END
  * CASE WHEN but_at = 0 OR pos = but_at THEN 1 WHEN pos < but_at THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS v FROM r4i)"""
_EMPHASIS = """least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0
  WHEN length(text) - length(replace(text, '?', '')) <= 3 THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE ELSE 0.96::DOUBLE END"""
_SCORES_SQL = f"""{_TOKENS_SQL},
sums AS (SELECT doc_id, sum(v) AS s, coalesce(sum(v + 1) FILTER (v > 0), 0) AS p, coalesce(sum(1 - v) FILTER (v < 0), 0) AS n, count(*) FILTER (v <> 0) AS charged FROM r5 GROUP BY doc_id),
base AS (SELECT docs.doc_id, text, len(words) AS k, {_EMPHASIS} AS e, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(charged, 0) AS charged FROM docs LEFT JOIN sums ON docs.doc_id = sums.doc_id),
amp AS (SELECT doc_id, text, s + CASE WHEN s > 0 THEN e WHEN s < 0 THEN -e ELSE 0 END AS s, p + CASE WHEN p > n THEN e ELSE 0 END AS p, n + CASE WHEN p < n THEN e ELSE 0 END AS n, k - charged AS u FROM base),
scored AS (SELECT doc_id, text, round(greatest(least(s / sqrt(s * s + 15), 1.0::DOUBLE), -1.0::DOUBLE), 4) AS compound, CASE WHEN p + n + u = 0 THEN 0.0 ELSE round(p / (p + n + u), 3) END AS positive,
  CASE WHEN p + n + u = 0 THEN 0.0 ELSE round(n / (p + n + u), 3) END AS negative, CASE WHEN p + n + u = 0 THEN 0.0 ELSE round(u / (p + n + u), 3) END AS neutral FROM amp)"""

RULES = _RULES


def scores_sql(source: str) -> str:
    """CTEs up to ``scored`` over any rows (doc_id, text)."""
    return _SCORES_SQL.replace("FROM documents)", f"FROM {source})")


@query("j01_token_valences", f"{_TOKENS_SQL} SELECT doc_id, CAST(pos - 1 AS INTEGER) AS position, token, round(v, 6) AS valence FROM r5")
def j01_tokens(spark, sf):
    return rounded(polarity.token_valences(t.table(spark, sf, "documents"), "doc_id", "text", t.lexicon(spark), **_RULES))


@query("j01_polarity", f"{_SCORES_SQL} SELECT doc_id, compound, positive, negative, neutral FROM scored")
def j01(spark, sf):
    return polarity.polarity(t.table(spark, sf, "documents"), "doc_id", "text", t.lexicon(spark), **_RULES)


@query("j02_subjectivity_of_scored", f"""{_SCORES_SQL} SELECT doc_id, compound AS sentiment_polarity, round({t.s_subjectivity('text', 'compound')}, 6) AS sentiment_subjectivity,
  {t.s_label('compound')} AS sentiment_label FROM scored""")
def j02(spark, sf):
    scored = polarity.with_scores(t.table(spark, sf, "documents"), "doc_id", "text", t.lexicon(spark), **_RULES)
    return rounded(scored.select("doc_id", "sentiment_polarity", "sentiment_subjectivity", "sentiment_label"))


@query("j03_findings", f"""WITH {t.EVENTS}, days AS (SELECT CAST(day(ts) AS INTEGER) AS day, avg(compound) AS m FROM ev GROUP BY 1),
  e AS (SELECT arg_min(m, day) AS a, arg_max(m, day) AS z, max(m) AS hi, min(m) AS lo FROM days)
  SELECT round((SELECT avg(compound) FROM ev), 6) AS mean, (SELECT CASE WHEN avg(compound) > 0.05 THEN 'POSITIVE' WHEN avg(compound) < -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END FROM ev) AS verdict,
    round(z - a, 6) AS change, CASE WHEN z > a THEN 'IMPROVING' ELSE 'DECLINING' END AS direction, (SELECT min(day) FROM days WHERE m = hi) AS best, (SELECT min(day) FROM days WHERE m = lo) AS worst,
    (SELECT event_type FROM ev GROUP BY 1 ORDER BY avg(compound) DESC, 1 LIMIT 1) AS best_group FROM e""")
def j03(spark, sf):
    """Verdict, trend over days and the best group, each a one-row table."""
    e = t.events(spark, sf).withColumn("day", F.dayofmonth("ts"))
    moves = trends.trend(e, "day", "compound").select("change", "direction", "best", "worst")
    best = aggregates.best_group(e, "event_type", "compound")
    verdict = aggregates.overall_verdict(e, "compound")
    return rounded(moves.select(
        verdict.select("mean").scalar().alias("mean"), verdict.select("verdict").scalar().alias("verdict"), "*",
        best.select("event_type").scalar().alias("best_group")))
