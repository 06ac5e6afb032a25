"""DuckDB SQL for the queries it can express."""

from __future__ import annotations

from opinara.llm import codes, credentials, decontaminate, links, rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def rules_sql() -> str:
    policy = rules.mask(rules.POLICIES[rules.CURRENT].reject)
    conditions = ("n_words < 10", "100 * n_repeat_words > 20 * n_words", "10 * n_symbols > n_words",
                  "word_chars > 40 * n_words", "2 * n_dup_lines > n_lines")
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(conditions))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)
), starts AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, unnest(range(0, 5)) AS k FROM starts) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), b AS (SELECT *, ({bits})::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
       (failure_bits & {policy}) = 0 AS kept, n_lines, failure_bits
FROM b"""


ANY_CASE = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = ANY_CASE + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def secrets_sql() -> str:
    kinds = (
        ("assign", ASSIGN, 2, 12, "TRUE"), ("access", "AKIA[A-Z0-9]+", 0, 18, "TRUE"), ("hex", "[0-9a-f]{16,}", 0, 16, "TRUE"),
        ("random", "[A-Za-z0-9+/_-]{20,}", 0, 20,
         "regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')"),
    )
    parts = []
    for i, (name, pattern, group, least, also) in enumerate(kinds):
        parts.append(rf"""
  SELECT doc_id, source, {i} AS place, '{name}' AS kind, start, start + length(f[i]) AS stop, v[i] AS value, k FROM (
    SELECT doc_id, source, k, f, v, i, list_sum(list_transform(g[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, source, hash(t) AS k, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS v,
                 string_split_regex(t, '{pattern}') AS g, unnest(range(1, len(f) + 1)) AS i FROM d))
  WHERE length(value) >= {least} AND {also}""")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
o AS (
  SELECT value, NOT ((owners > {credentials.MAX_OWNERS} AND repos > {credentials.MAX_REPOS}) OR repos > {credentials.MANY_REPOS}) AS live
  FROM (SELECT value, count(DISTINCT coalesce('x' || source, '')) AS owners, count(DISTINCT k) AS repos FROM s GROUP BY value)
),
k AS (SELECT s.*, o.live FROM s JOIN o ON o.value = s.value WHERE place < 3 OR o.live),
a AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans, count(*) FILTER (live) AS n_live
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def links_sql() -> str:
    up, low = links.UPPER, links.LOWER
    longest = sorted(links.RULES, key=lambda r: (-len(r[0] + r[1]), r))

    def case(value) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in longest) + " END"

    href = links.HREF.replace("'", "''")
    # Walks 300 steps, after which less than 1e-21 of the mass has still to arrive; additions may differ by less than a tie.
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{up}', '{low}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), m AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS listed FROM p),
edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{up}', '{low}') AS dst FROM p)
  WHERE src <> '' AND src <> dst GROUP BY src, dst
), hosts AS (
  SELECT host, count(*) FILTER (listed = 'allow') AS a, count(*) FILTER (listed = 'block') AS b FROM m WHERE host <> '' GROUP BY host
), seeds AS (
  SELECT 'trust' AS walk, host, a / sum(a) OVER () AS mass FROM hosts WHERE a > 0 UNION ALL
  SELECT 'distrust', host, b / sum(b) OVER () FROM hosts WHERE b > 0
), shares AS (
  SELECT 'trust' AS walk, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM edges UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), arrivals AS (
  SELECT 0 AS step, walk, host, mass * {1 - links.DAMPING} AS mass FROM seeds UNION ALL
  SELECT any_value(r.step) + 1, e.walk, e.b, sum(r.mass * e.share) * {links.DAMPING}
  FROM arrivals r JOIN shares e ON e.walk = r.walk AND e.a = r.host WHERE r.step < 300 GROUP BY e.walk, e.b
), scores AS (
  SELECT host, coalesce(sum(mass) FILTER (walk = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (walk = 'distrust'), 0) AS distrust
  FROM arrivals GROUP BY host
)
SELECT page_id, m.host, path, rule,
       coalesce(listed, CASE WHEN coalesce(distrust, 0) > {links.RATIO * (1 + links.TIE)!r} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN scores s ON s.host = m.host"""


NEAR = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), linked AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.b FROM reach r JOIN linked l ON l.a = r.y
), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.x = d.doc_id"""


def decontaminate_sql() -> str:
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    span, least_span = decontaminate.SPAN, 1 + min(max(m) for m in decontaminate.MASKS)

    def seeds(table: str, key: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {key}, p, '{i}:' || " + " || ' ' || ".join(f"w[p + {o + 1}]" for o in mask)
            + f" AS h FROM (SELECT {key}, w, unnest(range(0, len(w) - {span - 1})) AS p FROM {table})"
            for i, mask in enumerate(decontaminate.MASKS))

    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
i AS MATERIALIZED (SELECT * FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {decontaminate.LEAST_WORDS}),
hits AS (
  SELECT DISTINCT doc_id, item_id, a.p, b.p AS q FROM ({seeds('d', 'doc_id')}) a JOIN ({seeds('i', 'item_id')}) b ON a.h = b.h
), stretches AS (
  SELECT DISTINCT doc_id, item_id, shift, width, first FROM (
    SELECT doc_id, item_id, p - q AS shift, least({decontaminate.OVERLAP}, len(w)) AS width,
           unnest(range(greatest(0, q + least(0, {least_span} - width)), least(q, len(w) - width) + 1)) AS first
    FROM hits JOIN i USING (item_id))
), scored AS (
  SELECT doc_id, item_id, max(len(list_filter(range(0, width), lambda k: first + shift + k >= 0
         AND coalesce(d.w[first + shift + k + 1] = i.w[first + k + 1], FALSE))) / width) AS similarity
  FROM stretches JOIN d USING (doc_id) JOIN i USING (item_id) GROUP BY doc_id, item_id
  UNION ALL
  SELECT doc_id, item_id, max(c / n) FROM (
    SELECT doc_id, item_id, a.p - b.p AS shift, any_value(b.n) AS n, count(*) AS c
    FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d) a
    JOIN (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM i WHERE len(w) < {span}) b ON a.x = b.x
    GROUP BY doc_id, item_id, shift) GROUP BY doc_id, item_id
), a AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(similarity) AS similarity
  FROM scored WHERE similarity >= {decontaminate.SIMILARITY} GROUP BY doc_id
)
SELECT d.doc_id, a.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids,
       round(similarity, 6) AS similarity
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def codes_sql() -> str:
    rounds = []
    for r in range(codes.ROUNDS + 1):
        rounds.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 1024 + e) AS best
  FROM v JOIN b{r} USING (part) GROUP BY vec_id, part
)""")
        if r < codes.ROUNDS:
            rounds.append(f"""
m{r} AS (
  SELECT part, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS y FROM (
    SELECT part, best % 1024 AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM v JOIN a{r} USING (vec_id, part)) GROUP BY part, e, i
), b{r + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(n.c, b{r}.c) AS c FROM b{r}
  LEFT JOIN (SELECT part, e, list(y::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY part, e) n USING (part, e)
)""")
    last = codes.ROUNDS
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {codes.SCALE})::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, part, x[part * (len(x) // {codes.PARTS}) + 1:(part + 1) * (len(x) // {codes.PARTS})] AS x
  FROM (SELECT vec_id, x, unnest(range(0, {codes.PARTS})) AS part FROM k)
), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {codes.ENTRIES}),
b0 AS MATERIALIZED (SELECT part, e, x AS c FROM v JOIN f USING (vec_id)), {', '.join(rounds)},
o AS (
  SELECT vec_id, string_agg(format('{{:02x}}', best % 1024), '' ORDER BY part) AS code, sum(best // 1024)::BIGINT AS error FROM a{last} GROUP BY vec_id
), s AS (SELECT sha256(string_agg(y, ',' ORDER BY part, e, i)) AS h FROM (
  SELECT part, e, unnest(range(1, len(c) + 1)) AS i, unnest(c)::VARCHAR AS y FROM b{last}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM o JOIN k USING (vec_id), s"""


ORACLES = {
    "op2_rules": rules_sql(),
    "op4_secrets": secrets_sql(),
    "op5_links": links_sql(),
    "op6_near": NEAR,
    "op7_decontaminate": decontaminate_sql(),
    "op12_codes": codes_sql(),
}
