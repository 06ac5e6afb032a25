from collections import defaultdict

import pytest

from opinara.llm import links


def page(url, *targets):
    return url, "".join(f'<p><a class="x" href="{t}">x</a>' for t in targets)


PAGES = [
    page("https://good.com/fr/1", "https://mid.net/a", "//MID.net/b", "/local", "http://good.com/self"),
    page("http://mid.net/x", "https://far.net/"), page("http://far.net/y#z"), page("http://bad.com/de/1"),
    page("https://fan.net/q?x=1", "https://bad.com/de/2", "https://bad.com/de/3"), page("http://fan2.net", "http://fan.net/"),
    page("HTTP://Sub.Example.ORG/es/1"), page("http://example.org/en/12"), page("http://example.org"), page("http://org/a"),
    page("http://notorg/a"), page("mailto:x"), (None, None), page("http://good.com/fr/1"), page("://?", "http://bad.com/"),
]


def brute(rows):
    """Verdicts by dense power iteration."""
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host):]
        for c in "?#":
            path = path.split(c, 1)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    def rule(host, path):
        fits = [(h + p, v) for h, p, v in links.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda r: len(r[0]), default=(None, None))

    placed = [(*split(u), h) for u, h in rows]
    listed = [rule(h, p) for h, p, _ in placed]
    edges, seeds = defaultdict(float), {"trust": defaultdict(float), "distrust": defaultdict(float)}
    for (host, _, html), (_, verdict) in zip(placed, listed):
        import re

        for target in re.findall(links.HREF, html or ""):
            if host and target.lower() != host:
                edges[host, target.lower()] += 1
        if verdict and host:
            seeds["trust" if verdict == "allow" else "distrust"][host] += 1
    scores = {}
    for walk in seeds:
        pairs = {(a, b) if walk == "trust" else (b, a): n for (a, b), n in edges.items()}
        out, total = defaultdict(float), sum(seeds[walk].values())
        for (a, _), n in pairs.items():
            out[a] += n
        start = {h: n / total for h, n in seeds[walk].items()}
        now = dict(start)
        for _ in range(300):
            new = defaultdict(float, {h: m * (1 - links.DAMPING) for h, m in start.items()})
            for (a, b), n in pairs.items():
                new[b] += links.DAMPING * now.get(a, 0) * n / out[a]
            now = new
        scores[walk] = now
    result = []
    for (host, path, _), (name, verdict) in zip(placed, listed):
        t, d = (round(scores[w].get(host, 0), 12) for w in ("trust", "distrust"))
        result.append((host, path, name, verdict or ("block" if d > t else "allow")))
    return result


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAGES)], "page_id bigint, url string, html string")
    rows = links.judge(df).orderBy("page_id").collect()
    expected = brute(PAGES)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == expected
    verdicts = {r["host"]: r["verdict"] for r in rows}
    assert verdicts["fan.net"] == "block" and verdicts["fan2.net"] == "block" and verdicts["far.net"] == "allow"


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "http://a.net/", "<a href='http://b.net'>")] * 3])
def test_without_seeds(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = links.judge(df).collect()
    assert len(out) == len(rows) and all(r["verdict"] == "allow" and r["rule"] is None for r in out)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://x.org/", "", "v", "h", "t")], "page_id bigint, url string, html string, verdict string, host string, trust string")
    r = links.judge(df).first()
    assert (r["host"], r["verdict"], r["rule"]) == ("x.org", "allow", "org/")


def converged(edges, hosts, damping):
    """(trust, distrust) per host, from the linear system that the walks converge to."""
    import numpy as np

    names = sorted({h for e in edges for h in e[:2]} | {h[0] for h in hosts})
    at = {h: i for i, h in enumerate(names)}
    scores = []
    for walk in (0, 1):
        move, start = np.zeros((len(names), len(names))), np.zeros(len(names))
        for src, dst, n in edges:
            a, b = (src, dst) if walk == 0 else (dst, src)
            move[at[b], at[a]] += n
        move /= np.maximum(move.sum(axis=0), 1)
        for h in hosts:
            start[at[h[0]]] = h[1 + walk]
        scores.append(np.linalg.solve(np.eye(len(names)) - damping * move, (1 - damping) * start / start.sum()))
    return {h: (scores[0][i], scores[1][i]) for h, i in at.items()}


def test_walks_converge(spark):
    chain = [(f"c{i + 1}", f"c{i}", 1) for i in range(13)] + [("c0", "bad", 1)]
    cycle = [("good", "x", 3), ("x", "y", 2), ("y", "good", 5), ("y", "x", 1), ("x", "bad", 1)]
    small = [(f"s{i + 1}", f"s{i}", 1) for i in range(3)] + [("crowd", f"s{i}", 10**5) for i in range(3)] + [("s0", "rare", 1)]
    edges, hosts = chain + cycle + small, [("good", 7, 0), ("bad", 0, 10**6), ("rare", 0, 1), ("alone", 2, 3)]
    rows = links.host_scores(spark.createDataFrame(edges, "src string, dst string, n bigint"),
                             spark.createDataFrame(hosts, "host string, n_allow bigint, n_block bigint"), damping=0.5).collect()
    expected = converged(edges, hosts, 0.5)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in rows}
    assert set(got) == {h for h, s in expected.items() if max(s) > 0}
    for h, s in got.items():
        assert s == pytest.approx(expected[h], rel=1e-9, abs=0), h


def test_far_hosts_and_small_masses_are_blocked(spark):
    pages = [page("http://bad.com/de/1")] + [page(f"http://c{i}.net/", f"http://c{i - 1}.net/" if i else "http://bad.com/") for i in range(13)]
    pages += [page("http://crowd.net/", *[f"http://{h}.net/" for h in ("s0", "s1", "s2", "s3") for _ in range(999)])]
    pages += [page(f"http://s{i}.net/", f"http://s{i - 1}.net/" if i else "http://c0.net/") for i in range(5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    rows = links.judge(df).collect()
    assert {r["host"] for r in rows if r["verdict"] == "allow"} == set()
    assert 0 < min(r["distrust"] for r in rows) < 5e-13


def test_sql_judges_a_linked_graph(spark):
    """The given pages link inside their hosts only; here cycles, long chains and small masses are judged by the SQL, too."""
    import random

    import duckdb

    from opinara.llm import oracles

    rng = random.Random(6)
    hosts = ["good.com", "other.org", "bad.com", "worse.com"] + [f"h{i}.net" for i in range(60)] + [f"c{i}.net" for i in range(16)]
    paths = {"good.com": "/fr/1", "other.org": "/", "bad.com": "/de/1", "worse.com": "/de/2"}
    pages = []
    for _ in range(260):
        h = rng.choice(hosts[:64])
        pages.append(page(f"http://{h}{paths.get(h, '/x')}", *[f"http://{rng.choice(hosts[:64])}/" for _ in range(rng.randrange(4))]))
    pages += [page(f"http://c{i}.net/", f"http://c{i - 1}.net/" if i else "http://bad.com/") for i in range(16)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAGES + pages)], "page_id bigint, url string, html string")
    got = [tuple(r) for r in links.judge(df).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    db = duckdb.connect()
    table = df.toPandas()
    db.register("pages", table)
    expected = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.links_sql()}) ORDER BY page_id").fetchall()
    assert got == expected
    by_walk = {v for _, _, _, rule, v in got if rule is None}
    assert by_walk == {"allow", "block"} and all(v == "block" for _, h, _, _, v in got if h.startswith("c") and h.endswith(".net"))
