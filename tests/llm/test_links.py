"""The URL filter's propagation against brute force: a cycle, a long chain, hosts without links, repeated rows."""

import pytest

from tallyloom.llm import queries, url_filter

RULES = [("allow", "good.com", "/"), ("block", "bad.com", "/")]


def page(i, host, *to):
    return i, f"http://{host}/x", "".join(f'<a href="//{t}/y">t</a>' for t in to)


PAGES = [
    page(0, "good.com", "a.org", "c0.org"), page(1, "a.org", "b.org"), page(2, "b.org", "a.org", "end.org"), page(3, "bad.com", "b.org"), page(4, "spam.org", "bad.com"),
    page(5, "spam.org", "bad.com", "a.org"), *(page(10 + i, f"c{i}.org", f"c{i + 1}.org") for i in range(20)), page(40, "c20.org", "bad.com"), page(41, "lone.org"), page(0, "good.com", "a.org", "c0.org"),
]


def ranks(pages):
    """{kind: {host: rank}} by power iteration that returns from hosts without links to the seeds."""
    links, seed = {}, {"trust": {}, "distrust": {}}
    for _, url, html in pages:
        host = url.split("/")[2]
        for kind, seeded in (("trust", "good.com"), ("distrust", "bad.com")):
            if host == seeded:
                seed[kind][host] = seed[kind].get(host, 0) + 1
        for to in html.split('href="//')[1:]:
            links.setdefault(host, []).append(to.split("/")[0])
    edges = {"trust": [(a, b) for a, to in links.items() for b in to], "distrust": [(b, a) for a, to in links.items() for b in to]}
    out = {}
    for kind in seed:
        start = {h: n / sum(seed[kind].values()) for h, n in seed[kind].items()}
        degree = {}
        for a, _ in edges[kind]:
            degree[a] = degree.get(a, 0) + 1
        rank = dict(start)
        for _ in range(400):
            lost = sum(r for h, r in rank.items() if h not in degree)
            new = {h: (0.15 + 0.85 * lost) * s for h, s in start.items()}
            for a, b in edges[kind]:
                if a in rank:
                    new[b] = new.get(b, 0) + 0.85 * rank[a] / degree[a]
            rank = new
        out[kind] = rank
    return out


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "1 as rank")
    return url_filter.judge(df, RULES, tolerance=1e-12).collect()


def test_ranks(got):
    want = ranks(PAGES)
    assert len(got) == len(PAGES)
    for r in got:
        assert r.trust == pytest.approx(want["trust"].get(r.host, 0), rel=1e-6, abs=1e-10) and r.distrust == pytest.approx(want["distrust"].get(r.host, 0), rel=1e-6, abs=1e-10)


def test_verdicts(got):
    verdict = {r.host: r.verdict for r in got}
    assert (verdict["good.com"], verdict["bad.com"], verdict["spam.org"], verdict["a.org"], verdict["lone.org"], verdict["c20.org"]) == ("allow", "block", "block", "allow", "allow", "block")


def test_sql(spark, tmp_path):
    import duckdb

    names = {"good.com": "www.example.com", "bad.com": "bad.example.com", "/x": "/en/x"}
    rows = [[p[0], *p[1:]] for p in PAGES]
    for r in rows:
        for a, b in names.items():
            r[1], r[2] = r[1].replace(a, b), r[2].replace(a, b)
    rows.append([50, None, None])
    spark.createDataFrame([tuple(r) for r in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(queries.ORACLES["op2_url_filter"])
    at = [d[0] for d in found.description]
    want = sorted([tuple(dict(zip(at, r))[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in found.fetchall()], key=str)
    mine = sorted([tuple(r) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()], key=str)
    assert mine == want and {v[-1] for v in mine} == {"allow", "block"}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(none, RULES).count() == 0
