import random

import duckdb
from tidemark.llm import urlfilter
from tidemark.llm.queries import oracle_sql, queries

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parse(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    query = rest[len(path) :].split("#")[0]
    return host, path, host + path + query


def by_rule(host, path):
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(urls, edges):
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    actions = {}
    for s, d in edges:
        a, b = parse(s), parse(d)
        if a[2] is None or b[2] is None:
            continue
        group[find(a[2])] = find(b[2])
        for h, p, n in (a, b):
            actions[n] = by_rule(h, p)[1]
    seen = {}
    for n, a in actions.items():
        if a:
            seen.setdefault(find(n), set()).add(a)
    for u in urls:
        h, p, n = parse(u)
        rule, action = by_rule(h, p)
        alias = seen.get(find(n)) if n in group else None
        verdict = action or ("allow" if alias and "allow" in alias else "block" if alias else "allow")
        yield h, p, rule, verdict


def test_judge_agrees_with_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.net", "NET", "www.Example.net", "example.com", "x.example.com", "notexample.com", "b.org", "c.io", "d.io", "example.net:80", "net.io"]
    paths = ["", "/", "/en/x", "/de/y", "/fr/z", "/en", "/?q=/en/", "#/de/", "/de/a?b=1", "/de/a?b=2#c"]
    urls = [rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(200)] + [None, "", "example.net/en/", "://", "http://", "a://b://c/d"]
    known = [u for u in urls if u]
    edges = [(rng.choice(known), rng.choice(known)) for _ in range(25)] + [(known[0], None), (None, known[1]), (known[2], known[2]), ("http://c.io/r", "http://far.net/x"), ("http://c.io/r", "http://d.io/s")]
    urls += ["http://c.io/r", "https://d.io/s#f"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)] + [(0, urls[0], 0), (None, urls[1], 0)], "page_id long, url string, verdict int")
    got = urlfilter.judge(pages, spark.createDataFrame(edges, "src string, dst string")).collect()
    assert len(got) == len(urls) + 2
    want = dict(enumerate(brute(urls, edges)))
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[1 if r.page_id is None else r.page_id], (urls[r.page_id or 0], r)
    assert {"rule", "alias", "default"} == {r.decided_by for r in got}
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_edges_of_pages(spark):
    html = '<head><LINK rel="canonical" data-x href="https://a.io/c?x=1&amp;y=2"><meta http-equiv=refresh content="0; URL=/moved"></head>'
    df = spark.createDataFrame([(1, "http://h.io/p", html), (2, None, html), (3, "http://h.io/q", None), (4, "http://h.io/r", "canonical"), (5, "http://h.io/s", '<link rel=canonical href="rel">')], "page_id long, url string, html string")
    got = {(r.src, r.dst) for r in urlfilter.page_edges(df).collect()}
    assert got == {("http://h.io/p", "https://a.io/c?x=1&y=2"), ("http://h.io/p", "http://h.io/moved")}


def test_sql_agrees(spark, sf_dir, tmp_path):
    got = sorted(map(tuple, queries()["op3_url_filters"](spark, sf_dir).select("page_id", "host", "path", "rule", "verdict", "decided_by").collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(con.sql(oracle_sql()["op3_url_filters"]).fetchall(), key=str)
    # and with edges
    link = '<link rel="canonical" href="%s">'
    rows = [(1, "http://c.io/r", link % "http://far.net/x"), (2, "http://d.io/s", link % "http://c.io/r"), (3, "http://e.io/", ""), (4, "https://f.io/t", link % "https://z.org/fr/a"), (5, "https://f.io/u", link % "https://f.io/t"), (6, "http://e.io/v", link % "http://q.net/"), (7, "http://e.io/v", link % "http://q.org/fr/"), (8, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries()["op3_url_filters"](spark, str(tmp_path)).collect()), key=str)
    con.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(oracle_sql()["op3_url_filters"]).fetchall(), key=str)
    assert [r[4] for r in got] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
