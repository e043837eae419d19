import random

from sparkloom.llm import url_filter as U


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(120)] + [(f"m{rng.randint(0, 90)}", f"m{rng.randint(0, 90)}") for _ in range(60)]
    edges += [("hub", f"leaf{i}") for i in range(40)] + [("self", "self"), (None, "q"), ("hub", "leaf1")]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and root(a) != root(b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in U.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: root(x) for x in parent}


PAGES = [
    (1, "http://a.example.net/es/1?utm_source=x", '<link rel="canonical" href="https://b.example.org/x/1.html">'),
    (2, "https://b.example.org/x/1/", ""),
    (3, "http://c.example.org/y", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=http://b.example.org/x/1#t">'),
    (4, None, None),
    (5, "no scheme", None),
    (6, "http://WWW.Example.com/en/q", ""),
    (6, "http://WWW.Example.com/en/q", ""),
    (7, "http://sub.example.com/en/", '<link rel=canonical href="http://z.example.org/q">'),
    (8, "http://z.example.org/q", '<link href="http://www.example.com/en/k" rel="canonical">'),
    (9, "http://example.com", None),
    (10, "http://notexample.com/en/", None),
    (11, "http://x.net/ES/", None),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(*p, "r", "c") for p in PAGES], "page_id long, url string, html string, rule string, component string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.reason) for r in U.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/es/1", "net/es/", "block", "rule")
    assert got[2] == ("b.example.org", "/x/1/", None, "block", "alias")
    assert got[3][3:] == ("block", "alias")
    assert got[4] == ("", "", None, "allow", "default") == got[5]
    assert got[6][2:] == ("www.example.com/en/", "allow", "rule")
    assert got[7][2:] == ("example.com/en/", "block", "rule")
    # The canonical page that it names is allowed, though it isn't in the table, and that comes before the block of page 7.
    assert got[8][3:] == ("allow", "alias")
    assert got[9] == ("example.com", "", None, "allow", "default")
    assert got[10][2:4] == ("com/", "allow")
    assert got[11][2:4] == (None, "allow")
    assert U.judge(pages).count() == len(PAGES)


def test_explicit_allow_comes_first(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/fr/", '<link rel="canonical" href="http://o.org/x">'), (2, "http://b.com/x", '<link rel="canonical" href="http://o.org/x">'), (3, "http://o.org/x", "")],
        "page_id long, url string, html string",
    )
    assert {r.page_id: r.verdict for r in U.judge(pages).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_links_are_resolved_and_all_taken(spark):
    html = '<LINK REL="canonical" HREF="/a/b"><link rel=canonical href="c.html"><link rel="stylesheet" href="/no"><link href=\'//o.org/x\' rel=\'canonical\'>'
    html += '<link rel="canonical" href="?q=1"><link rel="canonical" href="#top"><link rel="canonical" href="mailto:a@b"><meta http-equiv=refresh content="0;url=d/e">'
    page = spark.createDataFrame([("https://h.org/f/g?x=1", html), ("http://h.org", '<link rel="canonical" href="z">')], "url string, html string")
    got = [r.l for r in page.select(U.links_of(page.html, page.url).alias("l")).collect()]
    assert got[0] == ["http://h.org/a/b", "http://h.org/f/c.html", "http://o.org/x", "http://h.org/f/g?q=1", "http://h.org/f/d/e"] and got[1] == ["http://h.org/z"]


def by_union_find(pages, redirects):
    """Verdicts by a plain loop over all urls; links are given beside the pages."""
    import re

    def host(u):
        return re.match(r"(?s).*?://([^/?#]*)", u).group(1).lower() if "://" in u else ""

    def path(u):
        return re.match(r"(?s).*?://[^/?#]*([^?#]*)", u).group(1) if "://" in u else ""

    def plain(u):
        query = re.match(r"(?s)[^?#]*\?([^#]*)", u)
        kept = sorted(q for q in (query.group(1) if query else "").split("&") if q and not re.match(U.TRACKING + "(=|$)", q))
        return host(u) + re.sub(r"(?:/index)?\.html?$|/+$", "", path(u)) + ("?" + "&".join(kept) if kept else "")

    def rule(u):
        fits = [(len(h) + len(p), v) for v, h, p in U.RULES if (host(u) == h or host(u).endswith("." + h)) and path(u).startswith(p)]
        return max(fits)[1] if fits else None

    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    urls = set()
    for url, targets in [*((u, t) for _, u, t in pages if u and "://" in u), *((a, [b]) for a, b in redirects)]:
        urls |= {url, *targets}
        for x, y in [("u " + url, plain(url)), *((plain(url), plain(t)) for t in targets)]:
            parent[root(x)] = root(y)
    decided = {}
    for u in urls:
        if rule(u):
            c = root(plain(u))
            decided[c] = max(decided.get(c, "block"), rule(u), key=lambda v: v == "allow")
    return [(i, (rule(u) if u else None) or (decided.get(root("u " + u)) if u and "://" in u else None) or "allow") for i, u, _ in pages]


def test_chains_cycles_and_a_hub_match_union_find(spark):
    rng = random.Random(8)
    hosts = ["a.net", "b.org", "www.example.com", "example.com", "c.org", "d.com"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x'])}/{rng.randint(0, 25)}{rng.choice(['', '.html', '/', '/index.html', '?ref=1', '?b=2&a=1'])}"
    pages = [(i, url(), [url() for _ in range(rng.choice([0, 0, 0, 1, 2]))]) for i in range(150)]
    pages += [(1000 + i, f"http://chain.org/{i}", [f"http://chain.org/{i + 1}"]) for i in range(60)]
    pages += [(2000 + i, f"http://hub.org/x?n={i}", ["http://hub.org/main"]) for i in range(10_000)]
    pages += [(30000, "http://loop.org/a", ["http://loop.org/b"]), (30001, "http://loop.org/b", ["http://loop.org/a"]), (40000, None, []), (40001, "no scheme", [])]
    redirects = [("http://chain.org/60", "http://bad.net/es/1"), ("http://hub.org/main/", "http://bad.net/fr/9"), ("http://loop.org/b", "http://ok.com/"), ("http://loop.org/a", "http://bad.net/es/7")]
    tags = lambda targets: "".join(f'<link rel="canonical" href="{t}">' for t in targets)
    df = spark.createDataFrame([(i, u, tags(t)) for i, u, t in pages], "page_id long, url string, html string").repartition(4)
    got = sorted((r.page_id, r.verdict) for r in U.judge(df, redirects=spark.createDataFrame(redirects, "src string, dst string")).collect())
    expected = sorted(by_union_find(pages, redirects))
    assert got == expected
    verdicts = dict(got)
    assert verdicts[1000] == "block" and verdicts[2500] == "block" and verdicts[30000] == "allow" and verdicts[40001] == "allow"


def test_long_urls_and_html(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 100_000, "<p>" * 200_000 + '<link rel="canonical" href="http://o.org/1">'), (2, "http://o.org/1", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in U.judge(pages).collect()} == {1: "block", 2: "block"}


def test_the_sql_follows_links_too(spark):
    import duckdb

    rows = [(i, u, h) for i, (_, u, h) in enumerate(PAGES)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    found = sorted(con.execute(U.OP8_SQL).fetchall(), key=lambda r: r[0])
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict")
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == found
