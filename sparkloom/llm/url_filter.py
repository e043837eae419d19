"""URL rules whose block decisions reach a page's aliases.

Explicit rules name a host and a path prefix; the longest that fits decides. Urls that stand for the same resource are
aliases: every url leads to its normalised form, as servers redirect it, a redirect joins a url to the one it leads to, and
a canonical link or a refresh joins a page to the ones it names. Connected components over these edges, computed by
randomised contraction in DataFrame operations alone, pass a block on to every page of the component without a rule of its
own, unless a url there is explicitly allowed.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import ascii_lower, cut, discard, settled, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that do not choose the resource.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Tags that name another url, the attribute that tells them from others of their kind, and where the url stands in them.
LINKS = (
    ("anonical", r"(?is)<link\b[^>]*>", r"(?is)\brel\s*=\s*[\"']?canonical", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    ("efresh", r"(?is)<meta\b[^>]*>", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null if none does. A rule fits its host and all subdomains.

    Length is that of host and path together. Of rules of one length that fit, the one whose host, then path, comes last in
    the order of texts decides. A null or empty host fits no rule.
    """
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def canonical_url(url: Column) -> Column:
    """Where servers commonly redirect a url: no scheme, fragment, tracking parameters, index file, .html or last slash."""
    path = F.regexp_replace(path_of(url), r"(?:/index)?\.html?$|/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike("^" + TRACKING + "(?:=|$)"))
    return F.concat(host_of(url), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def resolved(link: Column, url: Column) -> Column:
    """The absolute url that a link on the page ``url`` names; null for other schemes and for a place on the page itself."""
    host = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.startswith("?"), F.concat(host, path_of(url), link))
        .when(~link.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(host, F.when(folder == "", "/").otherwise(folder), link))
    )


def links_of(html: Column, url: Column) -> Column:
    """The absolute urls that the canonical links and refreshes of a page name, however many."""

    def named(word: str, tag: str, kind: str, href: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
        urls = F.filter(F.transform(tags, lambda t: resolved(F.regexp_extract(t, href, 1), url)), lambda x: x.isNotNull() & (x != ""))
        # Most pages have neither tag; a plain search for the word spares them the patterns.
        return F.when(html.contains(word) | html.contains(word.upper()), urls).otherwise(F.expr("cast(array() as array<string>)"))

    return F.concat(*(named(*link) for link in LINKS))


def node(c: Column) -> Column:
    """128 bits of a url's hash, as text."""
    return F.md5(c.cast("binary"))


def joined_urls(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """url and target: each page's url with null and with every url that it names, and the redirects (src, dst)."""
    has = F.contains("url", F.lit("://"))
    rows = pages.where(has).select("url", F.explode(F.concat(F.array(F.lit(None).cast("string")), links_of(F.coalesce("html", F.lit("")), F.col("url")))).alias("target"))
    if redirects is not None:
        ends = redirects.select(F.col("src").alias("url"), F.col("dst").alias("target"))
        rows = rows.unionByName(ends.where(has).withColumn("target", F.when(F.contains("target", F.lit("://")), F.col("target"))))
    return rows


def alias_edges(urls: DataFrame) -> DataFrame:
    """src, dst of (url, target): every url to its normalised form, and to that of its target. Nodes are hashed urls."""
    own, to = F.col("url"), F.col("target")
    plain = F.struct(node(own).alias("src"), node(canonical_url(own)).alias("dst"))
    named = F.struct(node(canonical_url(own)).alias("src"), node(canonical_url(to)).alias("dst"))
    edges = F.array(plain, F.when(to.isNotNull() & (canonical_url(to) != canonical_url(own)), named))
    return urls.select(F.inline(F.filter(edges, lambda e: e.isNotNull())))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (the smallest node in it) of every node that an edge names.

    In each round every node takes the smallest of its neighbours and itself; the edges between the chosen nodes make the
    next, smaller graph. Even rounds compare the names, which ends stars at once; odd ones compare hashed names, salted by
    the round, so that the rounds grow with the logarithm of the nodes only, whatever the graph's diameter. Nothing but one
    truth value a round reaches the driver. Null ends are left out. The tables of earlier rounds are deleted.
    """
    left = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct())
    first = left
    labels = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("label", F.col("node"))
    k = 0
    while not left.where("u <> v").isEmpty():
        both = left.select("u", "v").union(left.select("v", "u"))
        salt = k
        order = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(salt)) if salt % 2 else F.lit(0)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        chosen = cut(
            both.groupBy("u")
            .agg(F.min(order("v")).alias("near"))
            .select(F.col("u").alias("from"), F.least(F.col("near"), order("u"))["to"].alias("to"))
        )
        before = labels
        labels = cut(
            labels.join(chosen, labels.label == chosen["from"], "left").select("node", F.coalesce("to", "label").alias("label"))
        )
        step = left.where("u <> v").join(chosen.select(F.col("from").alias("u"), F.col("to").alias("u2")), "u")
        step = step.join(chosen.select(F.col("from").alias("v"), F.col("to").alias("v2")), "v")
        last, left = left, cut(step.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).where("u <> v").distinct())
        discard(before, chosen, last)
        k += 1
    if left is not first:
        discard(left)
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, component, reason.

    The reason is ``rule`` where a rule decides, ``alias`` where a component's explicit decision does (allow before
    block), else ``default`` (allow). Explicit decisions are those on the urls of pages, on urls that they name and on both
    ends of ``redirects`` (src, dst). Null urls, and such without ://, have empty host and path, no aliases and the verdict
    allow. Links relative to the page are resolved; a page may name several urls. Urls and html of any length are read whole.
    Null page_ids and repeated rows pass through; an empty table gives an empty result. Further columns are not read.
    """
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.contains("url", F.lit("://")), node(F.col("url"))).alias("_node")
    ).select("*", text.alias("rule"), verdict.alias("_own"))
    urls = cut(joined_urls(pages.select("url", "html"), redirects))
    components = settled(lambda: connected_components(alias_edges(urls)).select(F.col("node").alias("_n"), F.col("component").alias("_c")))
    # Decisions on all urls, those only named included; one row a decided component, by partial sums, so that a component of
    # many aliases doesn't meet in one task.
    each = urls.select(F.explode(F.array("url", "target")).alias("url")).where("url IS NOT NULL")
    decided = each.select(node(canonical_url(F.col("url"))).alias("_d"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("_v")).where("_v IS NOT NULL").distinct()
    explicit = (
        decided.join(components, decided["_d"] == components["_n"])
        .groupBy("_c")
        .agg(F.max(F.col("_v") == "allow").alias("_allowed"))
        .select(F.col("_c").alias("_e"), F.when(F.col("_allowed"), "allow").otherwise("block").alias("_shared"))
    )
    placed = rows.join(components, rows["_node"] == components["_n"], "left")
    return placed.join(explicit, placed["_c"] == explicit["_e"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("_own", "_shared", F.lit("allow")).alias("verdict"),
        F.col("_c").alias("component"),
        F.when(F.col("_own").isNotNull(), "rule").when(F.col("_shared").isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_host(u: str) -> str:
    return f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_path(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql_canonical(u: str) -> str:
    query = f"regexp_extract(coalesce({u}, ''), '(?s)^[^?#]*\\?([^#]*)', 1)"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')))"
    return f"{_sql_host(u)} || regexp_replace({_sql_path(u)}, '(/index)?\\.html?$|/+$', '') || coalesce('?' || nullif(list_aggregate({kept}, 'string_agg', '&'), ''), '')"


def _sql_resolved(x: str) -> str:
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    folder = f"regexp_replace({_sql_path('url')}, '[^/]*$', '')"
    return (
        f"CASE WHEN regexp_matches({x}, '{scheme}//') THEN {x} WHEN starts_with({x}, '//') THEN 'http:' || {x} WHEN starts_with({x}, '/') THEN 'http://' || {_sql_host('url')} || {x} "
        f"WHEN starts_with({x}, '?') THEN 'http://' || {_sql_host('url')} || {_sql_path('url')} || {x} "
        f"WHEN NOT regexp_matches({x}, '{scheme}|^#') THEN 'http://' || {_sql_host('url')} || coalesce(nullif({folder}, ''), '/') || {x} END"
    )


def _sql_links(tag: str, kind: str, href: str) -> str:
    quote = lambda s: s.replace("'", "''").replace('\\"', '"')
    tags = f"list_filter(regexp_extract_all(coalesce(html, ''), '{quote(tag)}'), lambda t: regexp_matches(t, '{quote(kind)}'))"
    return f"SELECT url, {_sql_resolved('x')} AS target FROM (SELECT url, unnest(list_transform({tags}, lambda t: regexp_extract(t, '{quote(href)}', 1))) AS x FROM pages WHERE contains(url, '://')) WHERE x <> ''"


def _sql_rule(host: str, path: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h}{p}'" for _, h, p in ordered) + " END"


def _sql_verdict(rule: str) -> str:
    return f"CASE {rule} " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES) + " END"


def _sql(redirects: str | None = None) -> str:
    """The same with components by a recursive query over the edges in both directions."""
    more = f" UNION SELECT src, CASE WHEN contains(dst, '://') THEN dst END FROM ({redirects}) WHERE contains(src, '://')" if redirects else ""
    return f"""
WITH RECURSIVE named AS ({" UNION ALL ".join(_sql_links(tag, kind, href) for _, tag, kind, href in LINKS)}),
u AS (SELECT url, NULL::VARCHAR AS target FROM pages WHERE contains(url, '://') UNION SELECT url, target FROM named WHERE target IS NOT NULL{more}),
one AS (SELECT DISTINCT 'u ' || url AS a, {_sql_canonical("url")} AS b FROM u UNION SELECT {_sql_canonical("url")}, {_sql_canonical("target")} FROM u WHERE target IS NOT NULL),
e AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach(n, l) AS (SELECT a, a FROM e UNION SELECT e.b, reach.l FROM reach JOIN e ON e.a = reach.n),
c AS (SELECT n, min(l) AS l FROM reach GROUP BY n),
every AS (SELECT url FROM u UNION SELECT target FROM u WHERE target IS NOT NULL),
d AS (SELECT {_sql_canonical("url")} AS n, {_sql_verdict(_sql_rule(_sql_host("url"), _sql_path("url")))} AS v FROM every),
x AS (SELECT l, max(CASE v WHEN 'allow' THEN 1 ELSE 0 END) AS allowed FROM d JOIN c USING (n) WHERE v IS NOT NULL GROUP BY l),
p AS (SELECT *, {_sql_rule("host", "path")} AS rule FROM (SELECT page_id, url, {_sql_host("url")} AS host, {_sql_path("url")} AS path FROM pages))
"""


OP8_SQL = f"""{_sql()}SELECT page_id, host, path, rule, coalesce({_sql_verdict("rule")}, CASE allowed WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN c ON c.n = 'u ' || p.url LEFT JOIN x ON x.l = c.l
"""

#: Redirects made from the pages, alike in both engines: of seven pages three begin chains over hosts without rules that end
#: at a blocked host, at an allowed one, or at both, and three more go to a hop of a chain.
_REDIRECTS = """SELECT url AS src, 'https://hop' || (page_id // 7) || '.org/' || (page_id % 3) AS dst FROM pages WHERE page_id % 7 < 6
UNION ALL SELECT 'https://hop' || (page_id // 7) || '.org/' || (page_id % 3), 'https://hop' || (page_id // 7) || '.org/end/' || (page_id % 3) FROM pages WHERE page_id % 7 < 3
UNION ALL SELECT 'https://hop' || (page_id // 7) || '.org/end/0', 'https://away' || (page_id // 7) || '.net/es/' FROM pages WHERE page_id % 7 < 3 AND page_id % 3 = 0
UNION ALL SELECT 'https://hop' || (page_id // 7) || '.org/end/1', 'https://away' || (page_id // 7) || '.com/' FROM pages WHERE page_id % 7 < 3 AND page_id % 3 = 1
UNION ALL SELECT 'https://hop' || (page_id // 7) || '.org/end/2', CASE page_id % 2 WHEN 0 THEN 'https://both.net/fr/' ELSE 'https://www.example.com/en/' END FROM pages WHERE page_id % 7 < 3 AND page_id % 3 = 2"""
OP8_REDIRECTS_SQL = f"""{_sql(_REDIRECTS)}SELECT page_id, rule, coalesce({_sql_verdict("rule")}, CASE allowed WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM p LEFT JOIN c ON c.n = 'u ' || p.url LEFT JOIN x ON x.l = c.l
"""


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with a table of redirects, which the pages of the tables don't name: most verdicts come from aliases."""
    pages = table(spark, sf_dir, "pages")
    redirects = spark.sql(_REDIRECTS.replace("//", "DIV").replace(":DIV", "://").replace("FROM pages", "FROM {pages}"), pages=pages)
    return judge(pages, redirects=redirects).select("page_id", "rule", "verdict", "reason")
