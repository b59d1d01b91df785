import re
import time

from llm_helpers import CLASHING
from pyspark.sql import functions as F

from tierloom.llm.url_filter import BLOCK, RULES, apply_rules, canonical_form, filter_urls, resolved

RULE_ROWS = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(url):
    host, path = parts(url)
    fits = [(h, p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: (len(r[0] + r[1]), r[2] == BLOCK), default=None)


def brute(pages, links):
    """Verdicts with classes by repeated merging; ``links`` are (url, other)."""
    group = {}
    for a, b in links:
        group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    verdicts = {}
    for url in group:
        if rule := rule_for(url):
            verdicts.setdefault(group[url], set()).add(rule[2])
    out = []
    for page_id, url in pages:
        rule = rule_for(url)
        seen = verdicts.get(group.get(url), set())
        verdict = rule[2] if rule else "block" if seen == {"block"} else "allow"
        out.append((page_id, *parts(url), rule and rule[0] + rule[1], verdict))
    return sorted(out, key=repr)


def page(page_id, url, canonical=None, refresh=None):
    html = "<html><head>"
    if canonical:
        html += f'<LINK href="{canonical}" rel="canonical">'
    if refresh:
        html += f"<meta http-equiv='refresh' content='0; URL={refresh}'>"
    return page_id, url, html + "</head></html>"


def test_aliases_against_brute_force(spark):
    pages = [
        page(1, "http://a.net/x", canonical="https://b.example.com/de/1"),  # an alias of a blocked page
        page(2, "https://b.example.com/de/1"),
        page(3, "http://c.net/y", refresh="http://a.net/x"),  # an alias of an alias
        page(4, "http://d.net/", canonical="http://e.example.org/es/q"),
        page(5, "http://f.net/", refresh="http://d.net/", canonical="http://g.org/"),  # allowed takes precedence
        page(6, "http://sub.EXAMPLE.org/en/12?q=1#f"),
        page(7, "http://example.org/en/2"),
        page(8, None), page(9, "no scheme"), page(10, ""), page(11, "http://notorg/"), page(12, "http://h.net"),
        page(13, "http://i.net/dir/a", canonical="../b"), page(20, "http://i.net/x/.././b", refresh="/de/../de/q"), page(21, "http://i.net/b"),
        page(22, "http://n.com/p/q", canonical="./../de/./1?x=../y#/../z"), page(23, "http://n.com/de/1?x=../y"),
        page(14, "http://j.net/k?utm_source=z&id=1"), page(15, "http://j.net/k?id=1"),
        page(1, "http://a.net/x", canonical="https://b.example.com/de/1"), page(None, "http://x.com/fr/"),
        page(19, "http://C.net/y?utm_source=z#part"),  # another form of an alias
        (16, "http://l.net/", None), (17, "http://m.net/dir/p", '<link rel=canonical href=/de/root>'),
        (18, "http://x.example.com/de/" + "y" * 100_000, "<meta " * 5000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df = df.withColumns({c: F.lit(1) for c in (*CLASHING, "verdict", "rule", "other", "path")})
    links = [
        ("http://a.net/x", "https://b.example.com/de/1"), ("http://c.net/y", "http://a.net/x"),
        ("http://d.net/", "http://e.example.org/es/q"), ("http://f.net/", "http://d.net/"), ("http://f.net/", "http://g.org/"),
        ("http://j.net/k?utm_source=z&id=1", "http://j.net/k?id=1"), ("http://C.net/y?utm_source=z#part", "http://c.net/y"),
        ("http://i.net/dir/a", "http://i.net/b"), ("http://i.net/b", "http://i.net/x/.././b"), ("http://i.net/x/.././b", "http://i.net/de/q"),
        ("http://n.com/p/q", "http://n.com/de/1?x=../y"), ("http://m.net/dir/p", "http://m.net/de/root"),
    ]
    got = filter_urls(df, spark.createDataFrame(list(RULES), RULE_ROWS))
    rows = sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert rows == brute([p[:2] for p in pages], links)
    by_id = {r.page_id: r for r in got.collect()}
    assert by_id[3].verdict == "block" and by_id[5].verdict == "allow" and by_id[4].verdict == "allow"
    assert by_id[19].verdict == "block" and by_id[19].component == by_id[3].component


def test_relative_links_join_a_blocked_class(spark):
    pages = [page(1, "http://x.example.com/a", canonical="/de/1"), page(2, "http://y.example.com/b", refresh="//x.example.com/a")]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(list(RULES), RULE_ROWS))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block"}


def test_canonical_form(spark):
    urls = ["HTTP://A.org/P?utm_source=x#f", "http://a.org/P?ref=1&b=2", "http://a.org/P?b=2&utm_id=3", "http://a.org", "x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_form(F.col("u"))).collect()]
    assert got == ["http://a.org/P", "http://a.org/P?b=2", "http://a.org/P?b=2", "http://a.org", None]


def test_dot_segments(spark):
    """The examples of RFC 3986, 5.4, on http://a/b/c/d;p."""
    cases = {
        "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g",
        "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g",
        "g..": "/b/c/g..", "..g": "/b/c/..g", "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h",
        "g?y/../x": "/b/c/g?y/../x", "g#s/./x": "/b/c/g#s/./x", "//h/../x": "//h/x",
    }
    df = spark.createDataFrame([(x, "http://a/b/c/d;p") for x in cases], "target string, page string")
    got = {r.target: r.full for r in df.select("target", resolved(F.col("target"), F.col("page")).alias("full")).collect()}
    assert got == {x: f"http:{want}" if want.startswith("//") else f"http://a{want}" for x, want in cases.items()}


def test_unclosed_tags_take_linear_time(spark):
    html = "<link " * 200_000 + "<meta http-equiv " * 100_000 + "<link rel=canonical href=/de/9>" + "<link rel " + "rel " * 100_000
    pages = spark.createDataFrame([(1, "http://x.example.com/a", html)], "page_id long, url string, html string")
    start = time.time()
    assert filter_urls(pages, spark.createDataFrame(list(RULES), RULE_ROWS)).first().verdict == "block"
    assert time.time() - start < 120


def test_rules_of_one_host_meet_paths_by_prefix(spark):
    """A host of many rules and many paths: joined rows are about as many as
    paths, not their product."""
    rules = [("big.net", f"/d{n % 50}/p{n}", BLOCK if n % 3 else "allow") for n in range(2000)] + [("big.net", "/d7/", BLOCK), ("net", "", "allow")]
    urls = [("www.big.net", f"/d{n % 50}/p{n}/x") for n in range(6000)] + [("net", ""), ("big.net", "/d7/")]
    df = spark.createDataFrame(urls, "host string, path string")
    found = apply_rules(df, spark.createDataFrame(rules, RULE_ROWS))
    got = {(r.host, r.path): (r.rule, r.verdict) for r in found.collect()}
    for host, path in urls[::97] + urls[-2:]:
        fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), r[2] == BLOCK))
        assert got[host, path] == (best[0] + best[1], best[2])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((rule_host" in plan and "StartsWith" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame(list(RULES), RULE_ROWS)
    assert filter_urls(none, rules).count() == 0
    some = spark.createDataFrame([page(1, "http://a.com/de/")], "page_id long, url string, html string")
    assert filter_urls(some, rules.limit(0)).first().verdict == "allow"
