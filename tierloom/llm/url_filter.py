"""URL filter with redirect equivalence.

A rule names a host and a path prefix and allows or blocks it; it fits the
host and all subdomains, and the longest fitting rule decides. URLs that no
rule fits take part in the decisions on their aliases: URLs that a redirect
or canonical link of a page connects are one thing under several names.

- URLs of one canonical form (host in lower case, no fragment, no tracking
  parameters) are one node. Links between nodes come from the pages: ``<link
  rel="canonical">`` and ``<meta http-equiv="refresh">``.
- Connected components over the links give the alias classes.
- Rules are applied to every URL of a class, also to link targets that are
  no page here. A block spreads to the class's URLs that no rule fits,
  unless a rule explicitly allows one of the class: allow takes precedence.
- What no rule and no alias decides is allowed.

Rules are rows like any other table's, and there may be millions, also of one
host: a URL asks for its host's last labels and, of its path, for the prefixes
of the lengths that rules of that host have; URLs and rules then meet by an
equi-join on host and prefix. URLs are handled as 64-bit hashes; page texts are
read once for their links, in linear time (a tag ends at the next ``<`` or
``>``), and never shuffled.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and has no alias; relative link targets are resolved against
the page, without dot segments (RFC 3986, 5.2.4); of several links of one kind
a page's first counts; of two rules of one length the blocking one wins; repeated rows
each get their row; null ids are kept; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.graph import connected_components
from tierloom.llm.storage import table, written

ALLOW, BLOCK = "allow", "block"

# Fixed values of op5's rules: host, path, verdict.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)

#: Query parameters that do not name another page.
TRACKING = r"(?:utm_[^=&#]*|gclid|fbclid|ref)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?i)<((?:link|meta)\b[^<>]*+)"
_CANONICAL = r"""(?is)^link\b(?=.*?\brel\s*+=\s*+["']?canonical\b).*?\bhref\s*+=\s*+["']?([^"'\s]+)"""
_REFRESH = r"""(?is)^meta\b(?=.*?\bhttp-equiv\s*+=\s*+["']?refresh\b).*?\burl\s*+=\s*+["']?([^"'\s]+)"""
_DOTS = r"(?:^|/)\.\.?(?:/|$)"


def _rest(url: Column) -> Column:
    """After the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path from ``/`` on, without ``.`` and ``..``."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    parts = F.slice(F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts), 2, 1 << 30)

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.rlike(_DOTS), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def canonical_form(url: Column) -> Column:
    """Without fragment, tracking parameters and dot segments, host in lower
    case."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    query = F.regexp_replace(query, rf"(?<=[?&]){TRACKING}=[^&]*(?:&|$)", "")
    query = F.regexp_replace(query, r"[?&]$", "")
    form = F.concat(scheme, F.lit("://"), host_of(url), without_dots(path_of(url)), query)
    return F.when(_rest(url).isNotNull(), form)


def resolved(target: Column, page: Column) -> Column:
    """A link's target as a full URL; null if there is none."""
    scheme = F.substring_index(page, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(page))
    folder = F.regexp_replace(path_of(page), r"[^/]*$", "")
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    full = (
        F.when(target == "", None)
        .when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("#") | target.startswith("?"), F.concat(root, path_of(page), target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    full = F.when(_rest(page).isNotNull() | target.contains("://"), full)
    parts = F.concat(F.substring_index(full, "://", 1), F.lit("://"), host_of(full))
    return F.concat(parts, without_dots(path_of(full)), F.regexp_extract(_rest(full), r"^[^?#]*(.*)", 1))


def _node(url: Column) -> Column:
    return F.xxhash64(canonical_form(url))


def alias_links(pages: DataFrame) -> DataFrame:
    """``url, other``: the canonical and redirect links of all pages."""
    tags = pages.where(_rest(F.col("url")).isNotNull()).select("url", F.regexp_extract_all("html", F.lit(_TAG), F.lit(1)).alias("tags"))

    def first(pattern: str) -> Column:
        each = F.transform("tags", lambda tag: F.regexp_extract(tag, pattern, 1))
        return F.coalesce(F.get(F.filter(each, lambda x: x != ""), 0), F.lit(""))

    targets = F.array(*[resolved(first(p), F.col("url")) for p in (_CANONICAL, _REFRESH)])
    links = tags.where(F.size("tags") > 0).select("url", F.explode(targets).alias("other"))
    return links.where(_rest(F.col("other")).isNotNull()).distinct()


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` for each distinct host and path of
    ``urls`` that some rule fits."""
    labels = F.size(F.split("rule_host", r"\."))
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict")).distinct()
    widths = [r["n"] for r in named.select(labels.alias("n")).distinct().collect()]  # at most 127: labels of a host
    ends = [F.substring_index("host", ".", -n) for n in sorted(widths)] or [F.lit(None).cast("string")]
    lengths = named.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    spread = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(F.array_distinct(F.array(*ends))))
    spread = spread.join(lengths, "rule_host")
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    fitting = spread.select("host", "path", "rule_host", F.explode(prefixes).alias("rule_path")).join(named, ["rule_host", "rule_path"])
    best = F.max(
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("length"),
            (F.col("verdict") == BLOCK).alias("strict"),
            F.concat("rule_host", "rule_path").alias("rule"),
            "verdict",
        )
    )
    return fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, component``: one row per
    page; ``component`` is its alias class (null without links)."""
    links = written(alias_links(pages), "url_links")
    ends = links.select(_node(F.col("url")).alias("a"), _node(F.col("other")).alias("b")).where("a != b")
    classes = connected_components(ends)
    known = links.select(F.explode(F.array("url", "other")).alias("url")).distinct()
    known = known.select(_node(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    decided = written(apply_rules(pages.select(*parts).unionByName(known.select("host", "path")), rules), "url_rules")
    allowed = F.max(F.col("verdict") == ALLOW)
    by_class = (
        known.join(decided, ["host", "path"])
        .join(classes, "node")
        .groupBy("component")
        .agg(F.when(allowed, ALLOW).otherwise(BLOCK).alias("class_verdict"))
    )
    of_node = classes.join(by_class, "component", "left")
    rows = pages.select("page_id", "url", *parts, F.when(_rest(F.col("url")).isNotNull(), _node(F.col("url"))).alias("node"))
    judged = rows.join(decided, ["host", "path"], "left").join(of_node, "node", "left")
    verdict = F.coalesce("verdict", "class_verdict", F.lit(ALLOW))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "component")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


# The rules, for pages that carry no canonical or refresh link (as the given
# tables): aliases then differ in query and fragment only, so that one rule
# fits all of a class or none does. Links are tested against brute force.
OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
),
rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rule_host, rule_path, rule_verdict)
),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""
