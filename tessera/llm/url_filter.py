"""URL rules carried to aliases over redirect and canonical-link edges (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint
from tessera.llm.components import connected_components

#: Tags that make an alias, what tells them from others of their kind, and where they lead. No look-around.
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
IS_CANONICAL, IS_REFRESH = r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\bcontent\s*=\s*["'][^"'>]*\burl\s*=\s*["']?([^"'\s>]+)"""
#: ``.`` and ``..`` are folded in paths of so many segments at most; longer ones are compared as written.
SEGMENTS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def folded(path: Column) -> Column:
    """A path that begins with ``/``, without ``.`` and ``..`` segments; the empty path is ``/``."""
    parts = F.split(path, "/")
    steps = F.slice(parts, 2, F.size(parts))
    nothing = F.array().cast("array<string>")
    kept = F.aggregate(steps, nothing, lambda done, x: F.when(x == ".", done).when(
        x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    dots = path.rlike(r"(?s)/\.\.?(/|\z)") & (F.size(parts) <= SEGMENTS)
    return F.when(path == "", "/").when(dots, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def address(url: Column) -> Column:
    """What aliases are compared by: host, folded path and query, without scheme and fragment; null if no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), folded(path_of(url)), query))


def resolved(link: Column, url: Column) -> Column:
    """A link of the page at ``url`` as a whole url; null for links that lead to no page."""
    base = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (F.when(link.isNull() | (link == "") | link.startswith("#"), None)
            .when(link.rlike(r"(?i)^https?://"), link)
            .when(link.startswith("//"), F.concat(F.lit("x:"), link))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(link.startswith("/"), F.concat(base, link))
            .when(link.startswith("?"), F.concat(base, path_of(url), link))
            .otherwise(F.concat(base, folder, link)))


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a_url, b_url) of every canonical link and refresh redirect of every page."""
    def targets(tag: str, wanted: str, at: str) -> Column:
        tags = F.filter(F.regexp_extract_all(F.col(html_col), F.lit(tag), F.lit(0)), lambda x: x.rlike(wanted))
        return F.transform(tags, lambda x: F.regexp_extract(x, at, 1))

    links = F.concat(targets(LINK, IS_CANONICAL, HREF), targets(META, IS_REFRESH, TARGET))
    each = pages.select(F.col(url_col).alias("a_url"), F.explode(links).alias("link")).where("link <> '' and a_url is not null")
    whole = resolved(F.regexp_replace("link", "(?i)&amp;", "&"), F.col("a_url"))
    return each.select("a_url", whole.alias("b_url")).where("b_url is not null").distinct()


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, verdict) from (verdict, rule) pairs such as ("block", "net/")."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")


def matched(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``urls(url)``, distinct, with the longest fitting rule and its verdict (or nulls).

    A rule is joined by its host with those suffixes of a url's host that have as many labels as some
    rule's host, so a host of any length yields a few suffixes; of rules of equal length allow goes first,
    then the first by code point.
    """
    none = [F.lit(None).cast("string").alias(c) for c in ("rule", "rule_verdict")]
    if not rules:
        return urls.select("url", *none)
    u = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    sizes = sorted({r.partition("/")[0].count(".") + 1 for _, r in rules})
    suffixes = F.array(*[F.when(dots >= k - 1, F.substring_index("host", ".", -k)) for k in sizes])
    each = u.select("url", "path", F.explode(suffixes).alias("rule_host")).where("rule_host is not null")
    fits = each.join(rules_table(urls.sparkSession, rules), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct(-F.length("rule"), F.col("rule_verdict"), F.col("rule"))
    best = fits.groupBy("url").agg(F.min(order.alias("o")).alias("o")).select(
        "url", F.col("o.rule").alias("rule"), F.col("o.rule_verdict").alias("rule_verdict"))
    return urls.join(best, "url", "left")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block) for every row.

    A url that a rule fits takes the rule's verdict. Any other url takes that of its aliases: urls
    joined by canonical links and refresh redirects (of any length and direction, every such tag of a
    page) are one class; a class with an allowed url allows, else one with a blocked url blocks, else
    it is allowed. Aliases are compared without scheme and fragment, with ``/`` for an empty path and without
    ``.`` and ``..`` segments (in paths of ``SEGMENTS`` segments at most).

    Null urls and urls without ``://`` have empty host and path and are allowed; they meet no join. Null
    html has no links. Repeated urls are judged once, and each of their rows is returned. Urls and hosts may be of any
    length. An empty table gives an empty result. Columns named host, path, rule and verdict are
    replaced; columns of any other name are kept.
    """
    edges = checkpoint(alias_edges(pages, url_col, html_col))
    own = pages.select(F.col(url_col).alias("url")).where(host_of(F.col("url")) != "")
    urls = own.union(edges.select("b_url").where(host_of(F.col("b_url")) != "")).distinct()
    said = checkpoint(matched(urls, rules).withColumn("node", address(F.col("url"))))
    ends = edges.select(address(F.col("a_url")).alias("a"), address(F.col("b_url")).alias("b"))
    known = said.join(connected_components(ends), "node", "left").withColumn("class", F.coalesce("component", "node"))
    told = known.where("rule_verdict is not null").groupBy("class").agg(F.min("rule_verdict").alias("class_verdict"))
    judged = known.join(told, "class", "left").select(
        F.col("url").alias("_tessera_url"), F.col("rule").alias("_tessera_rule"),
        F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("_tessera_verdict"))
    url = F.col(url_col)
    # Rows without a host have keys of their own, which match nothing and gather nowhere.
    key = F.when(host_of(url) != "", url).otherwise(F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string")))
    rest = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c not in (url_col, html_col)])
    out = rest.withColumn("_tessera_url", key).join(judged, "_tessera_url", "left")
    return out.withColumns({
        "host": host_of(url), "path": path_of(url), "rule": F.col("_tessera_rule"),
        "verdict": F.coalesce("_tessera_verdict", F.lit("allow"))}).drop("_tessera_url", "_tessera_rule", "_tessera_verdict")
