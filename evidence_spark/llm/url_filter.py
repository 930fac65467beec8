"""URL block and allow decisions that follow redirects: aliases of a blocked page are blocked, unless a rule allows them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .components import connected_components

#: (host, path, verdict): fits the host and its subdomains where the url's path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: So many rules at most are written into the plan as literals; more are joined as a table.
LITERAL_RULES = 200

#: An attribute's value, with the quote that opens it.
VALUE = r"""("[^">]*|'[^'>]*|[^"'\s>]+)"""
#: The href of a link with canonical among the tokens of its rel, the content of a refresh.
CANONICAL = r"""(?is)<link\b(?=[^>]*(?<![\w-])rel\s*=\s*(?:"(?:[^">]*\s)?canonical[\s"]|'(?:[^'>]*\s)?canonical[\s']|canonical[\s/>]))[^>]*?(?<![\w-])href\s*=\s*""" + VALUE
BASE = r"""(?is)<base\b[^>]*?(?<![\w-])href\s*=\s*""" + VALUE
REFRESH = r"""(?is)<meta\b(?=[^>]*(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b)[^>]*?(?<![\w-])content\s*=\s*""" + VALUE


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Of equally long ones the first in byte order, then allow."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def fitted(urls: DataFrame, rules) -> DataFrame:
    """urls (host, path and more) with r, the struct of best_rule(). rules: a list, or a table (host, path, verdict) of any size.

    A table is joined by equality: each of a host's suffixes meets the lengths that its rules' paths have, one row for each
    host of a rule, and so much of the path meets the rule itself. Distinct hosts and paths alone are looked up.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= LITERAL_RULES:
        return urls.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    spark = urls.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    table = table.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.min("verdict").alias("verdict"))
    shapes = table.groupBy("h").agg(F.collect_set(F.char_length("p")).alias("sizes"))  # as many as there are lengths of paths
    u = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = u.select("host", "path", F.explode(suffixes).alias("h")).join(shapes, "h")
    near = near.select("host", "path", "h", F.explode(F.filter("sizes", lambda n: n <= F.char_length("path"))).alias("n"))
    hits = near.withColumn("p", F.substr(F.col("path"), F.lit(1), F.col("n"))).join(table, ["h", "p"])
    rule = F.concat("h", "p")
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct(rule.alias("rule"), "verdict"), F.struct(-F.char_length(rule), rule, F.col("verdict"))).alias("r"))
    return urls.join(best, ["host", "path"], "left")


def node(url: Column) -> Column:
    """Urls that differ in scheme, fragment or the host's case alone are one node; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    return F.when(url_host(url) != "", F.xxhash64(F.concat(url_host(url), F.lit("\n"), url_path(url), query)))


def resolve(base: str, href: str) -> str | None:
    """The absolute url, without fragment, that a reference on a page means (RFC 3986, 5.2); None for one without a host, as of
    mailto: and javascript:."""
    part = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", re.S)
    scheme, host, path, query = part.match(href).groups()
    own, own_host, own_path, own_query = part.match(base).groups()
    if scheme is None:
        scheme = own
        if host is None:
            host = own_host
            if not path:
                path, query = own_path, own_query if query is None else query
            elif not path.startswith("/"):
                path = own_path.rpartition("/")[0] + "/" + path
    if not host or scheme is None:
        return None
    out: list[str] = []
    steps = path.split("/")
    for k, step in enumerate(steps):
        if step == "..":
            del out[max(1, len(out) - 1) :]
        elif step != ".":
            out.append(step)
            continue
        if k == len(steps) - 1:
            out.append("")
    return f"{scheme}://{host}{'/'.join(out)}{query or ''}"


def _hrefs():
    """(url, values of base elements, of canonical links, of refreshes) to (url, to). Character references are replaced as in
    HTML: a name needs its semicolon before a letter, a digit or =. Blanks become %20, line breaks and tabs go."""
    import html

    import pyarrow as pa

    reference = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;|(?![A-Za-z0-9=])))")
    goes = re.compile(r"\burl\s*=\s*(.*)", re.I | re.S)

    def plain(value):
        value = value[1:] if value[0] in "\"'" else value
        value = reference.sub(lambda m: html.entities.html5.get(m[1] + m[2], m[0]) if m[1] else html.unescape(m[0]), value)
        return value

    def tidy(value):
        return re.sub(r"[\t\n\r]", "", value.strip(" \t\n\f\r")).replace(" ", "%20")

    def target(value):
        to = (m := goes.search(plain(value))) and m[1]
        return to[1:].partition(to[0])[0] if to and to[0] in "\"'" else to or ""

    def step(batch):
        urls, ends = [], []
        for url, bases, links, refreshes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base = resolve(url, tidy(plain(bases[0]))) if bases else None
            for href in [*map(tidy, map(plain, links)), *map(tidy, map(target, refreshes))]:
                to = resolve(base or url, href) if href else None
                if to:
                    urls.append(url)
                    ends.append(to)
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(ends, pa.string())], names=["url", "to"])

    return step


def page_links(pages: DataFrame) -> DataFrame:
    """(url, to): one row for each canonical link and each refresh in a page's html, resolved against its base element's href,
    else its url."""
    found = [F.regexp_extract_all("html", F.lit(p), 1).alias(n) for p, n in ((BASE, "bases"), (CANONICAL, "links"), (REFRESH, "refreshes"))]
    rows = pages.where(F.col("html").isNotNull() & F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    return map_rows(rows.select("url", *found).where(F.size("links") + F.size("refreshes") > 0), _hrefs, "url string, to string")


def _redirects():
    import pyarrow as pa

    def step(batch):
        ends = [resolve(u, t.strip()) if u and t and t.strip() else None for u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.string())], names=["url", "to"])

    return step


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages.

    Links between urls are canonical links and refreshes in html and the rows (url, to) of redirects, which may be relative. Urls
    that links connect are aliases. A page that a rule fits has that rule's verdict, so an explicit allow holds whatever its aliases
    are; else it is blocked if any alias, a page or not, has a block by rule, and allowed if none has. rules: a list, or a table
    (host, path, verdict) of any size.
    Null or hostless urls have no alias and, unless a rule fits the empty host, are allowed. Repeated rows are judged alike;
    an empty table gives an empty result; columns other than page_id, url and html are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(map_rows(redirects.select(F.col("url").cast("string").alias("url"), F.col("to").cast("string").alias("to")), _redirects, "url string, to string"))
    ends = links.select("url", "to", node(F.col("url")).alias("a"), node(F.col("to")).alias("b")).where("a is not null and b is not null and a != b")
    ends = materialize(ends, "aliases")
    comps = connected_components(ends.select("a", "b"))
    urls = ends.select(F.col("a").alias("node"), "url").unionByName(ends.select(F.col("b").alias("node"), F.col("to").alias("url"))).distinct()
    judged = fitted(urls.select("node", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), rules)
    labels = comps.unionByName(comps.select(F.col("component").alias("node"), "component")).distinct()
    blocked = judged.where("r.verdict = 'block'").join(labels, "node").select("component").distinct()
    aliases = labels.join(blocked, "component").select(F.col("node").alias("n"), F.lit(True).alias("by_alias")).distinct()
    out = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), node(F.col("url")).alias("n"))
    out = fitted(out, rules).join(aliases, "n", "left")
    verdict = F.coalesce("r.verdict", F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
