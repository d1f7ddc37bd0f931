"""Operator 8, URL filters with redirect equivalence.

Rules block or allow a host with its subdomains and a path prefix. Pages that redirect to, or name as canonical, one
address are aliases: distributed connected components over these edges carry a block to aliases that no rule fits,
unless an explicit allow is among them, which takes precedence.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut
from .graph import connected_components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equally long ones the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def address_of(url: Column, host: Column | None = None, path: Column | None = None) -> Column:
    """What spellings of one address share by the standard of URLs: scheme and host in lower case, no default port, no
    fragment, and / for an empty path. Null where there is no ://. host and path may be columns that hold these of url."""
    host, path = host_of(url) if host is None else host, path_of(url) if path is None else path
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    named = F.when(scheme == "http", F.regexp_replace(host, "^(.*):80$", "$1")).when(scheme == "https", F.regexp_replace(host, "^(.*):443$", "$1")).otherwise(host)
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), named, F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), query))


def resolved(target: Column, url: Column) -> Column:
    """The absolute address that a reference in the page at url means; null for what leads to no page (mailto: and the
    like, the page itself)."""
    root = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    named = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substr(target, F.char_length(named) + 1)
    joined = F.when(named.startswith("/"), named).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), named))
    steps = F.aggregate(
        F.slice(F.split(joined, "/"), F.lit(2), F.size(F.split(joined, "/"))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    closing = F.when(joined.rlike(r"/\.\.?$") & (F.size(steps) > 0), "/").otherwise("")
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), target))
        .when((target == "") | target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("?"), F.concat(root, path, target))
        .otherwise(F.concat(root, F.lit("/"), F.array_join(steps, "/"), closing, rest))
    )


def _value(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, without quotes and with &amp; read as &; empty where there is none."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.replace(F.btrim(found, F.lit("\"'" + WHITE)), F.lit("&amp;"), F.lit("&"))


def declared_targets(html: Column) -> Column:
    """The references of rel=canonical links and of refresh redirects in a page's whole HTML."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    canonical = F.transform(F.filter(tags, lambda t: t.rlike("(?i)^<link") & _value(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")), lambda t: _value(t, "href"))
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike("(?i)^<meta") & (F.lower(_value(t, "http-equiv")) == "refresh")),
        lambda t: F.regexp_extract(_value(t, "content"), r"(?is)(?:^|[;,\s])url\s*=\s*[\"']?([^\"'\s]+)", 1),
    )
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(F.concat(canonical, refresh), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def filter_urls(pages: DataFrame, url: str, html: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    A row that a rule fits has the rule's verdict. Another is blocked if an address of its component is blocked by a
    rule and none is allowed by one, and else allowed. Edges: a page's address to the canonical and redirect targets in
    its html, relative ones resolved against it. Spellings of one address (see address_of) are one node; targets are
    judged by the rules too.

    A null url, or one without ://, has empty host and path, no edges, and is allowed. Null html has no targets.
    Repeated rows get equal answers; an empty table stays empty. Columns named like the new ones are replaced. The
    rules are few enough to be an expression; a node is an address's 128-bit digest, and all else is joined by it.
    """
    new = ["host", "path", "rule", "verdict"]
    address = F.col(url)
    targets = declared_targets(F.col(html)) if html is not None else F.array().cast("array<string>")
    told = pages.where(address.contains("://")).select(address.alias("a"), F.explode(targets).alias("t"))
    # Read from the pages once: each text is matched here and nowhere else. Addresses are columns of their own from here
    # on, so that no expression holds another one's pattern again and again.
    edges = cut(told.select("a", resolved(F.col("t"), F.col("a")).alias("b")).where("b is not null").distinct())
    edges = cut(edges.select(address_of(F.col("a")).alias("a"), address_of(F.col("b")).alias("b")))
    nodes = edges.select(F.md5("a").alias("a"), F.md5("b").alias("b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("address")).withColumns({"host": host_of(F.col("address")), "path": path_of(F.col("address"))})
    ends = ends.select(F.md5("address").alias("node"), rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("said"))
    parts = cut(connected_components(nodes))
    said = ends.where("said is not null").distinct().join(parts, "node").groupBy("component")
    blocked = said.agg(F.bool_or(F.col("said") == "allow").alias("allowed"), F.bool_or(F.col("said") == "block").alias("blocked")).where("blocked and not allowed")
    verdicts = parts.join(blocked, "component").select(F.col("node").alias("__node"), F.lit("block").alias("__said"))
    # Rows without an address are dealt out by all that they hold, as no verdict waits for them.
    rows = pages.drop(*new)
    none = F.concat(F.lit("none "), F.xxhash64(*rows.columns))
    rows = rows.withColumns({"host": host_of(address), "path": path_of(address), "__none": F.when(~F.coalesce(address.contains("://"), F.lit(False)), none)})
    rows = rows.withColumns({"__own": rule_of(F.col("host"), F.col("path"), rules), "__node": F.coalesce(F.md5(address_of(address, F.col("host"), F.col("path"))), "__none")})
    return (
        rows.join(verdicts, "__node", "left")
        .withColumns({"rule": F.col("__own.rule"), "verdict": F.coalesce("__own.verdict", "__said", F.lit("allow"))})
        .drop("__own", "__node", "__said", "__none")
    )
