"""Allow and block rules for urls, whose decisions also reach the aliases that redirects and canonical links name."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import connected_components
from pairloom.session import cut_lineage

#: A rule: allow or block, the host (itself and its subdomains), the beginning of the path.
Rule = tuple[str, str, str]

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
TAGS = re.compile(r"<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
ATTRIBUTES = re.compile(r"([a-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
REFRESH = re.compile(r"\s*[0-9.]+\s*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']+?)[\"']?\s*\Z", re.I | re.S)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """One spelling of a url: scheme and host in lower case, http as https, no default port, no fragment, ``/`` for an empty path."""
    host = F.regexp_replace(url_host(url), ":(80|443)?$", "")
    scheme = F.lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1))
    path = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    asked = F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), host, path, asked)).otherwise(url)


def page_links(body: str | None, url: str | None) -> list[str]:
    """Urls that a page names as its own: canonical links and refresh targets, resolved against the page and its base."""
    found, base = [], url or ""
    for tag in TAGS.finditer(HIDDEN.sub(" ", body or "")):
        kind = tag[1].lower()
        at = {}
        for name, *values in ATTRIBUTES.findall(tag[2]):
            at.setdefault(name.lower(), entities.unescape(next((v for v in values if v), "")).strip())
        target = None
        if kind == "base" and at.get("href"):
            base = _resolve(url or "", at["href"]) or base
        elif kind == "link" and "canonical" in at.get("rel", "").lower().split():
            target = at.get("href")
        elif kind == "meta" and at.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.match(at.get("content", ""))):
            target = m[1].strip()
        if target and (to := _resolve(base, target)):
            found.append(to)
    return found


def _resolve(base: str, target: str) -> str | None:
    try:
        to = urljoin(base, target)
    except ValueError:  # a target that is no url names no alias
        return None
    return to if "://" in to else None


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of a page and of what it redirects to or calls canonical. Only pages with such a tag leave the JVM."""
    def each(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                cut = batch.slice(start, 256)
                rows = [(u, to) for u, body in zip(cut.column("url").to_pylist(), cut.column("html")) for to in page_links(body.as_py(), u)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["a", "b"])

    likely = pages.where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh")).select("url", "html")
    return likely.mapInArrow(each, "a string, b string").select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")).where("a <> b").distinct()


def rules_table(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = [(verdict, host.lower(), path, host.lower() + path) for verdict, host, path in rules]
    return pages.sparkSession.createDataFrame(rows, "decision string, rule_host string, rule_path string, rule string")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``rule`` and ``decision`` of the longest rule that fits; of equally long ones an allowing one.

    Only distinct hosts meet the rules, by equality on each of their suffixes, so neither side is compared with all of the other. What
    fits a host comes back as one list, at most the rules on its chain of domains; the host table's size is known before the join.
    """
    hosts = urls.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    fit = hosts.select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("o"), "decision", "rule", "rule_path"))).alias("_rules"))
    best = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r.getField("rule_path"))), F.lit(0))
    return urls.join(cut_lineage(fit, "host-rules"), "host", "left").withColumn("_best", best).select(
        *urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.decision").alias("decision"))


def alias_decisions(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, alias): allow if a rule allows any url of the address's component, else block if one blocks any; without a rule, no row.

    Components are found by distributed star rounds over digests of the addresses (16 bytes). The decision of a component is an aggregate
    that combines map-side, so a url that half the web redirects to is no hot task.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("address")).distinct().withColumn("node", F.unhex(F.md5("address")))
    nodes = nodes.select("address", "node", url_host(F.col("address")).alias("host"), url_path(F.col("address")).alias("path"))
    decided = fitting_rules(nodes, rules).select("address", "node", "decision")
    linked = connected_components(edges.select(F.unhex(F.md5("a")).alias("u"), F.unhex(F.md5("b")).alias("v")))
    members = cut_lineage(decided.join(linked, "node").select("address", "label", "decision"), "aliases")
    verdicts = members.where("decision is not null").groupBy("label").agg(F.min("decision").alias("alias"))  # allow sorts before block
    return members.join(verdicts, "label").select("address", "alias")


def judge_urls(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A url's own rule decides. Without one, the decisions of its aliases do: the urls it is linked to, over any number of steps, by
    redirects (meta refresh) and canonical links; an explicit allow among them goes before a block. All others are allowed. Null urls and
    urls without ``://`` have an empty host and path, fit no rule and are allowed. Null or empty html has no links; links inside comments,
    scripts and styles are none. Repeated rows and null ids stay rows. No pages, no rows; other columns are ignored.
    """
    table = rules_table(pages, rules)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = cut_lineage(alias_edges(pages), "alias-edges")
    aliases = cut_lineage(alias_decisions(edges, table), "alias-decisions")
    own = fitting_rules(pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                                     address(F.col("url")).alias("address")), table)
    return own.join(aliases, "address", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decision", "alias", F.lit("allow")).alias("verdict"))
