"""URL filters: rules by host and path, carried over to redirect-equivalent urls.

Pages name other addresses of the same document: a canonical link or an
immediate redirect (``meta refresh``).  Connected components over these edges
are aliases of each other.  A url that a rule fits follows its longest rule;
any other url is allowed if a rule allows one of its aliases, blocked if a
rule blocks one (and none allows), and allowed otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import ship
from helpdeck.llm.components import components

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages without one of these words name no other address.
NAMES = r"(?i)canonical|refresh"
PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), _UP, _LOW)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def address(url: Column) -> Column:
    """A url as a node: without its fragment, scheme and host lower-cased."""
    plain = F.regexp_extract(url, r"^([^#]*)", 1)
    head = F.regexp_extract(plain, r"^([^/?]*://[^/?]*)", 1)
    return F.concat(F.translate(head, _UP, _LOW), F.substring(plain, F.char_length(head) + 1, F.char_length(plain)))


class _Links(HTMLParser):
    """Canonical link, refresh and base of a page; comments and the contents of scripts and styles are no tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)  # values of attributes come with their references decoded
        self.base, self.targets = None, {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and self.base is None and have.get("href"):
            self.base = have["href"].strip()
        elif tag == "link" and "canonical" in have.get("rel", "").lower().split():
            self.targets.setdefault("canonical", have.get("href", ""))
        elif tag == "meta" and have.get("http-equiv", "").strip().lower() == "refresh":
            _, _, target = have.get("content", "").partition(";")
            name, _, target = target.partition("=")
            if name.strip().lower() == "url":
                self.targets.setdefault("refresh", target.strip().strip("'\""))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def targets(url: str, html: str) -> list[str]:
    """The addresses that a page's first canonical link and first refresh name, against its base and url."""
    if "://" not in url:
        return []
    page = _Links()
    page.feed(html)
    page.close()
    out = []
    for target in page.targets.values():
        try:
            named = urljoin(urljoin(url, page.base or ""), target.strip()) if target.strip() else ""
        except ValueError:  # no address, like http://[
            continue
        if "://" in named:
            out.append(named)
    return out


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: the page's address and the one that its canonical link or refresh names."""
    some = pages.where(F.col("url").contains("://") & F.col("html").rlike(NAMES)).select("url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, t) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in targets(u, h)]
            if pairs:
                yield pa.RecordBatch.from_pydict({"url": [p[0] for p in pairs], "t": [p[1] for p in pairs]})

    ship(pages.sparkSession)
    d = some.mapInArrow(run, "url string, t string")
    return d.select(address(F.col("url")).alias("a"), address(F.col("t")).alias("b")).where("a <> b")


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct urls that a rule fits, with the longest: ``url, rule, verdict``.

    ``rules``: ``verdict, host, path``.  A url meets the rules of its host's
    suffixes (as many as the host has labels) by equality, then the path's start decides; the longest
    ``host + path`` wins, then the longer host, then ``allow``.
    """
    d = urls.select(F.col(url_col).alias("url")).distinct().select("url", host(F.col("url")).alias("_h"), path(F.col("url")).alias("_p"))
    labels = F.split("_h", r"\.")
    d = d.where("_h <> ''").withColumn("_s", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(F.split("_h", r"\."), k, F.size(labels)), "."))))
    r = rules.select(F.col("verdict").alias("_v"), F.col("host").alias("_rh"), F.col("path").alias("_rp"))
    hit = d.join(r, F.col("_s") == F.col("_rh")).where(F.col("_p").startswith(F.col("_rp")))
    rank = F.struct(F.char_length(F.concat("_rh", "_rp")).alias("n"), F.char_length("_rh").alias("h"), (F.col("_v") == "allow").alias("w"),
                    F.concat("_rh", "_rp").alias("rule"), F.col("_v").alias("verdict"))
    return hit.groupBy("url").agg(F.max(rank).alias("m")).select("url", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` per row of ``pages`` (``page_id, url, html``).

    A null url, or one without ``://``, has an empty host and path, meets no
    rule and has no aliases: it is allowed.  Null pages name no address.
    ``component`` is the smallest address of the url's aliases.  Repeated rows
    stay; an empty table gives no rows; other columns are ignored.
    """
    p = pages.select("page_id", "url", "html")
    comp = components(alias_edges(p), "a", "b")
    own = matched(p.where(F.col("url").isNotNull()), rules)
    # what the rules say of the members of a component, whether they are pages or only named
    members = comp.join(matched(comp.select(F.col("node").alias("url")), rules), F.col("node") == F.col("url"), "left")
    said = members.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    alias = comp.join(said.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c")).select(
        F.col("node"), "component", "allowed", "blocked")
    d = p.select("page_id", "url", address(F.col("url")).alias("_a"))
    d = d.join(own.withColumnRenamed("url", "_u"), F.col("url") == F.col("_u"), "left").join(alias, F.col("_a") == F.col("node"), "left")
    spread = (F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow"))
    return d.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule",
                    F.coalesce("verdict", spread).alias("verdict"), F.coalesce("component", "_a").alias("component"))
