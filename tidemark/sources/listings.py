"""Links, feed addresses and structured articles of HTML pages as rows, parsed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.markup import cleaned
from tidemark.functions.text import title_key

# Elements without an end tag, elements around a page's own text, headings, link schemes that lead nowhere, article types, nested keys.
VOID = "area base br col embed hr img input link meta source track wbr".split()
CHROME = "nav footer aside header form".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
NOWHERE = ("#", "javascript:", "mailto:", "tel:", "data:")
TYPES = "Article NewsArticle ReportageNewsArticle AnalysisNewsArticle OpinionNewsArticle BackgroundNewsArticle LiveBlogPosting BlogPosting VideoObject ListItem".split()
NESTED = "@graph itemListElement mainEntity hasPart item".split()
DEEP = 14  # ancestors that are asked

LINK = "page_id long, pos int, href string, text string, in_article boolean, in_heading boolean, chrome boolean"
FEED = "page_id long, pos int, href string"
STATED = "page_id long, pos int, kind string, url string, title string, dated string"


class Reader(HTMLParser):
    """One pass over a page: anchors with their surroundings, feed links, JSON-LD bodies, base and canonical address."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.anchors: list[dict] = []
        self.feeds: list[str] = []
        self.scripts: list[str] = []
        self.base = self.canonical = None
        self.inside: dict | None = None
        self.script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "a":
            near = self.open[-DEEP:]
            self.inside = {"href": at.get("href") or at.get("data-href") or "", "words": [], "in_article": "article" in near, "in_heading": any(t in HEADINGS for t in near), "chrome": any(t in CHROME for t in near)}
            self.anchors.append(self.inside)
        elif tag in HEADINGS and self.inside is not None:
            self.inside["in_heading"] = True
        elif tag == "base":
            self.base = self.base or at.get("href")
        elif tag == "link":
            rel, kind = at.get("rel", "").lower().split(), at.get("type", "").lower()
            if "alternate" in rel and any(x in kind for x in ("rss", "atom", "feed")) and at.get("href"):
                self.feeds.append(at["href"].strip())
            if "canonical" in rel:
                self.canonical = self.canonical or at.get("href")
        elif tag == "script" and at.get("type", "").lower().startswith("application/ld+json"):
            self.script = []
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag == "a":
            self.inside = None
        elif tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.inside is not None and not (self.open and self.open[-1] in ("script", "style")):
            self.inside["words"].append(data)


def read(html: str | None) -> Reader:
    page = Reader()
    page.feed(html or "")
    page.close()
    return page


def stated(body: str) -> Iterator[dict]:
    """Article objects of a JSON-LD body, those nested under lists and graphs too; nothing of a body that is no JSON."""
    import json

    try:
        todo = [json.loads(body)]
    except ValueError:
        return
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = node + todo
        elif isinstance(node, dict):
            kinds = node.get("@type") or []
            kind = next((k for k in ([kinds] if isinstance(kinds, str) else kinds) if k in TYPES), None)
            place = node.get("url") or node.get("mainEntityOfPage") or node.get("@id")
            place = place.get("@id") if isinstance(place, dict) else place
            title = node.get("headline") or node.get("name")
            if kind and isinstance(place, str) and isinstance(title, str):
                dated = node.get("datePublished")
                yield {"kind": kind, "url": place, "title": cleaned(title), "dated": dated if isinstance(dated, str) else None}
            todo = [node[k] for k in NESTED if k in node] + todo


def parsed(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": i, "pos": k, **row} for i, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True) for k, row in enumerate(rows_of(read(html), url or ""))]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def resolved(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return None


def anchors(pages: DataFrame) -> DataFrame:
    """`LINK`: every anchor that leads somewhere, in page order, its address resolved."""

    def rows(page: Reader, url: str) -> Iterator[dict]:
        base = resolved(url, page.base or "") or url
        for a in page.anchors:
            to = a["href"].strip()
            if to and not to.lower().startswith(NOWHERE) and (href := resolved(base, to)):
                yield {"href": href, "text": cleaned(" ".join(a["words"])), "in_article": a["in_article"], "in_heading": a["in_heading"], "chrome": a["chrome"]}

    return parsed(pages, rows, LINK)


def feed_links(pages: DataFrame) -> DataFrame:
    """`FEED`: advertised feeds in page order, each address once a page."""
    return parsed(pages, lambda page, url: [{"href": h} for h in dict.fromkeys(resolved(url, f) for f in page.feeds) if h], FEED)


def stated_articles(pages: DataFrame) -> DataFrame:
    """`STATED`: articles that pages state as JSON-LD."""
    rows = lambda page, url: [{**o, "url": resolved(url, o["url"])} for body in page.scripts for o in stated(body)]
    return parsed(pages, rows, STATED)


def url_score(url: Column) -> Column:
    """-1 for the front page and one-segment sections; else 2 for a slug of three words, 2 for a date or number, 1 for a file's ending, 1 for depth."""
    path = F.regexp_replace(urls.path(url), "/+$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), segments), -1), F.lit(""))
    slug = F.size(F.filter(F.split(F.regexp_replace(last, r"\.[a-z]+$", ""), "[-_]+"), lambda w: w.rlike("[A-Za-z]"))) >= 3
    marked = path.rlike(r"/(19|20)[0-9]{2}[/-][0-9]{1,2}|[0-9]{5,}")
    points = F.when(slug, 2).otherwise(0) + F.when(marked, 2).otherwise(0) + F.when(path.rlike(r"(?i)\.(html?|php|aspx?)$"), 1).otherwise(0) + F.when(F.size(segments) >= 3, 1).otherwise(0)
    return F.when((F.size(segments) == 0) | ((F.size(segments) == 1) & ~slug & ~marked), -1).otherwise(points)


def front_page(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, title, score): links of a page to articles of its own site, each link and title once.

    A link counts with a text of 10 to 250 characters and three words outside menus and
    footers, if its address looks like an article's (2 points) and the text has four
    words, or it stands in an article or heading (2 points each) and its address has a point.
    """
    own = pages.select("page_id", urls.site(urls.host(F.col("url"))).alias("_site"))
    words = F.size(F.split("text", " "))
    context = F.when(F.col("in_article"), 2).otherwise(0) + F.when(F.col("in_heading"), 2).otherwise(0)
    rows = anchors(pages).where(~F.col("chrome") & F.length("text").between(10, 250) & (words >= 3) & urls.scheme(F.col("href")).isin("http", "https"))
    rows = rows.withColumn("score", url_score(F.col("href"))).where(((F.col("score") >= 2) & (words >= 4)) | ((context >= 2) & (F.col("score") >= 1)))
    rows = rows.join(own, "page_id").where(urls.site(urls.host(F.col("href"))) == F.col("_site"))
    rows = rows.select("page_id", "pos", urls.normalised(F.col("href")).alias("url"), F.col("text").alias("title"), "score")
    for key in (urls.match_key(F.col("url")), title_key(F.col("title"))):
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("page_id", key).orderBy("pos"))).where("_nth = 1").drop("_nth")
    return rows


def page_quality(found: DataFrame) -> DataFrame:
    """By page: links, distinct ones, mean length of titles."""
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("url").alias("distinct_links"), F.round(F.avg(F.length("title")), 6).alias("mean_title"))
