"""RSS 2.0 and Atom documents as rows, one an entry, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.dates import written_date
from tidemark.functions.markup import cleaned

ENTRY = "source string, pos int, title string, url string, dated string, summary string, error string"
LEAST_TITLE = 10  # characters


def plain(tag) -> str:
    return str(tag).rpartition("}")[2].rpartition(":")[2].lower()


def trees(body: str) -> Iterator:
    """Entries of a document as elements; of a broken one those that are whole in themselves."""
    import re
    from xml.etree import ElementTree

    try:
        yield from (e for e in ElementTree.fromstring(body.encode()).iter() if plain(e.tag) in ("item", "entry"))
        return
    except ElementTree.ParseError:
        pass
    for whole in re.findall(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)\s*>", body):
        loose = re.sub(r"(?i)&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-f]+);)", "&amp;", re.sub(r"(</?)[\w.-]+:(?=[\w.-])", r"\1", whole))
        loose = re.sub(r"\s[\w.-]+:([\w.-]+\s*=)", r" \1", loose)
        try:
            yield ElementTree.fromstring(loose.encode())
        except ElementTree.ParseError:
            continue


def entry(element, base: str) -> dict:
    """First title, link, date and summary of an entry by their chains of fallbacks."""
    texts: dict[str, str] = {}
    links: list[tuple[str, str]] = []
    for child in element:
        name, text = plain(child.tag), "".join(child.itertext()).strip()
        if name == "link" and child.get("href"):
            links.append((child.get("rel") or "alternate", child.get("href").strip()))
        elif text:
            texts.setdefault(name, text)
    marked = texts.get("guid") or texts.get("id") or ""
    own = texts.get("link") or next((h for r, h in links if r == "alternate"), "") or (links[0][1] if links else "")
    url = own or (marked if marked.lower().startswith(("http://", "https://")) else "")
    dated = next((texts[k] for k in ("pubdate", "published", "date", "updated") if k in texts), None)
    summary = next((texts[k] for k in ("description", "summary", "encoded", "content") if k in texts), None)
    return {"title": cleaned(texts.get("title")), "url": urljoin(base, url) if url else None, "dated": dated, "summary": cleaned(summary) or None}


def entries(feeds: DataFrame) -> DataFrame:
    """`ENTRY` of feeds (source, url, body). A document that is broken and has no whole entry gives one row with pos -1 and an error; so does a null one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for batch in batches:
            rows = []
            for source, base, body in zip(batch["source"], batch["url"], batch["body"], strict=True):
                own = [entry(e, base or "") for e in trees(body or "")]
                rows += [{"source": source, "pos": k, **e, "error": None} for k, e in enumerate(own)]
                if not own and not (body or "").rstrip().lower().endswith(("</rss>", "</feed>", "</rdf:rdf>")):
                    rows.append({**dict.fromkeys(names), "source": source, "pos": -1, "error": "no entries in a broken document"})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return feeds.select("source", "url", "body").mapInPandas(read, ENTRY)


def scan(feeds: DataFrame, include: str | None = None, limit: int | None = None) -> DataFrame:
    """Valid entries: a web link, a title of ten characters; `include` filters links before the first `limit` of a source are taken (its own cap)."""
    rows = entries(feeds).where((F.col("pos") >= 0) & urls.scheme(F.col("url")).isin("http", "https") & (F.length("title") >= LEAST_TITLE))
    if include:
        rows = rows.where(F.col("url").rlike(include))
    if limit is not None:
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).where(F.col("_nth") <= limit).drop("_nth")
    live: Column = urls.looks_live(F.col("url"), F.col("title"))
    return rows.select("source", "pos", "title", urls.normalised(F.col("url")).alias("url"), written_date(F.col("dated")).alias("published_at"), "summary", live.alias("is_live"))


def failures(feeds: DataFrame) -> DataFrame:
    """(source, error) of documents without an entry that could be read."""
    return entries(feeds).where("pos < 0").select("source", "error")
