from datetime import datetime, timedelta
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, markup
from tidemark.operators import upsert
from tidemark.sinks import outputs
from tidemark.sources import feeds, listings

T = datetime(2024, 1, 1)

MAIL = ["Mon, 01 Jan 2024 10:20:30 +0200", "1 Jan 2024 10:20:30 GMT", "Tue, 2 Jan 2024 03:04:05 EST", "Fri, 05 Apr 2024 23:59:00 -0730"]
DATES = [
    ("2024-01-05T10:00:00Z", datetime(2024, 1, 5, 10)), ("2024-01-05T10:00:00+02:00", datetime(2024, 1, 5, 8)), ("2024-01-05T10:00:00+0200", datetime(2024, 1, 5, 8)), ("2024-01-05 10:00", datetime(2024, 1, 5, 10)),
    ("2024-01-05", datetime(2024, 1, 5)), ("5 January 2024", datetime(2024, 1, 5)), ("5 Jan 2024", datetime(2024, 1, 5)), ("October 5, 2024", datetime(2024, 10, 5)), ("Oct 5, 2024", datetime(2024, 10, 5)),
    ("2024", None), ("yesterday", None), ("", None), (None, None), ("2024-13-40", None),
] + [(m, parsedate_to_datetime(m).astimezone(__import__("datetime").UTC).replace(tzinfo=None)) for m in MAIL]


def test_dates(spark):
    rows = spark.createDataFrame(DATES, "x string, want timestamp").select("x", "want", dates.written_date(F.col("x")).alias("got")).collect()
    assert [(r["x"], r["got"]) for r in rows] == [(r["x"], r["want"]) for r in rows]


def test_spans_days_and_short_titles(spark):
    rows = spark.createDataFrame([("90s",), ("1.5h",), ("2w",), ("1y",), ("h",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(dates.span_seconds(F.col("x"))).collect()] == [90.0, 5400.0, 1209600.0, None, None, None, None]
    start, end = dates.day_bounds(F.lit("2024-03-31"), "Europe/London")
    assert tuple(spark.range(1).select(start, end).first()) == (datetime(2024, 3, 31), datetime(2024, 3, 31, 23))
    assert spark.range(1).select(dates.shortened(F.lit("one two three"), 9)).first()[0] == "one two…"


def test_markup(spark):
    rows = spark.createDataFrame([("<b>Fish &amp;amp; chips</b>\xa0now​",), ("a\x07b",), (None,), ("",)], "x string")
    assert [r[0] for r in rows.select(markup.clean_text("x")).collect()] == ["Fish & chips now", "ab", "", ""]
    diff = spark.createDataFrame([("rain in the north", "sun in the far north"), (None, "x")], "a string, b string").select(markup.word_diff("a", "b").alias("d")).collect()
    assert [tuple(x) for x in diff[0]["d"]] == [("replace", "rain", "sun"), ("equal", "in the", "in the"), ("insert", "", "far"), ("equal", "north", "north")]
    assert [tuple(x) for x in diff[1]["d"]] == [("insert", "", "x")]


RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title>
<item><title>A &lt;i&gt;storm&lt;/i&gt; hits the coast</title><link>/a?utm_source=x</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Rain&lt;/p&gt;</description></item>
<item><title>Short</title><link>https://e.com/b</link></item>
<item><title>Only a guid marks this one</title><guid>https://e.com/c</guid><dc:date>2024-01-02T00:00:00Z</dc:date></item>
<item><title>A guid that is no address</title><guid>77</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title type="html">Votes are counted tonight</title><link rel="self" href="https://e.com/self"/>
<link href="https://e.com/d"/><updated>2024-01-03T00:00:00Z</updated><summary>s</summary></entry></feed>"""
BROKEN = "<rss><channel><item><title>Fish & chips are dear now</title><link>https://e.com/e</link></item><item><title>cut off"


def test_feeds(spark):
    rows = spark.createDataFrame([("rss", "https://e.com/feed", RSS), ("atom", "https://e.com/f", ATOM), ("broken", "https://e.com/f", BROKEN), ("none", "", "<html>no"), ("null", None, None), ("empty", "", "<rss><channel></channel></rss>")], "source string, url string, body string")
    got = {(r["source"], r["pos"]): (r["title"], r["url"], r["published_at"], r["summary"]) for r in feeds.scan(rows).collect()}
    assert got == {
        ("rss", 0): ("A storm hits the coast", "https://e.com/a", datetime(2024, 1, 1, 10), "Rain"),
        ("rss", 2): ("Only a guid marks this one", "https://e.com/c", datetime(2024, 1, 2), None),
        ("atom", 0): ("Votes are counted tonight", "https://e.com/d", datetime(2024, 1, 3), "s"),
        ("broken", 0): ("Fish & chips are dear now", "https://e.com/e", None, None),
    }
    assert {r["source"] for r in feeds.failures(rows).collect()} == {"none", "null"}
    assert [r["pos"] for r in feeds.scan(rows, include="/c$", limit=1).collect()] == [2]


PAGE = """<html><head><link rel="alternate" type="application/rss+xml" href="/rss"><link rel="alternate" type="application/rss+xml" href="/rss"><link rel="stylesheet" href="x.css">
<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"Stated &amp; done","url":"/s/1","datePublished":"2024-01-01"},{"@type":"Person","name":"x","url":"/p"},{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":{"@type":["Article"],"headline":"Nested","@id":"https://e.com/n"}}]}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><a href="/2024/01/05/menu-with-many-words">A menu entry of five words</a></nav>
<article><h2><a href="/news/storm-hits-the-coast?utm_source=a">Storm hits the <b>northern</b> coast</a></h2></article>
<a href="https://m.e.com/news/storm-hits-the-coast">Storm hits the northern coast again</a><a href="/2024/05/06/votes-are-counted">Votes are counted in the capital</a>
<a href="https://other.org/2024/05/06/votes-are-counted-too">Votes are counted somewhere else</a><a href="javascript:x()">This leads to nowhere at all</a><a href="/about">All about this paper here</a><br></body>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, "https://www.e.com/", PAGE), (2, "https://e.com", None), (3, None, "<a href='/x'>"), (4, "https://e.com", "")], "page_id long, url string, html string")
    got = [(r["page_id"], r["url"], r["title"]) for r in listings.front_page(rows).orderBy("page_id", "pos").collect()]
    assert got == [(1, "https://www.e.com/news/storm-hits-the-coast", "Storm hits the northern coast"), (1, "https://www.e.com/2024/05/06/votes-are-counted", "Votes are counted in the capital")]
    assert [(r["page_id"], r["href"]) for r in listings.feed_links(rows).collect()] == [(1, "https://www.e.com/rss")]
    stated = [(r["kind"], r["url"], r["title"], r["dated"]) for r in listings.stated_articles(rows).orderBy("pos").collect()]
    assert stated == [("NewsArticle", "https://www.e.com/s/1", "Stated & done", "2024-01-01"), ("Article", "https://e.com/n", "Nested", None)]
    assert listings.front_page(rows.limit(0)).count() == 0


SCHEMA = "id long, source string, title string, url string, summary string, fetched_at timestamp, published_at timestamp, is_live boolean"


def reading(i, title, url, live=False, published=None):
    return i, "s", title, f"https://e.com/{url}", None, T + timedelta(minutes=i), published, live


BATCH = [reading(k, ["Rain", "rain!", "Sun", "Rain", "Snow"][k * k % 5], "abc"[k % 3], k == 4) for k in range(30)] + [(90, "s", None, "https://e.com/z", None, T, None, None), (91, "s", "No link", None, None, T, None, None)]


def by_hand(rows):
    """One reading after another."""
    heads, wordings, counts = {}, {}, {"new": 0, "retitled": 0, "minor": 0}
    key = lambda t: t.lower().strip("!")
    for i, _, title, url, _, at, _, live in sorted((r for r in rows if r[2] and r[3]), key=lambda r: (r[5], r[0])):
        if url not in heads:
            heads[url], counts["new"] = [title, at, False], counts["new"] + 1
        elif heads[url][0] != title:
            counts["retitled"] += 1
            counts["minor"] += key(heads[url][0]) == key(title)
            heads[url][0] = title
        heads[url][2] |= bool(live)
        wordings.setdefault((url, title), at)
    return {u: tuple(h) for u, h in heads.items()}, wordings, counts


def test_batches_are_stored_as_one_reading_after_another(spark):
    whole = spark.createDataFrame(BATCH, SCHEMA)
    a, b = whole.where("id < 11 or id > 80"), whole.where("id >= 11 and id <= 80")
    none, nothing = spark.createDataFrame([], upsert.HEAD), spark.createDataFrame([], upsert.REVISION)
    once = upsert.feed_heads(none, a)
    twice = upsert.feed_heads(upsert.feed_heads(once, b), b)  # a batch again changes nothing
    heads, wordings, counts = by_hand(BATCH)
    assert {r["url"]: (r["title"], r["fetched_at"], r["is_live"]) for r in twice.collect()} == heads
    stored = upsert.feed_revisions(upsert.feed_revisions(upsert.feed_revisions(nothing, a), b), b)
    assert {(r["url"], r["title"]): r["seen_at"] for r in stored.collect()} == wordings
    told = [upsert.outcome(none, a).first(), upsert.outcome(once, b).first()]
    assert {k: sum(r[k] for r in told) for k in counts} == counts


def test_a_front_page_keeps_titles_and_fills_dates(spark):
    heads = upsert.feed_heads(spark.createDataFrame([], upsert.HEAD), spark.createDataFrame([reading(1, "Rain", "a")], SCHEMA))
    page = spark.createDataFrame([reading(5, "Kicker: rain", "a", True, T), reading(6, "Snow", "b")], SCHEMA)
    got = {r["url"][-1]: (r["title"], r["published_at"], r["is_live"], r["methods"]) for r in upsert.page_heads(heads, page).collect()}
    assert got == {"a": ("Rain", T, True, ["front_page", "rss"]), "b": ("Snow", None, False, ["front_page"])}


def test_outputs_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'A "quoted", title', T, True), (2, None, None, False)], "id long, title string, at timestamp, is_live boolean")
    outputs.write_csv(rows.coalesce(1), f"file://{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.splitlines() == ["id,title,at,is_live", '1,"A ""quoted"", title",2024-01-01T00:00:00Z,1', "2,,,0"]
    outputs.write_json(rows.coalesce(1), f"file://{tmp_path}/json")
    assert next((tmp_path / "json").glob("*.txt")).read_text().splitlines()[1] == '{"id":2,"title":null,"at":null,"is_live":false}'
    assert [r["line"] for r in outputs.fixed_width(rows, {"id": 3, "title": 6}).collect()] == ['1    A "qu…', "2"]
    assert outputs.snapshot(rows, f"file://{tmp_path}/snap")[0] == 2
    assert not (tmp_path / "snap.partial").exists()
    with pytest.raises(FileExistsError):
        outputs.snapshot(rows, f"file://{tmp_path}/snap")
