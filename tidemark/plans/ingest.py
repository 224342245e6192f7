"""Named queries over feeds, pages and stored batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, markup
from tidemark.operators import history, upsert
from tidemark.plans import sql
from tidemark.plans.queries import query
from tidemark.sinks import outputs
from tidemark.sources import feeds, listings
from tidemark.sources.views import headlines, table, versions

H, V, R = sql.HEADLINES, sql.VERSIONS, sql.REVISIONS
ITEMS = 50  # entries of a feed
CLEAN = r"trim(regexp_replace(regexp_replace(title, '<[^>]*>', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g'))"


def escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(reference))
    return out


def feed_documents(spark, sf_dir) -> DataFrame:
    """source, url, body: readings written as RSS, fifty a document."""
    date = F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>"), escaped(F.col("url")), F.lit("</link><guid>"), F.col("id").cast("string"), F.lit("</guid><pubDate>"), date, F.lit("</pubDate></item>"))
    rows = headlines(spark, sf_dir).select("source", F.floor(F.col("id") / ITEMS).alias("part"), F.struct("id", item.alias("item")).alias("x")).groupBy("source", "part").agg(F.array_sort(F.collect_list("x")).alias("x"))  # fifty at most
    body = F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.transform("x", lambda x: x["item"]), ""), F.lit("</channel></rss>"))
    return rows.select("source", F.concat(F.lit("https://"), "source", F.lit(".example.co.uk/feed")).alias("url"), body.alias("body"))


@query(f"with {H}, c as (select *, {CLEAN} as clean from headlines) select source, clean as title, {sql.normalised('url')} as url, fetched_at as published_at from c where length(clean) >= 10")
def feed_scan(spark, sf_dir):
    """Entries of RSS documents, their dates and links read back."""
    return feeds.scan(feed_documents(spark, sf_dir)).select("source", "title", "url", "published_at")


@query()
def page_anchors(spark, sf_dir):
    """Every link of each page with its surroundings and how far its address looks like an article's."""
    return listings.anchors(table(spark, sf_dir, "pages")).withColumn("score", listings.url_score(F.col("href")))


@query()
def page_links(spark, sf_dir):
    """Links of each page to articles of its own site; tests use pages worked by hand."""
    return listings.front_page(table(spark, sf_dir, "pages"))


@query()
def page_feeds(spark, sf_dir):
    return listings.feed_links(table(spark, sf_dir, "pages"))


@query()
def page_articles_stated(spark, sf_dir):
    return listings.stated_articles(table(spark, sf_dir, "pages"))


@query()
def page_quality(spark, sf_dir):
    return listings.page_quality(listings.front_page(table(spark, sf_dir, "pages")))


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads after the first of two batches, both batches."""
    rows = headlines(spark, sf_dir)
    first, second = rows.where("fetched_at < timestamp'2024-01-11 00:00:00'"), rows.where("fetched_at >= timestamp'2024-01-11 00:00:00'")
    return upsert.feed_heads(spark.createDataFrame([], upsert.HEAD), first), first, second


@query(f"""with {V}, h as (select v.*, h.published_at, h.summary from versions v join headlines h using (id))
 select article_key as url, min_by(source, id) as source, max_by(title, id) as title, arg_max_null(summary, id) as summary, arg_min_null(published_at, id) as published_at, min(seen_at) as fetched_at, min(id) as first_id, bool_or(is_live) as is_live, 'rss' as methods from h group by article_key""")
def stored_heads(spark, sf_dir):
    """Articles after two batches, the second onto the first."""
    heads, _, second = halves(spark, sf_dir)
    return upsert.feed_heads(heads, second).drop("content_key").withColumn("methods", F.array_join("methods", ","))


@query(f"with {V} select article_key as url, title, min(seen_at) as seen_at, min(id) as first_id from versions group by all")
def stored_revisions(spark, sf_dir):
    """Wordings after two batches."""
    _, first, second = halves(spark, sf_dir)
    return upsert.feed_revisions(upsert.feed_revisions(spark.createDataFrame([], upsert.REVISION), first), second)


@query(f"""with {V}, s as (select *, lag(title) over w as was, lag(content_key) over w as was_key from versions window w as (partition by article_key order by id)), b as (select * from s where seen_at >= timestamp '2024-01-11 00:00:00')
 select count(*) as readings, count(*) filter (was is null) as new, count(*) filter (was <> title) as retitled, count(*) filter (was <> title and was_key = content_key) as minor, count(distinct article_key) filter (is_live) as live from b""")
def stored_outcome(spark, sf_dir):
    """What storing the second batch changed."""
    heads, _, second = halves(spark, sf_dir)
    return upsert.outcome(heads, second)


@query(f"with {R} select id, to_json({{'source': source, 'seen_at': strftime(seen_at, '%Y-%m-%dT%H:%M:%SZ'), 'title': title, 'prev_title': prev_title}}) as j from revisions")
def revisions_json(spark, sf_dir):
    rows = history.revisions(versions(spark, sf_dir))
    return rows.select("id", outputs.as_json(rows.select("source", "seen_at", "title", "prev_title")).alias("j"))


@query(f"with {H} select source, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') as published_at, title, url, summary, is_live::int as is_live from headlines")
def headlines_csv(spark, sf_dir):
    """The columns of the CSV output."""
    return outputs.machine(headlines(spark, sf_dir).select("source", "published_at", "title", "url", "summary", "is_live"))


@query(f"with {H} select id, rtrim(rpad(case when length(source) > 6 then left(source, 5) || '…' else source end, 6, ' ') || '  ' || rpad(case when length(title) > 30 then left(title, 29) || '…' else title end, 30, ' '), ' ') as line from headlines")
def headlines_table(spark, sf_dir):
    return outputs.fixed_width(headlines(spark, sf_dir), {"source": 6, "title": 30}, keep=("id",))


@query(f"with {H} select id, case when length(title) <= 40 then title else rtrim(regexp_replace(left(title, 40), '\\s+\\S*$', '')) || '…' end as short from headlines")
def titles_shortened(spark, sf_dir):
    return headlines(spark, sf_dir).select("id", dates.shortened(F.col("title"), 40).alias("short"))


@query()
def rewrite_diffs(spark, sf_dir):
    """Runs of words kept, replaced, gone and new in each rewrite."""
    rows = history.revisions(versions(spark, sf_dir)).where("prev_title is not null")
    return rows.select("id", F.to_json(markup.word_diff("prev_title", "title")).alias("diff"))
