"""Named queries over stories, twins, folds, alerts and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.text import title_key
from tidemark.operators import alerts, stories, twins
from tidemark.plans import sql
from tidemark.plans.queries import LOG, query
from tidemark.sources.views import fetch_log, headlines, table

H = sql.HEADLINES

WEIGHTS = f"""w0 as (select id, unnest({sql.tokens('title')}) as term, 1.0::double as w from headlines union all
  select id, unnest({sql.tokens("array_to_string([x for x in regexp_split_to_array(coalesce(summary, ''), '[ \\t\\n\\x0b\\f\\r]+') if x <> ''][1:30], ' ')")}), 0.35::double from headlines),
w1 as (select id, term, sum(w) as tf from w0 group by all), df as (select term, count(*) as df from w1 group by term),
w2 as (select id, term, tf * (1 + ln((1 + (select count(*) from headlines)) / (1 + df))) as raw from w1 join df using (term)),
weights as (select id, term, raw / sqrt(sum(raw * raw) over (partition by id)) as weight from w2)"""


@query(f"with {H}, {WEIGHTS} select id, term, round(weight, 6) as weight from (select *, row_number() over (partition by id order by round(weight, 9) desc, term) as k from weights) where k <= 3")
def tfidf_top_terms(spark, sf_dir):
    """The three heaviest words of each reading."""
    order = Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "term")
    rows = stories.weights(headlines(spark, sf_dir)).withColumn("k", F.row_number().over(order)).where("k <= 3")
    return rows.select("id", "term", F.round("weight", 6).alias("weight"))


def clustered(spark, sf_dir):
    rows = headlines(spark, sf_dir).withColumn("at", F.coalesce("published_at", "fetched_at"))
    return rows.join(stories.cluster(rows), "id")


@query()
def story_clusters(spark, sf_dir):
    """The story of each reading and whether it names it; a test compares with one ordered pass over all."""
    return clustered(spark, sf_dir).select("id", "story", "is_lead")


@query()
def story_list(spark, sf_dir):
    """Stories of two outlets or more: reach, first and last time, outlets in order of their first report, tags by frequency."""
    rows = clustered(spark, sf_dir)
    outlets = rows.groupBy("story", "source").agg(F.min(F.struct("at", "id")).alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.max(F.when(F.col("is_lead"), F.col("title"))).alias("title"))
    whole = outlets.groupBy("story").agg(
        F.count("*").alias("reach"), F.sum("n").alias("readings"), F.min("first.at").alias("first_seen"), F.max("last").alias("last_seen"), F.max("title").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]), ",").alias("sources"),
    )
    tags = rows.groupBy("story", "tag").agg(F.count("*").alias("n")).groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    return whole.where("reach >= 2").join(tags, "story").orderBy(F.desc("reach"), F.desc("last_seen"), "story")


KEYS = f"""k0 as (select id, source, title, fetched_at, {sql.normalised('url')} as whole from headlines),
k1 as (select *, {sql.match_key('whole')} as by_link, {sql.title_key('title')} as by_title from k0),
k2 as (select *, split_part({sql.site("split_part(by_link, '/', 1)")}, '.', 1) || '/' || regexp_replace(by_link, '^[^/]*/', '') as by_brand from k1)"""


@query(f"""with {H}, {KEYS}, p as (select a.id, a.fetched_at, b.id as twin, b.fetched_at as seen, case when a.by_link = b.by_link then 1 when a.by_brand = b.by_brand then 2 else 3 end as way
  from k2 a join k2 b on lower(a.source) = lower(b.source) and b.id < a.id and b.fetched_at >= a.fetched_at - interval 7 day and (a.by_link = b.by_link or a.by_brand = b.by_brand or a.by_title = b.by_title))
 select id, twin, way from (select *, row_number() over (partition by id order by way, seen desc, twin desc) as k from p) where k = 1""")
def resolve_twins(spark, sf_dir):
    """For each reading the earlier one of its source within seven days that is the same article: by link, brand and path, or title."""
    return twins.earlier(headlines(spark, sf_dir)).select("id", "twin", "way")


@query(f"""with {H}, {KEYS}, r as (select k2.*, h.published_at, h.is_live, row_number() over (partition by whole order by k2.fetched_at, k2.id) as nth from k2 join headlines h using (id))
 select whole as url, count(*) as readings, count(distinct by_title) as titles, min(id) filter (nth = 1) as keeper, min(fetched_at) as first_fetched, bool_or(is_live) as is_live,
 coalesce(min(published_at) filter (nth = 1), min(published_at)) as published_at, arg_max(title, (fetched_at, id)) as title from r group by whole""")
def articles_folded(spark, sf_dir):
    """Readings folded by normalised link: the oldest is kept, its own date else the least, live if any was, the latest title."""
    return twins.folded(headlines(spark, sf_dir)).withColumnRenamed("whole", "url")


@query(f"""with {LOG}, h as (select source, date_trunc('hour', started_at) as hour, count(*) filter (status = 'error') as failed, count(*) as n from log group by all)
 select source, hour, case when failed = n then 'fail' when failed > 0 then 'warn' else 'ok' end as level from h""")
def hourly_levels(spark, sf_dir):
    return levels(spark, sf_dir)


def levels(spark, sf_dir):
    failed = F.count_if(F.col("status") == "error")
    rows = fetch_log(spark, sf_dir).groupBy("source", F.date_trunc("hour", "started_at").alias("hour")).agg(failed.alias("failed"), F.count("*").alias("n"))
    level = F.when(F.col("failed") == F.col("n"), "fail").when(F.col("failed") > 0, "warn").otherwise("ok")
    return rows.select("source", "hour", level.alias("level"))


@query()
def alert_events(spark, sf_dir):
    """Alerts, reminders and recoveries of each source's checks; a test compares with cases worked by hand."""
    return alerts.events(levels(spark, sf_dir).select(F.col("source").alias("check"), F.col("hour").alias("at"), "level"))


@query(f"""with u as (select distinct {sql.part('url', 'host')} as host, min(page_id) over (partition by {sql.part('url', 'host')}) as first from pages), n as (select *, row_number() over (order by first) - 1 as k, count(*) over () as n from u)
 select host from n where k in (0, round_even((n - 1) / 2.0, 0)::bigint, n - 1)""")
def probe_hosts(spark, sf_dir):
    """Three hosts spread evenly over all in order of their first link."""
    rows = table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("first"))
    order = rows.withColumn("k", F.row_number().over(Window.orderBy("first")) - 1)  # one row a host
    last = rows.agg((F.count("*") - 1).alias("last"))
    return order.join(F.broadcast(last)).where((F.col("k") == 0) | (F.col("k") == F.col("last")) | (F.col("k") == F.bround(F.col("last") / 2))).select("host")


@query(f"with {H}, {KEYS} select by_title, count(*) as n, count(distinct lower(source)) as outlets from k2 where by_title <> '' group by by_title having count(*) > 1")
def repeated_titles(spark, sf_dir):
    """Titles that differ by case, marks and spaces at most, and how many outlets have them."""
    rows = headlines(spark, sf_dir).select(title_key(F.col("title")).alias("by_title"), F.lower("source").alias("s")).where("by_title <> ''")
    return rows.groupBy("by_title", "s").agg(F.count("*").alias("n")).groupBy("by_title").agg(F.sum("n").alias("n"), F.count("*").alias("outlets")).where("n > 1")
