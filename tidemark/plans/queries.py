"""Named queries over the views, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import history
from tidemark.plans.sql import REVISIONS
from tidemark.sources.views import articles, fetch_log, table, versions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


ARTICLES = """articles as (select doc_id as id, source, trim(string_split(trim(text),chr(10))[1]) as title, lang as tag,
  timestamp '2024-01-01 00:00:00' + doc_id * interval 1 minute as seen_at from documents)"""
LOG = """log as (select 'Src' || user_id as source, date_trunc('hour', ts) + (event_id % 500) * interval 1 second as started_at, date_trunc('hour', ts) + (event_id % 500 + 2) * interval 1 second as finished_at,
  event_id as id, case when event_type = 'error' or user_id % 9 = 0 then 'error' when event_type = 'signup' then 'skipped' else 'ok' end as status,
  case when (event_type = 'error' or user_id % 9 = 0) and event_id % 2 = 0 then 'Temporary failure in name resolution' when event_type = 'error' or user_id % 9 = 0 then 'HTTP 503' end as error,
  cast(json_extract_string(props,'$.k') as bigint) as items_found, cast(floor(value) as bigint) as items_new from events)"""


@query(f"with {REVISIONS} select id, article_key, source, seen_at, prev_title, title, content_key = prev_key as minor from revisions where prev_title is not null")
def changes(spark, sf_dir):
    """Headline rewrites, newest first."""
    rows = history.revisions(versions(spark, sf_dir)).where("prev_title is not null")
    return rows.select("id", "article_key", "source", "seen_at", "prev_title", "title", "minor").orderBy(F.desc("seen_at"), F.desc("id"))


@query(f"with {REVISIONS} select article_key, count(*) as n from revisions group by all")
def version_counts(spark, sf_dir):
    return history.revisions(versions(spark, sf_dir)).groupBy("article_key").agg(F.count("*").alias("n"))


@query(f"with {REVISIONS} select article_key, revision, id, title, seen_at from revisions")
def version_history(spark, sf_dir):
    return history.revisions(versions(spark, sf_dir)).select("article_key", "revision", "id", "title", "seen_at").orderBy("article_key", "revision")


@query(f"with {REVISIONS} select count(*) filter (not minor) as real, count(*) filter (minor) as hidden_minor from (select content_key = prev_key as minor from revisions where prev_title is not null)")
def change_counts(spark, sf_dir):
    rows = history.revisions(versions(spark, sf_dir)).where("prev_title is not null")
    return rows.agg(F.count_if(~F.col("minor")).alias("real"), F.count_if("minor").alias("hidden_minor"))


@query(f"""with {REVISIONS}, a as (select article_key, min_by(source, id) as source, min(seen_at) as first_at,
 min(seen_at) filter (prev_title is not null and content_key <> prev_key) as changed_at from revisions group by article_key)
 select coalesce(source, '(all)') as source, count(*) as articles, count(changed_at) as rewritten,
 round(median(epoch(changed_at) - epoch(first_at)), 3) as median_delay_s from a group by rollup (source)""")
def rewrite_stats(spark, sf_dir):
    """Articles, rewritten articles and the exact median delay, by source and over all."""
    later = F.when(F.col("prev_title").isNotNull() & ~F.col("minor"), F.col("seen_at"))
    rows = history.revisions(versions(spark, sf_dir))
    per = rows.groupBy("article_key").agg(F.min_by("source", "id").alias("source"), F.min("seen_at").alias("first_at"), F.min(later).alias("changed_at"))
    delay = F.unix_timestamp("changed_at") - F.unix_timestamp("first_at")
    out = per.rollup("source").agg(F.count("*").alias("articles"), F.count("changed_at").alias("rewritten"), F.round(F.median(delay), 3).alias("median_delay_s"))
    return out.withColumn("source", F.coalesce("source", F.lit("(all)")))


@query(f"with {ARTICLES} select source, count(*) as n, min(seen_at) as first_seen, max(seen_at) as last_seen from articles group by source")
def counts_by_source(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


@query(f"with {ARTICLES} select id, source, title, seen_at from articles order by seen_at desc, id desc limit 50")
def list_recent(spark, sf_dir):
    """One page of the newest articles."""
    return articles(spark, sf_dir).select("id", "source", "title", "seen_at").orderBy(F.desc("seen_at"), F.desc("id")).limit(50)


@query(f"with {ARTICLES} select id, source, title from articles where title ilike '%the%' or title ilike '%und%'")
def search_like(spark, sf_dir):
    return articles(spark, sf_dir).where("title ilike '%the%' or title ilike '%und%'").select("id", "source", "title")


@query(f"""with {ARTICLES}, d as (select source, cast(seen_at as date) as day, count(*) as n from articles group by all)
 select source, day, n, greatest(1, ceil(5.0 * n / max(n) over ()))::int as heat from d""")
def articles_per_day(spark, sf_dir):
    """Articles of a source and day with their heat level."""
    rows = articles(spark, sf_dir).groupBy("source", F.to_date("seen_at").alias("day")).agg(F.count("*").alias("n"))
    peak = rows.agg(F.max("n").alias("_peak"))
    return rows.join(F.broadcast(peak)).select("source", "day", "n", F.greatest(F.lit(1), F.ceil(F.lit(5.0) * F.col("n") / F.col("_peak"))).cast("int").alias("heat"))  # peak: one row


@query(f"with {ARTICLES} select h::int as hour, count(id) as n from range(24) r(h) left join articles on h = hour(seen_at) group by h")
def per_hour(spark, sf_dir):
    hours = articles(spark, sf_dir).groupBy(F.hour("seen_at").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(hours, "hour", "left").fillna(0, ["n"])


@query("select conv_id, max(turn) as turn, max_by(role, turn) as role, max_by(text, turn) as text from conversations group by conv_id")
def latest_per_key(spark, sf_dir):
    return history.latest_per_key(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("select conv_id, min(turn) as first_turn, min_by(text, turn) as first_text, count(*) - 1 as later from conversations group by conv_id")
def first_vs_rest(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.min("turn").alias("first_turn"), F.min_by("text", "turn").alias("first_text"), (F.count("*") - 1).alias("later"))


@query(f"""with {LOG} select source, count(*) as attempts, max(started_at) filter (status = 'ok') as last_ok, max_by(status, (started_at, id)) as last_status,
 cast(sum(items_new) filter (status = 'ok') as bigint) as items_new from log group by source""")
def source_status(spark, sf_dir):
    ok = F.col("status") == "ok"
    return fetch_log(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("attempts"),
        F.max(F.when(ok, F.col("started_at"))).alias("last_ok"),
        F.max_by("status", F.struct("started_at", "id")).alias("last_status"),
        F.sum(F.when(ok, F.col("items_new"))).alias("items_new"),
    )


@query(f"""with {ARTICLES}, t as (select id, unnest(regexp_extract_all(lower(title),'[\\p{{L}}\\p{{N}}]+')) as term from articles)
 select term, count(distinct id) as df, count(*) as cf from t group by term""")
def term_frequency(spark, sf_dir):
    """Articles and places of each term in titles."""
    own = articles(spark, sf_dir).select("id", F.explode(tokens(F.col("title"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""with {ARTICLES}, t as (select distinct id, source, unnest(regexp_extract_all(lower(title),'[\\p{{L}}\\p{{N}}]+')) as term from articles),
 n as (select source, count(*) as own from articles group by source), o as (select source, term, count(*) as n from t group by all), a as (select term, sum(n) as everywhere from o group by term)
 select source, term, n, round(n / (everywhere * (own / (select count(*) from articles))), 6) as lift from o join a using (term) join n using (source) where n >= 3""")
def distinctive_words(spark, sf_dir):
    """Title words of a source by their share against all sources."""
    rows = articles(spark, sf_dir)
    own = rows.groupBy("source").agg(F.count("*").alias("own"))
    own = own.withColumn("share", F.col("own") / F.sum("own").over(Window.partitionBy()))  # one row a source
    terms = rows.select("source", F.explode(F.array_distinct(tokens(F.col("title")))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    everywhere = terms.groupBy("term").agg(F.sum("n").alias("everywhere"))
    lift = F.round(F.col("n") / (F.col("everywhere") * F.col("share")), 6)
    return terms.where("n >= 3").join(everywhere, "term").join(own, "source").select("source", "term", "n", lift.alias("lift"))


@query("""with d as (select distinct cast(o_orderdate as date) as day, max(o_orderkey) over (partition by cast(o_orderdate as date)) as newest from orders),
 r as (select *, row_number() over (order by day desc) as nth, row_number() over (partition by date_trunc('week', day) order by day desc) as in_week, dense_rank() over (order by date_trunc('week', day) desc) as week from d)
 select day, newest from r where nth <= 7 or (in_week = 1 and week <= 4)""")
def snapshot_retention(spark, sf_dir):
    """Snapshots kept: the newest of each of 7 days and of each of 4 weeks."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("newest"))
    week = F.date_trunc("week", "day")
    rows = days.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("day")))).withColumn("in_week", F.row_number().over(Window.partitionBy(week).orderBy(F.desc("day"))))
    rows = rows.withColumn("week", F.dense_rank().over(Window.orderBy(week.desc())))
    return rows.where("nth <= 7 or (in_week = 1 and week <= 4)").select("day", "newest")
