"""Named queries over headlines and the fetch log: links, words, filters, statistics, search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.text import title_key
from tidemark.functions.words import KINDS, rewrite_kind, tokens, written_words
from tidemark.operators import history, logs, search
from tidemark.plans import sql
from tidemark.plans.queries import LOG, query
from tidemark.sources.views import fetch_log, headlines, table, versions

H, V, R = sql.HEADLINES, sql.VERSIONS, sql.REVISIONS
NOW = "2024-01-21 12:00:00"
WHEN = "coalesce(published_at, fetched_at)"
PAGE = 50


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# Links and words


@query(f"select page_id, {sql.normalised('url')} as url_normal from pages")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalised(F.col("url")).alias("url_normal"))


@query(f"with u as (select page_id, {sql.normalised('url')} as url from pages) select page_id, {sql.match_key('url')} as match_key from u")
def url_match_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.match_key(F.col("url")).alias("match_key"))


@query(f"with u as (select page_id, {sql.part('url', 'host')} as host from pages union all select -1 - id, {sql.part('url', 'host')} from (with {H} select id, url from headlines)) select page_id, {sql.site('host')} as site from u")
def url_site(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    rows = own.unionAll(headlines(spark, sf_dir).select(-1 - F.col("id"), urls.host(F.col("url"))))
    return rows.select("page_id", urls.site(F.col("host")).alias("site"))


@query(f"with u as (select page_id, {sql.normalised('url')} as url from pages), k as (select page_id, {sql.match_key('url')} as key from u) select page_id, split_part({sql.site('split_part(key, chr(47), 1)')}, '.', 1) || '/' || regexp_replace(key, '^[^/]*/', '') as brand_key from k")
def url_brand_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.brand_key(F.col("url")).alias("brand_key"))


@query(f"with {H} select id, sha256({sql.normalised('url')} || chr(10) || replace(lower(title), 'ß', 'ss')) as content_hash from headlines")
def content_hash(spark, sf_dir):
    folded = F.replace(F.lower("title"), F.lit("ß"), F.lit("ss"))
    return headlines(spark, sf_dir).select("id", F.sha2(F.concat(urls.normalised(F.col("url")), F.lit("\n"), folded), 256).alias("content_hash"))


@query(f"with {H} select id, is_live, {sql.MEDIA.format(live='is_live', title='title', url='url')} as is_media from headlines")
def live_and_media(spark, sf_dir):
    return headlines(spark, sf_dir).select("id", "is_live", urls.is_media(F.col("url"), F.col("title"), F.col("is_live")).alias("is_media"))


@query(f"with {H} select id, {sql.title_key('title')} as title_key from headlines")
def title_keys(spark, sf_dir):
    return headlines(spark, sf_dir).select("id", title_key(F.col("title")).alias("title_key"))


@query(f"with {H} select id, array_to_string({sql.tokens('title')}, ' ') as tokens from headlines")
def content_tokens(spark, sf_dir):
    return headlines(spark, sf_dir).select("id", F.array_join(tokens(F.col("title")), " ").alias("tokens"))


@query(f"with {H} select id, source, title, {sql.normalised('url')} as url, published_at, fetched_at, summary, is_live from headlines where length(title) >= 10 and {sql.part('url', 'scheme')} in ('http', 'https')")
def valid_headlines(spark, sf_dir):
    """Readings with a web link and a title of ten characters or more, their links normalised."""
    rows = headlines(spark, sf_dir).where((F.length("title") >= 10) & urls.scheme(F.col("url")).isin("http", "https"))
    return rows.select("id", "source", "title", urls.normalised(F.col("url")).alias("url"), "published_at", "fetched_at", "summary", "is_live")


# Rewrites


def rewrites(spark, sf_dir) -> DataFrame:
    return history.revisions(versions(spark, sf_dir)).where("prev_title is not null")


def kind_sql(old: str, new: str) -> str:
    roots = lambda t: f"list_distinct([left(w, 5) for w in {sql.tokens(t)} if not regexp_matches(w, '^[0-9]+$')])"
    return f"""select *, case when (bare_old <> trim({old}) or bare_new <> trim({new})) and (lower(bare_old) = lower(trim({new})) or lower(bare_new) = lower(trim({old}))) then 'label'
      when regexp_extract_all({old}, '[0-9]+(?:[.,][0-9]+)*') <> regexp_extract_all({new}, '[0-9]+(?:[.,][0-9]+)*') and overlap >= 0.7 then 'numbers' when overlap < 0.25 then 'new angle' else 'reworded' end as kind
      from (select *, case when len(list_distinct(a || b)) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 1.0 end as overlap
      from (select *, {roots(old)} as a, {roots(new)} as b, trim(regexp_replace({old}, '^\\s*[A-Za-z][\\p{{L}}\\p{{N}}_ ]{{0,20}}?\\s*[:|–—]\\s+', '')) as bare_old, trim(regexp_replace({new}, '^\\s*[A-Za-z][\\p{{L}}\\p{{N}}_ ]{{0,20}}?\\s*[:|–—]\\s+', '')) as bare_new
      from revisions where prev_title is not null))"""


@query(f"with {R}, k as ({kind_sql('prev_title', 'title')}) select id, prev_title, title, kind from k")
def rewrite_kinds(spark, sf_dir):
    return rewrites(spark, sf_dir).select("id", "prev_title", "title", rewrite_kind(F.col("prev_title"), F.col("title")).alias("kind"))


@query(f"with {R}, k as ({kind_sql('prev_title', 'title')}) select kinds.kind, count(k.id) as n from (values ('numbers'), ('label'), ('reworded'), ('new angle')) kinds(kind) left join k on k.kind = kinds.kind group by kinds.kind")
def rewrite_kind_counts(spark, sf_dir):
    """Rewrites of each kind, kinds without any too."""
    found = rewrites(spark, sf_dir).groupBy(rewrite_kind(F.col("prev_title"), F.col("title")).alias("kind")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(k,) for k in KINDS], "kind string").join(found, "kind", "left").fillna(0, ["n"])


# Upper ends of the delay buckets in seconds.
DELAYS = [900, 3600, 10800, 43200, 86400]


@query(f"""with {R}, d as (select epoch(seen_at) - epoch(first_value(seen_at) over (partition by article_key order by id)) as s, prev_title from revisions),
 b as (select (s >= 900)::int + (s >= 3600)::int + (s >= 10800)::int + (s >= 43200)::int + (s >= 86400)::int as bucket from d where prev_title is not null)
 select r.bucket::int as bucket, count(b.bucket) as n from range(6) r(bucket) left join b on b.bucket = r.bucket group by r.bucket""")
def delay_histogram(spark, sf_dir):
    """Rewrites by the time since the article was first seen, six buckets."""
    rows = history.revisions(versions(spark, sf_dir))
    first = F.min("seen_at").over(Window.partitionBy("article_key"))
    s = F.unix_timestamp("seen_at") - F.unix_timestamp("first")
    bucket = sum(((s >= d).cast("int") for d in DELAYS), F.lit(0)).alias("bucket")
    found = rows.withColumn("first", first).where("prev_title is not null").groupBy(bucket).agg(F.count("*").alias("n"))
    return spark.range(6).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left").fillna(0, ["n"])


# Lists, filters and pages


def listed(rows: DataFrame, since: str | None = None, fetched_from: str | None = None, fetched_to: str | None = None, sources: list[str] | None = None, live: str = "include") -> DataFrame:
    """Readings filtered as a list asks for; sources None is all, an empty list none; names in any case; live: include, exclude or only."""
    if since:
        rows = rows.where(F.expr(WHEN) >= at(since))
    if fetched_from:
        rows = rows.where(F.col("fetched_at") >= at(fetched_from))
    if fetched_to:
        rows = rows.where(F.col("fetched_at") < at(fetched_to))
    if sources is not None:
        rows = rows.where(F.lower("source").isin([s.lower() for s in sources]) if sources else F.lit(False))
    return rows if live == "include" else rows.where(F.col("is_live") == (live == "only"))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    """One page in order, with has_more: whether another follows. A row beyond the page tells."""
    number = min(200, max(1, number))
    some = rows.orderBy(*order).offset((number - 1) * size).limit(size + 1)  # a page is the feature
    rank = F.row_number().over(Window.orderBy(*order))
    return some.withColumn("_rank", rank).withColumn("has_more", F.max("_rank").over(Window.partitionBy()) > size).where(F.col("_rank") <= size).drop("_rank")


@query(f"with {H} select id, source, title from headlines where coalesce(published_at, fetched_at) >= timestamp '2024-01-05 00:00:00' and lower(source) in ('src1', 'src3') and not is_live")
def list_filtered(spark, sf_dir):
    """Of two sources, not live, since a day by the time of publication."""
    return listed(headlines(spark, sf_dir), since="2024-01-05 00:00:00", sources=["SRC1", "src3"], live="exclude").select("id", "source", "title")


@query(f"with {H} select id, source, is_live from headlines where fetched_at >= timestamp '2024-01-03 00:00:00' and fetched_at < timestamp '2024-01-10 00:00:00' and is_live")
def list_live_only(spark, sf_dir):
    return listed(headlines(spark, sf_dir), fetched_from="2024-01-03 00:00:00", fetched_to="2024-01-10 00:00:00", live="only").select("id", "source", "is_live")


@query(f"with {H}, t as (select *, row_number() over (order by coalesce(published_at, fetched_at) desc, id desc) as k, count(*) over () as n from headlines) select id, source, title, n > 100 as has_more from t where k > 50 and k <= 100")
def list_page(spark, sf_dir):
    """The second page of all, newest first."""
    return page(headlines(spark, sf_dir), [F.expr(WHEN).desc(), F.desc("id")], 2).select("id", "source", "title", "has_more")


@query(f"with {H} select id, title from headlines where contains(lower(title), 'th%') or contains(lower(title), 'er_') or contains(lower(coalesce(summary, '')), 'er,')")
def search_substring(spark, sf_dir):
    """Plain substrings of title or summary in any case; % and _ stand for themselves."""
    has = lambda c, x: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(x))
    return headlines(spark, sf_dir).where(has("title", "th%") | has("title", "er_") | has("summary", "er,")).select("id", "title")


@query(f"with {H} select id, to_json({{'source': source, 'title': title, 'is_live': is_live}}) as j from headlines")
def as_json(spark, sf_dir):
    return headlines(spark, sf_dir).select("id", F.to_json(F.struct("source", "title", "is_live")).cast("string").alias("j"))


# Counts


@query(f"""with {R} select (select count(*) from headlines) as articles, (select coalesce(sum(is_live::int), 0)::bigint from headlines) as live,
 (select count(*) from revisions where prev_title is not null and content_key <> prev_key) as rewrites, (select max(finished_at) from (with {LOG} select * from log)) as last_fetch""")
def totals(spark, sf_dir):
    whole = headlines(spark, sf_dir).agg(F.count("*").alias("articles"), F.coalesce(F.sum(F.col("is_live").cast("int")), F.lit(0)).alias("live"))
    changed = rewrites(spark, sf_dir).where("not minor").agg(F.count("*").alias("rewrites"))
    last = fetch_log(spark, sf_dir).agg(F.max("finished_at").alias("last_fetch"))
    return whole.crossJoin(changed).crossJoin(last)  # one row each


@query(f"with {H} select count(*) as n from headlines where fetched_at > timestamp '2024-01-10 07:20:00'")
def count_newer(spark, sf_dir):
    return headlines(spark, sf_dir).where(F.col("fetched_at") > at("2024-01-10 07:20:00")).agg(F.count("*").alias("n"))


@query(f"with {H} select source, cast(fetched_at as date) as day, count(*) as n, count(*) filter (is_live) as live from headlines group by all")
def per_source_day(spark, sf_dir):
    return headlines(spark, sf_dir).groupBy("source", F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"), F.count_if("is_live").alias("live"))


@query(f"with {H} select *, round(n / sum(n) over (partition by day), 6) as share from (select tag, cast(fetched_at as date) as day, count(*) as n from headlines where regexp_matches(tag, '^[A-Z]{{2}}$') group by all)")
def per_country_day(spark, sf_dir):
    rows = headlines(spark, sf_dir).where(F.col("tag").rlike("^[A-Z]{2}$")).groupBy("tag", F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("day")), 6))


@query(f"""with {H}, c as (select source, count(*) filter (fetched_at >= timestamp '2024-01-14 12:00:00') as cur, count(*) filter (fetched_at < timestamp '2024-01-14 12:00:00') as prev from headlines
 where fetched_at >= timestamp '2024-01-07 12:00:00' and fetched_at < timestamp '{NOW}' group by source)
 select source, cur, prev, round((cur - prev) / nullif(prev, 0), 6) as delta, case when prev > 0 and abs((cur - prev) / prev) >= 0.1 then sign(cur - prev)::int else 0 end as mark from c""")
def period_delta(spark, sf_dir):
    """A week against the week before, by source; mark: +1 or -1 from a tenth on."""
    cur = F.col("fetched_at") >= at("2024-01-14 12:00:00")
    rows = listed(headlines(spark, sf_dir), fetched_from="2024-01-07 12:00:00", fetched_to=NOW).groupBy("source").agg(F.count_if(cur).alias("cur"), F.count_if(~cur).alias("prev"))
    delta = F.when(F.col("prev") > 0, (F.col("cur") - F.col("prev")) / F.col("prev"))
    return rows.withColumn("delta", F.round(delta, 6)).withColumn("mark", F.when(F.abs(delta) >= 0.1, F.signum(delta).cast("int")).otherwise(0))


@query(f"""with {H}, t as (select hour(fetched_at) as h, count(*) as n from headlines where fetched_at >= timestamp '2024-01-21 00:00:00' and fetched_at < timestamp '{NOW}' group by h),
 p as (select hour(fetched_at) as h, count(*) / 7.0 as n from headlines where fetched_at >= timestamp '2024-01-14 00:00:00' and fetched_at < timestamp '2024-01-21 00:00:00' group by h)
 select r.h::int as hour, coalesce(t.n, 0)::bigint as today, round(coalesce(p.n, 0), 6)::double as typical, round(sum(coalesce(p.n, 0)) over (order by r.h), 6)::double as typical_upto from range(24) r(h) left join t on t.h = r.h left join p on p.h = r.h""")
def today_vs_typical(spark, sf_dir):
    """Articles of each hour today, the mean of the seven days before, and its running sum."""
    rows = listed(headlines(spark, sf_dir), fetched_from="2024-01-14 00:00:00", fetched_to=NOW)
    today = F.col("fetched_at") >= at("2024-01-21 00:00:00")
    found = rows.groupBy(F.hour("fetched_at").alias("hour")).agg(F.count_if(today).alias("today"), (F.count_if(~today) / 7.0).cast("double").alias("typical"))
    whole = spark.range(24).select(F.col("id").cast("int").alias("hour")).join(found, "hour", "left").fillna(0)
    upto = F.sum("typical").over(Window.orderBy("hour"))  # 24 rows
    return whole.select("hour", "today", F.round("typical", 6).alias("typical"), F.round(upto, 6).alias("typical_upto"))


@query(f"""with {H}, w as (select id, source, fetched_at >= timestamp '2024-01-20 12:00:00' as recent, unnest(list_distinct({sql.tokens('title')})) as stem from headlines where not is_live and fetched_at < timestamp '{NOW}'),
 o as (select greatest(1.0, (epoch(timestamp '2024-01-20 12:00:00') - epoch(min(fetched_at))) / 86400) as span from headlines where not is_live and fetched_at < timestamp '{NOW}'),
 s as (select stem, count(*) filter (recent) as recent, count(*) filter (not recent) as earlier, count(distinct source) filter (recent) as outlets from w where not regexp_matches(stem, '^[0-9]+$') group by stem),
 x as (select stem, recent, earlier, outlets, round((recent + 1) / (earlier / (select span from o) + 1), 6) as score from s where recent >= 3 and outlets >= 2)
 select stem, recent, earlier, outlets, score from x order by score desc, recent desc, stem desc limit 15""")
def rising_topics(spark, sf_dir):
    """Stems more frequent in titles of the last day than a day's mean before; the top 15."""
    rows = listed(headlines(spark, sf_dir), fetched_to=NOW, live="exclude")
    edge = at("2024-01-20 12:00:00")
    span = rows.agg(F.greatest(F.lit(1.0), (F.unix_timestamp(edge) - F.unix_timestamp(F.min("fetched_at"))) / 86400).alias("span"))
    terms = rows.select("source", (F.col("fetched_at") >= edge).alias("new"), F.explode(F.array_distinct(tokens(F.col("title")))).alias("stem")).where(~F.col("stem").rlike("^[0-9]+$"))
    per = terms.groupBy("stem", "source").agg(F.count_if("new").alias("recent"), F.count_if(~F.col("new")).alias("earlier"))
    found = per.groupBy("stem").agg(F.sum("recent").alias("recent"), F.sum("earlier").alias("earlier"), F.count_if(F.col("recent") > 0).alias("outlets")).where("recent >= 3 and outlets >= 2")
    score = F.round((F.col("recent") + 1) / (F.col("earlier") / F.col("span") + 1), 6)
    return found.join(F.broadcast(span)).withColumn("score", score).drop("span").orderBy(F.desc("score"), F.desc("recent"), F.desc("stem")).limit(15)  # span: one row


# The fetch log


@query(f"""with {LOG}, g as (select *, case when started_at - lag(started_at) over w > interval 10 minute or lag(started_at) over w is null then 1 else 0 end as opens from log window w as (order by started_at, id)),
 s as (select *, sum(opens) over (order by started_at, id rows unbounded preceding) as run from g)
 select min(started_at) as started, max(finished_at) as finished, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as failed,
 sum(items_found)::bigint as found, sum(items_new)::bigint as new, coalesce(string_agg(distinct source, ',' order by source) filter (status = 'error'), '') as failed_sources from s group by run""")
def fetch_runs(spark, sf_dir):
    """Attempts of all sources gathered into runs by gaps of ten minutes."""
    return logs.runs(fetch_log(spark, sf_dir))


@query(f"""with {LOG}, r as (select *, row_number() over (partition by lower(source) order by started_at desc, id desc) as rank from log)
 select lower(source) as source, count(*) as n from r where rank <= 3 group by lower(source) having count(*) = 3 and bool_and(status = 'error')""")
def failing_streaks(spark, sf_dir):
    """Sources whose last three attempts all failed."""
    return logs.failing(fetch_log(spark, sf_dir), 3)


@query(f"""with {LOG}, k as (select * from log where id not in (select min(id) from log group by lower(source)))
 select lower(source) as source, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'error') as failed, count(*) filter (status not in ('ok', 'error')) as skipped,
 coalesce(sum(items_found) filter (status = 'ok'), 0)::bigint as found, coalesce(sum(items_new) filter (status = 'ok'), 0)::bigint as new,
 count(*) filter (status = 'ok' and items_found > 0 and items_new >= items_found) as all_new from k group by lower(source)""")
def feed_turnover(spark, sf_dir):
    """Attempts by outcome and items found and new, each source's first attempt left out."""
    return logs.turnover(fetch_log(spark, sf_dir))


@query(f"""with {LOG}, f as (select date_trunc('hour', started_at) as hour, count(*) as attempts, count(*) filter (status = 'error') as failed,
 count(*) filter (status = 'error' and regexp_matches(coalesce(error, ''), '(?i)name or service not known|temporary failure in name resolution|nodename nor servname|errno -[235]\\b|network is unreachable|no route to host|network down:')) as network from log group by all)
 select hour, attempts, failed, network, failed >= greatest(3, 0.8 * attempts) and failed = network as down from f""")
def network_down(spark, sf_dir):
    """By hour: whether nearly all attempts failed, and all for the network's sake."""
    return logs.network_down(fetch_log(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "started_at")), "hour")


# Search


@query(f"""with {H}, d as (select id, title, fetched_at, published_at, [replace(x, 'ß', 'ss') for x in regexp_extract_all(lower(strip_accents(title || ' ' || coalesce(summary, ''))), '[\\p{{L}}\\p{{N}}]+')] as toks from headlines),
 n as (select count(*) as n, avg(len(toks)) as mean from d), q(p) as (values ('th'), ('ere')),
 m as (select d.id, q.p, len([t for t in toks if starts_with(t, q.p)]) as tf, len(toks) as dl from d, q), hit as (select * from m where tf > 0),
 idf as (select p, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5))) as idf from hit, n group by p, n)
 select hit.id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score from hit join idf using (p), n group by hit.id having count(*) = 2""")
def search_current(spark, sf_dir):
    """Readings whose title or summary have words that begin with each of the query's, and their rank."""
    rows = headlines(spark, sf_dir)
    text = F.concat("title", F.lit(" "), F.coalesce("summary", F.lit("")))
    return search.ranked(rows.select("id", text.alias("text")), "id", "th ere").select("id", F.round("score", 6).alias("score"))


@query(f"""with {R}, d as (select article_key, id, title, seen_at, regexp_extract_all(lower(strip_accents(replace(title, 'ß', 'ss'))), '[\\p{{L}}\\p{{N}}]+') as toks, id = max(id) over (partition by article_key) as current from revisions),
 n as (select count(*) as n, avg(len(toks)) as mean from d), m as (select *, len([t for t in toks if starts_with(t, 'th')]) as tf from d), hit as (select * from m where tf > 0),
 s as (select hit.*, -greatest(1e-6, ln((n - (select count(*) from hit) + 0.5) / ((select count(*) from hit) + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean)) as score from hit, n),
 r as (select *, row_number() over (partition by article_key order by current desc, round(score, 9), id) as k, min(score) over (partition by article_key) as best from s)
 select article_key, id, round(best, 6) as score, case when current then null else title end as matched_title from r where k = 1""")
def search_history(spark, sf_dir):
    """One hit an article over all its wordings: the current one if it matches, else the best; ranked by the best."""
    rows = history.revisions(versions(spark, sf_dir))
    return search.best_version(rows, "th").select("article_key", "id", F.round("score", 6).alias("score"), "matched_title")
