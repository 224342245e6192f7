from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import urls, words
from tidemark.operators import alerts, search, stories, twins
from tidemark.sources.views import headlines

URLS = [
    ("HTTP://User:pw@Example.COM:80/a/b/?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2", "example.com/a/b?a=1&b=2"),
    ("https://www.bbc.co.uk/news/1?at_medium=RSS&AT_x=1", "https://www.bbc.co.uk/news/1", "bbc.co.uk/news/1"),
    ("https://m.example.com:8443//x//amp/y.amp/", "https://m.example.com:8443//x//amp/y.amp", "example.com:8443/x/y"),
    ("https://example.com", "https://example.com", "example.com/"),
    ("https://example.com/", "https://example.com/", "example.com/"),
    ("https://a.org/x?q=caf%C3%A9+au+lait&z=~*&flag", "https://a.org/x?flag=&q=caf%C3%A9+au+lait&z=~%2A", "a.org/x?flag=&q=caf%C3%A9+au+lait&z=~%2A"),
    ("https://amp.site/x?amp=1&outputType=amp&id=3", "https://amp.site/x?amp=1&id=3&outputType=amp", "amp.site/x?id=3"),
]


def test_links(spark):
    rows = spark.createDataFrame([(u,) for u, _, _ in URLS], "u string").select("u", urls.normalised(F.col("u")), urls.match_key(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == URLS


@pytest.mark.parametrize("host,site,brand", [("www.bbc.co.uk", "bbc.co.uk", "bbc"), ("news.abc.net.au", "abc.net.au", "abc"), ("a.b.example.com", "example.com", "example"), ("co.uk", "co.uk", "co"), ("localhost", "localhost", "localhost")])
def test_sites(spark, host, site, brand):
    row = spark.range(1).select(urls.site(F.lit(host)), urls.brand_key(F.lit(f"https://{host}/x/y"))).first()
    assert tuple(row) == (site, f"{brand}/x/y")


@pytest.mark.parametrize("url,title,live", [("https://a.b/live/x", "t", True), ("https://a.b/live-in-harmony", "How to live in harmony", False), ("https://a.b/x", "Election live updates: polls", True), ("https://a.b/x?y=/live/", "t", False)])
def test_live(spark, url, title, live):
    assert spark.range(1).select(urls.looks_live(F.lit(url), F.lit(title))).first()[0] is live


def test_words(spark):
    title = F.lit("The President's 3 survivors' rescuing efforts: classes, buses and U.S. storms' ends in 2024")
    assert spark.range(1).select(words.tokens(title)).first()[0] == ["president", "3", "survivor", "rescu", "effort", "class", "buse", "storm", "ends", "2024"]


KINDS = [
    ("Rescuers find 60 ibises near the lake", "Rescuers find 59 ibises near the lake", "numbers"),
    ("Breaking: storm hits the coast", "Storm hits the coast", "label"),
    ("Storm hits the northern coast", "Storm batters the northern coast hard", "reworded"),
    ("Storm hits the northern coast", "Parliament votes on budget", "new angle"),
    ("The", "And", "reworded"),
]


def test_rewrite_kinds(spark):
    rows = spark.createDataFrame(KINDS, "a string, b string, k string")
    assert [r[0] for r in rows.select(words.rewrite_kind(F.col("a"), F.col("b"))).collect()] == [k for _, _, k in KINDS]


def test_search_is_by_beginnings_without_marks(spark):
    rows = spark.createDataFrame([(1, "Café tables"), (2, "cafeteria food"), (3, "the cave"), (4, None), (5, "CAFE table, CAFE table")], "id long, text string")
    got = search.ranked(rows, "id", "cafe tab").orderBy("score", "id").collect()
    assert [r["id"] for r in got] == [5, 1]
    assert search.ranked(rows, "id", "").count() == 0


T = datetime(2024, 1, 1)


def test_alerts_are_told_after_grace_repeated_and_ended(spark):
    minutes = [(0, "fail"), (5, "fail"), (9, "fail"), (20, "fail"), (369, "fail"), (400, "ok"), (410, "ok"), (420, "warn"), (474, "warn"), (475, "warn"), (476, "fail"), (485, "fail"), (490, "ok"), (500, "warn"), (501, "ok")]
    rows = [("c", T + timedelta(minutes=m), level) for m, level in minutes] + [("d", T, "ok")]
    got = alerts.events(spark.createDataFrame(rows, "check string, at timestamp, level string")).orderBy("at").collect()
    assert [(r["kind"], r["level"], (r["at"] - T).seconds // 60) for r in got] == [("alert", "fail", 9), ("remind", "fail", 369), ("recover", "ok", 400), ("alert", "warn", 475), ("alert", "fail", 485), ("recover", "ok", 490)]


def test_alerts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(f"c{k % 3}", T + timedelta(minutes=7 * k), ["fail", "fail", "warn", "ok"][k * k % 7 % 4]) for k in range(80)]
    frame = spark.createDataFrame(rows, "check string, at timestamp, level string")
    for k in range(4):  # four batches in order of time
        frame.where(f"at >= timestamp'{T + timedelta(minutes=140 * k)}' and at < timestamp'{T + timedelta(minutes=140 * (k + 1))}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = alerts.follow(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("told").collect())) == sorted(map(tuple, alerts.events(frame).collect()))


def test_stories_equal_one_ordered_pass_over_all(spark):
    rows = headlines(spark, "/root/testdata/sf0.01").withColumn("at", F.coalesce("published_at", "fetched_at")).where("id % 3 <> 1 or id < 300")
    got = {r["id"]: r["story"] for r in stories.cluster(rows).collect()}
    bags, titles = {}, {}
    for r in stories.weights(rows).collect():
        bags.setdefault(r["id"], {})[r["term"]] = r["weight"]
        if r["in_title"]:
            titles.setdefault(r["id"], set()).add(r["term"])
    order = [(r["at"], r["id"]) for r in rows.select("at", "id").orderBy("at", "id").collect()]
    found = stories.lead_by_order([__import__("pandas").Timestamp(a) for a, _ in order], [bags.get(i, {}) for _, i in order], [titles.get(i, set()) for _, i in order])
    want = {order[m][1]: order[s.members[0]][1] for s in found for m in s.members}
    assert got == want
    assert any(len(s.members) > 1 for s in found)


STORIES = "id long, title string, summary string, url string, is_live boolean, at timestamp"


def test_stories_are_found_in_few_jobs_however_long_a_chain_of_words(spark):
    rows = [(i, f"alpha{i} alpha{i + 1}", None, "https://a.com/x", False, T + timedelta(hours=30 * i)) for i in range(40)]
    spark.sparkContext.setJobGroup("chain", "chain")
    got = stories.cluster(spark.createDataFrame(rows, STORIES)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["id"] for r in got) == list(range(40)) and {r["story"] for r in got} == {0}
    assert jobs <= 20


def test_open_stories_are_those_of_the_window_and_equal_the_plain_pass(spark):
    draw = __import__("random").Random(5)
    words, at, vectors, titles = [f"w{k}" for k in range(40)], [], [], []
    when = T
    for k in range(1500):
        when += timedelta(minutes=draw.choice([0, 20, 40, 400]) if k % 90 else 36 * 60 + draw.randrange(2))
        own = sorted(draw.sample(words, draw.randrange(0, 9))) if k % 7 or not vectors else sorted(vectors[-draw.randrange(1, min(9, len(vectors)) + 1)])
        norm = len(own) ** 0.5 or 1.0
        at.append(when)
        vectors.append({w: 1 / norm for w in own})
        titles.append({w for w in own if draw.random() < 0.7})
    held, got, most = stories.Open(), {}, 0
    for k, (a, vector, own) in enumerate(zip(at, vectors, titles, strict=True)):
        micros = int((a - T).total_seconds()) * 10**6
        got |= {i: s for i, s, _ in held.over(micros)}
        held.take(k, micros, vector, own, False)
        assert all(micros - last <= 36 * 3600 * 10**6 for last in held.last.values())
        most = max(most, len(held.last))
    got |= {i: s for i, s, _ in held.over()}
    plain = stories.lead_by_order([__import__("pandas").Timestamp(a) for a in at], vectors, titles)
    assert got == {m: s.members[0] for s in plain for m in s.members}
    assert not (held.weight or held.titled or held.words or held.members) and 1 < most < len(plain) / 4


def reading(i, source, title, day, url=None):
    return i, source, title, url or f"https://{source}.com/{i}", T + timedelta(days=day), None, False


SCHEMA = "id long, source string, title string, url string, fetched_at timestamp, published_at timestamp, is_live boolean"


def test_twins_by_link_brand_and_title_within_a_week(spark):
    rows = [
        reading(1, "a", "One", 0, "https://a.com/x"), reading(2, "A", "Two", 1, "http://www.a.com/x/"), reading(3, "a", "Three", 2, "https://a.co.uk/x"), reading(4, "a", "three!", 3),
        reading(5, "b", "Three", 3), reading(6, "a", "THREE", 20),
    ]
    got = {r["id"]: (r["twin"], r["way"]) for r in twins.earlier(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2: (1, 1), 3: (2, 2), 4: (3, 3)}


def test_folding_takes_the_oldest_and_the_latest_title(spark):
    rows = [reading(2, "a", "New", 2, "https://a.com/x#y"), reading(1, "a", "Old", 1, "https://a.com/x?utm_source=f"), reading(3, "a", "Else", 0)]
    got = {r["whole"]: r for r in twins.folded(spark.createDataFrame(rows, SCHEMA)).collect()}
    row = got["https://a.com/x"]
    assert (row["readings"], row["titles"], row["keeper"], row["title"]) == (2, 2, 1, "New")
    assert twins.folded(spark.createDataFrame([], SCHEMA)).count() == 0
