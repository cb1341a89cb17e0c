"""Landing, the daily run, interchange formats and the large-lexicon paths."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from risetide.functions import fields
from risetide.functions.scoring import as_of_day, as_of_timestamp
from risetide.operators import lexicon
from risetide.operators.clean import clean_posts
from risetide.operators.joins import salted_lookup
from risetide.operators.selection import filter_posts
from risetide.plans import daily, dashboard
from risetide.plans.daily import Inputs
from risetide.schema import ARTICLES_SCHEMA, RSS_SCHEMA, SUBMISSION_SCHEMA
from risetide.sources import landing, tables
from risetide.sources.tables import Lake
from risetide.streaming.landing import stream_submissions

NOW = dt.datetime(2024, 1, 31, 12)


def submissions(spark, rows):
    return spark.createDataFrame(
        [(f"/r/t/comments/{i}/", 1706659200.7, body, title, score, "t", None) for i, title, body, score in rows],
        SUBMISSION_SCHEMA,
    )


def articles(spark, urls):
    items = [(u, "2024-01-30T10:00:00Z", f"Title {u}", None, "<p>text</p>") for u in urls]
    return spark.createDataFrame([("science", items), ("weather", items)], ARTICLES_SCHEMA)


def entries(spark, n):
    return spark.createDataFrame(
        [("f", i, f"http://f/{i}", None, "2024-01-05T06:07:08Z", "", "<i>d</i>", "t", "", ("Feed",)) for i in range(n)],
        RSS_SCHEMA,
    )


@pytest.fixture
def inputs(spark):
    return Inputs(
        categories=spark.createDataFrame([("solar", "science", 1.0), ("vote", "politics", 1.0)], "term string, category string, weight double"),
        valence=spark.createDataFrame([("great", 3.0), ("bad", -2.0)], "term string, valence double"),
        gazetteer=spark.createDataFrame([("Solar Farm", "ORG")], "entity string, type string"),
    )


def test_forum_mapping(spark):
    landed = submissions(spark, [(1, "T" * 600, None, 5)])
    row = landing.forum_posts(landed).first()
    assert (row.url, len(row.title), row.created_at, row.author, row.body) == (
        "https://www.reddit.com/r/t/comments/1/", 600, "2024-01-31 00:00:00", "", "")
    assert row.id.startswith("reddit_") and len(row.id) == 19


def test_news_mapping_and_fallback(spark):
    now = as_of_timestamp(NOW)
    news = landing.news_articles(articles(spark, ["a", "a", "", "b"]), now)
    assert sorted(r.url for r in news.collect()) == ["a", "b"]
    feeds = landing.feed_posts(entries(spark, 60), now)
    assert feeds.count() == 50
    assert {(r.body, r.author, r.created_at) for r in feeds.collect()} == {("d", "Feed", "2024-01-05 06:07:08")}
    assert landing.with_fallback(news, feeds).count() == 2
    none = landing.news_articles(articles(spark, []), now)
    assert landing.with_fallback(none, feeds).count() == 50


def snapshot(lake):
    return {
        "posts": sorted(map(tuple, lake.posts().select("url", "category", "trend_score", "sentiment_label", "keywords").collect())),
        "scores": sorted(map(tuple, lake.scores().collect())),
        "keywords": sorted(map(tuple, lake.keyword_history().collect())),
        "tracked": sorted(map(tuple, lake.tracked().collect())),
    }


def test_daily_run_end_to_end_and_again(spark, tmp_path, inputs):
    # Post 1 is tracked after the first day; its re-fetched score gives the second day's growth.
    seen = [("https://www.reddit.com/r/t/comments/1/", dt.date(2024, 1, 31), 30)]
    inputs = replace(inputs, snapshots=spark.createDataFrame(seen, "url string, date date, score long"))
    lake = Lake(spark, str(tmp_path / "lake"))
    assert daily.collect_day(lake, NOW) == daily.FAILED
    assert not daily.refresh_day(lake, NOW, inputs)
    first = NOW - dt.timedelta(days=1)
    for when, score in ((first, 10), (NOW, 30)):
        posts = submissions(spark, [(1, "Great solar farm opens", "solar farm output", score), (2, "vote today", "bad", 1)])
        assert daily.collect_day(lake, when, posts, articles(spark, ["a"])) == daily.OK
        assert daily.process_day(lake, when, inputs) == daily.OK
    today = dashboard.day_posts(lake, inputs=inputs)
    got = {r.url.rsplit("/", 2)[-2] if "reddit" in r.url else r.url: r for r in today.collect()}
    assert (got["1"].category, got["1"].trend_score, got["1"].sentiment_label) == ("science", 75.0, "positive")
    assert (got["2"].category, got["2"].trend_score, got["2"].sentiment_label) == ("politics", 50.0, "negative")
    assert (got["a"].category, got["a"].trend_score) == ("general", 50.0)
    assert got["1"].keywords.startswith("solar farm")

    before = snapshot(lake)
    assert lake.scores().count() == 6 and lake.keyword_history().count() > 0
    assert daily.process_day(lake, NOW, inputs) == daily.OK
    assert snapshot(lake) == before
    assert daily.refresh_day(lake, NOW, inputs)           # fresh: nothing to do
    assert not tables.is_stale(lake.raw(), lake.posts(), as_of_day(NOW))

    today = dashboard.day_posts(lake, inputs=inputs)      # the files were replaced
    found = dashboard.topics(today, lake.keyword_history(), as_of_day(NOW), inputs)
    # A trend of 75 weighs 0.5: enough for a category (0.5), not for the overall list (1).
    assert found["overall"].count() == 0
    by_category = found["by_category"].collect()
    assert {r.scope_key for r in by_category} == {"science"}
    assert "solar farm" in {r.term for r in by_category}
    assert found["burst"].count() > 0
    assert dashboard.overview(today)["kpis"].first().total_posts == 3
    assert dashboard.trend_lists(today)["all"].count() == 3
    dashboard.export(today, str(tmp_path / "csv"), source="reddit")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_retention_drops_old_partitions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", dt.date(2024, 1, d), 1) for d in (1, 2, 30)], "url string, date date, score long")
    lake.write(rows, tables.SCORES, "date")
    assert lake.drop_before(tables.SCORES, "date", dt.date(2024, 1, 2)) == ["2024-01-01"]
    assert lake.scores().count() == 2
    assert lake.drop_before("nothing", "date", dt.date(2024, 1, 2)) == []


def test_csv_rows(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "id,source,title,url,created_at,score,subreddit,author,body\n"
        '1,news,"two\nlines, ""quoted""",u1,c,1,s,a,b\n'
        "2,news,short,u2\n"
        "3,news,long,u3,c,1,s,a,b,extra\n"
    )
    got = tables.read_raw_csv(spark, str(path)).orderBy("seq").collect()
    assert [(r.id, r.title, r.body) for r in got] == [("1", 'two\nlines, "quoted"', "b"), ("2", "short", None)]
    assert tables.read_raw_csv(spark, str(tmp_path / "none.csv")) is None
    assert tables.read_scores_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_json_state(spark):
    doc = json.dumps({"u": {"category": "tech", "source": "reddit", "added_date": "2024-01-02"}})
    tracked = tables.tracked_from_json(spark.createDataFrame([(doc,)], "value string"))
    assert tuple(tracked.first()) == ("u", "tech", "reddit", dt.date(2024, 1, 2))
    assert json.loads(tables.tracked_to_json(tracked).first().value) == json.loads(doc)
    hist = tables.keyword_history_from_json(spark.createDataFrame([('{"2024-01-02": {"a": 2, "b": 1}}',)], "value string"))
    assert {(r.term, r.cnt) for r in hist.collect()} == {("a", 2), ("b", 1)}


def test_readiness(spark):
    raw = spark.createDataFrame([("reddit", dt.date(2024, 1, 1)), ("news", dt.date(2024, 1, 1)), ("news", dt.date(2024, 1, 2))], "source string, date date")
    assert {r.date.day: r.ready for r in tables.readiness(raw).collect()} == {1: True, 2: False}
    assert {r.date.day: r.ready for r in tables.readiness(raw, require_all=False).collect()} == {1: True, 2: True}


def test_lexicons_are_one_path(spark, inputs):
    rows = [(i, "news", f"u{i}" if i else None, t) for i, t in enumerate(["great solar solar farm vote", "bad vote vote", "nothing", "", "solar farm solar farm"])]
    posts = clean_posts(spark.createDataFrame(rows, "seq long, source string, url string, title string"))

    def run(batch):
        out = lexicon.classify_posts(batch, inputs.categories)
        out = lexicon.add_sentiment(out, inputs.valence)
        out = lexicon.add_entities(out, inputs.gazetteer)
        return sorted((r.title, r.category, r.sentiment_score, r.entities) for r in out.collect())

    broadcasting = run(posts)
    assert run(posts.drop("post_key")) == broadcasting        # keyed by the text instead
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(posts) == broadcasting
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lexicon_terms_and_names(spark):
    posts = spark.createDataFrame([("NASA met the one two three four five-six Coca Cola in may", None)], "title string, body string")
    categories = spark.createDataFrame([("NASA", "science", 1.0), ("nasa", "science", None), ("Met", "sports", 0.5)], "term string, category string, weight double")
    valence = spark.createDataFrame([("MET", 2.0), ("met", None)], "term string, valence double")
    names = spark.createDataFrame(
        [("one two three four five", "ORG"), ("Coca-Cola", "ORG"), ("May", "DATE"), ("NASA", "ORG"), ("the", "ORG"), ("five six coca cola in may now", "ORG")],
        "entity string, type string")
    row = lexicon.add_entities(lexicon.ensure_sentiment(lexicon.classify_posts(posts, categories), valence), names).first()
    assert row.category == "science" and row.sentiment_score == 0.4588
    assert row.entities == ["nasa", "coca cola", "one two three four five"]


def test_feed_times(spark):
    given = {
        "Tue, 02 Jan 2024 10:00:00 GMT": "2024-01-02 10:00:00", "Wed, 03 Jan 2024 10:00:00 +0530": "2024-01-03 04:30:00",
        "2024-01-01T10:00:00+05:00": "2024-01-01 05:00:00", "2 Jan 2024 10:00 EST": "2024-01-02 15:00:00", "2024-01-05": "2024-01-05 00:00:00",
        "2024-01-01T10:00Z": "2024-01-01 10:00:00", "20240101T101112": "2024-01-01 10:11:12", "Sat, 31 Feb 2024 10:00:00 GMT": None, "soon": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", fields.feed_time(F.col("t")).alias("u"), fields.published_text(
        F.col("t"), as_of_timestamp(NOW)).alias("p")).collect()
    assert {r.t: r.u for r in rows} == given
    articles_time = {r.t: r.p for r in rows}
    assert articles_time["2024-01-01T10:00:00+05:00"] == "2024-01-01 10:00:00" and articles_time["2024-01-01T10:00Z"] == "2024-01-01 10:00:00"
    assert articles_time["soon"] == "soon" and articles_time[""] == "2024-01-31 12:00:00"


def test_landing_an_empty_source_again(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "again"))
    some = submissions(spark, [(1, "a", "b", 5)])
    assert daily.collect_day(lake, NOW, some, articles(spark, ["u"])) == daily.OK
    assert daily.collect_day(lake, NOW, some.limit(0), articles(spark, ["v"])) == daily.OK
    assert [(r.source, r.url) for r in lake.raw().collect()] == [("news", "v")]
    assert daily.collect_day(lake, NOW, some.limit(0), articles(spark, [])) == daily.FAILED
    assert lake.raw().count() == 0


def test_late_micro_batches_keep_their_order(spark):
    rows = [("reddit", "u", "second", 10_000, 0), ("reddit", "u", "first", 9_999, 5)]
    raw = spark.createDataFrame(rows, "source string, url string, title string, batch int, seq long").withColumn("landing_rank", F.lit(0))
    assert [r.title for r in clean_posts(raw).collect()] == ["first"]


def test_filters_need_their_column(spark):
    posts = spark.createDataFrame([("a",)], "title string")
    assert filter_posts(posts, sentiment="positive").count() == 1
    with pytest.raises(ValueError):
        filter_posts(posts, category="tech")


def test_long_keywords_are_whole_keys(spark):
    from risetide.operators.trend import interest_key

    two = spark.createDataFrame([("k" * 50 + "a",), ("k" * 50 + "b",)], "k string").select(interest_key(F.col("k")).alias("k"))
    assert two.distinct().count() == 2


def test_totals_of_any_category(spark):
    from risetide.operators.topics import rising_totals

    posts = spark.createDataFrame([("space", "news", 80.0), ("space", "blog", 90.0), ("tech", "news", 10.0)], "category string, source string, trend_score double")
    assert {(r.scope, r.scope_key): r.n_rising for r in rising_totals(posts).collect()} == {
        ("all", ""): 2, ("category", "space"): 2, ("source", "news"): 1, ("source", "blog"): 1}


def test_title_case(spark):
    from risetide.functions.text import title_case

    assert spark.createDataFrame([("covid19x foo_bar it's",)], "t string").select(title_case(F.col("t"))).first()[0] == "Covid19X Foo_Bar It'S"


def test_salted_lookup_is_a_plain_join(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 600, "hot").when(F.col("id") < 900, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("700", 2)], "k string, v int")
    for how in ("left", "inner"):
        expected = left.join(right, "k", how).select("id", "v").collect()
        assert sorted(map(str, salted_lookup(left, right, "k", F.col("id"), how).select("id", "v").collect())) == sorted(map(str, expected))


def test_results_do_not_depend_on_partitioning(spark, inputs):
    rows = [(i, "reddit", f"u{i % 40}", f"solar farm number {i % 7} vote great") for i in range(80)]
    raw = spark.createDataFrame(rows, "seq long, source string, url string, title string")
    empty = spark.createDataFrame([], "url string, date date, score long")

    def run(df):
        return sorted(map(str, daily.enrich(df, empty, inputs, NOW).collect()))

    assert run(raw.repartition(1)) == run(raw.repartition(7).orderBy(F.rand(3)))


def test_a_day_is_cleaned_once(spark, inputs, tmp_path):
    plans = []

    class Seen(Lake):
        def write(self, df, table, *partition_by):
            plans.append((table, df._jdf.queryExecution().optimizedPlan().toString()))
            super().write(df, table, *partition_by)

    lake = Seen(spark, str(tmp_path / "lake"))
    assert daily.collect_day(lake, NOW, submissions(spark, [(1, "solar", "<b>great</b>", 5)]), articles(spark, ["http://a"])) == daily.OK
    assert daily.process_day(lake, NOW, inputs) == daily.OK
    # tags are stripped in the job before, not in each branch of the posts' plan
    assert "<[^>]+>" not in dict(plans)[tables.POSTS]
    assert sorted((r.title, r.body) for r in lake.posts().collect()) == [("Title http://a", "text"), ("solar", "great")]
    assert not any((tmp_path / "lake" / "scratch").iterdir())


def test_filters(spark):
    posts = spark.createDataFrame([("tech", "news"), ("tech", "reddit")], "category string, source string")
    assert filter_posts(posts, category="All", source="news", sentiment="positive").count() == 1


def test_streamed_landing_reads_each_file_once(spark, tmp_path):
    folder, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"))
    folder.mkdir()

    def drop(name, i, score):
        (folder / name).write_text(json.dumps({"permalink": f"/r/t/comments/{i}/", "created_utc": 1706659200.0, "title": "t", "score": score, "subreddit": "t"}))

    def run():
        stream_submissions(spark, str(folder), lake, str(tmp_path / "cp"), NOW).awaitTermination(60)

    drop("a.json", 1, 1)
    run()
    drop("b.json", 1, 2)
    drop("c.json", 2, 3)
    run()
    run()
    assert lake.raw().count() == 3
    assert sorted((r.url[-2], r.score) for r in clean_posts(lake.raw()).collect()) == [("1", 1), ("2", 3)]
