"""Hand-computed cases, one operator each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from risetide.functions import fields, scoring, text
from risetide.operators import burst, graph, history, keywords, phrases, report, selection, topics, tracking, trend
from risetide.operators.clean import clean_posts, union_sources

NOW = dt.datetime(2024, 1, 31)


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, column, *rows):
    return values(spark, column, [(r,) for r in rows], "c string")


def day(n, month=1):
    return dt.date(2024, month, n)


def test_strip_markup(spark):
    got = one(spark, text.strip_markup(F.col("c")), "<b>A</b>&nbsp; B &amp;lt; C", "&lt;b&gt;x", "a​b  \x1cc", None)
    assert got == ["A B < C", "<b>x", "ab c", ""]


def test_score_and_time_text(spark):
    assert one(spark, fields.lenient_bigint(F.col("c")), "7", " 7 ", "abc", None, "1.9", "1d", "-2e1", "inf") == [7, 7, 0, 0, 1, 0, -20, 0]
    assert one(spark, fields.time_text(F.col("c")), " 2024-01-02T03:04:05.678+00:00", None, "2024-01-02") == ["2024-01-02 03:04:05", "", "2024-01-02"]
    assert one(spark, fields.parse_time(F.col("c")), "2024-01-02 03:04:05", "2024-01-02", "n/a") == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), None]
    assert one(spark, fields.published_text(F.col("c"), scoring.as_of_timestamp(NOW)), "2024-01-01T10:00:00+05:00", "") == ["2024-01-01 10:00:00", "2024-01-31 00:00:00"]


def test_submission_id(spark):
    assert one(spark, fields.submission_id(F.col("c")), "x/COMMENTS/AbC1/t/", "x/r/x/") == ["AbC1", None]


def raw(spark, rows):
    return spark.createDataFrame(
        [(i, s, u) for i, (s, u) in enumerate(rows)], "seq long, source string, url string"
    )


def test_dedup_comes_before_source_filter(spark):
    assert clean_posts(raw(spark, [("blog", "a"), ("news", "a")])).count() == 0
    got = clean_posts(raw(spark, [("news", None), ("news", None), ("news", "a")]))
    assert got.count() == 2 and got.where("title = '' and score = 0 and trend_score is null").count() == 2


def test_landing_order_decides_between_sources(spark):
    both = union_sources(raw(spark, [("reddit", "a")]), raw(spark, [("news", "a"), ("news", "b")]))
    assert {(r.source, r.url) for r in clean_posts(both.repartition(5)).collect()} == {("reddit", "a"), ("news", "b")}


def test_velocity_growth_and_scaling(spark):
    created = F.col("c").cast("timestamp")
    assert one(spark, scoring.velocity(F.lit(10), created, scoring.as_of_timestamp(NOW)), "2024-01-31 00:00:00", None) == [20.0, 50.0]
    rows = [(20, 10), (5, 10), (7, 0), (0, 10)]
    assert values(spark, scoring.growth_score(F.col("a"), F.col("b")), rows, "a long, b long") == [75.0, 37.5, 50.0, 25.0]
    assert values(spark, scoring.min_max(F.col("v"), F.lit(0.0), F.lit(10.0)), [(0.0,), (5.0,), (10.0,)], "v double") == [0.0, 50.0, 100.0]
    assert values(spark, scoring.min_max(F.col("v"), F.lit(3.0), F.lit(3.0)), [(3.0,)], "v double") == [50.0]


def test_unreadable_date_joins_the_velocity_population(spark):
    rows = [(0, "reddit", "a", "2024-01-30 23:00:00", "0"), (1, "reddit", "b", "2024-01-30 23:00:00", "100"),
            (2, "reddit", "c", "n/a", "7"), (3, "reddit", None, "n/a", "7"), (4, "news", "d", "", "0")]
    posts = clean_posts(spark.createDataFrame(rows, "seq long, source string, url string, created_at string, score string"))
    empty = spark.createDataFrame([], "url string, date date, score long")
    got = {r.url: r.trend_score for r in trend.score_trends(posts, empty, scoring.as_of_timestamp(NOW)).collect()}
    assert got == {"a": 0.0, "b": 100.0, "c": 50.0, None: 50.0, "d": 50.0}


def test_interest(spark):
    rows = [("k", f"2024-01-0{i} 00:00:00", v) for i, v in enumerate([10.0, 20.0, 30.0, 40.0], 1)] + [("one", "2024-01-01 00:00:00", 33.0)]
    series = spark.createDataFrame(rows, "keyword string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.keyword: r.interest for r in trend.interest_scores(series).collect()} == {"k": 75.0, "one": 33.0}


@pytest.mark.parametrize("scores, expected", [
    ([8, 9, 10, 10], (0, 1)), ([5, 5, 6], (1, 0)), ([10, 9], (0, 0)), ([7], (0, 0)),
    ([1005, 1000], (0, 1)), ([995, 1000], (1, 0)), ([1, 2, 3, 4], (3, 0)),
])
def test_score_runs(spark, scores, expected):
    rows = [("u", day(20 - i), s) for i, s in enumerate(scores)]
    row = history.score_runs(spark.createDataFrame(rows, "url string, date date, score long")).first()
    assert (row.days_losing, row.days_stale) == expected


def test_merge_history_is_idempotent(spark):
    schema = "url string, date date, score long"
    stored = spark.createDataFrame([("a", day(30), 5), ("a", day(31), 1), ("old", day(1), 1)], schema)
    seen = spark.createDataFrame([("a", day(31), 9)], schema)
    scored = spark.createDataFrame([("a", day(31), 7)], schema)
    today = scoring.as_of_day(NOW)
    once = history.merge_history(stored, today, 14, seen, scored)
    again = history.merge_history(once, today, 14, seen, scored)
    expected = {("a", day(30), 5), ("a", day(31), 7)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in again.collect()} == expected


def posts_of(spark, rows):
    return spark.createDataFrame(rows, "seq long, url string, source string, category string, trend_score double, created_at string")


def test_bucket_edges_and_top_n(spark):
    posts = posts_of(spark, [(0, "a", "news", "tech", 70.0, "1"), (1, "b", "news", "tech", 30.0, "1"), (2, "c", "news", "tech", 30.1, "1"), (3, "d", "news", "tech", None, "1")])
    got = {r.url: r.bucket for r in selection.top_per_bucket(posts).collect()}
    assert got == {"a": "rising", "b": "falling", "c": "new"}


def test_news_posts_use_up_curated_places(spark):
    posts = posts_of(spark, [(0, "n1", "news", "tech", 99.0, "1"), (1, "r1", "reddit", "tech", 80.0, "1")])
    assert tracking.curated_posts(posts, 1).count() == 0
    assert [r.url for r in tracking.curated_posts(posts, 2).collect()] == ["r1"]


def test_tracking_keeps_metadata_and_prunes(spark):
    schema = "url string, category string, source string, added_date date"
    tracked = spark.createDataFrame([("r1", "old", "reddit", day(1)), ("lost", "x", "reddit", day(1)), ("new", "x", "reddit", day(1))], schema)
    posts = posts_of(spark, [(0, "r1", "reddit", "tech", 80.0, "1"), (1, "r2", "reddit", "tech", 80.0, "1")])
    scores = spark.createDataFrame([("lost", day(20 + i), 9 - i) for i in range(4)], "url string, date date, score long")
    got = {(r.url, r.category, r.added_date) for r in tracking.update_tracked(tracked, posts, scores, scoring.as_of_day(NOW)).collect()}
    assert got == {("r1", "old", day(1)), ("new", "x", day(1)), ("r2", "tech", day(31))}


def test_refetch_matches_submission_ids(spark):
    tracked = spark.createDataFrame([("https://www.reddit.com/r/a/comments/X1/t/", "reddit"), ("https://www.reddit.com/r/a/", "reddit"), ("https://n.com/comments/X1/", "news")], "url string, source string")
    shots = spark.createDataFrame([("https://old.reddit.com/comments/X1/", day(3), 4)], "url string, date date, score long")
    assert [r.score for r in history.refetched_scores(tracked, shots).collect()] == [4]


def test_phrase_validity(spark):
    assert one(spark, text.is_valid_phrase(F.col("c")), "tax finance", "the deal", "abc", "solar farm") == [False, False, False, True]
    assert one(spark, text.is_valid_phrase(F.col("c"), False), "tax finance") == [True]


def test_ngrams_and_keywords(spark):
    words = text.words(F.col("c"))
    assert one(spark, text.ngrams(words, 2, 3), "a b c d", "a", "") == [["a b", "b c", "c d", "a b c", "b c d"], [], []]
    assert one(spark, text.ngrams(words, 1, 1), "a b") == [["a", "b"]]
    assert one(spark, keywords.simple_keywords(F.col("c"), F.lit("body words here")), "The élan of Solar-Farms and big SOLAR news", "of a", "") == ["Solar Farms SOLAR", "of a", "words body here"]


def test_word_pairs(spark):
    got = one(spark, graph.word_pairs(F.col("c")), "a1 b1 c1 d1")[0]
    assert [(p.a, p.b) for p in got] == [("a1", "b1"), ("a1", "c1"), ("b1", "c1"), ("b1", "d1"), ("c1", "d1")]


def test_ranked_key_phrases(spark):
    posts = spark.createDataFrame([("k", "solar farm output and solar farm, wind of change")], "post_key string, t string")
    got = [(r.phrase, r.score) for r in phrases.rake_phrases(posts, F.col("t")).orderBy("rank").collect()]
    # solar and farm: (3 + 2) / 2; output: 3; wind and change: 1.
    assert got == [("solar farm output", 8.0), ("solar farm", 5.0), ("wind", 1.0), ("change", 1.0)]


def test_phrase_assembly_repeats_single_words_only(spark):
    posts = spark.createDataFrame([("k", "grid grid grid", "", "", "tech", "news", 80.0)], "post_key string, title string, body string, keywords string, category string, source string, trend_score double")
    got = phrases.add_phrases(posts, use_rake=False).first().phrases
    assert got == ["grid grid", "grid grid grid", "grid", "grid", "grid"]


def phrased(spark, rows):
    return spark.createDataFrame(rows, "category string, source string, trend_score double, phrases array<string>, entities array<string>")


def test_topic_scores_by_scope(spark):
    posts = phrased(spark, [("tech", "news", 100.0, ["solar farm", "wind park"], ["wind park"]), ("tech", "reddit", 75.0, ["solar farm"], []), ("health", "news", 10.0, ["solar farm", "wind park"], ["solar farm"])])
    got = {(r.scope, r.scope_key, r.term): r.score for r in topics.ranked_topics(posts).collect()}
    assert got[("all", "", "solar farm")] == pytest.approx(1.5 / (1 + 3 / 2))
    assert got[("all", "", "wind park")] == pytest.approx(2 * 1.0 / (1 + 2 / 2))
    assert got[("category", "tech", "solar farm")] == pytest.approx(1.5 / (1 + 2 / 2))
    assert got[("source", "news", "solar farm")] == pytest.approx(1.0 / (1 + 2 / 1))
    assert ("source", "reddit", "solar farm") not in got          # 0.5 is under the minimum of 1


def test_equal_scores_rank_by_length_preference(spark):
    terms = ["gridline", "bb farm", "aa solar farm park", "cc1 dd2 ee3 ff4 gg5"]
    posts = phrased(spark, [("tech", "news", 100.0, terms, [])])
    got = [r.term for r in topics.ranked_topics(posts).where("scope = 'all'").orderBy("rank").collect()]
    assert got == ["cc1 dd2 ee3 ff4 gg5", "aa solar farm park", "bb farm", "gridline"]


def ranked(spark, terms):
    rows = [("all", "", i, t, s) for i, (t, s) in enumerate(terms, 1)]
    return spark.createDataFrame(rows, "scope string, scope_key string, rank int, term string, score double")


def test_superset_terms_are_dropped(spark):
    a, b = ("solar farm", 2.0), ("big solar farm", 1.0)
    def names(df): return [r.term for r in df.orderBy("rank").collect()]
    assert names(topics.drop_supersets(ranked(spark, [a, b]))) == ["solar farm"]
    assert names(topics.drop_supersets(ranked(spark, [b, a]))) == ["big solar farm", "solar farm"]
    one_only = topics.TopicOptions(top_n=1)
    assert names(topics.drop_supersets(ranked(spark, [("x", 3.0), a]), one_only)) == ["x"]


def greedy_mmr(terms, n, weight=0.7):
    def sim(a, b): return len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    left, picked = list(terms), []
    while left and len(picked) < n:
        best = max(left, key=lambda t: round(weight * t[1] - (1 - weight) * max([sim(t[0], p[0]) for p in picked], default=0), 12))
        left.remove(best)
        picked.append(best)
    return [t for t, _ in picked]


def test_diversity_matches_brute_force(spark):
    terms = [(f"w{i % 5} v{i % 3} u{i % 7}", 1.0 - i / 50) for i in range(15)]
    got = topics.diversify(ranked(spark, terms), 6).orderBy("rank").collect()
    assert [r.term for r in got] == greedy_mmr(terms, 6)
    same = topics.diversify(ranked(spark, terms), 15).orderBy("rank").collect()
    assert [r.term for r in same] == [t for t, _ in terms]


def test_burst(spark):
    rows = [(day(10), "a", 3), (day(10), "b", 3), (day(9), "a", 1), (day(11), "a", 1)] + [(day(i), "x", 1) for i in range(1, 9)]
    hist = spark.createDataFrame(rows, "date date, term string, cnt long")
    target = F.lit("2024-01-10").cast("date")
    assert {r.term: round(r.pct_change) for r in burst.burst_topics(hist, target).collect()} == {"a": 20, "b": 500}
    assert {r.term: round(r.pct_change) for r in burst.burst_topics(hist, target, past_only=True).collect()} == {"a": 100, "b": 500}
    assert {r.term: round(r.pct_change) for r in burst.burst_topics(hist, target, baseline_days=1).collect()} == {"a": 100, "b": 500}


def test_sentiment_edges_and_shares(spark):
    assert values(spark, scoring.sentiment_label(F.col("v")), [(0.02,), (-0.02,), (0.019,)], "v double") == ["positive", "negative", "neutral"]
    posts = spark.createDataFrame([("t", "news")] * 7 + [("t", "reddit")] * 9 + [("u", "news")], "category string, source string")
    got = {(r.category, r.source): r.share_pct for r in report.share_of_voice(posts).collect()}
    assert got == {("t", "news"): 43.8, ("t", "reddit"): 56.2, ("u", "news"): 100.0}


def test_planted_cliques_are_found(spark):
    def clique(words): return [(a, b, 5) for i, a in enumerate(words) for b in words[i + 1:]]
    left, right = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(4)]
    edges = spark.createDataFrame(clique(left) + clique(right) + [("a0", "b0", 1)], "src string, dst string, weight long")
    found = graph.cluster_report(edges, graph.communities(edges)).orderBy("cluster_rank").collect()
    assert [(r.size, sorted(r.words)) for r in found] == [(5, left), (4, right)]
    assert found[0].words[0] == "a0"


def test_display_formats(spark):
    assert one(spark, text.title_case(F.col("c")), "solar farm") == ["Solar Farm"]
    assert values(spark, text.signed_percent(F.col("v")), [(500.0,), (-2.5,)], "v double") == ["+500%", "-2%"]
    assert one(spark, text.ellipsis(F.col("c"), 3), "abcd", "abc") == ["abc...", "abc"]


def test_communities_with_small_gains(spark):
    # the loop holds nearly all weight, so each merge gains far less than 0.001 modularity
    left, right = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    rows = [(a, b, 1) for words in (left, right) for i, a in enumerate(words) for b in words[i + 1:]] + [("z", "z", 100000)]
    groups = {}
    for r in graph.communities(spark.createDataFrame(rows, "src string, dst string, weight int")).collect():
        groups.setdefault(r.comm, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [left, right, ["z"]]
