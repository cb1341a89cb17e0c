"""Registered queries: (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fields import parse_time, stable_id, submission_id
from ..functions.scoring import as_of_day, as_of_timestamp
from ..functions.text import ellipsis, signed_percent, strip_markup, title_case
from ..operators import report
from ..operators.burst import burst_topics, keyword_counts
from ..operators.clean import KEY, clean_posts, union_sources
from ..operators.graph import cluster_report, communities, cooccurrence_edges, modularity, node_degrees, topic_clusters
from ..operators.history import (
    day_scores, growth_by_url, merge_history, refetched_scores, retain, score_runs, unique_scores,
)
from ..operators.keywords import add_keywords
from ..operators.model import classify_with_model
from ..operators.tagging import add_chunk_keywords, add_noun_chunks
from ..operators.valence import add_shifted_sentiment
from ..operators.lexicon import add_entities, add_sentiment, classify_posts, ensure_sentiment
from ..operators.phrases import add_phrases, add_phrases_among, rake_phrases, spread_by_text
from ..operators import runs
from ..operators.selection import post_table, top_per_bucket
from ..operators.topics import diversify, drop_supersets, ranked_topics
from ..operators.tracking import curated_posts, update_tracked
from ..operators.trend import interest_scores, score_trends
from ..functions.text import join_text
from ..plans import daily
from ..schema import POST_COLUMNS, RISING_THRESHOLD, SCORE_RETENTION_DAYS, conform
from ..sources.landing import feed_posts, forum_posts, news_articles, with_fallback
from ..sources.commit import DayLake
from ..sources.scratch import Scratch, ensure_checkpoint_dir
from ..sources.tables import (
    POSTS, RAW, SCORES, TRACKED, Lake, land_raw, listed_days, stale_days as days_to_process, keyword_history_from_json, read_raw_csv, write_csv, keyword_history_to_json, readiness, tracked_from_json, tracked_to_json,
)
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = datetime.fromisoformat(views.AS_OF)
DIGITS = 6
_PHRASED = ("url", "category", "source", "created_at", "trend_score", "phrases", "entities")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _now() -> Column:
    return as_of_timestamp(NOW)


def _today() -> Column:
    return as_of_day(NOW)


class Tables:
    """The derived input tables of one scale folder, as lazy frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._held: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of a plan read, written once as the daily run has it."""
        if name not in self._held:
            self._held[name] = Scratch(self.spark).save(make())
        return self._held[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    def raw_posts(self) -> DataFrame:
        return self.sql(views.RAW_POSTS, documents=self.table("documents")).withColumn(
            "landing_rank", F.lit(0)
        )

    def clean(self) -> DataFrame:
        return clean_posts(self.raw_posts())

    def cleaned(self) -> DataFrame:
        return self._once("cleaned", self.clean)

    def history(self) -> DataFrame:
        return self._once("history", lambda: unique_scores(self.sql(
            views.POST_SCORES, raw_posts=self.raw_posts().select("url", "seq", "source"),
            events=self.table("events"),
        )))

    def interest(self) -> DataFrame:
        news = add_keywords(self.cleaned().where(F.col("source") == "news"))
        series = self.sql(
            views.SEARCH_INTEREST, news_keywords=news.select("keywords", "seq"),
            events=self.table("events"),
        )
        return interest_scores(series)

    def category_lexicon(self) -> DataFrame:
        return self.sql(views.CATEGORY_LEXICON)

    def valence_lexicon(self) -> DataFrame:
        return self.sql(views.VALENCE_LEXICON)

    def shifters(self) -> DataFrame:
        return self.sql(views.SHIFTERS)

    def tag_lexicon(self) -> DataFrame:
        return self.sql(views.TAG_LEXICON)

    def tag_moves(self) -> DataFrame:
        return self.sql(views.TAG_MOVES)

    def gazetteer(self) -> DataFrame:
        return self.sql(views.GAZETTEER)

    def tracked(self) -> DataFrame:
        return self.sql(views.TRACKED, raw_posts=self.raw_posts().select("url", "subreddit", "source"))

    def snapshots(self) -> DataFrame:
        return self.sql(views.SNAPSHOTS, documents=self.table("documents"))

    def classified(self) -> DataFrame:
        return classify_posts(self.clean(), self.category_lexicon(), ("title", "body"))

    def scored(self) -> DataFrame:
        """Classified posts with keywords and trend score (growth and velocity; news flat)."""
        posts = classify_posts(self.cleaned(), self.category_lexicon(), ("title", "body"))
        return score_trends(posts, self.history(), _now())

    def posts(self) -> DataFrame:
        """Fully enriched posts."""
        return add_sentiment(self.scored(), self.valence_lexicon()).withColumn(
            "date", F.to_date(parse_time(F.col("created_at")))
        )

    def phrased(self) -> DataFrame:
        """What topics need of the scored posts. Phrases are many times the text, so they are computed where
        they are read, from posts that are written once."""
        return self._phrases_of(self._with_entities())

    def phrased_among(self, terms: list[str]) -> DataFrame:
        """`phrased`, but phrases that are none of the terms may be missing."""
        return add_phrases_among(self._with_entities(), terms).select(*_PHRASED)

    def _with_entities(self) -> DataFrame:
        return self._once("with_entities", lambda: add_entities(self.scored(), self.gazetteer()).select(
            "url", "category", "source", "created_at", "trend_score", "title", "body", "keywords", "entities"))

    def rising_phrased(self) -> DataFrame:
        """`phrased` of the rising posts alone."""
        scored = score_trends(self.cleaned(), self.history(), _now(), keywords=False)
        rising = Scratch(self.spark).save(scored.where(F.col("trend_score") >= RISING_THRESHOLD))
        known = classify_posts(add_keywords(rising), self.category_lexicon(), ("title", "body"))
        return self._phrases_of(spread_by_text(add_entities(known, self.gazetteer()), rising))

    def _phrases_of(self, posts: DataFrame) -> DataFrame:
        return add_phrases(posts).select(*_PHRASED)


def _rounded(*names: str) -> list[Column]:
    return [F.round(n, DIGITS).alias(n) for n in names]


# --- cleaning and landing -------------------------------------------------------------


@query
def clean_raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).clean().select(
        "seq", "source", "url", "title", "body", "created_at", "score", "subreddit", "author"
    )


@query
def html_strip_pages(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).table("pages").select("page_id", strip_markup(F.col("html")).alias("text"))


@query
def post_id_and_ref(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    urls = tables.raw_posts().select("url").unionByName(tables.table("pages").select("url"))
    return urls.select(
        "url", stable_id("news", F.col("url")).alias("id"), submission_id(F.col("url")).alias("ref")
    )


@query
def land_submissions(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return forum_posts(_submissions(tables)).drop("subreddit")


def _submissions(tables: Tables) -> DataFrame:
    return tables.sql(views.SUBMISSIONS, documents=tables.table("documents"))


def _responses(tables: Tables, category: str) -> DataFrame:
    posts = tables.raw_posts()
    article = F.struct(
        F.when(F.col("source") != "blog", F.col("url")).alias("url"),
        F.col("created_at").alias("publishedAt"), "title", "author",
        F.col("body").alias("description"),
    )
    return posts.select("seq", F.lit(category).alias("category"), F.array(article, article).alias("articles"))


@query
def land_articles(spark: SparkSession, folder: str) -> DataFrame:
    return news_articles(_responses(Tables(spark, folder), "science"), _now()).drop(
        "score", "subreddit"
    )


def _entries(tables: Tables) -> DataFrame:
    return tables.sql(views.RSS_ENTRIES, pages=tables.table("pages"))


@query
def rss_first_n_per_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_posts(_entries(Tables(spark, folder)), _now()).select(
        "id", "title", "url", "created_at", "author", "body"
    )


@query
def source_fallback(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    feeds = feed_posts(_entries(tables), _now(), per_feed=None)
    filled = news_articles(_responses(tables, "science"), _now())
    empty = news_articles(_responses(tables, "weather"), _now())   # no such news category
    return with_fallback(filled, feeds).select(F.lit("filled").alias("primary"), "url").unionByName(
        with_fallback(empty, feeds).select(F.lit("empty").alias("primary"), "url")
    )


@query
def day_readiness(spark: SparkSession, folder: str) -> DataFrame:
    raw = Tables(spark, folder).raw_posts().withColumn("date", F.substring("created_at", 1, 10))
    return readiness(raw).select("date", "n_sources", F.col("ready").cast("int").alias("ready"))


# --- trend ------------------------------------------------------------------------------


@query
def velocity_trend(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    scored = score_trends(tables.clean(), tables.history().limit(0), _now(), keywords=False)
    return scored.select("url", "source", *_rounded("trend_score"))


@query
def growth_trend(spark: SparkSession, folder: str) -> DataFrame:
    return growth_by_url(Tables(spark, folder).history()).select("url", *_rounded("growth_score"))


@query
def interest_trend(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).interest().select("keyword", *_rounded("interest"))


@query
def trend_score(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    scored = score_trends(tables.cleaned(), tables.history(), _now(), tables.interest())
    return scored.select("url", "source", "keywords", *_rounded("trend_score"))


@query
def buckets_per_category(spark: SparkSession, folder: str) -> DataFrame:
    top = top_per_bucket(Tables(spark, folder).posts())
    return top.select("category", "bucket", "rank", "url", *_rounded("trend_score"))


@query
def buckets_overall(spark: SparkSession, folder: str) -> DataFrame:
    top = top_per_bucket(Tables(spark, folder).scored(), by_category=False)
    return top.select(
        "bucket", "rank", "url", ellipsis(F.col("title")).alias("headline"),
        F.bround("trend_score", 0).cast("bigint").alias("trend"),
    )


# --- history and tracking -----------------------------------------------------------------


@query
def history_merge(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    merged = merge_history(
        tables.history(), _today(), 14, refetched_scores(tables.tracked(), tables.snapshots()),
        day_scores(tables.clean(), _today()),
    )
    return merged.select("url", F.col("date").cast("string").alias("date"), "score")


@query
def refetch_tracked(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return refetched_scores(tables.tracked(), tables.snapshots()).select(
        "url", F.col("date").cast("string").alias("date"), "score"
    )


@query
def losing_stale(spark: SparkSession, folder: str) -> DataFrame:
    return score_runs(Tables(spark, folder).history())


@query
def track_update(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    history = retain(tables.history(), _today(), SCORE_RETENTION_DAYS)
    updated = update_tracked(tables.tracked(), tables.scored(), history, _today())
    return updated.select("url", "category", "source", F.col("added_date").cast("string").alias("added_date"))


@query
def curated(spark: SparkSession, folder: str) -> DataFrame:
    return curated_posts(Tables(spark, folder).scored(), 5)


@query
def tracked_json(spark: SparkSession, folder: str) -> DataFrame:
    back = tracked_from_json(tracked_to_json(Tables(spark, folder).tracked()))
    return back.select("url", "category", "source", F.col("added_date").cast("string").alias("added_date"))


# --- reports --------------------------------------------------------------------------------


@query
def kpis(spark: SparkSession, folder: str) -> DataFrame:
    return report.kpis(Tables(spark, folder).scored()).withColumn(
        "avg_trend", F.round("avg_trend", DIGITS)
    )


@query
def trend_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return report.trend_histogram(Tables(spark, folder).scored())


@query
def sentiment_counts(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return report.sentiment_counts(add_sentiment(tables.clean(), tables.valence_lexicon()))


@query
def sentiment_by_category(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return report.sentiment_by_category(add_sentiment(tables.classified(), tables.valence_lexicon()))


@query
def share_of_voice(spark: SparkSession, folder: str) -> DataFrame:
    return report.share_of_voice(Tables(spark, folder).classified())


@query
def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return report.daily_rollup(Tables(spark, folder).posts()).withColumn(
        "date", F.col("date").cast("string")
    )


@query
def categories(spark: SparkSession, folder: str) -> DataFrame:
    return report.categories(Tables(spark, folder).classified())


@query
def filtered_table(spark: SparkSession, folder: str) -> DataFrame:
    table = post_table(Tables(spark, folder).posts(), source="reddit", sentiment="positive")
    return table.withColumn("trend_score", F.round("trend_score", DIGITS))


@query
def newest_table(spark: SparkSession, folder: str) -> DataFrame:
    table = post_table(Tables(spark, folder).posts(), category="politics", sort_by="created_at")
    return table.select("title", "source", "category", "sentiment_label", "score")


# --- text -------------------------------------------------------------------------------------


@query
def classify(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).classified().select("url", "category")


@query
def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    turns = tables.table("conversations").withColumn("body", F.lit(""))
    scored = add_sentiment(turns, tables.valence_lexicon(), title_col="text")
    return scored.select("conv_id", "turn", "sentiment_score", "sentiment_label")


@query
def keywords(spark: SparkSession, folder: str) -> DataFrame:
    return add_keywords(Tables(spark, folder).clean()).select("url", "keywords")


@query
def entity_keywords(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return add_keywords(add_entities(tables.clean(), tables.gazetteer())).select("url", "keywords")


@query
def noun_chunks(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return add_noun_chunks(tables.clean(), tables.tag_lexicon(), tables.tag_moves()).select(
        "url", F.size("noun_chunks").alias("n_chunks"), F.md5(F.array_join("noun_chunks", "|")).alias("chunks_digest"),
        F.size("nouns").alias("n_nouns"), F.md5(F.array_join("nouns", "|")).alias("nouns_digest"))


@query
def chunk_keywords(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    posts = add_entities(tables.clean(), tables.gazetteer())
    return add_chunk_keywords(posts, tables.tag_lexicon(), tables.tag_moves()).select("url", "keywords")


def _counting_model() -> Callable[[list[str], list[str]], list[str]]:
    """A model that can be told in SQL: by the title's length and letters; it fails on some titles and
    knows a label that is no category."""
    def choose(texts: list[str], categories: list[str]) -> list[str]:
        if any("zz" in t for t in texts):
            raise ValueError("a title that the model can't read")
        return ["unknown" if len(t) % 11 == 0 else categories[(len(t) + t.count("e")) % len(categories)] for t in texts]

    return choose


@query
def classify_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return classify_with_model(Tables(spark, folder).clean(), _counting_model).select("url", "category")


@query
def shifted_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    scored = add_shifted_sentiment(tables.clean(), tables.valence_lexicon(), tables.shifters())
    return scored.select("url", "sentiment_score", "sentiment_label")


@query
def entities(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return add_entities(tables.clean(), tables.gazetteer()).select(
        "url", F.explode("entities").alias("entity")
    )


@query
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Per post the number of phrases and a digest of the sorted list, repeats included."""
    found = Tables(spark, folder).phrased()
    return found.select(
        "url", F.size("phrases").cast("bigint").alias("n"),
        F.md5(F.array_join(F.sort_array("phrases"), "|")).alias("digest"),
    )


@query
def ranked_key_phrases(spark: SparkSession, folder: str) -> DataFrame:
    posts = Tables(spark, folder).clean()
    ranked = rake_phrases(posts.select(KEY, "title", "body"), join_text(F.col("title"), F.col("body")))
    return ranked.select(F.col(KEY).alias("post"), "rank", "phrase", *_rounded("score"))


# --- topics -----------------------------------------------------------------------------------


def _ranked_topics(tables: Tables) -> DataFrame:
    return ranked_topics(tables.phrased(), among=tables.phrased_among)


@query
def emerging_topics(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked_topics(Tables(spark, folder))


@query
def emerging_topics_deduped(spark: SparkSession, folder: str) -> DataFrame:
    return drop_supersets(_ranked_topics(Tables(spark, folder)))


@query
def mmr_topics(spark: SparkSession, folder: str) -> DataFrame:
    return diversify(_ranked_topics(Tables(spark, folder)))


def _keyword_history(tables: Tables) -> DataFrame:
    return keyword_counts(
        tables.rising_phrased(), F.to_date(parse_time(F.col("created_at")))
    ).where("date is not null")


@query
def keyword_history(spark: SparkSession, folder: str) -> DataFrame:
    return _keyword_history(Tables(spark, folder)).withColumn("date", F.col("date").cast("string"))


@query
def keyword_history_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyword_history_to_json(_keyword_history(Tables(spark, folder)))
    back = rows.select(F.from_json("value", "date string, term string, cnt bigint").alias("r"))
    nested = back.select(
        F.to_json(F.create_map("r.date", F.create_map("r.term", "r.cnt"))).alias("value")
    )
    days = keyword_history_from_json(nested)
    return days.groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("terms"), F.sum("cnt").alias("cnt")
    )


def _stored_keyword_history(tables: Tables) -> DataFrame:
    """The history as the daily run stores it: written once, read by date."""
    return Scratch(tables.spark).save(_keyword_history(tables))


@query
def burst(spark: SparkSession, folder: str) -> DataFrame:
    history = _stored_keyword_history(Tables(spark, folder))
    found = burst_topics(history, as_of_day(views.BURST_DAY))
    return found.select(
        title_case(F.col("term")).alias("topic"), "today_count", *_rounded("pct_change"),
        signed_percent(F.col("pct_change")).alias("shown"),
    )


@query
def burst_past_only(spark: SparkSession, folder: str) -> DataFrame:
    history = _stored_keyword_history(Tables(spark, folder))
    return burst_topics(history, as_of_day(views.BURST_DAY), top_n=None, past_only=True).select(
        "term", "today_count", *_rounded("pct_change")
    )


@query
def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence_edges(Tables(spark, folder).rising_phrased())


@query
def cooccurrence_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return node_degrees(cooccurrence_edges(Tables(spark, folder).rising_phrased()))


@query
def cluster_report_given_members(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster report for a known membership: words with the same first letter."""
    edges = Scratch(spark).save(cooccurrence_edges(Tables(spark, folder).rising_phrased()))
    words = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    members = words.withColumn("comm", F.substring("node", 1, 1))
    return cluster_report(edges, members).select("cluster_rank", "size", F.array_join("words", " ").alias("words"))


@query
def land_day_again(spark: SparkSession, folder: str) -> DataFrame:
    """The raw rows of a day after a second landing that empties one of its two sources."""
    tables = Tables(spark, folder)
    lake = Lake(spark, f"{ensure_checkpoint_dir(spark)}/lake-{uuid.uuid4().hex}")
    news = _responses(tables, "science")
    daily.collect_day(lake, NOW, _submissions(tables), news)
    daily.collect_day(lake, NOW, _submissions(tables).limit(0), news)
    return lake.raw().select("source", "url", "created_at", "seq", "pos")


def _new_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/lake-{uuid.uuid4().hex}"


def _landed(tables: Tables, lake: Lake) -> Lake:
    """The lake with all raw posts as one day's rows."""
    land_raw(lake, [tables.raw_posts().drop("landing_rank").withColumn("id", F.col("url"))], NOW, ["reddit", "news", "blog"])
    return lake


def _state(lake: Lake) -> DataFrame:
    """The posts and scores of a lake, as text rows."""
    posts = lake.posts().select(
        F.lit("posts").alias("kind"), "url", F.concat_ws("|", "category", "keywords", "sentiment_label").alias("value"),
        F.round("trend_score", DIGITS).alias("number"))
    scores = lake.scores().select(F.lit("scores").alias("kind"), "url", F.col("date").cast("string").alias("value"),
                                  F.col("score").cast("double").alias("number"))
    return posts.unionByName(scores)


def _inputs(tables: Tables) -> daily.Inputs:
    return daily.Inputs(categories=tables.category_lexicon(), valence=tables.valence_lexicon())


@query
def process_day_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Stored posts and scores of a day that was processed twice."""
    tables = Tables(spark, folder)
    lake = _landed(tables, Lake(spark, _new_root(spark)))
    for _ in range(2):
        if daily.process_day(lake, NOW, _inputs(tables)) != daily.OK:
            raise RuntimeError("the day was not processed")
    return _state(lake)


class _Dies(DayLake):
    """A lake whose run dies when it writes a table."""

    fatal: str | None = None

    def write(self, df: DataFrame, table: str, *partition_by: str) -> None:
        if table == self.fatal:
            raise ConnectionError(f"lost at {table}")
        super().write(df, table, *partition_by)


@query
def day_after_a_dead_run(spark: SparkSession, folder: str) -> DataFrame:
    """Stored posts and scores of a day, after a second run with other inputs died between two tables."""
    tables = Tables(spark, folder)
    lake = _Dies(spark, _new_root(spark))
    _landed(tables, lake)
    daily.process_day(lake, NOW, _inputs(tables))
    lake.fatal = TRACKED
    try:
        daily.process_day(lake, NOW, daily.Inputs())
    except ConnectionError:
        return _state(DayLake(spark, lake.root))
    raise RuntimeError("the run did not die")


@query
def day_list(spark: SparkSession, folder: str) -> DataFrame:
    """The days of a stored table, by the time their files were written, and whether its folders tell the same."""
    tables = Tables(spark, folder)
    lake = Lake(spark, _new_root(spark))
    posts = tables.clean().withColumn("date", F.to_date(parse_time(F.col("created_at")))).where("date is not null")
    lake.write(posts.select("url", "date"), POSTS, "date")
    days = lake.partitions(POSTS, "date")
    listed = listed_days(spark.read.parquet(lake.path(POSTS)))
    return listed.select(F.col("date").cast("string").alias("date"), F.col("date").isin(days).cast("int").alias("has_folder"))


@query
def kept_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Score rows of a table after its days before a date were dropped."""
    tables = Tables(spark, folder)
    lake = Lake(spark, _new_root(spark))
    lake.write(tables.history(), SCORES, "date")
    lake.drop_before(SCORES, "date", datetime(2024, 1, 10).date())
    return lake.scores().groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("n"), F.sum("score").alias("score"))


@query
def stale_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose posts are missing or older than their raw rows: those that were never processed, and
    those that landed again."""
    tables = Tables(spark, folder)
    lake = Lake(spark, _new_root(spark))
    rows = tables.raw_posts().withColumn("date", F.to_date(parse_time(F.substring("created_at", 1, 10)))).where("date is not null")
    rows = rows.select("url", "date")
    lake.write(rows, RAW, "date")
    lake.write(rows.where("day(date) % 2 = 0"), POSTS, "date")
    lake.write(rows.where("day(date) % 3 = 0"), RAW, "date")
    found = days_to_process(*(spark.read.parquet(lake.path(t)) for t in (RAW, POSTS)))
    return found.select(F.col("date").cast("string").alias("date"), F.col("stale").cast("int").alias("stale"))


@query
def losing_stale_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """losing_stale from summaries of weeks, merged in an order that is not that of time."""
    days = Scratch(spark).save(runs.one_day(Tables(spark, folder).history()).withColumn(
        "week", F.floor(F.datediff("summary.first_date", F.lit("2023-01-02").cast("date")) / 7) % 4))
    weeks = [days.where(F.col("week") == w).drop("week") for w in range(4)]
    return runs.days_of(runs.merged(*(weeks[w] for w in (2, 0, 3, 1))))


@query
def ensured_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiment for a batch that has none and whose urls are partly null."""
    tables = Tables(spark, folder)
    posts = tables.clean().drop("post_key", "sentiment_score", "sentiment_label").withColumn("url", F.when(F.col("seq") % 3 > 0, F.col("url")))
    return ensure_sentiment(posts, tables.valence_lexicon()).select("seq", "sentiment_score", "sentiment_label")


@query
def union_in_landing_order(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of the same urls: the one that landed first wins, though its rows come last."""
    raw = Tables(spark, folder).raw_posts().drop("landing_rank")
    first = raw.where("seq % 2 = 0").withColumn("title", F.lit("first"))
    second = raw.withColumn("title", F.lit("second"))
    return clean_posts(union_sources(first, second)).select("url", "title", "landing_rank")


@query
def conformed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A batch that has only ids and urls, filled up to the post schema."""
    bare = Tables(spark, folder).raw_posts().select("seq", "url")
    return conform(bare).select("seq", "url", "source", "title", "score", "body", "trend_score", "category")


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Raw posts written as CSV and read back: quotes and line breaks survive."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(Tables(spark, folder).raw_posts().withColumn("id", F.col("seq")).select(*POST_COLUMNS), path)
    return read_raw_csv(spark, path).select(
        F.col("id").cast("bigint").alias("id"), "source", "url", "score",
        F.length(F.coalesce("title", F.lit(""))).cast("bigint").alias("title_length"), F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"))


@query
def cluster_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Of the communities of the word graph: nodes, members and distinct members, and whether modularity is
    at least that of single words."""
    edges = Scratch(spark).save(cooccurrence_edges(Tables(spark, folder).rising_phrased()))
    members = communities(edges)
    alone = node_degrees(edges).select(F.col("word").alias("node"), F.col("word").alias("comm"))
    better = modularity(edges, members) >= modularity(edges, alone) - 1e-9
    return members.agg(F.count("*").alias("members"), F.countDistinct("node").alias("nodes"),
                       F.lit(int(better)).alias("no_worse_than_single"))


@query
def topic_cluster_words(spark: SparkSession, folder: str) -> DataFrame:
    found = topic_clusters(Tables(spark, folder).rising_phrased())
    return found.select("cluster_rank", "size", F.array_join("words", " ").alias("words"))
