"""Emerging topics: overall, per category and per source, in one aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import rising_weight, topic_score
from ..functions.text import explode_once, jaccard, word_count
from ..schema import (
    ENTITY_BOOST, MMR_LAMBDA, RISING_THRESHOLD, TOPICS_OVERALL, TOPICS_PER_CATEGORY,
    TOPICS_PER_SOURCE,
)
from ..sources.scratch import Scratch
from .joins import salted_lookup
from .phrases import valid_phrases

ALL, CATEGORY, SOURCE = "all", "category", "source"
CANDIDATE_FACTOR = 3   # fixed value: candidates looked at per wanted topic
LOOKED_AT = 10_000     # terms of a scope that are counted in all posts first; no bound on the result
HELD_CHARS = 16_000_000   # terms of no more characters, with ROW_CHARS for each, go to the tasks that make phrases
ROW_CHARS = 50

Among = Callable[[list[str]], DataFrame]


@dataclass(frozen=True)
class TopicOptions:
    threshold: float = RISING_THRESHOLD
    top_n: int = TOPICS_OVERALL
    top_n_category: int = TOPICS_PER_CATEGORY
    top_n_source: int = TOPICS_PER_SOURCE
    min_count: float = 1.0
    min_count_category: float = 0.5
    min_count_source: float = 1.0
    trend_weight: bool = True
    damping: bool = True
    entity_boost: float = ENTITY_BOOST
    block_substrings: bool = True


def _per_scope(options: TopicOptions, name: str) -> Column:
    overall, category, source = (
        getattr(options, name + suffix) for suffix in ("", "_category", "_source")
    )
    return (
        F.when(F.col("scope") == CATEGORY, F.lit(category))
        .when(F.col("scope") == SOURCE, F.lit(source))
        .otherwise(F.lit(overall))
    )


def rising_totals(posts: DataFrame, threshold: float = RISING_THRESHOLD) -> DataFrame:
    """(scope, scope_key, n_rising) for the scopes the posts have, whatever their categories are."""
    scope = lambda kind, key: F.struct(F.lit(kind).alias("scope"), key.alias("scope_key"))
    scopes = F.array(scope(ALL, F.lit("")), scope(CATEGORY, F.col("category")), scope(SOURCE, F.col("source")))
    return posts.where(F.col("trend_score") >= threshold).select(F.explode(scopes).alias("s")).groupBy(
        "s.scope", "s.scope_key"
    ).agg(F.count("*").alias("n_rising"))


def _by_scope(terms: DataFrame, *sums: Column) -> DataFrame:
    """Rows of (category, source, term, ...) summed up for each term in each scope."""
    grouped = terms.groupingSets(
        [["term"], ["category", "term"], ["source", "term"]], "category", "source", "term"
    ).agg(*sums, F.grouping("category").alias("_no_category"), F.grouping("source").alias("_no_source"))
    scope = (
        F.when(F.col("_no_category") == 0, F.lit(CATEGORY))
        .when(F.col("_no_source") == 0, F.lit(SOURCE))
        .otherwise(F.lit(ALL))
    )
    key = F.when(F.col("_no_category") == 0, F.col("category")).when(
        F.col("_no_source") == 0, F.col("source")
    ).otherwise(F.lit(""))
    return grouped.withColumns({"scope": scope, "scope_key": key}).drop(
        "category", "source", "_no_category", "_no_source"
    ).where(F.col("scope_key").isNotNull())


def rising_statistics(posts: DataFrame, options: TopicOptions = TopicOptions()) -> DataFrame:
    """(scope, scope_key, term, rise, seen, is_entity) of the rising posts' terms, for all scopes; `seen`
    counts their occurrences in rising posts. Terms below a scope's least count are left out.

    Grouping sets expand in the map task and combine there before the only shuffle.
    """
    trend = F.col("trend_score")
    weight = rising_weight(trend, options.threshold) if options.trend_weight else F.lit(1.0)
    # A rising post's entities ride along as rows that count nowhere but mark their term.
    occurrences = F.concat(
        F.transform(
            valid_phrases("phrases", options.block_substrings),
            lambda p: F.struct(p.alias("term"), F.lit(0).alias("entity")),
        ),
        F.transform("entities", lambda e: F.struct(e.alias("term"), F.lit(1).alias("entity"))),
    )
    rising = posts.where(trend >= options.threshold)
    seen = explode_once(rising, ["category", "source", weight.alias("_rise")], occurrences, "s").select(
        "category", "source", "_rise", "s.term", "s.entity"
    )
    return _by_scope(
        seen,
        F.sum(F.when(F.col("entity") == 0, F.col("_rise")).otherwise(0.0)).alias("rise"),
        F.count_if(F.col("entity") == 0).alias("seen"),
        (F.max("entity") == 1).alias("is_entity"),
    ).where((F.col("rise") > 0) & (F.col("rise") >= _per_scope(options, "min_count")))


def _occurrences(posts: DataFrame, terms: DataFrame, among: Among | None = None) -> DataFrame:
    """(category, source, term, n): how often all posts have the terms, which are valid phrases."""
    if among is not None:
        wanted = terms.select("term").distinct()
        if wanted.agg(F.coalesce(F.sum(F.length("term") + ROW_CHARS), F.lit(0))).first()[0] <= HELD_CHARS:
            posts = among([r.term for r in wanted.collect()])
    said = explode_once(posts, ["category", "source"], F.col("phrases"), "phrase").select(
        "category", "source", F.trim(F.lower("phrase")).alias("term")
    )
    return said.join(terms.select("term").distinct(), "term", "left_semi").groupBy(
        "category", "source", "term"
    ).agg(F.count("*").alias("n"))


def _score(everywhere: str, options: TopicOptions) -> Column:
    n_rising = F.coalesce("n_rising", F.lit(0))
    return F.round(
        topic_score(
            F.col("rise"), F.col(everywhere), n_rising, F.col("is_entity"), options.damping, options.entity_boost,
        ),
        9,
    )


def length_preference(term: Column) -> Column:
    """Tie rule between equal scores: 2-3 words first-rate, else 4 minus the word count."""
    n = word_count(term)
    return F.when(n.between(2, 3), F.lit(0)).otherwise(F.lit(4) - n)


def _by_rank(score: str) -> Window:
    return Window.partitionBy("scope", "scope_key").orderBy(
        F.col(score).desc(), length_preference(F.col("term")), "term"
    )


def _ranked(candidates: DataFrame, occurrences: DataFrame, options: TopicOptions) -> DataFrame:
    """The top 3 x N of the candidates of each scope. The rank filter is applied in each task before rows
    of one scope meet."""
    everywhere = _by_scope(occurrences, F.sum("n").alias("everywhere"))
    scored = candidates.join(everywhere, ["scope", "scope_key", "term"]).withColumn("score", _score("everywhere", options))
    widest = CANDIDATE_FACTOR * max(options.top_n, options.top_n_category, options.top_n_source)
    return scored.withColumn("rank", F.row_number().over(_by_rank("score"))).where(
        (F.col("rank") <= widest) & (F.col("rank") <= CANDIDATE_FACTOR * _per_scope(options, "top_n"))
    ).select("scope", "scope_key", "rank", "term", "score")


def ranked_topics(
    posts: DataFrame, options: TopicOptions = TopicOptions(), looked_at: int = LOOKED_AT, among: Among | None = None,
) -> DataFrame:
    """(scope, scope_key, rank, term, score): the top 3 x N candidate topics of each scope.

    A term's occurrences in rising posts bound its score, as those in other posts only damp it. So all
    terms are rated in rising posts alone; of all posts those terms are counted whose bound is among the
    `looked_at` highest of their scope. If a term below may still reach the top, all are counted whose bound
    is not below the last score of the top. The result is that of counting every term.

    `among` tells the posts with phrases that may lack all but given terms, where that is cheaper than `posts`.
    """
    scratch = Scratch(posts.sparkSession)
    # few totals, each for very many terms
    where = F.concat_ws(":", "scope", "scope_key").alias("_where")
    totals = rising_totals(posts, options.threshold).select(where, "n_rising")
    stats = rising_statistics(posts, options).withColumn("_where", where)
    bounded = salted_lookup(stats, totals, "_where", F.col("term")).drop("_where").withColumn(
        "bound", _score("seen", options)
    )
    least = max(looked_at, CANDIDATE_FACTOR * max(options.top_n, options.top_n_category, options.top_n_source))
    place = F.row_number().over(_by_rank("bound"))
    first = scratch.save(bounded.withColumn("place", place).where(F.col("place") <= least + 1))
    occurrences = scratch.save(_occurrences(posts, first, among))
    top = _ranked(first, occurrences, options)
    last = top.where(F.col("rank") == CANDIDATE_FACTOR * _per_scope(options, "top_n")).select(
        "scope", "scope_key", F.col("score").alias("last")
    )
    last = scratch.save(last)   # one row a scope
    below = first.where(F.col("place") == least + 1).join(last, ["scope", "scope_key"], "left")
    if below.where(F.coalesce(F.col("bound") >= F.col("last"), F.lit(True))).isEmpty():
        return top
    enough = F.coalesce(F.col("bound") >= F.col("last"), F.lit(True))
    candidates = scratch.save(bounded.join(last, ["scope", "scope_key"], "left").where(enough).drop("last"))
    return _ranked(candidates, scratch.save(_occurrences(posts, candidates, among)), options)


def _candidate_lists(ranked: DataFrame) -> DataFrame:
    # At most 3 x N rows per scope by construction of `ranked_topics`.
    return ranked.groupBy("scope", "scope_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("candidates")
    )


def _unnest(lists: DataFrame, column: str) -> DataFrame:
    return lists.select("scope", "scope_key", F.posexplode(column).alias("pos", "c")).select(
        "scope", "scope_key", (F.col("pos") + 1).alias("rank"), F.col("c.term"), F.col("c.score")
    )


def drop_supersets(ranked: DataFrame, options: TopicOptions = TopicOptions()) -> DataFrame:
    """Walk each scope's candidates in rank order and skip a term that contains all words of a
    shorter accepted one; stop at N."""

    def covered(accepted: Column, term: Column) -> Column:
        mine = F.split(term, " ")
        return F.exists(
            accepted,
            lambda e: (F.size(F.split(e["term"], " ")) < F.size(mine))
            & (F.size(F.array_except(F.split(e["term"], " "), mine)) == 0),
        )

    start = F.array().cast("array<struct<rank:int,term:string,score:double>>")
    lists = _candidate_lists(ranked).withColumn("_wanted", _per_scope(options, "top_n"))
    accepted = F.aggregate(
        "candidates", start,
        lambda acc, c: F.when(
            (F.size(acc) >= F.col("_wanted")) | covered(acc, c["term"]), acc
        ).otherwise(F.concat(acc, F.array(c))),
    )
    return _unnest(lists.withColumn("accepted", accepted), "accepted")


def diversify(ranked: DataFrame, top_n: int = TOPICS_OVERALL, weight: float = MMR_LAMBDA) -> DataFrame:
    """Pick `top_n` topics per scope, each time the one with the largest
    weight x score - (1 - weight) x (highest word overlap with a picked topic); the earlier
    candidate wins ties. A scope with no more than `top_n` candidates stays as it is."""
    item = "struct<rank:int,term:string,score:double>"
    start = F.struct(
        F.array().cast(f"array<{item}>").alias("picked"), F.col("candidates").alias("left")
    )

    def gain(picked: Column, c: Column) -> Column:
        overlap = F.array_max(F.transform(picked, lambda p: jaccard(c["term"], p["term"])))
        return F.lit(weight) * c["score"] - F.lit(1 - weight) * F.coalesce(overlap, F.lit(0.0))

    def step(state: Column, _: Column) -> Column:
        rated = F.transform(
            state["left"],
            lambda c: F.struct(
                F.round(gain(state["picked"], c), 12).alias("gain"), (-c["rank"]).alias("nrank"),
                c.alias("c"),
            ),
        )
        best = F.array(F.array_max(rated)["c"])
        return F.transform(
            best,   # one element: binds the winner once for both uses
            lambda b: F.struct(
                F.concat(state["picked"], F.array(b)).alias("picked"),
                F.filter(state["left"], lambda c: c["rank"] != b["rank"]).alias("left"),
            ),
        )[0]

    picked = F.when(F.size("candidates") <= top_n, F.col("candidates")).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(top_n)), start, step)["picked"]
    )
    return _unnest(_candidate_lists(ranked).withColumn("picked", picked), "picked")


def emerging_topics(
    posts: DataFrame, options: TopicOptions = TopicOptions(),
) -> DataFrame:
    """(scope, scope_key, rank, term, score) for posts carrying `phrases` and `trend_score`."""
    return drop_supersets(ranked_topics(posts, options), options)
