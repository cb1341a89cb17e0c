"""Lexicon-driven text operators: category, sentiment and entities.

Each takes its lexicon as a table of any size. Tokens are exploded and joined to the lexicon with a salt, as
common words are hot keys; Spark broadcasts a lexicon if its measured size is small. Lexicon terms are
lower-cased like the tokens; weights of a repeated term add up and null weights add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import sentiment_label
from ..functions.text import explode_once, join_text, lower_words, text_or_empty
from ..schema import DEFAULT_CATEGORY, ENTITY_TYPES, VALID_CATEGORIES
from ..vocab import KEYWORD_STOPWORDS
from .clean import KEY
from .joins import salted_lookup

_TEXT_KEY = "_text_key"


def _keyed(posts: DataFrame, text: Column) -> tuple[DataFrame, DataFrame, str]:
    """(posts, distinct texts, their common key). Cleaned posts have a key and are partitioned by it;
    for other batches the text's digest is the key, so rows with equal texts share a result."""
    if KEY in posts.columns:
        return posts, posts.select(KEY, text.alias("text")), KEY
    hashed = posts.withColumn(_TEXT_KEY, F.md5(text))
    return hashed, hashed.select(_TEXT_KEY, text.alias("text")).dropDuplicates([_TEXT_KEY]), _TEXT_KEY


def _known_tokens(texts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, lexicon columns) for each token that the lexicon (term, ...) has. Few tokens are in a lexicon,
    so they are joined before anything is counted."""
    tokens = explode_once(texts, [key], lower_words(F.col("text")), "term")
    return salted_lookup(tokens, lexicon, "term", F.col(key), how="inner")


def _argmax_category(weights: Column, categories: list[str]) -> Column:
    """The heaviest category (first in list order on ties) of an array of weights."""
    ranked = F.transform(
        weights,
        lambda w, i: F.struct(
            F.round(w, 9).alias("w"), (-i).alias("i"),
            F.element_at(F.array(*map(F.lit, categories)), i + 1).alias("c"),
        ),
    )
    best = F.array_max(ranked)
    return F.when(best["w"] > 0, best["c"]).otherwise(F.lit(DEFAULT_CATEGORY))


def classify_posts(
    posts: DataFrame, lexicon: DataFrame, text_cols: tuple[str, ...] = ("title",),
    categories: list[str] | None = None,
) -> DataFrame:
    """Add `category`: the category of `lexicon` (term, category, weight) with the largest summed
    weight over the words of the text; "general" when no word is known."""
    categories = categories or VALID_CATEGORIES
    posts, texts, key = _keyed(posts, F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in text_cols]))
    per_term = lexicon.where(F.col("category").isin(categories)).groupBy(F.lower("term").alias("term")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("category") == c, F.col("weight"))), F.lit(0.0)).alias(f"w{i}")
            for i, c in enumerate(categories)
        ]
    )
    sums = _known_tokens(texts, key, per_term).groupBy(key).agg(
        F.array(*[F.sum(f"w{i}") for i in range(len(categories))]).alias("_weights")
    )
    labelled = sums.select(key, _argmax_category(F.col("_weights"), categories).alias("category"))
    return posts.drop("category").join(labelled, key, "left").withColumn(
        "category", F.coalesce("category", F.lit(DEFAULT_CATEGORY))
    ).drop(_TEXT_KEY)


def compound(total: Column) -> Column:
    """Squash a summed valence into [-1, 1]."""
    return F.round(total / F.sqrt(total * total + F.lit(15.0)), 4) + F.lit(0.0)   # no negative zero


def add_sentiment(
    posts: DataFrame, lexicon: DataFrame, title_col: str = "title", body_col: str = "body",
) -> DataFrame:
    """Add `sentiment_score` in [-1, 1] and `sentiment_label` from `lexicon` (term, valence)."""
    body = F.col(body_col) if body_col in posts.columns else F.lit("")
    posts, texts, key = _keyed(posts, join_text(F.col(title_col), body))
    valence = lexicon.groupBy(F.lower("term").alias("term")).agg(F.sum("valence").alias("valence"))
    sums = _known_tokens(texts, key, valence).groupBy(key).agg(F.sum("valence").alias("_valence"))
    score = compound(F.coalesce("_valence", F.lit(0.0)))
    return posts.join(sums, key, "left").withColumn("sentiment_score", score).withColumn(
        "sentiment_label", sentiment_label(F.col("sentiment_score"))
    ).drop("_valence", _TEXT_KEY)


def ensure_sentiment(posts: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """`add_sentiment` only where the batch does not carry both sentiment columns yet."""
    if {"sentiment_score", "sentiment_label"} <= set(posts.columns):
        return posts
    return add_sentiment(posts, lexicon, **options)


def _names(gazetteer: DataFrame) -> DataFrame:
    """(term, ws): the names of the wanted types as the words a text would show."""
    ws = lower_words(F.col("entity"))
    named = gazetteer.where(F.col("type").isin(ENTITY_TYPES)).select(
        F.array_join(ws, " ").alias("term"), ws.alias("ws")
    )
    return named.where((F.length("term") > 1) & ~F.col("term").isin(KEYWORD_STOPWORDS)).distinct()


def add_entities(
    posts: DataFrame, gazetteer: DataFrame, title_col: str = "title", body_col: str = "body",
) -> DataFrame:
    """Add `entities`: the distinct word sequences of the text that are names of the wanted types in
    `gazetteer` (entity, type), lower-cased, of any length; ordered by length, then text position.

    Places where a name's first word stands learn how long the names are that begin so; the windows of these
    lengths are looked up among the names, one name a row, so no row grows with the names that share a word."""
    text = join_text(F.col(title_col), F.col(body_col) if body_col in posts.columns else F.lit(""))
    posts, texts, key = _keyed(posts, text)
    names = _names(gazetteer)
    heads = names.groupBy(F.get("ws", F.lit(0)).alias("term")).agg(F.collect_set(F.size("ws")).alias("sizes"))
    tokens = texts.select(key, lower_words(F.col("text")).alias("ws"))
    placed = tokens.select(key, F.posexplode_outer("ws").alias("pos", "term")).where("term is not null")
    hits = salted_lookup(placed, heads, "term", F.col(key), how="inner").groupBy(key).agg(
        F.collect_list(F.struct("pos", "sizes")).alias("hits")
    )
    windows = F.flatten(F.transform("hits", lambda h: F.transform(
        F.filter(h["sizes"], lambda n: h["pos"] + n <= F.size("ws")),
        lambda n: F.struct(
            n.alias("n"), h["pos"].alias("pos"), F.array_join(F.slice("ws", h["pos"] + 1, n), " ").alias("term")))))
    met = explode_once(tokens.join(hits, key), [key], windows, "w").groupBy(key, "w.term").agg(
        F.min(F.struct("w.n", "w.pos")).alias("first"))
    found = salted_lookup(met, names.select("term"), "term", F.col(key), how="inner").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("first", "term"))).alias("found"))
    found = found.select(key, F.col("found.term").alias("entities"))
    return posts.drop("entities").join(found, key, "left").withColumn(
        "entities", F.coalesce("entities", F.array().cast("array<string>"))
    ).drop(_TEXT_KEY)


def no_entities(posts: DataFrame) -> DataFrame:
    """The behaviour without a gazetteer: an empty entity list for every post."""
    return posts.withColumn("entities", F.array().cast("array<string>"))
