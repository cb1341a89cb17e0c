"""Sentiment with shifted valence: a word's valence is changed by the words and signs around it.

Words that no table knows are dropped by the join; what is left of a text is folded in order, with the
places of the last boosters and negations as the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import sentiment_label
from ..functions.text import join_text, words
from .joins import salted_lookup
from .lexicon import _TEXT_KEY, _keyed, compound

# --- fixed values: the published rules of valence shifting --------------------------
WINDOW = 3                      # words before a word that may change it
DAMPING = (1.0, 0.95, 0.9)      # of a booster one, two, three words before
CAPITALS = 0.733
NEGATION = -0.74
BEFORE_TURN, AFTER_TURN = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
# ------------------------------------------------------------------------------------
_FAR = -1_000_000


def _known_words(valence: DataFrame, shifters: DataFrame) -> DataFrame:
    """(term, valence, boost, negates, turns), one row for each lower-cased term."""
    none = F.lit(None).cast("double")
    rows = valence.select(F.lower("term").alias("term"), F.col("valence").cast("double").alias("valence"),
                          none.alias("boost"), F.lit(False).alias("negates"), F.lit(False).alias("turns"))
    rows = rows.unionByName(shifters.select(
        F.lower("term").alias("term"), none.alias("valence"),
        F.when(F.col("kind") == "booster", F.col("weight").cast("double")).alias("boost"),
        F.coalesce(F.col("kind") == "negation", F.lit(False)).alias("negates"),
        F.coalesce(F.col("kind") == "turn", F.lit(False)).alias("turns")))
    return rows.groupBy("term").agg(
        F.coalesce(F.sum("valence"), F.lit(0.0)).alias("valence"), F.coalesce(F.sum("boost"), F.lit(0.0)).alias("boost"),
        F.max("negates").alias("negates"), F.max("turns").alias("turns"))


def _in_capitals(w: Column) -> Column:
    return (F.upper(w) == w) & (F.lower(w) != w)


def _word_total(held: Column, t: Column, mixed: Column) -> Column:
    """A word's valence after capitals, boosters and negations."""
    sign = F.signum(t["valence"])
    value = t["valence"] + F.when(mixed & t["capitals"], sign * CAPITALS).otherwise(0.0)
    for k in range(WINDOW):
        away = t["pos"] - held[f"b{k}"]
        damped = F.when(away == 1, DAMPING[0]).when(away == 2, DAMPING[1]).when(away == 3, DAMPING[2]).otherwise(0.0)
        value = value + sign * held[f"w{k}"] * damped
    for k in range(WINDOW):
        value = value * F.when(t["pos"] - held[f"n{k}"] <= WINDOW, NEGATION).otherwise(1.0)
    return F.when(t["valence"] == 0, 0.0).otherwise(value)


def _folded(known: Column, mixed: Column) -> Column:
    """Summed valence of the known words (pos, valence, boost, negates, turns, capitals) in order."""
    far, zero = F.lit(_FAR), F.lit(0.0)
    begin = F.struct(
        zero.alias("before"), zero.alias("after"), F.lit(False).alias("turned"),
        *[far.alias(f"b{k}") for k in range(WINDOW)], *[zero.alias(f"w{k}") for k in range(WINDOW)],
        *[far.alias(f"n{k}") for k in range(WINDOW)])

    def step(held: Column, t: Column) -> Column:
        value = _word_total(held, t, mixed)
        boosts, negates = t["boost"] != 0, t["negates"]
        weight = t["boost"] + F.when(mixed & t["capitals"], F.signum(t["boost"]) * CAPITALS).otherwise(0.0)
        new = {"b0": t["pos"], "w0": weight, "n0": t["pos"]}

        def pushed(name: str, k: int, when: Column) -> Column:
            return F.when(when, new[f"{name}0"] if not k else held[f"{name}{k - 1}"]).otherwise(held[f"{name}{k}"]).alias(f"{name}{k}")

        return F.struct(
            (held["before"] + F.when(held["turned"], 0.0).otherwise(value)).alias("before"),
            (held["after"] + F.when(held["turned"], value).otherwise(0.0)).alias("after"),
            (held["turned"] | t["turns"]).alias("turned"),
            *[pushed("b", k, boosts) for k in range(WINDOW)], *[pushed("w", k, boosts) for k in range(WINDOW)],
            *[pushed("n", k, negates) for k in range(WINDOW)])

    def ended(held: Column) -> Column:
        return F.when(held["turned"], BEFORE_TURN * held["before"] + AFTER_TURN * held["after"]).otherwise(held["before"])

    return F.aggregate(known, begin, step, ended)


def _emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the size of a total."""
    def count(sign: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    marks, questions = count("!"), count("?")
    return F.least(marks, F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + F.when(questions < 2, 0.0).when(
        questions <= MOST_QUESTIONS, questions * QUESTION).otherwise(MANY_QUESTIONS)


def add_shifted_sentiment(
    posts: DataFrame, valence: DataFrame, shifters: DataFrame, title_col: str = "title", body_col: str = "body",
) -> DataFrame:
    """Add `sentiment_score` in [-1, 1] and `sentiment_label` from `valence` (term, valence) and `shifters`
    (term, kind, weight), whose kinds are 'booster', 'negation' and 'turn'.

    A booster adds its weight to the size of a valence up to three words later, damped with the distance; a
    word in capitals among others counts more; each negation in the three words before turns a valence and
    weakens it; after the first turn ("but") valences count more, before it less; exclamation and question
    marks add to the size of the total. A text without known words scores 0."""
    body = F.col(body_col) if body_col in posts.columns else F.lit("")
    posts, texts, key = _keyed(posts, join_text(F.col(title_col), body))
    own = texts.select(key, words(F.col("text")).alias("ws"), _emphasis(F.col("text")).alias("emphasis"))
    shout = F.size(F.filter("ws", _in_capitals))
    own = own.withColumn("mixed", (shout > 0) & (shout < F.size("ws")))
    placed = own.select(key, "mixed", "emphasis", F.posexplode("ws").alias("pos", "w")).withColumn("term", F.lower("w"))
    found = salted_lookup(placed, _known_words(valence, shifters), "term", F.col(key), how="inner")
    known = found.groupBy(key).agg(
        F.first("mixed").alias("mixed"), F.first("emphasis").alias("emphasis"),
        F.sort_array(F.collect_list(F.struct(
            "pos", "valence", "boost", "negates", "turns", _in_capitals(F.col("w")).alias("capitals")))).alias("known"))
    total = known.select(key, "emphasis", _folded(F.col("known"), F.col("mixed")).alias("_total")).select(
        key, (F.col("_total") + F.signum("_total") * F.col("emphasis")).alias("_total"))
    return posts.join(total, key, "left").withColumn(
        "sentiment_score", compound(F.coalesce("_total", F.lit(0.0)))).withColumn(
        "sentiment_label", sentiment_label(F.col("sentiment_score"))).drop("_total", _TEXT_KEY)
