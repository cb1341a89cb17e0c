"""Phrases of a post: n-grams, ranked key phrases, and their assembly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection
from decimal import ROUND_HALF_UP, Decimal
from heapq import nlargest
from itertools import chain
from math import fsum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import (
    content_words, explode_once, is_valid_phrase, join_text, lower_words, ngrams, text_or_empty, word_count,
)
from ..sources.workers import importable
from ..vocab import KEYWORD_STOPWORDS, RAKE_STOPWORDS, TOPIC_STOPWORDS
from .clean import KEY
from .keywords import simple_keywords

# --- fixed values ---
RAKE_PHRASES = 5
KEYWORD_NGRAMS = 8
ENOUGH_PHRASES = 3
# --------------------
TASK_CHARS = 500_000   # of text whose phrases one task makes
_RAKE_STOP = frozenset(RAKE_STOPWORDS)
_KEYWORD_STOP = frozenset(KEYWORD_STOPWORDS)
_NINE = Decimal(1).scaleb(-9)
# letters outside of these may become others, or more of them, by what stands beside them or by the version of Unicode
_UNLIKE = r"[^\x00-\u012f\u0131-\u03a2\u03a4-\u2bff\u3000-\u9fff\uac00-\ud7a3]"


def text_phrases(text: Column, low: int = 2, high: int = 4) -> Column:
    """Lower-cased n-grams over content words of more than two characters, repeats included."""
    return ngrams(content_words(lower_words(text), 3, KEYWORD_STOPWORDS), low, high)


def rake_stretches(text: Column) -> Column:
    """The lower-cased words between punctuation, joined by spaces; a line for each stretch."""
    spaced = F.regexp_replace(F.lower(text_or_empty(text)), r"[\t\n\x0b\f\r]", " ")
    return F.regexp_replace(spaced, r"[^\p{L}\p{N}_ ]+", "\n")


def word_runs(stretches: str) -> list[list[str]]:
    """The runs of words without stop words, of one text's stretches."""
    runs = []
    for stretch in stretches.split("\n"):
        held = []
        for word in stretch.split():    # spaces are the only white space left
            if word in _RAKE_STOP:
                if held:
                    runs.append(held)
                    held = []
            else:
                held.append(word)
        if held:
            runs.append(held)
    return runs


def best_runs(stretches: str, top: int) -> list[tuple[str, float]]:
    """The `top` best-scored runs of words without stop words, of one text's stretches."""
    return best_of(word_runs(stretches), top)


def best_of(runs: list[list[str]], top: int) -> list[tuple[str, float]]:
    occurrences = Counter(chain.from_iterable(runs))
    lengths = dict(occurrences)
    for run in runs:
        if len(run) > 1:
            others = len(run) - 1
            for word in run:
                lengths[word] += others
    ratio = {word: lengths[word] / n for word, n in occurrences.items()}
    rough = [sum(map(ratio.__getitem__, run)) for run in runs]
    # plain sums are off by far less than what parts these from the best
    least = min(nlargest(top, rough), default=0.0) * (1 - 1e-9) - 2e-8
    runs = [run for run, score in zip(runs, rough) if score >= least]
    rough = [fsum(map(ratio.__getitem__, run)) for run in runs]
    # what rounding may lift among the best is rounded, half up as in `round`
    least = min(nlargest(top, rough), default=0.0) - 1e-8
    scored = [
        (float(Decimal(repr(score)).quantize(_NINE, ROUND_HALF_UP)), " ".join(run))
        for score, run in zip(rough, runs) if score >= least
    ]
    # a reversed sort keeps the order of equal runs, that of the text
    return [(phrase, score) for score, phrase in sorted(scored, reverse=True)[:top]]


def key_phrases(text: Column, top: int = RAKE_PHRASES) -> Column:
    """Array of (phrase, score), best first: the `top` best-scored key phrases of a text.

    A word scores (summed length of its runs) / (number of occurrences), a phrase the sum of its
    words. All of it is in the text, so nothing is shuffled for it."""
    best = F.udf(lambda s: best_runs(s, top), "array<struct<phrase:string,score:double>>", useArrow=True)
    return best(rake_stretches(text))


def rake_phrases(posts: DataFrame, text: Column, top: int = RAKE_PHRASES, key: str = KEY) -> DataFrame:
    """(key, rank, phrase, score): the `top` best-scored key phrases of each text."""
    importable(posts.sparkSession)
    ranked = posts.select(key, F.posexplode_outer(key_phrases(text, top)).alias("pos", "p")).where("p is not null")
    return ranked.select(key, (F.col("pos") + 1).alias("rank"), "p.phrase", "p.score")


def keyword_ngrams(keywords: Column, limit: int = KEYWORD_NGRAMS) -> Column:
    """The first valid 2-3-word n-grams of a keyword string."""
    grams = ngrams(content_words(lower_words(keywords), 2, TOPIC_STOPWORDS), 2, 3)
    return F.slice(F.filter(grams, lambda g: is_valid_phrase(g)), 1, limit)


def _parts(posts: DataFrame) -> tuple[DataFrame, Column, Column, Column, Column]:
    """(posts with entities, text, multi-word entities, n-grams of the keyword string, longer title words)."""
    if "entities" not in posts.columns:
        posts = posts.withColumn("entities", F.array().cast("array<string>"))
    title = text_or_empty(F.col("title"))
    body = text_or_empty(F.col("body"))
    known = F.trim(text_or_empty(F.col("keywords"))) if "keywords" in posts.columns else F.lit("")
    recomputed = simple_keywords(title, body)
    source = (
        F.when((known != "") & (F.lower(known) != "nan"), known)
        .when(recomputed != "", recomputed)
        .otherwise(title)
    )
    multi = F.filter("entities", lambda e: word_count(e).between(2, 4))
    return posts, join_text(title, body), multi, keyword_ngrams(source), content_words(lower_words(title), 4, TOPIC_STOPWORDS)


def add_phrases(posts: DataFrame, use_rake: bool = True) -> DataFrame:
    """Add `phrases` (and `entities`, empty if the batch has none).

    Order: multi-word entities, text n-grams, ranked key phrases of 2-5 words, n-grams of the
    keyword string; distinct. With fewer than three, the longer title words follow, repeats kept.
    """
    posts, text, multi, of_keywords, single = _parts(posts)
    rake = F.array().cast("array<string>")
    if use_rake:
        importable(posts.sparkSession)
        posts = posts.withColumn("_rake", key_phrases(text))
        rake = F.transform(F.filter(
            "_rake", lambda p: word_count(p["phrase"]).between(2, 5) & (F.length(p["phrase"]) > 4)), lambda p: p["phrase"])
    found = F.array_distinct(
        F.concat(multi, text_phrases(text), rake, of_keywords)
    )
    posts = posts.withColumn("_found", found).withColumn(
        "phrases",
        F.when(F.size("_found") < ENOUGH_PHRASES, F.concat("_found", single)).otherwise(F.col("_found")),
    )
    return posts.drop("_found", "_rake")


def phrases_among(
    stretches: str, lowered: str | None, multi: list[str], of_keywords: list[str], single: list[str],
    terms: frozenset[str], begins: frozenset[str],
) -> list[str]:
    """The phrases of a text that may be among the terms, whose first two words are `begins`; `single` follows where
    the text has fewer than three phrases, all counted."""
    ws = [w for w in (stretches if lowered is None else lowered).split() if len(w) > 2 and w not in _KEYWORD_STOP]
    found = dict.fromkeys(multi)
    for i, two in enumerate(map(" ".join, zip(ws, ws[1:]))):
        if two in begins:
            for n in (2, 3, 4):
                gram = " ".join(ws[i:i + n])
                if i + n <= len(ws) and gram in terms:
                    found[gram] = None
    runs, rake = word_runs(stretches), []
    # runs are scored where that may tell of a term
    if len(ws) < 4 or any(2 <= len(run) <= 5 and (p := " ".join(run)) in terms and p not in found for run in runs):
        rake = [p for p, _ in best_of(runs, RAKE_PHRASES) if 2 <= p.count(" ") + 1 <= 5 and len(p) > 4]
    found.update((p, None) for p in (*rake, *of_keywords) if p in terms)
    if len(ws) >= 4:        # a phrase of two words, one of three and one of four
        return list(found)
    grams = (" ".join(ws[i:i + n]) for n in (2, 3, 4) for i in range(len(ws) - n + 1))
    return [*found, *single] if len({*multi, *grams, *rake, *of_keywords}) < ENOUGH_PHRASES else list(found)


def add_phrases_among(posts: DataFrame, terms: Collection[str]) -> DataFrame:
    """`add_phrases`, but phrases that are none of the lower-cased terms may be left out. They are not made then:
    a text has hundreds of phrases, few of them wanted where terms are counted."""
    importable(posts.sparkSession)
    posts, text, multi, of_keywords, single = _parts(posts)
    wanted = frozenset(terms)
    begins = frozenset(" ".join(t.split(" ")[:2]) for t in wanted)

    @F.arrow_udf("array<string>")
    def among(stretches: pa.Array, lowered: pa.Array, others: pa.Array, n_multi: pa.Array, n_of_keywords: pa.Array) -> pa.Array:
        rows = zip(stretches, *(c.to_pylist() for c in (lowered, others, n_multi, n_of_keywords)))
        return pa.array([
            phrases_among(s.as_py(), low, held[:i], held[i:i + n], held[i + n:], wanted, begins) for s, low, held, i, n in rows
        ], pa.list_(pa.string()))

    # lower-cased before it is cut or after, a text has the same words, but for a few letters
    lowered = F.when(F.rlike(text, F.lit(_UNLIKE)), F.array_join(lower_words(text), " "))
    # read twice, these stay a projection of their own: Spark does not find a function whose arguments have lambdas
    posts = posts.withColumns({"_multi": multi, "_of_keywords": of_keywords, "_single": single})
    others = F.concat("_multi", "_of_keywords", "_single")
    made = among(rake_stretches(text), lowered, others, F.size("_multi"), F.size("_of_keywords"))
    return posts.withColumn("phrases", made).drop("_multi", "_of_keywords", "_single")


def spread_by_text(posts: DataFrame, texts: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """`posts` dealt by key over tasks of about TASK_CHARS characters of title and body, counted in `texts` where
    that is a cheaper frame of the same posts.

    Phrases are many times the text. A number of tasks that follows the bytes of the text, or the cores, lets what
    a task counts grow with the table."""
    both = F.length(text_or_empty(F.col("title"))) + F.length(text_or_empty(F.col("body")))
    chars = (posts if texts is None else texts).agg(F.coalesce(F.sum(both), F.lit(0))).first()[0]
    tasks = max(posts.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    return posts.repartition(tasks, F.col(key))


def valid_phrases(phrases: Column | str, block_substrings: bool = True) -> Column:
    """The phrases that may count as terms, lower-cased and trimmed, repeats kept."""
    return F.filter(
        F.transform(phrases, lambda p: F.trim(F.lower(p))),
        lambda p: is_valid_phrase(p, block_substrings),
    )


def post_terms(posts: DataFrame, *carry: str, block_substrings: bool = True) -> DataFrame:
    """One row per valid phrase occurrence: (carry columns..., term)."""
    return explode_once(posts, list(carry), valid_phrases("phrases", block_substrings), "term")
