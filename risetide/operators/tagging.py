"""Noun chunks: words are tagged by the best path through a tag lexicon and a transition table, and chunks
are read off the tags by a small grammar.

Both tables are the user's. The lexicon may be of any size: a small one goes to the tasks whole, a larger one is
joined word by word with a salt. The transitions have at most one row for two tags. Scores are whole numbers (such
as thousandths of a log probability), so that sums are exact and ties are real ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import explode_once, join_text, lower_words, text_or_empty
from ..sources.workers import importable
from ..vocab import KEYWORD_STOPWORDS
from . import paths
from .joins import salted_lookup
from .keywords import KEYWORD_CHARS, KEYWORD_TERMS, simple_keywords
from .lexicon import _TEXT_KEY, _keyed
from .paths import Tagger

#: Determiner, adjective, noun, verb, preposition, other; earlier ones win ties.
TAGS = ("D", "A", "N", "V", "P", "X")
#: A chunk: at most one determiner, adjectives, and at least one noun.
CHUNK = "D?A*N+"
#: What no lexicon row or transition allows costs this much.
IMPOSSIBLE = -1_000_000
#: Words are tagged in stretches between punctuation, and of at most this many words.
STRETCH = 64
_BREAK = r'[.,;:!?()\[\]"]+'
#: A lexicon of no more characters, with ROW_CHARS for a row's scores, goes to the tasks whole.
HELD_CHARS = 8_000_000
ROW_CHARS = 80
#: Grammars that mean the same to Python; what others match is left to Spark's expressions.
_PLAIN = re.compile(r"[A-Z?*+|]+")
_STOP = frozenset(KEYWORD_STOPWORDS)


def _marked(text: Column) -> Column:
    """The words of a text, spaces between them and line ends in the place of punctuation."""
    lines = F.regexp_replace(F.replace(text_or_empty(text), F.lit("\n"), F.lit(" ")), _BREAK, "\n")
    return F.regexp_replace(lines, r"[^\p{L}\p{N}_ \n][^\p{L}\p{N}_\n]*| [^\p{L}\p{N}_\n]+", " ")


def _emissions(lexicon: DataFrame) -> DataFrame:
    """(term, scores): for each lower-cased term the best score of each tag."""
    return lexicon.where(F.col("tag").isin(*TAGS)).groupBy(F.lower("term").alias("term")).agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("tag") == t, F.col("score"))), F.lit(IMPOSSIBLE)).cast("long") for t in TAGS]).alias("scores"))


def _transition_scores(transitions: DataFrame) -> dict[tuple[str, str], int]:
    """Best score of each two tags; '' is what stands before a stretch."""
    rows = transitions.where(F.col("previous").isin("", *TAGS) & F.col("tag").isin(*TAGS) & F.col("score").isNotNull())
    best = rows.groupBy("previous", "tag").agg(F.max("score").alias("score")).collect()     # at most 42 rows
    return {(r.previous, r.tag): int(r.score) for r in best}


def _tagger(lacking: list[int], moves: dict[tuple[str, str], int], held: dict[str, list[int]] = {}) -> Tagger:
    def row(before: str) -> list[int]:
        return [moves.get((before, t), IMPOSSIBLE) for t in TAGS]

    tables = ([lacking, *held.values()], row(""), [row(t) for t in TAGS])
    return Tagger("".join(TAGS), {t: i for i, t in enumerate(held, 1)}, *(np.array(x, np.int64) for x in tables), STRETCH)


def best_path(scores: Column, moves: dict[tuple[str, str], int]) -> Column:
    """Letters of the best tags for an array of the words' tag scores, which is not empty."""
    tagger = _tagger([0] * len(TAGS), moves)

    @F.arrow_udf("string")
    def path(rows: pa.Array) -> pa.Array:
        words = rows.flatten()
        own = words.flatten().to_numpy(zero_copy_only=False).reshape(len(words), len(TAGS))
        lengths = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        tags = paths.best_tags(np.arange(len(own)), lengths, own, tagger.first, tagger.moves)
        letters, ends = "".join(map(tagger.tags.__getitem__, tags)), np.cumsum(lengths)
        return pa.array([letters[e - n:e] for n, e in zip(lengths.tolist(), ends.tolist())], pa.string())

    return path(scores)


def _known(posts: DataFrame, lexicon: DataFrame, transitions: DataFrame, text: Column) -> tuple[DataFrame, Tagger, Column | None]:
    """(posts, tagger, what each post's words are known as). A lexicon of no more than HELD_CHARS goes to the
    tasks with the tagger; of a larger one each post gets the rows (term, scores) of its distinct words."""
    moves = _transition_scores(transitions)
    known = _emissions(lexicon)
    unknown = known.where("term = ''").select("scores").first()
    lacking = list(unknown["scores"]) if unknown else [IMPOSSIBLE] * (len(TAGS) - 1) + [0]
    known = known.where("term <> ''")
    importable(posts.sparkSession)
    if known.agg(F.coalesce(F.sum(F.length("term") + ROW_CHARS), F.lit(0))).first()[0] <= HELD_CHARS:
        return posts, _tagger(lacking, moves, {r.term: list(r.scores) for r in known.collect()}), None
    posts, texts, key = _keyed(posts, text)
    # only what the lexicon says about a text's distinct words is brought back to the text, not its words
    terms = F.array_distinct(lower_words(F.col("text")))
    met = salted_lookup(explode_once(texts, [key], terms, "term"), known, "term", F.col(key), how="inner")
    scored = met.groupBy(key).agg(F.collect_set(F.struct("term", "scores")).alias("_known"))
    none = F.array().cast("array<struct<term:string,scores:array<bigint>>>")
    return posts.join(scored, key, "left"), _tagger(lacking, moves), F.coalesce("_known", none)


def _read(posts: DataFrame, lexicon: DataFrame, transitions: DataFrame, text: Column, read: Callable[..., pa.Array], kind: str) -> DataFrame:
    """Add `_read`: what `read` (marked texts, the lower-cased ones, what is known of them, tagger) makes of the texts."""
    posts, tagger, known = _known(posts, lexicon, transitions, text)

    @F.arrow_udf(kind)
    def told(marked: pa.Array, lowered: pa.Array) -> pa.Array:
        return read(marked, lowered, None, tagger)

    @F.arrow_udf(kind)
    def told_with(marked: pa.Array, lowered: pa.Array, rows: pa.Array) -> pa.Array:
        return read(marked, lowered, rows, tagger)

    posts = posts.withColumn("_marked", _marked(text))
    # of a marked text's words, as spaces and line ends part them
    both = ("_marked", F.lower("_marked"))
    return posts.withColumn("_read", told(*both) if known is None else told_with(*both, known)).drop("_marked", "_known")


def tag_words(posts: DataFrame, lexicon: DataFrame, transitions: DataFrame, text: Column) -> tuple[DataFrame, DataFrame, str]:
    """(posts, their tagged stretches (key, stretch, ws, tags), key). Lexicon rows with an empty term score
    the words that the lexicon lacks; without such rows these are 'other'."""
    posts, texts, key = _keyed(posts, text)
    kind = "array<struct<ws:array<string>,tags:string>>"
    tagged = _read(texts, lexicon, transitions, F.col("text"), paths.tagged_stretches, kind)
    return posts, tagged.select(key, F.posexplode("_read").alias("stretch", "s")).select(key, "stretch", "s.ws", "s.tags"), key


def _spans(tags: Column, grammar: str) -> Column:
    """Array of (at, n, chunk) that cover the tags: what the grammar matches, and single tags between."""
    parts = F.regexp_extract_all(tags, F.lit(f"({grammar})|."), F.lit(0))
    chunk = F.lit(f"^({grammar})$")
    empty = F.array().cast("array<struct<at:int,n:int,chunk:boolean>>")
    return F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda held, p: F.struct(
            (held["at"] + F.length(p)).alias("at"),
            F.concat(held["spans"], F.array(F.struct(
                held["at"].alias("at"), F.length(p).alias("n"), F.rlike(p, chunk).alias("chunk")))).alias("spans")),
        lambda held: held["spans"])


def add_noun_chunks(
    posts: DataFrame, lexicon: DataFrame, transitions: DataFrame, title_col: str = "title", body_col: str = "body",
    low: int = 2, high: int = 4, grammar: str = CHUNK,
) -> DataFrame:
    """Add `noun_chunks`, the distinct chunks of `low` to `high` words, and `nouns`, the distinct nouns of more
    than two characters, both in text order, as written, without stop words.

    Chunks don't cross punctuation. A post without words has none of either."""
    text = join_text(F.col(title_col), F.col(body_col) if body_col in posts.columns else F.lit(""))
    none = F.array().cast("array<string>")
    if _PLAIN.fullmatch(grammar) and not re.fullmatch(grammar, ""):
        def read(marked: pa.Array, lowered: pa.Array, known: pa.Array | None, tagger: Tagger) -> pa.Array:
            return paths.chunks_and_nouns(marked, lowered, known, tagger, grammar, low, high, _STOP)

        done = _read(posts.drop("noun_chunks", "nouns"), lexicon, transitions, text, read, "array<array<string>>")
        return done.withColumns({
            n: F.coalesce(F.get("_read", F.lit(i)), none) for i, n in enumerate(("noun_chunks", "nouns"))}).drop("_read", _TEXT_KEY)
    posts, tagged, key = tag_words(posts, lexicon, transitions, text)
    spans = F.filter(_spans(F.col("tags"), grammar), lambda s: s["chunk"] & s["n"].between(low, high))
    tag_of: Callable[[Column], Column] = lambda i: F.substring("tags", i + 1, F.lit(1))     # noqa: E731
    found = tagged.select(
        key, "stretch",
        F.transform(spans, lambda s: F.array_join(F.slice("ws", s["at"] + 1, s["n"]), " ")).alias("chunks"),
        F.filter("ws", lambda w, i: (tag_of(i) == "N") & (F.length(w) > 2) & ~w.isin(KEYWORD_STOPWORDS)).alias("nouns"))
    ordered = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("stretch", "chunks", "nouns"))).alias("_found"))
    return posts.drop("noun_chunks", "nouns").join(ordered, key, "left").withColumns({
        "noun_chunks": F.coalesce(F.array_distinct(F.filter(
            F.flatten("_found.chunks"), lambda c: ~F.lower(c).isin(KEYWORD_STOPWORDS))), none),
        "nouns": F.coalesce(F.array_distinct(F.flatten("_found.nouns")), none),
    }).drop("_found", _TEXT_KEY)


def chunk_keywords(title: Column, body: Column, entities: Column, chunks: Column, nouns: Column) -> Column:
    """Entities, then noun chunks, then nouns if these are fewer than three: the first three joined and cut
    at 80 characters; `simple_keywords` when there are none."""
    first = F.array_distinct(F.concat(entities, chunks))
    terms = F.when(F.size(first) < KEYWORD_TERMS, F.array_distinct(F.concat(first, nouns))).otherwise(first)
    joined = F.trim(F.substring(F.array_join(F.slice(terms, 1, KEYWORD_TERMS), " "), 1, KEYWORD_CHARS))
    return F.when(F.size(terms) > 0, joined).otherwise(simple_keywords(title, body))


def add_chunk_keywords(posts: DataFrame, lexicon: DataFrame, transitions: DataFrame) -> DataFrame:
    """Set `keywords` from noun chunks; uses `entities` where the batch has that column."""
    chunked = add_noun_chunks(posts, lexicon, transitions)
    entities = F.col("entities") if "entities" in posts.columns else F.array().cast("array<string>")
    return chunked.withColumn("keywords", chunk_keywords(
        F.col("title"), F.col("body"), entities, F.col("noun_chunks"), F.col("nouns"))).drop("noun_chunks", "nouns")
