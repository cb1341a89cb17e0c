"""Text expressions. Everything here is a Column built from JVM-side functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..vocab import KEYWORD_STOPWORDS, TOPIC_STOPWORDS

# Unicode white space plus the four ASCII separators, in runs that are not yet a single space: replacing spaces by
# themselves is most of the work
_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
# letters and digits of every script are word characters; single spaces need no replacing here either
_NON_WORD = r"[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*| [^\p{L}\p{N}_]+"

# --- fixed values: literal replacements, applied in this order ---------------------
ENTITY_REPLACEMENTS = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("\u200b", ""), ("\ufffd", ""),
]
# ----------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` computed once. An expression used inside a lambda would
    otherwise be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, keep: list[str | Column], array: Column, name: str) -> DataFrame:
    """`keep` plus one row per non-null element of `array`.

    A plain explode makes Spark add a filter on the array below it, which computes a costly array
    expression again; the outer form plus a filter on the element does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def strip_markup(c: Column) -> Column:
    """Null to "", tags out, entities decoded in list order, white space collapsed."""
    out = strip_tags(text_or_empty(c))
    for old, new in ENTITY_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return collapse_space(out)


def join_text(title: Column, body: Column) -> Column:
    return F.trim(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(body)))


def words(c: Column) -> Column:
    """Maximal runs of word characters, in order; an empty array for wordless text."""
    return F.array_remove(F.split(F.regexp_replace(text_or_empty(c), _NON_WORD, " "), " "), "")


def lower_words(c: Column) -> Column:
    """`words`, lower-cased all at once: the spaces between them end what a letter's lower case may depend on."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text_or_empty(c), _NON_WORD, " ")), " "), "")


def content_words(lowered: Column, min_length: int, stopwords: Iterable[str]) -> Column:
    """Lower-cased tokens of at least `min_length` characters that are no stop words."""
    stop = list(stopwords)
    return F.filter(lowered, lambda w: (F.length(w) >= min_length) & ~w.isin(stop))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of `low`..`high` tokens, shorter ones first, each size in text order."""

    def longer(ws: Column, previous: Column, n: int, done: list[Column]) -> Column:
        # An n-gram is the (n-1)-gram at its place plus one word. Indexing with slice() inside
        # the lambda instead would copy the whole array for every n-gram.
        if n > high:
            return F.concat(*done)
        count = F.greatest(F.size(ws) - F.lit(n - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(previous, F.lit(1), count), F.slice(ws, F.lit(n), count),
            lambda head, word: F.concat(head, F.lit(" "), word),
        )
        return let(grams, lambda g: longer(ws, g, n + 1, done + [g] if n >= low else done))

    return let(tokens, lambda ws: longer(ws, ws, 2, [ws] if low == 1 else []))


def word_count(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def is_valid_phrase(phrase: Column, block_substrings: bool = True) -> Column:
    """At least 4 characters and no stop word; by default also no "nan"/"none" inside."""
    ok = (F.length(phrase) >= 4) & ~F.exists(
        F.split(phrase, " "), lambda w: w.isin(TOPIC_STOPWORDS)
    )
    if block_substrings:
        ok = ok & ~phrase.contains("nan") & ~phrase.contains("none")
    return ok


def longest_words(title: Column, count: int = 3) -> Column:
    """The `count` longest distinct non-stop-words (earlier first on ties), as an array."""
    kept = F.array_distinct(
        F.filter(
            words(title),
            lambda w: (F.length(w) > 2) & ~F.lower(w).isin(KEYWORD_STOPWORDS),
        )
    )
    keyed = F.transform(
        kept, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, count), lambda s: s["w"])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two phrases, 0 if either is empty."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    both = F.size(F.array_intersect(wa, wb))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        both.cast("double") / F.size(F.array_union(wa, wb))
    )


def title_case(c: Column) -> Column:
    """Each run of letters gets a capital first letter; digits and signs end a run."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def ellipsis(c: Column, limit: int = 80) -> Column:
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))
    ).otherwise(c)


def signed_percent(c: Column) -> Column:
    return F.format_string("%+.0f%%", F.bround(c.cast("double"), 0))
