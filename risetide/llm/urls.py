"""URL filters: host words by unigram Viterbi, then multinomial naive Bayes.

Word frequencies come from all pages' urls and titles, and all of them count; they stay a table, which is
joined with the substrings of the distinct pieces. A host's labels are split at dots,
hyphens and digits, and each piece into the words that are most likely together. Naive Bayes is trained
on the distinct urls, so that a host with a third of all rows counts as its different pages do; a url that
holds a seed word is taken as bad, others as good. Words that keep company with seeds become bad too.
Rules given for hosts and paths come first.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risetide.llm.work import saved
from risetide.operators.joins import salted_lookup

SALTS = 8
#: Words up to this length are looked up as substrings of a piece, longer ones by their first letters.
HEAD = 24
_ROWS = 100_000
_CACHED = 100_000
_OTHER, _NUMBER = "<other>", "<number>"
#: Words that mark unwanted hosts.
SEEDS = ("adult", "ads", "adserver", "bet", "bets", "betting", "casino", "gambling", "pharma", "pills", "poker", "porn",
         "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "xxx")
#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_PIECES = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], position: int) -> Column:
    """Of the rules that fit, the longest one's text (position 0) or verdict (1); else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0])):     # a longer rule overrides
        own_host, _, own_path = rule[0].partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        chosen = F.when(fits, F.lit(rule[position])).otherwise(chosen)
    return chosen


@dataclass
class Words:
    """Unigram model: counts of the words it holds."""

    counts: dict[str, int]
    total: int = field(init=False)
    sizes: list[int] = field(init=False)

    def __post_init__(self):
        self.total = sum(self.counts.values()) or 1
        self.sizes = sorted({len(w) for w in self.counts}, reverse=True)

    def split(self, text: str) -> list[str]:
        """The most likely words that make up the text; of equal ones, the fewest letters first. A string that
        is no word, of any length, is less likely with each letter."""
        whole, letter = math.log(self.total), math.log(10)
        best, begin = [0.0], [0]
        # the cheapest place to begin an unknown string at, whose cost grows evenly
        low, at = 0.0, 0
        for end in range(1, len(text) + 1):
            found = (low + whole + end * letter, at)
            for size in self.sizes:
                if size <= end and (count := self.counts.get(text[end - size:end])) is not None:
                    found = min(found, (best[end - size] + whole - math.log(count), end - size))
            best.append(found[0])
            begin.append(found[1])
            if found[0] - end * letter < low:
                low, at = found[0] - end * letter, end
        words, end = [], len(text)
        while end:
            words.append(text[begin[end]:end])
            end = begin[end]
        return words[::-1]


class Model:
    """Word model, and naive Bayes over the words: log odds of bad against good."""

    def __init__(self, words: Words):
        self.words = words
        self.odds: dict[str, float] = {}
        self.prior = 0.0
        self._known: dict[str, tuple[str, ...]] = {}

    def tokens(self, text: str) -> tuple[str, ...]:
        found = self._known.get(text)
        if found is None:
            found = []
            for piece in _PIECES.findall(text.lower()):
                if piece.isdigit():
                    found.append(_NUMBER)
                else:
                    found += [w if w in self.words.counts else _OTHER for w in self.words.split(piece)]
            found = tuple(found)
            if len(self._known) >= _CACHED:
                self._known.clear()
            self._known[text] = found
        return found

    def all_tokens(self, host: str, path: str) -> list[str]:
        return [*("h " + t for t in self.tokens(host)), *("p " + t for t in self.tokens(path))]

    def learn(self, seen: dict[tuple[str, bool], int], classes: dict[bool, int]) -> None:
        """seen: (token, bad) -> count; classes: bad -> urls. Counts are smoothed by one; a
        token that was never seen says nothing."""
        names = {t for t, _ in seen}
        total = {c: sum(n for (_, bad), n in seen.items() if bad == c) + len(names) + 1 for c in (False, True)}
        self.odds = {t: math.log((seen.get((t, True), 0) + 1) / total[True]) - math.log((seen.get((t, False), 0) + 1) / total[False])
                     for t in names}
        self.prior = math.log((classes.get(True, 0) + 1) / (classes.get(False, 0) + 1))

    def score(self, host: str, path: str) -> float:
        """Log odds of bad; a url without tokens has the prior."""
        return self.prior + sum(self.odds.get(t, 0.0) for t in self.all_tokens(host, path))

    def bad(self, host: str, path: str) -> bool:
        return self.score(host, path) > 0


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): words of all urls and titles; seeds have one more."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    title = F.when(html.contains("<title>"), F.substring_index(F.substring_index(html, "</title>", 1), "<title>", -1)).otherwise("")
    text = F.lower(F.concat_ws(" ", host_of(F.col("url")), path_of(F.col("url")), title))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    seeds = pages.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("word"))
    return words.unionByName(seeds).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fit(pages: DataFrame) -> Model:
    """Word counts and naive Bayes from all pages (url, html), all brought to the driver: for tables whose
    words fit there. judge() needs no such model."""
    common = saved(word_counts(pages), "url-words").collect()
    model = Model(Words({r.word: r.n for r in common}))
    held = pages.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, path in zip(batch.host, batch.path):
                tokens = held.value.all_tokens(host, path)
                bad = any(t[2:] in SEEDS for t in tokens)
                rows += [(t, bad) for t in tokens] + [("", bad)]
            yield pd.DataFrame(rows, columns=["token", "bad"])

    # numbers in a path are one token, so they make no different urls here
    distinct = _distinct_urls(pages)
    seen = saved(distinct.mapInPandas(counted, "token string, bad boolean").groupBy("token", "bad").agg(F.count(F.lit(1)).alias("n")), "url-tokens")
    rows = seen.collect()
    model = Model(model.words)
    model.learn({(r.token, r.bad): r.n for r in rows if r.token}, {r.bad: r.n for r in rows if not r.token})
    return model


def _distinct_urls(pages: DataFrame) -> DataFrame:
    """(host, path), with one digit for each number."""
    return pages.select(host_of(F.col("url")).alias("host"), F.regexp_replace(path_of(F.col("url")), r"\d+", "0").alias("path")).distinct()


def _url_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path, scope, piece): a number's piece is _NUMBER."""
    for batch in batches:
        rows = [(host, path, scope, _NUMBER if piece.isdigit() else piece)
                for host, path in zip(batch.host, batch.path) for scope, text in (("h ", host), ("p ", path))
                for piece in _PIECES.findall(text.lower())]
        yield pd.DataFrame(rows, columns=["host", "path", "scope", "piece"])


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(piece, word): the distinct substrings of each piece, of HEAD letters at most."""
    pieces, words = [], []
    for batch in batches:
        for piece in batch.piece:
            found = {piece[i:j] for i in range(len(piece)) for j in range(i + 1, min(len(piece), i + HEAD) + 1)}
            pieces += [piece] * len(found)
            words += found
            if len(words) >= _ROWS:
                yield pd.DataFrame({"piece": pieces, "word": words})
                pieces, words = [], []
    yield pd.DataFrame({"piece": pieces, "word": words}, dtype=object)


def _split_pieces(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, tokens): the most likely words of each piece by all counts (word, n)."""
    total = counts.agg(F.sum("n")).first()[0]
    parts = pieces.where(F.col("piece") != _NUMBER).mapInPandas(_substrings, "piece string, word string")
    words = salted_lookup(parts, counts, "word", F.col("piece"), "inner", SALTS).select("piece", "word", "n")
    # a longer word is met at its first letters, and is one of the piece's if the rest follows
    long = counts.where(F.length("word") > HEAD).select(F.left("word", F.lit(HEAD)).alias("word"), F.col("word").alias("whole"), "n")
    met = parts.where(F.length("word") == HEAD).join(long, "word").where(F.col("piece").contains(F.col("whole")))
    words = words.unionByName(met.select("piece", F.col("whole").alias("word"), "n").distinct())
    held = words.groupBy("piece").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = []
            for piece, own, ns in zip(batch.piece, batch.words, batch.ns):
                model = Words({} if own is None else dict(zip(own, map(int, ns))))
                model.total = total
                tokens.append([_NUMBER] if piece == _NUMBER else [w if w in model.counts else _OTHER for w in model.split(piece)])
            yield pd.DataFrame({"piece": batch.piece, "tokens": tokens})

    return pieces.join(held, "piece", "left").mapInPandas(split, "piece string, tokens array<string>")


def url_scores(pages: DataFrame) -> DataFrame:
    """(host, path, score) of _distinct_urls(): what fit() and Model.score() give, without bringing words or
    odds to the driver. One row of totals comes there."""
    counts = saved(word_counts(pages), "url-words")
    urls = saved(_distinct_urls(pages), "url-distinct")
    pieces = saved(urls.mapInPandas(_url_pieces, "host string, path string, scope string, piece string"), "url-pieces")
    splits = saved(_split_pieces(pieces.select("piece").distinct(), counts), "url-splits")
    place = F.struct("host", "path")
    met = salted_lookup(pieces, splits, "piece", place, "inner", SALTS)
    # a row holds the tokens of one url
    own = met.groupBy("host", "path").agg(F.flatten(F.collect_list(F.transform("tokens", lambda t: F.concat("scope", t)))).alias("tokens"))
    own = saved(urls.join(own, ["host", "path"], "left").select(
        "host", "path", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn(
        "bad", F.exists("tokens", lambda t: t.isin(*(scope + s for scope in ("h ", "p ") for s in SEEDS)))), "url-tokens")
    token = own.select("host", "path", "bad", F.explode("tokens").alias("token"))
    seen = saved(token.groupBy("token").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")), "url-seen")
    sums = seen.agg(F.count(F.lit(1)).alias("names"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    classes = own.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    prior = math.log((classes.bad + 1) / (classes.good + 1))
    odds = seen.select("token", (F.log((F.col("bad") + 1) / F.lit(sums.bad + sums.names + 1))
                                 - F.log((F.col("good") + 1) / F.lit(sums.good + sums.names + 1))).alias("odds"))
    rated = salted_lookup(token.select("host", "path", "token"), odds, "token", place, "inner", SALTS)
    # in one order, so that the sum doesn't depend on partitions
    total = rated.groupBy("host", "path").agg(F.aggregate(F.array_sort(F.collect_list("odds")), F.lit(0.0), lambda x, y: x + y).alias("odds"))
    return urls.join(total, ["host", "path"], "left").select("host", "path", (F.coalesce("odds", F.lit(0.0)) + F.lit(prior)).alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: Model | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages (page_id, url, html).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest that fits
    decides, else naive Bayes: block above even odds. A null url, or one without ://, has an empty host
    and path, fits no rule and has the prior odds. Rows are judged one by one, so repeated rows and null
    ids stay. Empty table: no rows. Other columns are ignored.
    """
    parts = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if model is None:
        whole = F.struct(F.col("host"), F.regexp_replace("path", r"\d+", "0").alias("path"))
        scores = url_scores(pages).select(F.struct("host", "path").alias("_url"), "score")
        scored = salted_lookup(parts.withColumn("_url", whole), scores, "_url", F.struct("page_id", "path"), "left", SALTS)
    else:
        held = pages.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = functools.lru_cache(_CACHED)(held.value.score)
            for batch in batches:
                scores = [score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["page_id", "host", "path", "score"])

        scored = parts.mapInArrow(run, "page_id long, host string, path string, score double")
    host, path = F.col("host"), F.col("path")
    return scored.select(
        "page_id", "host", "path", rule_of(host, path, rules, 0).alias("rule"),
        F.coalesce(rule_of(host, path, rules, 1), F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
