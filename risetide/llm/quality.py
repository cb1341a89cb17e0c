"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote junk, good, or abstain on every text. Only the counts of vote
   patterns leave the tasks: 3 to the power of the number of labellers at most, whatever the data.
2. Expectation-maximisation over the pattern counts of all texts estimates each labeller's reliability
   and the share of good texts, and so the posterior of each pattern. No hand label is used.
3. The posterior labels of a bounded sample of TRAINED texts train a linear scorer over hashed byte
   3-grams and hashed bins of the same measures; it scores all texts.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risetide.llm.work import saved

ABSTAIN, JUNK, GOOD = 0, 1, 2
#: Texts the scorer is trained on, at most.
TRAINED = 5000
KEEP = 0.5
BUCKETS = 1 << 14
_ROUNDS, _STEPS = 200, 80
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are as with be at by this from or an have not "
    "der die das und ist von mit den nicht ein eine zu für auf im dem des sich "
    "le la les de et des un une est que qui en dans pour par du au pas sur elle "
    "el los las y que en un por con una para es al se del no".split())
_SYMBOLS = b"%&$#*|^~<>{}[]\\_=@"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


@dataclass(frozen=True)
class Measures:
    words: int
    symbols: float      # symbols for each word
    capitals: float     # share of capitals among ASCII letters
    top: float          # share of the most frequent word
    distinct: float     # distinct words for each word
    function: float     # share of function words
    stops: float        # share of words that end in a stop
    bare: float         # share of words without letters or digits
    repeats: float      # share of words equal to the word before
    marks: float        # doubled marks for each word
    length: float       # mean length of a word


def measures(text: str) -> Measures:
    words = text.split()
    n = len(words)
    if not n:
        return Measures(0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    data = text.encode("utf-8", "replace")
    letters = len(data) - len(data.translate(None, _LETTERS))
    capitals = len(data) - len(data.translate(None, _UPPER))
    counts = Counter(words)
    function = stops = bare = 0
    for word, count in counts.items():
        if word[-1] in ".,;:!?":
            stops += count
            word = word[:-1]
        if word.lower() in FUNCTION_WORDS:
            function += count
        elif len(word) < 4 and not any(map(str.isalnum, word)):
            bare += count
    return Measures(
        n, (len(data) - len(data.translate(None, _SYMBOLS))) / n, capitals / max(1, letters), max(counts.values()) / n,
        len(counts) / n, function / n, stops / n, bare / n,
        sum(map(operator.eq, words, words[1:])) / n, (text.count("!!") + text.count("??")) / n, (len(text) - n + 1) / n)


def _vote(junk: bool, good: bool) -> int:
    return JUNK if junk else GOOD if good else ABSTAIN


#: The labellers. Each sees one weakness, abstains where it can't tell, and errs in its own way.
LABELLERS = (
    lambda m: _vote(m.words == 0, False),
    lambda m: _vote(m.symbols > 0.4, m.words > 0 and m.symbols < 0.1),
    lambda m: _vote(m.words >= 5 and m.capitals > 0.5, m.words >= 5 and m.capitals < 0.2),
    lambda m: _vote(m.words >= 20 and m.top > 0.25, m.words >= 20 and m.top < 0.15),
    lambda m: _vote(m.words >= 40 and m.distinct < 0.15, m.words >= 40 and m.distinct > 0.3),
    lambda m: _vote(m.words >= 30 and m.function < 0.05, m.words >= 10 and m.function > 0.12),
    lambda m: _vote(m.words >= 60 and (m.stops < 0.01 or m.stops > 0.7), m.words >= 10 and 0.02 < m.stops < 0.5),
    lambda m: _vote(m.words >= 5 and m.bare > 0.2, m.words >= 5 and m.bare < 0.05),
    lambda m: _vote(m.words >= 10 and m.repeats > 0.2, m.words >= 10 and m.repeats < 0.08),
    lambda m: _vote(m.words >= 5 and m.marks > 0.2, m.words >= 5 and m.marks < 0.02),
    lambda m: _vote(m.words >= 10 and (m.length < 2 or m.length > 14), m.words >= 10 and 2.5 < m.length < 10),
)


def pattern_of(m: Measures) -> int:
    code = 0
    for labeller in LABELLERS:
        code = code * 3 + labeller(m)
    return code


def votes_of(pattern: int) -> list[int]:
    votes = []
    for _ in LABELLERS:
        pattern, vote = divmod(pattern, 3)
        votes.append(vote)
    return votes[::-1]


def posteriors(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray, float]:
    """Probability of good for each pattern, each labeller's P(vote | class, not abstaining), and the share of good texts."""
    patterns = sorted(counts)
    if not patterns:
        return {}, np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5
    votes = np.array([votes_of(p) for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    good, junk = (votes == GOOD).sum(1), (votes == JUNK).sum(1)
    # a start: a labeller sees one fault, so one that votes junk outweighs those that don't see theirs
    belief = (good + 1) / (good + 1 + 20.0 * junk)
    shown = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    for _ in range(_ROUNDS):
        share = float((belief * weight).sum() / weight.sum())
        share = min(max(share, 1e-3), 1 - 1e-3)
        sides = np.stack([(1 - belief) * weight, belief * weight])
        chance = np.einsum("cp,pjv->jcv", sides, shown) + 1
        chance[:, :, ABSTAIN] = 0       # abstaining says nothing about the class
        chance /= chance.sum(axis=2, keepdims=True)
        chance[:, :, ABSTAIN] = 1
        odds = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", shown, np.log(chance[:, 1]) - np.log(chance[:, 0]))
        following = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(following - belief).max() < 1e-9:
            break
        belief = following
    return dict(zip(patterns, belief.tolist())), chance, share


def _bins(m: Measures) -> list[int]:
    """Hashed features of the measures."""
    said = [f"words {min(12, int(math.log2(m.words + 1)))}"]
    if m.words >= 10:
        for name in ("symbols", "capitals", "top", "distinct", "function", "stops", "bare", "repeats", "marks"):
            said.append(f"{name} {min(12, int(getattr(m, name) * 12))}")
        said.append(f"length {min(20, int(m.length))}")
    return [BUCKETS + xxhash.xxh3_64_intdigest(s) % BUCKETS for s in said]


def features(text: str, m: Measures) -> np.ndarray:
    """Two blocks of BUCKETS: byte 3-grams scaled to length 1, and bins."""
    out = np.zeros(2 * BUCKETS, np.float32)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) >= 3:
        grams = (data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(0x9E3779B1) >> np.uint32(18)
        counts = np.bincount(grams, minlength=BUCKETS)
        out[:BUCKETS] = counts / math.sqrt(float(counts @ counts))
    out[_bins(m)] = 0.3
    return out


def train(rows: list[np.ndarray], places: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Logistic regression on sparse rows with soft labels; the last weight is the constant."""
    size = np.array([len(r) for r in rows])
    owner, place, value = np.repeat(np.arange(len(rows)), size), np.concatenate(places), np.concatenate(rows).astype(float)
    weights, grown = np.zeros(2 * BUCKETS + 1), np.full(2 * BUCKETS + 1, 1e-6)
    good = max(1e-9, float(labels.sum()))
    junk = max(1e-9, float((1 - labels).sum()))
    each = (labels / good + (1 - labels) / junk) / 2     # both classes weigh the same
    for _ in range(_STEPS):
        z = np.bincount(owner, weights[place] * value, len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * each
        slope = np.append(np.bincount(place, value * error[owner], 2 * BUCKETS), error.sum()) + 1e-6 * weights
        grown += slope * slope
        weights -= 0.5 * slope / np.sqrt(grown)
    return weights


@dataclass(frozen=True)
class Model:
    posterior: dict[int, float]
    reliability: np.ndarray
    share: float
    weights: np.ndarray

    def score(self, text: str, m: Measures) -> float:
        z = float(features(text, m) @ self.weights[:-1]) + float(self.weights[-1])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def fit(docs: DataFrame, trained: int = TRAINED) -> Model:
    """Labellers' reliabilities from all texts, the scorer from a sample of trained texts at most."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(pattern_of(measures(x.as_py())) for x in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    found = docs.select(_text()).mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r.pattern: r.n for r in found}
    posterior, reliability, share = posteriors(counts)
    number = sum(counts.values())
    if not number:
        return Model({}, reliability, share, np.zeros(2 * BUCKETS + 1))
    # a fixed draw, a little under the bound, and the bound itself
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.9 * trained / number))
    sample = docs.where(drawn | F.lit(number <= trained)).select(_text().alias("text")).limit(trained)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, places, labels = [], [], []
        for batch in batches:
            for x in batch.column(0):
                m = measures(x.as_py())
                dense = features(x.as_py(), m)
                at = np.nonzero(dense)[0]
                rows.append(dense[at])
                places.append(at)
                labels.append(posterior[pattern_of(m)])
        weights = train(rows, places, np.array(labels)) if rows else np.zeros(2 * BUCKETS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary())], ["weights"])

    weights = saved(sample, "quality-sample").coalesce(1).mapInArrow(learn, "weights binary").collect()
    return Model(posterior, reliability, share, np.frombuffer(weights[0].weights, "<f8") if weights else np.zeros(2 * BUCKETS + 1))


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label_posterior, score, keep) for every row of docs (doc_id, text).

    label_posterior is the probability of good by the labellers alone, score that of the trained scorer;
    keep: score of KEEP or more. A null text is empty; a text without words is never kept, as nothing in
    it can be judged good. Equal texts score the same; null doc_ids stay. Empty table: no rows. Other
    columns are ignored. A pattern the model has not met has the share of good texts as posterior.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            posterior, score, keep = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                m = measures(text)
                posterior.append(own.posterior.get(pattern_of(m), own.share))
                score.append(own.score(text, m))
                keep.append(m.words > 0 and score[-1] >= KEEP)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array(keep, pa.bool_())],
                ["doc_id", "label_posterior", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), _text()).mapInArrow(
        run, "doc_id long, label_posterior double, score double, keep boolean")


def drop_junk(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns; a map over the rows."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    names = [f"`{c}`" for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            good = []
            for x in batch.column(1):
                m = measures(x.as_py())
                good.append(m.words > 0 and own.score(x.as_py(), m) >= KEEP)
            yield batch.select([0]).filter(pa.array(good, pa.bool_()))

    packed = docs.select(F.struct(*names).alias("row"), _text().alias("own"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}").select("row.*")
