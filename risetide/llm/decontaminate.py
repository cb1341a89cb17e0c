"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every training passage is a query. Terms are runs of WORDS words, so nearly all passages share no term
with any item and cost one look at a bit table. An item's BM25 weights are divided by the least score
that any passage can have that holds OVERLAP of the item's question, so one threshold, 1, serves all items
and the search loses no passage that the check after it would accept.

The items are cut into shards of bounded size; a shard's index is broadcast and the texts are read once
for each shard. Usually there is one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risetide.llm.work import saved

WORDS = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 64
PASSAGE = 256
#: A shard holds about this many items, and characters of items, at most.
SHARD_ITEMS, SHARD_CHARS = 20_000, 16_000_000
_SLACK = 1e-9
_PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Odd multipliers from a fixed rule, one for each place of a run.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) & (1 << 64) - 1 for i in range(WORDS)], np.uint64)
_FILTER_BITS = 22


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total += words[i:len(words) - size + 1 + i] * _PLACES[i]
    return total ^ total >> np.uint64(29)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what comes before it the question; one sentence is both."""
    parts = [p for p in _SENTENCE.split(text) if p and len(word_hashes(p))]
    if len(parts) < 2:
        return text, text
    return " ".join(parts[:-1]), parts[-1]


def question_terms(text: str | None) -> np.ndarray:
    """Hashes of the runs of words of an item's question; a short question is one run."""
    question = word_hashes(question_and_answer(text or "")[0])
    return runs(question, min(WORDS, len(question))) if len(question) else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Statistics:
    """Over all items: how many there are, their mean number of distinct terms, and in how many a term is."""

    items: int
    mean: float
    held: dict[int, int]


class Index:
    """Inverted index of one shard of items; statistics are those of all shards, by default of these items."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None):
        self.ids: list[int | None] = []
        self.questions: list[np.ndarray] = []
        self.answers: list[tuple[int, np.ndarray]] = []
        bags, self.longest = [], 1
        self.sizes: set[int] = set()
        for item, text in items:
            question, answer = map(word_hashes, question_and_answer(text or ""))
            if not len(question):
                continue
            size = min(WORDS, len(question))
            self.sizes.add(size)
            grams = runs(question, size)
            self.ids.append(item)
            bags.append(Counter(grams.tolist()))
            self.questions.append(np.unique(grams))
            self.answers.append((min(WORDS, len(answer)), np.unique(runs(answer, min(WORDS, len(answer))))))
            self.longest = max(self.longest, len(word_hashes(text)))
        self._build(bags, statistics or Statistics(
            len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(t for bag in bags for t in bag)))

    def _build(self, bags: list[Counter], statistics: Statistics) -> None:
        held, mean = statistics.held, statistics.mean
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.least = []
        for number, bag in enumerate(bags):
            weights = {
                t: math.log(1 + (statistics.items - held[t] + 0.5) / (held[t] + 0.5)) * n * (K1 + 1)
                / (n + K1 * (1 - B + B * len(bag) / mean)) for t, n in bag.items()}
            needed = math.ceil(OVERLAP * len(bag) - _SLACK)
            least = sum(sorted(weights.values())[:needed])
            self.least.append(least)
            for t, weight in weights.items():
                postings[t].append((number, weight / least))
        #: term -> items, impacts, largest impact, and each block's largest impact and last item
        self.postings = {}
        for t, listed in postings.items():
            blocks = [listed[i:i + BLOCK] for i in range(0, len(listed), BLOCK)]
            self.postings[t] = (
                [d for d, _ in listed], [w for _, w in listed], max(w for _, w in listed),
                [max(w for _, w in b) for b in blocks], [b[-1][0] for b in blocks])
        self.terms = np.array(sorted(self.postings), np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.terms & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item number, score) for all items that score 1 or more for the passage's distinct terms."""
        lists = [self.postings[t] for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []

        def advance(i: int, item: int) -> None:
            items = lists[i][0]
            while at[i] < len(items) and items[at[i]] < item:
                block = at[i] // BLOCK
                at[i] = (block + 1) * BLOCK if lists[i][4][block] < item else at[i] + 1

        while True:
            live = [i for i in live if at[i] < len(lists[i][0])]
            live.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, -1
            for place, i in enumerate(live):
                bound += lists[i][2]
                if bound >= 1 - _SLACK:
                    pivot = place
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            ahead = live[:pivot + 1]
            blocks = []
            for i in ahead:     # the block that would hold the item, without moving the cursor
                block = at[i] // BLOCK
                while block < len(lists[i][4]) and lists[i][4][block] < item:
                    block += 1
                blocks.append(block)
            bound = sum(lists[i][3][b] for i, b in zip(ahead, blocks) if b < len(lists[i][3]))
            if bound < 1 - _SLACK:
                # no item up to the first of these blocks' ends can reach 1
                ends = [lists[i][4][b] + 1 for i, b in zip(ahead, blocks) if b < len(lists[i][4])]
                if pivot + 1 < len(live):
                    ends.append(lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                following = max(min(ends, default=item + 1), item + 1)
                for i in ahead:
                    advance(i, following)
            elif lists[live[0]][0][at[live[0]]] == item:
                score = 0.0
                for i in ahead:
                    score += lists[i][1][at[i]]
                    at[i] += 1
                if score >= 1 - _SLACK:
                    found.append((item, score))
            else:
                for i in ahead:
                    advance(i, item)

    def matches(self, text: str) -> dict[int, tuple[float, float, float]]:
        """item number -> (BM25 score, question overlap, answer overlap), the best of all passages."""
        words = word_hashes(text)
        hits = []
        for size in self.sizes:
            grams = runs(words, size)
            near = np.nonzero(self.filter[grams & np.uint64((1 << _FILTER_BITS) - 1)])[0]
            place = np.minimum(np.searchsorted(self.terms, grams[near]), len(self.terms) - 1)
            near = near[self.terms[place] == grams[near]]
            hits.append(np.stack([near.astype(np.uint64), grams[near], np.full(len(near), size, np.uint64)]))
        hits = np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), np.uint64)
        best: dict[int, tuple[float, float, float]] = {}
        if not hits.shape[1]:
            return best
        length = max(PASSAGE, 2 * self.longest)
        step = length - self.longest
        # passages overlap by the longest item, so each occurrence lies whole in one of them
        firsts = {max(0, int(p) - k * step) // step * step for p in hits[0].tolist() for k in range(-(-length // step))}
        for first in sorted(firsts):
            inside = (hits[0] >= first) & (hits[0] + hits[2] <= first + length)
            terms = np.unique(hits[1][inside])
            if not len(terms):
                continue
            own: dict[int, np.ndarray] = {}
            for number, score in self.retrieve(terms.tolist()):
                question = np.isin(self.questions[number], terms).mean()
                if question < OVERLAP - _SLACK:
                    continue
                size, wanted = self.answers[number]
                if size not in own:
                    own[size] = runs(words[first:first + length], size)
                answer = np.isin(wanted, own[size]).mean()
                if answer >= OVERLAP - _SLACK:
                    best[number] = max(best.get(number, (0.0, 0.0, 0.0)), (score * self.least[number], float(question), float(answer)))
        return best


def _terms_of(items: DataFrame) -> DataFrame:
    """(shard, term, n): n distinct terms an item in a row without term, and a row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = np.unique(question_terms(text)).view(np.int64)
                if len(terms):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * (len(terms) + 1), pa.int64()), pa.array([None, *terms.tolist()], pa.int64()),
                         pa.array([len(terms)] + [1] * len(terms), pa.int64())], ["shard", "term", "n"])

    return items.select(F.col("shard").cast("long"), "text").mapInArrow(run, "shard long, term long, n long")


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """One index for each shard of the items; each is of bounded size. Scores don't depend on the shards: the
    statistics are counted over all items, and a shard is told those of its own terms."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    number, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-number // SHARD_ITEMS), -(-size // SHARD_CHARS))
    if shards > 1:
        items = saved(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), "benchmark-items")
        terms = saved(_terms_of(items), "benchmark-terms")
        lengths = terms.where("term is null").agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean")).first()
        frequency = terms.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
        own_terms = terms.where("term is not null").select("shard", "term").distinct()
        held = saved(own_terms.join(frequency, "term"), "benchmark-frequencies")
    for shard in range(shards):
        rows = (items.where(F.col("shard") == shard) if shards > 1 else items).select("item_id", "text").collect()
        statistics = None
        if shards > 1:      # as many rows as the shard's items have terms
            known = held.where(F.col("shard") == shard).select("term", "n").collect()
            statistics = Statistics(lengths["items"], lengths["mean"] or 0.0, {r.term & (1 << 64) - 1: r.n for r in known})
        index = Index(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), statistics)
        if index.ids:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): texts of docs that hold an item.

    An item is held if, in one passage, OVERLAP or more of its question's distinct runs of WORDS words
    occur, and OVERLAP or more of its answer's. The last sentence of an item is its answer; an item of one
    sentence is both. A shorter question or answer is one run. Words are lower-cased, ASCII
    punctuation parts them. score is the BM25 score of the best passage. Items without words match
    nothing; null and empty texts hold nothing. Rows with equal doc_id and item_id are one, with the best
    figures; a null id stays null. Either table empty: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = []
    for index in indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                rows = [(d, own.ids[n], *x) for d, text in zip(batch.column(0).to_pylist(), batch.column(1))
                        for n, x in own.matches(text.as_py()).items()]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        parts.append(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(
            run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns; a map over the rows, so repeated
    rows and null ids stay as they are. Null and empty texts hold nothing and stay; without items all rows
    stay; an empty table gives no rows."""
    names = [f"`{c}`" for c in docs.columns]
    for index in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not held.value.matches(x.as_py() or "") for x in batch.column(1)]
                yield batch.select([0]).filter(pa.array(clean, pa.bool_()))

        packed = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("own"))
        kind = packed.schema["row"].dataType.simpleString()
        docs = packed.mapInArrow(run, f"row {kind}").select("row.*")
    return docs
