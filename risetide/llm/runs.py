"""Periodic runs of words: harmonic grids of candidates, longest common extensions by a difference cover.

A run of period q and length at least max(LEAST, EXPONENT * q) holds that many less q places i whose word
equals the one at i + q, so one of them stands on a grid of that step, and the grids of all periods have
n log n places together. From a grid place whose words agree, the run's ends are longest common extensions
(LCE) to the right and, over the reversed words, to the left.

Of the suffixes only those at places in a difference cover modulo PERIOD are sorted, by prefix doubling. Any
two places reach places of the cover after the same few steps, whose words are compared one by one; from
there the LCE is the least LCP between two ranks, which a sparse table gives at once. Documents are laid
side by side with marks between them, so a batch of many short ones costs the same few array operations as
a long one; the suffixes are sorted only of documents in which a candidate outlives the few steps.

Everything is a map of rows: no shuffle, and a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 24
EXPONENT = 3
PERIOD = 13
COVER = (0, 1, 3, 9)
BATCH_WORDS = 1 << 17
_QUERIES = 1 << 18
_PER = len(COVER)
#: Steps from places of two remainders to places of the cover; 0 to 12.
_STEPS = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
                    for j in range(PERIOD)] for i in range(PERIOD)], np.int8)
_AT = np.array([COVER.index(r) if r in COVER else -1 for r in range(PERIOD)], np.int64)


def same_words(w: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from i and j on agree, at most limit (12 or less)."""
    found = np.zeros(len(i), np.int64)
    alive = np.nonzero(limit > 0)[0]
    for step in range(PERIOD):
        alive = alive[w[i[alive] + step] == w[j[alive] + step]]
        found[alive] += 1
        alive = alive[limit[alive] > step + 1]
        if not len(alive):
            break
    return found


class Extensions:
    """LCE of any two places of w, whose last word and marks occur once each."""

    def __init__(self, w: np.ndarray):
        blocks = -(-len(w) // PERIOD) + 1
        self._w = np.concatenate([w, np.full(blocks * PERIOD + 2 * PERIOD - len(w), -1, w.dtype)])
        places = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        levels = self._ranks(places[places < len(w)])
        self._rank = levels[-1]
        order = np.empty(len(self._rank), np.int64)
        order[self._rank] = np.arange(len(order))
        self._table = [self._shared(places, order, levels)]
        while 2 << len(self._table) - 1 <= len(self._table[0]):
            last, half = self._table[-1], 1 << len(self._table) - 1
            self._table.append(np.minimum(last[:-half], last[half:]))

    def _ranks(self, places: np.ndarray) -> list[np.ndarray]:
        """Ranks of the cover's suffixes by their first PERIOD, 2 * PERIOD, ... words, until all differ."""
        w = self._w
        bits = int(w.max() + 2).bit_length()
        width = max(1, 62 // bits)
        rank = np.zeros(len(places), np.int64)
        for at in range(0, PERIOD, width):
            key = np.zeros(len(places), np.int64)
            for k in range(at, min(PERIOD, at + width)):
                key = key << bits | w[places + k] + 1
            key = np.unique(key, return_inverse=True)[1]
            rank = np.unique(rank * len(places) + key, return_inverse=True)[1] if at else key
        # rank: the number of smaller suffixes
        rank = (np.cumsum(counts := np.bincount(rank)) - counts)[rank]
        levels, ahead = [rank], _PER
        while True:
            open_ = np.nonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)[0]
            if not len(open_):
                return levels
            following = np.append(rank, np.zeros(ahead, np.int64))[open_ + ahead]
            by = np.lexsort((following, rank[open_]))
            group, key = rank[open_][by], following[by]
            first = np.append(True, group[1:] != group[:-1])
            parts = first | np.append(True, key[1:] != key[:-1])
            start = np.arange(len(by))
            rank = rank.copy()
            rank[open_[by]] = group + np.maximum.accumulate(np.where(parts, start, 0)) - np.maximum.accumulate(np.where(first, start, 0))
            levels.append(rank)
            ahead *= 2

    def _shared(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of each two suffixes that are neighbours in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][a] == levels[k][b]
            a[same] += _PER << k
            b[same] += _PER << k
            shared[same] += PERIOD << k
        return shared + same_words(self._w, places[a], places[b], np.full(len(a), PERIOD - 1))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i and j on, i <> j."""
        steps = _STEPS[i % PERIOD, j % PERIOD].astype(np.int64)
        found = same_words(self._w, i, j, steps)
        far = np.nonzero(found == steps)[0]
        a, b = (x[far] + steps[far] for x in (i, j))
        a, b = (self._rank[x // PERIOD * _PER + _AT[x % PERIOD]] for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            row = self._table[k]
            found[far[own]] += np.minimum(row[low[own]], row[high[own] - (1 << int(k))])
        return found


def _laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents with a mark before each and at the end; documents' first places; the document
    of each place."""
    top = max(int(d.max()) for d in docs) + 1
    parts, starts, at = [], [], 0
    for k, d in enumerate(docs):
        parts += [np.array([top + k]), d]
        starts.append(at + 1)
        at += len(d) + 1
    w = np.concatenate([*parts, np.array([top + len(docs)])]).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    return w, np.array(starts), np.append(owner, len(docs))


def _grid(w: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid places whose word is that a period later, in the same document. Documents
    stand longest first, so each period looks at those alone that can hold its runs."""
    ends = np.cumsum(sizes + 1)
    places, periods = [], []
    for q in range(1, int(sizes[0]) // EXPONENT + 1):
        own = int(np.searchsorted(-sizes, -max(LEAST, EXPONENT * q), side="right"))
        step = max(LEAST, EXPONENT * q) - q
        hits = np.nonzero(w[:ends[own - 1] - q:step] == w[q:ends[own - 1]:step])[0] * step
        if len(hits):
            places.append(hits)
            periods.append(np.full(len(hits), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.concatenate(places), np.concatenate(periods)
    inside = owner[i] == owner[i + q]
    return i[inside], q[inside]


def find_runs(docs: list[np.ndarray]) -> list[np.ndarray]:
    """For each document, an array of word numbers: its runs (start, length, period) by start, then period."""
    found = [np.zeros((0, 3), np.int64)] * len(docs)
    order = sorted((k for k in range(len(docs)) if len(docs[k]) >= LEAST), key=lambda k: -len(docs[k]))
    if not order:
        return found
    w, starts, owner = _laid_out([docs[k] for k in order])
    i, q = _grid(w, owner, np.array([len(docs[k]) for k in order]))
    few = np.full(len(i), PERIOD - 1)
    padded = np.concatenate([w, np.full(PERIOD, -1)])
    back = np.concatenate([w[::-1], np.full(PERIOD, -1)])
    right = same_words(padded, i, i + q, few)
    left = same_words(back, len(w) - i, len(w) - i - q, few)
    open_ = right + left >= np.minimum(np.maximum(LEAST, EXPONENT * q) - q, PERIOD - 1)
    alive = np.unique(owner[i[open_]])
    if not len(alive):
        return found
    # the documents with open candidates, laid out anew
    where = np.full(len(order) + 1, -1)
    where[alive] = np.arange(len(alive))
    own = open_ & (where[owner[i]] >= 0)
    i, q = i[own], q[own]
    at, doc = i - starts[owner[i]], where[owner[i]]
    w, starts, _ = _laid_out([docs[order[k]] for k in alive])
    i = starts[doc] + at
    ahead, behind = Extensions(w), Extensions(w[::-1])
    rows = []
    for k in range(0, len(i), _QUERIES):
        x, p, d = i[k:k + _QUERIES], q[k:k + _QUERIES], doc[k:k + _QUERIES]
        right = ahead.lce(x, x + p)
        left = behind.lce(len(w) - x, len(w) - x - p)
        length = right + left + p
        long = length >= np.maximum(LEAST, EXPONENT * p)
        rows.append(np.stack([d, x - left - starts[d], length, p], axis=1)[long])
    rows = np.unique(np.concatenate(rows), axis=0)
    if not len(rows):
        return found
    # one stretch has its smallest period alone
    first = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    bounds = np.searchsorted(rows[:, 0], np.arange(len(alive) + 1))
    for k in range(len(alive)):
        found[order[alive[k]]] = rows[bounds[k]:bounds[k + 1], 1:]
    return found


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.nonzero(np.cumsum(depth[:-1]) == 0)[0].tolist()]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first, then that of least period."""
    order = cmp_to_key(lambda a, b: b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2])
    return min(map(tuple, runs.tolist()), key=order, default=None)


Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A fixed tenth of the documents gets a periodic end, by the CRC of its id; null ids get none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _parts(batches: Iterator[pa.RecordBatch], prepare: Prepare | None) -> Iterator[tuple[pa.Array, list[list[bytes]], list[np.ndarray]]]:
    """(first column, words, runs) of rows (row, doc_id, text), BATCH_WORDS words or one row at a time."""
    for batch in batches:
        at, held, words = 0, 0, []
        for k in range(batch.num_rows):
            own = (batch.column(2)[k].as_py() or "").encode("utf-8", "surrogatepass").split()
            words.append(prepare(batch.column(1)[k].as_py(), own) if prepare else own)
            held += len(own)
            if held >= BATCH_WORDS or k == batch.num_rows - 1:
                number: dict[bytes, int] = {}
                for own in words:
                    number.update(dict.fromkeys(own))
                number = dict(zip(number, range(len(number))))
                coded = [np.fromiter(map(number.__getitem__, own), np.int64, len(own)) for own in words]
                yield batch.column(0).slice(at, len(words)), words, find_runs(coded)
                at, held, words = k + 1, 0, []


def _rows(docs: DataFrame, *first: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in first]) if first else F.col("doc_id").cast("long")
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("own"))


def runs(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """(doc_id, start, length, period) of every run of docs (doc_id, text), in words from 0.

    A run is a stretch of words with smallest period q and length max(LEAST, EXPONENT * q) or more that no
    neighbouring word extends. Words are what ASCII white space parts; a null or empty text has none. Rows
    are independent: repeated rows give their runs again, null doc_ids stay; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _parts(batches, prepare):
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(rows[:, k]) for k in range(3))],
                                             ["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """docs with the words that a run holds after its first period dropped, and with n_runs and
    n_words_dropped. Texts without a run stay as they are, also null ones; in others the words that are kept
    are joined by single spaces. Older columns of the two names are replaced."""
    rest = [c for c in docs.columns if c not in ("n_runs", "n_words_dropped")]
    payload = _rows(docs, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, found in _parts(batches, None):
            kept = [kept_words(own, x) for own, x in zip(words, found)]
            said = [b" ".join(own).decode("utf-8", "surrogatepass") if len(x) else None for own, x in zip(kept, found)]
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(said, pa.string()), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([len(a) - len(b) for a, b in zip(words, kept)], pa.int64())], ["row", "said", "n_runs", "n_words_dropped"])

    done = payload.mapInArrow(run, f"row {payload.schema['row'].dataType.simpleString()}, said string, n_runs long, n_words_dropped long")
    return done.select(
        *[F.coalesce("said", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in rest], "n_runs", "n_words_dropped")


def summary(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text), its runs as runs() finds them: doc_id, n_runs; start,
    length, period and exponent_milli of the run with the greatest length / period (smallest start, then
    period among equals; null without a run); runs_sha256 of every run's "start,length,period" lines;
    collapsed_sha256 of the kept words joined by one space.

    Null and empty texts have no words and no runs. Repeated rows and null doc_ids stay as they are; other
    columns are ignored; an empty table gives no rows. prepare may change a document's words first."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, found in _parts(batches, prepare):
            best = [strongest(x) for x in found]
            told = ["".join(f"{s},{n},{p}\n" for s, n, p in x.tolist()) for x in found]
            kept = [b" ".join(kept_words(own, x)) for own, x in zip(words, found)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) for x in found], pa.int64()),
                 *(pa.array([b and b[k] for b in best], pa.int64()) for k in range(3)),
                 pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told], pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names)

    return _rows(docs).mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string")
