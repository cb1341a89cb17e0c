"""Best tag paths of many stretches of words at once, and the chunks read off them, in arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

BITS = 3               # below a score: how early its tag comes
WORDS = 200_000        # of the texts whose paths are made at once


@dataclass(frozen=True)
class Tagger:
    """What scores a path: for each term the place of its row in `scores` (row 0: words that are no term), and
    the scores of what two tags, or a stretch's begin and its first tag, add."""

    tags: str
    places: dict[str, int]
    scores: np.ndarray
    first: np.ndarray
    moves: np.ndarray
    stretch: int

    def knowing(self, terms: Sequence[str], scores: np.ndarray) -> Tagger:
        return Tagger(self.tags, {t: i for i, t in enumerate(terms, 1)}, np.vstack([self.scores[:1], scores]),
                      self.first, self.moves, self.stretch)

    def stretches(self, marked: str) -> list[list[str]]:
        """The words of a text in which lines are what stands between punctuation and spaces part words."""
        pieces = (line.split() for line in marked.split("\n"))
        return [ws[i:i + self.stretch] for ws in pieces for i in range(0, len(ws), self.stretch)]

    def paths(self, lowered: Iterable[str], lengths: np.ndarray) -> np.ndarray:
        codes = np.fromiter(map(self.places.get, lowered, repeat(0)), np.int64, int(lengths.sum()))
        return best_tags(codes, lengths, self.scores, self.first, self.moves)


def best_tags(codes: np.ndarray, lengths: np.ndarray, scores: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags, as numbers, of stretches that lie one after another, none of them empty; earlier tags win
    ties. Step by step, over all stretches that are so long."""
    if not len(codes):
        return np.zeros(0, np.int64)
    last = len(first) - 1
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")     # stretches longer than t words
    own = np.ascontiguousarray(scores.T)
    early = np.arange(last, -1, -1)[:, None]
    step = moves << BITS
    came = np.zeros((last + 1, len(codes)), np.int8)
    held = first[:, None] + own[:, codes[starts]]
    for t in range(1, sizes[0]):
        n = active[t]
        at = starts[:n] + t
        ranked = (held[:, :n] << BITS) + early
        here = codes[at]
        for j in range(last + 1):
            best = ranked[0] + step[0, j]
            for i in range(1, last + 1):
                np.maximum(best, ranked[i] + step[i, j], out=best)
            came[j, at] = last - (best & (1 << BITS) - 1)
            held[j, :n] = (best >> BITS) + own[j, here]
    tag = np.argmax(held, axis=0)
    found = np.zeros(len(codes), np.int64)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        found[at] = tag[:n]
        tag[:n] = came[tag[:n], at]
    return found


def batched(marked: pa.Array, lowered: pa.Array) -> Iterator[tuple[list[str], list[str]]]:
    """Consecutive texts of about WORDS words, and the lowered ones."""
    size, texts, lows = 0, [], []
    for text, low in zip(marked, lowered):
        texts.append(text.as_py())
        lows.append(low.as_py())
        size += len(texts[-1]) // 6
        if size >= WORDS:
            yield texts, lows
            size, texts, lows = 0, [], []
    if texts:
        yield texts, lows


def known_to(tagger: Tagger, known: pa.Array | None) -> Tagger:
    """The tagger with the rows (term, scores) that the texts of a batch brought along."""
    if known is None:
        return tagger
    met = known.flatten()       # of every text, so terms come again with the same scores
    terms = met.field("term").to_pylist()
    scores = met.field("scores").flatten().to_numpy(zero_copy_only=False).reshape(len(terms), len(tagger.tags))
    return tagger.knowing(terms, scores)


def tagged_stretches(marked: pa.Array, lowered: pa.Array, known: pa.Array | None, tagger: Tagger) -> pa.Array:
    """Of each text its stretches (ws, tags)."""
    tagger, rows = known_to(tagger, known), []
    for texts, lows in batched(marked, lowered):
        per_text = [tagger.stretches(t) for t in texts]
        lengths = np.array([len(ws) for stretches in per_text for ws in stretches], np.int64)
        letters = "".join(map(tagger.tags.__getitem__, tagger.paths((w for low in lows for w in low.split()), lengths)))
        ends = iter(np.cumsum(lengths).tolist())
        for stretches in per_text:
            row = [(ws, next(ends)) for ws in stretches]
            rows.append([{"ws": ws, "tags": letters[end - len(ws):end]} for ws, end in row])
    return pa.array(rows, pa.list_(pa.struct([("ws", pa.list_(pa.string())), ("tags", pa.string())])))


def chunks_and_nouns(
    marked: pa.Array, lowered: pa.Array, known: pa.Array | None, tagger: Tagger, grammar: str, low: int, high: int, stop: frozenset[str],
) -> pa.Array:
    """Of each text the two arrays of its distinct chunks and nouns, in text order."""
    tagger = known_to(tagger, known)
    chunk = re.compile(grammar)
    letters = np.frombuffer(tagger.tags.encode(), np.uint8)
    longest_stop = max((len(s.split(" ")) for s in stop), default=0)
    all_chunks, all_nouns = [], []
    for texts, lows in batched(marked, lowered):
        ws, lengths, ends_of_texts = [], [], []
        for text in texts:
            for stretch in tagger.stretches(text):
                ws += stretch
                lengths.append(len(stretch))
            ends_of_texts.append(len(ws))
        lower = [w for text in lows for w in text.split()]
        lengths = np.array(lengths, np.int64)
        tags = tagger.paths(lower, lengths)
        # a sign that is no tag stands behind each stretch, so one search finds the chunks of all
        behind = np.repeat(np.arange(len(lengths)), lengths)
        line = np.full(len(tags) + len(lengths), ord("\n"), np.uint8)
        line[np.arange(len(tags)) + behind] = letters[tags]
        spans = np.array([m.span() for m in chunk.finditer(line.tobytes().decode())], np.int64).reshape(-1, 2)
        size = spans[:, 1] - spans[:, 0]
        spans, size = (x[(size >= low) & (size <= high)] for x in (spans, size))
        begins = spans[:, 0] - np.repeat(np.arange(len(lengths)), lengths + 1)[spans[:, 0]]
        nouns = np.flatnonzero(tags == tagger.tags.index("N"))
        chunk_cuts = np.searchsorted(begins, ends_of_texts).tolist()
        noun_cuts = np.searchsorted(nouns, ends_of_texts).tolist()
        begins, size, nouns = begins.tolist(), size.tolist(), nouns.tolist()
        c = n = 0
        for c_end, n_end in zip(chunk_cuts, noun_cuts):
            all_chunks.append(list(dict.fromkeys(
                " ".join(ws[b:b + k]) for b, k in zip(begins[c:c_end], size[c:c_end])
                if k > longest_stop or " ".join(lower[b:b + k]) not in stop)))
            all_nouns.append([w for w in dict.fromkeys(map(ws.__getitem__, nouns[n:n_end])) if len(w) > 2 and w not in stop])
            c, n = c_end, n_end
    return pa.array(list(zip(all_chunks, all_nouns)), pa.list_(pa.list_(pa.string())))
