"""BPE encoding and decoding with a contiguous rank array.

A word is held as a list of part boundaries beside the rank of each part joined with its right
neighbour. The smallest rank is found by scanning, its inner boundary deleted, and the ranks of the two
neighbouring joins looked up again, until no join has a rank. Words over SHORT symbols get the same
merges from a heap, as scanning would take the square of their length.

The vocabulary file is read once in each Python worker; words met before are looked up in a bounded
cache, and so are runs between white space. Everything is a per-row map, so rows need no shuffle and a lost executor costs its tasks alone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
CACHED = 200_000
PAIR = 32
_NONE = 1 << 60
#: White space and the word pattern of the vocabulary file's normaliser and splitter.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def merge_short(parts: list[int], joins: dict[int, int], joined: list[int]) -> list[int]:
    """Parts of a word by repeated scans of the rank array. parts: ids, each the text between two
    boundaries; joins: rank of a pair of ids; joined: the id that a rank's join makes."""
    rank_of = joins.get
    rank = [rank_of(a << PAIR | b, _NONE) for a, b in zip(parts, parts[1:])]
    while rank and (least := min(rank)) < _NONE:
        at = rank.index(least)
        parts[at] = joined[least]
        del parts[at + 1], rank[at]
        if at < len(rank):
            rank[at] = rank_of(parts[at] << PAIR | parts[at + 1], _NONE)
        if at:
            rank[at - 1] = rank_of(parts[at - 1] << PAIR | parts[at], _NONE)
    return parts


def merge_long(parts: list[int], joins: dict[int, int], joined: list[int]) -> list[int]:
    """The same parts for a long word: the joins wait in a heap, stale ones are passed over."""
    parts = list(parts)
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0 and (rank := joins.get(parts[i] << PAIR | parts[right[i]])) is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[right[i]]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = joined[rank], -1
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [p for p in parts if p >= 0]


class _Cache(dict):
    """Results by key, made on demand. When CACHED are held they become the older generation, of which
    only what is asked for again is kept."""

    def __init__(self, make: Callable[[str], tuple[int, str, str]]):
        self._make = make
        self._older: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, key: str) -> tuple[int, str, str]:
        found = self._older.pop(key, None) or self._make(key)
        if len(self) >= CACHED:
            self._older = dict(self)
            self.clear()
        self[key] = found
        return found


class Coder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model["end_of_word_suffix"] or ""
        self._joined_ids = [vocab[a + b] for a, b in merges]
        self._joins = {vocab[a] << PAIR | vocab[b]: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self._inner = [vocab[c] for c in byte_symbols()]
        self._last = [vocab[c + end] for c in byte_symbols()]
        self._added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self._tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self._added.items()}
        self._split = regex.compile("(" + "|".join(map(regex.escape, self._added)) + ")") if self._added else None
        self._by_word = _Cache(lambda word: self._told([self.word_ids(word)]))
        self._by_chunk = _Cache(lambda chunk: self._joined([self._by_word[w] for w in _WORD.findall(chunk)]))

    def word_ids(self, word: str) -> list[int]:
        if word in self._added:
            return [self._added[word]]
        data = word.encode("utf-8", "surrogatepass")
        parts = [self._inner[b] for b in data]
        parts[-1] = self._last[data[-1]]
        return (merge_short if len(parts) <= SHORT else merge_long)(parts, self._joins, self._joined_ids)

    def _pieces(self, text: str) -> list[str]:
        if self._split is None or not any(t in text for t in self._added):
            return [text]
        return self._split.split(text)

    def chunks(self, text: str) -> list[str]:
        """Normalised text without added tokens, cut at white space: no word goes across it."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:     # letter by letter, without the rule for a sigma at a word's end
                text = "".join(c.lower() for c in text)
        text = text.lower()
        # four control characters are space to str.split() alone
        return _SPACE.split(text) if _CONTROL.search(text) else text.split()

    def words(self, text: str) -> list[str]:
        """Normalised words and added tokens, in order."""
        found = []
        for piece in self._pieces(text):
            found += [piece] if piece in self._added else [w for c in self.chunks(piece) for w in _WORD.findall(c)]
        return found

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(text) for i in self.word_ids(word)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the file names no decoder. Unknown ids are passed over."""
        return " ".join(self._tokens[i] for i in ids if i in self._tokens)

    def _told(self, ids: list[list[int]]) -> tuple[int, str, str]:
        flat = [i for x in ids for i in x]
        return len(flat), " ".join(map(str, flat)), self.decode(flat)

    @staticmethod
    def _joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        found = [x for x in found if x[0]]
        return sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids, decoded text); words met before come from the caches."""
        found = []
        for piece in self._pieces(text):
            found += [self._by_word[piece]] if piece in self._added else map(self._by_chunk.__getitem__, self.chunks(piece))
        return self._joined(found)


@functools.lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with a column ids array<int>; null texts are empty and have no ids. An older column of the
    name ids is replaced, other columns stay."""
    return _mapped(docs, path, F.coalesce(F.col(text).cast("string"), F.lit("")), "ids", "array<int>", pa.list_(pa.int32()), "encode")


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with a column decoded string; null ids are none, ids outside the vocabulary are passed over.
    An older column of the name decoded is replaced, other columns stay."""
    return _mapped(docs, path, F.coalesce(F.col(ids), F.array().cast("array<int>")), "decoded", "string", pa.string(), "decode")


def _mapped(docs, path, source, name, kind, arrow, method) -> DataFrame:
    path = path or vocabulary_path()
    rest = [c for c in docs.columns if c != name]
    payload = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), source.alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = getattr(coder(path), method)
        for batch in batches:
            done = pa.array([act(x) for x in batch.column(1).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), done], ["row", "done"])

    schema = f"row {payload.schema['row'].dataType.simpleString()}, done {kind}"
    return payload.mapInArrow(run, schema).select("row.*", F.col("done").alias(name))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs (doc_id, text).

    A null or empty text has no ids: 0 and the digests of the empty string. Rows are independent, so
    repeated rows and null doc_ids stay as they are; other columns are ignored."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                n, said, back = own.digest(text.as_py())
                counts.append(n)
                ids.append(hashlib.sha256(said.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
