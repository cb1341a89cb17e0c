"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

A text's symbols are its characters, spaces written as U+2581. An agenda holds each pair of neighbours
whose joined text is a piece, best score first and leftmost among equals; the best pair is joined and the
pairs it makes with its new neighbours enter, until the agenda is empty. The agenda is a heap; that of a
short chunk is a list whose best entry a scan finds. Symbols that are no piece are told by their UTF-8
bytes.

No pair can join across a place that no piece spans, so texts are cut there and what was met before is
looked up in a cache bounded by entries and length. Everything is a map of rows: no shuffle, and a lost
executor costs its tasks alone. check() holds the results against the sentencepiece library, a batch of
rows at a time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED = 300_000
LONGEST_CACHED = 64
SHORT = 64
#: Fixed values of the model file's format: kinds of pieces, and the number of the merge model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
_BITS = 22
_NONE = 1 << 29
_GONE = -1 << 30


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def _cuts(pieces: list[str]) -> str:
    """Pattern of the chunks that no piece of several characters crosses: spaces go with what follows,
    letters part from other characters if no piece mixes them, characters of no such piece stand apart."""
    if any(SPACE in t.lstrip(SPACE) for t in pieces):
        return r"(?s).+"
    joining = {c for t in pieces for c in t} - {SPACE}
    kinds = [{c for c in joining if c.isalpha()}, {c for c in joining if not c.isalpha()}]
    if any(0 < sum(c in kinds[0] for c in own) < len(own) for own in (t.lstrip(SPACE) for t in pieces)):
        kinds = [joining]
    classes = [re.escape("".join(sorted(k))) for k in kinds if k]
    return "|".join([*(f"{SPACE}*[{x}]+" for x in classes), f"{SPACE}+", f"[^{SPACE}{''.join(classes)}]+"])


class _Cache(dict):
    """Results by chunk, made on demand; short chunks' are held in two generations of CACHED each."""

    def __init__(self, make: Callable[[str], tuple[int, str, str]]):
        self._make = make
        self._older: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        found = self._older.get(chunk) or self._make(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self._older = dict(self)
                self.clear()
            self[chunk] = found
        return found


class Coder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            told = list(_fields(file.read()))
        pieces = [dict(_fields(x)) for number, x in told if number == 1]
        trainer = dict(_fields(next(x for number, x in told if number == 2)))
        normaliser = dict(_fields(next(x for number, x in told if number == 3)))
        self._texts = [p[1].decode() for p in pieces]
        self._kinds = [p.get(3, NORMAL) for p in pieces]
        plain = not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
        if trainer.get(3) != MERGES or not trainer.get(35) or not plain or {USER_DEFINED, UNUSED} & set(self._kinds):
            raise ValueError(f"{path}: not a merge model with byte fallback and no normalisation but a first space")
        self._ids = {t: i for i, (t, kind) in enumerate(zip(self._texts, self._kinds)) if kind == NORMAL}
        cost = {self._texts[i]: -struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for i in self._ids.values()}
        by_value = {int(t[3:5], 16): i for i, (t, kind) in enumerate(zip(self._texts, self._kinds)) if kind == BYTE}
        self._byte_ids = [by_value[b] for b in range(256)]
        self._byte_of = {i: b for b, i in by_value.items()}
        self._unknown = trainer[44].decode() if 44 in trainer else " ⁇ "
        # a symbol is a number: a piece's id, or what its single character gets behind them or below zero
        self._alone = sorted({c for t in self._ids for c in t if c not in self._ids})
        self._number = self._ids | {c: len(self._texts) + i for i, c in enumerate(self._alone)}
        made = sorted(cost, key=lambda t: (cost[t], self._ids[t]))
        self._made = [self._ids[t] for t in made]
        self._costs = [cost[t] for t in made]
        self._joins = {
            self._number[t[:k]] << _BITS | self._number[t[k:]]: u
            for u, t in enumerate(made) for k in range(1, len(t)) if t[:k] in self._number and t[k:] in self._number}
        held = Counter(cost.values())
        tied = [t for t in self._ids if len(t) > 1 and held[cost[t]] > 1]
        self._ties = SPACE * 2 if tied and all(SPACE * 2 in t for t in tied) else "" if tied else None
        self._cut = re.compile(_cuts([t for t in self._ids if len(t) > 1]))
        self._told = _Cache(self._tell)

    def _chunk_ids(self, chunk: str) -> list[int]:
        """Ids of the symbols that are left when the agenda is empty."""
        number = self._number.get
        symbols = [number(c, -1 - ord(c)) for c in chunk]
        tied = self._ties is not None and self._ties in chunk
        symbols = (self._by_heap if tied or len(symbols) > SHORT else self._by_scan)(symbols)
        if 0 <= min(symbols) and max(symbols) < len(self._texts):
            return symbols
        found = []
        for s in symbols:   # a symbol that is no piece is a single character
            if 0 <= s < len(self._texts):
                found.append(s)
            else:
                c = chr(-1 - s) if s < 0 else self._alone[s - len(self._texts)]
                found += [self._byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return found

    def _by_scan(self, symbols: list[int]) -> list[int]:
        """The agenda of a short chunk stands in the order of places; no two pieces share a score."""
        joins, made = self._joins.get, self._made
        agenda = [joins(a << _BITS | b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != _NONE:
            i = agenda.index(best)
            joined = symbols[i] = made[best]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = joins(joined << _BITS | symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = joins(symbols[i - 1] << _BITS | joined, _NONE)
        return symbols

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """An entry is a cost, a place and the piece that its pair makes; one whose pair has changed since
        is passed over."""
        joins, made, costs = self._joins.get, self._made, self._costs
        last = len(symbols) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        pair = [joins(a << _BITS | b, _NONE) for a, b in zip(symbols, symbols[1:])] + [_NONE]
        agenda = [(costs[u], i, u) for i, u in enumerate(pair) if u != _NONE]
        heapq.heapify(agenda)

        def offer(i: int) -> None:
            u = pair[i] = joins(symbols[i] << _BITS | symbols[after[i]], _NONE) if after[i] >= 0 else _NONE
            if u != _NONE:
                heapq.heappush(agenda, (costs[u], i, u))

        while agenda:
            _, i, u = heapq.heappop(agenda)
            if pair[i] != u:
                continue
            j = after[i]
            symbols[i], symbols[j], pair[j] = made[u], _GONE, _NONE
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s != _GONE]

    def chunks(self, text: str) -> list[str]:
        return self._cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self._chunk_ids(chunk)]

    def _said(self, ids: list[int]) -> str:
        """Text of ids, the first space included."""
        kinds, texts = self._kinds, self._texts
        if all(kinds[i] == NORMAL for i in ids):
            return "".join([texts[i] for i in ids]).replace(SPACE, " ")
        found, held = [], bytearray()
        for i in [*ids, None]:
            if i in self._byte_of:
                held.append(self._byte_of[i])
                continue
            if held:
                found.append(_characters(bytes(held)))
                held.clear()
            if i is not None and kinds[i] == NORMAL:
                found.append(texts[i].replace(SPACE, " "))
            elif i is not None and kinds[i] == UNKNOWN:
                found.append(self._unknown)
        return "".join(found)

    def decode(self, ids: list[int]) -> str:
        """Control ids say nothing; bytes that are no character become U+FFFD each; the space that the
        first piece begins with goes."""
        first = next((i for i in ids if self._kinds[i] != CONTROL), None)
        return self._said(ids)[first is not None and self._kinds[first] == NORMAL and self._texts[first].startswith(SPACE):]

    def _tell(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids, text) of a chunk."""
        ids = self._chunk_ids(chunk)
        return len(ids), ",".join(map(str, ids)), self._said(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by commas, decoded text) of a text."""
        found = list(map(self._told.__getitem__, self.chunks(text)))
        said = "".join([x[2] for x in found])
        return sum([x[0] for x in found]), ",".join([x[1] for x in found]), said[1:]


def _characters(data: bytes) -> str:
    found = []
    while data:
        try:
            return "".join([*found, data.decode()])
        except UnicodeDecodeError as error:
            found += [data[:error.start].decode(), "�"]
            data = data[error.start + 1:]
    return "".join(found)


@functools.lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


@functools.lru_cache(maxsize=4)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mapped(docs: DataFrame, path: str | None, source, name: str, kind: str, arrow: pa.DataType, method: str) -> DataFrame:
    path = path or vocabulary_path()
    rest = [c for c in docs.columns if c != name]
    payload = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), source.alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = getattr(coder(path), method)
        for batch in batches:
            done = pa.array([act(x.as_py()) for x in batch.column(1)], arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), done], ["row", "done"])

    return payload.mapInArrow(run, f"row {payload.schema['row'].dataType.simpleString()}, done {kind}").select(
        "row.*", F.col("done").alias(name))


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with a column ids array<int>; null and empty texts have no ids. An older column of the name
    ids is replaced, other columns stay."""
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return _mapped(docs, path, source, "ids", "array<int>", pa.list_(pa.int32()), "encode")


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with a column decoded string; null ids are none. An older column of the name decoded is
    replaced, other columns stay."""
    source = F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>"))
    return _mapped(docs, path, source, "decoded", "string", pa.string(), "decode")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs (doc_id, text).

    A null or empty text has no ids: 0 and the digests of the empty string. Rows are independent, so
    repeated rows and null doc_ids stay as they are; other columns are ignored; an empty table gives none."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                n, said, back = own.digest(text.as_py())
                counts.append(n)
                ids.append(hashlib.sha256(said.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def check(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_library, agrees) for every row of docs (doc_id, text): whether ids and decoded
    text equal those of the sentencepiece library, which takes a batch of rows at a time."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, library = coder(path), _library(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            wanted = library.encode(texts, num_threads=1)
            back = library.decode(wanted, num_threads=1) if texts else []
            found = [own.encode(t) for t in texts]
            same = [a == b and own.decode(a) == c for a, b, c in zip(found, wanted, back)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([len(x) for x in wanted], pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "n_library", "agrees"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, n_library long, agrees boolean")
