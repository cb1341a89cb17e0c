"""Line dedup: SimHash of normalised lines, a join on pigeonhole blocks, and a check of edit similarity.

1. One pass over the texts gives each line the digest of its normalised form and a SimHash of BLOCKS * 16
   bits over its words, each occurrence a vote, and is written; lines equal when normalised become one distinct
   line, combined in the map tasks.
2. Prints that differ in fewer than BLOCKS bits share a block (pigeonhole), and nearer ones share many. A
   block's number and value are a key. What meets under a key are prints and lengths, never texts, sorted by
   length and streamed; a line stays that has a partner of a length that edit similarity allows, within
   RADIUS bits of the first 128, and with this block the first that both share, so that a pair meets once.
   (Of the blocks behind the first 128 bits, which don't travel with a key, several may meet.)
   Those lines, with all bits, meet again, and stay with a partner within RADIUS_OF_ALL bits.
3. The texts of those lines alone are read again. Lines of a key meet in tiles of bounded bytes; a key with
   more text is cut into blocks, and each two blocks are a tile. A tile checks the edit similarity of its
   pairs that are within RADIUS_OF_ALL bits and share SHARED of the longer line's distinct words, as near
   prints say they do, but of no pair that checked ones already connect, and returns spanning links; where an
   alignment of the words proves enough similarity, the exact distance isn't computed. Groups
   are the connected components; a group's first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risetide.llm.work import components, delete_table, saved

SIMILARITY = 0.8
#: Set by recall against edit similarity alone, see the README.
BLOCKS = 12
RADIUS, RADIUS_OF_ALL = 20, 30
SHARED = 0.5
TILE_BYTES = 4 << 20
_LONGS = BLOCKS // 4
_SEEN = 8       # blocks in the 128 bits that travel with a key
_ROWS = 1 << 17
_PART = 1 << 16
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_AHEAD = 6      # words that _provably_similar() looks ahead
_PUNCTUATION = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256))


def normalised(line: str) -> bytes:
    """Lower case, ASCII punctuation as space, single spaces."""
    return b" ".join(line.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split())


def _words(text: str) -> tuple[list[int], list[bytes], list[bytes]]:
    """Number, digest and normalised form of each line that has a word."""
    numbers, digests, own = [], [], []
    text = text.lower().encode("utf-8", "replace").translate(_PUNCTUATION)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    for i, line in enumerate(text.split(b"\n")):
        if line := line.strip(b" "):
            own.append(line)
            numbers.append(i)
            digests.append(xxhash.xxh3_128_digest(line))
    return numbers, digests, own


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each of the words that single spaces or newlines part; those of fewer than 32 bytes all at once."""
    letters = np.frombuffer(text + bytes(8), np.uint8)
    eights = np.ndarray(len(text) + 1, "<u8", letters, 0, (1,))    # the eight bytes from each place on
    ends = np.append(np.nonzero((letters[:len(text)] == 32) | (letters[:len(text)] == 10))[0], len(text))
    at = np.append(0, ends[:-1] + 1)
    size = ends - at
    found = size.astype(np.uint64) + _PRIMES[4]
    for k in range(3):
        own = np.nonzero(size >= 8 * k + 8)[0]
        x = eights[at[own] + 8 * k] * _PRIMES[1]
        x = _turned(x, 31) * _PRIMES[0] ^ found[own]
        found[own] = _turned(x, 27) * _PRIMES[0] + _PRIMES[3]
    at += size & ~7
    own = np.nonzero(size & 4)[0]
    x = (eights[at[own]] & np.uint64(0xFFFFFFFF)) * _PRIMES[0] ^ found[own]
    found[own] = _turned(x, 23) * _PRIMES[1] + _PRIMES[2]
    at += size & 4
    for k in range(3):
        own = np.nonzero((size & 3) > k)[0]
        x = letters[at[own] + k] * _PRIMES[4] ^ found[own]
        found[own] = _turned(x, 11) * _PRIMES[0]
    found = (found ^ found >> np.uint64(33)) * _PRIMES[1]
    found = (found ^ found >> np.uint64(29)) * _PRIMES[2]
    found ^= found >> np.uint64(32)
    for k in np.nonzero(size >= 32)[0].tolist():
        found[k] = xxhash.xxh64_intdigest(text[ends[k] - size[k]:ends[k]])
    return found


def prints_of(own: list[bytes]) -> np.ndarray:
    """SimHash of each normalised line, lines x _LONGS: the bits that more than half of its words have."""
    found = []
    at, held = 0, 0
    for end in range(1, len(own) + 1):      # parts that stay in the processor's cache
        held += len(own[end - 1])
        if held >= _PART or end == len(own):
            sizes = np.array([line.count(b" ") for line in own[at:end]]) + 1
            hashes = _word_hashes(b"\n".join(own[at:end]))
            parts = []
            for k in range(_LONGS):
                x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(29)
                parts.append(_majorities(x, sizes))
            found.append(np.stack(parts, axis=1))
            at, held = end, 0
    return np.concatenate(found) if found else np.zeros((0, _LONGS), np.int64)


def _majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of sizes[i] hashes: the bits that more than half of them have. Eight counters of a
    byte share a word, so runs are counted in parts of 255 hashes at most."""
    parts = -(-sizes // 255)
    line_of = np.repeat(np.arange(len(sizes)), parts)
    first_part = np.cumsum(parts) - parts
    starts = (np.cumsum(sizes) - sizes)[line_of] + 255 * (np.arange(len(line_of)) - first_part[line_of])
    ones = np.empty((len(starts), 64), np.uint8)
    for shift in range(8):
        lanes = hashes >> np.uint64(shift) & np.uint64(0x0101010101010101)
        ones[:, shift::8] = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
    counts = ones if len(starts) == len(sizes) else np.add.reduceat(ones, first_part, axis=0, dtype=np.int64)
    return np.packbits(counts > sizes[:, None] // 2, axis=1, bitorder="little").copy().view("<i8")[:, 0]


def _meet(x: np.ndarray, y: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Whether two prints of 128 bits (their exclusive or, in two halves) are within RADIUS bits, and share
    none of the blocks before block."""
    near = np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y) <= RADIUS
    at = np.nonzero(near)[0]
    for k in range(_SEEN):
        half = (x if k < 4 else y)[at] >> np.uint64(16 * (k % 4)) & np.uint64(0xFFFF)
        at = at[(half != 0) | (block[at] <= k)]
    near[:] = False
    near[at] = True
    return near


def _partnered(key: np.ndarray, size: np.ndarray, p0: np.ndarray, p1: np.ndarray, p2: np.ndarray | None = None) -> np.ndarray:
    """Which rows, sorted by key and size, have a partner under their key; with p2, within RADIUS_OF_ALL bits too."""
    found = np.zeros(len(key), bool)
    alive, shift = np.arange(len(key)), 0
    while len(alive):
        shift += 1
        alive = alive[:np.searchsorted(alive, len(key) - shift)]
        other = alive + shift
        # sizes ascend: a pair too unequal ends its row's part
        alive = alive[(key[alive] == key[other]) & (size[other] - size[alive] <= _allowed(size[other]))]
        other = alive + shift
        near = _meet(p0[alive] ^ p0[other], p1[alive] ^ p1[other], key[alive] >> 16)
        if p2 is not None:
            at = np.nonzero(near)[0]
            i, j = alive[at], other[at]
            near[at] = sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int16) for p in (p0, p1, p2)) <= RADIUS_OF_ALL
        found[alive[near]] = True
        found[other[near]] = True
    return found


def _allowed(size: np.ndarray) -> np.ndarray:
    """Edits that similarity allows for a longer text of that size."""
    return ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, one bit for each character of b; where it is more than most, perhaps another number
    above most: it is looked up on the way, as it does not fall along a diagonal."""
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    up, down = full, 0
    for i in range(0, len(a), 32):
        if most is not None and (at := len(b) - len(a) + i) > 0:
            seen = (1 << at) - 1
            if (so_far := i + (up & seen).bit_count() - (down & seen).bit_count()) > most:
                return so_far
        for c in a[i:i + 32]:
            equal = where.get(c, 0)
            flat = ((((equal & up) + up) ^ up) | equal | down) & full
            rises = ((down | (flat | up) ^ full) << 1 | 1) & full
            up, down = (up & flat) << 1 & full | (flat | rises) ^ full, rises & flat
    return len(a) + up.bit_count() - down.bit_count()


def _provably_similar(a: list[str], b: list[str], allowed: int) -> bool:
    """Whether some alignment of the words, with one space behind each, costs no more than the allowed edits:
    where words differ, it goes on at the nearest equal ones, at most _AHEAD words on."""
    i = j = cost = 0
    while True:
        for x, y in zip(islice(a, i, None), islice(b, j, None)):
            if x != y:
                break
            i += 1
            j += 1
        else:       # one of them has ended
            return cost + sum(map(len, a[i:])) + len(a) - i + sum(map(len, b[j:])) + len(b) - j <= allowed
        for far in range(1, _AHEAD + 1):
            x, y = a[i:i + far + 1], b[j:j + far + 1]
            if len(x) > far and len(y) > far and x[far] == y[far]:
                di, dj = far, far
            elif len(y) > far and y[far] in x[:far]:
                di, dj = x.index(y[far]), far
            elif len(x) > far and x[far] in y[:far]:
                di, dj = far, y.index(x[far])
            else:
                continue
            break
        else:
            di, dj = len(a) - i, len(b) - j
        cost += max(sum(map(len, a[i:i + di])) + di, sum(map(len, b[j:j + dj])) + dj)
        if cost > allowed:
            return False
        i, j = i + di, j + dj


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Edit similarity, 1 - distance / longer length, of least or more."""
    longer = max(len(a), len(b))
    allowed = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    if _provably_similar(a.split(" "), b.split(" "), allowed):
        return True
    for _ in range(2):      # drop what both begin with, then what both end with
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        a, b = a[low:][::-1], b[low:][::-1]
    if max(len(a), len(b)) <= allowed:
        return True
    return edit_distance(a, b, allowed) <= allowed


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, h, size, p0, p1, p2): every line with a word, its size in characters and its print; th
    tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, digests, own = _lines_of(batch)
            # lines equal when normalised are looked at once
            kinds = dict(zip(digests, own))
            place = dict(zip(kinds, range(len(kinds))))
            sizes = np.array([len(x) if x.isascii() else len(x.decode()) for x in kinds.values()], np.int32)
            prints = prints_of(list(kinds.values()))
            where = np.fromiter(map(place.__getitem__, digests), np.int64, len(digests))
            ids = batch.select(["doc_id", "th"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), pa.array(sizes[where], pa.int32()),
                 *(pa.array(prints[where, k]) for k in range(_LONGS))],
                ["doc_id", "th", "line", "h", "size", *(f"p{k}" for k in range(_LONGS))])

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, line int, h binary, size int, p0 long, p1 long, p2 long")


def _lines_of(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes], list[bytes]]:
    """Row, number, digest and normalised form of the lines of a batch of _keyed()."""
    at, numbers, digests, own = [], [], [], []
    for i, text in enumerate(batch.column(2)):
        found = _words(text.as_py())
        at += [i] * len(found[0])
        numbers += found[0]
        digests += found[1]
        own += found[2]
    return at, numbers, digests, own


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))


def _members(distinct: DataFrame) -> DataFrame:
    """(at, p0, p1) of prints that have a partner under a key; at is the key, and the size in its low 32 bits."""
    keys = [F.shiftrightunsigned(f"p{k // 4}", 16 * (k % 4)).bitwiseAND(0xFFFF).bitwiseOR(k << 16) for k in range(BLOCKS)]
    keyed = distinct.select(F.explode(F.array(*[F.shiftleft(key, 32).bitwiseOR(F.col("size")) for key in keys])).alias("at"), "p0", "p1")
    return _with_partners(keyed).distinct()


def _with_partners(keyed: DataFrame) -> DataFrame:
    """The rows (at, p0, p1, perhaps p2 and more) that _partnered() finds. As key and size are one number, rows are
    narrow and Spark's radix sort takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
                if rows < _ROWS:
                    continue
            if not rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at = whole.column("at").to_numpy()
            key = (at >> 32).astype(np.int32)
            # the last key may go on in the next batch
            end = int(np.searchsorted(key, key[-1])) if batch is not None else len(key)
            held, rows = [whole.slice(end)], len(key) - end
            if end:
                prints = [whole.column(c).to_numpy().view(np.uint64)[:end] for c in ("p0", "p1", "p2") if c in whole.schema.names]
                yield whole.slice(0, end).filter(pa.array(_partnered(key[:end], at[:end] & 0xFFFFFFFF, *prints)))

    return keyed.repartition(F.shiftright("at", 32)).sortWithinPartitions("at").mapInArrow(run, keyed.schema)


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, norm): normalised text of the wanted lines (h, first)."""
    by_doc = wanted.groupBy(F.col("first.doc_id").alias("wd"), F.col("first.th").alias("wt")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "h")).alias("lines"))
    keyed = _keyed(docs)
    # texts are not sorted: what meets them is small, and one row a document
    found = keyed.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wt"))).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for text, lines in zip(batch.column(0), batch.column(1).to_pylist()):
                own = text.as_py().split("\n")
                keys += [x["h"] for x in lines]
                texts += [normalised(own[x["line"]]).decode() for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["h", "norm"])

    # repeated rows give a line more than once
    return found.mapInArrow(run, "h binary, norm string").dropDuplicates(["h"])


def tile_links(tile: np.ndarray, block: np.ndarray, prints: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
    """Spanning links of the pairs of rows of one tile that meet under its block, share SHARED of their words, and
    are similar. Rows are sorted by tile."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.lexsort((sizes, tile))
    tile, block, prints, size = tile[order], block[order], prints[order], sizes[order]
    words: dict[int, frozenset[str]] = {}
    up = list(range(len(texts)))
    label = np.arange(len(texts))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def own(x: int) -> frozenset[str]:
        if x not in words:
            words[x] = frozenset(texts[order[x]].split())
        return words[x]

    linked = []
    alive, shift = np.arange(len(texts)), 0
    while len(alive):
        shift += 1
        alive = alive[:np.searchsorted(alive, len(texts) - shift)]
        other = alive + shift
        # sizes ascend: a pair too unequal ends its row's part
        alive = alive[(tile[alive] == tile[other]) & (size[other] - size[alive] <= _allowed(size[other]))]
        i = alive[label[alive] != label[alive + shift]]
        x = prints[i] ^ prints[i + shift]
        i = i[_meet(x[:, 0], x[:, 1], block[i]) & (np.bitwise_count(x).sum(axis=1) <= RADIUS_OF_ALL)]
        before = len(linked)
        for k in i.tolist():
            a, b = root(k), root(k + shift)
            if a != b:
                x, y = own(k), own(k + shift)
                if len(x & y) >= SHARED * max(len(x), len(y)) and similar(texts[order[k]], texts[order[k + shift]]):
                    up[max(a, b)] = min(a, b)
                    linked.append((int(order[k]), int(order[k + shift])))
                    label[max(a, b)] = min(a, b)
        if len(linked) > before:
            while (label != (following := label[label])).any():
                label = following
    return linked


def _links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): digests of distinct lines that link, enough of them to connect all that do."""
    members = _members(distinct).withColumn("size", F.col("at").bitwiseAND(0xFFFFFFFF).cast("int"))
    keyed = distinct.join(members.hint("shuffle_hash"), ["p0", "p1", "size"]).select("at", "p0", "p1", "p2", "h", "first")
    wanted = saved(_with_partners(keyed).select(
        F.shiftright("at", 32).cast("int").alias("key"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("size"), "p0", "p1", "p2", "h", "first"),
        "lines-wanted")
    texts = _line_texts(docs, wanted.select("h", "first").dropDuplicates(["h"]))
    blocks = wanted.groupBy("key").agg(F.ceil(F.sum("size") / TILE_BYTES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    met = wanted.join(blocks, "key").select(
        "key", "h", "p0", "p1", "p2", block.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y")).join(texts, "h")
    tiles = met.select("key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "h", "p0", "p1", "p2", "norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tile in _whole_tiles(batches):
            key, p0, p1, p2 = (rows.column(c).to_numpy() for c in ("key", "p0", "p1", "p2"))
            found = tile_links(tile, key >> 16, np.stack([p0, p1, p2], axis=1).view(np.uint64), rows.column("norm").to_pylist())
            left, right = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([rows.column("h").take(pa.array(left)), rows.column("h").take(pa.array(right))], ["a", "b"])

    by_tile = tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "h")
    return by_tile.mapInArrow(run, "a binary, b binary")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole tiles, sorted by those, and each row's tile as a number; a tile's rows may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
            begins = np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1
            new, last = last is None or (names[0] != last).any(), names[-1]
            if not new and not len(begins):     # all in the tile that is held
                held.append(batch)
                continue
            end = int(begins[-1]) if len(begins) else 0
            done, held = [*held, batch.slice(0, end)], [batch.slice(end)]
        else:
            done, held = held, []
        if rows := pa.Table.from_batches(done).combine_chunks().to_batches() if done else []:
            names = np.stack([rows[0].column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
            yield rows[0], np.concatenate([[0], np.cumsum((names[1:] != names[:-1]).any(axis=1))])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, dropped array<int>): for texts that lose lines, the numbers of those, from 0."""
    lines = saved(_prints(docs), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th", "line")
    distinct = saved(
        lines.groupBy("h").agg(F.min(place).alias("first"), *(F.first(c).alias(c) for c in ("size", "p0", "p1", "p2")),
                                       F.count(F.lit(1)).alias("n")), "lines-distinct")
    reached = components(_links(docs, distinct), "lines-components")
    grouped = (
        distinct.select("h", "first", "n").join(reached.withColumnRenamed("node", "h").hint("shuffle_hash"), "h", "left")
        .where("n > 1 or component is not null").select("h", "first", F.coalesce("component", "h").alias("label"))
    )
    kept = grouped.groupBy("label").agg(F.min("first").alias("kept"))
    touched = saved(grouped.join(kept, "label").select("h", "kept"), "lines-touched")
    delete_table(distinct)
    return lines.select("doc_id", "th", "line", "h").join(touched.hint("shuffle_hash"), "h").where(place != F.col("kept")).groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set("line")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated lines, and with n_lines and n_dropped.

    Lines are what newlines part. Lines that are equal when normalised (lower case, no ASCII
    punctuation, single spaces) are one; others link if their SimHashes share one of BLOCKS blocks and differ in
    at most RADIUS of the first 128 bits and RADIUS_OF_ALL of all, SHARED of the longer one's distinct words
    or more are common, and their edit similarity is SIMILARITY or more. Of each connected group the first occurrence stays, by doc_id (unknown ones last), text and line; the rest go, also within one text. Lines without a word
    stay. A text may become empty; a null text stays null and has one line. Rows with equal doc_id and
    text are one document and get the same result. Empty table: no rows. Columns of docs other than text
    stay as they are; older columns named n_lines or n_dropped are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drops = repeated_lines(docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("dropped").alias("_dropped"))
    joined = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn("_own", F.xxhash64(text)).join(
        drops.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")), "left")
    pieces = F.split(F.col("text"), "\n", -1)
    left = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    return joined.select(
        *[(F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`")) for c in rest],
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).alias("n_dropped"))
