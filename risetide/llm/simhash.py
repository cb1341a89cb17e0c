"""SimHash near-dedup: fingerprints, pivot distance tables, verified links, components.

Method. A fingerprint's distances to PIVOTS reference fingerprints are computed once and packed into
its table. Two fingerprints that differ in at most 2 bits have coordinates that differ by at most 2, by
the triangle inequality, so a larger coordinate difference discards a pair before it is verified.

So that no task meets all pairs, fingerprints meet in cells first. The 64 bits are cut into 8 blocks;
for a reference that differs from another one in one block alone, the difference of the two distances
depends on that block alone. Two changed bits leave at least 6 blocks, and so 6 blocks' coordinates,
equal. The coordinates of a block's 8 one-bit references stand one to one for its bits, so a cell's key
is the fingerprint with 2 of its 8 blocks masked out: 28 keys for each distinct fingerprint. A cell
holds at most 2^16 distinct fingerprints whatever the data, as only 16 bits are free in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from risetide.llm.roots import roots_of
from risetide.llm.work import components, saved, text_bytes

SHINGLE = 3
RADIUS = 2
SEED = 42
PIVOTS = 16
_BLOCKS = 8
_PART = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def reference_fingerprints() -> list[int]:
    """Spread-out references, from a fixed rule."""
    return [int.from_bytes(hashlib.sha256(f"reference {i}".encode()).digest()[:8], "big") for i in range(PIVOTS)]


def cell_masks() -> list[int]:
    """For each choice of 2 of the 8 blocks: the bits of the other 6."""
    width = 64 // _BLOCKS
    block = [((1 << width) - 1) << (width * i) for i in range(_BLOCKS)]
    return [((1 << 64) - 1) ^ sum(block[i] for i in free) for free in combinations(range(_BLOCKS), RADIUS)]


def fingerprint_of(data: bytes) -> int:
    """Majority of each bit over the hashes of all word 3-grams; zero without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = len(words) - SHINGLE + 1
    if size <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:size].tolist()
    ends = (ends[SHINGLE - 1:] - 1).tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, size, _PART):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _PART], ends[at:at + _PART])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; a null text counts as empty. A doc_id that is a struct stays one."""
    own = docs.schema["doc_id"].dataType
    kind = own.simpleString() if isinstance(own, StructType) else "long"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint_of(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast(kind), text_bytes()).mapInArrow(of, f"doc_id {kind}, fp long")


def _with_tables(distinct: DataFrame) -> DataFrame:
    """Adds the pivot distances, eight to a long."""
    near = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in reference_fingerprints()]
    packed = []
    for at in range(0, PIVOTS, 8):
        parts = [F.shiftleft(d, 8 * i) for i, d in enumerate(near[at:at + 8])]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.bitwiseOR(part)
        packed.append(whole)
    return distinct.select("fp", F.array(*packed).alias("table"))


def near_pairs(fps: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs within RADIUS bits; pairs whose coordinates differ by more are not verified."""
    order = np.argsort(tables[:, 0], kind="stable")
    fps, tables = fps[order], tables[order]
    first = tables[:, 0]
    left, right = [], []
    for at in range(0, len(fps), 256):
        rows = slice(at, at + 256)
        end = int(np.searchsorted(first, first[min(at + 255, len(fps) - 1)] + RADIUS, "right"))
        there = slice(at, end)
        close = np.triu(np.ones((len(fps[rows]), end - at), bool), 1)
        for c in range(tables.shape[1]):
            close &= np.abs(tables[rows, None, c] - tables[None, there, c]) <= RADIUS
        i, j = np.nonzero(close)
        good = np.bitwise_count(fps[rows][i] ^ fps[there][j]) <= RADIUS
        left.append(order[at + i[good]])
        right.append(order[at + j[good]])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect all that are linked."""
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("bits")) for i, m in enumerate(cell_masks())])
    cells = (
        _with_tables(distinct).select("fp", "table", F.explode(masks).alias("m"))
        .groupBy("m.mask", F.col("fp").bitwiseAND(F.col("m.bits")).alias("key"))
        .agg(F.collect_list("fp").alias("fps"), F.flatten(F.collect_list("table")).alias("tables"))
        .where(F.size("fps") > 1).select("fps", "tables")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps, tables in zip(batch.column(0), batch.column(1)):
                signed = fps.values.to_numpy()
                coordinates = tables.values.to_numpy().view(np.int8).reshape(len(signed), -1)
                i, j = near_pairs(signed.view(np.uint64), coordinates)
                if len(i):
                    root = roots_of(len(signed), i, j)
                    far = np.nonzero(root != np.arange(len(signed)))[0]
                    a.append(signed[far])
                    b.append(signed[root[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return cells.mapInArrow(linked, "a long, b long").distinct()


def _components_of(printed: DataFrame) -> DataFrame:
    """(fp, component_id) of every fingerprint of printed (doc_id, fp)."""
    distinct = saved(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    reached = components(links(distinct.select("fp")), "simhash-links")
    placed = (
        distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("label"))
    )
    smallest = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    return placed.join(smallest, "label").select("fp", "component_id", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs (doc_id, text).

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest doc_id that links
    reach. kept: the row's doc_id is its component_id. A null or empty text has fingerprint zero and is
    linked like any other; equal rows get equal results; a row without doc_id gets its component's, and
    is kept only if none of its component has a doc_id. Empty table: no rows. Other columns are ignored.
    """
    printed = saved(fingerprints(docs), "simhash-fingerprints")
    return printed.join(_components_of(printed), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each component: that with the smallest doc_id, and of several
    with that doc_id the one with the smallest digest of its text. Rows equal in doc_id and text are one
    document, of which one row stays. Rows without doc_id all stay, as nothing names the ones to drop. A null
    or empty text is like any other; an empty table gives no rows; columns stay as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.where("doc_id is not null")
    place = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))
    packed = named.select(place.alias("doc_id"), text.alias("text"))
    printed = saved(fingerprints(packed), "simhash-fingerprints")
    groups = _components_of(printed)
    kept = printed.join(groups, "fp").groupBy("label").agg(F.min("doc_id").alias("kept")).select("kept")
    names = [f"`{c}`" for c in docs.columns]
    row = F.struct(*names)
    found = named.select(place.alias("place"), row.alias("row")).join(kept, F.col("place") == F.col("kept"), "left_semi")
    # rows equal in doc_id and text: the smallest of those that the others tell apart
    return found.groupBy("place").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*").unionByName(docs.where("doc_id is null"))
