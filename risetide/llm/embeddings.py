"""Embedding near-dedup: an exact metric range join.

Vectors are scaled to length 1. Pivots partition them: a vector's home is the nearest pivot's cell. A
vector is also sent to another pivot's cell if a vector there may be within the angle of the threshold.
Two bounds, both consequences of the triangle inequality on the sphere, decide: what lies in the cell of
q but within the angle of x means that x is no farther than that angle from the plane between its own
pivot and q; and no farther from q than that angle plus the radius of q's cell. A pair meets once: in
the home cell of one of its vectors, the one whose pivot has the larger number.

Cells join independently. A cell is cut into tiles of at most about TILE home vectors by TILE visitors,
so a hot cell is spread over many tasks with bounded memory, and what a tile returns is linear in its
vectors: link counts and spanning links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risetide.llm.roots import roots_of
from risetide.llm.work import components, saved

THRESHOLD = 0.9
TILE = 4096
#: Pivots: one for this many distinct vectors, MAX_PIVOTS at most, chosen from a sample of SAMPLE vectors.
VECTORS_PER_PIVOT = 8192
MAX_PIVOTS = 512
SAMPLE = 4096
#: Added to angles and taken from products, far over rounding and far under any angle that matters.
SLACK = 1e-6


def _matrix(column: pa.Array | list, width: int) -> np.ndarray:
    """Rows in double precision, shorter vectors padded with zeros."""
    rows = [np.asarray(x, np.float64) for x in column]
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _scaled(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)   # no overflow in the squares
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample's vector farthest from all pivots so far."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _visits(vectors: np.ndarray, pivots: np.ndarray, angle: float, radius: np.ndarray | None):
    """Home cell of each vector, its angle to that pivot, and which cells it must be sent to."""
    near = vectors @ pivots.T
    home = near.argmax(axis=1)
    own = near[np.arange(len(vectors)), home]
    if radius is None:
        return home, np.arccos(np.clip(own, -1, 1)), None
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        height = np.where(apart > SLACK, (own[:, None] - near) / apart, 0)
    sent = height <= np.sin(angle) + SLACK
    sent &= np.arccos(np.clip(near, -1, 1)) <= angle + radius[None, :] + SLACK
    sent &= np.arange(len(pivots))[None, :] > home[:, None]
    sent[np.arange(len(vectors)), home] = True
    return home, None, sent


def join_tile(left: np.ndarray, right: np.ndarray, allowed: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of a tile that link: a fast product first, then the cosine in double precision."""
    rough = left.astype(np.float32) @ right.astype(np.float32).T
    i, j = np.nonzero((rough >= threshold - 1e-4) & allowed)
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]])
    good = exact >= threshold
    return np.stack([i[good], j[good]])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Rows link at a cosine of threshold or more in double precision, threshold over 0. Vectors that are
    null, empty, zero or hold null or non-finite parts link with nothing and are their own component.
    A shorter vector counts as padded with zeros. Equal vectors are joined once, and count as the rows
    they are. Rows with the same vec_id are rows of their own, in one component. A null vec_id is never
    a component_id unless nothing else is reached. Empty table: no rows. Other columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = saved(rows.select("vec_id", F.when(usable, F.col("v")).alias("v")), "embedding-rows")
    distinct = saved(
        rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("id", F.monotonically_increasing_id()), "embedding-distinct")
    number, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not number:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = saved(_tiles(distinct, number, width, threshold), "embedding-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "embedding-edges")
    placed = (
        distinct.join(counts, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
        .select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("label"))
    )
    smallest = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "label").select("v", "n_links", "component_id")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(named, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def _tiles(distinct: DataFrame, number: int, width: int, threshold: float) -> DataFrame:
    """(id, links, root): for vectors with links in a tile, the copies linked there and a spanning link."""
    spark = distinct.sparkSession
    angle = float(np.arccos(threshold))
    share = min(1.0, 4.0 * SAMPLE / number)
    some = distinct.select("v").sample(share, 7).limit(SAMPLE).collect() or distinct.select("v").limit(SAMPLE).collect()
    count = max(1, min(MAX_PIVOTS, number // VECTORS_PER_PIVOT))
    pivots = spark.sparkContext.broadcast(choose_pivots(_scaled(_matrix([x.v for x in some], width)), count))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                home, far, _ = _visits(_scaled(_matrix(batch.v, width)), pivots.value, angle, None)
                yield pd.DataFrame({"cell": home, "far": far})

    count = len(pivots.value)
    radius = np.full(count, -10.0)
    held = np.ones(count, np.int64)
    for row in distinct.select("v").mapInPandas(homes, "cell int, far double").groupBy("cell").agg(
            F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():   # a row for each pivot
        radius[row.cell], held[row.cell] = row.far, row.n

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                home, _, sent = _visits(_scaled(_matrix(batch.v, width)), pivots.value, angle, radius)
                i, cell = np.nonzero(sent)
                yield pd.DataFrame({"cell": cell, "home": home[i], "id": batch.id.to_numpy()[i]})

    visitors = saved(distinct.select("id", "v").mapInPandas(placed, "cell int, home int, id long"), "embedding-cells")
    visits = np.ones(count, np.int64)
    for row in visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():   # a row for each pivot
        visits[row.cell] = row.n
    across = F.array(*[F.lit(int(-(-x // TILE))) for x in held])
    down = F.array(*[F.lit(int(-(-x // TILE))) for x in visits])
    mixed = F.abs(F.xxhash64("id"))
    cell_rows = visitors.withColumn("h", F.element_at(across, F.col("cell") + 1)).withColumn("d", F.element_at(down, F.col("cell") + 1))
    at_home = cell_rows.where("cell = home").select(
        "id", "cell", "home", F.lit(True).alias("own"), (mixed % F.col("h")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("y"))
    come = cell_rows.select(
        "id", "cell", "home", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("x"),
        (mixed % F.col("d")).cast("int").alias("y"))
    dealt = at_home.unionByName(come).join(distinct.select("id", "copies", F.col("v").cast("array<float>").alias("f"), "v"), "id")
    # single precision travels where it says the same
    same = F.col("f").cast("array<double>") == F.col("v")
    dealt = dealt.select("cell", "home", "own", "x", "y", "id", "copies", F.when(same, F.col("f")).alias("f"),
                         F.when(~same, F.col("v")).alias("v"))

    def linked(tile: pd.DataFrame) -> pd.DataFrame:
        values = tile.f.where(tile.f.notna(), tile.v)
        own = tile.own.to_numpy(bool)
        ids, copies, home = tile.id.to_numpy(), tile.copies.to_numpy(), tile.home.to_numpy()
        left = _scaled(_matrix(values[own], width)) if own.any() else np.zeros((0, width))
        right = _scaled(_matrix(values[~own], width)) if (~own).any() else np.zeros((0, width))
        left_ids, right_ids = ids[own], ids[~own]
        left_copies, right_copies = copies[own], copies[~own]
        same_cell = home[~own] == tile.cell.iloc[0]
        all_ids = np.unique(ids)
        links = np.zeros(len(all_ids), np.int64)
        root = np.arange(len(all_ids))
        left_at, right_at = np.searchsorted(all_ids, left_ids), np.searchsorted(all_ids, right_ids)
        for at in range(0, len(left_ids), 512):
            part = slice(at, at + 512)
            allowed = ~same_cell[None, :] | (left_ids[part, None] < right_ids[None, :])
            i, j = join_tile(left[part], right, allowed, threshold)
            a, b = left_at[part][i], right_at[j]
            np.add.at(links, a, right_copies[j])
            np.add.at(links, b, left_copies[part][i])
            if len(a):
                root = root[roots_of(len(all_ids), np.concatenate([a, np.arange(len(root))]), np.concatenate([b, root]))]
        some = links > 0
        return pd.DataFrame({"id": all_ids[some], "links": links[some], "root": all_ids[root[some]]})

    return dealt.groupBy("cell", "x", "y").applyInPandas(linked, "id long, links long, root long")
