"""Source divergence audit by one-hot level products.

1. One pass counts terms in the tasks, so a hot source or term leaves a task as one row; counts and the
   numbers of documents add up per (lang, source, term).
2. A lang keeps the terms of at least LEAST_DOCUMENTS of its documents. Each group's price of a count is
   p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), in exact decimals.
3. A cell is a block of a lang's kept terms times a pair of blocks of its sources. Within it each (source,
   count level) is an indicator column over the terms, and the product of the columns' transpose with the
   columns holds how many terms have one level here and another there: every joint table of two sources.
   Entries are below 2^24, so single-precision products are exact. A joint table times the prices of its
   levels is the cell's part of both sources' divergences; parts add up in Spark. Blocks have terms of
   similar frequency, so that a block of rare terms has few levels and a block of frequent ones few terms.

Nothing is collected; cells are bounded by TERMS and SOURCES, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risetide.llm.work import delete_table, saved
from risetide.operators.joins import salted_lookup

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 10 ** 9
#: Kept terms in a block: of those whose count is below 2 ** FEW in their lang, and of more frequent ones.
TERMS, FREQUENT_TERMS, FEW = 1024, 256, 10
SOURCES = 64
#: Counts that a task holds before it hands them on.
_HELD = 500_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences of a term, and how many rows have it, for each row of
    docs (text, lang, source). A row without a term marks that the group occurs; null columns are ''."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)

        def told() -> pa.RecordBatch:
            keys, terms, ns, ds = [], [], [], []
            for key, counts in held.items():
                keys += [key] * (len(counts) + 1)
                terms += [*(t.decode("utf-8", "surrogatepass") for t in counts), None]
                ns += [*(x >> 32 for x in counts.values()), 0]
                ds += [*(x & 0xFFFFFFFF for x in counts.values()), 0]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.string()),
                 pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], ["lang", "source", "term", "n", "documents"])

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = held[lang, source]
                before = len(counts)
                for t, n in Counter(terms_of(text)).items():    # occurrences above, documents below
                    counts[t] = counts.get(t, 0) + (n << 32 | 1)
                size += len(counts) - before
                if size >= _HELD:
                    yield told()
                    size = 0
        yield told()

    partial = own.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _price(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 kept)), exact; null without kept terms."""
    return F.when(F.col(kept) > 0, F.expr(
        f"1L + (cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(19, 0))) div cast({total} + 2 * {kept} as decimal(19, 0))"))


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def prices(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """Prices of counts; Python's integers where 64 bits don't hold the product."""
    if len(counts) and (int(counts.max()) + 2) * SCALE < 1 << 62:
        return 1 + (counts + 2) * SCALE // (total + 2 * kept)
    return np.array([1 + (int(c) + 2) * SCALE // (total + 2 * kept) for c in counts], np.int64)


def joint_tables(counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """counts: terms x sources. For each source in left with each in right: both, the levels (distinct
    counts in ascending order) of a table's entries here and there, and the number of terms in each entry.
    Entries without terms are left out."""
    if not len(left) or not len(right):
        return
    levels, codes = zip(*(np.unique(counts[:, c], return_inverse=True) for c in range(counts.shape[1])))
    terms = np.arange(len(counts))

    def one_hot(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(levels[c]) for c in columns])
        starts = np.cumsum(sizes) - sizes
        marks = np.zeros((len(counts), int(sizes.sum())), np.float32)
        for c, at in zip(columns, starts):
            marks[terms, at + codes[c]] = 1
        return marks, np.repeat(columns, sizes), np.concatenate([levels[c] for c in columns])

    there, owners, level_there = one_hot(right)
    for c in left:
        here, _, level_here = one_hot(np.array([c]))
        joint = here.T @ there
        i, j = np.nonzero(joint)
        order = np.argsort(owners[j], kind="stable")
        i, j = i[order], j[order]
        ends = np.searchsorted(owners[j], right, side="right")
        starts = np.searchsorted(owners[j], right, side="left")
        for d, low, high in zip(right.tolist(), starts.tolist(), ends.tolist()):
            a, b = i[low:high], j[low:high]
            yield int(c), d, level_here[a], level_there[b], joint[a, b].astype(np.int64)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """For a cell's pairs of sources, over its terms that not both lack: how many, and the sum of their gaps."""
    lang, x, y = rows["lang"].iloc[0], int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
    roster = rows[rows["term"].isna()].sort_values("source").reset_index(drop=True)
    own = rows[rows["term"].notna()]
    found = {k: [] for k in ("source", "item", "value", "terms")}
    if len(own):
        term, names = pd.factorize(own["term"])
        counts = np.zeros((len(names), len(roster)), np.int64)
        counts[term, pd.Index(roster["source"]).get_indexer(own["source"])] = own["n"].to_numpy()
        totals, kept = roster["group_total"].to_numpy(), int(roster["kept"].iloc[0])
        block = roster["block"].to_numpy()
        for a, b, here, there, n in joint_tables(counts, np.nonzero(block == x)[0], np.nonzero(block == y)[0]):
            if a == b:
                continue
            some = (here > 0) | (there > 0)
            p, q = prices(here[some], int(totals[a]), kept), prices(there[some], int(totals[b]), kept)
            value = int(((p - q) * (p - q) // (p + q) * n[some]).sum())
            for one, other in ((a, b), (b, a))[:1 if x == y else 2]:
                found["source"].append(roster["source"].iloc[one])
                found["item"].append(roster["source"].iloc[other])
                found["value"].append(value)
                found["terms"].append(int(n[some].sum()))
    told = {"lang": [lang] * len(found["source"]), **found}
    return pd.DataFrame({k: pd.Series(v, dtype="int64" if k in ("value", "terms") else object) for k, v in told.items()})


def _other_blocks(df: DataFrame) -> DataFrame:
    """Each row once for every pair (x, y), x <= y, of source blocks that its own block is in."""
    return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1))).withColumns(
        {"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source).

    A term is a run of letters (ASCII in lower case, anything beyond ASCII); a lang keeps the terms of at
    least LEAST_DOCUMENTS of its rows. Part 'pair': each other source of the lang, by the sum over kept terms
    of (p - q)^2 / (p + q), rounded down for each term, of the two sources' prices; all ranks. Part 'term':
    the TOP terms that occur in the group and cost more there than in the whole lang. Ranks go by value
    descending, then item.

    Null text, lang and source are ''. Every row counts as a document, repeated ones too; a group without
    terms occurs as well; a lang without kept terms has pairs of value 0. Other columns are ignored; an empty
    table gives no rows."""
    counts = saved(count_terms(docs), "divergence-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("documents").alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS)
    kept_counts = saved(counts.where("term is not null").select("lang", "source", "term", "n").join(
        kept.select("lang", "term", "total"), ["lang", "term"]), "divergence-kept")
    # every kept term has a row, so lang totals and vocabularies can be told from kept_counts
    terms = kept_counts.groupBy("lang", "term").agg(F.max("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    group_totals = kept_counts.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = counts.where("term is null").select("lang", "source").join(group_totals, ["lang", "source"], "left")
    sources = counts.where("term is null").groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("source_blocks"))
    groups = saved(
        groups.join(langs, "lang", "left").join(sources, "lang").select(
            "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("group_total", "kept", "lang_total")), "source_blocks",
            F.pmod(F.xxhash64("source"), "source_blocks").cast("int").alias("block")), "divergence-groups")
    delete_table(counts)
    priced = _looked_up(kept_counts, groups, ["lang", "source"], "term")
    return _pairs(priced, groups, terms).unionByName(_terms(priced))


def _looked_up(left: DataFrame, right: DataFrame, on: list[str], spread_by: str) -> DataFrame:
    """left with the columns of right's one row for each value of on, few of which may have most rows."""
    key = F.struct(*on)
    found = salted_lookup(left.withColumn("_key", key), right.withColumn("_key", key).drop(*on), "_key", F.col(spread_by), "inner")
    return found.drop("_key")


def _terms(priced: DataFrame) -> DataFrame:
    rated = priced.withColumns({"p": _price("n", "group_total", "kept"), "q": _price("total", "lang_total", "kept")}).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP))


def _pairs(priced: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    band = F.when(F.col("total") < 1 << FEW, 0).otherwise(F.floor(F.log2(F.col("total").cast("double"))).cast("int"))
    size = F.when(F.col("band") == 0, TERMS).otherwise(FREQUENT_TERMS)
    bands = terms.withColumn("band", band).groupBy("lang", "band").agg(F.count(F.lit(1)).alias("terms")).select(
        "lang", "band", F.ceil(F.col("terms") / size).cast("int").alias("term_blocks"))
    columns = ["lang", "band", "term_block", "source", "term", "n", "group_total", "kept", "block", "source_blocks"]
    counted = _looked_up(priced.withColumn("band", band), bands, ["lang", "band"], "term").withColumn(
        "term_block", F.pmod(F.xxhash64("term"), "term_blocks").cast("int")).select(*columns)
    # each cell knows all its sources, also those without any of its terms
    roster = groups.join(bands, "lang").withColumns({
        "term_block": F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)), "term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}).select(*columns)
    cells = _other_blocks(counted.unionByName(roster)).groupBy("lang", "band", "term_block", "x", "y").applyInPandas(
        _cell, "lang string, source string, item string, value long, terms long")
    # a row for each pair, with what a term costs that both lack
    one = groups.withColumn("n", F.lit(0).cast("long")).withColumn("p", _price("n", "group_total", "kept"))
    left = one.select("lang", "source", "kept", "p", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)).alias("y"))
    right = one.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("block").alias("y"),
                       F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)).alias("x"))
    pairs = left.join(right, ["lang", "x", "y"]).where("source <> item").select(
        "lang", "source", "item", "kept", F.coalesce(_gap("p", "q"), F.lit(0)).alias("lacking"))
    none = F.lit(0).cast("long")
    found = pairs.withColumns({"value": none, "terms": none}).unionByName(
        cells.withColumns({"kept": none, "lacking": none})).groupBy("lang", "source", "item").agg(
        (F.sum("value") + (F.max("kept") - F.sum("terms")) * F.max("lacking")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
