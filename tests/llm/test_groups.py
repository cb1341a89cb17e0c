"""Operators that link rows: lines, embeddings, SimHash; and the helpers they share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risetide.llm import embeddings, lines, simhash
from risetide.llm.work import components

SMALL = "/root/testdata/sf0.001"


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000, x) for x in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2040)]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: forest.find(x) for e in edges for x in e if e[0] != e[1]} | {k: v for k, v in found.items() if forest.find(k) == v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash

def majority(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_brute(rows):
    prints = {d: majority(t) for d, t in rows}
    forest = Forest()
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                forest.join(a, b)
    return {d: (f"{p:016x}", forest.find(d)) for d, p in prints.items()}


def test_simhash(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, None), (9001, ""), (9002, "\u00a0x"), (9003, "A b"), (9004, "a  B\n")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == simhash_brute(rows)
    odd = simhash.near_duplicates(odd_docs).collect()
    assert len(odd) == odd_docs.count() and {r.component_id for r in odd if r.doc_id in (4, 5, None)} == {4}
    stay = simhash.drop_near_duplicates(odd_docs)
    assert stay.columns == odd_docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 1
    assert simhash.near_duplicates(odd_docs.where("false")).count() == 0


def test_one_row_of_a_component_stays(spark):
    rows = [(1, "one text of its own here"), (1, "another text that is not near it"), (2, "another text that is not near it"),
            (1, "one text of its own here"), (3, "ANOTHER text that is not near it"), (None, "one text of its own here")]
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, extra int")
    for parts in (1, 5):
        found = sorted(map(tuple, simhash.drop_near_duplicates(frame.repartition(parts)).collect()), key=str)
        assert found == sorted([(1, rows[0][1], 0), (1, rows[1][1], 1), (None, rows[5][1], 5)], key=str)


def test_linked_fingerprints(spark):
    draw = random.Random(2)
    prints = set()
    for _ in range(40):     # chains and dense groups of near fingerprints
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 30)):
            prints.add(x)
            for _ in range(draw.randint(1, 3)):
                x ^= 1 << draw.randrange(64)
    forest = Forest()
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                forest.join(simhash._signed(a), simhash._signed(b))
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    reached = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    assert {x: reached.get(x, x) for x in map(simhash._signed, prints)} == {x: forest.find(x) for x in map(simhash._signed, prints)}


# embeddings

def cosine_brute(rows):
    usable = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.pad(np.array(v, float), (0, 8 - len(v)))
            usable[i] /= np.abs(usable[i]).max()
            usable[i] /= np.linalg.norm(usable[i])
    links, forest = [0] * len(rows), Forest()
    for a in usable:
        for b in usable:
            if a != b and usable[a] @ usable[b] >= 0.9:
                links[a] += 1
                forest.join(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(forest.find(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(groups[forest.find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("per_pivot", [8192, 20])
def test_embeddings(spark, monkeypatch, per_pivot):
    monkeypatch.setattr(embeddings, "VECTORS_PER_PIVOT", per_pivot)
    monkeypatch.setattr(embeddings, "TILE", 4096 if per_pivot > 100 else 16)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 8))
    vectors = [(centres[draw.integers(12)] + draw.normal(size=8) * draw.choice([0.05, 0.4])).tolist() for _ in range(250)]
    vectors += [vectors[0]] * 30 + [[x * 2 for x in vectors[1]], None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0],
                [1e200] * 8, [1e-200] * 8]
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as home")
    found = embeddings.near_duplicates(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == cosine_brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


# lines

def test_edit_distance():
    draw = random.Random(4)
    for _ in range(500):
        a, b = ("".join(draw.choice("abc ") for _ in range(draw.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert lines.edit_distance(a, b) == row[-1]
        assert lines.similar(a, b) == (row[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_edit_distance_that_ends_early():
    draw = random.Random(11)
    for _ in range(300):
        a = "".join(draw.choice("abcd ") for _ in range(draw.randint(0, 150)))
        b = "".join(draw.choice("abcd ") if draw.random() < 0.3 else c for c in a if draw.random() < 0.95)
        exact = lines.edit_distance(a, b)
        for most in (0, exact - 1, exact, exact + 1, 200):
            found = lines.edit_distance(a, b, most)
            assert found == exact if exact <= most else found > most


def test_word_hashes():
    import xxhash

    draw = random.Random(12)
    words = [bytes(draw.choice(b"abz09\xc3\xa9\xff") for _ in range(n)) for n in [*range(1, 70)] * 5]
    for mark in (b" ", b"\n"):
        assert lines._word_hashes(mark.join(words)).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def test_replaced_words_need_no_exact_distance(monkeypatch):
    def exact(*_):
        raise AssertionError("asked for the exact distance")

    draw = random.Random(13)
    words = [f"w{draw.randrange(900)}" for _ in range(120)]
    replaced, moved = words[:], words[3:60] + ["new", "words"] + words[60:]
    for k in (5, 50, 51, 90):
        replaced[k] = "other"
    with monkeypatch.context() as patch:
        patch.setattr(lines, "edit_distance", exact)
        assert lines.similar(" ".join(words), " ".join(replaced))
        assert lines.similar(" ".join(words), " ".join(moved)) and lines.similar(" ".join(moved), " ".join(words))
    for _ in range(300):    # what words prove holds by letters
        a = [draw.choice(["a", "bc", "def", "", "gh"]) for _ in range(draw.randint(1, 14))]
        b = [draw.choice(["a", "bc", "def", "", "gh"]) if draw.random() < 0.3 else w for w in a if draw.random() < 0.9] or ["a"]
        exact = lines.edit_distance(" ".join(a), " ".join(b))
        for allowed in range(exact):
            assert not lines._provably_similar(a, b, allowed)
        assert lines._provably_similar(a, b, 100)


def test_tiles_of_many_batches():
    import pyarrow as pa

    draw = np.random.default_rng(14)
    tiles = np.sort(draw.integers(0, 12, 500))
    rows = pa.record_batch({"key": tiles // 4, "x": tiles % 4 // 2, "y": tiles % 2, "n": np.arange(500)})
    for cuts in ([], [1], [0, 0, 7], sorted(draw.integers(0, 500, 60).tolist())):
        ends = [0, *cuts, 500]
        found = list(lines._whole_tiles(rows.slice(i, j - i) for i, j in zip(ends, ends[1:])))
        assert [n for batch, _ in found for n in batch.column("n").to_pylist()] == list(range(500))
        seen = [set(tiles[batch.column("n").to_numpy()].tolist()) for batch, _ in found]
        assert sum(map(len, seen)) == len(set(tiles.tolist()))
        for batch, own in found:
            assert (np.diff(own) == (np.diff(tiles[batch.column("n").to_numpy()]) != 0)).all()


def test_links_of_tiles():
    draw = random.Random(15)
    texts, tile = [], []
    for k in range(9):
        base = [f"w{draw.randrange(900)}" for _ in range(30)]
        for _ in range(draw.choice([1, 2, 15])):
            base[draw.randrange(30)] = f"w{draw.randrange(900)}"
            texts.append(" ".join(base))
            tile.append(k // 2)
    prints = lines.prints_of([t.encode() for t in texts]).view(np.uint64)
    for block in (0, 3, 9):
        forest, found = Forest(), Forest()
        for i in range(len(texts)):
            for j in range(i + 1, len(texts)):
                x = [int(a ^ b) for a, b in zip(prints[i], prints[j])]
                common, longer = len({*texts[i].split()} & {*texts[j].split()}), max(len({*texts[i].split()}), len({*texts[j].split()}))
                if (tile[i] == tile[j] and all([v >> 16 * k & 0xFFFF for v in x for k in range(4)][:min(block, 8)]) and 2 * common >= longer
                        and x[0].bit_count() + x[1].bit_count() <= 20 and sum(v.bit_count() for v in x) <= 30 and lines.similar(texts[i], texts[j])):
                    forest.join(i, j)
        links = lines.tile_links(np.array(tile), np.full(len(texts), block), prints, texts)
        for i, j in links:
            assert tile[i] == tile[j] and found.find(i) != found.find(j)
            found.join(i, j)
        assert [found.find(i) for i in range(len(texts))] == [forest.find(i) for i in range(len(texts))]


def test_partners_by_all_bits():
    draw = np.random.default_rng(16)
    p = draw.integers(0, 1 << 63, (20, 3), dtype=np.uint64)[draw.integers(0, 20, 300)]
    for _ in range(12):
        p ^= np.uint64(1) << draw.integers(0, 64, p.shape).astype(np.uint64) * draw.integers(0, 2, p.shape).astype(np.uint64)
    key, size = np.sort(draw.integers(0, 3, 300)), np.full(300, 80)
    want = np.zeros(300, bool)
    for i in range(300):
        for j in range(i + 1, 300):
            x = [int(a ^ b) for a, b in zip(p[i], p[j])]
            if key[i] == key[j] and x[0].bit_count() + x[1].bit_count() <= 20 and sum(v.bit_count() for v in x) <= 30:
                want[i] = want[j] = True
    found = lines._partnered(key, size, p[:, 0], p[:, 1], p[:, 2])
    assert found.tolist() == want.tolist() and found.sum() < lines._partnered(key, size, p[:, 0], p[:, 1]).sum()


def plain_print(line):
    """The 64-bit words of a line's print, as Python integers."""
    import xxhash

    words, found = line.split(), []
    for k in range(3):
        ones = [0] * 64
        for w in words:
            x = xxhash.xxh64_intdigest(w) * (0x9E3779B97F4A7C15 + 2 * k) % 2 ** 64
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2 ** 64
            x ^= x >> 29
            for bit in range(64):
                ones[bit] += x >> bit & 1
        found.append(sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(words)))
    return found


def candidate(a, b):
    """Whether two prints share a block and are near in their first 128 bits."""
    x = [p ^ q for p, q in zip(a, b)]
    blocks = [v >> 16 * k & 0xFFFF for v in x for k in range(4)]
    return (not all(blocks) and x[0].bit_count() + x[1].bit_count() <= lines.RADIUS
            and sum(v.bit_count() for v in x) <= lines.RADIUS_OF_ALL)


def signed(x):
    return x - 2 ** 64 if x >> 63 else x


def test_prints():
    draw = random.Random(7)
    texts = [" ".join(draw.choice(["the", "of", f"w{draw.randrange(50)}", "é"]) for _ in range(n)).encode() for n in [1, 2, 3, 60, 300, 700] * 20]
    assert [list(map(int, p)) for p in lines.prints_of(texts)] == [list(map(signed, plain_print(t))) for t in texts]


def test_partners(monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    p = base[draw.integers(0, 60, 900)]
    for _ in range(9):
        p ^= np.uint64(1) << draw.integers(0, 64, p.shape).astype(np.uint64) * draw.integers(0, 2, p.shape).astype(np.uint64)
    key, size = draw.integers(0, 12, 900) << 16 | draw.integers(0, 3, 900), draw.integers(50, 120, 900)
    order = np.lexsort((size, key))
    key, size, p = key[order], size[order], p[order]
    want = np.zeros(900, bool)
    for i in range(900):
        for j in range(i + 1, 900):
            x = [int(a ^ b) for a, b in zip(p[i], p[j])]
            blocks = [v >> 16 * k & 0xFFFF for v in x for k in range(4)]
            if (key[i] == key[j] and abs(size[i] - size[j]) <= int(0.2 * max(size[i], size[j]) + 1e-9)
                    and x[0].bit_count() + x[1].bit_count() <= lines.RADIUS and all(blocks[:key[i] >> 16])):
                want[i] = want[j] = True
    assert lines._partnered(key, size, p[:, 0], p[:, 1]).tolist() == want.tolist() and 20 < want.sum() < 880


def lines_brute(rows):
    first, occurrences = {}, []
    for doc, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            own = lines.normalised(line).decode()
            if own:
                occurrences.append((doc, n))
                first.setdefault(own, (doc, n))
    forest, keys = Forest(), list(first)
    prints = {t: plain_print(t.encode()) for t in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            common, longer = len({*a.split()} & {*b.split()}), max(len({*a.split()}), len({*b.split()}))
            if candidate(prints[a], prints[b]) and 2 * common >= longer and lines.similar(a, b):
                forest.join(a, b)
    kept = {}
    for t in keys:
        root = forest.find(t)
        kept[root] = min(kept.get(root, first[t]), first[t])
    places = set(kept.values())
    gone = {}
    for doc, n in occurrences:
        if (doc, n) not in places:
            gone.setdefault(doc, set()).add(n)
    return {doc: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ())) for doc, text in rows}


def test_lines(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = " ".join(f"word{i} of the passage" for i in range(30))
    rows += [(9000, f"{passage}\nown line"), (9001, f"other line here\n{passage.upper()}!"), (9002, passage.replace("word7 ", "word8 ")), (9003, "a\n\na\nb")]
    found = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in found.items()} == lines_brute(rows)
    assert found[9001].text == "other line here" and found[9001].n_dropped == 1 and found[9001].n_lines == 2
    odd = lines.drop_repeated_lines(odd_docs)
    assert odd.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    told = {r.doc_id: r.text for r in odd.collect()}
    assert odd.count() == odd_docs.count()
    assert told[0] is None and told[1] == "" and told[4] == "Same words here today again." and told[5] == "" and told[None] == ""
    assert lines.drop_repeated_lines(odd_docs.where("false")).count() == 0


def edit_pairs(texts):
    """All pairs with edit similarity lines.SIMILARITY or more; no fingerprint is asked."""
    sizes = np.array([len(t) for t in texts])
    letters = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") & 63, minlength=64) for t in texts])
    found = []
    for i in range(len(texts)):
        allowed = (0.2 * np.maximum(sizes[i], sizes[i + 1:]) + 1e-9).astype(int)
        near = (np.abs(sizes[i + 1:] - sizes[i]) <= allowed) & (np.abs(letters[i + 1:] - letters[i]).sum(axis=1) <= 2 * allowed)
        found += [(i, j) for j in (np.nonzero(near)[0] + i + 1).tolist() if lines.similar(texts[i], texts[j])]
    return found


def linked_share(spark, texts):
    """Of the pairs with enough edit similarity, the share that ends in one group, with each text a line."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = lines._prints(frame).select("h", "size", "p0", "p1", "p2", F.struct("doc_id", "th", "line").alias("first"))
    group = {r.node: r.component for r in components(lines._links(frame, distinct)).collect()}
    names = [lines._words(t)[1][0] for t in texts]
    pairs = edit_pairs(texts)
    return sum(group.get(names[i], i) == group.get(names[j], j) for i, j in pairs) / len(pairs)


def test_line_recall(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    texts = sorted({lines.normalised(x).decode() for r in docs for x in (r.text or "").split("\n")} - {""})
    share = linked_share(spark, texts)
    print(f"\nrecall on sf0.001: {share:.3f}")
    assert share >= 0.9


def test_long_unrelated_lines(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(f"w{draw.randrange(50_000)}" for _ in range(15_000))) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines._members(lines._prints(frame)).count() == 0
    assert all(r.n_dropped == 0 for r in lines.drop_repeated_lines(frame).collect())


def test_keys_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(lines, "TILE_BYTES", 700)
    monkeypatch.setattr(lines, "_ROWS", 16)
    draw = random.Random(9)
    rows = []
    for k in range(8):
        base = [f"w{draw.randrange(900)}" for _ in range(30)]
        for _ in range(12):
            base[draw.randrange(30)] = f"w{draw.randrange(900)}"
            rows.append((len(rows), " ".join(base)))
    found = {r.doc_id: r.text for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == lines_brute(rows) and list(found.values()).count("") > 30


def test_lines_that_frequent_words_dominate(spark):
    draw = random.Random(6)

    def word():
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))

    kinds, rows = ((8, 3), (14, 6), (12, 11), (30, 12)), []
    for often, rest in kinds:
        for _ in range(60):
            own = [word() for _ in range(rest)]
            rows += [(len(rows), " ".join(["the"] * often + own)), (len(rows) + 1, " ".join(["the"] * often + own[:-1] + [word()]))]
    assert all(lines.similar(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2))
    found = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, kind in enumerate(kinds):
        assert sum(found[i] for i in range(120 * n + 1, 120 * (n + 1), 2)) >= 57, kind
