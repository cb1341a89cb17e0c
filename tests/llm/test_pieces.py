"""SentencePiece operator against the sentencepiece library."""

import hashlib
import random

import pytest

from risetide.llm import pieces

SMALL = "/root/testdata/sf0.001"


def hostile():
    draw = random.Random(1)
    texts = ["", " ", "  ", "   a", "a  b ", "▁", "a▁b", "\n", "\t x\ny", "é🎉 ß Σ", "x" * 3000, "\x00", "a\x00b", "　全角 日本語テキスト",
             "العربية", "  \n  12 345,6", "<s>", "</s> <unk> <0x0A>", "�", "﻿x", "🇩🇪👩‍👩‍👧", " " * 37, "don't (well) \"so\"", "aa" * 500]
    texts += ["".join(draw.choice("ab ▁\n1é日🎉<>the in er.,'") for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    return texts + ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x250), draw.randrange(0x4e00, 0x5000), draw.randrange(0x1f300, 0x1f600)]))
                            for _ in range(draw.randint(0, 40))) for _ in range(1500)]


def told(library, text):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_agendas():
    own, library = pieces.coder(pieces.vocabulary_path()), pieces._library(pieces.vocabulary_path())
    for text in hostile():
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids), repr(text)
        for chunk in own.chunks(text):      # the heap and the scan of an agenda agree
            if pieces.SPACE * 2 not in chunk:
                symbols = [own._number.get(c, -1 - ord(c)) for c in chunk]
                assert own._by_heap(list(symbols)) == own._by_scan(list(symbols))


def test_decoding_of_any_ids():
    own, library = pieces.coder(pieces.vocabulary_path()), pieces._library(pieces.vocabulary_path())
    draw = random.Random(2)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(4), draw.randrange(131, 259)]) for _ in range(draw.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 3)
    own = pieces.Coder(pieces.vocabulary_path())
    library = pieces._library(pieces.vocabulary_path())
    for text in ["one two three four five six one two", "seven one eight two nine", "one two three four"] * 2:
        n, said, back = own.digest(text)
        assert (said, back) == (",".join(map(str, library.encode(text))), text) and len(own._told) <= 3


def test_round_trip(spark, odd_docs):
    library = pieces._library(pieces.vocabulary_path())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(hostile()[:200], 10_000))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in pieces.round_trip(frame).collect()} == {d: told(library, t) for d, t in rows}
    assert pieces.check(frame).where("not agrees or n_tokens <> n_library").count() == 0
    odd = {(r.doc_id, tuple(r)[1:]) for r in pieces.round_trip(odd_docs).collect()}
    assert odd == {(r.doc_id, told(library, r.text)) for r in odd_docs.collect()}
    assert pieces.round_trip(odd_docs).count() == odd_docs.count()
    assert pieces.round_trip(odd_docs.where("false")).count() == 0


def test_columns(spark, odd_docs):
    coded = pieces.decode(pieces.encode(odd_docs))
    assert coded.columns == [c for c in odd_docs.columns if c != "ids"] + ["ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in coded.collect())


def test_other_models(tmp_path):
    with open(pieces.vocabulary_path(), "rb") as file:
        data = file.read()
    path = tmp_path / "other.model"
    path.write_bytes(data.replace(b"identity", b"nmt_nfkc", 1).replace(b"\x18\x01\x20\x00", b"\x18\x01\x20\x01"))
    with pytest.raises(ValueError):
        pieces.Coder(str(path))
