"""The pipeline against its stages' plain versions, and its parts' contracts."""

import corpus_pipeline
from risetide.llm import bpe, decontaminate, quality

from test_groups import lines_brute, simhash_brute
from test_text import told

SMALL = "/root/testdata/sf0.001"


def test_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs)
    good = {d: t for d, t in rows.items() if t and t.split() and model.score(t, quality.measures(t)) >= quality.KEEP}
    cleaned = lines_brute(list(good.items()))
    groups = simhash_brute(list(cleaned.items()))
    kept = {d: t for d, t in cleaned.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    clean = {d: t for d, t in kept.items() if not index.matches(t)}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    found = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert found == {d: told(library, t) for d, t in clean.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SMALL).columns == docs.columns


def test_odd_rows(spark, odd_docs, tmp_path):
    from pyspark.sql import functions as F

    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_docs.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "h": F.col("source")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns, name
        assert done.count() <= docs.count()
    assert corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).count() == docs.count()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in found.collect()} <= {None, *range(10)}
