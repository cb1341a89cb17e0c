"""Registered queries of the operators, and oracle SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from risetide.llm import archives, bpe, decontaminate, divergence, embeddings, lines, pieces, pii, quality, runs, secrets, simhash, urls
from risetide.llm.work import importable


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"))


def op5_archive_converter(spark: SparkSession, folder: str) -> DataFrame:
    return archives.round_trip(_table(spark, folder, "pages"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.summary(_table(spark, folder, "documents"))


def op11_sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(_table(spark, folder, "documents"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.summary(_table(spark, folder, "documents"), runs.planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_archive_converter": op5_archive_converter,
    "op6_url_filter": op6_url_filter,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_pii": op9_pii,
    "op10_secret_scan": op10_secret_scan,
    "op11_sentencepiece_round_trip": op11_sentencepiece_round_trip,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reached AS (
          SELECT vec_id AS a, vec_id AS b FROM v
          UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
        smallest AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
        SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, s.component_id,
               v.vec_id = s.component_id AS kept
        FROM v JOIN smallest s ON s.a = v.vec_id
    """,
    "op12_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
          FROM documents),
        words AS (
          SELECT id, lang, source, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM d),
        kept AS (
          SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
        grp AS (SELECT DISTINCT lang, source FROM d),
        counted AS (
          SELECT g.lang, g.source, k.term, k.total, l.v, l.n AS lang_n,
                 (SELECT count(*) FROM words w WHERE w.lang = g.lang AND w.source = g.source AND w.term = k.term) AS c
          FROM grp g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang),
        totals AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source),
        priced AS (
          SELECT lang, source, term, c,
                 1 + (1000000000 * (c + 2)::HUGEINT) // (t.n + 2 * v)::HUGEINT AS p,
                 1 + (1000000000 * (total + 2)::HUGEINT) // (lang_n + 2 * v)::HUGEINT AS q
          FROM counted JOIN totals t USING (lang, source)),
        pairs AS (
          SELECT a.lang, a.source, b.source AS item,
                 coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))
                           FROM priced x JOIN priced y ON y.lang = x.lang AND y.term = x.term
                           WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source),
        found AS (
          SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
          UNION ALL
          SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM priced WHERE c > 0 AND p > q),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
