"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, kneser_ney, language_id, line_dedup, media, merge_dropout, near_dup, packing, phrases, pii, substring_dedup, url_filter, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int) -> F.Column:
    """crc32 of the doc_id's text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


#: (host, path, verdict) of op9.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_hierarchical_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (remainder(4) == 2).alias("held_out"))
    machines = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), machines).select("doc_id", "held_out", "lang_pred", "score")


def op2_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.report(documents(spark, sf_dir))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    return kneser_ney.score(kneser_ney.train(docs.where("not held_out")), docs)


def op4_tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(documents(spark, sf_dir))


def op5_simhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(documents(spark, sf_dir))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op10_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op11_tsqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_apriori(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.report(docs, pii.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hierarchical_svm, op2_bottom_k, op3_kneser_ney, op4_tar_shards, op5_simhash_lines, op6_lsh_forest, op7_merge_dropout, op8_best_two_fit, op9_url_trie, op10_level_doubling,
        op11_tsqr, op12_apriori, op13_semi_crf,
    )
}

# The fits of op9 in order of precedence: more host labels, then the longer path.
_OP9 = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

# Words of op12 with the next two of their piece; a cut's score is a quotient of 128-bit integers.
_OP12 = """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
cut AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM cut),
ahead AS (SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
f1 AS (SELECT lang, w, count(*) AS f FROM ahead GROUP BY ALL),
f2 AS (SELECT lang, w, w2, count(*) AS f FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w, w2, w3, count(*) AS f FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.w || ' ' || c.w2 AS phrase, c.f AS a, 1 AS place, l.f AS l, r.f AS r FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w = c.w JOIN f1 r ON r.lang = c.lang AND r.w = c.w2
  UNION ALL SELECT c.lang, c.w || ' ' || c.w2 || ' ' || c.w3, c.f, 1, l.f, r.f FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w = c.w JOIN f2 r ON r.lang = c.lang AND r.w = c.w2 AND r.w2 = c.w3
  UNION ALL SELECT c.lang, c.w || ' ' || c.w2 || ' ' || c.w3, c.f, 2, l.f, r.f FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.w = c.w AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.w = c.w3),
scores AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
inside AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, w || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op9_url_trie": _OP9, "op12_apriori": _OP12}
