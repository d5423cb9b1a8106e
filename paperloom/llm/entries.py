"""The queries of this subpackage's operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jpeg, langid, lm, packing, pii, quality, simhash, suffix_dedup, token_files
from .common import documents

#: The end-of-text ids that the packing and file contracts ask for.
PACK_END, FILE_END = 0, 2


def byte_bpe_path() -> str:
    """The public byte-level vocabulary; its place is asked for, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fold() -> Column:
    """The remainder by which documents are held out; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(_fold() != 2).select("text", "lang"))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), byte_bpe_path())


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(jpeg.encode_texts(documents(spark, sf_dir)))


def op4_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).drop("spans")


def op5_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.scores(documents(spark, sf_dir), order=3, backoff=0.4)
    return found.withColumns({k: F.round(k, 4) for k in ("log10_score", "mean_log10")})


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir), length=400)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), byte_bpe_path(), 2048, PACK_END)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, path = token_files.written(documents(spark, sf_dir), byte_bpe_path(), FILE_END)
    return token_files.read_digests(manifest, path)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_bpe, op3_progressive_jpeg, op4_suffix_array_repetition, op5_candidate_boosting, op6_stupid_backoff, op7_simhash, op8_suffix_array_dedup, op9_best_fit_packing, op10_token_files)}


_OP6 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM d, range(1, len(ws) + 1) r(i)),
k AS (SELECT *,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) END AS c2,
    CASE WHEN u IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) END AS c3,
    count(*) OVER () AS total FROM t),
h AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM k),
s AS (SELECT doc_id, n, c3 > 0 AS found, log10(CASE WHEN c3 > 0 THEN c3 / CAST(h2 AS DOUBLE) WHEN c2 > 0 THEN power(0.4, least(i, 3) - 2) * c2 / CAST(h1 AS DOUBLE)
    ELSE power(0.4, least(i, 3) - 1) * greatest(c1, 1) / CAST(greatest(total - n, 1) AS DOUBLE) END) AS x FROM h)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(a.x, 0), 4) AS log10_score, round(a.x / len(ws), 4) AS mean_log10, CAST(coalesce(a.f, 0) AS BIGINT) AS n_found
FROM d LEFT JOIN (SELECT doc_id, sum(x) AS x, count(*) FILTER (found) AS f FROM s GROUP BY doc_id) a ON a.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The others need hashes, suffix arrays, images or a tokenizer: tests hold them against brute force."""
    return {"op6_stupid_backoff": _OP6}
