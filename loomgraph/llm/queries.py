"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, license_scan, line_quality, packing, probminhash, ranked_search, secret_links, substring_dedup, tiff, toxicity, url_filter

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.scan(table(spark, sf_dir, "documents"))


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def decoded_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of op12 that SQL can tell: what the ids decode to."""
    return op12_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can tell: what was read back from the stored media."""
    return op1_tiff_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4's base spans."""
    return op4_secret_links(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, place, array_to_string(w[place:place + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS place FROM d)),
owners AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, place + k AS place FROM (SELECT doc_id, place, unnest(range(13)) AS k FROM windows JOIN owners USING (win) WHERE least < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

PAYLOAD_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
n AS (SELECT doc_id, raw, octet_length(raw) AS n_bytes, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS payload_bytes FROM d)
SELECT doc_id, n_bytes, payload_bytes, sha256(raw || repeat('\x00'::BLOB, payload_bytes - n_bytes)) AS payload_sha256 FROM n
"""

SECRET_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex
FROM d
"""

LICENSE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, place, CASE WHEN word = 'mit' AND next = 'license' THEN 'mit' WHEN word = 'apache' AND next = 'license' THEN 'apache' WHEN word = 'general' AND next = 'public' AND third = 'license' THEN 'gpl' END AS label
  FROM (SELECT doc_id, unnest(range(len(w))) AS place, unnest(w) AS word, unnest(w[2:]) AS next, unnest(w[3:]) AS third FROM d)),
found AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_tiff_media, op2_best_fit_packing, op3_line_quality, op4_secret_links, op5_probminhash, op6_toxicity, op7_substring_dedup, op8_template_leaks, op9_url_filter, op10_license_scan, op11_ranked_search, op12_byte_bpe, decoded_digests, payload_digests, secret_base_counts, license_base_places]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": SUBSTRING_SQL, "op9_url_filter": url_filter.ORACLE_SQL, "op11_ranked_search": ranked_search.ORACLE_SQL, "decoded_digests": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents", "payload_digests": PAYLOAD_SQL, "secret_base_counts": SECRET_SQL, "license_base_places": LICENSE_SQL}
