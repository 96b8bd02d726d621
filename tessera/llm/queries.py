"""The registered queries of the package: thin digests of each operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import document_size, shard_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, shards=8).select(
        "doc_id", document_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_pieces

    return pack_pieces(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"), length=50)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_components

    return whitened_components(table(spark, sf_dir, "embeddings"), components=16)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_trees import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"), length=13)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# every window's first document, the places that windows of later documents cover, and the words left
_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, p, list_slice(w, p, p + 12) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM win JOIN low USING (g) WHERE doc_id > m),
word AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_OP13 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, part,
  CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 16 ELSE 0 END AS mask FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox
  FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(tox), 0) AS tox
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT a.x AS a, b.x AS b, c.x AS c, d.x AS d, e.x AS e FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT concat(substr('ABCDE', a, 1), substr('ABCDE', b, 1), substr('ABCDE', c, 1), substr('ABCDE', d, 1),
  substr('ABCDE', e, 1)) AS filter_order, k.x AS step, [a, b, c, d, e] AS p FROM o, one k),
m AS (SELECT filter_order, step, CAST(1 << (p[step] - 1) AS INTEGER) AS own,
  CAST(coalesce(list_sum([1 << (y - 1) for y in p[1:step - 1]]), 0) AS INTEGER) AS before FROM s),
q AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN tox ELSE 0 END) AS toxic_lost
  FROM c, m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM q
"""

# the others need hashes, models, tokenizers, byte strings or eigenvectors, which SQL does not have
ORACLE: dict[str, str] = {"op12_substring_dedup": _OP12, "op13_filter_audit": _OP13}
