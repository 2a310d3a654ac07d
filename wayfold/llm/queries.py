"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, exact_topk, language_id, quality_knn, quality_rules, simhash, token_matrix, tokens, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and boosted trees' verdict on every document."""
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), trees).drop("text")


#: Listed pages: those on these host words, and those whose title has two runs of doubled marks.
LISTED_HOSTS = r"(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\."
LISTED_TITLES = r"<title>[^<]*([!*%$]{2}|&amp;&amp;)[^<]*([!*%$]{2}|&amp;&amp;)"


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the list: canonical URLs of pages on LISTED_HOSTS or with LISTED_TITLES.

    Which paths of an ordinary host are listed hangs on their pages' titles, so no rule on URLs
    gives the same verdicts; a clean page whose canonical URL equals a listed one's is blocked too.
    """
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.host_and_path(F.col("url"))
    listed = pages.filter(host.rlike(LISTED_HOSTS) | F.col("html").rlike(LISTED_TITLES)).select(url_filter.canonical(F.col("url")).alias("canonical"))
    return url_filter.judge(pages, listed)


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour quality scores of all documents, learned outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    voters = quality_knn.fit(docs, labels.filter(~quality_knn.held_out()))
    return quality_knn.classify(docs.select("doc_id", "text"), voters).select("doc_id", quality_knn.held_out().alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back, and indexed."""
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces, packed into sequences of 4096 by linear grouping."""
    return tokens.packed_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids as packed matrix rows of 4096 ids, written and read back."""
    rows = token_matrix.written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumnsRenamed({"keys": "doc_ids"})


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return exact_topk.top_k(table(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    trees = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), trees).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_quality_knn, op4_warc, op5_byte_bpe, op6_best_fit_packing, op7_simhash, op8_token_matrix, op9_exact_topk, op10_language_id)},
}

_URL_PARTS = r"""
raw AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM raw),
urls AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
  array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#[\s\S]*$', ''), '\?([\s\S]*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&') AS query FROM parts),
canon AS (SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM urls)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
WITH {_URL_PARTS},
listed AS (SELECT DISTINCT canonical FROM canon JOIN pages USING (page_id) WHERE regexp_matches(host, '{LISTED_HOSTS}') OR coalesce(regexp_matches(html, '{LISTED_TITLES}'), false)),
rules(verdict, own, prefix) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
fits AS (SELECT page_id, own || prefix AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(own || prefix) DESC) AS k
  FROM canon, rules WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix))
SELECT c.page_id, host, path, rule, coalesce(verdict, CASE WHEN c.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fits f ON f.page_id = c.page_id AND f.k = 1""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM f""",
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
