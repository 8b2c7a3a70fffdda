"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import bpe, embed_dedup, html_template, minhash, packing, pii, topk, toxicity, url_reputation, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The registries' suffixes and those under which the synthetic crawl gives names to its sites, as a private section would.
SUFFIXES = (*url_reputation.SUFFIXES, "example.com", "example.net", "example.org")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extracted(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path ends in: the label of that document is the page's outcome."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.try_to_number(F.regexp_extract("url", r"/[a-z]{2}/([0-9]+)", 1), F.lit("999999999999999999")).cast("long").alias("key"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    return url_reputation.filtered(pages, labels, suffixes=SUFFIXES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage is a query over all documents."""
    return topk.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its class and the number of its links."""
    return embed_dedup.near_classes(table(spark, sf_dir, "embeddings"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as archives without repeated payloads, as read back from the written files."""
    return warc.deduplicated(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_documents(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has near or exact copies, and the smallest id of its group."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.col("group_id").alias("duplicate_of"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_pii": op8_pii,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLE: dict[str, str] = {
    "op3_url_filter": """
WITH page AS (
  SELECT page_id, url, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         try_cast(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') AS BIGINT) AS key FROM pages),
named AS (
  SELECT *, string_split(host, '.') AS p FROM page),
split AS (
  SELECT page_id, url, host, key, CASE WHEN len(p) < 2 THEN host ELSE p[-2] || '.' || p[-1] END AS last2,
         CASE WHEN len(p) < 3 THEN host ELSE p[-3] || '.' || p[-2] || '.' || p[-1] END AS last3, p[-1] AS last1 FROM named),
part AS (
  SELECT page_id, url, host, key, CASE WHEN last2 IN (%(suffixes)s) THEN last3 ELSE last2 END AS domain,
         CASE WHEN last2 IN (%(suffixes)s) THEN last2 ELSE last1 END AS suffix FROM split),
outcome AS (
  SELECT doc_id AS key, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad, count(*) AS seen FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
hosts AS (
  SELECT host, domain, suffix, coalesce(sum(bad), 0)::DOUBLE AS k, coalesce(sum(seen), 0)::DOUBLE AS n
  FROM part LEFT JOIN outcome USING (key) GROUP BY ALL),
top AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m FROM hosts WHERE host <> ''),
s0 AS (SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(m) AS m FROM hosts, top GROUP BY suffix),
s1 AS (SELECT sum(n * pow(k / n - m, 2) / (m * (1 - m))) AS q, count(*) AS u, sum(n - 1) AS d FROM s0 WHERE n > 0),
s2 AS (SELECT 1 / (CASE WHEN d > 0 THEN least(greatest((q - u) / d, 0.001::DOUBLE), 0.9::DOUBLE) ELSE 0.5::DOUBLE END) - 1 AS s FROM s1),
s3 AS (SELECT suffix, (s * m + k) / (s + n) AS mean FROM s0, s2),
d0 AS (SELECT domain, suffix, sum(k) AS k, sum(n) AS n, any_value(mean) AS m FROM hosts JOIN s3 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT sum(n * pow(k / n - m, 2) / (m * (1 - m))) AS q, count(*) AS u, sum(n - 1) AS d FROM d0 WHERE n > 0),
d2 AS (SELECT 1 / (CASE WHEN d > 0 THEN least(greatest((q - u) / d, 0.001::DOUBLE), 0.9::DOUBLE) ELSE 0.5::DOUBLE END) - 1 AS s FROM d1),
d3 AS (SELECT domain, suffix, (s * m + k) / (s + n) AS mean FROM d0, d2),
h0 AS (SELECT host, k, n, mean AS m FROM hosts JOIN d3 USING (domain, suffix)),
h1 AS (SELECT sum(n * pow(k / n - m, 2) / (m * (1 - m))) AS q, count(*) AS u, sum(n - 1) AS d FROM h0 WHERE n > 0),
h2 AS (SELECT 1 / (CASE WHEN d > 0 THEN least(greatest((q - u) / d, 0.001::DOUBLE), 0.9::DOUBLE) ELSE 0.5::DOUBLE END) - 1 AS s FROM h1),
h3 AS (SELECT host, (s * m + k) / (s + n) AS mean, s + n AS weight FROM h0, h2),
bound AS (SELECT host, round(mean, 6) AS mean, round(greatest(mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (weight + 1)), 0.0::DOUBLE), 6) AS lower FROM h3)
SELECT page_id, url, host, mean, lower, lower <= 0.30::DOUBLE AS kept FROM part JOIN bound USING (host)
""" % {"suffixes": ", ".join(f"'{x}'" for x in SUFFIXES)},
    "op5_exact_top_k": """
WITH tok AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w
  FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)),
tf AS (SELECT row_no, any_value(doc_id) AS doc_id, w, count(*) AS tf FROM tok GROUP BY row_no, w),
dl AS (SELECT row_no, count(*) AS dl FROM tok GROUP BY row_no),
size AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark),
scored AS (
  SELECT item_id, row_no, any_value(doc_id) AS doc_id,
         round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
  FROM asked JOIN tf USING (w) JOIN df USING (w) JOIN dl USING (row_no), size GROUP BY item_id, row_no),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT a AS vec_id, min(reach.b) AS class_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS links FROM reach GROUP BY a
""",
    "op7_warc_revisits": """
WITH page AS (SELECT DISTINCT page_id, url, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_length FROM pages),
ranked AS (
  SELECT *, first_value(page_id) OVER w AS original, row_number() OVER w AS place FROM page
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id, url ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT page_id, url, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS warc_type, payload_digest, payload_length,
       CASE WHEN place > 1 THEN original END AS refers_to FROM ranked
""",
}
