"""The thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import discriminant, html, licences, mixing, pieces, rules, simhash, substrings, urls, vectors
from rowloom.llm.common import tables


def piece_model() -> str:
    """The vocabulary file of the merge-type tokenizer, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of the documents that labels call good."""
    return labels.where("quality = 1").select("doc_id")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return pieces.tokenize(docs, piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return licences.scan(docs)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return rules.quality_rules(docs, trusted_documents(labels))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return discriminant.classify(docs, labels)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    listed = spark.createDataFrame([(k,) for k in urls.LISTED], "key string")
    return urls.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    return html.extract_pages(pages, html.fit(pages))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return substrings.substring_dedup(docs)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = tables(spark, sf_dir, "embeddings")
    return vectors.near_duplicates(rows)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_license_scans, op3_quality_rules, op4_quality_classifier, op5_url_filters, op6_html_extraction, op7_substring_dedup, op8_embedding_dedup, op9_mixing, op10_simhash)}

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
ratios AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM sources),
levels AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT)
              - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ratios),
pick AS (SELECT ratio AS fits, level AS chosen FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size,
         CASE WHEN fits IS NULL OR ratio < fits THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), chosen * weight) END AS target
  FROM levels LEFT JOIN pick ON true),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM goals),
runs AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM runs
"""

OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
                                ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) r(d, p, rule, verdict)),
fits AS (
  SELECT page_id, host, path, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
  FROM parts LEFT JOIN rules ON (host = d OR ends_with(host, '.' || d)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT parts.page_id, parts.host, parts.path, fits.rule,
       coalesce(fits.verdict, CASE WHEN regexp_matches(parts.host, '^(.*\.)?(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN fits ON parts.page_id = fits.page_id AND parts.host = fits.host AND parts.path = fits.path
"""

OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, row_number() OVER () AS r FROM documents),
windows AS (
  SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 33))) AS s FROM split)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, s + j AS i FROM windows JOIN again USING (h), (SELECT unnest(range(35)) AS j)),
lists AS (SELECT r, list(i) AS l FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(l), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN l IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(l, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN lists USING (r)
"""

OP8_SQL = """
WITH RECURSIVE units AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM units UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM units JOIN lowest ON vec_id = lowest.a LEFT JOIN counts ON vec_id = counts.a
"""

ORACLE_SQL = {"op2_license_scans": licences.sql(), "op5_url_filters": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op9_mixing": OP9_SQL}
