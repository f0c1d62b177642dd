"""Registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import (
    decontamination,
    html_extraction,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    secret_scan,
    toxicity,
    url_filter,
    vector_dedup,
    whitening,
)
from veilspark.llm.tables import bucket, table

TOKENIZER = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: its remaining text and how many lines went."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_deleted_lines")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labelled documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score_documents(docs, docs.where("NOT held_out"), labels).select("doc_id", "held_out", "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the languages of documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket("doc_id", 4) == 2)
    training = docs.where("NOT held_out").select("doc_id", "text", "lang")
    return language_id.identify(docs, training).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those labelled good or bad weigh more or less where only a part of a source is taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs.join(weights, "doc_id", "left"), weight_col="weight")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_decontamination, op3_line_dedup, op4_html_extraction, op5_best_fit_packing, op6_url_filter, op7_toxicity,
    op8_language_id, op9_vector_dedup, op10_secret_scan, op11_mixing, op12_lexical_search,
    op13_whitening)}

_OP2 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS span
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
    SELECT DISTINCT g.doc_id, g.p, g.n, windows.item_id
    FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS span
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)) g
    JOIN windows USING (n, span)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT reached.vec_id, links.v FROM reached JOIN links ON reached.other = links.u),
parts AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""

_OP11 = r"""
WITH known AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id),
docs AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
               / coalesce(weight, 1.0) AS k
    FROM documents LEFT JOIN known USING (doc_id)),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS s,
           CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
    FROM docs GROUP BY source),
levels AS (
    SELECT *, row_number() OVER (ORDER BY s / w, source NULLS LAST) AS i,
           1.5 * sum(s) OVER () - 2.0 * coalesce(sum(s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS rest_size,
           sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
    FROM sources),
opened AS (SELECT i, rest_size, rest_w FROM levels WHERE w * rest_size < 2.0 * s * rest_w ORDER BY i LIMIT 1),
goals AS (
    SELECT source, s, CASE WHEN i < coalesce((SELECT i FROM opened), 2147483647) THEN 2.0 * s
                           ELSE w * (SELECT rest_size FROM opened)::DOUBLE / (SELECT rest_w FROM opened) END::DOUBLE AS target FROM levels),
summed AS (
    SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs,
           sum(size) OVER (PARTITION BY docs.source ORDER BY k, CAST(doc_id AS VARCHAR), size ROWS UNBOUNDED PRECEDING) - size AS before
    FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * (epochs + CASE WHEN 2 * (target - epochs * s - before) > size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

_OP12 = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM words),
items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
posted AS (
    SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n
    FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM posted, sizes GROUP BY term),
scored AS (
    SELECT item_id, r, doc_id,
           CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN posted USING (term), sizes GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""

SQL: dict[str, str] = {"op2_decontamination": _OP2, "op9_vector_dedup": _OP9, "op11_mixing": _OP11, "op12_lexical_search": _OP12}
