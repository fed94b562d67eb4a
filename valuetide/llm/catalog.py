"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from valuetide.llm import embedding_dedup, exact_dedup, importance, langid, license_scan, mixing, near_dedup, packing, secret_scan, substring_dedup, toxicity, warc, whitening
from valuetide.llm.common import table


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = langid.fold_two()
    return langid.identify_language(docs, docs.where(~held), held_out=held)


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    """Clean words come from ``benchmark``; documents whose id leaves 2 by 4 are not learnt from."""
    dictionary = secret_scan.dictionary_of(table(spark, sf_dir, "benchmark"))
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), dictionary, learn=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    """A document's path is its source, language and id."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan_licences(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_packing, op3_embedding_dedup, op4_toxicity, op5_mixing, op6_secret_scan, op7_substring_dedup, op8_license_scan, op9_near_dedup, op10_exact_dedup,
        op11_embedding_whitening, op12_importance_resampling, op13_warc,
    )
}
#: Vectors are linked by the exact cosine, components grow to a fixpoint.
_OP3_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN k ON k.a = e.vec_id"""

CHECK_SQL = {"op3_embedding_dedup": _OP3_SQL, "op5_mixing": mixing.OP5_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op12_importance_resampling": importance.OP12_SQL, "op13_warc": warc.OP13_SQL}
