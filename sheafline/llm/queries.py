"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression_classifier, embed_dedup, licenses, minhash, packing, pii, sharding, toxicity
from . import quality_rules as rules


TOKENIZER = "byte_bpe_50k.json"
#: Key of the registered queries where the session sets none (pii.KEY_CONF). It is public: whoever reads it can undo their pseudonyms.
DEMO_KEY = "published demonstration key"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal shards; the law is `key`: grown_shard is the shard once a ninth is added."""
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), eight := sharding.tree(8), sharding.grown(eight))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as the contract of this query has it."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = compression_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return compression_classifier.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


def pii_key(spark: SparkSession) -> str:
    return pii.key_of(spark, DEMO_KEY)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), pii_key(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
}
OP2_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)"""

OP5_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.93 * a.n * b.n),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY a) USING (vec_id)"""

#: The others need checksums, zstandard, trained models, token ids or look-around patterns, which DuckDB lacks; tests hold them against plain versions.
ORACLES: dict[str, str] = {"op2_minhash_near_dedup": OP2_SQL, "op5_embedding_near_dedup": OP5_SQL}
