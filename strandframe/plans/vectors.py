"""Similarity and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity
from ..session import materialize, table
from .inputs import SEQ
from .registry import query

PAIRS = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
  pairs AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.id < b.id WHERE c >= {t})"""
COMPONENTS = f"""{PAIRS.format(t=0.4)}, edge AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
  reach(id, root) AS (SELECT id, id FROM v UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id WHERE edge.b > reach.root),
  comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"""


def _pairs(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", None, threshold)


@query(f"WITH {PAIRS.format(t=0.35)} SELECT a, b, round(c, 5) AS cosine FROM pairs")
def embedding_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 0.35).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(
    f"""WITH s AS (SELECT doc_id AS id, source, regexp_replace({SEQ}, '[^ACGT]', 'N', 'g') AS seq FROM documents),
  k AS (SELECT id, source, kmer, count(*) AS n FROM (SELECT id, source, seq[p + 1 : p + 4] AS kmer FROM s, unnest(range(0, greatest(length(seq) - 3, 0))) AS u(p)) WHERE NOT contains(kmer, 'N') GROUP BY ALL),
  m AS (SELECT *, max(n) OVER (PARTITION BY id) AS top, count(*) OVER () AS c FROM k), t AS (SELECT id, source, kmer, CAST(CASE WHEN top <= 255 THEN n ELSE n * 255 // top END AS DOUBLE) AS n FROM m),
  z AS (SELECT id, sqrt(sum(n * n)) AS z FROM t GROUP BY id), j AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n) AS d FROM t a JOIN t b ON a.source = b.source AND a.kmer = b.kmer AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(d / (x.z * y.z), 5) AS cosine FROM j JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE d / (x.z * y.z) >= 0.985"""
)
def kmer_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where("source IS NOT NULL").selectExpr("doc_id AS id", f"{SEQ} AS seq", "source")
    vectors = materialize(similarity.kmer_vectors(documents, "id", "seq", 4, ["source"]), "vectors")
    return similarity.cosine_pairs(vectors, "id", "vector", "source", 0.985).select("a", "b", F.round("cosine", 5).alias("cosine"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) > 0")
    return similarity.clusters(vectors, materialize(_pairs(spark, sf_dir, 0.4), "pairs"), "vec_id")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT id, cluster FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {COMPONENTS}, m AS (SELECT cluster, id, id % 7 AS size FROM comp)
SELECT cluster, arg_max(id, size * 1000000 - id) AS representative, max(size) AS size, count(*) AS members FROM m GROUP BY cluster"""
)
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.representatives(_clusters(spark, sf_dir).withColumn("size", F.col("id") % 7), "cluster", "size", "id")


@query(
    f"""WITH RECURSIVE {COMPONENTS}, m AS (SELECT count(*) AS n FROM comp GROUP BY cluster)
SELECT CAST(CASE WHEN n <= 2 THEN n ELSE 3 * (1 << CAST(floor(log2((n + 0.5) / 3)) AS INTEGER)) END AS BIGINT) AS band, count(*) AS clusters FROM m GROUP BY 1"""
)
def cluster_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy(similarity.log_band(F.col("n")).alias("band")).agg(F.count("*").alias("clusters"))


@query()
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against plain Python in the tests."""
    return similarity.farthest_first(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.3, 100)
