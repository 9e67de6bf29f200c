"""Queries of the read, seed and chain filters and of their weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequence as S
from ..operators import filters
from ..session import table
from .inputs import LINES, SEQ, lines, sequences
from .registry import query
from .seeds import sql_kmers, sql_syncmer


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def named_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return filters.named(table(spark, sf_dir, "documents"), names, "doc_id").select("doc_id", "source")


@query(f"WITH d AS (SELECT doc_id, {SEQ} AS seq FROM documents) SELECT d.doc_id, item_id FROM d JOIN benchmark b ON d.doc_id % 50 = b.item_id % 50 WHERE length(seq) >= 20 AND NOT regexp_matches(seq, '[Nn]') AND greatest(length(seq), length(b.text)) > 0 AND least(length(seq), length(b.text)) / greatest(length(seq), length(b.text)) >= 0.5")
def candidate_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside passages of comparable length, texts that are short or hold an N left out."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SEQ} AS seq", "doc_id % 50 AS k").where(filters.usable(F.col("seq")))
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id", "length(text) AS n", "item_id % 50 AS k")
    return docs.join(items, "k").where(filters.comparable(F.length("seq"), F.col("n"))).select("doc_id", "item_id")


_SEEDS = f"s AS (SELECT l_orderkey AS read, l_orderkey * 10 + l_linenumber AS q, CAST(l_suppkey % 2 AS BIGINT) AS chrom, (l_partkey * 13) % 700 AS diagonal FROM {LINES})"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("l_orderkey AS read", "l_orderkey * 10 + l_linenumber AS q", "cast(l_suppkey % 2 as bigint) AS chrom", "(l_partkey * 13) % 700 AS diagonal")


@query(f"WITH {_SEEDS}, t AS (SELECT *, lag(diagonal) OVER w - diagonal AS a, lead(diagonal) OVER w - diagonal AS b FROM s WINDOW w AS (PARTITION BY read, chrom ORDER BY q)) SELECT read, q, coalesce(abs(a) > 100 AND abs(b) > 100 AND sign(a) <> sign(b), false) AS excursion FROM t")
def diagonal_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.excursions(_seeds(spark, sf_dir), ["read", "chrom"], "q", 100).select("read", "q", "excursion")


@query(
    f"""WITH {_SEEDS}, t AS (SELECT *, CASE WHEN lag(q) OVER w IS NULL THEN 0 WHEN abs(diagonal - lag(diagonal) OVER w) > 150 OR chrom <> lag(chrom) OVER w THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY read ORDER BY q)), u AS (SELECT *, sum(fresh) OVER (PARTITION BY read ORDER BY q) AS segment FROM t)
SELECT read, q, CAST(segment AS BIGINT) AS segment, count(*) OVER (PARTITION BY read, segment) = 1 AS alone FROM u"""
)
def seed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a read's seeds, and which are of a single seed."""
    return filters.segments(_seeds(spark, sf_dir), "read", "q", ["chrom"], 150).select("read", "q", F.col("segment").cast("long").alias("segment"), "alone")


_PLACES = "s AS (SELECT CAST(l_suppkey % 20 AS BIGINT) AS chrom, (l_partkey * 31) % 20000 AS diagonal, CAST(l_quantity AS DOUBLE) AS score FROM lineitem)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 20 as bigint) AS chrom", "(l_partkey * 31) % 20000 AS diagonal", "cast(l_quantity as double) AS score")


@query(f"WITH {_PLACES}, d AS (SELECT chrom, diagonal, count(*) AS n FROM s GROUP BY ALL) SELECT a.chrom, a.diagonal, round(sum(b.n / (1.0::DOUBLE + (a.diagonal - b.diagonal) * (a.diagonal - b.diagonal))), 6) AS weight FROM d a JOIN d b ON a.chrom = b.chrom AND b.diagonal BETWEEN a.diagonal - 50 AND a.diagonal + 50 GROUP BY a.chrom, a.diagonal")
def collinear_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.collinear_weights(_places(spark, sf_dir), ["chrom"], 50).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_PLACES}, d AS (SELECT chrom, diagonal, sum(score) AS score FROM s GROUP BY ALL) SELECT a.chrom, a.diagonal, round(sum(b.score * exp(-((a.diagonal - b.diagonal) / 25.0::DOUBLE) * ((a.diagonal - b.diagonal) / 25.0::DOUBLE) / 2)), 4) AS support FROM d a JOIN d b ON a.chrom = b.chrom AND b.diagonal BETWEEN a.diagonal - 100 AND a.diagonal + 100 GROUP BY a.chrom, a.diagonal")
def gaussian_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.gaussian_support(_places(spark, sf_dir), ["chrom"], 25.0).withColumn("support", F.round("support", 4))


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN row_number() OVER w > 1 AND o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN 1 ELSE 0 END AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS run FROM t")
def status_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.runs_of(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", F.col("run").cast("long").alias("run"))


@query()
def chain_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of each read that go together best; held against all subsets in the tests."""
    rows = lines(spark, sf_dir).selectExpr("l_orderkey AS read", "l_linenumber AS chain", "l_linenumber * 30 + l_partkey % 50 AS start", "l_linenumber * 30 + l_partkey % 50 + cast(l_quantity as bigint) + 10 AS end", "cast(l_suppkey % 40 + 5 as double) AS score")
    return filters.schedule(rows, "read", 5, 0.1)


@query("SELECT source, lang, count(*) AS members, min(doc_id) AS first FROM documents GROUP BY source, lang")
def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and first of each group by two names."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("members"), F.min("doc_id").alias("first"))


@query("SELECT CAST(least(floor(l_discount * 10 * 20 / 1.0), 20) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-one bins of width 1/20; what is 1 or more falls into the last."""
    bin_ = F.least(F.floor(F.col("l_discount") * 10 * 20), F.lit(20)).cast("long").alias("bin")
    return table(spark, sf_dir, "lineitem").groupBy(bin_).agg(F.count("*").alias("n"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '-7'), doc_id) AS r FROM documents) WHERE r <= 10")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each source, by a seeded hash: a sampling operator."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return filters.sample(docs, ["source"], 10, F.struct(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7")).cast("binary")), "doc_id"))


@query("WITH a AS (SELECT l_orderkey AS read, count(*) AS n, max(l_quantity) AS best FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS read, count(*) AS n, max(l_quantity) AS best FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) SELECT coalesce(a.read, b.read) AS read, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, CAST(coalesce(a.best, 0) AS DOUBLE) AS best_a, CAST(coalesce(b.best, 0) AS DOUBLE) AS best_b FROM a FULL JOIN b ON a.read = b.read")
def per_read_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides' records per read; a side without the read counts 0."""
    rows = table(spark, sf_dir, "lineitem")
    side = lambda where, s: rows.where(where).groupBy(F.col("l_orderkey").alias("read")).agg(F.count("*").alias(f"n_{s}"), F.max("l_quantity").cast("double").alias(f"best_{s}"))
    both = side("l_linenumber <= 3", "a").join(side("l_linenumber >= 3", "b"), "read", "full_outer")
    return both.select("read", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_a", "best_b")))


@query("SELECT s_name AS name, n_nationkey AS contig, n_nationkey IS NULL AS unknown FROM (SELECT 'chr' || (s_suppkey % 30) AS s_name FROM supplier) LEFT JOIN (SELECT 'chr' || n_nationkey AS n_name, n_nationkey FROM nation) ON s_name = n_name")
def contig_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up among the contigs, the unknown ones marked."""
    names = table(spark, sf_dir, "supplier").selectExpr("concat('chr', s_suppkey % 30) AS name")
    contigs = table(spark, sf_dir, "nation").selectExpr("concat('chr', n_nationkey) AS name", "n_nationkey AS contig")
    return names.join(contigs, "name", "left").select("name", "contig", F.col("contig").isNull().alias("unknown"))


@query(f"WITH {sql_kmers('b', 'benchmark', 'item_id', 21)}, s AS (SELECT * FROM b WHERE {sql_syncmer('kmer', 21, 13)}) SELECT CAST(id AS BIGINT) AS chrom, CAST(pos AS BIGINT) AS start, CAST(pos + 21 AS BIGINT) AS \"end\", kmer AS name, count(*) OVER (PARTITION BY kmer) AS score FROM s")
def syncmer_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmers of the passages with the frequency of each, counted before it is joined."""
    found = S.kmers(sequences(spark, sf_dir, "benchmark", "item_id"), "id", "seq", 21, 13)
    named = found.join(found.groupBy("kmer").agg(F.count("*").alias("score")), "kmer")
    return named.select(F.col("id").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 21).alias("end"), S.kmer_text(F.col("kmer"), 21).alias("name"), "score")


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS best_before FROM {LINES} QUALIFY best_before IS NULL OR l_quantity + 10 > best_before")
def prefix_max_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may still be above the best before them by ten or less."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(spark, sf_dir).withColumn("best_before", F.max("l_quantity").over(w).cast("double"))
    return rows.where("best_before is null or l_quantity + 10 > best_before").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "best_before")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'BND' WHEN 1 THEN 'CNV' WHEN 2 THEN 'DEL' WHEN 3 THEN 'DUP' WHEN 4 THEN 'INS' ELSE 'INV' END AS kind FROM orders) WHERE kind NOT IN ('BND', 'CNV', 'CPX', 'INS') GROUP BY kind")
def sampled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural variants without the types that have no plain sequence."""
    rows = table(spark, sf_dir, "orders").selectExpr("CASE o_orderkey % 6 WHEN 0 THEN 'BND' WHEN 1 THEN 'CNV' WHEN 2 THEN 'DEL' WHEN 3 THEN 'DUP' WHEN 4 THEN 'INS' ELSE 'INV' END AS kind")
    return rows.where(~F.col("kind").isin("BND", "CNV", "CPX", "INS")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS nulls, CAST(max(length(text)) AS BIGINT) AS longest FROM documents")
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters taken on the way by a job that writes nothing, as a row."""
    seen = Observation("documents")
    docs = table(spark, sf_dir, "documents")
    docs.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("text").isNull()).alias("nulls"), F.max(F.length("text")).cast("long").alias("longest")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "nulls", "longest"))], "rows long, nulls long, longest long")
