"""Pileup queries: documents as reads at made-up places of a reference, one contig per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pileup
from .inputs import SEQ
from .registry import query
from ..session import table

#: A read of n bases: 5 clipped, 20 equal, 2 inserted, 15 equal, 3 deleted, the rest equal.
BASE = f"""d AS (SELECT doc_id, source AS chrom, (doc_id * 37) % 500 AS start, doc_id % 40 AS mapq, {SEQ} AS seq FROM documents WHERE source IS NOT NULL),
  ref AS (SELECT chrom, min_by(seq, doc_id) AS seq FROM d GROUP BY chrom),
  place AS (SELECT * FROM (SELECT chrom, unnest(regexp_extract_all(seq, '(?s).')) AS ref, unnest(range(length(seq))) AS pos FROM ref) WHERE ref IN ('A', 'C', 'G', 'T')),
  base AS (SELECT chrom, start, mapq, unnest(regexp_extract_all(seq, '(?s).')) AS allele, unnest(range(length(seq))) AS q FROM d WHERE length(seq) >= 60),
  seen AS (SELECT chrom, start + CASE WHEN q < 25 THEN q - 5 WHEN q < 42 THEN q - 7 ELSE q - 4 END AS pos, mapq, allele FROM base WHERE q >= 5 AND q NOT IN (25, 26) AND allele IN ('A', 'C', 'G', 'T')
    UNION ALL SELECT chrom, start + i, mapq, '-' FROM d, unnest([35, 36, 37]) t(i) WHERE length(seq) >= 60 UNION ALL SELECT chrom, start + 19, mapq, '+' FROM d WHERE length(seq) >= 60),
  cls AS (SELECT *, 'all' AS class FROM seen UNION ALL SELECT *, 'q20' FROM seen WHERE mapq >= 20),
  agg AS (SELECT chrom, pos, class, count(*) FILTER (allele = 'A') AS A, count(*) FILTER (allele = 'C') AS C, count(*) FILTER (allele = 'G') AS G, count(*) FILTER (allele = 'T') AS T, count(*) FILTER (allele = '-') AS del, count(*) FILTER (allele = '+') AS ins FROM cls GROUP BY ALL),
  cnt AS (SELECT p.chrom, p.pos, p.ref, k.class, coalesce(A, 0) AS A, coalesce(C, 0) AS C, coalesce(G, 0) AS G, coalesce(T, 0) AS T, coalesce(del, 0) AS del, coalesce(ins, 0) AS ins,
    coalesce(A, 0) + coalesce(C, 0) + coalesce(G, 0) + coalesce(T, 0) + coalesce(del, 0) AS depth FROM place p CROSS JOIN (VALUES ('all'), ('q20')) k(class) LEFT JOIN agg a ON a.chrom = p.chrom AND a.pos = p.pos AND a.class = k.class)"""
CALL = f"""{BASE},
  top AS (SELECT *, list_sort([{{'n': -x.n, 'o': x.a <> ref, 'i': x.i, 'a': x.a}} FOR x IN [{{'a': 'A', 'n': A, 'i': 0}}, {{'a': 'C', 'n': C, 'i': 1}}, {{'a': 'G', 'n': G, 'i': 2}}, {{'a': 'T', 'n': T, 'i': 3}}, {{'a': '-', 'n': del, 'i': 4}}]]) AS r,
    CASE ref WHEN 'A' THEN A WHEN 'C' THEN C WHEN 'G' THEN G ELSE T END AS ref_count FROM cnt),
  cal AS (SELECT *, r[1].a AS major, -r[1].n AS major_count, r[2].a AS minor, -r[2].n AS minor_count, depth >= 2 AS called,
    CASE WHEN depth >= 2 THEN -r[1].n / depth END AS major_af, CASE WHEN depth >= 2 THEN -r[2].n / depth END AS minor_af, CASE WHEN depth >= 2 THEN least(1.0, ins / depth) END AS ins_af,
    CASE WHEN depth >= 2 THEN least(4, length(bin(greatest(1, depth // 2))) - 1) END AS depth_bin FROM top)"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq")
    rows = table(spark, sf_dir, "documents").where("source is not null").selectExpr("doc_id", "source AS chrom", "(doc_id * 37) % 500 AS start", "doc_id % 40 AS mapq", f"{SEQ} AS seq")
    return rows.withColumn("cigar", F.when(n >= 60, F.concat(F.lit("5S20=2I15=3D"), (n - 42).cast("string"), F.lit("="))))


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reads = _reads(spark, sf_dir)
    reference = reads.groupBy("chrom").agg(F.min_by("seq", "doc_id").alias("seq"))
    return pileup.counts(reads.where("cigar is not null"), reference), reference


@query(f"WITH {BASE} SELECT * FROM cnt WHERE depth + ins > 0")
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)[0].where("depth + ins > 0")


@query(
    f"""WITH {CALL} SELECT chrom, class, count(*) AS positions, count(*) FILTER (called) AS called_positions, CAST(sum(depth) AS BIGINT) AS depth_sum, CAST(sum(ref_count) AS BIGINT) AS ref_sum, CAST(sum(depth - ref_count - del) AS BIGINT) AS mismatch_sum,
  CAST(sum(del) AS BIGINT) AS del_sum, CAST(sum(ins) AS BIGINT) AS ins_sum, count(*) FILTER (called AND major <> ref) AS major_nonref, count(*) FILTER (minor_af >= 0.2) AS candidate_sites FROM cal GROUP BY chrom, class"""
)
def pileup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.totals(pileup.called(_counts(spark, sf_dir)[0]), ["chrom", "class"])


@query(f"WITH {BASE} SELECT chrom, class, CAST(least(depth, 1000) AS BIGINT) AS bin, count(*) AS count FROM cnt GROUP BY ALL")
def pileup_depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.depth_histogram(_counts(spark, sf_dir)[0], ["chrom", "class"])


@query(
    f"""WITH {CALL}, af AS (SELECT class, depth_bin, unnest(['major', 'minor', 'ins']) AS kind, unnest([major_af, minor_af, ins_af]) AS af FROM cal WHERE called)
SELECT class, CAST(depth_bin AS BIGINT) AS depth_bin, kind, CAST(least(floor(af * 100), 99) AS BIGINT) AS bin, count(*) AS count FROM af GROUP BY ALL"""
)
def pileup_af_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.share_histogram(pileup.called(_counts(spark, sf_dir)[0]), ["class"])


@query(f'WITH {CALL} SELECT chrom, pos AS start, pos + 1 AS "end", class, CAST(depth AS BIGINT) AS depth, ref, major, CAST(major_count AS BIGINT) AS major_count, minor, CAST(minor_count AS BIGINT) AS minor_count FROM cal WHERE minor_af >= 0.2')
def pileup_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pileup.called(_counts(spark, sf_dir)[0]).where("candidate")
    return rows.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "class", "depth", "ref", "major", "major_count", "minor", "minor_count")


@query(
    f"""WITH {BASE}, s AS (SELECT chrom, pos // 250 * 250 AS start, count(*) FILTER (class = 'all') AS positions, sum(depth) FILTER (class = 'all') AS a, sum(depth) FILTER (class = 'q20') AS q FROM cnt GROUP BY ALL),
  w AS (SELECT chrom, length(seq) AS n, unnest(range(0, length(seq), 250)) AS start FROM ref)
SELECT w.chrom, w.start, CAST(least(w.start + 250, n) AS BIGINT) AS "end", coalesce(positions, 0) AS positions, round(coalesce(a / positions, 0), 6) AS mean_depth_all, round(coalesce(q / positions, 0), 6) AS mean_depth_q FROM w LEFT JOIN s ON s.chrom = w.chrom AND s.start = w.start"""
)
def pileup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, reference = _counts(spark, sf_dir)
    return pileup.window_depth(counts, reference.select("chrom", F.length("seq").alias("length")), 250)


#: Thirteen strata on every contig, some of which overlap.
_STRATA = "SELECT i AS priority, 'S' || i AS stratum, chrom, (i * 131) % 900 AS s, (i * 131) % 900 + 120 AS e FROM (SELECT chrom, unnest(range(13)) AS i FROM ref)"


@query(
    f"""WITH {CALL}, st AS ({_STRATA}), m AS (SELECT p.chrom, p.pos, min_by(stratum, priority) AS stratum FROM place p JOIN st ON st.chrom = p.chrom AND p.pos >= s AND p.pos < e GROUP BY p.chrom, p.pos)
SELECT class, coalesce(stratum, 'other') AS stratum, count(*) AS positions, count(*) FILTER (called) AS called_positions, CAST(sum(depth) AS BIGINT) AS depth_sum, CAST(sum(ref_count) AS BIGINT) AS ref_sum, CAST(sum(depth - ref_count - del) AS BIGINT) AS mismatch_sum,
  CAST(sum(del) AS BIGINT) AS del_sum, CAST(sum(ins) AS BIGINT) AS ins_sum, count(*) FILTER (called AND major <> ref) AS major_nonref, count(*) FILTER (minor_af >= 0.2) AS candidate_sites FROM cal LEFT JOIN m USING (chrom, pos) GROUP BY class, coalesce(stratum, 'other')"""
)
def pileup_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine counters by class and stratum; of strata that overlap the first counts."""
    counts, reference = _counts(spark, sf_dir)
    at = (F.col("i") * 131) % 900
    numbered = reference.select("chrom", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("i"))
    strata = numbered.select("chrom", F.col("i").alias("priority"), F.concat(F.lit("S"), F.col("i").cast("string")).alias("stratum"), at.alias("start"), (at + 120).alias("end"))
    return pileup.totals(pileup.stratified(pileup.called(counts), strata, 100), ["class", "stratum"])
