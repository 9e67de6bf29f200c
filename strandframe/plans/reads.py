"""Read-level queries: seeds chained to explanations, alignments, tiles, variants, record checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions import sequence as S
from ..operators import alignment, chaining, compare, seeds, similarity, validate
from ..session import materialize, table
from .inputs import ALN, SEQ, alignments, sequences
from .registry import query
from .seeds import K, sql_kmers

CHAIN_K = 14


def _both_strands(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Seeds of documents on both strands against the benchmark passages, all k-mers of at most 500 loci."""
    index = seeds.build_index(S.kmers(sequences(spark, sf_dir, "benchmark", "item_id"), "id", "seq", k), "id", 500)
    docs = sequences(spark, sf_dir, "documents", "doc_id")
    forward = S.kmers(docs, "id", "seq", k).select(F.col("id").alias("read_id"), F.col("pos").alias("read_pos"), "kmer")
    return seeds.lookup(forward, seeds.both_strands(index, k))


@query(
    f"""WITH {sql_kmers('d', 'documents', 'doc_id', K)}, {sql_kmers('b', 'benchmark', 'item_id', K)},
  h AS (SELECT d.id AS read_id, b.id AS chrom, d.pos AS q, b.pos - d.pos AS diagonal FROM d JOIN b ON d.kmer = b.kmer),
  f AS (SELECT *, CASE WHEN q > max(q + {K}) OVER (PARTITION BY read_id, chrom, diagonal ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM h),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, chrom, diagonal ORDER BY q ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT read_id, CAST(chrom AS BIGINT) AS chrom, CAST(min(q) AS BIGINT) AS read_start, CAST(max(q) + {K} AS BIGINT) AS read_end, CAST(min(q) + diagonal AS BIGINT) AS entry, CAST(max(q) + {K} + diagonal AS BIGINT) AS exit, count(*) AS hits
FROM g GROUP BY read_id, chrom, diagonal, island"""
)
def compound_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward seeds of one diagonal joined to runs."""
    found = _both_strands(spark, sf_dir, K).where(~F.col("reverse"))
    return chaining.compound_seeds(found, K).select("read_id", "chrom", "read_start", "read_end", "entry", "exit", "hits")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.explain_reads(chaining.compound_seeds(_both_strands(spark, sf_dir, CHAIN_K), CHAIN_K))


@query()
def explain_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best explanation of every document by passages, with mapping qualities; the program is held against brute force in the tests."""
    return _explained(spark, sf_dir).withColumn("score", F.round("score", 4))


@query()
def align_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations as alignment records: each part's bases aligned to the passage's, with CIGAR and identity; unmapped documents too."""
    docs = sequences(spark, sf_dir, "documents", "doc_id").select(F.col("id").alias("read"), F.col("seq").alias("read_seq"))
    passages = sequences(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("chrom"), F.col("seq").alias("ref_seq"))
    parts = materialize(_explained(spark, sf_dir), "explained")
    rows = parts.join(passages, "chrom").join(docs, "read")
    piece = F.substring("read_seq", F.col("read_start").cast("int") + 1, (F.col("read_end") - F.col("read_start")).cast("int"))
    target = F.substring("ref_seq", F.col("ref_start").cast("int") + 1, (F.col("ref_end") - F.col("ref_start")).cast("int"))
    rows = rows.withColumn("a", alignment.global_align(F.when(F.col("reverse"), S.revcomp(piece)).otherwise(piece), target))
    ops = cigar.parse(F.col("a.cigar"))
    records = rows.select("read", "part", "chrom", F.col("ref_start").alias("start"), "reverse", "mapq", F.col("a.cigar").alias("cigar"), F.round(cigar.identity(ops), 6).alias("identity"))
    none = chaining.unmapped(docs, parts, "read").select("read", F.lit(None).cast("int").alias("part"), *(F.lit(None).cast(t).alias(n) for n, t in records.dtypes[2:]))
    return records.unionByName(none)


@query()
def global_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage against the next one."""
    rows = sequences(spark, sf_dir, "benchmark", "item_id")
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("seq").alias("next")), "id")
    return pairs.select("id", alignment.global_align(F.col("seq"), F.col("next")).alias("a")).select("id", "a.score", "a.cigar")


@query(
    f"""WITH s AS (SELECT doc_id AS parent, {SEQ} AS seq FROM documents), t AS (SELECT parent, seq, length(seq) AS n, unnest(range(0, length(seq), 1000)) AS a FROM s), e AS (SELECT *, least(a + 1000, n) AS b FROM t)
SELECT parent, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", md5(substring(seq, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS seq_md5 FROM e WHERE (b - a) * 2 >= 1000"""
)
def make_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.tiles(sequences(spark, sf_dir, "documents", "doc_id"), 1000).select("parent", "start", "end", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


CODES = "FROM (SELECT read, (qs + 24) // 25 * 25 AS q, qs, qe, rs, {shift} AS sh FROM aln), unnest(range(q, qe, 25)) AS u(p)"


@query(
    f"""WITH {ALN}, o AS (SELECT DISTINCT read, p, rs + p - qs AS code {CODES.format(shift='0')}), v AS (SELECT DISTINCT read, p, rs + p - qs + CASE WHEN read % 4 = 0 AND p > 100 THEN 3 ELSE 0 END AS code {CODES.format(shift='0')}),
  a AS (SELECT coalesce(o.read, v.read) AS read, count(*) FILTER (o.code IS NOT NULL AND v.code IS NOT NULL) AS agree, count(*) AS e FROM o FULL JOIN v ON o.read = v.read AND o.p = v.p AND o.code = v.code GROUP BY 1),
  n AS (SELECT read, CASE WHEN agree / e = 1 THEN 'identical' WHEN agree / e >= 0.95 THEN 'near' WHEN agree > 0 THEN 'partial' ELSE 'disjoint' END AS class, round(agree / e, 4) AS score FROM a)
SELECT * FROM n"""
)
def invariance_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions sampled every 25 bases: the place codes of a read against those of a shifted placement of it."""
    aln = alignments(spark, sf_dir)
    first = F.expr("(qs + 24) div 25 * 25")
    at = aln.where("qe > qs").select("read", "qs", "qe", "rs", first.alias("q")).where("q < qe").select("read", "qs", "rs", F.explode(F.expr("sequence(q, qe - 1, 25L)")).alias("p"))
    code = F.col("rs") + F.col("p") - F.col("qs")
    moved = F.when((F.col("read") % 4 == 0) & (F.col("p") > 100), 3).otherwise(0)
    o = at.select("read", "p", code.alias("code"), F.lit(1).alias("o")).distinct()
    v = at.select("read", "p", (code + moved).alias("code"), F.lit(1).alias("v")).distinct()
    both = o.join(v, ["read", "p", "code"], "full_outer").groupBy("read").agg(F.count(F.col("o") + F.col("v")).alias("agree"), F.count("*").alias("either"))
    return compare.invariance(both.withColumns({"n_orig": F.lit(1), "n_var": F.lit(1)}), F.lit(1))


@query(
    f"""WITH {ALN}, c AS (SELECT chrom, CASE WHEN chrom = 'chr4' THEN 100 ELSE 9990 END AS n FROM aln WHERE chrom <> 'chr2' GROUP BY chrom),
  p AS (SELECT read, rank, chrom, rs, re, mapq, cigar, n, read % 200 + 60 AS seq_len, list_sum([CAST(x[:-2] AS BIGINT) FOR x IN regexp_extract_all(cigar, '[0-9]+[MDN=X]')]) AS span, list_sum([CAST(x[:-2] AS BIGINT) FOR x IN regexp_extract_all(cigar, '[0-9]+[MIS=X]')]) AS q FROM aln LEFT JOIN c USING (chrom))
SELECT read, rank, 'unknown_contig' AS problem FROM p WHERE n IS NULL UNION ALL SELECT read, rank, 'query_length' FROM p WHERE q <> seq_len UNION ALL SELECT read, rank, 'beyond_contig' FROM p WHERE rs + span > n"""
)
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = alignments(spark, sf_dir).withColumn("seq_len", F.col("read") % 200 + 60)
    contigs = aln.where("chrom <> 'chr2'").select("chrom").distinct().withColumn("length", F.when(F.col("chrom") == "chr4", 100).otherwise(9990))
    return validate.problems(aln, contigs)


VARIANTS = "v AS (SELECT o_orderkey AS id, CAST(o_custkey * 10 AS BIGINT) AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' ELSE 'INS' END AS kind, CAST(o_orderkey % 90 + 20 AS BIGINT) AS len FROM orders)"


@query(f"WITH {VARIANTS} SELECT id, kind, CASE kind WHEN 'DUP' THEN pos - 1 ELSE pos END AS start, CASE kind WHEN 'INS' THEN pos ELSE pos + len END AS \"end\", CASE kind WHEN 'INS' THEN repeat('ACG', CAST(len % 9 + 1 AS INTEGER)) END AS seq FROM v")
def variant_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    kind = F.when(n % 4 == 0, "DEL").when(n % 4 == 1, "DUP").otherwise("INS")
    length = n % 90 + 20
    alt = F.when(kind == "INS", F.concat(F.lit("A"), F.expr("repeat('ACG', cast((o_orderkey % 90 + 20) % 9 + 1 as int))"))).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    info = F.create_map(F.lit("SVTYPE"), kind, F.lit("SVLEN"), F.when(kind == "DEL", -length).otherwise(length).cast("string"))
    rows = table(spark, sf_dir, "orders").select(n.alias("id"), (F.col("o_custkey") * 10).alias("pos"), F.lit("A").alias("ref"), alt.alias("alt"), info.alias("info"))
    return validate.variant_sequences(rows)


@query(
    f"""WITH {sql_kmers('d', 'documents', 'doc_id', K)}, {sql_kmers('b', 'benchmark', 'item_id', K)}, nd AS (SELECT id, count(DISTINCT kmer) AS n FROM d GROUP BY id), nb AS (SELECT id, count(DISTINCT kmer) AS n FROM b GROUP BY id),
  h AS (SELECT DISTINCT d.id AS q, b.id AS t, kmer FROM d JOIN b USING (kmer)), s AS (SELECT q, t, count(*) AS shared, count(*) / least(nb.n, nd.n) AS score FROM h JOIN nb ON nb.id = t JOIN nd ON nd.id = q GROUP BY q, t, nb.n, nd.n),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t) AS rank FROM s WHERE score >= 0.15)
SELECT q AS doc_id, rank, CAST(t AS BIGINT) AS item_id, shared, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def library_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that share at least 15 % of the k-mers of the smaller of the two with a document, the five best of each: a top-k report."""
    lib = S.kmers(sequences(spark, sf_dir, "benchmark", "item_id"), "id", "seq", K).select(F.col("id").alias("item_id"), "kmer").distinct()
    docs = sequences(spark, sf_dir, "documents", "doc_id")
    reads = S.kmers(docs, "id", "seq", K).select(F.col("id").alias("doc_id"), "kmer")
    n_item = lib.groupBy("item_id").agg(F.count("*").alias("n_item"))
    n_doc = S.different_kmers(docs, "id", "seq", K).select(F.col("id").alias("doc_id"), F.col("different").alias("n_doc"))
    hits = reads.join(lib, "kmer").join(n_item, "item_id").join(n_doc, "doc_id")
    return similarity.top_candidates(hits, "doc_id", "item_id", "n_doc", "n_item").select("doc_id", F.col("rank").cast("long").alias("rank"), "item_id", "shared", F.round("score", 6).alias("score"))


@query(
    f"""WITH {ALN}, o AS (SELECT DISTINCT read, p, rs + p - qs AS code {CODES.format(shift='0')}), v AS (SELECT DISTINCT read, p, rs + p - qs + CASE WHEN read % 4 = 0 AND p > 100 THEN 3 ELSE 0 END AS code {CODES.format(shift='0')} WHERE read % 11 <> 0 OR p < 200),
  a AS (SELECT coalesce(o.read, v.read) AS parent, coalesce(o.p, v.p) // 100 AS tile, count(*) FILTER (o.code IS NOT NULL AND v.code IS NOT NULL) AS agree, count(*) AS e, count(o.code) AS n_o, count(v.code) AS n_v FROM o FULL JOIN v ON o.read = v.read AND o.p = v.p AND o.code = v.code GROUP BY 1, 2),
  m AS (SELECT read AS parent, max(mapq) AS mapq FROM aln GROUP BY read)
SELECT parent, CAST(tile AS BIGINT) AS tile, CASE WHEN n_o = 0 THEN 'parent_unaligned' WHEN n_v = 0 THEN 'unaligned' WHEN agree / e >= 0.9 THEN 'agree' WHEN agree > 0 THEN 'partial' WHEN mapq >= 20 THEN 'disagree_confident' ELSE 'disagree_lowmapq' END AS class, round(agree / e, 4) AS score FROM a JOIN m USING (parent)"""
)
def invariance_frag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place codes of a read's tiles of 100 bases against those of a second placement of the tiles."""
    aln = alignments(spark, sf_dir)
    at = aln.where("qe > qs").select("read", "qs", "qe", "rs", F.expr("(qs + 24) div 25 * 25").alias("q")).where("q < qe").select("read", "qs", "rs", F.explode(F.expr("sequence(q, qe - 1, 25L)")).alias("p"))
    code = F.col("rs") + F.col("p") - F.col("qs")
    moved = F.when((F.col("read") % 4 == 0) & (F.col("p") > 100), 3).otherwise(0)
    o = at.select("read", "p", code.alias("code"), F.lit(1).alias("o")).distinct()
    v = at.where("read % 11 <> 0 or p < 200").select("read", "p", (code + moved).alias("code"), F.lit(1).alias("v")).distinct()
    both = o.join(v, ["read", "p", "code"], "full_outer").groupBy("read", F.expr("p div 100").alias("tile"))
    sums = both.agg(F.count(F.col("o") + F.col("v")).alias("agree"), F.count("*").alias("either"), F.count("o").alias("n_o"), F.count("v").alias("n_v"))
    return compare.tile_invariance(sums.join(aln.groupBy("read").agg(F.max("mapq").alias("mapq")), "read"))


@query()
def chain_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains without the price of further loci; the program is held against all chains in the tests."""
    seeds_ = chaining.compound_seeds(_both_strands(spark, sf_dir, CHAIN_K), CHAIN_K)
    return chaining.explain_reads(seeds_, config=chaining.ChainConfig(locus_bits=0.0)).withColumn("score", F.round("score", 4))


@query(
    """WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey AS UHUGEINT) AS h FROM orders), m AS (SELECT CAST(18446744073709551616 AS UHUGEINT) AS m),
  a AS (SELECT k, m, (xor(h, h >> 33) * CAST(18397679294719823053 AS UHUGEINT)) % m AS h FROM x, m), b AS (SELECT k, m, (xor(h, h >> 33) * CAST(14181476777654086739 AS UHUGEINT)) % m AS h FROM a), c AS (SELECT k, xor(h, h >> 33) AS h FROM b)
SELECT k AS o_orderkey, CAST(h AS VARCHAR) AS hash FROM c"""
)
def hash_mix64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned, as text."""

    @F.pandas_udf("string")
    def mix(x: pd.Series) -> pd.Series:
        return pd.Series(S.mix64_array(x.to_numpy(np.int64).view(np.uint64))).astype(str)

    return table(spark, sf_dir, "orders").where("o_orderkey is not null").select("o_orderkey", mix("o_orderkey").alias("hash"))
