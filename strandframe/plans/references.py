"""Queries over the reference as blocks: extension of seeds, bases checked along CIGAR strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain_programs, chaining, extension, gap_scores, records, reference, seeds, segments
from ..session import materialize, table
from .inputs import SEQ, lines, sequences
from .registry import query
from .reads import CHAIN_K, _both_strands
from .rescue import _HITS, _RUNS, PRUNE_K, _hits

#: Narrow blocks, so that windows of the short passages cross their borders.
NARROW = 64


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.blocks(sequences(spark, sf_dir, "benchmark", "item_id"), NARROW, "id")


def _prefix(a: str, b: str, n: int = 500) -> str:
    """Common prefix of two strings in SQL, by positions."""
    return f"coalesce(list_min([i FOR i IN range(0, least(length({a}), length({b}), {n})) IF substr({a}, i + 1, 1) <> substr({b}, i + 1, 1)]), least(length({a}), length({b}), {n}))"


@query(
    f"""WITH {_RUNS}, p AS (SELECT s.*, CASE WHEN reverse THEN diagonal - read_end + {PRUNE_K} ELSE diagonal + read_start END AS ref_start FROM s),
  r AS (SELECT p.*, ref_start + read_end - read_start AS ref_end, t.seq AS read_seq, x.seq AS ref FROM p JOIN (SELECT doc_id, {SEQ} AS seq FROM documents) t ON t.doc_id = p.read_id JOIN (SELECT item_id, {SEQ} AS seq FROM benchmark) x ON x.item_id = p.chrom),
  fl AS (SELECT *, substr(read_seq, CAST(greatest(read_start - 500, 0) + 1 AS BIGINT), CAST(least(read_start, 500) AS BIGINT)) AS l, substr(read_seq, CAST(read_end + 1 AS BIGINT), 500) AS rr,
    reverse(substr(ref, CAST(greatest(ref_start - 500, 0) + 1 AS BIGINT), CAST(least(ref_start, 500) AS BIGINT))) AS low, substr(ref, CAST(ref_end + 1 AS BIGINT), 500) AS high FROM r),
  tu AS (SELECT *, CASE WHEN reverse THEN translate(regexp_replace(reverse(l), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA') ELSE reverse(l) END AS lf, CASE WHEN reverse THEN translate(regexp_replace(rr, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA') ELSE rr END AS rf,
    CASE WHEN reverse THEN high ELSE low END AS lw, CASE WHEN reverse THEN low ELSE high END AS rw FROM fl)
SELECT read_id, CAST(chrom AS BIGINT) AS chrom, reverse, CAST(read_start AS BIGINT) AS read_start, CAST(read_end AS BIGINT) AS read_end, CAST(ref_start AS BIGINT) AS ref_start, CAST({_prefix('lf', 'lw')} AS BIGINT) AS left_ext, CAST({_prefix('rf', 'rw')} AS BIGINT) AS right_ext FROM tu"""
)
def extended_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of every document and how far they match on, up to 500 bases a side, against the passages' blocks."""
    runs = chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K)
    seeds = runs.select(F.col("read_id").alias("read"), "chrom", "reverse", "read_start", "read_end", F.least("entry", "exit").alias("ref_start"), F.greatest("entry", "exit").alias("ref_end"))
    reads = sequences(spark, sf_dir, "documents", "doc_id").withColumnRenamed("id", "read")
    found = reference.extend_exact(seeds, reads, _passages(spark, sf_dir), width=NARROW)
    return found.select(F.col("read").alias("read_id"), "chrom", "reverse", "read_start", "read_end", "ref_start", "left_ext", "right_ext")


TILE = 200
#: Records of three kinds over every document's tiles, some with changed bases, too long a CIGAR or on no contig.
_TILES = {"n": f"least({TILE}, total - rank * {TILE})", "start": f"rank * {TILE}"}
_KIND = {
    "cigar": "case rank % 3 when 0 then concat(n, 'M') when 1 then concat('30=2D', n - 32, 'M') else concat('20=3I', n - 21, 'M1X') end",
    "bases": "case rank % 3 when 0 then t when 1 then concat(substring(t, 1, 30), substring(t, 33)) else concat(substring(t, 1, 20), 'GGG', substring(t, 21)) end",
    "chrom": "case when rank % 41 = 40 then -1 else doc_id end",
}
_CHANGED = "case when rank % 50 = 7 then translate(bases, 'A', 'C') when rank % 37 = 5 then concat(bases, 'A') else bases end"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SEQ} AS seq").withColumn("total", F.length("seq").cast("long")).where("total >= 60")
    rows = docs.select("doc_id", "seq", "total", F.explode(F.expr(f"sequence(0L, (total - 60) div {TILE})")).alias("rank"))
    rows = rows.withColumns({n: F.expr(e).cast("long") for n, e in _TILES.items()}).withColumn("t", F.expr(f"substring(seq, cast(start as int) + 1, {TILE})"))
    rows = rows.withColumns({n: F.expr(e) for n, e in _KIND.items()})
    return rows.select("doc_id", "rank", "chrom", "start", "cigar", F.expr(_CHANGED).alias("seq"))


_RECORDS = f"""d AS (SELECT doc_id, {SEQ} AS seq, length({SEQ}) AS total FROM documents), e AS (SELECT *, unnest(range(0, (total - 60) // {TILE} + 1)) AS rank FROM d WHERE total >= 60),
  f AS (SELECT *, {", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in _TILES.items())}, substring(seq, rank * {TILE} + 1, {TILE}) AS t FROM e), g AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _KIND.items())} FROM f), rec AS (SELECT doc_id, rank, chrom, start, n, cigar, t, total, {_CHANGED} AS q FROM g)"""
#: The aligned pieces of a record: operation, place in the read, place in the tile, length.
_CHECKED = f"""{_RECORDS}, runs AS (SELECT *, unnest(CASE rank % 3 WHEN 0 THEN [{{'o': 'M', 'q': 0, 'r': 0, 'n': n}}] WHEN 1 THEN [{{'o': '=', 'q': 0, 'r': 0, 'n': 30}}, {{'o': 'M', 'q': 30, 'r': 32, 'n': n - 32}}]
    ELSE [{{'o': '=', 'q': 0, 'r': 0, 'n': 20}}, {{'o': 'M', 'q': 23, 'r': 20, 'n': n - 21}}, {{'o': 'X', 'q': n + 2, 'r': n - 1, 'n': 1}}] END) AS x FROM rec),
  cmp AS (SELECT doc_id, rank, x.o AS o, CASE WHEN chrom < 0 THEN 0 ELSE x.n END AS n, CASE WHEN chrom < 0 THEN 0 ELSE list_sum([CASE WHEN substr(q, x.q + i + 1, 1) = substr(t, x.r + i + 1, 1) THEN 1 ELSE 0 END FOR i IN range(0, x.n)]) END AS same FROM runs),
  c AS (SELECT doc_id, rank, coalesce(sum(same) FILTER (o = 'M'), 0) AS mm, coalesce(sum(n - same) FILTER (o = 'M'), 0) AS mx, coalesce(sum(n - same) FILTER (o = '='), 0) AS ex, coalesce(sum(same) FILTER (o = 'X'), 0) AS xm FROM cmp GROUP BY doc_id, rank),
  v AS (SELECT doc_id, rank, mm, mx, ex, xm, array_to_string(list_filter([CASE WHEN chrom < 0 THEN 'unknown_contig' END, CASE WHEN rank % 37 = 5 AND rank % 50 <> 7 THEN 'query_length' END, CASE WHEN ex > 0 THEN 'match_mismatch' END, CASE WHEN xm > 0 THEN 'mismatch_match' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM rec JOIN c USING (doc_id, rank))"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sequences(spark, sf_dir, "documents", "doc_id")
    contigs = docs.select(F.col("id").alias("chrom"), F.length("seq").cast("long").alias("length"))
    return reference.check_bases(_records(spark, sf_dir), contigs, reference.blocks(docs, 1024, "id"), ["doc_id", "rank"], 1024)


@query(f"WITH {_CHECKED} SELECT doc_id, CAST(rank AS BIGINT) AS rank, CAST(mm AS BIGINT) AS m_matches, CAST(mx AS BIGINT) AS m_mismatches, CAST(ex AS BIGINT) AS eq_mismatches, CAST(xm AS BIGINT) AS x_matches, problems FROM v")
def checked_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of every document as records, compared with the documents base by base."""
    return _checked(spark, sf_dir).withColumn("problems", F.array_join("problems", ","))


@query(f"WITH {_CHECKED} SELECT count(*) AS records, CAST(sum(CASE WHEN problems = '' THEN 0 ELSE len(string_split(problems, ',')) END) AS BIGINT) AS problems, CAST(sum(mm) AS BIGINT) AS m_matches, CAST(sum(mx) AS BIGINT) AS m_mismatches, round(sum(mx) / sum(mm + mx), 9) AS mismatch_rate, sum(CASE WHEN problems = '' THEN 0 ELSE 1 END) = 0 AND sum(mx) / sum(mm + mx) <= 0.01 AS passed FROM v")
def validation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems, bases under M and the one-per-cent gate."""
    return reference.validation(_checked(spark, sf_dir)).withColumn("mismatch_rate", F.round("mismatch_rate", 9))


@query()
def terminal_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's longest seed, grown into both of its ends until the score drops; held against the full matrix in the tests."""
    runs = chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K)
    best = runs.groupBy("read_id").agg(F.max(F.struct((F.col("read_end") - F.col("read_start")).alias("n"), "chrom", "reverse", "read_start", "read_end", F.least("entry", "exit").alias("ref_start"), F.greatest("entry", "exit").alias("ref_end"))).alias("b"))
    parts = best.select(F.col("read_id").alias("read"), F.lit(0).alias("part"), *(F.col(f"b.{c}").alias(c) for c in ("chrom", "reverse", "read_start", "read_end", "ref_start", "ref_end")))
    reads = sequences(spark, sf_dir, "documents", "doc_id").withColumnRenamed("id", "read")
    return extension.extend_ends(parts, reads, _passages(spark, sf_dir), x=30, width=NARROW).withColumnRenamed("read", "read_id")


@query()
def bridged_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best chain without detours that an alignment of the flanks explains as well."""
    runs = chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K)
    weighted = runs.select(F.col("read_id").alias("read"), "chrom", "reverse", "diagonal", "read_start", "read_end", ((F.col("read_end") - F.col("read_start")) / F.sqrt("multiplicity")).alias("weight"))
    low = F.when(F.col("reverse"), F.col("diagonal") - F.col("read_end") + PRUNE_K).otherwise(F.col("diagonal") + F.col("read_start"))
    chain = materialize(chain_programs.chain_by_breaks(weighted, scheme=chain_programs.BreakScheme(penalty=2.0)).withColumn("ref_start", low), "chains")
    reads = sequences(spark, sf_dir, "documents", "doc_id").withColumnRenamed("id", "read")
    found = segments.collapse_breaks(chain, reads, _passages(spark, sf_dir), width=NARROW)
    return found.select(F.col("read").alias("read_id"), "place", "chrom", "reverse", "read_start", "read_end", "ref_start", "step", "bridge_cigar")


@query()
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring segments of every order that overlap on the reference as one, the worse side of the overlap inserted."""
    rows = lines(spark, sf_dir).selectExpr(
        "l_orderkey AS read", "cast(l_linenumber as int) AS part", "'c' AS chrom", "l_orderkey % 2 = 0 AS reverse", "l_linenumber * 100 AS read_start", "l_linenumber * 100 + 90 AS read_end",
        "case when l_orderkey % 2 = 0 then (10 - l_linenumber) else l_linenumber end * 60 + l_suppkey % 20 AS ref_start", "concat(10 + l_partkey % 30, '=', l_suppkey % 7 + 1, 'X', 80 - (10 + l_partkey % 30) - (l_suppkey % 7 + 1), '=10I') AS cigar",
    )
    return segments.merge_overlaps(rows.withColumn("ref_end", F.col("ref_start") + 80), "read", forced=30)


#: SQL of the gaps: the seeds of a diagonal's runs, numbered, each with the nearest three before it.
_SEED_GAPS = f"""WITH {_RUNS}, z AS (SELECT read_id, chrom, reverse, read_start, read_end, CASE WHEN reverse THEN diagonal - read_start + {PRUNE_K} ELSE diagonal + read_start END AS entry,
    CASE WHEN reverse THEN diagonal - read_end + {PRUNE_K} ELSE diagonal + read_end END AS exit, row_number() OVER (PARTITION BY read_id ORDER BY read_end, read_start, chrom, reverse, diagonal) - 1 AS seed FROM s),
  pairs AS (SELECT i.read_id, i.seed, j.seed AS before, i.chrom, i.reverse, j.read_end AS read_start, i.read_start AS read_end, least(j.exit, i.entry) AS ref_start, greatest(j.exit, i.entry) AS ref_end,
    row_number() OVER (PARTITION BY i.read_id, i.seed ORDER BY j.seed DESC) AS nth FROM z i JOIN z j ON i.read_id = j.read_id AND i.chrom = j.chrom AND i.reverse = j.reverse
      AND i.read_start - j.read_end BETWEEN 20 AND 2000 AND (CASE WHEN i.reverse THEN j.exit - i.entry ELSE i.entry - j.exit END) BETWEEN 0 AND 2000)"""


@query(
    f"""{_SEED_GAPS} SELECT read_id, CAST(seed AS BIGINT) AS seed, CAST(before AS BIGINT) AS before, CAST(chrom AS BIGINT) AS chrom, reverse, CAST(read_start AS BIGINT) AS read_start, CAST(read_end AS BIGINT) AS read_end,
  CAST(ref_start AS BIGINT) AS ref_start, CAST(ref_end AS BIGINT) AS ref_end FROM pairs WHERE nth <= 3"""
)
def seed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between every document's seeds that an alignment may close: the three nearest seeds before each."""
    return gap_scores.candidates(chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K))


@query()
def explained_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best explanation of every document where a gap earns the bits of its alignment; held against brute force in the tests."""
    return _explained_with_gaps(spark, sf_dir).withColumnRenamed("read", "read_id").withColumn("score", F.round("score", 4))


def _explained_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = materialize(chaining.compound_seeds(_both_strands(spark, sf_dir, CHAIN_K), CHAIN_K), "seeds")
    reads = sequences(spark, sf_dir, "documents", "doc_id").withColumnRenamed("id", "read_id")
    return chaining.explain_reads(runs, gaps=gap_scores.scored(gap_scores.candidates(runs), reads, _passages(spark, sf_dir), width=NARROW))


def aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``records, parts`` of every document: its best explanation, parts cut apart, aligned to the passages' blocks, with flags, clips and SA tags."""
    found = materialize(_explained_with_gaps(spark, sf_dir), "explained")
    parts = records.apart(found.select("read", "part", "chrom", "reverse", "read_start", "read_end", "ref_start", "ref_end", "mapq"))
    reads = sequences(spark, sf_dir, "documents", "doc_id").withColumnRenamed("id", "read")
    done = materialize(records.align_parts(parts, reads, _passages(spark, sf_dir), width=NARROW), "aligned")
    return records.emit(done.withColumnRenamed("ref_start", "start")), done


@query()
def aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every document that a passage explains: hard clips, supplementary flags and SA tags; the tests check bases and overlaps."""
    return aligned(spark, sf_dir)[0]


@query(
    f"""WITH {_HITS}, v AS (SELECT read_id, chrom, reverse, diagonal, read_start, read_end FROM h),
  lens AS (SELECT doc_id AS read_id, length({SEQ}) AS n FROM documents), w AS (SELECT read_id, chrom, reverse, list(DISTINCT diagonal ORDER BY diagonal) AS d FROM v GROUP BY ALL),
  a AS (SELECT read_id, chrom, reverse, list_reduce(list_prepend([d[1]], [[y] FOR y IN d]), lambda p, y: CASE WHEN y[1] - p[-1] >= 800 THEN p || y ELSE p END) AS anchors FROM w),
  bb AS (SELECT v.*, list_max([z FOR z IN anchors IF z <= diagonal]) AS band FROM v JOIN a USING (read_id, chrom, reverse)),
  c AS (SELECT *, CASE WHEN read_start > max(read_end) OVER (PARTITION BY read_id, chrom, reverse, band ORDER BY read_start, read_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM bb),
  e AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, chrom, reverse, band ORDER BY read_start, read_end ROWS UNBOUNDED PRECEDING) AS island FROM c),
  f AS (SELECT read_id, chrom, reverse, band, island, min(diagonal) AS low, max(diagonal) AS high, count(*) AS n, max(read_end) - min(read_start) AS covered FROM e GROUP BY ALL)
SELECT read_id, CAST(chrom AS BIGINT) AS chrom, reverse, CAST(band AS BIGINT) AS band, CAST(min(low) AS BIGINT) AS low, CAST(max(high) AS BIGINT) AS high, CAST(sum(f.n) AS BIGINT) AS n, CAST(sum(covered) AS BIGINT) AS covered, round(sum(covered) / max(lens.n), 6) AS coverage
FROM f JOIN lens USING (read_id) GROUP BY read_id, chrom, reverse, band HAVING sum(covered) / max(lens.n) >= 0.01"""
)
def covered_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal bands of every document and passage that cover a hundredth of the document or more."""
    found = _hits(spark, sf_dir)
    diagonal = F.when(F.col("reverse"), F.col("ref_pos") + F.col("read_pos")).otherwise(F.col("ref_pos") - F.col("read_pos"))
    hits = found.select("read_id", "chrom", "reverse", diagonal.alias("diagonal"), F.lit(1.0).alias("weight"), F.col("read_pos").alias("read_start"), (F.col("read_pos") + PRUNE_K).alias("read_end"))
    lengths = sequences(spark, sf_dir, "documents", "doc_id").select(F.col("id").alias("read_id"), F.length("seq").alias("length"))
    out = seeds.band_coverage(hits, ["read_id", "chrom", "reverse"], lengths, "read_id", 800, 0.01)
    return out.select("read_id", "chrom", "reverse", "band", "low", "high", "n", "covered", F.round("coverage", 6).alias("coverage"))
