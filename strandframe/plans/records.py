"""Queries of CIGAR editing and record emission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, registered, scalars
from ..functions import sequence as S
from ..operators import records
from ..session import prepare, table
from .inputs import ALN, LINES, SEQ, alignments, lines
from .registry import query
from .seeds import sql_kmers

#: CIGARs of six shapes, neighbouring kinds and empty operations among them.
SHAPED = """concat(case l_linenumber % 6 when 0 then '4S3S' when 1 then '' when 2 then '7H' when 3 then '0M' when 4 then '2I' else '1X2X' end, l_suppkey % 30 + 1, '=',
  case l_partkey % 5 when 0 then '3I0D2I' when 1 then concat(l_linenumber, 'D', 2, 'D') when 2 then concat(l_linenumber, 'X') when 3 then '2I3D' else '' end, cast(l_quantity as bigint), '=', 5, 'M', case l_orderkey % 3 when 0 then '9S' when 1 then '1D' else '' end)"""
ROWS = f"c AS (SELECT l_orderkey AS read, CAST(l_linenumber AS BIGINT) AS line, {SHAPED} AS cigar FROM {LINES}), o AS (SELECT read, line, cigar, list_transform(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1), lambda p: {{'op': p[-1], 'len': CAST(p[:-2] AS BIGINT)}}) AS ops FROM c)"


def _sum(kinds: str, ops: str = "ops") -> str:
    return f"CAST(coalesce(list_sum([x.len FOR x IN {ops} IF contains('{kinds}', x.op)]), 0) AS BIGINT)"


#: Runs of one kind among the operations of a list ``xs`` of each row, as text, by a window over their places.
def _joined(ctes: str, key: str) -> str:
    return f"""{ctes}, u AS (SELECT {key}, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM xs WHERE len(xs) > 0), v AS (SELECT {key}, i, x.op AS op, x.len AS n, x.op IS DISTINCT FROM lag(x.op) OVER (PARTITION BY {key} ORDER BY i) AS fresh FROM u WHERE x.len > 0),
  w AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY {key} ORDER BY i) AS run FROM v), r AS (SELECT {key}, run, any_value(op) AS op, sum(n) AS n FROM w GROUP BY {key}, run), t AS (SELECT {key}, string_agg(n || op, '' ORDER BY run) AS text FROM r GROUP BY {key})"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).selectExpr("l_orderkey AS read", "cast(l_linenumber as bigint) AS line", f"{SHAPED} AS cigar")
    return rows.withColumn("ops", cigar.parse(F.col("cigar")))


@query(f"WITH {ROWS}, {_joined('xs AS (SELECT read, line, list_concat(ops, list_reverse(ops)) AS xs FROM o)', 'read, line')} SELECT read, line, text AS cigar FROM t")
def cigar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each CIGAR and its reversal, one after the other, normalised."""
    return _ops(spark, sf_dir).select("read", "line", cigar.text(cigar.join(F.col("ops"), F.reverse("ops"))).alias("cigar"))


_CUT = "x AS (SELECT read, line, unnest(ops) AS x, unnest(range(len(ops))) AS i FROM o), y AS (SELECT read, line, i, x.op AS op, x.len AS n, contains('MDN=X', x.op) AS ref, coalesce(sum(CASE WHEN contains('MDN=X', x.op) THEN x.len ELSE 0 END) OVER (PARTITION BY read, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM x)"


@query(
    f"""WITH {ROWS}, {_CUT}, z AS (SELECT *, CASE WHEN r >= 20 THEN 0 WHEN ref THEN least(n, 20 - r) ELSE n END AS h, CASE WHEN r >= 20 THEN n WHEN ref AND r + n > 20 THEN r + n - 20 ELSE 0 END AS t FROM y),
  s AS (SELECT read, line, coalesce(string_agg(h || op, '' ORDER BY i) FILTER (r < 20), '') AS head, coalesce(string_agg(t || op, '' ORDER BY i) FILTER (r >= 20 OR ref AND r + n > 20), '') AS tail, sum(CASE WHEN ref THEN n ELSE 0 END) AS span FROM z GROUP BY read, line)
SELECT read, line, CASE WHEN span >= 20 THEN head END AS head, CASE WHEN span >= 20 THEN tail END AS tail FROM s"""
)
def cigar_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each CIGAR cut at reference offset 20."""
    rows = _ops(spark, sf_dir).withColumn("s", cigar.split_at(F.col("ops"), F.lit(20)))
    return rows.select("read", "line", cigar.text(F.col("s.head")).alias("head"), cigar.text(F.col("s.tail")).alias("tail"))


@query(
    f"""WITH {ROWS}, p AS (SELECT *, {_sum('=')} AS m, {_sum('X')} AS x, {_sum('=XI')} AS q, {_sum('=XD')} AS r, coalesce(list_sum([least(6.0 + 2.0 * e.len, 26.0 + 1.0 * e.len) FOR e IN ops IF contains('ID', e.op)]), 0) AS gap,
  {_sum('=M')} AS good, coalesce(list_sum([6.0 + e.len FOR e IN ops IF contains('ID', e.op)]), 0) AS gap_bits FROM o)
SELECT read, line, round(CASE WHEN greatest(q, r) > 0 THEN m / greatest(q, r) ELSE 1.0 END, 6) AS identity, CAST(4.0 * x + gap AS DOUBLE) AS divergence, CAST(2.0 * m - 4.0 * x - gap AS DOUBLE) AS quality, CAST(2.0 * good - 8.0 * x - gap_bits AS DOUBLE) AS bits FROM p"""
)
def cigar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.col("ops")
    return _ops(spark, sf_dir).select("read", "line", F.round(cigar.identity_longest(ops), 6).alias("identity"), cigar.divergence(ops).alias("divergence"), cigar.quality(ops).alias("quality"), cigar.alignment_bits(ops).alias("bits"))


@query(
    f"""WITH s AS (SELECT doc_id, regexp_replace({SEQ}, '[^ACGT]', 'N', 'g') AS seq, CAST(doc_id % 5 + 1 AS BIGINT) AS k FROM documents WHERE length(text) >= 400), t AS (SELECT doc_id, seq, k, unnest([100, 137, 200, 261]) AS p FROM s),
  a AS (SELECT doc_id, p, k, coalesce(list_position([seq[p - j] <> seq[p + k - j] FOR j IN range(p)], true) - 1, p) AS shift FROM t)
SELECT doc_id, CAST(p AS BIGINT) AS at, CASE WHEN shift < p THEN (p - shift) || '=' ELSE '' END || k || 'D' || (shift + 50) || '=' AS cigar FROM a"""
)
def left_align_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion of one to five bases at four places of each text, moved left as far as the bases let it."""
    rows = table(spark, sf_dir, "documents").where("length(text) >= 400").selectExpr("doc_id", f"regexp_replace({SEQ}, '[^ACGT]', 'N') AS seq", "doc_id % 5 + 1 AS k").withColumn("p", F.explode(F.array(*map(F.lit, (100, 137, 200, 261)))))
    text = F.concat(F.col("p").cast("string"), F.lit("="), F.col("k").cast("string"), F.lit("D50="))
    read = F.concat(F.expr("substring(seq, 1, p)"), F.expr("substring(seq, cast(p + k + 1 as int), 50)"))
    return rows.select("doc_id", F.col("p").cast("long").alias("at"), cigar.left_align(text, read, F.col("seq")).alias("cigar"))


PART = {
    "read": "l_orderkey", "part": "cast(l_linenumber as bigint)", "chrom": "concat('chr', l_suppkey % 5)", "start": "(l_partkey * 7) % 10000", "reverse": "l_linestatus = 'F'", "mapq": "cast(l_partkey % 61 as bigint)",
    "read_start": "cast((l_linenumber - 1) * 60 as bigint)", "read_end": "cast((l_linenumber - 1) * 60 + 20 + l_quantity as bigint)", "read_len": "cast(480 as bigint)",
    "cigar": "concat(cast(l_quantity as bigint), '=', l_suppkey % 4 + 1, 'X', l_partkey % 3 + 1, 'D', 16 - l_suppkey % 4, '=3I')",
}
PARTS = "p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PART.items()) + f" FROM {LINES})"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in PART.items()))


@query(
    f"""WITH {PARTS}, e AS (SELECT *, read_start AS lft, read_len - read_end AS rgt, list_transform(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1), lambda p: {{'op': p[-1], 'len': CAST(p[:-2] AS BIGINT)}}) AS ops FROM p),
  f AS (SELECT *, {_sum('M=X')} AS m, {_sum('I')} - {_sum('D')} AS more, {_sum('XID')} AS nm, CASE WHEN reverse THEN rgt ELSE lft END AS a, CASE WHEN reverse THEN lft ELSE rgt END AS b FROM e),
  g AS (SELECT *, chrom || ',' || start || ',' || CASE WHEN reverse THEN '-' ELSE '+' END || ',' || CASE WHEN lft > 0 THEN lft || 'H' ELSE '' END || m || 'M' || CASE WHEN more > 0 THEN more || 'I' WHEN more < 0 THEN -more || 'D' ELSE '' END || CASE WHEN rgt > 0 THEN rgt || 'H' ELSE '' END || ',' || mapq || ',' || nm AS entry,
    row_number() OVER (PARTITION BY read ORDER BY part) AS k FROM f)
SELECT x.read, x.part, CAST(CASE WHEN x.reverse THEN 16 ELSE 0 END + CASE WHEN x.k = 1 THEN 0 ELSE 2048 END AS INTEGER) AS flag, x.chrom, x.start, x.mapq, CASE WHEN x.a > 0 THEN x.a || 'H' ELSE '' END || x.cigar || CASE WHEN x.b > 0 THEN x.b || 'H' ELSE '' END AS cigar,
  (SELECT string_agg(y.entry, ';' ORDER BY y.part) FROM g y WHERE y.read = x.read AND y.part <> x.part) AS sa FROM g x"""
)
def record_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, hard clips and SA tags of reads in parts."""
    return records.emit(_parts(spark, sf_dir))


@query(f"WITH {PARTS}, k AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY part) AS k FROM p) SELECT x.read, x.part, y.chrom AS sa_chrom, CAST(y.start AS BIGINT) AS sa_pos, y.reverse AS sa_reverse, CAST(y.mapq AS INTEGER) AS sa_mapq FROM k x JOIN k y ON x.read = y.read AND x.part <> y.part")
def sa_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SA tags of record_emission read back."""
    return records.sa_entries(records.emit(_parts(spark, sf_dir))).select("read", "part", "sa_chrom", "sa_pos", "sa_reverse", "sa_mapq")


@query(f"WITH {PARTS} SELECT DISTINCT read, CAST(1 AS BIGINT) AS records FROM p")
def primary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without the supplementary ones."""
    rows = records.emit(_parts(spark, sf_dir)).where(F.col("flag").bitwiseAND(records.SUPPLEMENTARY) == 0)
    return rows.groupBy("read").agg(F.count("*").alias("records"))


_SEEDS = f"s AS (SELECT l_orderkey AS read, CAST(l_linenumber AS BIGINT) AS step, CAST(l_suppkey % 3 AS BIGINT) AS chrom, l_linestatus = 'F' AS reverse, CAST((l_linenumber - 1) * 25 + l_partkey % 40 AS BIGINT) AS a, CAST((l_linenumber - 1) * 25 + l_partkey % 40 + l_quantity AS BIGINT) AS b, (l_partkey * 11) % 9000 AS r FROM {LINES})"


@query(
    f"""WITH {_SEEDS}, t AS (SELECT *, max(a) OVER (PARTITION BY read ORDER BY step) AS f, lead(a) OVER (PARTITION BY read ORDER BY step) AS nx FROM s), u AS (SELECT *, greatest(least(b, coalesce(nx, b)), f) AS l FROM t)
SELECT read, step, chrom, reverse, f AS read_start, l AS read_end, CAST(r + CASE WHEN reverse THEN b - l ELSE f - a END AS BIGINT) AS ref_start FROM u"""
)
def chain_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).selectExpr(
        "l_orderkey AS read", "cast(l_linenumber as bigint) AS step", "cast(l_suppkey % 3 as bigint) AS chrom", "l_linestatus = 'F' AS reverse", "cast((l_linenumber - 1) * 25 + l_partkey % 40 as bigint) AS read_start",
        "cast((l_linenumber - 1) * 25 + l_partkey % 40 + l_quantity as bigint) AS read_end", "(l_partkey * 11) % 9000 AS ref_start",
    )
    return records.bounds(rows)


@query(
    """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey - 10 END AS os, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey + 5 END AS ins,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey + 90 END AS e, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey + 80 END AS ine, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey + 99 END AS oe FROM orders),
  p AS (SELECT *, coalesce(s, ins, os) AS pos, coalesce(e, ine, oe) AS last FROM v)
SELECT id, pos, last AS "end", CASE WHEN coalesce(os, ins) IS NOT NULL THEN coalesce(os - pos, 0) END AS cipos_low, CASE WHEN coalesce(os, ins) IS NOT NULL THEN coalesce(ins - pos, 0) END AS cipos_high,
  CASE WHEN coalesce(ine, oe) IS NOT NULL THEN coalesce(ine - last, 0) END AS ciend_low, CASE WHEN coalesce(ine, oe) IS NOT NULL THEN coalesce(oe - last, 0) END AS ciend_high FROM p"""
)
def variant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, end and their confidence intervals of variants that say some of their inner and outer bounds."""
    some = lambda n, e: F.expr(f"CASE WHEN o_orderkey % {n} = 0 THEN NULL ELSE {e} END")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), some(3, "o_custkey").alias("start"), some(5, "o_custkey - 10").alias("outer_start"), some(7, "o_custkey + 5").alias("inner_start"), some(4, "o_custkey + 90").alias("stop"), some(6, "o_custkey + 80").alias("inner_end"), some(11, "o_custkey + 99").alias("outer_end")
    )
    at = scalars.variant_place(*(F.col(c) for c in ("outer_start", "start", "inner_start", "inner_end", "stop", "outer_end")))
    return rows.select("id", at.alias("a")).select("id", "a.*")


_FNV32 = "list_reduce(list_prepend(2166136261::BIGINT, [((o_orderkey >> (8 * b)) & 255)::BIGINT FOR b IN range(8)]), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@query(f"SELECT o_orderkey, {_FNV32} AS hash FROM orders")
def hash_fnv32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.fnv32(F.col("o_orderkey")).alias("hash"))


@query("SELECT o_orderkey, CAST(coalesce(list_position([o_comment[i] <> c_comment[i] FOR i IN range(1, least(length(o_comment), length(c_comment)) + 1)], true) - 1, least(length(o_comment), length(c_comment))) AS BIGINT) AS n FROM (SELECT o_orderkey, CAST(o_custkey * 1001 AS VARCHAR) AS o_comment, CAST(o_custkey * 1001 + o_orderkey % 50 AS VARCHAR) AS c_comment FROM orders)")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_custkey * 1001 as string) AS a", "cast(o_custkey * 1001 + o_orderkey % 50 as string) AS b")
    return rows.select("o_orderkey", S.common_prefix(F.col("a"), F.col("b")).alias("n"))


@query(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, round(n * (1 + 0.25 * log10(n)) / (1 + 0.5 * log10(m) / (1 + 0.25 * log10(n))), 4) AS single, round(n * 3.5 / sqrt(m), 4) AS collinear, round(1 / sqrt(m), 6) AS atom
FROM (SELECT *, CAST(l_quantity + 20 AS DOUBLE) AS n, CAST(l_suppkey % 40 + 1 AS DOUBLE) AS m FROM lineitem)"""
)
def seed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = (F.col("l_quantity") + 20).cast("double"), (F.col("l_suppkey") % 40 + 1).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.round(scalars.seed_weight(n, m), 4).alias("single"), F.round(scalars.collinear_weight(n, F.lit(3.5), m), 4).alias("collinear"), F.round(scalars.atom_weight(m), 6).alias("atom")
    )


@query(f"WITH d AS (SELECT doc_id, {SEQ} AS seq FROM documents) SELECT doc_id, md5(reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))) AS rc_md5, CAST(CASE WHEN doc_id < 1 THEN 0 ELSE 1 << (length(bin(doc_id)) - 1) END AS BIGINT) AS band, CAST(greatest(0, least(doc_id, 70) - greatest(20, doc_id % 30)) AS BIGINT) AS shared FROM d")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package's functions called from SQL text."""
    prepare(spark)
    registered.register(spark)
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SEQ} AS seq")
    return spark.sql("SELECT doc_id, md5(sf_revcomp(seq)) AS rc_md5, sf_size_band(doc_id) AS band, sf_overlap(doc_id % 30, doc_id, 20L, 70L) AS shared FROM {docs}", docs=docs)


@query(
    f"""WITH {sql_kmers('d', 'documents', 'doc_id', 12)} SELECT id AS doc_id, count(*) AS kmers, count(DISTINCT kmer) AS different, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last FROM d GROUP BY id"""
)
def sql_kmers_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers of every document by the table function, called from SQL text."""
    prepare(spark)
    registered.register(spark)
    docs = S.by_id(table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SEQ} AS seq"), "doc_id")
    return S.kmer_totals(spark.sql("SELECT doc_id, pos, kmer FROM {docs} d, LATERAL sf_kmers(d.seq, 12)", docs=docs), "doc_id")


_SUM = "coalesce(list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(cigar, '([0-9]+)[{}]', 1)]), 0)"


@query(
    f"""WITH {ALN} SELECT read, rank, CAST({_SUM.format('MISHX=')} AS BIGINT) AS bases, CAST({_SUM.format('MDN=X')} AS BIGINT) AS span, CAST({_SUM.format('XID')} AS BIGINT) AS edits,
  round({_SUM.format('=')} / nullif({_SUM.format('=XID')}, 0), 6) AS identity FROM aln"""
)
def sql_cigar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every record's CIGAR string by the functions that SQL text can call."""
    prepare(spark)
    registered.register(spark)
    aln = alignments(spark, sf_dir).select("read", "rank", "cigar")
    return spark.sql("SELECT read, rank, sf_query_length(cigar) AS bases, sf_ref_span(cigar) AS span, sf_edit_distance(cigar) AS edits, round(sf_identity(cigar), 6) AS identity FROM {aln}", aln=aln)
