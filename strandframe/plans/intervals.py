"""Interval and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, scalars
from ..operators import compare, intervals, stats
from ..session import table
from .inputs import ALN, FIRST_WHERE, LHS, OTHER, OTHER_WHERE, RHS, alignments
from .registry import query

ISLANDS = """f AS (SELECT chrom, rs, re, CASE WHEN rs > max(re) OVER (PARTITION BY chrom ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM aln),
  g AS (SELECT chrom, rs, re, sum(fresh) OVER (PARTITION BY chrom ORDER BY rs, re ROWS UNBOUNDED PRECEDING) AS island FROM f),
  isl AS (SELECT chrom, min(rs) AS s, max(re) AS e, count(*) AS n FROM g GROUP BY chrom, island)"""
QI = """f AS (SELECT read, qs, qe, CASE WHEN qs > max(qe) OVER (PARTITION BY read ORDER BY qs, qe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM aln),
  g AS (SELECT read, qs, qe, sum(fresh) OVER (PARTITION BY read ORDER BY qs, qe ROWS UNBOUNDED PRECEDING) AS island FROM f),
  isl AS (SELECT read, min(qs) AS s, max(qe) AS e FROM g GROUP BY read, island)"""
OPS = "o AS (SELECT read, rank, chrom, reverse, cigar, list_transform(regexp_extract_all(cigar, '([0-9]+[MIDNSHP=X])', 1), lambda p: {'op': p[-1], 'len': CAST(p[:-2] AS BIGINT)}) AS ops FROM aln)"


def _total(kinds: str) -> str:
    return f"CAST(coalesce(list_sum([x.len FOR x IN ops IF contains('{kinds}', x.op)]), 0) AS BIGINT)"


def _where(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.col("rs").alias("start"), F.col("re").alias("end"))


@query(f'WITH {ALN}, {ISLANDS} SELECT chrom, s AS start, e AS "end", n FROM isl')
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_binned(_where(alignments(spark, sf_dir)), ["chrom"], 1000)


@query(f'WITH {ALN}, {QI} SELECT * FROM (SELECT read, e AS start, lead(s) OVER (PARTITION BY read ORDER BY s) AS "end" FROM isl) WHERE "end" IS NOT NULL')
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(alignments(spark, sf_dir).select("read", F.col("qs").alias("start"), F.col("qe").alias("end")), ["read"])


@query(f"WITH {ALN}, {ISLANDS} SELECT chrom, CAST(sum(e - s) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS intervals FROM isl GROUP BY chrom")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage(_where(alignments(spark, sf_dir)), ["chrom"])


@query(
    """WITH v AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, event_id FROM events),
  f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 3600 THEN 1 ELSE 0 END AS fresh FROM v)
SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM f"""
)
def dbscan_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return intervals.linkage(rows, ["user_id"], "t", 3600).select("event_id", "group")


@query(
    f"""WITH {ALN}, q AS (SELECT p_partkey AS id, concat('chr', p_partkey % 5) AS chrom, (p_partkey * 31) % 10000 AS s, (p_partkey * 31) % 10000 + p_size AS e FROM part)
SELECT id, count(*) AS hits, CAST(sum(least(e, re) - greatest(s, rs)) AS BIGINT) AS bases FROM aln JOIN q ON aln.chrom = q.chrom AND rs < e AND s < re AND re > rs GROUP BY id"""
)
def range_join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") * 31) % 10000
    regions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("chrom"), at.alias("start"), (at + F.col("p_size")).alias("end"))
    met = intervals.overlap_sums(regions, _where(alignments(spark, sf_dir)), ["chrom"], 500)
    return met.groupBy("id").agg(F.sum("hits").alias("hits"), F.sum("bases").alias("bases"))


@query(
    f"""WITH {ALN}, st AS (SELECT n_nationkey AS priority, n_name AS name, concat('chr', n_nationkey % 5) AS chrom, n_nationkey * 331 % 9000 AS s, n_nationkey * 331 % 9000 + 700 AS e FROM nation),
  m AS (SELECT read, rank, min_by(name, priority) AS name FROM aln JOIN st ON aln.chrom = st.chrom AND rs >= s AND rs < e GROUP BY read, rank)
SELECT coalesce(name, 'other') AS stratum, count(*) AS n FROM aln LEFT JOIN m USING (read, rank) GROUP BY 1"""
)
def strata_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stratum that holds the start of a record wins; else ``other``."""
    at = F.col("n_nationkey") * 331 % 9000
    strata = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("priority"), F.col("n_name").alias("name"), F.concat(F.lit("chr"), F.col("n_nationkey") % 5).alias("chrom"), at.alias("start"), (at + 700).alias("end"))
    aln = alignments(spark, sf_dir).select("read", "rank", "chrom", "rs")
    named = intervals.contains_point(aln, strata, ["chrom"], "rs", 500).groupBy("read", "rank").agg(F.min_by("name", "priority").alias("name"))
    return aln.join(named, ["read", "rank"], "left").groupBy(F.coalesce("name", F.lit("other")).alias("stratum")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {LHS}, {RHS} SELECT l.read, CAST(sum(least(l.re, r.re) - greatest(l.rs, r.rs)) AS BIGINT) AS shared FROM lhs l JOIN rhs r ON l.read = r.read AND l.chrom = r.chrom AND l.reverse = r.reverse AND l.rs < r.re AND r.rs < l.re GROUP BY l.read"""
)
def intersect_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["read", "chrom", "reverse", F.col("rs").alias("start"), F.col("re").alias("end")]
    lhs, rhs = alignments(spark, sf_dir, where=FIRST_WHERE).select(*cols), alignments(spark, sf_dir, OTHER, OTHER_WHERE).select(*cols)
    pairs = intervals.range_join(lhs, rhs, ["read", "chrom", "reverse"], 1000)
    return pairs.groupBy("read").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).cast("long").alias("shared"))


@query(f"WITH {ALN} SELECT read, rank, chrom FROM (SELECT *, max(re) OVER (PARTITION BY chrom, reverse ORDER BY rs, read * 8 + rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM aln) WHERE rs < reach")
def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).withColumn("at", F.col("read") * 8 + F.col("rank"))
    return intervals.overlapping(rows, ["chrom", "reverse"], "at", "rs", "re").select("read", "rank", "chrom")


@query(f"WITH {ALN}, {OPS} SELECT read, rank, {_total('MIS=XH')} AS query_length, {_total('MDN=X')} AS reference_span, {_total('=')} AS matches, {_total('X')} AS mismatches, {_total('I')} AS ins_bases, {_total('D')} AS del_bases FROM o")
def cigar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = cigar.parse(F.col("cigar"))
    t = lambda kinds, name: cigar.total(F.col("ops"), kinds).alias(name)
    return alignments(spark, sf_dir).withColumn("ops", ops).select("read", "rank", t("MIS=XH", "query_length"), t("MDN=X", "reference_span"), t("=", "matches"), t("X", "mismatches"), t("I", "ins_bases"), t("D", "del_bases"))


@query(f'WITH {ALN}, {OPS}, c AS (SELECT read, rank, reverse, {_total("MIS=XH")} AS n, ops[1].len AS lead, ops[-1].len AS trail FROM o) SELECT read, rank, CASE WHEN reverse THEN trail ELSE lead END AS start, n - CASE WHEN reverse THEN lead ELSE trail END AS "end" FROM c')
def cigar_query_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).withColumn("q", cigar.query_range(cigar.parse(F.col("cigar")), F.col("reverse")))
    return rows.select("read", "rank", F.col("q.start").cast("long").alias("start"), F.col("q.end").cast("long").alias("end"))


@query(f"WITH {ALN}, {OPS} SELECT read, rank, {_total('XID')} AS edit_distance FROM o")
def cigar_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("read", "rank", cigar.edit_distance(cigar.parse(F.col("cigar"))).alias("edit_distance"))


@query(
    f"""WITH {ALN}, {OPS} SELECT read, rank, concat(ops[1].len, 'S', ops[2].len + ops[3].len + ops[4].len, 'M', ops[5].len, 'I', ops[6].len, 'M', ops[7].len, 'D', ops[8].len, 'M', ops[9].len, 'H') AS cigar FROM o"""
)
def cigar_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("read", "rank", cigar.basic(F.col("cigar")).alias("cigar"))


@query(f"WITH {ALN}, {OPS}, i AS (SELECT read, rank, {_total('=')} / {_total('MID=X')} AS id FROM o) SELECT read, rank, round(id, 6) AS identity, round(CASE WHEN id >= 1 THEN 60.0 ELSE least(60.0, greatest(0.0, -20 * log10(1 - id))) END, 6) AS phred FROM i")
def cigar_identity_phred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir).withColumn("i", cigar.identity(cigar.parse(F.col("cigar"))))
    return rows.select("read", "rank", F.round("i", 6).alias("identity"), F.round(cigar.identity_phred(F.col("i")), 6).alias("phred"))


BAND = "CAST(1 << (length(bin({n})) - 1) AS BIGINT)"


@query(f"WITH {ALN}, {OPS}, e AS (SELECT chrom, unnest(ops) AS x FROM o) SELECT chrom, CASE x.op WHEN 'I' THEN 'ins' ELSE 'del' END AS kind, {BAND.format(n='x.len')} AS band, count(*) AS events, CAST(sum(x.len) AS BIGINT) AS bases FROM e WHERE x.op IN ('I', 'D') GROUP BY ALL")
def size_band_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.indel_spectrum(alignments(spark, sf_dir), ["chrom"])


@query(f"WITH {ALN}, d AS (SELECT chrom, rs % 2000 AS d FROM aln) SELECT chrom, CASE WHEN d = 0 THEN 0 ELSE {BAND.format(n='d')} END AS bin, count(*) AS n FROM d GROUP BY ALL")
def error_distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).groupBy("chrom", scalars.size_band(F.col("rs") % 2000).alias("bin")).agg(F.count("*").alias("n"))


FP = "string_agg(concat(chrom, ':', rs, '-', re, ':', CASE WHEN reverse THEN '-' ELSE '+' END, ':', qs, '-', qe), ';' ORDER BY concat(chrom, ':', rs, '-', re, ':', CASE WHEN reverse THEN '-' ELSE '+' END, ':', qs, '-', qe))"
BOTH = f"""{LHS}, {RHS}, a AS (SELECT read, {FP} AS fp, count(*) AS n FROM lhs GROUP BY read), b AS (SELECT read, {FP} AS fp, count(*) AS n FROM rhs GROUP BY read),
  cmp AS (SELECT coalesce(a.read, b.read) AS read, CASE WHEN b.fp IS NULL THEN 'lhs' WHEN a.fp IS NULL THEN 'rhs' WHEN a.fp = b.fp THEN 'agree' ELSE 'both' END AS state, coalesce(a.fp, '') AS lhs_fp, coalesce(b.fp, '') AS rhs_fp, coalesce(a.n, 0) AS lhs_n, coalesce(b.n, 0) AS rhs_n FROM a FULL JOIN b ON a.read = b.read)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return alignments(spark, sf_dir, where=FIRST_WHERE), alignments(spark, sf_dir, OTHER, OTHER_WHERE)


@query(f"WITH {ALN} SELECT read, {FP} AS fingerprint, count(*) AS segments FROM aln GROUP BY read")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.fingerprints(alignments(spark, sf_dir))


@query(f"WITH {BOTH} SELECT * FROM cmp")
def compare_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.outer(*_sides(spark, sf_dir))


@query(
    f"""WITH {LHS}, {RHS}, r AS (SELECT o_orderkey AS read FROM orders),
  a AS (SELECT read, list(struct_pack(rank := rank, chrom := chrom, reverse := reverse, rs := rs) ORDER BY rank, chrom, reverse, rs) AS l FROM lhs GROUP BY read), b AS (SELECT read, list(struct_pack(rank := rank, chrom := chrom, reverse := reverse, rs := rs) ORDER BY rank, chrom, reverse, rs) AS r FROM rhs GROUP BY read)
SELECT r.read, CASE WHEN l IS NULL AND b.r IS NULL THEN 'both_unmapped' WHEN l IS NULL THEN 'only_2_mapped' WHEN b.r IS NULL THEN 'only_1_mapped'
  WHEN l[1].chrom <> b.r[1].chrom THEN 'discordant_chrom' WHEN l[1].reverse <> b.r[1].reverse THEN 'discordant_strand' WHEN abs(l[1].rs - b.r[1].rs) > 100 THEN 'discordant_pos'
  WHEN len(l) <> len(b.r) THEN 'different_count'
  WHEN list_bool_and([l[i].chrom = b.r[i].chrom AND l[i].reverse = b.r[i].reverse AND abs(l[i].rs - b.r[i].rs) <= 100 FOR i IN range(1, len(l) + 1)]) THEN 'concordant' ELSE 'partial_match' END AS category
FROM r LEFT JOIN a USING (read) LEFT JOIN b USING (read)"""
)
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read"))
    return compare.concordance(*_sides(spark, sf_dir), reads)


OUTCOME = """{name} AS (SELECT t.read, CASE WHEN NOT coalesce(bool_or(x.rank = 1), false) THEN 'UNMAPPED' WHEN bool_or(x.rank = 1 AND {hit}) THEN 'OK' WHEN bool_or({hit}) THEN 'SECONDARY' ELSE 'MISMATCH' END AS outcome
  FROM truth t LEFT JOIN {side} x ON t.read = x.read GROUP BY t.read)"""
HIT = "x.chrom = t.chrom AND x.reverse = t.reverse AND abs(x.rs - t.rs) <= 50 AND abs(x.re - t.re) <= 50"
TRUTH = "truth AS (SELECT read, chrom, reverse, rs, re FROM aln WHERE rank = 1)"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).where("rank = 1")


@query(f"WITH {ALN}, {TRUTH}, {RHS}, {OUTCOME.format(name='oc', side='rhs', hit=HIT)} SELECT * FROM oc")
def truth_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.truth_outcome(_truth(spark, sf_dir), _sides(spark, sf_dir)[1])


@query(f"WITH {ALN}, {TRUTH}, {LHS}, {RHS}, {OUTCOME.format(name='oa', side='lhs', hit=HIT)}, {OUTCOME.format(name='ob', side='rhs', hit=HIT)} SELECT oa.outcome AS a, ob.outcome AS b, count(*) AS count FROM oa JOIN ob USING (read) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lhs, rhs = _sides(spark, sf_dir)
    truth = _truth(spark, sf_dir)
    return compare.confusion(compare.truth_outcome(truth, lhs), compare.truth_outcome(truth, rhs))


EXISTING = """ex AS (SELECT o_orderkey AS read_name, CASE o_orderkey % 5 WHEN 0 THEN 'lhs' WHEN 1 THEN 'agree' WHEN 2 THEN 'uncurated' WHEN 3 THEN 'clip' ELSE 'neither' END AS verdict, '' AS lhs_fingerprint, '' AS rhs_fingerprint, '' AS notes FROM orders WHERE o_custkey % 2 = 0)"""
MERGED = f"""{BOTH}, {EXISTING}, mg AS (SELECT coalesce(read_name, read) AS read_name,
  CASE WHEN state IS NULL THEN verdict WHEN state = 'agree' THEN 'agree' WHEN verdict IS NULL OR verdict IN ('agree', 'clip', 'ends') OR (lhs_fingerprint <> lhs_fp AND verdict <> 'uncurated') THEN 'uncurated' ELSE verdict END AS verdict,
  coalesce(lhs_fp, lhs_fingerprint) AS lhs_fingerprint, coalesce(rhs_fp, rhs_fingerprint) AS rhs_fingerprint, coalesce(notes, '') AS notes FROM ex FULL JOIN cmp ON read_name = read)"""


@query(f"WITH {MERGED} SELECT * FROM mg")
def curation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 5
    verdict = F.when(n == 0, "lhs").when(n == 1, "agree").when(n == 2, "uncurated").when(n == 3, "clip").otherwise("neither")
    empty = [F.lit("").alias(c) for c in ("lhs_fingerprint", "rhs_fingerprint", "notes")]
    existing = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("read_name"), verdict.alias("verdict"), *empty)
    compared = compare.outer(*_sides(spark, sf_dir)).select(F.col("read").alias("read_name"), "state", "lhs_fp", "rhs_fp")
    return compare.curate(existing, compared)


@query(f"WITH {MERGED} SELECT read_name, lhs_fingerprint, rhs_fingerprint FROM mg WHERE verdict = 'uncurated' ORDER BY read_name LIMIT 100")
def curation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred reads to judge: a top-k report."""
    return curation_merge(spark, sf_dir).where("verdict = 'uncurated'").orderBy("read_name").limit(100).select("read_name", "lhs_fingerprint", "rhs_fingerprint")


@query(
    f"""WITH {ALN}, {QI}, u AS (SELECT read, sum(e - s) AS un FROM isl GROUP BY read)
SELECT aln.read, count(*) AS records, CAST(max(un) AS BIGINT) AS aligned_union, CAST(sum(qe - qs) AS BIGINT) AS aligned_sum, CAST(max(qe) - min(qs) - max(un) AS BIGINT) AS interior_gap, CAST(min(qs) AS BIGINT) AS clip5, CAST(max(read_len) - max(qe) AS BIGINT) AS clip3
FROM aln JOIN u ON aln.read = u.read GROUP BY aln.read"""
)
def read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_summary(alignments(spark, sf_dir))


@query(
    f"""WITH {ALN}, {QI}, x AS (SELECT read, s, e, lag(e) OVER w AS b, lead(s) OVER w AS a FROM isl WINDOW w AS (PARTITION BY read ORDER BY s)),
  p AS (SELECT read, 'mapped' AS type, s AS start, e AS "end" FROM x UNION ALL SELECT read, CASE WHEN b IS NULL THEN 'left' ELSE 'interior' END, coalesce(b, 0), s FROM x UNION ALL SELECT read, 'right', e, 500 FROM x WHERE a IS NULL)
SELECT read, type, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM p WHERE "end" > start"""
)
def read_coverage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_segments(alignments(spark, sf_dir))


@query(
    f"""WITH {ALN}, n AS (SELECT read, chrom, reverse, qe, rs, re, lead(chrom) OVER w AS c2, lead(reverse) OVER w AS v2, lead(qs) OVER w AS q2, lead(rs) OVER w AS r2, lead(re) OVER w AS e2 FROM aln WINDOW w AS (PARTITION BY read ORDER BY qs, rank, chrom, reverse, rs, re)),
  g AS (SELECT read, q2 - qe AS gq, CASE WHEN reverse THEN rs - e2 ELSE r2 - re END AS gr FROM n WHERE chrom = c2 AND reverse = v2)
SELECT read, CASE WHEN gr > gq THEN 'del' ELSE 'ins' END AS kind, CAST(abs(gr - gq) AS BIGINT) AS size FROM g WHERE gq BETWEEN -100 AND 10000 AND gr BETWEEN -100 AND 10000 AND gr <> gq"""
)
def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split_events(alignments(spark, sf_dir))


@query(
    """WITH c AS (SELECT user_id, median(value) AS m, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 3), r AS (SELECT e.*, m FROM events e JOIN c USING (user_id)),
  d AS (SELECT user_id, median(abs(value - m)) AS mad FROM r GROUP BY user_id)
SELECT event_id, round(value, 6) AS value, round(m, 6) AS median FROM r JOIN d USING (user_id) WHERE value < m - greatest(1.0 * 1.4826 * mad, 0.05)"""
)
def windowed_identity_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad_outliers(table(spark, sf_dir, "events"), "user_id", "value", k=1.0).select("event_id", F.round("value", 6).alias("value"), F.round("median", 6).alias("median"))


REPORT = f"""{ALN}, {OPS}, b AS (SELECT chrom, CASE WHEN reverse THEN 'rev' ELSE 'fwd' END AS stratum, {_total('=')} AS m, {_total('MID=X')} AS c, {_total('X')} AS x, {_total('ID')} AS g FROM o),
  gs AS (SELECT chrom AS key, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, sum(m) AS m, sum(c) AS c, sum(x) AS x, sum(g) AS g FROM b GROUP BY GROUPING SETS ((chrom), (chrom, stratum))),
  rep AS (SELECT key, stratum, 'identity' AS metric, round(m / c, 6) AS value FROM gs UNION ALL SELECT key, stratum, 'mismatch_rate', round(x / c, 6) FROM gs UNION ALL SELECT key, stratum, 'gap_rate', round(g / c, 6) FROM gs)"""


@query(f"WITH {REPORT} SELECT * FROM rep")
def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = cigar.parse(F.col("cigar"))
    rows = alignments(spark, sf_dir).withColumn("ops", ops).select(F.col("chrom").alias("key"), F.when(F.col("reverse"), "rev").otherwise("fwd").alias("stratum"), *(cigar.total(F.col("ops"), k).alias(n) for k, n in (("=", "m"), ("MID=X", "c"), ("X", "x"), ("ID", "g"))))
    return stats.report(rows, "key", "stratum", {n: (F.col(a), F.col("c")) for n, a in (("identity", "m"), ("mismatch_rate", "x"), ("gap_rate", "g"))})


@query(f"WITH {REPORT} SELECT metric, stratum, {', '.join(f'max(CASE WHEN key = $chr{i}$ THEN value END) AS chr{i}' for i in range(5)).replace('$', chr(39))} FROM rep GROUP BY metric, stratum")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pivot(report_grouping_sets(spark, sf_dir), "key")


@query("WITH v AS (SELECT l_returnflag, l_linenumber, l_partkey, l_orderkey, least(1.0, (l_quantity + 10 - greatest(l_linenumber, 1) + 1) / (l_quantity + 10 + abs(l_suppkey % 20))) AS cov FROM lineitem), c AS (SELECT l_returnflag, quantile_cont(cov, 0.75) AS cut FROM v GROUP BY 1) SELECT l_orderkey, l_linenumber, round(cov, 6) AS coverage FROM v JOIN c USING (l_returnflag) WHERE cov >= cut")
def repeat_quantile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = scalars.repeat_coverage(F.col("l_linenumber"), F.col("l_quantity") + 10, F.col("l_suppkey") % 20)
    rows = table(spark, sf_dir, "lineitem").withColumn("cov", cov)
    return stats.quantile_filter(rows, "l_returnflag", "cov").select("l_orderkey", "l_linenumber", F.round("cov", 6).alias("coverage"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) - 1 AS last FROM events WHERE value IS NOT NULL) SELECT event_type, CAST(q AS BIGINT) AS q, value FROM r, range(0, 11) t(q) WHERE i = q * last // 10")
def quantile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("q", F.col("q").cast("long"))


@query("SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(*) AS count FROM events GROUP BY ALL")
def int_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events"), ["event_type"], F.floor("value"))
