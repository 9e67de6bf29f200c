"""Queries of two sets of records against each other, by the full rules: touching intervals, merged sides, placements in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compare, filters, intervals
from ..session import table
from .inputs import ALIGNMENT, ALN, FIRST_WHERE, LEN, LHS, LINES, OTHER, OTHER_WHERE, RHS, alignments, columns, lines
from .registry import query


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return alignments(spark, sf_dir, where=FIRST_WHERE), alignments(spark, sf_dir, OTHER, OTHER_WHERE)


_REGIONS = "g AS (SELECT p_partkey AS id, concat('chr', p_partkey % 5) AS chrom, (p_partkey * 31) % 10000 AS s, (p_partkey * 31) % 10000 + p_size % 20 AS e FROM part)"


@query(f"WITH {ALN}, {_REGIONS} SELECT id, count(*) AS hits, count(*) FILTER (rs = e OR re = s) AS touching FROM g JOIN aln ON g.chrom = aln.chrom AND rs <= e + 5 AND s <= re + 5 WHERE re >= rs GROUP BY id")
def touching_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and the records that overlap, touch or lie within five bases of them."""
    at = (F.col("p_partkey") * 31) % 10000
    regions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("chrom"), at.alias("start"), (at + F.col("p_size") % 20).alias("end"))
    records = alignments(spark, sf_dir).select("chrom", F.col("rs").alias("start"), F.col("re").alias("end"))
    met = intervals.touching_sums(regions, records, ["chrom"], 500, 5)
    return met.groupBy("id").agg(F.sum("hits").alias("hits"), F.sum("touching").alias("touching"))


def sql_islands(name: str, source: str, keys: str, start: str, end: str) -> str:
    """CTE ``name (keys, s, e)`` of merged intervals, touching ones joined."""
    k = ", ".join(keys.split())
    return f"""{name} AS (SELECT {k}, min({start}) AS s, max({end}) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY {k} ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING) AS i FROM
    (SELECT *, CASE WHEN {start} > max({end}) OVER (PARTITION BY {k} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM {source})) GROUP BY {k}, i)"""


@query(
    f"""WITH {LHS}, {RHS}, {sql_islands('l', 'lhs', 'chrom reverse', 'rs', 're')}, {sql_islands('r', 'rhs', 'chrom reverse', 'rs', 're')}
SELECT chrom, reverse, CAST(sum(least(l.e, r.e) - greatest(l.s, r.s)) AS BIGINT) AS shared FROM l JOIN r USING (chrom, reverse) WHERE l.s < r.e AND r.s < l.e GROUP BY chrom, reverse"""
)
def merged_intersect_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference bases that both sides cover on each chromosome and strand, each side merged first."""
    sides = (s.select("chrom", "reverse", F.col("rs").alias("start"), F.col("re").alias("end")) for s in _sides(spark, sf_dir))
    return intervals.shared_length(*sides, ["chrom", "reverse"], 1000)


#: The second side's ranks turned round in every third read, so that order alone differs.
_TURNED = "CASE WHEN read % 3 = 0 THEN CASE WHEN rank = 1 THEN 1 ELSE 9 - rank END ELSE rank END"


@query(
    f"""WITH RECURSIVE {LHS}, {RHS}, q AS (SELECT o_orderkey AS read FROM orders), t AS (SELECT read, {_TURNED} AS rank, chrom, reverse, rs FROM rhs),
  a AS (SELECT read, list({{'rank': rank, 'chrom': chrom, 'reverse': reverse, 'rs': rs}} ORDER BY rank, chrom, reverse, rs) AS l FROM lhs GROUP BY read), b AS (SELECT read, list({{'rank': rank, 'chrom': chrom, 'reverse': reverse, 'rs': rs}} ORDER BY rank, chrom, reverse, rs) AS r FROM t GROUP BY read),
  w AS (SELECT read, l, 1 AS i, r, true AS ok FROM a JOIN b USING (read) WHERE len(l) = len(r) UNION ALL
    SELECT read, l, i + 1, CASE WHEN p IS NULL THEN r ELSE r[:p - 1] || r[p + 1:] END, ok AND p IS NOT NULL FROM (
      SELECT *, list_min([j FOR j IN range(1, len(r) + 1) IF r[j].chrom = l[i].chrom AND r[j].reverse = l[i].reverse AND abs(r[j].rs - l[i].rs) <= 100]) AS p FROM w WHERE i <= len(l))),
  m AS (SELECT read, ok AND len(r) = 0 AS ok FROM w WHERE i = len(l) + 1)
SELECT q.read, CASE WHEN l IS NULL AND r IS NULL THEN 'both_unmapped' WHEN l IS NULL THEN 'only_2_mapped' WHEN r IS NULL THEN 'only_1_mapped' WHEN l[1].chrom <> r[1].chrom THEN 'discordant_chrom' WHEN l[1].reverse <> r[1].reverse THEN 'discordant_strand'
  WHEN abs(l[1].rs - r[1].rs) > 100 THEN 'discordant_pos' WHEN len(l) <> len(r) THEN 'different_count' WHEN ok THEN 'concordant' ELSE 'partial_match' END AS category
FROM q LEFT JOIN a USING (read) LEFT JOIN b USING (read) LEFT JOIN m USING (read)"""
)
def matched_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine ways two aligners agree on a read, placements matched in any order."""
    lhs, rhs = _sides(spark, sf_dir)
    turned = F.when(F.col("read") % 3 == 0, F.when(F.col("rank") == 1, 1).otherwise(9 - F.col("rank"))).otherwise(F.col("rank"))
    return compare.concordance_any_order(lhs, rhs.withColumn("rank", turned), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read")))


_SPAN = "qs + CASE WHEN mapq % 3 = 0 THEN -20 ELSE 0 END"
_FLAGS = f"{_SPAN} AS a, qe AS b, mapq % 5 = 0 AS secondary, mapq % 5 <> 0 AND rank > 1 AS supplementary"


def _measure_sql(p: str, source: str) -> str:
    return f"""{p}r AS (SELECT *, {_FLAGS} FROM {source}), {sql_islands(f'{p}m', f'{p}r', 'read chrom reverse secondary', 'a', 'b')},
  {p}c AS (SELECT read, sum(e - s) FILTER (NOT secondary) AS pri, sum(e - s) FILTER (secondary) AS sec FROM {p}m GROUP BY read),
  {p}n AS (SELECT read, max(read_len) AS len, count(*) FILTER (NOT secondary) AS np, count(*) FILTER (secondary) AS ns, coalesce(max(mapq) FILTER (NOT secondary), 0) AS mapq, coalesce(min(chrom) FILTER (NOT secondary AND NOT supplementary), '.') AS chrom FROM {p}r GROUP BY read),
  {p} AS (SELECT * FROM {p}n LEFT JOIN {p}c USING (read))"""


def _share_sql(name: str, x: str, xs: str, y: str, ys: str) -> str:
    return f"{name} AS (SELECT read, sum(least(x.e, y.e) - greatest(x.s, y.s)) AS n FROM {x}m x JOIN {y}m y USING (read, chrom, reverse) WHERE {xs} x.secondary AND {ys} y.secondary AND x.s < y.e AND y.s < x.e GROUP BY read)"


_SIDE = ", ".join(f"coalesce({p}.np, 0) AS {p}_n_primary, coalesce({p}.ns, 0) AS {p}_n_secondary, round(coalesce({p}.pri, 0) / n, 6) AS {p}_primary_frac, round(coalesce({p}.sec, 0) / n, 6) AS {p}_secondary_frac, CAST(coalesce({p}.mapq, 0) AS BIGINT) AS {p}_mapq, coalesce({p}.chrom, '.') AS {p}_chrom" for p in "ab")


@query(
    f"""WITH {LHS}, {RHS}, {_measure_sql('a', 'lhs')}, {_measure_sql('b', 'rhs')}, {_share_sql('pp', 'a', 'NOT', 'b', 'NOT')}, {_share_sql('ps', 'a', 'NOT', 'b', '')}, {_share_sql('sp', 'b', 'NOT', 'a', '')}
SELECT read, n AS read_len, {_SIDE}, round(coalesce(pp.n / nullif(a.pri, 0), 0), 6) AS a_in_b_primary, round(coalesce(pp.n / nullif(b.pri, 0), 0), 6) AS b_in_a_primary, round(coalesce(ps.n / nullif(a.pri, 0), 0), 6) AS a_in_b_secondary, round(coalesce(sp.n / nullif(b.pri, 0), 0), 6) AS b_in_a_secondary
FROM (SELECT coalesce(a.read, b.read) AS read, coalesce(a.len, b.len) AS n FROM a FULL JOIN b ON a.read = b.read) x LEFT JOIN a USING (read) LEFT JOIN b USING (read) LEFT JOIN pp USING (read) LEFT JOIN ps USING (read) LEFT JOIN sp USING (read)""".replace(", n AS read_len", ", x.n AS read_len").replace(" / n, 6)", " / x.n, 6)")
)
def read_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two aligners cover each read, and how much of either's primary placement the other shares."""
    flagged = [s.withColumns({"qs": F.expr(_SPAN), "secondary": F.col("mapq") % 5 == 0, "supplementary": (F.col("mapq") % 5 != 0) & (F.col("rank") > 1)}) for s in _sides(spark, sf_dir)]
    found = compare.interval_measures(*flagged)
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if c.endswith("_mapq") else F.col(c) for c, t in found.dtypes))


#: One record a read; the second side stops at the first mismatch from the read's left end in some, and lies a little or far off in others.
_MATCH = "cast(l_quantity as bigint)"
_SKIP = f"case when l_partkey % 3 <> 0 then 0 when l_linestatus = 'F' then 6 when {_MATCH} <= 12 then {_MATCH} + 1 else 2 end"
_FAR = "case when l_partkey % 7 = 1 then 60 when l_partkey % 11 = 1 then 500 else 0 end"
_ONE = ALIGNMENT | {"read": "l_orderkey * 8 + l_linenumber", "cigar": f"concat(l_linenumber, 'S', {LEN}, '=', l_suppkey % 8 + 1, 'X', {LEN} + 3, '=', l_suppkey % 9 + 1, 'I', {LEN}, '=', l_partkey % 40 + 1, 'D', 5, '=', l_linenumber + 1, 'H')"}
_TWO = _ONE | {"qs": f"{_ONE['qs']} + ({_SKIP})", "rs": f"{_ONE['rs']} + (case when l_linestatus = 'F' then 0 else {_SKIP} end) + ({_FAR})", "re": f"{_ONE['re']} - (case when l_linestatus = 'F' then {_SKIP} else 0 end) + ({_FAR})", "skip": _SKIP, "far": _FAR}


@query(
    f"""WITH l AS (SELECT {columns(_ONE)}, l_quantity AS n, l_suppkey, l_partkey FROM {LINES} WHERE {FIRST_WHERE}), r AS (SELECT {columns(_TWO)} FROM {LINES} WHERE {OTHER_WHERE}),
  j AS (SELECT coalesce(l.read, r.read) AS read, l.read IS NOT NULL AS a, r.read IS NOT NULL AS b, skip, far, CASE WHEN l.reverse THEN skip BETWEEN 5 AND 5 + l_partkey % 40 + 1 ELSE skip BETWEEN CAST(n AS BIGINT) AND CAST(n AS BIGINT) + l_suppkey % 8 + 1 END AS at_mismatch FROM l FULL JOIN r ON l.read = r.read)
SELECT read, CASE WHEN NOT b THEN 'lhs' WHEN NOT a THEN 'rhs' WHEN skip = 0 AND far = 0 THEN 'agree' WHEN far = 0 AND skip <= 15 AND at_mismatch OR skip = 0 AND far <> 0 THEN 'clip' WHEN far + skip <= 100 THEN 'ends' ELSE 'both' END AS state, CAST(a AS BIGINT) AS lhs_n, CAST(b AS BIGINT) AS rhs_n FROM j"""
)
def outer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides' reads of one record each: on one side only, agreeing, clipped differently, ending differently, or apart.

    Records whose read ranges are equal have no end that differs on the read, so they count as clipped alike, wherever they lie.
    """
    side = lambda spec, where: lines(spark, sf_dir).where(where).selectExpr(*(f"{e} AS {n}" for n, e in spec.items()))
    return compare.outer_states(side(_ONE, FIRST_WHERE), side(_TWO, OTHER_WHERE))


@query("WITH c AS (SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN -1 ELSE (o_custkey << 33) | ((o_orderkey % 2) << 32) | (o_orderkey * 7) END AS code FROM orders) SELECT o_orderkey, code, CASE WHEN code >= 0 THEN xor(code, 4294967296) ELSE code END AS flipped, CASE WHEN code >= 0 THEN code >> 33 END AS target, CASE WHEN code >= 0 THEN (code >> 32) & 1 = 1 END AS reverse, CASE WHEN code >= 0 THEN code & 4294967295 END AS pos FROM c")
def position_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as one long each, flipped to the other strand and read back."""
    code = F.when(F.col("o_custkey") % 13 == 0, F.lit(-1).cast("long")).otherwise(scalars.position_code(F.col("o_custkey"), F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") * 7))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).withColumn("d", scalars.position_decode(F.col("code")))
    return rows.select("o_orderkey", "code", scalars.position_flip(F.col("code")).alias("flipped"), "d.target", "d.reverse", "d.pos")


_DIV = "CAST(l_partkey % 90 AS DOUBLE)"


@query(
    f"""WITH t AS (SELECT l_orderkey AS read, l_linenumber AS k, l_suppkey % 60 AS qs, l_suppkey % 60 + {LEN} AS qe, {_DIV} AS divergence FROM {LINES}), f AS (SELECT * FROM t WHERE k = 1), o AS (SELECT * FROM t WHERE k > 1 AND qe > qs),
  m AS (SELECT f.read, sum(o.divergence * (least(f.qe, o.qe) - greatest(f.qs, o.qs)) / (o.qe - o.qs)) AS d, sum(least(f.qe, o.qe) - greatest(f.qs, o.qs)) AS c FROM f JOIN o ON f.read = o.read AND o.qs < f.qe AND f.qs < o.qe GROUP BY f.read)
SELECT read, CAST(CASE WHEN qe > qs THEN floor(least(60.0::DOUBLE, greatest(0.0::DOUBLE, (coalesce(d, 0) + greatest(qe - qs - coalesce(c, 0), 0) - divergence) * 10 / ln(10.0::DOUBLE))) + 0.5) ELSE 0 END AS INTEGER) AS mapq FROM f LEFT JOIN m USING (read)"""
)
def divergence_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping quality of each order's first line as a segment, the others being its rivals."""
    rows = lines(spark, sf_dir).selectExpr("l_orderkey AS read", "l_linenumber AS k", "l_suppkey % 60 AS qs", f"l_suppkey % 60 + {LEN} AS qe", "cast(l_partkey % 90 as double) AS divergence")
    return filters.mapq_by_divergence(rows.where("k = 1"), rows.where("k > 1"))


@query(
    f"""WITH t AS (SELECT l_orderkey AS read, l_linenumber AS part, l_suppkey % 2 AS grp, l_linenumber * 60 AS qs, l_linenumber * 60 + {LEN} + 20 AS qe, ({LEN} + 20) * (l_partkey % 10) // 10 AS matches FROM {LINES}), l AS (SELECT *, o_custkey % 600 + 1 AS length FROM t JOIN orders ON o_orderkey = read WHERE qe - qs >= 50),
  g AS (SELECT read, grp FROM l GROUP BY read, grp HAVING sum(qe - qs) / max(length) >= 0.1 AND sum(matches) / sum(qe - qs) >= 0.5)
SELECT read, part, grp FROM l SEMI JOIN g USING (read, grp)"""
)
def accepted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of groups that cover a tenth of the read, half of it matching."""
    rows = lines(spark, sf_dir).selectExpr("l_orderkey AS read", "l_linenumber AS part", "l_suppkey % 2 AS grp", "l_linenumber * 60 AS qs", f"l_linenumber * 60 + {LEN} + 20 AS qe", f"({LEN} + 20) * (l_partkey % 10) div 10 AS matches")
    lengths = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read"), (F.col("o_custkey") % 600 + 1).alias("length"))
    return filters.accepted(rows, lengths, "read", "grp").select("read", "part", "grp")
