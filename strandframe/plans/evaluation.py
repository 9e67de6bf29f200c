"""Queries of the measures that walk CIGAR strings, over records of four shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .inputs import FIRST_WHERE, LINES, MOVED, OTHER_WHERE, columns, lines
from .registry import query

_Q = "cast(l_quantity as bigint)"
_LEAD = "(l_linenumber - 1) * 150"
_BODY = f"""case l_partkey % 4 when 0 then concat({_Q} + 150, '=', 1 + l_partkey % 3, 'X', 200, '=', 1 + l_partkey % 7, 'I', {_Q} + 60, '=')
  when 1 then concat({_Q} + 300, '=', l_partkey % 40 + 1, 'D', {_Q} + 100, '=') when 2 then concat({_Q} + 120, '=', {_Q}, 'X', 90, '=1D', 90, '=3I', {_Q}, '=') else concat({_Q} + 200, '=') end"""
_QUERY = f"(case l_partkey % 4 when 0 then 2 * {_Q} + 412 + l_partkey % 3 + l_partkey % 7 when 1 then 2 * {_Q} + 400 when 2 then 3 * {_Q} + 303 else {_Q} + 200 end)"
_SPAN = f"(case l_partkey % 4 when 0 then 2 * {_Q} + 411 + l_partkey % 3 when 1 then 2 * {_Q} + 401 + l_partkey % 40 when 2 then 3 * {_Q} + 301 else {_Q} + 200 end)"
_START = f"(case when l_linestatus = 'F' then 2000 - {_LEAD} - {_QUERY} else {_LEAD} end)"
#: Reads of 2,000 bases whose records begin with a soft clip or none and end with a hard one.
SHAPES = {
    "read": "l_orderkey", "rank": "cast(l_linenumber as bigint)", "chrom": "concat('chr', l_suppkey % 5)", "reverse": "l_linestatus = 'F'", "mapq": "l_partkey % 61 % 40",
    "read_len": "cast(2000 as bigint)", "rs": "cast((l_partkey * 7) % 10000 as bigint)", "re": f"cast((l_partkey * 7) % 10000 + {_SPAN} as bigint)",
    "qs": f"cast({_START} as bigint)", "qe": f"cast({_START} + {_QUERY} as bigint)",
    "cigar": f"concat(case when l_linenumber > 1 then concat({_LEAD}, 'S') else '' end, {_BODY}, 2000 - {_LEAD} - {_QUERY}, 'H')",
}
MOVES = SHAPES | {"rs": f"cast((l_partkey * 7) % 10000 + {MOVED} as bigint)", "re": f"cast((l_partkey * 7) % 10000 + {_SPAN} + {MOVED} as bigint)"}
#: The same records as those of the reads' reverse complements.
TURNED = MOVES | {"reverse": "l_linestatus <> 'F'"}


def _records(spark: SparkSession, sf_dir: str, spec: dict[str, str] = SHAPES, where: str = "true") -> DataFrame:
    return lines(spark, sf_dir).where(where).selectExpr(*(f"{e} AS {n}" for n, e in spec.items()))


def _cte(name: str, spec: dict[str, str] = SHAPES, where: str = "true") -> str:
    return f"{name} AS (SELECT {columns(spec)} FROM {LINES} WHERE {where})"


def _walk(source: str, out: str) -> str:
    """SQL of the operations of ``source`` with their offsets ``q`` and ``r``, by window sums."""
    parts = "regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')"
    sums = ", ".join(f"CAST(sum(CASE WHEN contains('{kinds}', op) THEN len ELSE 0 END) OVER w - CASE WHEN contains('{kinds}', op) THEN len ELSE 0 END AS BIGINT) AS {n}" for kinds, n in (("MIS=XH", "q"), ("MDN=X", "r")))
    return f"""{out}_t AS (SELECT *, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS i FROM {source}), {out}_s AS (SELECT *, part[-1] AS op, CAST(part[:-2] AS BIGINT) AS len FROM {out}_t),
  {out} AS (SELECT *, {sums} FROM {out}_s WINDOW w AS (PARTITION BY read, rank ORDER BY i))"""


_WINDOWS = f"""{_cte("rec")}, {_walk("rec", "st")},
  f AS (SELECT *, CASE WHEN op = 'D' THEN 0 ELSE len END AS n, CASE WHEN reverse THEN read_len - q - CASE WHEN op = 'D' THEN 0 ELSE len END ELSE q END AS f0 FROM st WHERE op IN ('=', 'X', 'I', 'D')),
  v AS (SELECT *, f0 + n AS f1, unnest(range(least(f0, read_len - 1) // 200, greatest(least(f0, read_len - 1) // 200, (f0 + n - 1) // 200) + 1)) AS win FROM f),
  o AS (SELECT *, CASE WHEN op = 'D' THEN 0 ELSE least(f1, (win + 1) * 200) - greatest(f0, win * 200) END AS b FROM v),
  w AS (SELECT read, win, sum(b) AS aligned, sum(CASE WHEN op = '=' THEN b ELSE 0 END) AS m, sum(CASE WHEN op IN ('X', 'I') THEN b WHEN op = 'D' THEN len ELSE 0 END) AS e FROM o GROUP BY read, win),
  ids AS (SELECT read, win, CAST(m AS DOUBLE) / CAST(m + e AS DOUBLE) AS identity FROM w WHERE 2 * aligned >= 200 AND m + e > 0)"""


@query(f"WITH {_WINDOWS} SELECT read, CAST(win AS BIGINT) AS win, round(identity, 6) AS identity FROM ids")
def identity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.identity_windows(_records(spark, sf_dir), 200).select("read", F.col("window").alias("win"), F.round("identity", 6).alias("identity"))


@query(
    f"""WITH {_WINDOWS}, c AS (SELECT read, median(identity) AS med FROM ids GROUP BY read HAVING count(*) >= 3), d AS (SELECT read, any_value(med) AS med, median(abs(identity - med)) AS mad FROM ids JOIN c USING (read) GROUP BY read)
SELECT read, CAST(win * 200 AS BIGINT) AS start, CAST(least(win * 200 + 200, 2000) AS BIGINT) AS "end", round(identity, 6) AS identity, round(med, 6) AS median FROM ids JOIN d USING (read) WHERE identity < med - greatest(5.0::DOUBLE * 1.4826::DOUBLE * mad, 0.05::DOUBLE)"""
)
def identity_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.outlier_windows(_records(spark, sf_dir), 200)
    return found.select("read", "start", "end", F.round("identity", 6).alias("identity"), F.round("median", 6).alias("median"))


_BIN = "CASE WHEN {n} < 1 THEN 0 ELSE CAST(1 << (length(bin({n})) - 1) AS BIGINT) END"
_KIND = "CASE WHEN {clip} < 50 THEN 'read_end' WHEN EXISTS (SELECT 1 FROM rec x WHERE x.read = rec.read AND (x.qs, x.qe) <> (rec.qs, rec.qe) AND (abs(x.qs - {at}) < 50 OR abs(x.qe - {at}) < 50)) THEN 'junction' ELSE 'clipped' END"


@query(
    f"""WITH {_cte("rec")}, ends AS (SELECT *, CASE WHEN reverse THEN read_len - qe ELSE qs END AS a0, CASE WHEN reverse THEN read_len - qs ELSE qe END AS a1,
    CASE WHEN reverse THEN {_KIND.format(clip="read_len - qe", at="rec.qe")} ELSE {_KIND.format(clip="qs", at="rec.qs")} END AS k0, CASE WHEN reverse THEN {_KIND.format(clip="qs", at="rec.qs")} ELSE {_KIND.format(clip="read_len - qe", at="rec.qe")} END AS k1 FROM rec),
  d AS (SELECT k0 AS end_kind, unnest(range(0, (a1 - a0 - 1) // 2 + 1)) AS dist FROM ends UNION ALL SELECT k1, unnest(range(0, a1 - a0 - 2 - (a1 - a0 - 1) // 2 + 1)) FROM ends),
  {_walk("ends", "st")}, e AS (SELECT *, unnest(CASE WHEN op = 'X' THEN range(q, q + len) ELSE [q] END) AS pt FROM st WHERE op IN ('X', 'I', 'D')),
  n AS (SELECT CASE WHEN pt - a0 <= a1 - 1 - pt THEN k0 ELSE k1 END AS end_kind, least(pt - a0, a1 - 1 - pt) AS dist, op FROM e),
  u AS (SELECT end_kind, dist, 'P' AS op FROM d UNION ALL SELECT * FROM n)
SELECT end_kind, {_BIN.format(n="dist")} AS bin, count(*) FILTER (op = 'P') AS positions, count(*) FILTER (op = 'X') AS mismatches, count(*) FILTER (op = 'I') AS ins_events, count(*) FILTER (op = 'D') AS del_events FROM u GROUP BY ALL"""
)
def error_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_by_distance(_records(spark, sf_dir))


def _lift(source: str, out: str, flip: bool = False) -> str:
    turned = "NOT reverse" if flip else "reverse"
    return f"""{_walk(source, out + "w")}, {out}f AS (SELECT *, {turned} AS turn, CASE WHEN {turned} THEN read_len - q - len ELSE q END AS f0 FROM {out}w WHERE op IN ('M', '=', 'X')),
  {out}p AS (SELECT *, unnest(range(CAST((f0 + 24) // 25 * 25 AS BIGINT), CAST(f0 + len AS BIGINT), 25)) AS t FROM {out}f),
  {out} AS (SELECT read, t, arg_min(chrom || CASE WHEN turn THEN '-' ELSE '+' END || (rs + r + CASE WHEN turn THEN read_len - 1 - t ELSE t END - q), rank) AS code FROM {out}p GROUP BY read, t)"""


@query(f"WITH {_cte('rec')}, {_lift('rec', 'a')} SELECT read, CAST(t AS BIGINT) AS t, code FROM a")
def lifted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the CIGAR strings place every 25th base of the reads."""
    code = F.concat("chrom", F.when(F.col("reverse"), "-").otherwise("+"), F.col("pos").cast("string"))
    return evaluation.lifted(_records(spark, sf_dir)).select("read", "t", code.alias("code"))


@query(
    f"""WITH {_cte("lhs", where=FIRST_WHERE)}, {_cte("rhs", TURNED, OTHER_WHERE)}, {_lift("lhs", "a")}, {_lift("rhs", "b", True)},
  m AS (SELECT read, count(*) FILTER (a.code = b.code) AS agree, count(*) AS either FROM a FULL JOIN b USING (read, t) GROUP BY read),
  n AS (SELECT read, coalesce(agree, 0) AS agree, coalesce(either, 0) AS either, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM m FULL JOIN (SELECT read, count(*) AS x FROM lhs GROUP BY read) USING (read) FULL JOIN (SELECT read, count(*) AS y FROM rhs GROUP BY read) USING (read))
SELECT read, CASE WHEN y = 0 THEN 'orig_only' WHEN x = 0 THEN 'variant_only' WHEN either = 0 THEN 'disjoint' WHEN agree = either AND x = y THEN 'identical' WHEN agree / either >= 0.95 THEN 'near' WHEN agree > 0 THEN 'partial' ELSE 'disjoint' END AS class, CASE WHEN either > 0 THEN round(agree / either, 4) END AS score FROM n"""
)
def flipped_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads against the records of their reverse complements, by positions that the CIGAR strings place."""
    return evaluation.flipped_invariance(_records(spark, sf_dir, where=FIRST_WHERE), _records(spark, sf_dir, TURNED, OTHER_WHERE))


_SIDES = f"{_cte('lhs', where=FIRST_WHERE)}, {_cte('rhs', MOVES, OTHER_WHERE)}"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _records(spark, sf_dir, where=FIRST_WHERE), _records(spark, sf_dir, MOVES, OTHER_WHERE)


_LINE = "(SELECT read, chrom, reverse, qs, qe, CASE WHEN reverse THEN -sl ELSE sl END AS m, CASE WHEN reverse THEN re + sl * qs ELSE rs - sl * qs END AS c FROM (SELECT *, CAST(re - rs AS DOUBLE) / greatest(1, qe - qs) AS sl FROM {side}))"
_MERGED = """{name}f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY read ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT read, s, e FROM {source})),
  {name}g AS (SELECT *, sum(fresh) OVER (PARTITION BY read ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}f), {name} AS (SELECT read, CAST(round_even(sum(n), 0) AS BIGINT) AS bp FROM (SELECT read, max(e) - min(s) AS n FROM {name}g GROUP BY read, island) GROUP BY read)"""


@query(
    f"""WITH {_SIDES}, p AS (SELECT a.read, CAST(greatest(a.qs, b.qs) AS DOUBLE) AS lo, CAST(least(a.qe, b.qe) AS DOUBLE) AS hi, a.m - b.m AS dm, a.c - b.c AS dc FROM {_LINE.format(side="lhs")} a JOIN {_LINE.format(side="rhs")} b ON a.read = b.read AND a.chrom = b.chrom AND a.reverse = b.reverse),
  i AS (SELECT read, lo AS s, hi AS e FROM p WHERE lo < hi AND abs(dm) < 1e-12 AND abs(dc) <= 50 UNION ALL SELECT read, greatest(lo, least((-50 - dc) / dm, (50 - dc) / dm)), least(hi, greatest((-50 - dc) / dm, (50 - dc) / dm)) FROM p WHERE lo < hi AND abs(dm) >= 1e-12),
  k AS (SELECT * FROM i WHERE s < e), q AS (SELECT read, qs AS s, qe AS e FROM lhs UNION ALL SELECT read, qs, qe FROM rhs), {_MERGED.format(name="x", source="k")}, {_MERGED.format(name="y", source="q")}
SELECT y.read, coalesce(x.bp, 0) AS agree_bp, y.bp - coalesce(x.bp, 0) AS differ_bp FROM y LEFT JOIN x ON x.read = y.read"""
)
def base_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.base_agreement(*_sides(spark, sf_dir))


def _area(source: str, keys: str, out: str) -> str:
    """SQL of the covered area: the plane cut along both axes, and the cells that lie in any box."""
    plane = f"{keys}, chrom, reverse"
    cut = lambda a, b, n: f"{out}{n} AS (SELECT *, lead(v) OVER (PARTITION BY {plane} ORDER BY v) AS w FROM (SELECT {plane}, {a} AS v FROM {source} UNION SELECT {plane}, {b} FROM {source}))"
    return f"""{cut("qs", "qe", "c")}, {cut("rs", "re", "d")}, {out}e AS (SELECT DISTINCT {plane}, c.v AS q0, c.w AS q1, d.v AS r0, d.w AS r1 FROM {source} s JOIN {out}c c USING ({plane}) JOIN {out}d d USING ({plane}) WHERE qs <= c.v AND c.w <= qe AND rs <= d.v AND d.w <= re),
  {out} AS (SELECT {keys}, sum((q1 - q0) * (r1 - r0)) AS area FROM {out}e GROUP BY {keys})"""


@query(f"WITH {_SIDES}, u AS (SELECT *, 0 AS side FROM lhs UNION ALL SELECT *, 1 FROM rhs), {_area('u', 'read, side', 'a')}, {_area('u', 'read', 'b')} SELECT b.read, round((sum(a.area) - any_value(b.area)) / any_value(b.area), 6) AS jaccard FROM a JOIN b USING (read) GROUP BY b.read")
def box_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.box_jaccard(*_sides(spark, sf_dir)).select("read", F.round("jaccard", 6).alias("jaccard"))


def _sum(kinds: str) -> str:
    return f"coalesce(list_sum([CAST(x[:-2] AS BIGINT) FOR x IN regexp_extract_all(cigar, '[0-9]+[{kinds}]')]), 0)"


_RATES = "[('aligned_query_bases', q, 1), ('identity', m, m + x + ib + db), ('gap_compressed_identity', m, m + x + ie + de), ('mismatches_per_kb', 1000 * x, q), ('ins_events_per_kb', 1000 * ie, q), ('del_events_per_kb', 1000 * de, q), ('primary_frac_mapq0', p0, p), ('primary_frac_mapq_ge20', p20, p)]"


@query(
    f"""WITH {_cte("rec")}, b AS (SELECT chrom, CASE WHEN reverse THEN 'rev' ELSE 'fwd' END AS stratum, qe - qs AS q, {_sum("=")} AS m, {_sum("X")} AS x, {_sum("I")} AS ib, {_sum("D")} AS db, len(regexp_extract_all(cigar, '[0-9]+I')) AS ie, len(regexp_extract_all(cigar, '[0-9]+D')) AS de, rank = 1 AS prim, mapq FROM rec),
  g AS (SELECT chrom AS key, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, sum(q) AS q, sum(m) AS m, sum(x) AS x, sum(ib) AS ib, sum(db) AS db, sum(ie) AS ie, sum(de) AS de, count(*) FILTER (prim) AS p, count(*) FILTER (prim AND mapq = 0) AS p0, count(*) FILTER (prim AND mapq >= 20) AS p20 FROM b GROUP BY GROUPING SETS ((chrom), (chrom, stratum))),
  u AS (SELECT key, stratum, unnest([{{'metric': r[1], 'a': r[2], 'b': r[3]}} FOR r IN {_RATES}]) AS r FROM g)
SELECT key, stratum, r.metric AS metric, CASE WHEN r.b > 0 THEN round(CAST(r.a AS DOUBLE) / CAST(r.b AS DOUBLE), 6) END AS value FROM u"""
)
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumns({"stratum": F.when(F.col("reverse"), "rev").otherwise("fwd"), "primary": F.col("rank") == 1})
    return evaluation.alignment_report(rows, "chrom", "stratum")
