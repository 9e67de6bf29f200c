"""Queries of the report metrics, each over a summary made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..session import table
from .registry import query


def _table(spark: SparkSession, sf_dir: str, name: str, spec: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {n}" for n, e in spec.items()))


def _columns(spec: dict[str, str]) -> str:
    return ", ".join(f"{e.replace(' div ', ' // ')} AS {n}" for n, e in spec.items())


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("value", F.round("value", 6))


def _unpivot(metrics: dict[str, str], source: str, stratum: str = "'all'") -> str:
    """Rows ``key, metric, stratum, value`` of the named expressions, those without a value left out."""
    listed = ", ".join(f"{{'m': '{n}', 'v': CAST({e} AS DOUBLE)}}" for n, e in metrics.items())
    return f"SELECT key, u.r.m AS metric, stratum, round(u.r.v, 6) AS value FROM (SELECT *, {stratum} AS stratum FROM {source}) z, unnest([{listed}]) AS u(r) WHERE u.r.v IS NOT NULL AND NOT isnan(u.r.v)"


def _r(a: str, b: str, by: str = "") -> str:
    return f"{by}(CAST({a} AS DOUBLE) / nullif({b}, 0))"


READS = {
    "key": "o_orderstatus", "read_len": "o_custkey % 900 + 100", "mapped": "o_orderkey % 7 <> 0", "aligned_union": "case when o_orderkey % 7 <> 0 then o_custkey % 900 div 2 else 0 end", "aligned_sum": "case when o_orderkey % 7 <> 0 then o_custkey % 900 div 2 + o_orderkey % 30 else 0 end",
    "interior_gap": "o_orderkey % 40", "clip5": "o_orderkey % 13", "clip3": "o_orderkey % 11", "n_primary": "1", "n_supplementary": "case when o_orderkey % 5 = 0 then 2 else 0 end", "n_secondary": "o_orderkey % 3", "n_outlier_windows": "case when o_orderkey % 9 = 0 then 1 else 0 end", "split_events": "o_orderkey % 4",
}


@query(
    f"WITH t AS (SELECT {_columns(READS)} FROM orders), s AS (SELECT key, count(*) AS n, sum(read_len) AS len, count(*) FILTER (mapped) AS o, sum(aligned_union) AS u, sum(aligned_sum) AS s, sum(interior_gap) AS g, coalesce(sum(clip5 + clip3) FILTER (mapped), 0) AS c, coalesce(sum(n_primary + n_supplementary) FILTER (mapped), 0) AS a, count(*) FILTER (mapped AND n_supplementary > 0) AS sp, coalesce(sum(n_secondary) FILTER (mapped), 0) AS sec, sum(n_outlier_windows) AS w, count(*) FILTER (mapped AND n_outlier_windows > 0) AS rw, sum(split_events) AS e FROM t GROUP BY key) "
    + _unpivot({
        "reads": "n", "read_bases": "len", "frac_reads_mapped": _r("o", "n"), "frac_bases_aligned": _r("u", "len"), "frac_bases_multiply_aligned": _r("s - u", "len"), "frac_bases_interior_gap": _r("g", "len"), "frac_bases_end_clipped": _r("c", "len"), "alignments_per_mapped_read": _r("a", "o"),
        "frac_mapped_reads_split": _r("sp", "o"), "secondary_per_mapped_read": _r("sec", "o"), "outlier_windows_per_Mb_aligned": _r("w", "u", "1000000 * "), "frac_reads_with_outlier_window": _r("rw", "o"), "split_indels_per_Mb_aligned": _r("e", "u", "1000000 * "),
    }, "s")
)
def report_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report.read_metrics(_table(spark, sf_dir, "orders", READS)))


CLASSES = {"key": "l_linestatus", "class": "case when l_linenumber = 1 then 'primary' when l_linenumber < 5 then 'supplementary' else 'secondary' end", "qs": "l_suppkey % 50", "qe": "l_suppkey % 50 + cast(l_quantity as bigint) * 3", "mapq": "l_partkey % 61"}


@query(
    f"""WITH t AS (SELECT {_columns(CLASSES)} FROM lineitem), s AS (SELECT key, class, count(*) AS n, median(qe - qs) AS m, avg(mapq) AS q FROM t GROUP BY key, class)
SELECT key, class || u.r.m AS metric, 'all' AS stratum, round(u.r.v, 6) AS value FROM s, unnest([{{'m': '_count', 'v': CAST(n AS DOUBLE)}}, {{'m': '_median_qlen', 'v': CAST(m AS DOUBLE)}}, {{'m': '_mean_mapq', 'v': q}}]) AS u(r)"""
)
def report_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report.class_metrics(_table(spark, sf_dir, "lineitem", CLASSES)))


INDELS = CLASSES | {"kind": "case when l_partkey % 2 = 0 then 'ins' else 'del' end", "band": "power(2, l_suppkey % 9)", "source": "case when l_suppkey % 3 = 0 then 'split' else 'cigar' end", "events": "cast(l_quantity as bigint)"}


@query(
    f"""WITH t AS (SELECT {_columns(INDELS)} FROM lineitem), b AS (SELECT key, sum(qe - qs) AS bases FROM t WHERE class <> 'secondary' GROUP BY key),
  s AS (SELECT key, {", ".join(f"coalesce(sum(events) FILTER (class <> 'secondary' AND kind = '{k}' AND {w}), 0) AS {k}_{n}" for k in ("ins", "del") for n, w in (("l", "band >= 64"), ("p", "band >= 64 AND source = 'split'"), ("s", "band < 4")))} FROM t GROUP BY key), j AS (SELECT * FROM s JOIN b USING (key)) """
    + _unpivot({n: e for k in ("ins", "del") for n, e in ((f"{k}_ge64_per_Mb", _r(f"{k}_l", "bases", "1000000 * ")), (f"{k}_ge64_frac_as_split", _r(f"{k}_p", f"{k}_l")), (f"{k}_lt4_per_kb", _r(f"{k}_s", "bases", "1000 * ")))}, "j")
)
def report_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem", INDELS)
    aligned = rows.where("class <> 'secondary'").groupBy("key").agg(F.sum(F.col("qe") - F.col("qs")).alias("bases"))
    return _shown(report.indel_metrics(rows, aligned))


ERRORS = {"key": "l_linestatus", "end_kind": "case l_partkey % 3 when 0 then 'clip' when 1 then 'split' else 'end' end", "dist_bin": "power(2, (l_partkey + l_suppkey) % 13)", "positions": "cast(l_quantity as bigint) * 10", "mismatches": "l_partkey % 4", "ins_events": "l_partkey % 3", "del_events": "l_suppkey % 2"}


@query(
    f"""WITH t AS (SELECT *, mismatches + ins_events + del_events AS bad FROM (SELECT {_columns(ERRORS)} FROM lineitem)), b AS (SELECT key, CAST(sum(bad) FILTER (dist_bin >= 1024) AS DOUBLE) / nullif(sum(positions) FILTER (dist_bin >= 1024), 0) AS base FROM t GROUP BY key),
  n AS (SELECT key, end_kind, CAST(sum(bad) AS DOUBLE) / nullif(sum(positions), 0) AS near FROM t WHERE dist_bin < 32 GROUP BY key, end_kind), j AS (SELECT * FROM n JOIN b USING (key))
SELECT key, 'error_rate_interior' AS metric, 'all' AS stratum, round(base, 6) AS value FROM b WHERE base IS NOT NULL UNION ALL SELECT key, 'error_rate_within32_' || end_kind, 'all', round(near, 6) FROM j UNION ALL SELECT key, 'error_excess_within32_' || end_kind, 'all', round(near / base, 6) FROM j WHERE base <> 0"""
)
def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report.error_metrics(_table(spark, sf_dir, "lineitem", ERRORS)))


INVARIANCE = {"key": "o_orderstatus", "variant": "case when o_orderkey % 2 = 0 then 'frag1000' else 'revcomp' end", "class": "case o_custkey % 4 when 0 then 'agree' when 1 then 'partial' when 2 then 'disagree_confident' else 'unaligned' end", "score": "case when o_custkey % 4 = 3 then null else (o_custkey % 100) / 100.0 end", "stratum": "case when o_orderkey % 3 = 0 then 'repeat' else 'unique' end"}


@query(
    f"""WITH t AS (SELECT {_columns(INVARIANCE)} FROM orders), a AS (SELECT key, variant, count(*) AS n, avg(score) AS m FROM t GROUP BY key, variant), c AS (SELECT key, variant, class, count(*) AS k FROM t GROUP BY key, variant, class), f AS (SELECT key, variant, stratum, count(*) AS n, count(*) FILTER (class = 'agree') AS g, count(*) FILTER (class = 'disagree_confident') AS d FROM t WHERE variant LIKE 'frag%' GROUP BY key, variant, stratum)
SELECT key, variant || '_frac_' || class AS metric, 'all' AS stratum, round(CAST(k AS DOUBLE) / n, 6) AS value FROM c JOIN a USING (key, variant) UNION ALL SELECT key, variant || '_mean_score', 'all', round(m, 6) FROM a
UNION ALL SELECT key, variant || '_frac_agree', stratum, round(CAST(g AS DOUBLE) / n, 6) FROM f UNION ALL SELECT key, variant || '_frac_disagree_confident', stratum, round(CAST(d AS DOUBLE) / n, 6) FROM f"""
)
def report_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report.invariance_metrics(_table(spark, sf_dir, "orders", INVARIANCE)))


PILEUP = {
    "key": "l_linestatus", "mapq_class": "case when l_partkey % 2 = 0 then 'all' else 'ge20' end", "stratum": "l_returnflag", "positions": "cast(l_quantity as bigint) * 7", "called_positions": "cast(l_quantity as bigint) * 5", "depth_sum": "cast(l_quantity as bigint) * 90 + l_suppkey % 7",
    "mismatch_sum": "l_partkey % 12", "del_sum": "l_partkey % 5", "ins_sum": "l_suppkey % 6", "candidate_sites": "l_suppkey % 4", "major_nonref": "l_suppkey % 2",
}


@query(
    f"WITH t AS (SELECT {_columns(PILEUP)} FROM lineitem), g AS (SELECT key, mapq_class, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS st, {', '.join(f'sum({n}) AS {n}' for n in list(PILEUP)[3:])} FROM t GROUP BY GROUPING SETS ((key, mapq_class), (key, mapq_class, stratum))) SELECT key, 'pileup_' || mapq_class || '_' || metric AS metric, stratum, value FROM ("
    + _unpivot({"mean_depth": _r("depth_sum", "positions"), "nonref_rate": _r("mismatch_sum + del_sum", "depth_sum"), "ins_rate": _r("ins_sum", "depth_sum"), "candidate_sites_per_Mb": _r("candidate_sites", "called_positions", "1000000 * "), "major_nonref_per_Mb": _r("major_nonref", "called_positions", "1000000 * "), "frac_called": _r("called_positions", "positions")}, "g", "st").replace("SELECT key, u.r.m", "SELECT key, mapq_class, u.r.m")
    + ")"
)
def report_pileups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report.pileup_metrics(_table(spark, sf_dir, "lineitem", PILEUP)))


DEPTHS = {"key": "l_linestatus", "bin": "l_suppkey % 40", "count": "cast(l_quantity as bigint)"}
WINDOWS = {"key": "l_linestatus", "positions": "l_partkey % 3", "depth": "cast(l_suppkey % 40 as double) + (case when l_partkey % 29 = 0 then 90 else 0 end)"}


@query(
    f"""WITH h AS (SELECT key, bin, sum(count) AS n FROM (SELECT {_columns(DEPTHS)} FROM lineitem) GROUP BY key, bin), c AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY key) AS total FROM h), m AS (SELECT key, min(bin) FILTER (upto * 2 >= total) AS med, max(total) AS total FROM c GROUP BY key),
  d AS (SELECT key, med, total, coalesce(sum(n) FILTER (bin = 0), 0) AS z, coalesce(sum(n) FILTER (bin < 0.2 * med), 0) AS l FROM h JOIN m USING (key) GROUP BY key, med, total), w AS (SELECT * FROM (SELECT {_columns(WINDOWS)} FROM lineitem) WHERE positions > 0), x AS (SELECT key, median(depth) AS med FROM w GROUP BY key),
  v AS (SELECT key, stddev(depth) AS sd, avg(depth) AS mean, count(*) AS n, count(*) FILTER (depth > 3 * med) AS hi, count(*) FILTER (depth < 0.2 * med) AS lo FROM w JOIN x USING (key) WHERE med > 0 GROUP BY key) """
    + _unpivot({"pileup_median_depth": "med", "pileup_frac_depth0": _r("z", "total"), "pileup_frac_depth_lt_0.2x_median": _r("l", "total")}, "d") + " UNION ALL " + _unpivot({"window_depth_cv": _r("sd", "mean"), "frac_windows_gt_3x_median": _r("hi", "n"), "frac_windows_lt_0.2x_median": _r("lo", "n")}, "v")
)
def report_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(report.depth_metrics(_table(spark, sf_dir, "lineitem", DEPTHS), _table(spark, sf_dir, "lineitem", WINDOWS)))
