"""Queries of chained seeds: filters, cut overlaps, chains by count of breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..operators import chain_programs, chaining, seed_filters, seeds
from ..session import materialize
from .inputs import LINES, lines
from .registry import query
from .rescue import _HITS, PRUNE_K, _hits

#: A chain for each supplier: its order lines by number, places and noise by part.
SEED = {
    "read": "l_suppkey",
    "step": "l_orderkey * 10 + l_linenumber",
    "chrom": "cast((l_orderkey div 400) % 3 as bigint)",
    "reverse": "(l_orderkey div 400) % 2 = 1",
    "read_start": "(l_orderkey * 10 + l_linenumber) * 3",
    "read_end": "(l_orderkey * 10 + l_linenumber) * 3 + 15 + l_partkey % 70",
    "diagonal": "case when l_partkey % 17 = 0 then 3000 else 0 end + (l_partkey * 13) % 60 * (case when l_partkey % 5 = 0 then 4 else 1 end)",
    "weight": "cast(l_quantity as double) * (l_partkey % 9 + 1)",
    "frequency": "cast(l_partkey % 6 + 1 as bigint)",
}
_REF = "case when reverse then diagonal - read_end else diagonal + read_start end"
THRESHOLD, SEED_BRIDGE = 100, 1000
_SQL = f"""q AS (SELECT {", ".join(f"{e.replace(' div ', ' // ')} AS {n}" for n, e in SEED.items())} FROM {LINES}), p AS (SELECT *, {_REF} AS ref_start FROM q),
  t AS (SELECT *, CASE WHEN lag(step) OVER w IS NULL THEN 0 WHEN abs(diagonal - lag(diagonal) OVER w) > {SEED_BRIDGE} OR chrom <> lag(chrom) OVER w OR reverse <> lag(reverse) OVER w THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY read ORDER BY step)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY read ORDER BY step) AS segment, row_number() OVER (PARTITION BY read ORDER BY step) AS i FROM t)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in SEED.items())).withColumn("ref_start", F.expr(_REF))


def _flags(spark: SparkSession, sf_dir: str, find: seed_filters.Filter) -> DataFrame:
    return find(seed_filters.chained(_seeds(spark, sf_dir), bridge=SEED_BRIDGE)).select("read", "step", F.col("segment").cast("long").alias("segment"), "flag")


def _flag_sql(flag: str, more: str = "") -> str:
    return f"WITH {_SQL}{more} SELECT read, step, CAST(segment AS BIGINT) AS segment, {flag} AS flag FROM s"


@query(
    f"""WITH {_SQL}, u AS (SELECT *, abs(lag(diagonal) OVER w - diagonal) AS a, abs(lead(diagonal) OVER w - diagonal) AS b FROM s WINDOW w AS (PARTITION BY read, segment ORDER BY step))
SELECT read, step, CAST(segment AS BIGINT) AS segment, coalesce(a IS NOT NULL AND b IS NOT NULL AND weight / frequency < 50 AND greatest(a, b) > {THRESHOLD}, false) AS flag FROM u"""
)
def frequent_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light seeds of frequent k-mers beside a step of the diagonal."""
    return _flags(spark, sf_dir, lambda s: seed_filters.frequent(s, THRESHOLD))


@query(
    f"""WITH {_SQL}, c AS (SELECT *, sum(weight) OVER (PARTITION BY read, segment ORDER BY diagonal, step ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY read, segment) AS whole, count(*) OVER (PARTITION BY read, segment) AS n FROM s),
  m AS (SELECT *, min(CASE WHEN upto * 2 >= whole THEN diagonal END) OVER (PARTITION BY read, segment) AS median FROM c),
  k AS (SELECT read, segment, min(step) AS a, max(step) AS b FROM m WHERE abs(diagonal - median) <= {THRESHOLD} GROUP BY read, segment)
SELECT m.read, m.step, CAST(m.segment AS BIGINT) AS segment, n >= 3 AND (step < a OR step > b) AS flag FROM m JOIN k ON m.read = k.read AND m.segment = k.segment"""
)
def terminal_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of segments that stray from the weighted median diagonal."""
    return _flags(spark, sf_dir, lambda s: seed_filters.terminal(s, THRESHOLD))


@query(_flag_sql("count(*) OVER (PARTITION BY read, segment) = 1 AND read_end - read_start < 75"))
def short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one short seed."""
    return _flags(spark, sf_dir, seed_filters.short_alone)


@query(
    f"""WITH RECURSIVE {_SQL}, g AS (SELECT read, segment, count(*) AS n, arg_min(read_start, step) AS fs, arg_min(read_end, step) AS fe, arg_min(ref_start, step) AS fr, arg_max(read_start, step) AS ls, arg_max(read_end, step) AS le, arg_max(ref_start, step) AS lr FROM s GROUP BY read, segment),
  h AS (SELECT read, segment, le, n <= 3 AND greatest(fr + fe - fs, lr + le - ls) - least(fr, lr) <= 100 AS small, lead(fs) OVER w AS ns, lead(fe) OVER w AS ne FROM g WINDOW w AS (PARTITION BY read ORDER BY segment)),
  f AS (SELECT read, segment, le AS reach, false AS gone FROM h WHERE segment = 0 UNION ALL
    SELECT h.read, h.segment, CASE WHEN o THEN f.reach ELSE h.le END, o FROM f JOIN (SELECT * FROM h) h ON f.read = h.read AND h.segment = f.segment + 1,
      LATERAL (SELECT coalesce(small AND ns IS NOT NULL AND greatest(f.reach - ns, 0) <= 50 AND greatest(f.reach - ns, 0) < ne - ns, false) AS o))
SELECT s.read, s.step, CAST(s.segment AS BIGINT) AS segment, f.gone AS flag FROM s JOIN f ON s.read = f.read AND s.segment = f.segment"""
)
def excursion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small segments between two breaks whose flanks could be joined."""
    return _flags(spark, sf_dir, seed_filters.excursion_segments)


@query(
    f"""WITH RECURSIVE {_SQL}, f AS (
  SELECT read, i, reverse, segment, read_start AS q0, read_end AS q1, ref_start AS r, CAST(NULL AS BIGINT) AS pi, CAST(NULL AS BIGINT) AS p0, CAST(NULL AS BIGINT) AS p1, CAST(NULL AS BIGINT) AS pr FROM s WHERE i = 1
  UNION ALL
  SELECT read, i, reverse, segment, q0 + y2, q1, r + CASE WHEN reverse THEN 0 ELSE y2 END, i - 1, p0, p1 - x2, pr + CASE WHEN prev THEN x2 ELSE 0 END FROM (
    SELECT *, greatest(0, least(o2, p1 - p0)) AS x2, greatest(0, least(o2 - greatest(0, least(o2, p1 - p0)), q1 - q0)) AS y2 FROM (
      SELECT *, CASE WHEN NOT same THEN 0 WHEN prev THEN r + q1 - q0 - pr ELSE pr + p1 - p0 - r END AS o2 FROM (
        SELECT read, i, reverse, prev, segment, same, q0 + y AS q0, q1, r + CASE WHEN reverse THEN 0 ELSE y END AS r, p0, p1 - x AS p1, pr + CASE WHEN prev THEN x ELSE 0 END AS pr FROM (
          SELECT *, greatest(0, least(o, p1 - p0)) AS x, greatest(0, least(o - greatest(0, least(o, p1 - p0)), q1 - q0)) AS y FROM (
            SELECT s.read, s.i, s.reverse, f.reverse AS prev, s.segment, s.segment = f.segment AS same, s.read_start AS q0, s.read_end AS q1, s.ref_start AS r, f.q0 AS p0, f.q1 AS p1, f.r AS pr, f.q1 - s.read_start AS o
            FROM f JOIN s ON s.read = f.read AND s.i = f.i + 1))))))
SELECT s.read, s.step, CAST(coalesce(n.p0, f.q0) AS BIGINT) AS read_start, CAST(coalesce(n.p1, f.q1) AS BIGINT) AS read_end, CAST(coalesce(n.pr, f.r) AS BIGINT) AS ref_start
FROM f JOIN s ON s.read = f.read AND s.i = f.i LEFT JOIN f n ON n.read = f.read AND n.pi = f.i"""
)
def trimmed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of every chain cut until none overlaps the next, on the read and within segments on the reference."""
    return seed_filters.trimmed(_seeds(spark, sf_dir), bridge=SEED_BRIDGE).select("read", "step", "read_start", "read_end", "ref_start")


@query()
def pruned_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains after the repetitive prune, which goes on until nothing changes; held against a loop in plain Python in the tests."""
    return seed_filters.prune_repetitive(_seeds(spark, sf_dir), THRESHOLD, bridge=SEED_BRIDGE).select("read", "step", "read_start", "read_end", "ref_start", F.col("segment").cast("long").alias("segment"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of every document with what their bases weigh: less for k-mers of many loci."""
    runs = chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K)
    return runs.select(F.col("read_id").alias("read"), "chrom", "reverse", "diagonal", "read_start", "read_end", ((F.col("read_end") - F.col("read_start")) / F.sqrt("multiplicity")).alias("weight"))


@query()
def break_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best chain, the k-th break costing k times the first; held against all chains in the tests."""
    return chain_programs.chain_by_breaks(_weighted(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query()
def component_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chains, component by component; held against all chains in the tests."""
    return chain_programs.chain_components(_weighted(spark, sf_dir), scheme=chain_programs.SegmentScheme.for_k(PRUNE_K)).withColumn("score", F.round("score", 4))


@query()
def band_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chains around its heaviest diagonal band."""
    found = materialize(_weighted(spark, sf_dir), "weighted")
    bands = seeds.bands(found, ["read", "chrom", "reverse"], 800)
    heaviest = bands.groupBy("read").agg(F.max(F.struct("weight", "chrom", "reverse", "low", "mean", "variance")).alias("b"))
    picked = heaviest.select("read", F.col("b.chrom").alias("band_chrom"), F.col("b.reverse").alias("band_reverse"), F.col("b.mean").alias("center"), F.col("b.variance").alias("variance"))
    return chain_programs.chain_band(found, picked).withColumn("score", F.round("score", 4))


#: Seeds of a read that overlap on it: neighbours by start, whatever their place; atoms are the hits, weighing less the more loci.
_SPLITS = f"""{_HITS.replace("d.pos + " + str(PRUNE_K) + " AS read_end", "d.pos + " + str(PRUNE_K) + " AS read_end, 1 / sqrt(n_hits::DOUBLE) AS weight")}, t AS (SELECT *, CASE WHEN read_start > max(read_end) OVER (PARTITION BY read_id, chrom, reverse, diagonal ORDER BY read_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM h),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, chrom, reverse, diagonal ORDER BY read_start ROWS UNBOUNDED PRECEDING) AS island FROM t),
  s AS (SELECT read_id, chrom, reverse, diagonal, island, min(read_start) AS f, max(read_end) AS u FROM g GROUP BY ALL),
  q AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY f, u, chrom, reverse, diagonal) AS i FROM s),
  a AS (SELECT q.read_id, q.i, g.read_start AS b, g.read_end AS e, g.weight FROM g JOIN q USING (read_id, chrom, reverse, diagonal, island)),
  p AS (SELECT l.read_id, l.i, l.f AS lf, l.u AS lu, r.f AS rf, r.u AS ru FROM q l JOIN q r ON l.read_id = r.read_id AND r.i = l.i + 1 AND r.f < l.u),
  c AS (SELECT DISTINCT p.*, a.e AS x FROM p JOIN a ON a.read_id = p.read_id AND a.i = p.i AND a.e > p.rf UNION SELECT p.*, a.b FROM p JOIN a ON a.read_id = p.read_id AND a.i = p.i + 1 AND a.b < p.lu),
  z AS (SELECT *, coalesce((SELECT sum(weight) FROM a WHERE a.read_id = c.read_id AND a.i = c.i AND a.e > c.x), 0) + coalesce((SELECT sum(weight) FROM a WHERE a.read_id = c.read_id AND a.i = c.i + 1 AND a.b < c.x), 0) AS cost FROM c),
  m AS (SELECT read_id, i, lu, rf, min({{'c': round(cost, 6), 'x': x}}) AS m FROM z GROUP BY read_id, i, lu, rf)"""


@query(
    f"""WITH {_SPLITS} SELECT m.read_id, CAST(m.i AS BIGINT) AS pair, CAST(m.m.x AS BIGINT) AS split, m.m.c AS trimmed,
  CAST(coalesce((SELECT max(e) FROM a WHERE a.read_id = m.read_id AND a.i = m.i AND a.e <= m.m.x), lu) AS BIGINT) AS left_end, CAST(coalesce((SELECT min(b) FROM a WHERE a.read_id = m.read_id AND a.i = m.i + 1 AND a.b >= m.m.x), rf) AS BIGINT) AS right_start FROM m"""
)
def overlap_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where neighbouring seeds of a document that overlap on it part best."""
    found = _hits(spark, sf_dir)
    diagonal = F.when(F.col("reverse"), F.col("ref_pos") + F.col("read_pos")).otherwise(F.col("ref_pos") - F.col("read_pos"))
    place = ["read_id", "chrom", "reverse", "diagonal"]
    hits = found.select("read_id", "chrom", "reverse", diagonal.alias("diagonal"), F.col("read_pos").alias("start"), (F.col("read_pos") + PRUNE_K).alias("end"), (1 / F.sqrt(F.col("n_hits").cast("double"))).alias("weight"))
    w = Window.partitionBy(*place).orderBy("start")
    fresh = (F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    hits = materialize(hits.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))), "islands")
    runs = hits.groupBy(*place, "island").agg(F.min("start").alias("f"), F.max("end").alias("u"))
    numbered = materialize(runs.withColumn("pair", F.row_number().over(Window.partitionBy("read_id").orderBy("f", "u", *place[1:])).cast("long")), "numbered")
    # only seeds that overlap a neighbour are split, so only their hits are
    w = Window.partitionBy("read_id").orderBy("pair")
    met = (F.lead("f").over(w) < F.col("u")) | (F.col("f") < F.lag("u").over(w))
    atoms = hits.join(numbered.withColumn("met", met).where("met"), [*place, "island"]).select(F.struct("read_id", "pair").alias("seed"), "start", "end", "weight")
    pairs = numbered.select("read_id", "pair", F.struct("read_id", "pair").alias("left"), F.struct("read_id", (F.col("pair") + 1).alias("pair")).alias("right"))
    # costs to six digits, so that sums of equal weights are equal
    return chain_programs.split_overlaps(pairs, materialize(atoms.withColumn("weight", F.round("weight", 9)), "atoms"), ["read_id", "pair"]).withColumn("trimmed", F.round("trimmed", 6))
