"""Queries of seed rescue and of seeds without neighbours, on both strands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import chaining, intervals, isolation, rescue, seeds
from .inputs import SEQ, sequences
from .registry import query
from .seeds import sql_kmers

#: Short k-mers, so that the passages hold some of several loci; those of one locus are looked up directly.
RESCUE_K, DIRECT, MOST, SPACING = 10, 1, 500, 500
#: k-mers of the prunes.
PRUNE_K = 12


def _rescue_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    index = seeds.build_index(S.kmers(sequences(spark, sf_dir, "benchmark", "item_id"), "id", "seq", RESCUE_K), "id", MOST)
    docs = sequences(spark, sf_dir, "documents", "doc_id")
    kmers = S.kmers(docs, "id", "seq", RESCUE_K).select(F.col("id").alias("read"), "pos", "kmer")
    return kmers, docs.select(F.col("id").alias("read"), F.length("seq").alias("length")), seeds.both_strands(index, RESCUE_K)


def sql_index(k: int, most: int) -> str:
    """CTEs ``b`` and ``i (kmer, reverse, chrom, ref_pos, n_hits)``: the passages' k-mers on both strands."""
    return f"""{sql_kmers('b', 'benchmark', 'item_id', k)}, bn AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS n FROM b),
  i AS (SELECT kmer, false AS reverse, id AS chrom, pos AS ref_pos, n AS n_hits FROM bn WHERE n <= {most} UNION ALL SELECT reverse(translate(kmer, 'ACGT', 'TGCA')), true, id, pos, n FROM bn WHERE n <= {most})"""


_GAPS = f"""{sql_kmers('d', 'documents', 'doc_id', RESCUE_K)}, {sql_index(RESCUE_K, MOST)},
  direct AS (SELECT d.id AS read, d.pos, reverse, chrom, ref_pos, n_hits FROM d JOIN i USING (kmer) WHERE n_hits <= {DIRECT}),
  later AS (SELECT d.id AS read, d.pos, reverse, chrom, ref_pos, n_hits FROM d JOIN i USING (kmer) WHERE n_hits > {DIRECT}),
  f AS (SELECT read, pos, coalesce(max(pos + {RESCUE_K}) OVER (PARTITION BY read ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM (SELECT DISTINCT read, pos FROM direct)),
  gaps AS (SELECT read, reach AS s, pos AS e FROM f WHERE pos > reach UNION ALL
    SELECT l.read, coalesce(m, 0), n FROM (SELECT doc_id AS read, length({SEQ}) AS n FROM documents) l LEFT JOIN (SELECT read, max(pos + {RESCUE_K}) AS m FROM direct GROUP BY read) x ON l.read = x.read WHERE n > coalesce(m, 0))"""


@query(f'WITH {_GAPS} SELECT read AS read_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM gaps')
def uncovered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of every document without a direct hit, ends included."""
    kmers, lengths, index = _rescue_inputs(spark, sf_dir)
    hits = seeds.lookup(kmers, index, DIRECT).select("read", F.col("pos").alias("start"), (F.col("pos") + RESCUE_K).alias("end"))
    return intervals.uncovered(hits, lengths, ["read"], "length").withColumnRenamed("read", "read_id")


@query(
    f"""WITH RECURSIVE {_GAPS}, places AS (SELECT read, pos, min(n_hits) AS n FROM later GROUP BY read, pos),
  open AS (SELECT read, s, e FROM gaps WHERE e - s > {SPACING} UNION ALL
    SELECT read, u.x.s, u.x.e FROM (SELECT o.read, o.s, o.e, min({{'n': n, 'p': pos}}).p AS p FROM open o JOIN places ON places.read = o.read AND pos >= o.s AND pos + {RESCUE_K} <= o.e GROUP BY o.read, o.s, o.e) z,
      unnest([{{'s': s, 'e': p}}, {{'s': p + {RESCUE_K}, 'e': e}}]) AS u(x) WHERE u.x.e - u.x.s > {SPACING}),
  picked AS (SELECT o.read, min({{'n': n, 'p': pos}}).p AS pos FROM open o JOIN places ON places.read = o.read AND pos >= o.s AND pos + {RESCUE_K} <= o.e GROUP BY o.read, o.s, o.e),
  hits AS (SELECT *, false AS rescued FROM direct UNION ALL SELECT *, true FROM later SEMI JOIN picked USING (read, pos))
SELECT read AS read_id, CAST(pos AS BIGINT) AS read_pos, reverse, CAST(chrom AS BIGINT) AS chrom, CAST(ref_pos AS BIGINT) AS ref_pos, n_hits, rescued FROM hits"""
)
def rescued_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct seeds of every document and those rescued into its long gaps, in as many rounds as the gaps need."""
    kmers, lengths, index = _rescue_inputs(spark, sf_dir)
    found = rescue.rescue(kmers, lengths, index, "read", RESCUE_K, DIRECT, MOST, SPACING)
    return found.select(F.col("read").alias("read_id"), F.col("pos").alias("read_pos"), "reverse", "chrom", "ref_pos", "n_hits", "rescued")


@query(
    f"""WITH {_GAPS}, places AS (SELECT read, pos, min(n_hits) AS n FROM later GROUP BY read, pos)
SELECT g.read AS read_id, CAST(min({{'n': n, 'p': pos}}).p AS BIGINT) AS pos, CAST(min({{'n': n, 'p': pos}}).n AS BIGINT) AS n_hits FROM gaps g JOIN places ON places.read = g.read AND pos >= g.s AND pos + {RESCUE_K} <= g.e WHERE e - s > {SPACING} GROUP BY g.read, s, e"""
)
def rescue_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round: the rarest deferred place of each long gap."""
    kmers, lengths, index = _rescue_inputs(spark, sf_dir)
    routed = seeds.route(index, DIRECT, MOST)
    hits = seeds.lookup(kmers, routed.where("tier = 'direct'")).select("read", F.col("pos").alias("start"), (F.col("pos") + RESCUE_K).alias("end"))
    places = kmers.join(routed.where("tier = 'deferred'").select("kmer", "n_hits").distinct(), "kmer").groupBy("read", "pos").agg(F.min("n_hits").alias("n_hits"))
    picked = rescue.split_gaps(intervals.uncovered(hits, lengths, ["read"], "length"), places, ["read"], RESCUE_K, SPACING, rounds=1)
    return picked.withColumnRenamed("read", "read_id")


_HITS = f"""{sql_kmers('d', 'documents', 'doc_id', PRUNE_K)}, {sql_index(PRUNE_K, MOST)},
  h AS (SELECT d.id AS read_id, chrom, reverse, CASE WHEN reverse THEN ref_pos + d.pos ELSE ref_pos - d.pos END AS diagonal, d.pos AS read_start, d.pos + {PRUNE_K} AS read_end FROM d JOIN i USING (kmer))"""
_RUNS = f"""{_HITS}, t AS (SELECT *, CASE WHEN read_start > max(read_end) OVER (PARTITION BY read_id, chrom, reverse, diagonal ORDER BY read_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM h),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, chrom, reverse, diagonal ORDER BY read_start ROWS UNBOUNDED PRECEDING) AS island FROM t),
  s AS (SELECT read_id, chrom, reverse, diagonal, min(read_start) AS read_start, max(read_end) AS read_end FROM g GROUP BY read_id, chrom, reverse, diagonal, island)"""


def _sql_isolated(table_: str, rule: isolation.Rule) -> str:
    """``isolated`` by EXISTS, over the rows of ``table_``."""

    def neighbour(a: str, b: str) -> str:
        step = f"(CASE WHEN s.reverse THEN -1 ELSE 1 END * ({b}.diagonal - {a}.diagonal))"
        gap = f"greatest({b}.read_start - {a}.read_end, 0)"
        bounds = [f"{gap} + {step} >= {rule.low}" if rule.low is not None else "", f"{gap} + {step} <= {rule.high}" if rule.high is not None else "", f"abs({step}) <= {rule.shift}" if rule.shift is not None else ""]
        within = "(" + " AND ".join(x for x in bounds if x) + ")"
        within = f"({within} OR ({gap} + {step} < {rule.low} AND abs({step}) <= {rule.expansion}))" if rule.expansion is not None else within
        apart = f" AND ({b}.read_start >= {a}.read_end OR {step} = 0)" if rule.apart else ""
        first = f"({b}.read_start > {a}.read_start OR ({b}.read_start = {a}.read_start AND ({b}.read_end > {a}.read_end OR ({b}.read_end = {a}.read_end AND {b}.diagonal > {a}.diagonal))))"
        return f"({first} AND {b}.read_start - {a}.read_end <= {rule.read_gap} AND {a}.read_end < {b}.read_end AND {within}{apart})"

    long = f" AND s.read_end - s.read_start <= {rule.long}" if rule.long is not None else ""
    return f"""SELECT read_id, CAST(chrom AS BIGINT) AS chrom, reverse, CAST(diagonal AS BIGINT) AS diagonal, CAST(read_start AS BIGINT) AS read_start, CAST(read_end AS BIGINT) AS read_end,
  NOT EXISTS (SELECT 1 FROM {table_} n WHERE n.read_id = s.read_id AND n.chrom = s.chrom AND n.reverse = s.reverse AND ({neighbour('s', 'n')} OR {neighbour('n', 's')})){long} AS isolated FROM {table_} s"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = seeds.both_strands(seeds.build_index(S.kmers(sequences(spark, sf_dir, "benchmark", "item_id"), "id", "seq", PRUNE_K), "id", MOST), PRUNE_K)
    return seeds.lookup(S.kmers(sequences(spark, sf_dir, "documents", "doc_id"), "id", "seq", PRUNE_K).select(F.col("id").alias("read_id"), F.col("pos").alias("read_pos"), "kmer"), index)


COLUMNS = ["read_id", "chrom", "reverse", "diagonal", "read_start", "read_end", "isolated"]


@query(f"WITH {_RUNS} {_sql_isolated('s', isolation.BY_GAPS)}")
def isolated_by_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of 100 bases or less with no neighbour within 400 read and 800 reference bases."""
    return isolation.isolated(chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K), "read_id", isolation.BY_GAPS).select(*COLUMNS)


@query(f"WITH {_RUNS} {_sql_isolated('s', isolation.BY_DEVIATION)}")
def isolated_by_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with no neighbour within 1,000 read bases whose reference gap deviates by 1,000 at the most and overlaps by 10 at the most."""
    return isolation.isolated(chaining.compound_seeds(_hits(spark, sf_dir), PRUNE_K), "read_id", isolation.BY_DEVIATION).select(*COLUMNS)


@query(f"WITH {_HITS} {_sql_isolated('h', isolation.by_edge(expansion=300)).replace('FROM h s', 'FROM h AS s')}")
def isolated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single hits that no edge without a break joins to another."""
    found = _hits(spark, sf_dir)
    diagonal = F.when(F.col("reverse"), F.col("ref_pos") + F.col("read_pos")).otherwise(F.col("ref_pos") - F.col("read_pos"))
    hits = found.select("read_id", "chrom", "reverse", diagonal.alias("diagonal"), F.col("read_pos").alias("read_start"), (F.col("read_pos") + PRUNE_K).alias("read_end"))
    return isolation.isolated(hits, "read_id", isolation.by_edge(expansion=300)).select(*COLUMNS)
