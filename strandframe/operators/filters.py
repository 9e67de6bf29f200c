"""Filters of reads, seeds and chains, and the weights that they go by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare


def named(rows: DataFrame, names: DataFrame, key: str = "read") -> DataFrame:
    """Rows whose name is listed in the column ``key`` of ``names``; all of them if none is listed."""
    return rows if names.isEmpty() else rows.join(names.select(key).distinct(), key, "left_semi")


def comparable(a: Column, b: Column, least: float = 0.5) -> Column:
    """Whether the shorter of two lengths is ``least`` of the longer or more."""
    return (F.greatest(a, b) > 0) & (F.least(a, b) / F.greatest(a, b) >= least)


def usable(seq: Column, least: int = 20) -> Column:
    """Long enough, and without an N."""
    return (F.length(seq) >= least) & ~seq.rlike("[Nn]")


def excursions(seeds: DataFrame, keys: list[str], order: str, threshold: int) -> DataFrame:
    """Adds ``excursion``: a seed whose two neighbours of the same place lie more than ``threshold`` diagonals off, one to each side."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag("diagonal").over(w) - F.col("diagonal"), F.lead("diagonal").over(w) - F.col("diagonal")
    out = (F.abs(before) > threshold) & (F.abs(after) > threshold) & (F.signum(before.cast("double")) != F.signum(after.cast("double")))
    return seeds.withColumn("excursion", F.coalesce(out, F.lit(False)))


def segments(seeds: DataFrame, read: str, order: str, place: list[str], bridge: int) -> DataFrame:
    """Adds ``segment`` (from 0), a run of a read's seeds on one place whose diagonals step by ``bridge`` at the most, and ``alone``, a segment of one seed."""
    w = Window.partitionBy(read).orderBy(order)
    new = F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) > bridge
    for p in place:
        new = new | ~F.col(p).eqNullSafe(F.lag(p).over(w))
    rows = seeds.withColumn("_new", F.when(F.lag(order).over(w).isNull(), 0).otherwise(F.coalesce(new, F.lit(False)).cast("int")))
    rows = rows.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return rows.withColumn("alone", F.count("*").over(Window.partitionBy(read, "segment")) == 1)


def _pairs_near(rows: DataFrame, keys: list[str], value: str, reach: int, kept: list[str]) -> DataFrame:
    """Rows beside each other row of the key whose value is within ``reach``: ``n_*`` columns. Dealt to bins, so a hot key is spread."""
    here = F.floor(F.col(value) / max(reach, 1))
    other = rows.select(*(F.col(k).alias(f"n_{k}") for k in [*keys, value, *kept]), F.explode(F.sequence(here - 1, here + 1)).alias("_b"))
    same = F.col("_b") == here
    for k in keys:
        same = same & (F.col(k) == F.col(f"n_{k}"))
    return rows.join(other, same & (F.abs(F.col(value) - F.col(f"n_{value}")) <= reach)).drop("_b")


def collinear_weights(seeds: DataFrame, keys: list[str], reach: int = 50, kept: list[str] | None = None) -> DataFrame:
    """``*keys, diagonal, weight``: for each diagonal the sum of 1 / (1 + d * d) over the key's seeds at distance d, up to ``reach``.

    Equal diagonals are counted first, so the join is over different ones.
    """
    sums = seeds.groupBy(*keys, "diagonal").agg(F.count("*").alias("n"))
    d = (F.col("diagonal") - F.col("n_diagonal")).cast("double")
    return _pairs_near(sums, keys, "diagonal", reach, ["n"]).groupBy(*keys, "diagonal").agg(F.sum(F.col("n_n") / (1 + d * d)).alias("weight"))


def gaussian_support(chains: DataFrame, keys: list[str], sigma: float, cutoff: float = 4.0) -> DataFrame:
    """``*keys, diagonal, support``: the scores of the key's chains, each weighed by exp(-(d / sigma)**2 / 2) of its diagonal's distance, up to ``cutoff`` sigmas."""
    sums = chains.groupBy(*keys, "diagonal").agg(F.sum("score").alias("score"))
    d = (F.col("diagonal") - F.col("n_diagonal")) / F.lit(float(sigma))
    return _pairs_near(sums, keys, "diagonal", int(cutoff * sigma), ["score"]).groupBy(*keys, "diagonal").agg(F.sum(F.col("n_score") * F.exp(-d * d / 2)).alias("support"))


def runs_of(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run`` (from 0): rows in order, a new run where ``value`` changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    return rows.withColumn("_c", changed.cast("long")).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def best_schedules(start: np.ndarray, end: np.ndarray, weight: np.ndarray, overlap: int = 0, gap_cost: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """``best_schedule`` of many reads of equally many chains, a read a row: the scores, and the chains kept, in order, after as many -1 as chains are left out."""
    reads, n = start.shape
    row = np.arange(reads)
    order = np.lexsort((-start, end), axis=-1)
    start, end, weight = (np.take_along_axis(x, order, axis=1) for x in (start, end, weight))
    value, came = weight.astype(np.float64), np.full((reads, n), -1)
    for rank in range(1, n):
        s = start[:, rank, None]
        joined = np.where(end[:, :rank] <= s + overlap, value[:, :rank] + weight[:, rank, None] - gap_cost * np.maximum(0, s - end[:, :rank]), -np.inf)
        at = np.argmax(joined, axis=1)
        better = joined[row, at] > value[:, rank]
        came[better, rank] = at[better]
        value[better, rank] = joined[row, at][better]
    at = np.argmax(value, axis=1)
    top, picked = value[row, at], np.full((reads, n), -1)
    for place in range(n - 1, -1, -1):
        live = at >= 0
        picked[live, place] = order[row, at][live]
        at = np.where(live, came[row, at], -1)
    return top, picked


def best_schedule(start: np.ndarray, end: np.ndarray, weight: np.ndarray, overlap: int = 0, gap_cost: float = 0.0) -> tuple[float, list[int]]:
    """The chains that go together best: each begins ``overlap`` bases before the last one's end at the earliest; a gap costs by the base."""
    if not len(start):
        return 0.0, []
    top, picked = best_schedules(start[None], end[None], weight[None], overlap, gap_cost)
    return float(top[0]), picked[picked >= 0].tolist()


def schedule(chains: DataFrame, read: str = "read", overlap: int = 0, gap_cost: float = 0.0) -> DataFrame:
    """``read, chain, place, score``: the chains of each read that are kept, in order; ``chains (read, chain, start, end, score)``.

    Reads are dealt out and sorted, and those of a batch with equally many chains go through together. A read's
    chains are one task's, which its length and the seeds' limits bound.
    """
    prepare(chains.sparkSession)
    kind = chains.schema[read].dataType.simpleString()

    def first_rows(reads: pa.Array) -> np.ndarray:
        a, b = reads[1:], reads[:-1]
        new = pc.or_kleene(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        return np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1])

    def solve(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff([*first, rows.num_rows])
        columns = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "score")]
        kept, places, scores = [], [], []
        for n in np.unique(sizes):
            at = first[sizes == n][:, None] + np.arange(n)
            top, picked = best_schedules(*(c[at] for c in columns), overlap, gap_cost)
            held = picked >= 0
            kept.append(np.take_along_axis(at, np.where(held, picked, 0), axis=1)[held])
            places.append((np.cumsum(held, axis=1) - 1)[held])
            scores.append(np.broadcast_to(top[:, None], held.shape)[held])
        taken = pa.array(np.concatenate(kept))
        return pa.RecordBatch.from_arrays([rows.column("read").take(taken), rows.column("chain").take(taken), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(scores))], names=["read", "chain", "place", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last read, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.concat_batches([*held, batch])
            first = first_rows(whole.column("read"))
            if first[-1]:
                yield solve(whole.slice(0, first[-1]), first[:-1])
            held = [whole.slice(first[-1])]
        if held:
            yield solve(held[0], np.zeros(1, np.int64))

    rows = chains.select(F.col(read).alias("read"), F.col("chain").cast("long").alias("chain"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("score").cast("double").alias("score"))
    return rows.repartition("read").sortWithinPartitions("read", "chain", "start", "end", "score").mapInArrow(run, f"read {kind}, chain long, place int, score double")


def sample(rows: DataFrame, keys: list[str], n: int, by: Column) -> DataFrame:
    """``n`` rows of each key, those of least ``by`` (a hash of the row, so reruns agree); a sampling operator."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where(F.col("_r") <= n).drop("_r")


def accepted(segments: DataFrame, lengths: DataFrame, read: str = "read", group: str = "group", least_coverage: float = 0.1, least_identity: float = 0.5, least_length: int = 50) -> DataFrame:
    """Segments of the groups that explain a read well enough: ``segments (read, group, qs, qe, matches, ...)``, ``lengths (read, length)``.

    Segments of under ``least_length`` read bases go first; a group stays if what is left covers ``least_coverage`` of the
    read, and ``least_identity`` of the covered bases match.
    """
    long = segments.where(F.col("qe") - F.col("qs") >= least_length)
    sums = long.groupBy(read, group).agg(F.sum(F.col("qe") - F.col("qs")).alias("_n"), F.sum("matches").alias("_m")).join(lengths.select(read, F.col("length").alias("_length")), read)
    good = sums.where((F.col("_length") > 0) & (F.col("_n") / F.col("_length") >= least_coverage) & (F.col("_m") / F.col("_n") >= least_identity))
    return long.join(good.select(read, group), [read, group], "left_semi")


def mapq_by_divergence(first: DataFrame, others: DataFrame, read: str = "read") -> DataFrame:
    """``read, mapq`` from 0 to 60: how much more the alternatives diverge over the bases of a read's first segment.

    ``first (read, qs, qe, divergence)``, one row a read; ``others`` alike. An alternative's divergence counts by the share of it
    that overlaps; bases that none covers count as fully divergent. Only alternatives that overlap are joined.
    """
    a = first.select(read, F.col("qs").alias("_s"), F.col("qe").alias("_e"), F.col("divergence").alias("_d"))
    b = others.where("qe > qs")
    over = F.least("_e", "qe") - F.greatest("_s", "qs")
    met = a.join(b, read).where((F.col("qs") < F.col("_e")) & (F.col("_s") < F.col("qe")))
    sums = met.groupBy(read).agg(F.sum(F.col("divergence") * over / (F.col("qe") - F.col("qs"))).alias("_div"), F.sum(over).alias("_cov"))
    n = F.col("_e") - F.col("_s")
    more = F.coalesce("_div", F.lit(0.0)) + F.greatest(n - F.coalesce("_cov", F.lit(0)), F.lit(0)) - F.col("_d")
    quality = F.least(F.lit(60.0), F.greatest(F.lit(0.0), more * 10 / F.log(F.lit(10.0))))
    return a.join(sums, read, "left").select(read, F.when(n > 0, F.floor(quality + 0.5)).otherwise(0).cast("int").alias("mapq"))
