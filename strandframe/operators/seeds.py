"""Seed indexes as tables: building, lookup, frequency routing, bands, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import revcomp_kmer
from ..session import prepare


def build_index(found: DataFrame, chrom: str = "chrom", most: int | None = None) -> DataFrame:
    """``kmer, chrom, ref_pos, n_hits``: one row a locus, with the number of loci of its k-mer.

    K-mers with more than ``most`` loci are left out by their counts, before any locus is joined.
    """
    counts = found.groupBy("kmer").agg(F.count("*").alias("n_hits"))
    counts = counts if most is None else counts.where(F.col("n_hits") <= most)
    return found.select("kmer", F.col(chrom).alias("chrom"), F.col("pos").alias("ref_pos")).join(counts, "kmer")


def both_strands(index: DataFrame, k: int) -> DataFrame:
    """``index`` with ``reverse``: each locus also under its reverse complement, so one pass over a read's k-mers serves both strands."""
    turned = index.withColumns({"kmer": revcomp_kmer(F.col("kmer"), k), "reverse": F.lit(True)})
    return index.withColumn("reverse", F.lit(False)).unionByName(turned)


def lookup(reads: DataFrame, index: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Read k-mers joined to their loci. Frequent k-mers are dropped before the join, so they never fan out."""
    held = index if max_hits is None else index.where(F.col("n_hits") <= max_hits)
    return reads.join(held, "kmer")


def local_multiplicity(hits: DataFrame, read: str) -> DataFrame:
    """Adds ``kmer_multiplicity``: the hits of the k-mer within its read and strand."""
    return hits.withColumn("kmer_multiplicity", F.count("*").over(Window.partitionBy(read, "strand", "kmer")))


def route(index: DataFrame, middle: int, most: int) -> DataFrame:
    """Adds ``tier``: direct up to ``middle`` loci (or up to ``most`` if middle is 0), deferred up to ``most``, dropped beyond."""
    n = F.col("n_hits")
    return index.withColumn("tier", F.when(n > most, "dropped").when((n <= middle) | F.lit(middle == 0), "direct").otherwise("deferred"))


#: Seeds of whole bands that are summed together.
GATHERED = 1 << 16


def _runs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Numbers of the runs of equal keys in a sorted batch; nulls are equal."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return np.cumsum(np.concatenate(([False], new)))[: batch.num_rows]


def _anchors(run: np.ndarray, diagonal: np.ndarray, width: int) -> np.ndarray:
    """Where the bands of sorted runs begin: a band of every run is found at a time, by bisection."""
    if not len(run):
        return run
    span = int(diagonal.max()) - int(diagonal.min()) + width + 1
    if span * (int(run[-1] - run[0]) + 1) >= 1 << 62:  # too wide to number places of all runs: half of them at a time
        half = int(np.searchsorted(run, run[len(run) // 2])) or int(np.searchsorted(run, run[0], side="right"))
        if half == len(run):
            raise OverflowError("diagonals of a key that lie 2^61 apart")
        return np.concatenate([_anchors(run[:half], diagonal[:half], width), half + _anchors(run[half:], diagonal[half:], width)])
    place = (run - run[0]) * span + (diagonal - diagonal.min())
    at, found = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0))), []
    while len(at):
        found.append(at)
        after = np.searchsorted(place, place[at] + width)
        inside = after < len(run)
        at, after = at[inside], after[inside]
        at = after[run[after] == run[at]]
    return np.sort(np.concatenate(found))


def _by_diagonal(seeds: DataFrame, keys: list[str]) -> DataFrame:
    prepare(seeds.sparkSession)
    return seeds.withColumn("diagonal", F.col("diagonal").cast("long")).repartition(*keys).sortWithinPartitions(*keys, "diagonal")


def _banded(batches: Iterator[pa.RecordBatch], keys: list[str], width: int) -> Iterator[pa.RecordBatch]:
    """Adds ``band`` to batches sorted by key and diagonal."""
    held, first = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        diagonal, run = batch.column("diagonal").to_numpy(), _runs(batch, keys)
        lead = 0  # rows that still belong to the last band
        if held == [batch.column(k)[0].as_py() for k in keys]:
            lead = int(np.searchsorted(diagonal[: np.searchsorted(run, 0, side="right")], first + width))
        at = lead + _anchors(run[lead:], diagonal[lead:], width)
        band = np.full(len(run), first, np.int64)
        band[lead:] = diagonal[at][np.searchsorted(at, np.arange(lead, len(run)), side="right") - 1]
        held, first = [batch.column(k)[-1].as_py() for k in keys], int(band[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band)], names=[*batch.schema.names, "band"])


def _schema(seeds: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {seeds.schema[c].dataType.simpleString()}, " for c in names)


def in_bands(seeds: DataFrame, keys: list[str], width: int = 800) -> DataFrame:
    """Adds ``band`` to ``seeds (*keys, diagonal, ...)``: the diagonal of the first seed of its band.

    In order of diagonals a seed joins the band while it lies within ``width`` of the band's first seed. The anchor is
    the first seed, not the one before, so bands follow one another: a key's seeds are sorted in one task and pass by,
    a batch at a time.
    """
    rows = _by_diagonal(seeds, keys)
    return rows.mapInArrow(lambda batches: _banded(batches, keys, width), f"{_schema(rows, rows.columns)}band long")


def bands(seeds: DataFrame, keys: list[str], width: int = 800) -> DataFrame:
    """``*keys, low, high, n, weight, mean, variance`` of the diagonal bands of ``seeds (*keys, diagonal, weight)``; the variance is 1 at the least."""
    w, d = F.col("weight"), F.col("diagonal").cast("double")
    sums = in_bands(seeds, keys, width).groupBy(*keys, "band").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.count("*").alias("n"), F.sum(w).alias("weight"), F.sum(w * d).alias("_wd"), F.sum(w * d * d).alias("_wdd"))
    mean = F.col("_wd") / F.col("weight")
    return sums.select(*keys, "low", "high", "n", "weight", mean.alias("mean"), F.greatest(F.lit(1.0), F.col("_wdd") / F.col("weight") - mean * mean).alias("variance"))


def band_coverage(seeds: DataFrame, keys: list[str], lengths: DataFrame, read: str, width: int = 800, least: float | None = None) -> DataFrame:
    """``*keys, band, low, high, n, weight, covered, coverage``: of each band the read's bases that its seeds cover, and their share of the read.

    ``seeds (*keys, diagonal, weight, read_start, read_end)``, ``lengths (read, length)``; ``least`` keeps the bands that
    cover so much. Seeds are exchanged and sorted once; a task holds a batch, one band and ``GATHERED`` seeds of others.
    """
    names = ["diagonal", "weight", "read_start", "read_end"]
    rows = _by_diagonal(seeds.select(*keys, "diagonal", F.col("weight").cast("double").alias("weight"), *(F.col(c).cast("long").alias(c) for c in names[2:])), keys)

    def sums_of(table: pa.RecordBatch, run: np.ndarray) -> pa.RecordBatch:
        first = np.searchsorted(run, np.arange(run[-1] + 1))
        diagonal, start, end = (table.column(c).to_numpy() for c in ("diagonal", "read_start", "read_end"))
        low = min(int(start.min()), int(end.min()))
        far = (max(int(start.max()), int(end.max())) - low + 1) * run  # keeps the running end of one band out of the next
        order = np.lexsort((end, start, run))
        start, end = (start - low + far)[order], (end - low + far)[order]
        fresh = np.concatenate(([True], start[1:] > np.maximum.accumulate(end)[:-1])) | np.isin(np.arange(len(run)), first)
        island = np.flatnonzero(fresh)
        covered = np.add.reduceat(np.maximum.reduceat(end, island) - start[island], np.searchsorted(island, first))
        known = ~table.column("weight").is_null().to_numpy(zero_copy_only=False)
        weight = np.add.reduceat(table.column("weight").fill_null(0).to_numpy(zero_copy_only=False), first)
        n, last, at = np.diff(np.append(first, len(run))), np.append(first[1:], len(run)) - 1, pa.array(first)
        numbers = [pa.array(diagonal[first]), pa.array(diagonal[last]), pa.array(n), pa.array(weight, mask=np.add.reduceat(known.astype(np.int64), first) == 0), pa.array(covered)]
        return pa.RecordBatch.from_arrays([*(table.column(k).take(at) for k in [*keys, "band"]), *numbers], names=[*keys, "band", "low", "high", "n", "weight", "covered"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wanted = [], 0, GATHERED
        for batch in _banded(batches, keys, width):
            held.append(batch)
            size += batch.num_rows
            if size < wanted:
                continue
            table = pa.concat_batches(held)
            run = _runs(table, [*keys, "band"])
            done = int(np.searchsorted(run, run[-1]))  # the last band may go on
            if done:
                yield sums_of(table.slice(0, done), run[:done])
            held, size = [table.slice(done)], table.num_rows - done
            wanted = max(GATHERED, 2 * size)
        if size:
            table = pa.concat_batches(held)
            yield sums_of(table, _runs(table, [*keys, "band"]))

    sums = rows.mapInArrow(cover, f"{_schema(rows, keys)}band long, low long, high long, n long, weight double, covered long")
    out = sums.join(lengths.select(read, "length"), read).withColumn("coverage", F.when(F.col("length") > 0, F.col("covered") / F.col("length")).otherwise(F.lit(0.0))).drop("length")
    return out if least is None else out.where(F.col("coverage") >= least)


def select_reads(hits: DataFrame, regions: DataFrame, read: str, max_hits: int = 10, least: float = 2.0, width: int = 1000) -> DataFrame:
    """Reads with a region and strand whose rare hits weigh ``least`` or more, each hit 1 / its loci."""
    from .intervals import contains_point

    inside = contains_point(hits.where(F.col("n_hits") <= max_hits), regions, ["chrom"], "ref_pos", width)
    weight = inside.groupBy(read, "strand", "chrom", "start", "end").agg(F.sum(1 / F.col("n_hits")).alias("w"))
    return weight.where(F.col("w") >= least).select(read).distinct()
