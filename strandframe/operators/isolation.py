"""Seeds without a collinear neighbour, found in one pass over the sorted seeds of a place."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare


@dataclass(frozen=True)
class Rule:
    """When of two seeds of one place, in read order, each is the other's neighbour.

    ``read_gap``: read bases between them at the most; with g the bases between (none if they overlap) and s the
    step of the diagonal, the gap on the reference is g + s, which lies from ``low`` to ``high``, and s within ``shift``.
    Bounds that are None do not count. A gap under ``low`` is a repeat's expansion if s is within ``expansion``. With
    ``apart`` seeds that overlap on the read must share the diagonal. Seeds longer than ``long`` stay without a neighbour.
    """

    read_gap: int
    low: int | None = None
    high: int | None = None
    shift: int | None = None
    long: int | None = None
    expansion: int | None = None
    apart: bool = False


#: The three prunes' bounds.
BY_GAPS = Rule(read_gap=400, low=-800, high=800, long=100)
BY_DEVIATION = Rule(read_gap=1000, low=-10, shift=1000)


def by_edge(deviation: int = 1000, tolerance: int = 10, expansion: int | None = None) -> Rule:
    """The prune of single hits: neighbours are those whose step chaining would not call a break."""
    return Rule(read_gap=deviation, low=-tolerance, shift=deviation, expansion=expansion, apart=True)


#: Rows of whole places that are compared together.
GATHERED = 1 << 16


def _joined(of: np.ndarray, sign: np.ndarray, diagonal: np.ndarray, start: np.ndarray, end: np.ndarray, rule: Rule) -> np.ndarray:
    """Which seeds have a neighbour; ``of`` numbers places, seeds are sorted by place, start, end and diagonal.

    Each seed meets the next one, then the one after, while they lie within the rule's read gap.
    """
    kept = np.zeros(len(start), bool)
    last = np.searchsorted(of, of, side="right")  # the first seed of the next place
    a, away = np.arange(len(start)), 0
    while len(a):
        away += 1
        a = a[a + away < last[a]]
        a = a[start[a + away] - end[a] <= rule.read_gap]
        i = a[~(kept[a] & kept[a + away])]
        b = i + away
        gap, step = np.maximum(start[b] - end[i], 0), sign[i] * (diagonal[b] - diagonal[i])
        near = end[i] < end[b]
        within = np.ones(len(i), bool)
        if rule.low is not None:
            within &= gap + step >= rule.low
        if rule.high is not None:
            within &= gap + step <= rule.high
        if rule.shift is not None:
            within &= np.abs(step) <= rule.shift
        if rule.expansion is not None:
            within |= (gap + step < rule.low) & (np.abs(step) <= rule.expansion)
        near &= within
        if rule.apart:
            near &= (start[b] >= end[i]) | (step == 0)
        kept[i[near]] = kept[b[near]] = True
    return kept


def isolated(seeds: DataFrame, read: str, rule: Rule) -> DataFrame:
    """Adds ``isolated`` to ``seeds (read, chrom, reverse, diagonal, read_start, read_end, ...)``.

    A seed is isolated if no other of its read, chromosome and strand follows or precedes it by the rule. One
    that another covers to its end is no neighbour of that one. Equal seeds count as one, and one without a
    diagonal, start or end has no neighbour. Seeds are dealt out by read, chromosome and strand and come sorted; each
    meets those behind it within the read gap, those of a batch together. A task holds one such place beside
    ``GATHERED`` rows.
    """
    prepare(seeds.sparkSession)
    place, spot = [read, "chrom", "reverse"], ["read_start", "read_end", "diagonal"]

    def places(rows: pa.Table) -> np.ndarray:
        fresh = np.zeros(rows.num_rows, bool)
        for c in place:
            codes = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(fresh)

    def solve(rows: pa.Table, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        there = np.ones(rows.num_rows, bool)
        for c in spot:
            there &= rows.column(c).is_valid().to_numpy()
        start, end, diagonal = (rows.column(c).cast(pa.int64()).fill_null(0).to_numpy()[there] for c in spot)
        sign = np.where(rows.column("reverse").fill_null(False).to_numpy()[there], -1, 1)
        kept = np.zeros(rows.num_rows, bool)
        kept[there] = _joined(of[there], sign, diagonal, start, end, rule)
        yield from rows.append_column("_kept", pa.array(kept)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        enough = GATHERED
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < enough:
                continue
            rows = pa.Table.from_batches(held)
            of = places(rows)
            cut = int(np.searchsorted(of, of[-1]))  # the last place may go on
            if cut:
                yield from solve(rows.slice(0, cut), of[:cut])
            held = rows.slice(cut).to_batches()
            enough = max(GATHERED, 2 * (rows.num_rows - cut))
        if held:
            rows = pa.Table.from_batches(held)
            yield from solve(rows, places(rows))

    dealt = seeds.repartition(*place).sortWithinPartitions(*place, *spot)
    found = dealt.mapInArrow(run, T.StructType([*seeds.schema.fields, T.StructField("_kept", T.BooleanType())]))
    alone = ~F.col("_kept")
    if rule.long is not None:
        alone = alone & (F.col("read_end") - F.col("read_start") <= rule.long)
    return found.withColumn("isolated", alone).drop("_kept")
