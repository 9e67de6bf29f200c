"""Chaining programs over a read's seeds: by count of breaks, and chain after chain from the components of reachable seeds.

Seeds are ``read, chrom, reverse, diagonal, read_start, read_end, weight``. Reads are dealt out by key and come
sorted, a read at a time; within a read one vector operation steps from all earlier seeds to the next. A task
holds a read's seeds, which the index's frequency limit and the read's length bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import prepare

Seeds = dict[str, np.ndarray]
COLUMNS = {"chrom": "long", "reverse": "boolean", "diagonal": "long", "read_start": "long", "read_end": "long", "weight": "double"}
#: Kinds of a step.
CONTINUATION, REPEAT, BREAK = 0, 1, 2
KINDS = ("continuation", "repeat", "break")


def piecewise(x: np.ndarray, base: float, steps: tuple[tuple[float, float], ...]) -> np.ndarray:
    """A cost whose slope grows by the second number of each step beyond its first; none for what is not positive."""
    x = np.maximum(x, 0.0)
    return base * x + sum(more * np.maximum(x - at, 0.0) for at, more in steps)


@dataclass(frozen=True)
class Gaps:
    """Steps from seeds ``j`` to seed ``i``: bases between them on read and reference once overlaps are cut, what the cut costs, and whether they can follow each other at all."""

    read: np.ndarray
    shift: np.ndarray
    same: np.ndarray
    cut: np.ndarray
    ok: np.ndarray

    @classmethod
    def between(cls, s: Seeds, j: np.ndarray, i: int) -> Gaps:
        """An overlap on the read is taken off the seed that weighs less a base. A seed of the same place that ends no further than ``j`` cannot follow it."""
        raw = s["read_start"][i] - s["read_end"][j]
        over = np.maximum(-raw, 0)
        same = (s["chrom"][j] == s["chrom"][i]) & (s["reverse"][j] == s["reverse"][i])
        length = s["read_end"] - s["read_start"]
        thin, thin_i = (s["weight"][x] / np.maximum(length[x], 1) for x in (j, i))
        shift = np.where(s["reverse"][i], -1, 1) * (s["diagonal"][i] - s["diagonal"][j])
        ok = np.where(same, over < length[i], over < np.minimum(length[i], length[j]))
        return cls(np.maximum(raw, 0), shift, same, over * np.minimum(thin, thin_i), ok)


@dataclass(frozen=True)
class BreakScheme:
    """Costs of steps where the k-th break costs k times ``penalty``."""

    penalty: float = 6.0
    repeat: float = 4.0
    repeat_window: int = 400
    most_deviation: float = 1000.0
    tolerance: int = 10
    read_gap: tuple[float, tuple[tuple[float, float], ...]] = (0.02, ((15.0, 0.03), (60.0, 0.15)))
    deviation: tuple[float, tuple[tuple[float, float], ...]] = (0.01, ((50.0, -0.009),))

    def steps(self, s: Seeds, j: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``cost without the break's own, kind, possible`` of each step."""
        g = Gaps.between(s, j, i)
        off, ref = np.abs(g.shift), g.read + g.shift
        near = g.same & np.where(ref >= -self.tolerance, off <= self.most_deviation, off <= self.repeat_window)
        kind = np.where(~near, BREAK, np.where(ref >= -self.tolerance, CONTINUATION, REPEAT))
        cost = piecewise(g.read, *self.read_gap) + np.where(g.same, g.cut, 0.0)
        return cost + np.where(near, piecewise(off, *self.deviation), 0.0) + np.where(kind == REPEAT, self.repeat, 0.0), kind, g.ok


@dataclass(frozen=True)
class Chain:
    """Seeds of a chain in read order, the kind of the step to each but the first, and the score."""

    score: float
    seeds: list[int]
    kinds: list[int] = field(default_factory=list)


def by_breaks(s: Seeds, scheme: BreakScheme = BreakScheme(), most: int = 8) -> Chain | None:
    """The best chain of seeds in read order (``s`` is sorted by read_start); beyond ``most`` breaks each costs ``most`` times the penalty.

    A layer for each number of breaks: a step without a break stays in its layer, a break moves one on. For
    each seed all earlier seeds and layers are scored at once. Of equal steps the latest earlier seed counts.
    """
    return by_breaks_all([s], scheme, most)[0]


#: Seeds of all reads, padding included, that go through the program of breaks together.
TOGETHER = 1 << 13


def by_breaks_all(reads: list[Seeds], scheme: BreakScheme = BreakScheme(), most: int = 8) -> list[Chain | None]:
    """``by_breaks`` of many reads: those alike in number of seeds go together, a seed of each at a time."""
    out: list[Chain | None] = [None] * len(reads)
    sizes = [len(s["read_start"]) for s in reads]
    left = sorted((k for k, n in enumerate(sizes) if n), key=sizes.__getitem__)
    while left:
        taken = 1
        while taken < len(left) and (taken + 1) * sizes[left[taken]] <= TOGETHER:
            taken += 1
        group, left = left[:taken], left[taken:]
        for k, chain in zip(group, _by_breaks_together([reads[k] for k in group], scheme, most)):
            out[k] = chain
    return out


def _by_breaks_together(reads: list[Seeds], scheme: BreakScheme, most: int) -> list[Chain]:
    """The program over reads as columns, the shorter ones filled up with seeds that no chain ends in."""
    sizes = np.array([len(r["read_start"]) for r in reads])
    n, count = int(sizes.max()), len(reads)
    s: Seeds = {}
    for c in COLUMNS:
        s[c] = np.zeros((n, count), np.result_type(*(r[c] for r in reads)))
        for g, r in enumerate(reads):
            s[c][: sizes[g], g] = r[c]
    score = np.full((most + 1, n, count), -np.inf)
    came = np.full((most + 1, n, count, 2), -1, np.int32)  # seed, layer
    kinds = np.zeros((most + 1, n, count), np.int8)
    score[0] = s["weight"]
    layers = np.arange(most + 1)
    top = 0  # the last layer that any chain has reached
    for i in range(1, n):
        first = int(np.searchsorted(sizes, i, side="right"))  # reads are sorted by size; those that have a seed i
        part = {c: v[: i + 1, first:] for c, v in s.items()}
        cost, kind, ok = scheme.steps(part, np.arange(i), i)
        top = min(top + 1, most)
        past = score[: top + 1, :i, first:]
        broken = np.full_like(past, -np.inf)
        broken[1:] = past[:-1]
        breaks = kind == BREAK
        if top == most:  # the last layer is also entered from itself
            again = past[most] > broken[most]
            broken[most][again] = past[most][again]
        total = np.where(breaks, broken - (layers[: top + 1] * scheme.penalty)[:, None, None], past) - cost + part["weight"][i]
        total[:, ~ok] = -np.inf
        layer, read = np.nonzero(total.max(axis=1) > score[: top + 1, i, first:])
        if not len(layer):
            continue
        ways = total[layer, :, read]
        at = i - 1 - np.argmax(ways[:, ::-1], axis=1)
        g = read + first
        score[layer, i, g] = ways[np.arange(len(at)), at]
        by = kind[at, read]
        before = layer - 1
        if top == most:
            before = np.where((layer == most) & again[at, read], most, before)
        came[layer, i, g, 0], came[layer, i, g, 1], kinds[layer, i, g] = at, np.where(by == BREAK, before, layer), by
    return [_chain_back(score[:, :m, g], came[:, :, g], kinds[:, :, g]) for g, m in enumerate(sizes)]


def _chain_back(score: np.ndarray, came: np.ndarray, kinds: np.ndarray) -> Chain:
    """A read's chain from its best end; of equal ends the latest seed and layer."""
    flat = score.T.ravel()
    i, layer = divmod(len(flat) - 1 - int(np.argmax(flat[::-1])), len(score))
    chain, steps, top = [], [], float(score[layer, i])
    while True:
        chain.append(i)
        before, from_layer = came[layer, i]
        if before < 0:
            return Chain(top, chain[::-1], steps[::-1])
        steps.append(int(kinds[layer, i]))
        i, layer = int(before), int(from_layer)


@dataclass(frozen=True)
class SegmentScheme:
    """Reach and costs of steps within one place; seeds of other places are not joined."""

    read_gap: int = 40
    deviation: int = 200
    least_span: int = 40
    gap_cost: float = 0.05
    deviation_cost: float = 0.01
    diagonal_cost: float = 0.0
    repeat: float = 0.0

    @classmethod
    def for_k(cls, k: int) -> SegmentScheme:
        return cls(read_gap=2 * k, least_span=2 * k)

    def reachable(self, s: Seeds, i: int, j: np.ndarray) -> np.ndarray:
        """Which of the later seeds ``j`` can be in one component with ``i``."""
        near = s["read_start"][j] - s["read_end"][i] <= self.read_gap
        return near & (s["chrom"][j] == s["chrom"][i]) & (s["reverse"][j] == s["reverse"][i]) & (np.abs(s["diagonal"][j] - s["diagonal"][i]) <= self.deviation)

    def weights(self, s: Seeds) -> np.ndarray:
        return s["weight"]

    def steps(self, s: Seeds, j: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = Gaps.between(s, j, i)
        off = np.abs(g.shift)
        again = g.read + g.shift < -(s["read_end"][i] - s["read_start"][i])
        cost = g.read * self.gap_cost + off * self.diagonal_cost + np.where(again, self.repeat, off * self.deviation_cost + g.cut)
        return cost, np.where(again, REPEAT, CONTINUATION), g.ok & g.same


@dataclass(frozen=True)
class BandScheme(SegmentScheme):
    """Chains around one diagonal: seeds away from it weigh less, by the band's own spread; breaks are steps at a price."""

    chrom: int = 0
    reverse: bool = False
    center: float = 0.0
    variance: float = 1.0
    penalty: float = 30.0
    most_off: float = 15.0
    reach: int = 1000

    def reachable(self, s: Seeds, i: int, j: np.ndarray) -> np.ndarray:
        return s["read_start"][j] - s["read_end"][i] <= self.reach

    def weights(self, s: Seeds) -> np.ndarray:
        inside = (s["chrom"] == self.chrom) & (s["reverse"] == self.reverse)
        off = self.most_off * np.tanh((s["diagonal"] - self.center) ** 2 / self.variance)
        return np.maximum(s["weight"] - np.where(inside, off, self.most_off), 0.0)

    def steps(self, s: Seeds, j: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = Gaps.between(s, j, i)
        off = np.abs(g.shift)
        again = g.same & (g.read + g.shift < -(s["read_end"][i] - s["read_start"][i]))
        far = ~g.same | ~again & (g.read > self.reach)
        more = np.where(far, self.penalty, off * self.diagonal_cost + np.where(again, self.penalty / np.sqrt(2.0), off * self.deviation_cost + g.cut))
        return g.read * self.gap_cost + more, np.where(far, BREAK, np.where(again, REPEAT, CONTINUATION)), g.ok


def components(s: Seeds, scheme: SegmentScheme) -> list[np.ndarray]:
    """Seeds (sorted by read_start) that reach each other, in read order; components under the scheme's span are left out."""
    n = len(s["read_start"])
    of = np.arange(n)  # the first seed of each seed's component
    for i in range(n):
        later = np.arange(i + 1, n)
        met = of[later[scheme.reachable(s, i, later)]]
        if (met != of[i]).any():  # all that meet here become one at once
            joined = np.arange(n)
            joined[met] = joined[of[i]] = min(of[i], met.min())
            of = joined[of]
    groups = [np.flatnonzero(of == r) for r in np.unique(of)]
    return [g for g in groups if s["read_end"][g[-1]] - s["read_start"][g[0]] >= scheme.least_span]


def chains_of(s: Seeds, component: np.ndarray, scheme: SegmentScheme) -> list[Chain]:
    """Chains of a component, the best first, each without the seeds of those before; what is left are chains of one seed.

    A chain has two seeds at least and a score above 0. Scores of seeds before the first one taken stay as they are.
    """
    weight = scheme.weights(s)
    active, out = component, []
    score, came, kinds, done = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int8), 0
    while len(active) > 1:
        n = len(active)
        score, came, kinds = (np.concatenate([x[:done], np.zeros(n - done, x.dtype)]) for x in (score, came, kinds))
        for r in range(done, n):
            i = active[r]
            score[r], came[r] = weight[i], -1
            if r:
                cost, kind, ok = scheme.steps(s, active[:r], i)
                total = np.where(ok, score[:r] - cost, -np.inf) + weight[i]
                at = r - 1 - int(np.argmax(total[::-1]))
                if total[at] > score[r]:
                    score[r], came[r], kinds[r] = total[at], at, kind[at]
        end = n - 1 - int(np.argmax(score[::-1]))
        if score[end] <= 0:
            break
        ranks, steps, at = [], [], end
        while at >= 0:
            ranks.append(at)
            if came[at] >= 0:
                steps.append(int(kinds[at]))
            at = int(came[at])
        ranks.reverse()
        if len(ranks) < 2:
            break
        out.append(Chain(float(score[end]), active[ranks].tolist(), steps[::-1]))
        done = ranks[0]
        active = np.delete(active, ranks)
    return out + [Chain(float(weight[i]), [int(i)]) for i in active]


def by_read(rows: DataFrame, read: str, columns: dict[str, str], order: list[str], solve: Callable[[object, Seeds], list[tuple]], schema: str) -> DataFrame:
    """``solve(read, columns as arrays)`` for each read, in one pass over reads dealt out and sorted; its tuples follow ``read``, as ``schema`` says.

    A task holds one read's rows beside a batch.
    """
    return by_reads(rows, read, columns, order, lambda keys, reads: [solve(k, s) for k, s in zip(keys, reads)], schema, 0)


#: Rows of whole reads that are solved together.
GATHERED = 1 << 16


def by_reads(rows: DataFrame, read: str, columns: dict[str, str], order: list[str], solve: Callable[[list, list[Seeds]], list[list[tuple]]], schema: str, gathered: int = GATHERED) -> DataFrame:
    """``by_read`` where ``solve(reads, their columns)`` takes many reads and gives each one's tuples.

    A task holds a batch, one read's rows and ``gathered`` rows of others.
    """
    prepare(rows.sparkSession)
    names = ["read", *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Seeds] = []
        keys_of: list = []
        ready: list[Seeds] = []
        size = 0
        name = key = None

        def finish(last: bool = False) -> list[tuple]:
            nonlocal size
            if held:
                keys_of.append(key)
                ready.append({c: np.concatenate([h[c] for h in held]) for c in columns})
                size += len(next(iter(ready[-1].values())))
                held.clear()
            if not ready or not last and size < gathered:
                return []
            out = [(k, *row) for k, found in zip(keys_of, solve(keys_of, ready)) for row in found]
            keys_of.clear()
            ready.clear()
            size = 0
            return out

        for batch in batches:
            out: list[tuple] = []
            keys, reads, whole = batch["_key"].to_numpy(), batch["_read"].to_numpy(), {c: batch[c].to_numpy() for c in columns}
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else []
            for first, end in zip(cuts, cuts[1:]):
                if held and name != keys[first]:
                    out += finish()
                name, key = keys[first], None if pd.isna(reads[first]) else reads[first]
                held.append({c: v[first:end] for c, v in whole.items()})
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(finish(True), columns=names)

    key = F.coalesce(F.concat(F.lit("r"), F.col(read).cast("string")), F.lit("")).alias("_key")  # null reads are one read
    dealt = rows.select(key, F.col(read).alias("_read"), *(F.col(c).cast(t).alias(c) for c, t in columns.items())).repartition("_key").sortWithinPartitions("_key", *order)
    return dealt.mapInPandas(run, f"read {rows.schema[read].dataType.simpleString()}, {schema}")


ORDER = ["read_start", "read_end", "chrom", "reverse", "diagonal", "weight"]
_ROW = "chain int, place int, chrom long, reverse boolean, diagonal long, read_start long, read_end long, weight double, step string, score double"


def _rows(s: Seeds, chains: list[Chain]) -> list[tuple]:
    return [
        (n, p, int(s["chrom"][i]), bool(s["reverse"][i]), int(s["diagonal"][i]), int(s["read_start"][i]), int(s["read_end"][i]), float(s["weight"][i]), KINDS[c.kinds[p - 1]] if p else None, c.score)
        for n, c in enumerate(chains) for p, i in enumerate(c.seeds)
    ]


def chain_by_breaks(seeds: DataFrame, read: str = "read", scheme: BreakScheme = BreakScheme(), most: int = 8) -> DataFrame:
    """Each read's best chain by count of breaks: ``read, chain`` (0) ``, place`` (from 0), the seed's columns, ``step`` to it (null for the first), ``score``."""
    return by_reads(seeds, read, COLUMNS, ORDER, lambda _, reads: [_rows(s, [c] if c else []) for s, c in zip(reads, by_breaks_all(reads, scheme, most))], _ROW)


def chain_components(seeds: DataFrame, read: str = "read", scheme: SegmentScheme = SegmentScheme()) -> DataFrame:
    """All chains of each read, component by component; columns as ``chain_by_breaks`` gives them, ``chain`` counting from 0."""
    return by_read(seeds, read, COLUMNS, ORDER, lambda _, s: _rows(s, [c for part in components(s, scheme) for c in chains_of(s, part, scheme)]), _ROW)


def chain_band(seeds: DataFrame, bands: DataFrame, read: str = "read", **costs: float) -> DataFrame:
    """All chains of each read around its band: ``bands (read, band_chrom, band_reverse, center, variance)``, one row a read at the most; reads without one have no chains."""
    columns = COLUMNS | {"band_chrom": "long", "band_reverse": "boolean", "center": "double", "variance": "double"}

    def solve(_: object, s: Seeds) -> list[tuple]:
        scheme = BandScheme(chrom=int(s["band_chrom"][0]), reverse=bool(s["band_reverse"][0]), center=float(s["center"][0]), variance=float(s["variance"][0]), **costs)
        return _rows(s, [c for part in components(s, scheme) for c in chains_of(s, part, scheme)])

    return by_read(seeds.join(bands, read), read, columns, ORDER, solve, _ROW)


def split_overlaps(pairs: DataFrame, atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Where two overlapping seeds part: ``*keys, split, trimmed, left_end, right_start``.

    ``pairs (*keys, left, right)`` name seeds, ``atoms (seed, start, end, weight)`` are the hits they are made of. The
    split is the end of a left atom or the start of a right one within the overlap, such that the left atoms ending
    after it and the right ones starting before it weigh least; of equal ones the first. ``left_end`` and ``right_start``
    are what stays of the two, or their whole extent where nothing would. Weights of all atoms beyond each
    place are running sums from either end of the pair's overlap.
    """
    named = lambda side: atoms.select(F.col("seed").alias(side), *(F.col(c).alias(f"_{c}") for c in ("start", "end", "weight")))
    ends = atoms.groupBy("seed").agg(F.min("start").alias("_from"), F.max("end").alias("_to"))
    both = pairs.join(ends.select(F.col("seed").alias("left"), F.col("_to").alias("left_to"), F.col("_from").alias("left_from")), "left").join(ends.select(F.col("seed").alias("right"), F.col("_from").alias("right_from"), F.col("_to").alias("right_to")), "right")
    both = both.where("right_from < left_to")
    held = [*keys, "left_from", "left_to", "right_from", "right_to"]
    left = both.join(named("left"), "left").select(*held, F.col("_end").alias("p"), F.col("_end").alias("e"), F.lit(None).cast("long").alias("b"), F.when(F.col("_end") > F.col("right_from"), F.col("_weight")).alias("lw"), F.lit(None).cast("double").alias("rw"))
    right = both.join(named("right"), "right").select(*held, F.col("_start").alias("p"), F.lit(None).cast("long").alias("e"), F.col("_start").alias("b"), F.lit(None).cast("double").alias("lw"), F.when(F.col("_start") < F.col("left_to"), F.col("_weight")).alias("rw"))
    w = Window.partitionBy(*held).orderBy("p")
    after, before = w.rangeBetween(1, Window.unboundedFollowing), w.rangeBetween(Window.unboundedPreceding, -1)
    upto, since = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    cost = F.coalesce(F.sum("lw").over(after), F.lit(0.0)) + F.coalesce(F.sum("rw").over(before), F.lit(0.0))
    scored = left.unionByName(right).withColumns({"cost": cost, "left_end": F.max("e").over(upto), "right_start": F.min("b").over(since)}).where("lw is not null or rw is not null")
    best = scored.groupBy(*held).agg(F.min(F.struct("cost", "p", "left_end", "right_start")).alias("m"))
    return best.select(*keys, F.col("m.p").alias("split"), F.col("m.cost").alias("trimmed"), F.coalesce("m.left_end", "left_to").alias("left_end"), F.coalesce("m.right_start", "right_from").alias("right_start"))
