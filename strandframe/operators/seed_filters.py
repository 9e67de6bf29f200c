"""Filters of chained seeds, alone and repeated until nothing changes.

Seeds are rows ``read, step, chrom, reverse, read_start, read_end, ref_start, diagonal, weight, frequency`` of one
chain a read; ``ref_start`` is the low end on the reference, ``frequency`` how often the seed's k-mer stands in the
read. A *segment* is a run of a chain without a break. Every filter is a set of windows over a read or a
segment, which the read's length bounds, and adds a boolean column; a null weight or frequency flags nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, prepare
from . import filters

#: The filters' defaults.
LEAST_WEIGHT, SHORT, MOST_SEEDS, MOST_SPAN, OVERLAP, BRIDGE = 50.0, 75, 3, 100, 50, 1000
SEED = {"step": "long", "chrom": "long", "reverse": "boolean", "read_start": "long", "read_end": "long", "ref_start": "long", "diagonal": "long", "weight": "double", "frequency": "long"}

Filter = Callable[[DataFrame], DataFrame]


def chained(seeds: DataFrame, read: str = "read", bridge: int = BRIDGE) -> DataFrame:
    """Adds ``segment`` (from 0): broken where chromosome or strand change or the diagonal steps by more than ``bridge``."""
    return filters.segments(seeds, read, "step", ["chrom", "reverse"], bridge).drop("alone")


def _within(read: str) -> Window:
    return Window.partitionBy(read, "segment").orderBy("step")


def frequent(seeds: DataFrame, threshold: int, read: str = "read", least: float = LEAST_WEIGHT) -> DataFrame:
    """``flag``: seeds inside a segment that weigh less than ``least`` for each time they stand in the read, and lie over ``threshold`` off a neighbour's diagonal."""
    w = _within(read)
    before, after = (F.abs(f("diagonal").over(w) - F.col("diagonal")) for f in (F.lag, F.lead))
    flag = (F.col("weight") / F.col("frequency") < least) & (F.greatest(before, after) > threshold) & before.isNotNull() & after.isNotNull()
    return seeds.withColumn("flag", F.coalesce(flag, F.lit(False)))


def excursion(seeds: DataFrame, threshold: int, read: str = "read") -> DataFrame:
    """``flag``: seeds whose neighbours in the segment both lie over ``threshold`` diagonals off, to opposite sides."""
    return filters.excursions(seeds, [read, "segment"], "step", threshold).withColumnRenamed("excursion", "flag")


def terminal(seeds: DataFrame, threshold: int, read: str = "read") -> DataFrame:
    """``flag``: seeds at either end of a segment of three or more, as far as they lie over ``threshold`` off its weighted median diagonal.

    The median is the least diagonal up to which half the segment's weight lies: a running sum in order of diagonals.
    """
    whole = Window.partitionBy(read, "segment")
    upto = whole.orderBy("diagonal", "step").rowsBetween(Window.unboundedPreceding, 0)
    summed = seeds.withColumns({"_sum": F.sum("weight").over(upto), "_all": F.sum("weight").over(whole), "_n": F.count("*").over(whole)})
    rows = summed.withColumn("_median", F.min(F.when(F.col("_sum") * 2 >= F.col("_all"), F.col("diagonal"))).over(whole))
    sound = (F.abs(F.col("diagonal") - F.col("_median")) <= threshold).cast("int")
    rows = rows.withColumn("_sound", F.coalesce(sound, F.lit(1)))
    from_left, from_right = (F.sum("_sound").over(whole.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) == 0 for o in (F.col("step").asc(), F.col("step").desc()))
    return rows.withColumn("flag", (F.col("_n") >= 3) & (from_left | from_right)).drop("_sum", "_all", "_n", "_median", "_sound")


def short_alone(seeds: DataFrame, read: str = "read", least: int = SHORT) -> DataFrame:
    """``flag``: segments of one seed shorter than ``least``."""
    n = F.count("*").over(Window.partitionBy(read, "segment"))
    return seeds.withColumn("flag", (n == 1) & (F.col("read_end") - F.col("read_start") < least))


def joinable(left: Column, right: Column, overlap: int = OVERLAP) -> Column:
    """Whether a chain could step from one seed to the other: they overlap on the read by ``overlap`` at the most, and not by the whole of the later one."""
    shared = F.greatest(left["read_end"] - right["read_start"], F.lit(0))
    return (shared <= overlap) & (shared < right["read_end"] - right["read_start"])


def excursion_segments(seeds: DataFrame, read: str = "read", most: int = MOST_SEEDS, span: int = MOST_SPAN) -> DataFrame:
    """``flag``: inner segments of ``most`` seeds and ``span`` reference bases at the most, whose flanks could be joined without them.

    From left to right; the left flank is the last segment that stays. A read's segments are folded as an array, inside the JVM.
    """
    seed = F.struct("step", "read_start", "read_end", "ref_start")
    ends = seeds.groupBy(read, "segment").agg(F.min_by(seed, "step").alias("first"), F.max_by(seed, "step").alias("last"), F.count("*").alias("n"))
    low = F.least("first.ref_start", "last.ref_start")
    size = lambda s: F.col(f"{s}.ref_start") + F.col(f"{s}.read_end") - F.col(f"{s}.read_start")
    small = (F.col("n") <= most) & (F.greatest(size("first"), size("last")) - low <= span)
    w = Window.partitionBy(read).orderBy("segment")
    kept = lambda s: F.struct(F.col(f"{s}.read_start").alias("read_start"), F.col(f"{s}.read_end").alias("read_end"))
    rows = ends.select(read, "segment", small.alias("small"), kept("last").alias("last"), F.lead(kept("first")).over(w).alias("next"))
    listed = rows.groupBy(read).agg(F.array_sort(F.collect_list(F.struct("segment", "small", "last", "next"))).alias("s"))
    start = F.struct(F.lit(None).cast("struct<read_start:bigint,read_end:bigint>").alias("left"), F.array().cast("array<bigint>").alias("gone"))

    def step(state: Column, x: Column) -> Column:
        out = F.coalesce(x["small"] & state["left"].isNotNull() & x["next"].isNotNull() & joinable(state["left"], x["next"]), F.lit(False))
        return F.struct(F.when(out, state["left"]).otherwise(x["last"]).alias("left"), F.when(out, F.concat(state["gone"], F.array(x["segment"].cast("long")))).otherwise(state["gone"]).alias("gone"))

    gone = listed.select(read, F.explode(F.aggregate("s", start, step, lambda s: s["gone"])).alias("segment")).withColumn("flag", F.lit(True))
    return seeds.join(gone, [read, "segment"], "left").select(*seeds.columns, F.coalesce("flag", F.lit(False)).alias("flag"))


def trimmed(seeds: DataFrame, read: str = "read", bridge: int = BRIDGE) -> DataFrame:
    """Chained seeds (exact matches) cut so that none overlaps the next on the read, nor, within a segment, on the reference.

    From the first pair to the last: the earlier seed loses its right end, and what it cannot give the later
    one loses on the left; the read goes before the reference. Seeds may end up empty. Diagonals and segments
    do not change. Streamed by read, a batch at a time; a task holds one seed back.
    """
    prepare(seeds.sparkSession)
    rows = seeds if "segment" in seeds.columns else chained(seeds, read, bridge)
    names = rows.columns

    def cut(left: dict, right: dict, n: int) -> None:
        """Takes ``n`` bases off the end of ``left``, then off the start of ``right``; the reference follows."""
        a = max(0, min(n, left["read_end"] - left["read_start"]))
        left["read_end"] -= a
        left["ref_start"] += a if left["reverse"] else 0
        b = max(0, min(n - a, right["read_end"] - right["read_start"]))
        right["read_start"] += b
        right["ref_start"] += 0 if right["reverse"] else b

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    if held[read] == row[read]:
                        cut(held, row, held["read_end"] - row["read_start"])
                        if held["segment"] == row["segment"]:
                            low, high = (row, held) if held["reverse"] else (held, row)
                            cut(held, row, low["ref_start"] + low["read_end"] - low["read_start"] - high["ref_start"])
                    out.append(held)
                held = row
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=batch.schema)

    return rows.repartition(read).sortWithinPartitions(read, "step").mapInArrow(run, rows.select(*names).schema)


def drop_flagged(seeds: DataFrame, find: Filter, read: str = "read", bridge: int = BRIDGE) -> DataFrame:
    """One pass: flagged seeds go; the reads that lost some are broken into segments and cut anew. Adds ``changed``."""
    marked = find(seeds if "segment" in seeds.columns else chained(seeds, read, bridge))
    marked = marked.withColumn("changed", F.max("flag").over(Window.partitionBy(read)))
    kept = marked.where(~F.col("flag")).drop("flag")
    again = trimmed(chained(kept.where("changed").drop("segment"), read, bridge), read)
    return kept.where(~F.col("changed")).unionByName(again)


def until_stable(seeds: DataFrame, find: Filter, read: str = "read", bridge: int = BRIDGE) -> DataFrame:
    """``drop_flagged`` until no seed goes. Only the reads that changed go on to the next round, and each round is written to the shared folder."""
    active, settled = chained(seeds.drop("segment"), read, bridge), []
    while True:
        state = materialize(drop_flagged(active, find, read, bridge), "filter")
        settled.append(state.where(~F.col("changed")).drop("changed"))
        active = state.where("changed").drop("changed")
        if active.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


#: Rows of whole reads that are pruned together.
GATHERED = 1 << 16
_PRUNED = ("chrom", "reverse", "diagonal", "read_start", "read_end", "ref_start", "weight", "_share")


def _segments(r: dict[str, np.ndarray], bridge: int) -> np.ndarray:
    """Numbers of the segments of sorted reads, as ``chained`` breaks them, going on from read to read."""
    step = ~r["no_diagonal"][1:] & ~r["no_diagonal"][:-1] & (np.abs(np.diff(r["diagonal"])) > bridge)
    fresh = step | (np.diff(r["chrom"]) != 0) | (np.diff(r["reverse"]) != 0) | (np.diff(r["read"]) != 0)
    return np.cumsum(np.concatenate(([False], fresh))[: len(r["read"])])


def _beside(r: dict[str, np.ndarray], segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of the diagonal to the seed before and behind, and which seeds have both in their segment."""
    met = np.concatenate(([False], (np.diff(segment) == 0) & ~r["no_diagonal"][1:] & ~r["no_diagonal"][:-1], [False]))[: len(segment) + 1]
    by = np.concatenate(([0], np.diff(r["diagonal"]), [0]))[: len(segment) + 1]
    return -by[:-1], by[1:], met[:-1] & met[1:]


def _at_ends(r: dict[str, np.ndarray], segment: np.ndarray, threshold: int) -> np.ndarray:
    """The flags of ``terminal``; segments of one size are summed together."""
    flag = np.zeros(len(segment), bool)
    first, size = np.unique(segment, return_index=True, return_counts=True)[1:]
    for n in np.unique(size[size >= 3]):
        at = first[size == n][:, None] + np.arange(n)
        d, gone, w = r["diagonal"][at], r["no_diagonal"][at], r["weight"][at]
        order = np.lexsort((d, ~gone), axis=1)  # steps are in order already
        w, none = (np.take_along_axis(x, order, 1) for x in (w, r["no_weight"][at]))
        upto = np.cumsum(np.where(none, 0.0, w), axis=1)
        half = ((upto * 2 >= upto[:, -1:]) | np.isnan(upto)) & (np.cumsum(~none, axis=1) > 0) & ~np.take_along_axis(gone, order, 1)
        median = np.take_along_axis(np.take_along_axis(d, order, 1), half.argmax(axis=1)[:, None], 1)
        sound = (np.abs(d - median) <= threshold) | gone | ~half.any(axis=1)[:, None]
        flag[at] = (np.cumsum(sound, axis=1) == 0) | (np.cumsum(sound[:, ::-1], axis=1)[:, ::-1] == 0)
    return flag


def _trim(r: dict[str, np.ndarray], segment: np.ndarray) -> None:
    """``trimmed`` in place. A cut changes no border that a later pair is asked by, so only pairs that overlap are cut: the first of each run of them together, then the second."""
    start, end, low, back = r["read_start"], r["read_end"], r["ref_start"], r["reverse"] == 1

    def over(j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where(back[j], low[i] + end[i] - start[i] - low[j], low[j] + end[j] - start[j] - low[i])

    def cut(j: np.ndarray, i: np.ndarray, n: np.ndarray) -> None:
        a = np.maximum(0, np.minimum(n, end[j] - start[j]))
        end[j] -= a
        low[j] += np.where(back[j], a, 0)
        b = np.maximum(0, np.minimum(n - a, end[i] - start[i]))
        start[i] += b
        low[i] += np.where(back[i], 0, b)

    i = np.arange(1, len(start))
    one = segment[1:] == segment[:-1]
    pairs = i[(np.diff(r["read"]) == 0) & ((end[:-1] > start[1:]) | one & (over(i - 1, i) > 0))]
    if not len(pairs):
        return
    fresh = np.concatenate(([True], np.diff(pairs) != 1))
    level = np.arange(len(pairs)) - np.maximum.accumulate(np.where(fresh, np.arange(len(pairs)), 0))
    order = np.argsort(level, kind="stable")
    for i in np.split(pairs[order], np.cumsum(np.bincount(level))[:-1]):
        cut(i - 1, i, end[i - 1] - start[i])
        i = i[one[i - 1]]
        cut(i - 1, i, over(i - 1, i))


def _pruned(r: dict[str, np.ndarray], threshold: int, bridge: int) -> dict[str, np.ndarray]:
    """``r``, whole reads in order, after the repetitive prune: seeds that stay (``row``), cut, with their ``segment``."""

    def drop(flag: np.ndarray) -> np.ndarray:
        """Flagged seeds go and the reads that lost some are cut anew; the numbers of those reads."""
        nonlocal r
        changed = np.unique(r["read"][flag])
        lost = np.isin(r["read"], changed)
        if (r["no_place"] & lost & ~flag).any():
            raise ValueError("a seed without a place on read and reference cannot be cut")
        r = {k: v[~flag] for k, v in r.items()}
        part = np.flatnonzero(lost[~flag])
        cut = {k: v[part] for k, v in r.items()}
        _trim(cut, _segments(cut, bridge))
        for k in ("read_start", "read_end", "ref_start"):
            r[k][part] = cut[k]
        return changed

    def until_none(find: Callable[[dict[str, np.ndarray]], np.ndarray]) -> None:
        going = np.arange(len(r["read"]))
        while len(going):
            flag = np.zeros(len(r["read"]), bool)
            flag[going] = find({k: v[going] for k, v in r.items()})
            changed = drop(flag) if flag.any() else []
            going = np.flatnonzero(np.isin(r["read"], changed))

    def light(part: dict[str, np.ndarray]) -> np.ndarray:
        before, after, both = _beside(part, _segments(part, bridge))
        return both & part["light"] & (np.maximum(np.abs(before), np.abs(after)) > threshold)

    def straying(part: dict[str, np.ndarray]) -> np.ndarray:
        before, after, both = _beside(part, _segments(part, bridge))
        return both & (np.abs(before) > threshold) & (np.abs(after) > threshold) & (np.sign(before) != np.sign(after))

    until_none(light)
    until_none(straying)
    flag = _at_ends(r, _segments(r, bridge), threshold)
    if flag.any():
        drop(flag)
    segment = _segments(r, bridge)
    first = np.concatenate(([True], np.diff(r["read"]) != 0))[: len(segment)]
    r["segment"] = segment - np.maximum.accumulate(np.where(first, segment, 0)) if len(segment) else segment
    return r


def prune_repetitive(seeds: DataFrame, threshold: int, read: str = "read", bridge: int = BRIDGE) -> DataFrame:
    """Frequent seeds until stable, then excursions until stable, then one pass over the ends of segments.

    The rows of ``until_stable`` and ``drop_flagged`` with these filters. Reads are dealt out by key and come sorted,
    so all rounds of a read are made where it is; a task holds a batch, one read's seeds and ``GATHERED`` rows of others.
    """
    prepare(seeds.sparkSession)
    names = [c for c in seeds.columns if c != "segment"]
    share = F.col("weight") / F.col("frequency")
    rows = seeds.select(*names, share.cast("double").alias("_share"))

    def prune(table: pa.RecordBatch) -> pa.RecordBatch:
        none = {c: table[c].is_null().to_numpy(zero_copy_only=False) for c in _PRUNED}
        r = {c: table[c].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("diagonal", "read_start", "read_end", "ref_start")}
        r |= {n: table[c].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for n, c in (("read", read), ("chrom", "chrom"))}
        r["reverse"] = table["reverse"].cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
        r["weight"] = table["weight"].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        r["light"] = (table["_share"].fill_null(0).to_numpy(zero_copy_only=False) < LEAST_WEIGHT) & ~none["_share"]
        r |= {"no_diagonal": none["diagonal"], "no_weight": none["weight"], "no_place": none["read_start"] | none["read_end"] | none["ref_start"], "row": np.arange(table.num_rows)}
        r = _pruned(r, threshold, bridge)
        at = pa.array(r["row"])
        columns = [table[c].take(at) for c in names]
        for c in ("read_start", "read_end", "ref_start"):
            columns[names.index(c)] = pa.array(r[c], mask=none[c][r["row"]]).cast(table[c].type)
        return pa.record_batch([*columns, pa.array(r["segment"].astype(np.int64))], [*names, "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wanted = [], 0, GATHERED
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < wanted:
                continue
            table = pa.concat_batches(held)
            key = table[read].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            done = int(np.argmax(key == key[-1]))  # the last read may go on
            if done:
                yield prune(table.slice(0, done))
            held, size = [table.slice(done)], table.num_rows - done
            wanted = max(GATHERED, 2 * size)
        if size:
            yield prune(pa.concat_batches(held))

    schema = ", ".join(f"`{c}` {seeds.schema[c].dataType.simpleString()}" for c in names)
    return rows.repartition(read).sortWithinPartitions(read, "step").mapInArrow(run, f"{schema}, segment long")
