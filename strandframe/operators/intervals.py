"""Half-open intervals: merging, gaps, coverage, overlap joins, point lookups, single linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, also: list[Column] | None = None) -> DataFrame:
    """Islands of intervals that overlap, touch or lie within ``gap``: ``*keys, start, end, n`` and the aggregates ``also``. A key is windowed in one task."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = df.withColumn("_new", (F.coalesce(F.col(start) > F.max(end).over(before) + gap, F.lit(True))).cast("int"))
    return fresh.withColumn("_island", F.sum("_new").over(upto)).groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), *(also or [])).drop("_island")


def merge_binned(df: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Islands as ``merge`` gives them (``gap`` 0), for keys too large for one window.

    Intervals are dealt to the bins of ``width`` where they start and become islands there; a bin's islands
    that others may reach are then merged over the key. Those are at most as many as the bins' islands,
    so the second window holds rows in proportion to the reference, not to the intervals.
    """
    binned = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.floor(F.col(start) / width).alias("_bin"))
    inner = merge(binned, [*keys, "_bin"]).drop("_bin").withColumnRenamed("n", "_m")
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = inner.withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    return fresh.withColumn("_island", F.sum("_new").over(upto)).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_m").alias("n")).drop("_island")


def gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What lies between neighbouring islands: ``*keys, start, end``."""
    w = Window.partitionBy(*keys).orderBy("start")
    islands = merge(df, keys, start, end)
    return islands.withColumn("_next", F.lead("start").over(w)).where("_next is not null").select(*keys, F.col("end").alias("start"), F.col("_next").alias("end"))


def coverage(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1 << 16) -> DataFrame:
    """``*keys, covered, intervals``: the union's length and the number of intervals. Islands are made within bins of ``width`` first, so a key is many tasks'."""
    return merge_binned(df, keys, width, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum("n").alias("intervals"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, gap: int = 0, how: Column | None = None) -> DataFrame:
    """Pairs with equal ``keys`` whose intervals overlap (or lie within ``gap``): left columns, and right ones with an ``r_`` prefix.

    Intervals (``start, end`` on both sides) are dealt to bins of ``width``, an equality that spreads the
    join and a hot key; a pair is made in the bin where the later one starts, so it comes once.
    """
    def bins(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / width), F.floor(F.greatest(hi - 1, lo) / width)))

    a = left.where(F.col("end") > F.col("start")).withColumn("_bin", bins(F.col("start") - gap, F.col("end") + gap))
    b = right.where(F.col("end") > F.col("start"))
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns)).withColumn("_rbin", bins(F.col("r_start"), F.col("r_end")))
    same = F.col("_bin") == F.col("_rbin")
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    near = (F.col("start") < F.col("r_end") + gap) & (F.col("r_start") < F.col("end") + gap)
    once = F.col("_bin") == F.floor(F.greatest(F.col("start") - gap, F.col("r_start")) / width)
    return a.join(b, same & near & once & (how if how is not None else F.lit(True))).drop("_bin", "_rbin")


def sums_at(rows: DataFrame, marks: DataFrame, keys: list[str], places: dict[str, Column], values: list[str], width: int = 1 << 16) -> DataFrame:
    """Adds to ``rows`` a struct for each of ``places``, a position: ``below_<v>`` and ``at_<v>``, the sums of the ``values`` of the key's ``marks (*keys, pos, *values)`` before it and on it.

    Marks and places are summed by position first, then within bins of ``width``; each bin's sums, one row a bin, are carried
    to the bins after it. No row meets another, so the work goes with the rows and not with the pairs that they form. Rows
    with a null key or place get a null struct.
    """
    here = rows.select(*keys, F.explode(F.array(*(p.cast("long") for p in places.values()))).alias("pos")).distinct()
    asked = here.select(*keys, "pos", *(F.lit(0).cast(marks.schema[v].dataType).alias(v) for v in values), F.lit(True).alias("_asked"))
    spots = marks.select(*keys, F.col("pos").cast("long").alias("pos"), *values, F.lit(False).alias("_asked")).unionByName(asked).dropna(subset=[*keys, "pos"])
    spots = spots.groupBy(*keys, "pos").agg(*(F.sum(v).alias(v) for v in values), F.max("_asked").alias("_asked")).withColumn("_bin", F.floor(F.col("pos") / width))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.groupBy(*keys, "_bin").agg(*(F.sum(v).alias(f"_{v}") for v in values)).select(*keys, "_bin", *(F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values))
    within = Window.partitionBy(*keys, "_bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    below = spots.select("*", *(F.sum(v).over(within).alias(f"_in_{v}") for v in values)).where("_asked").join(carried, [*keys, "_bin"])
    zero = F.lit(0)
    found = F.struct(*((F.coalesce(f"_in_{v}", zero) + F.coalesce(f"_{v}", zero)).alias(f"below_{v}") for v in values), *(F.col(v).alias(f"at_{v}") for v in values))
    sums = below.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("pos").alias("_pos"), found.alias("_found"))
    for name, place in places.items():
        same = place.cast("long") == F.col("_pos")
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"_k{i}"))
        rows = rows.join(sums, same, "left").select(*rows.columns, F.col("_found").alias(name))
    return rows


def _ends(df: DataFrame, keys: list[str]) -> DataFrame:
    """Marks of both ends of intervals: ``*keys, pos, starts, ends``."""
    side = lambda at, s, e: df.select(*keys, F.col(at).alias("pos"), F.lit(s).cast("long").alias("starts"), F.lit(e).cast("long").alias("ends"))
    return side("start", 1, 0).unionByName(side("end", 0, 1))


def overlap_sums(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``left`` with ``hits, bases``: how many of the ``right`` intervals of equal ``keys`` overlap each of its intervals, and by how many bases in all. What none overlaps is left out.

    The pairs of ``range_join`` counted without making them: those that start before an interval's end, less those that end
    by its start; bases are the difference of the running depth's sums. An empty interval meets those that hold it inside,
    by no bases; backward left and empty right intervals meet nothing.
    """
    marks = _ends(right.where(F.col("end") > F.col("start")), keys)
    marks = marks.withColumn("depth", F.col("starts") - F.col("ends")).withColumn("reach", F.col("depth") * F.col("pos"))
    found = sums_at(left.where(F.col("end") >= F.col("start")), marks, keys, {"_s": F.col("start"), "_e": F.col("end")}, ["starts", "ends", "depth", "reach"], width)
    hits = F.col("_e.below_starts") - F.col("_s.below_ends") - F.col("_s.at_ends")
    upto = lambda at, place: F.col(at) * F.col(f"{place}.below_depth") - F.col(f"{place}.below_reach")
    return found.select(*left.columns, hits.alias("hits"), (upto("end", "_e") - upto("start", "_s")).cast("long").alias("bases")).where("hits > 0")


def touching_sums(left: DataFrame, right: DataFrame, keys: list[str], width: int, gap: int = 0) -> DataFrame:
    """``left`` with ``hits, touching``: the pairs of ``touching_join`` counted without making them, and those of them where one interval ends just where the other starts. What none meets is left out."""
    held = right.where(F.col("end") >= F.col("start"))
    marks = _ends(held, keys).withColumn("points", F.lit(0).cast("long"))
    points = held.where(F.col("end") == F.col("start")).select(*keys, F.col("start").alias("pos"), F.lit(0).cast("long").alias("starts"), F.lit(0).cast("long").alias("ends"), F.lit(1).cast("long").alias("points"))
    places = {"_low": F.col("start") - gap, "_high": F.col("end") + gap, "_s": F.col("start"), "_e": F.col("end")}
    found = sums_at(left.where(F.col("end") >= F.col("start")), marks.unionByName(points), keys, places, ["starts", "ends", "points"], width)
    hits = F.col("_high.below_starts") + F.col("_high.at_starts") - F.col("_low.below_ends")
    twice = F.when(F.col("start") == F.col("end"), F.col("_s.at_points")).otherwise(0)  # an empty interval on an empty one touches at both ends
    return found.select(*left.columns, hits.alias("hits"), (F.col("_e.at_starts") + F.col("_s.at_ends") - twice).alias("touching")).where("hits > 0")


def contains_point(points: DataFrame, regions: DataFrame, keys: list[str], pos: str, width: int) -> DataFrame:
    """Points joined to the half-open regions that hold them."""
    spread = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    at = points.withColumn("_bin", F.floor(F.col(pos) / width))
    return at.join(spread, [*keys, "_bin"]).where((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))).drop("_bin")


def linkage(df: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """Single linkage on a line: a new group where the step to the next value is over ``eps``. Adds ``group`` from 0."""
    w = Window.partitionBy(*keys).orderBy(value)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("_new", F.coalesce(step > eps, F.lit(False)).cast("long")).withColumn("group", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def overlapping(df: DataFrame, keys: list[str], order: str, start: str = "start", end: str = "end", width: int = 1 << 16) -> DataFrame:
    """Intervals that begin before the furthest end of those before them: adds ``reach``, that end.

    Intervals are windowed within bins of ``width`` by start; each bin's furthest end, one row a bin, is carried to
    the bins after it, so a key with a third of all rows is many tasks'.
    """
    binned = df.withColumn("_bin", F.floor(F.col(start) / width))
    ends = binned.groupBy(*keys, "_bin").agg(F.max(end).alias("_end"))
    carried = ends.withColumn("_carried", F.max("_end").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("_carried is not null").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bin").alias("_b"), "_carried")
    within = Window.partitionBy(*keys, "_bin").orderBy(start, order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = binned.withColumn("_reach", F.max(end).over(within)).join(carried, same, "left")
    return rows.select(*df.columns, F.greatest("_reach", "_carried").alias("reach")).where(F.col(start) < F.col("reach"))


def uncovered(df: DataFrame, lengths: DataFrame, keys: list[str], length: str, start: str = "start", end: str = "end") -> DataFrame:
    """What ``df`` leaves of [0, length), both ends included: ``*keys, start, end``. A key without intervals is one gap; intervals beyond the ends count as far as they reach in."""
    w = Window.partitionBy(*keys).orderBy("start")
    islands = merge(df.where(F.col(end) > F.col(start)), keys, start, end)
    spans = lengths.select(*keys, F.col(length).cast("long").alias("_length")).join(islands, keys, "left")
    low = F.greatest(F.coalesce(F.lag("end").over(w), F.lit(0)), F.lit(0))
    high = F.least(F.coalesce("start", "_length"), F.col("_length"))
    before = spans.withColumns({"_low": low, "_high": high, "_last": F.lead("end").over(w).isNull()})
    tail = F.when(F.col("_last") & F.col("end").isNotNull(), F.struct(F.greatest("end", F.lit(0)).alias("start"), F.col("_length").alias("end")))
    both = before.select(*keys, F.explode(F.array(F.struct(F.col("_low").alias("start"), F.col("_high").alias("end")), tail)).alias("g"))
    return both.where("g is not null and g.end > g.start").select(*keys, "g.start", "g.end")


def touching_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, gap: int = 0, how: Column | None = None) -> DataFrame:
    """Pairs with equal ``keys`` whose intervals overlap, touch or lie within ``gap``; columns as ``range_join`` gives them.

    Ends count as in [start, end]: (0, 10) meets (10, 20), and an empty interval meets what it touches. Backward
    and null intervals meet nothing. Both sides are dealt to bins of ``width``; a pair comes in the bin of the
    later start, so once, also where it touches at a bin's border.
    """
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    a = left.where(F.col("end") >= F.col("start")).withColumn("_bin", spread(F.col("start") - gap, F.col("end") + gap))
    b = right.where(F.col("end") >= F.col("start")).select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("_rbin", spread(F.col("r_start"), F.col("r_end")))
    meet = (F.col("_bin") == F.col("_rbin")) & (F.col("r_start") <= F.col("end") + gap) & (F.col("start") <= F.col("r_end") + gap)
    for k in keys:
        meet = meet & (F.col(k) == F.col(f"r_{k}"))
    once = F.col("_bin") == F.floor(F.greatest(F.col("start") - gap, F.col("r_start")) / width)
    return a.join(b, meet & once & (how if how is not None else F.lit(True))).drop("_bin", "_rbin")


def shared_length(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``*keys, shared``: the length that the unions of both sides have in common; overlapping intervals of a side count once. Keys without any are left out."""
    a, b = (merge_binned(x.where(F.col("end") > F.col("start")), keys, width).drop("n") for x in (left, right))
    pairs = range_join(a, b, keys, width)
    return pairs.groupBy(*keys).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).cast("long").alias("shared"))
