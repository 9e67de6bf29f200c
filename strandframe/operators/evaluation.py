"""Measures of alignments that walk their CIGAR strings: windows of identity, errors by distance, position maps, boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar
from ..functions.scalars import size_band
from ..session import prepare
from .compare import invariance
from .intervals import merge
from .stats import mad_outliers


def steps(records: DataFrame, kept: list[str]) -> DataFrame:
    """``*kept, op, len, q, r``: each operation of ``cigar`` with where it begins on the read as aligned, hard clips counted, and on the reference from 0.

    Rows come out of an array of the record itself: no shuffle. Null and empty CIGAR strings give no rows.
    """
    records, ops = records.select(*kept, cigar.parse(F.col("cigar")).alias("_ops")), F.col("_ops")  # parsed once
    first = F.get(ops, F.lit(0))
    hard = F.when(first["op"] == "H", first["len"]).otherwise(F.lit(0))
    rows = records.select(*kept, hard.alias("_hard"), F.explode(cigar.placed(ops)).alias("_s"))
    return rows.select(*kept, "_s.op", "_s.len", (F.col("_s.q") + F.when(F.col("_s.op") == "H", 0).otherwise(F.col("_hard"))).alias("q"), "_s.r")


def _forward(reverse: Column, q: Column, n: Column) -> Column:
    """Where a run of n bases at q of the aligned read begins on the forward read."""
    return F.when(reverse, F.col("read_len") - q - n).otherwise(q)


def identity_windows(records: DataFrame, size: int = 500) -> DataFrame:
    """``read, read_len, window, identity`` of the windows of ``size`` bases, at least half of them aligned, from ``records (read, read_len, reverse, cigar)``.

    Runs are split at the borders of windows; a deletion is an error at the base before which it lies.
    """
    s = steps(records, ["read", "read_len", "reverse"]).where(F.col("op").isin("=", "X", "M", "I", "D") & (F.col("len") > 0))
    n = F.when(F.col("op") == "D", 0).otherwise(F.col("len"))
    s = s.withColumn("f0", _forward(F.col("reverse"), F.col("q"), n)).withColumn("f1", F.col("f0") + n)
    at = F.floor(F.least("f0", F.col("read_len") - 1) / size)
    s = s.withColumn("window", F.explode(F.sequence(at, F.greatest(at, F.floor((F.col("f1") - 1) / size)))))
    inside = F.least("f1", (F.col("window") + 1) * size) - F.greatest("f0", F.col("window") * size)
    of = lambda kinds, v: F.sum(F.when(F.col("op").isin(*kinds), v).otherwise(0))
    sums = s.groupBy("read", "read_len", "window").agg(of("=XMI", inside).alias("aligned"), of("=", inside).alias("matches"), (of("XI", inside) + of("D", F.col("len"))).alias("errors"))
    enough = (2 * F.col("aligned") >= size) & (F.col("matches") + F.col("errors") > 0)
    return sums.where(enough).select("read", "read_len", "window", (F.col("matches") / (F.col("matches") + F.col("errors"))).alias("identity"))


def outlier_windows(records: DataFrame, size: int = 500, k: float = 5.0, drop: float = 0.05) -> DataFrame:
    """``read, start, end, identity, median`` of windows far below their read's median, for reads of three windows or more."""
    low = mad_outliers(identity_windows(records, size), "read", "identity", k, drop)
    start = F.col("window") * size
    return low.select("read", start.alias("start"), F.least(start + size, "read_len").alias("end"), "identity", "median")


def error_by_distance(records: DataFrame, near: int = 50) -> DataFrame:
    """``end_kind, bin, positions, mismatches, ins_events, del_events`` by power-of-two distance from the nearer end of the alignment.

    An end is ``read_end`` if less than ``near`` bases are clipped there, ``junction`` if another range of the
    read begins or ends near it, else ``clipped``. Positions are counted by rule, not one by one.
    ``records (read, read_len, reverse, cigar)`` holds the primary and supplementary ones; the ranges of
    a read are gathered in an array of it, so its records bound that.
    """
    # the string is tested beside its parsed form: a filter would be pushed below and have the string made anew for each test
    span = F.when(~F.col("cigar").isin("", "*"), cigar.query_range(F.col("_ops"), F.col("reverse")))
    rows = records.select("read", "read_len", "reverse", "cigar", cigar.parse(F.col("cigar")).alias("_ops")).withColumn("_own", span).drop("_ops")
    rows = rows.withColumn("_others", F.collect_set("_own").over(Window.partitionBy("read"))).where("_own is not null")
    lead = F.when(F.col("reverse"), F.col("read_len") - F.col("_own.end")).otherwise(F.col("_own.start"))
    trail = F.when(F.col("reverse"), F.col("_own.start")).otherwise(F.col("read_len") - F.col("_own.end"))

    def kind(clip: Column, border: Column) -> Column:
        close = lambda o: (F.abs(o["start"] - border) < near) | (F.abs(o["end"] - border) < near)
        other = F.exists(F.col("_others"), lambda o: (o != F.col("_own")) & close(o))
        return F.when(clip < near, "read_end").when(other, "junction").otherwise("clipped")

    forward = lambda at: F.when(F.col("reverse"), F.col("read_len") - at).otherwise(at)
    a0, a1 = lead, F.col("read_len") - trail
    rows = rows.select("cigar", a0.alias("a0"), a1.alias("a1"), kind(lead, forward(a0)).alias("k0"), kind(trail, forward(a1)).alias("k1"))

    half = F.floor((F.col("a1") - F.col("a0") - 1) / 2)
    last = F.explode(F.array(F.struct(F.col("k0").alias("end_kind"), half.alias("m")), F.struct(F.col("k1").alias("end_kind"), (F.col("a1") - F.col("a0") - 2 - half).alias("m"))))
    bins = F.concat(F.array(F.lit(0).cast("long")), F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.length(F.bin("m")) - 1), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(F.array().cast("array<bigint>")))
    exposed = rows.select(last.alias("e")).select("e.end_kind", "e.m").where("m >= 0").withColumn("bin", F.explode(bins))
    held = F.when(F.col("bin") == 0, 1).otherwise(F.least(2 * F.col("bin") - 1, "m") - F.col("bin") + 1)
    exposed = exposed.select("end_kind", "bin", F.lit("positions").alias("what"), held.alias("n"))

    s = steps(rows, ["a0", "a1", "k0", "k1"]).where(F.col("op").isin("X", "I", "D") & (F.col("len") > 0))
    at = F.explode(F.when(F.col("op") == "X", F.sequence(F.col("q"), F.col("q") + F.col("len") - 1)).otherwise(F.array("q")))
    s = s.withColumn("at", at).withColumns({"dl": F.col("at") - F.col("a0"), "dr": F.col("a1") - 1 - F.col("at")})
    what = F.when(F.col("op") == "X", "mismatches").when(F.col("op") == "I", "ins_events").otherwise("del_events")
    found = s.select(F.when(F.col("dl") <= F.col("dr"), F.col("k0")).otherwise(F.col("k1")).alias("end_kind"), size_band(F.greatest(F.least("dl", "dr"), F.lit(0))).alias("bin"), what.alias("what"), F.lit(1).alias("n"))
    total = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w)
    return exposed.unionByName(found).groupBy("end_kind", "bin").agg(*(total(w) for w in ("positions", "mismatches", "ins_events", "del_events")))


#: Steps of a read in a tile; records are dealt out and walked by tile, so a long or hot read is many tasks'.
TILE = 1 << 17
_NULL = np.iinfo(np.int64).min
_OWN = ("read", "_tile", "_side", "rank", "chrom", "reverse", "rs", "read_len", "cigar")


def _dealt(records: DataFrame, span: int, order: list[str]) -> DataFrame:
    """``records`` with ``_part, _tile``, a row for each tile of ``span`` bases of the forward read that a record may touch, dealt out and sorted by read and tile.

    Bases before the first belong to it. The CIGAR is parsed only where its numbers or the read's length may reach beyond the first tile.
    """
    prepare(records.sparkSession)
    ops = cigar.parse(F.col("cigar"))
    clip = F.get(ops, F.lit(0))
    start, end = F.when(clip["op"].isin("S", "H"), clip["len"]).otherwise(0), cigar.query_length(ops)
    turned = F.coalesce("reverse", F.lit(False))
    tile = lambda at: F.greatest(F.floor(at / span), F.lit(0))
    first, last = tile(F.when(turned, F.col("read_len") - end).otherwise(start)), tile(F.when(turned, F.col("read_len") - start).otherwise(end))
    short = (F.length("cigar") <= 2 * span // 100_000) & ~F.col("cigar").rlike("[0-9]{6}") & (F.coalesce("read_len", F.lit(0)) <= span)
    zero = F.array(F.lit(0).cast("long"))
    tiles = F.when(short, zero).otherwise(F.coalesce(F.sequence(first, F.greatest(first, last)), zero))
    return records.select("*", F.posexplode(tiles).alias("_part", "_tile")).repartition("read", "_tile").sortWithinPartitions("read", "_tile", *order)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers in the order of the column's values, null first."""
    coded = column.dictionary_encode(null_encoding="mask")
    values = coded.dictionary.to_numpy(zero_copy_only=False)
    ranks = np.empty(len(values) + 1, np.int64)
    ranks[np.argsort(values)], ranks[-1] = np.arange(len(values)), -1
    return ranks[coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)]


def _groups(table: pa.RecordBatch) -> np.ndarray:
    """Numbers of the runs of equal read and tile in a sorted batch."""
    read = table["read"].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    tile = _numbers(table["_tile"])
    return np.cumsum(np.concatenate(([False], (read[1:] != read[:-1]) | (tile[1:] != tile[:-1]))))[: len(read)]


def _stacked(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if held is None else pa.concat_batches([held, batch])


def _walked(strings: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, operation, length, and the places on read and reference where it begins, as ``steps`` has them."""
    row, op, n = cigar.runs(strings)
    hard = np.where(np.concatenate(([True], row[1:] != row[:-1]))[: len(row)] & cigar.among(op, "H"), n, 0)
    lead = np.bincount(row, hard, len(strings)).astype(np.int64)[row]
    q = cigar.before(row, np.where(cigar.among(op, cigar.QUERY), n, 0)) + np.where(cigar.among(op, "H"), 0, lead)
    return row, op, n, q, cigar.before(row, np.where(cigar.among(op, cigar.REFERENCE), n, 0))


def _placements(table: pa.RecordBatch, group: np.ndarray, step: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record, t and pos of the record that counts at each t of a group's sides, and the number of that group and side; in the order of group, t and side."""
    row, op, n, q, r = _walked(table["cigar"])
    back, length, rs = _codes(table["reverse"].cast(pa.int8())), _numbers(table["read_len"]), _numbers(table["rs"])
    turned = table["reverse"].fill_null(False).to_numpy(zero_copy_only=False)
    use = cigar.among(op, cigar.ALIGNED) & ~(turned[row] & (length[row] == _NULL))
    row, n, q, r = row[use], n[use], q[use], r[use]
    f0 = np.where(turned[row], length[row] - q - n, q)
    first = -(-f0 // step) * step
    count = np.maximum(-(-(f0 + n - first) // step), 0)
    of = np.repeat(np.arange(len(row)), count)
    t = first[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    inside = np.maximum(t // span, 0) == _numbers(table["_tile"])[row[of]]
    of, t = of[inside], t[inside]
    rec = row[of]
    pos = np.where(rs[rec] == _NULL, _NULL, rs[rec] + r[of] + np.where(turned[rec], length[rec] - 1 - t, t) - q[of])
    side = group * 2 + _numbers(table["_side"])
    slot = t // step - (t.min(initial=0) // step)
    # records come by rank, so the first of a place is the one that counts, unless ranks are equal
    order = np.lexsort((side[rec], slot, group[rec])) if slot.max(initial=0) >= 1 << 40 else np.argsort((group[rec] * (slot.max(initial=0) + 1) + slot) * 2 + (side[rec] & 1), kind="stable")
    same = lambda o: (side[rec[o]][1:] == side[rec[o]][:-1]) & (t[o][1:] == t[o][:-1])
    rank = _numbers(table["rank"])
    again = same(order)
    if (again & (rank[rec[order]][1:] == rank[rec[order]][:-1])).any():
        order = np.lexsort((pos, back[rec], _codes(table["chrom"])[rec], rank[rec], side[rec], t, group[rec]))
        again = same(order)
    order = order[np.concatenate(([True], ~again))[: len(order)]]
    return rec[order], t[order], pos[order], side[rec[order]]


def lifted(records: DataFrame, step: int = 25, flip: bool = False) -> DataFrame:
    """``read, t, chrom, reverse, pos``: where the CIGAR strings place every ``step``-th base of the forward read; of several records the one of least ``rank`` counts.

    With ``flip`` the records belong to the reverse complement of the read, and positions and strands
    are given for the read itself. Records, not positions, are exchanged; a task holds a batch and, of the
    tile that goes on in the next, the records that count somewhere.
    """
    span = step * TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shown(table: pa.RecordBatch, rec: np.ndarray, t: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            at = pa.array(rec)
            return pa.record_batch([table["read"].take(at), pa.array(t), table["chrom"].take(at), table["reverse"].take(at), pa.array(pos, mask=pos == _NULL)], ["read", "t", "chrom", "reverse", "pos"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _stacked(held, batch)
            group = _groups(table)
            rec, t, pos, _ = _placements(table, group, step, span)
            done = np.searchsorted(group, group[-1])
            yield shown(table, *(v[rec < done] for v in (rec, t, pos)))
            held = table.take(pa.array(np.union1d(rec[rec >= done], [done])))
        if held is not None:
            yield shown(held, *_placements(held, _groups(held), step, span)[:3])

    rows = _sided(records, 0, flip)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("read", "chrom")}
    return _dealt(rows, span, ["rank"]).select(*_OWN).mapInArrow(run, f"read {kinds['read']}, t long, chrom {kinds['chrom']}, reverse boolean, pos long")


def _sided(records: DataFrame, side: int, flip: bool) -> DataFrame:
    rows = records.withColumns({"_side": F.lit(side), "reverse": F.col("reverse") != F.lit(flip)})
    return rows.select(*(c for c in _OWN if c != "_tile"))


def flipped_invariance(records: DataFrame, variants: DataFrame, step: int = 25) -> DataFrame:
    """``read, class, score``: reads against the records of their reverse complements, by ``lifted`` positions; a read placed by neither has no row.

    Both sides are dealt out and walked together, a tile of a read leaves a task as one row of counts.
    """
    span = step * TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
            group = _groups(table)
            rec, t, pos, side = _placements(table, group, step, span)
            chrom, back = _codes(table["chrom"]), _codes(table["reverse"].cast(pa.int8()))
            pair = (side[1:] == side[:-1] + 1) & (side[1:] & 1 == 1) & (t[1:] == t[:-1])
            a, b = rec[:-1][pair], rec[1:][pair]
            equal = (chrom[a] == chrom[b]) & (back[a] == back[b]) & (pos[:-1][pair] == pos[1:][pair])
            groups = int(group[-1]) + 1
            count = lambda at: np.bincount(at, minlength=groups)
            records_, sides = _numbers(table["_n"]), _numbers(table["_side"])
            sums = [count(group[a[equal]]), count(group[rec]) - count(group[a]), *(np.bincount(group, np.where(sides == k, records_, 0), groups).astype(np.int64) for k in (0, 1))]
            first = np.searchsorted(group, np.arange(groups))
            return group, rec, pa.record_batch([table["read"].take(pa.array(first)), *(pa.array(v, pa.int64()) for v in sums)], names)

        def counted(table: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
            return table.set_column(table.num_columns - 1, table.schema.field("_n"), pa.array(n))

        names = ["read", "agree", "either", "n_orig", "n_var"]
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            aligned = ~pc.is_in(batch["cigar"], pa.array([None, "", "*"], batch["cigar"].type)).to_numpy(zero_copy_only=False)
            table = _stacked(held, counted(batch, _numbers(batch["_n"]) * aligned))
            group, rec, sums = walk(table)
            yield sums.slice(0, sums.num_rows - 1)
            # of the last tile: the records that count somewhere and one of each side, which takes over the number of records
            done = int(np.searchsorted(group, group[-1]))
            sides = _numbers(table["_side"])[done:]
            keep = np.union1d(rec[rec >= done], done + np.unique(sides, return_index=True)[1])
            n = np.zeros(table.num_rows, np.int64)
            for k in np.unique(sides):
                n[done + int(np.argmax(sides == k))] = sums[3 + int(k)][-1].as_py()
            held = counted(table, n).take(pa.array(keep))
        if held is not None:
            yield walk(held)[2]

    both = _sided(records, 0, False).unionByName(_sided(variants, 1, True))
    rows = _dealt(both, span, ["_side", "rank"])
    kind = both.schema["read"].dataType.simpleString()
    walked = rows.select(*_OWN, (F.col("_part") == 0).cast("long").alias("_n")).mapInArrow(run, f"read {kind}, agree long, either long, n_orig long, n_var long")
    sums = walked.groupBy("read").agg(*(F.sum(c).alias(c) for c in ("agree", "either", "n_orig", "n_var")))
    return invariance(sums.where("n_orig + n_var > 0"), F.lit(1))


def base_agreement(lhs: DataFrame, rhs: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """``read, agree_bp, differ_bp`` of records ``(read, chrom, reverse, qs, qe, rs, re)``: bases that both sides place within ``tolerance``, and the other aligned ones.

    A record places its read along a straight line. The distance of two such lines is linear, so it
    is within the tolerance on one interval; intervals are merged by read.
    """
    slope = (F.col("re") - F.col("rs")) / F.greatest(F.lit(1), F.col("qe") - F.col("qs"))
    m = F.when(F.col("reverse"), -slope).otherwise(slope)
    c = F.when(F.col("reverse"), F.col("re") + slope * F.col("qs")).otherwise(F.col("rs") - slope * F.col("qs"))
    side = lambda rows, p: rows.select("read", "chrom", "reverse", *(e.cast("double").alias(f"{p}_{n}") for e, n in ((F.col("qs"), "s"), (F.col("qe"), "e"), (m, "m"), (c, "c"))))
    pairs = side(lhs, "a").join(side(rhs, "b"), ["read", "chrom", "reverse"])
    pairs = pairs.select("read", F.greatest("a_s", "b_s").alias("lo"), F.least("a_e", "b_e").alias("hi"), (F.col("a_m") - F.col("b_m")).alias("dm"), (F.col("a_c") - F.col("b_c")).alias("dc")).where("lo < hi")
    x1, x2 = ((F.lit(sign * tolerance) - F.col("dc")) / F.col("dm") for sign in (-1, 1))
    level = F.abs(F.col("dm")) < 1e-12
    start = F.when(level, F.col("lo")).otherwise(F.greatest(F.col("lo"), F.least(x1, x2)))
    end = F.when(level, F.when(F.abs(F.col("dc")) <= tolerance, F.col("hi"))).otherwise(F.least(F.col("hi"), F.greatest(x1, x2)))
    length = lambda rows, name: merge(rows, ["read"]).groupBy("read").agg(F.rint(F.sum(F.col("end") - F.col("start"))).cast("long").alias(name))
    agree = length(pairs.select("read", start.alias("start"), end.alias("end")).where("start < end"), "agree_bp")
    every = lhs.select("read", "qs", "qe").unionByName(rhs.select("read", "qs", "qe")).where("qs < qe")
    aligned = length(every.select("read", F.col("qs").cast("double").alias("start"), F.col("qe").cast("double").alias("end")), "aligned")
    agreed = F.coalesce("agree_bp", F.lit(0))
    return aligned.join(agree, "read", "left").select("read", agreed.alias("agree_bp"), (F.col("aligned") - agreed).alias("differ_bp"))


def box_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, area``: the area that the boxes ``(chrom, reverse, qs, qe, rs, re)`` of a key cover together, on each chromosome and strand of its own.

    Boxes are cut at the read positions where any box of their plane begins or ends; in each
    slab the reference ranges are merged.
    """
    plane = [*keys, "chrom", "reverse"]
    boxes = boxes.where("qs < qe and rs < re").select(*plane, "qs", "qe", "rs", "re")
    cuts = boxes.select(*plane, F.explode(F.array("qs", "qe")).alias("lo")).distinct()
    slabs = cuts.withColumn("hi", F.lead("lo").over(Window.partitionBy(*plane).orderBy("lo"))).where("hi is not null")
    inside = slabs.join(boxes, plane).where("qs <= lo and hi <= qe").select(*plane, "lo", "hi", F.col("rs").alias("start"), F.col("re").alias("end"))
    covered = merge(inside, [*plane, "lo", "hi"])
    return covered.groupBy(*keys).agg(F.sum((F.col("hi") - F.col("lo")) * (F.col("end") - F.col("start"))).alias("area"))


def box_jaccard(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """``read, jaccard``: what two sides' boxes of a read share over what they cover together, as areas of read times reference."""
    apart = box_area(lhs.withColumn("side", F.lit(0)).unionByName(rhs.withColumn("side", F.lit(1))), ["read", "side"])
    sums = apart.groupBy("read").agg(F.sum("area").alias("apart"))
    union = box_area(lhs.unionByName(rhs), ["read"])
    return union.join(sums, "read").select("read", ((F.col("apart") - F.col("area")) / F.col("area")).alias("jaccard"))


def alignment_report(records: DataFrame, key: str, stratum: str) -> DataFrame:
    """``key, stratum, metric, value``: the report's alignment metrics by key, and by key and stratum (``all`` for the former), in one pass of grouping sets.

    ``records (qs, qe, mapq, primary, cigar)`` leaves the secondary ones out. A rate without a denominator is null.
    """
    records, ops = records.withColumn("_ops", cigar.parse(F.col("cigar"))), F.col("_ops")  # parsed once
    parts = {
        "n": F.lit(1), "q": F.col("qe") - F.col("qs"), "m": cigar.total(ops, "="), "x": cigar.total(ops, "X"), "ib": cigar.total(ops, "I"), "db": cigar.total(ops, "D"),
        "ie": cigar.events(ops, "I"), "de": cigar.events(ops, "D"), "p": F.col("primary").cast("int"), "p0": (F.col("primary") & (F.col("mapq") == 0)).cast("int"), "p20": (F.col("primary") & (F.col("mapq") >= 20)).cast("int"),
    }
    rows = records.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), *(c.cast("long").alias(n) for n, c in parts.items()))
    rolled = rows.groupingSets([[F.col("key")], [F.col("key"), F.col("stratum")]], F.col("key"), F.col("stratum")).agg(F.grouping("stratum").alias("_g"), *(F.sum(n).alias(n) for n in parts))
    v = {n: F.col(n) for n in parts}
    rates = {
        "aligned_query_bases": (v["q"], F.lit(1)), "identity": (v["m"], v["m"] + v["x"] + v["ib"] + v["db"]), "gap_compressed_identity": (v["m"], v["m"] + v["x"] + v["ie"] + v["de"]),
        "mismatches_per_kb": (1000 * v["x"], v["q"]), "ins_events_per_kb": (1000 * v["ie"], v["q"]), "del_events_per_kb": (1000 * v["de"], v["q"]),
        "primary_frac_mapq0": (v["p0"], v["p"]), "primary_frac_mapq_ge20": (v["p20"], v["p"]),
    }
    shown = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.when(b > 0, F.round(a / b, 6)).alias("value")) for name, (a, b) in rates.items())))
    return rolled.select("key", F.when(F.col("_g") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), shown.alias("x")).select("key", "stratum", "x.metric", "x.value")
