"""Segments of a read's alignment: spurious breaks bridged, overlapping neighbours merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar as cigar_
from ..functions.sequence import revcomp
from ..session import prepare
from .alignment import global_align
from .reference import WIDTH, windows

#: Gaps that are bridged at the most, what a break costs, overlaps that are always merged, and how much worse the loser of a longer one is.
MOST_GAP, PENALTY, FORCED, RATIO = 10_000, 30.0, 4000, 0.5

Ops = list[tuple[int, str]]


def collapse_breaks(chain: DataFrame, reads: DataFrame, reference: DataFrame, read: str = "read", penalty: float = PENALTY, most_gap: int = MOST_GAP, width: int = WIDTH) -> DataFrame:
    """``chain (read, place, chrom, reverse, read_start, read_end, ref_start, step)`` without detours that a plain alignment explains as well.

    ``step`` is how a seed follows the one before (``break`` or other), ``ref_start`` the low end of an exact match. A
    run of two or more breaks whose flanks lie on one chromosome and strand in order, with gaps of ``most_gap`` at
    the most, is bridged if the bases of the seeds within score less than ``penalty`` a break above the alignment
    of the flanks' gap; then the seeds go, the later flank's step is ``bridge`` and ``bridge_cigar`` has the alignment,
    in the order of the read. Runs of breaks share no seed but a flank. Windows within a read; only candidates
    are joined to reads and blocks.
    """
    prepare(chain.sparkSession)
    w = Window.partitionBy(read).orderBy("place")
    broken = F.coalesce(F.col("step") == "break", F.lit(False))
    rows = chain.withColumn("_b", broken)
    # a run begins where a break follows no break; seeds up to the next step without one belong to it
    rows = rows.withColumn("_run", F.sum((F.col("_b") & ~F.coalesce(F.lag("_b").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seed = F.struct("place", "chrom", "reverse", "read_start", "read_end", "ref_start")
    rows = rows.withColumn("_before", F.lag(seed).over(w))
    length = F.col("read_end") - F.col("read_start")
    runs = rows.where("_b").groupBy(read, "_run").agg(F.min_by("_before", "place").alias("l"), F.max_by(seed, "place").alias("r"), F.count("*").alias("n"), F.sum(length).alias("bases"))
    size = lambda s: F.col(f"{s}.read_end") - F.col(f"{s}.read_start")
    low, high = F.when(F.col("l.reverse"), F.col("r.ref_start") + size("r")).otherwise(F.col("l.ref_start") + size("l")), F.when(F.col("l.reverse"), F.col("l.ref_start")).otherwise(F.col("r.ref_start"))
    runs = runs.withColumns({"start": low, "end": high, "q0": F.col("l.read_end"), "q1": F.greatest("r.read_start", "l.read_end")})
    same = (F.col("l.chrom") == F.col("r.chrom")) & (F.col("l.reverse") == F.col("r.reverse"))
    asked = runs.where(same & (F.col("n") > 1) & (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") <= most_gap) & (F.col("q1") - F.col("q0") <= most_gap))
    asked = asked.join(reads.select(read, F.col("seq").alias("_seq")), read)
    piece = F.substring("_seq", (F.col("q0") + 1).cast("int"), (F.col("q1") - F.col("q0")).cast("int"))
    asked = asked.select(read, "_run", F.col("l.chrom").alias("chrom"), "start", "end", F.col("l.reverse").alias("back"), piece.alias("piece"), "n", (F.col("bases") - size("r")).alias("inner"), F.col("l.place").alias("from"), F.col("r.place").alias("to"))
    met = windows(asked, reference, [read, "_run"], ["back", "piece", "n", "inner", "from", "to"], width)
    scored = met.withColumn("a", global_align(F.col("piece"), F.when(F.col("back"), revcomp("bases")).otherwise(F.col("bases"))))
    bridged = scored.where(2 * F.col("inner") - cigar_.quality(cigar_.parse(F.col("a.cigar"))) < F.col("n") * F.lit(penalty)).select(F.col(read).alias("_read"), "from", "to", F.col("a.cigar").alias("bridge_cigar"))
    hit = (F.col(read) == F.col("_read")) & (F.col("place") > F.col("from")) & (F.col("place") <= F.col("to"))
    out = chain.join(bridged, hit, "left").where("`to` is null or place = `to`")
    return out.select(*(F.when(F.col("to").isNotNull(), "bridge").otherwise(F.col(c)).alias(c) if c == "step" else F.col(c) for c in chain.columns), "bridge_cigar")


def parse(cigar: str) -> Ops:
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def text(ops: Ops) -> str:
    """The string of the operations, empty ones left out and neighbours of one kind joined."""
    out: list[list] = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1][0] += n
        elif n:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


def total(ops: Ops, kinds: str) -> int:
    return sum(n for n, op in ops if op in kinds)


def cut(ops: Ops, at: int) -> tuple[Ops, Ops]:
    """The operations of the first ``at`` reference bases and those after; an insertion at the border comes after."""
    for i, (n, op) in enumerate(ops):
        if at == 0:
            return ops[:i], ops[i:]
        if op in "MDN=X":
            if n > at:
                return [*ops[:i], (at, op)], [(n - at, op), *ops[i + 1 :]]
            at -= n
    return ops, []


def identity(ops: Ops) -> float:
    """Matches over the longer of read and reference; 1 without either."""
    longest = max(total(ops, "=XI"), total(ops, "=XD"))
    return total(ops, "=") / longest if longest else 1.0


def merged(prev: dict, following: dict, ratio: float = RATIO, forced: int = FORCED) -> dict | None:
    """Two neighbours in read order as one segment, or None if they stay apart.

    They must lie on one chromosome and strand and overlap on the reference properly: the later begins within the
    earlier and goes on beyond it (mirrored on the reverse strand). Where one aligns worse over the overlap, by
    less than ``ratio`` of the other's identity, or at all if the overlap is under ``forced`` bases (the earlier loses
    a tie), its bases there and the read gap between the two become one insertion. CIGARs are in read order.
    """
    if (prev["chrom"], prev["reverse"]) != (following["chrom"], following["reverse"]) or following["read_start"] < prev["read_end"]:
        return None
    # on the reverse strand the same picture with the reference's sign turned
    a0, a1, b0, b1 = (prev["ref_start"], prev["ref_end"], following["ref_start"], following["ref_end"]) if not prev["reverse"] else (-prev["ref_end"], -prev["ref_start"], -following["ref_end"], -following["ref_start"])
    if not (a0 <= b0 < a1 < b1):
        return None
    left, right, over = parse(prev["cigar"]), parse(following["cigar"]), a1 - b0
    if total(left, "MDN=X") != a1 - a0 or total(right, "MDN=X") != b1 - b0:
        return None
    (head, x), (y, tail) = cut(left, a1 - a0 - over), cut(right, over)
    ix, iy = identity(x), identity(y)
    always = over < forced
    first_loses = always and ix <= iy or ix < iy * ratio
    if not first_loses and not (always and iy < ix or iy < ix * ratio):
        return None
    gap = following["read_start"] - prev["read_end"]
    middle = [(total(x, "MIS=X") + gap, "I"), *y] if first_loses else [*x, (total(y, "MIS=X") + gap, "I")]
    return prev | {"read_end": following["read_end"], "ref_start": min(prev["ref_start"], following["ref_start"]), "ref_end": max(prev["ref_end"], following["ref_end"]), "cigar": text([*head, *middle, *tail])}


def merge_overlaps(segments: DataFrame, read: str = "read", ratio: float = RATIO, forced: int = FORCED) -> DataFrame:
    """``segments (read, part, chrom, reverse, read_start, read_end, ref_start, ref_end, cigar)`` with neighbours merged as ``merged`` says; other columns are the first one's.

    From the first segment of a read on: a merged segment may merge with the next. Streamed by read; a task
    holds one segment back.
    """
    prepare(segments.sparkSession)
    schema = segments.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                one = merged(held, row, ratio, forced) if held is not None and held[read] == row[read] else None
                if one is None:
                    if held is not None:
                        out.append(held)
                    one = row
                held = one
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=batch.schema)

    return segments.repartition(read).sortWithinPartitions(read, "read_start", "part").mapInArrow(run, schema)
