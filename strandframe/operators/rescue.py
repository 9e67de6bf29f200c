"""Rescue of deferred seeds: k-mers too frequent to be looked up at once fill the long stretches of a read that no direct seed covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialize
from .intervals import contains_point, uncovered
from .seeds import lookup, route

#: Rounds of splitting that one job makes; rows are exchanged once a job.
ROUNDS = 4


def _round(rows: DataFrame, keys: list[str], k: int, spacing: int) -> DataFrame:
    """One round over ``*keys, start, end, pos, n_hits, picked``: the rarest position of each open gap is picked, the others move to what is left of the gap.

    Of equally rare positions the leftmost. A position that the picked k-mer overlaps, or whose new gap is
    ``spacing`` or less, is dropped.
    """
    best = F.min(F.struct("n_hits", "pos")).over(Window.partitionBy(*keys, "start", "end"))["pos"]
    rows = rows.withColumn("_best", F.when(~F.col("picked"), best))
    left, right = F.col("pos") + k <= F.col("_best"), F.col("pos") >= F.col("_best") + k
    low = F.when(left, F.col("start")).when(right, F.col("_best") + k)
    high = F.when(left, F.col("_best")).when(right, F.col("end"))
    now = F.col("picked") | (F.col("pos") == F.col("_best"))
    moved = rows.select(*keys, F.when(~now, low).alias("start"), F.when(~now, high).alias("end"), "pos", "n_hits", now.alias("picked"))
    return moved.where(F.col("picked") | (F.col("end") - F.col("start") > spacing))


def split_gaps(gaps: DataFrame, positions: DataFrame, keys: list[str], k: int, spacing: int = 500, rounds: int | None = None) -> DataFrame:
    """``*keys, pos, n_hits`` of the positions picked: in each gap over ``spacing`` the rarest k-mer, then again on both sides of it.

    ``gaps (*keys, start, end)`` do not overlap; ``positions (*keys, pos, n_hits)``: deferred k-mers, one row a place.
    Positions meet their gap once, by bins; after that a round is a window within gaps, which the read's length
    bounds. ROUNDS of them share one exchange, and what is still open is written to the shared folder, so a
    job's plan does not grow. ``rounds`` stops early; None goes on until no gap holds a position.
    """
    width = max(spacing, 1)
    held = contains_point(positions, gaps.where(F.col("end") - F.col("start") > spacing), keys, "pos", width).where(F.col("pos") + k <= F.col("end"))
    held = held.select(*keys, "start", "end", "pos", "n_hits", F.lit(False).alias("picked"))
    done, out = 0, []
    while rounds is None or done < rounds:
        step = ROUNDS if rounds is None else min(ROUNDS, rounds - done)
        held = held.where(~F.col("picked")).repartition(*keys)
        for _ in range(step):
            held = _round(held, keys, k, spacing)
        held = materialize(held, "rescue")
        out.append(held.where("picked").select(*keys, "pos", "n_hits"))
        done += step
        if held.where(~F.col("picked")).isEmpty():
            break
    picked = out[0]
    for more in out[1:]:
        picked = picked.unionByName(more)
    if len(out) > 2:  # many small tables become one
        files, picked = held, materialize(picked, "rescued")
        discard(files)
    return picked


def rescue(kmers: DataFrame, lengths: DataFrame, index: DataFrame, read: str, k: int, direct: int = 50, most: int = 500, spacing: int = 500) -> DataFrame:
    """Hits of the direct k-mers and of the rescued ones: columns of ``kmers`` and ``index``, and ``rescued``.

    ``kmers (read, pos, kmer)``, ``lengths (read, length)``, ``index (kmer, ..., n_hits)``; an index that holds both
    strands has the k-mers of the reverse strand turned, so ``pos`` is a place of the read as it is. K-mers of up
    to ``direct`` loci are looked up; those of up to ``most`` are deferred, and looked up only where one is picked
    in a stretch of over ``spacing`` bases without a direct hit (read ends included). Both strands of a picked place come.
    """
    routed = route(index, direct, most).where("tier <> 'dropped'")
    first = lookup(kmers, routed.where("tier = 'direct'").drop("tier"))
    later = routed.where("tier = 'deferred'").drop("tier")
    deferred = kmers.join(later.select("kmer", "n_hits").distinct(), "kmer").groupBy(read, "pos").agg(F.min("n_hits").alias("n_hits"))
    gaps = uncovered(first.select(read, F.col("pos").alias("start"), (F.col("pos") + k).alias("end")), lengths, [read], "length")
    picked = split_gaps(gaps, deferred, [read], k, spacing).select(read, "pos")
    again = lookup(kmers.join(picked, [read, "pos"], "left_semi"), later)
    return first.withColumn("rescued", F.lit(False)).unionByName(again.withColumn("rescued", F.lit(True)))
