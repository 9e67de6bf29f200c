"""Gaps between a read's seeds, scored in bits by aligning their bases, so that chaining can credit what stands in them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.sequence import revcomp
from .alignment import global_align
from .chain_programs import by_read
from .chaining import ORDER, SEED, ChainConfig
from .reference import WIDTH, windows


def nearest_before(s: dict[str, np.ndarray], c: ChainConfig) -> list[tuple]:
    """``seed, before, chrom, reverse, read_start, read_end, ref_start, ref_end`` of the gaps of one read's seeds, sorted by ORDER.

    Of the earlier seeds on a seed's chromosome and strand whose gap to it fits, the nearest in that order; those
    that end in reach of the read are one range of it.
    """
    out = []
    first = np.searchsorted(s["read_end"], s["read_start"] - c.gap_align_max, side="left")
    last = np.searchsorted(s["read_end"], s["read_start"] - c.gap_align_min, side="right")
    for i in np.flatnonzero(last > first):
        reach = slice(first[i], last[i])
        turned = bool(s["reverse"][i])
        gap = (s["entry"][i] - s["exit"][reach]) * (-1 if turned else 1)
        fits = (s["chrom"][reach] == s["chrom"][i]) & (s["reverse"][reach] == s["reverse"][i]) & (gap >= 0) & (gap <= c.gap_align_max)
        for j in first[i] + np.flatnonzero(fits)[-c.gap_align_nearest :]:
            low, high = sorted((int(s["exit"][j]), int(s["entry"][i])))
            out.append((int(i), int(j), int(s["chrom"][i]), turned, int(s["read_end"][j]), int(s["read_start"][i]), low, high))
    return out


def candidates(seeds: DataFrame, read: str = "read_id", config: ChainConfig = ChainConfig()) -> DataFrame:
    """The gaps of every read that are worth an alignment: ``read`` and the columns of ``nearest_before``.

    ``seeds`` as compound_seeds gives them; a seed's number is its place in ORDER, from 0. At most
    ``gap_align_nearest`` a seed: which seeds a chain may use is not known yet, so the nearest of all count.
    """
    schema = "seed long, before long, chrom long, reverse boolean, read_start long, read_end long, ref_start long, ref_end long"
    return by_read(seeds, read, SEED, ORDER, lambda _, s: nearest_before(s, config), schema).withColumnRenamed("read", read)


def scored(gaps: DataFrame, reads: DataFrame, blocks: DataFrame, read: str = "read_id", config: ChainConfig = ChainConfig(), width: int = WIDTH) -> DataFrame:
    """``read, seed, before, bits, cigar`` of ``candidates``: the bases of the read, turned round on the reverse strand, aligned to the reference's.

    ``reads (read, seq)``; the reference comes in blocks. A read or contig that is not there gives no row. Only the
    gap's bases of a read go on to the join with the blocks.
    """
    keys = [read, "seed", "before"]
    rows = gaps.join(reads.select(read, F.col("seq").alias("_seq")), read)
    piece = F.substring("_seq", (F.col("read_start") + 1).cast("int"), (F.col("read_end") - F.col("read_start")).cast("int"))
    asked = rows.select(*keys, "chrom", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), (F.col("ref_end") - F.col("ref_start")).alias("_n"), F.when(F.col("reverse"), revcomp(piece)).otherwise(piece).alias("_piece"))
    found = windows(asked.where("_piece IS NOT NULL"), blocks, keys, ["_n", "_piece"], width).where(F.length("bases") == F.col("_n"))
    aligned = found.select(*keys, global_align(F.col("_piece"), F.col("bases"))["cigar"].alias("cigar"))
    bits = cigar.alignment_bits(cigar.parse(F.col("cigar")), config.match_bits, config.mismatch_bits, config.gap_open_bits, config.gap_extend_bits)
    return aligned.select(*keys, bits.alias("bits"), "cigar")
