"""Alignment records of reads' parts: bounds of chained seeds, clips, flags, SA tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar
from ..functions.sequence import revcomp
from .alignment import global_align
from .reference import WIDTH, windows

REVERSE, SUPPLEMENTARY, UNMAPPED = 0x10, 0x800, 0x4


def bounds(seeds: DataFrame, read: str = "read") -> DataFrame:
    """Exact-match seeds of a chain trimmed so that no read base is in two of them; ``seeds (read, step, chrom, reverse, read_start, read_end, ref_start)``.

    Of two that overlap the earlier loses its right end first; what is left over goes off the later one's
    left end. So a seed begins at the furthest start so far and ends where the next one begins. The
    reference start moves with the end that lies low on the reference.
    """
    w = Window.partitionBy(read).orderBy("step")
    first = F.max("read_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.greatest(F.least("read_end", F.coalesce(F.lead("read_start").over(w), F.col("read_end"))), first)
    rows = seeds.withColumns({"_first": first, "_last": last})
    low = F.when(F.col("reverse"), F.col("read_end") - F.col("_last")).otherwise(F.col("_first") - F.col("read_start"))
    return rows.select(read, "step", "chrom", "reverse", F.col("_first").alias("read_start"), F.col("_last").alias("read_end"), (F.col("ref_start") + low).alias("ref_start"))


def apart(parts: DataFrame, read: str = "read") -> DataFrame:
    """Parts of a read that share none of its bases: of two that overlap the later one begins where the earlier ends.

    ``parts (read, part, reverse, read_start, read_end, ref_start, ref_end, ...)`` begin and end with exact matches that
    reach beyond the overlap, as chains of seeds do, so the reference moves base by base with the read.
    """
    w = Window.partitionBy(read).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = F.greatest(F.coalesce(F.max("read_end").over(w) - F.col("read_start"), F.lit(0)), F.lit(0))
    cut = F.least(over, F.col("read_end") - F.col("read_start"), F.col("ref_end") - F.col("ref_start"))
    moved = {"read_start": F.col("read_start") + F.col("_cut"), "ref_start": F.col("ref_start") + F.when(F.col("reverse"), 0).otherwise(F.col("_cut")), "ref_end": F.col("ref_end") - F.when(F.col("reverse"), F.col("_cut")).otherwise(0)}
    return parts.withColumn("_cut", cut).select(*(moved[c].alias(c) if c in moved else F.col(c) for c in parts.columns))


def align_parts(parts: DataFrame, reads: DataFrame, blocks: DataFrame, read: str = "read", width: int = WIDTH) -> DataFrame:
    """``parts (read, part, chrom, reverse, read_start, read_end, ref_start, ref_end, ...)`` with ``cigar, seq, read_len``.

    Each part's bases (``seq``, turned round on the reverse strand) are aligned to the reference between its ends,
    which comes from the blocks. Parts without a read or contig are left out.
    """
    keys = [read, "part"]
    rows = parts.join(reads.select(read, F.col("seq").alias("_seq")), read)
    piece = F.substring("_seq", (F.col("read_start") + 1).cast("int"), (F.col("read_end") - F.col("read_start")).cast("int"))
    rows = rows.withColumns({"seq": F.when(F.col("reverse"), revcomp(piece)).otherwise(piece), "read_len": F.length("_seq").cast("long")})
    asked = rows.select(*keys, "chrom", F.col("ref_start").alias("start"), F.col("ref_end").alias("end"), "seq", "read_len")
    aligned = windows(asked, blocks, keys, ["seq", "read_len"], width).where(F.length("bases") > 0)
    aligned = aligned.withColumn("cigar", global_align(F.col("seq"), F.col("bases"))["cigar"]).drop("bases")
    return parts.join(aligned, keys)


def clipped(text: Column, left: Column, right: Column, reverse: Column) -> Column:
    """The CIGAR with hard clips for the read bases before and after the part, in the order of the reference."""
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("H"))).otherwise(F.lit(""))
    return F.concat(clip(F.when(reverse, right).otherwise(left)), text, clip(F.when(reverse, left).otherwise(right)))


def summary(ops: Column, left: Column, right: Column) -> Column:
    """The CIGAR of an SA entry: clips in read order, the aligned columns as one M, insertions less deletions as one I or D."""
    columns, more = cigar.total(ops, "M=X"), cigar.total(ops, "I") - cigar.total(ops, "D")
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise(F.lit(""))
    return F.concat(part(left, "H"), part(columns, "M"), part(more, "I"), part(-more, "D"), part(right, "H"))


def emit(parts: DataFrame, read: str = "read") -> DataFrame:
    """``read, part, flag, chrom, start, mapq, cigar, sa`` of ``parts (read, part, chrom, start, reverse, mapq, read_start, read_end, read_len, cigar)``.

    The first part in read order is the primary record, the others are supplementary. All read bases
    outside a part are hard clips. ``sa`` lists the read's other records in order, its positions from 0;
    null for a read of one record. A read's records are gathered, which its length bounds.
    """
    ops = cigar.parse(F.col("cigar"))
    left, right = F.col("read_start"), F.col("read_len") - F.col("read_end")
    entry = F.concat_ws(",", "chrom", F.col("start").cast("string"), F.when(F.col("reverse"), "-").otherwise("+"), summary(ops, left, right), F.col("mapq").cast("string"), cigar.edit_distance(ops).cast("string"))
    rows = parts.withColumn("_e", F.struct("part", entry.alias("entry")))
    rows = rows.withColumn("_all", F.sort_array(F.collect_list("_e").over(Window.partitionBy(read))))
    others = F.transform(F.filter("_all", lambda e: e["part"] != F.col("part")), lambda e: e["entry"])
    first = F.col("part") == F.array_min(F.transform("_all", lambda e: e["part"]))
    flag = F.when(F.col("reverse"), REVERSE).otherwise(0) + F.when(first, 0).otherwise(SUPPLEMENTARY)
    return rows.select(
        read, "part", flag.cast("int").alias("flag"), "chrom", "start", "mapq", clipped(F.col("cigar"), left, right, F.col("reverse")).alias("cigar"), F.when(F.size(others) > 0, F.array_join(others, ";")).alias("sa")
    )


def sa_entries(records: DataFrame, column: str = "sa") -> DataFrame:
    """One row for each entry of an SA tag: ``sa_chrom, sa_pos`` (as written) ``, sa_reverse, sa_cigar, sa_mapq, sa_nm`` beside the record's columns."""
    rows = records.where(F.col(column).isNotNull()).withColumn("_f", F.explode(F.transform(F.filter(F.split(column, ";"), lambda e: e != ""), lambda e: F.split(e, ","))))
    f = lambda i: F.get("_f", F.lit(i))
    return rows.select(
        *(c for c in records.columns if c != column), f(0).alias("sa_chrom"), f(1).cast("long").alias("sa_pos"), (f(2) == "-").alias("sa_reverse"), f(3).alias("sa_cigar"), f(4).cast("int").alias("sa_mapq"), f(5).cast("long").alias("sa_nm")
    )
