"""Pileups of alignments: per-position counts and the rollups made of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar
from ..session import prepare
from .intervals import contains_point

ALLELES = ("A", "C", "G", "T", "-")
MAX_DEPTH, DEPTH_BINS, AF_BINS = 1000, 5, 100


def _bases(seq: Column, upper: bool = False) -> Column:
    """One element a character; other letters than bases become N first, as splitting would halve those outside the basic plane."""
    plain = F.regexp_replace(seq, "[^ACGTacgt]", "N")  # before upper(), which makes two letters of some
    return F.split(F.upper(plain) if upper else plain, "")


def tallies(alignments: DataFrame, min_mapq: int = 20) -> DataFrame:
    """``chrom, pos, allele, n_all, n_q`` of ``alignments (chrom, start, mapq, cigar, seq)``: bases, ``-`` for deletions, ``+`` for insertions.

    One Arrow pass that counts within each batch, so a row leaves a task for each place and allele of a
    batch rather than for each base. An insertion counts at the reference base before it, and not at all
    at the start of an alignment; other letters than ACGT have no count.
    """
    code = np.full(256, len(ALLELES) + 1, np.int64)
    for i, base in enumerate("ACGT"):
        code[[ord(base), ord(base.lower())]] = i
    names = np.array([*ALLELES, "+"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str | None, list[np.ndarray]] = {}
            for chrom, start, mapq, text, seq in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or seq is None or start is None:
                    continue
                bases = code[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
                q, r, good = 0, start, int(mapq is not None and mapq >= min_mapq)
                for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text)):
                    if op in cigar.ALIGNED:
                        alleles = bases[q : q + n]
                        keep = np.flatnonzero(alleles < 4)
                        places, alleles = r + keep, alleles[keep]
                    elif op == "D":
                        places, alleles = np.arange(r, r + n), np.full(n, 4)
                    elif op == "I" and r > start:
                        places, alleles = np.array([r - 1]), np.array([5])
                    else:
                        places = alleles = np.zeros(0, np.int64)
                    if len(places):
                        found.setdefault(chrom, []).append((places << 4) + (alleles << 1) + good)
                    q += n * (op in cigar.QUERY)
                    r += n * (op in cigar.REFERENCE)
            for chrom, parts in found.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                both, first = np.unique(keys >> 1, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chrom] * len(both), pa.string()), pa.array(both >> 3), pa.array(names[both & 7], pa.string()), pa.array(np.add.reduceat(n, first)),
                        pa.array(np.add.reduceat(np.where(keys & 1, n, 0), first)),
                    ],
                    names=["chrom", "pos", "allele", "n_all", "n_q"],
                )

    prepare(alignments.sparkSession)
    rows = alignments.select(F.col("chrom").cast("string").alias("chrom"), F.col("start").cast("long").alias("start"), F.col("mapq").cast("int").alias("mapq"), "cigar", "seq")
    return rows.mapInArrow(run, "chrom string, pos long, allele string, n_all long, n_q long")


def counts(alignments: DataFrame, reference: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Counts per valid reference position and quality class (``all`` and ``q<n>``), zeros included.

    ``chrom, pos, ref, class, A, C, G, T, del, ins``. ``reference (chrom, seq)``; other letters than
    ACGT have no position.
    """
    seen = tallies(alignments, min_mapq)
    names = {"A": "A", "C": "C", "G": "G", "T": "T", "-": "del", "+": "ins"}
    wide = seen.groupBy("chrom", "pos").agg(*(F.coalesce(F.sum(F.when(F.col("allele") == a, F.col(n))), F.lit(0)).alias(f"{names[a]}_{n}") for a in names for n in ("n_all", "n_q")))
    places = reference.select("chrom", F.posexplode(_bases(F.col("seq"), True)).alias("pos", "ref")).withColumn("pos", F.col("pos").cast("long")).where(F.col("ref").isin("A", "C", "G", "T"))
    joined = places.join(wide, ["chrom", "pos"], "left")
    classes = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), *(F.coalesce(F.col(f"{v}_{n}"), F.lit(0)).cast("long").alias(v) for v in names.values())) for c, n in (("all", "n_all"), (f"q{min_mapq}", "n_q"))))).alias("x")
    return joined.select("chrom", "pos", "ref", classes).select("chrom", "pos", "ref", "x.*").withColumn("depth", F.col("A") + F.col("C") + F.col("G") + F.col("T") + F.col("del"))


def called(count: DataFrame, min_depth: int = 2, het: float = 0.2) -> DataFrame:
    """Adds to each position its two foremost alleles (ties: reference first, then A C G T -) and its shares."""
    sizes = dict(zip(ALLELES, ("A", "C", "G", "T", "del")))
    rank = F.array_sort(F.array(*(F.struct((-F.col(c)).alias("n"), (F.col("ref") != a).alias("other"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, (a, c) in enumerate(sizes.items()))))
    ref = F.coalesce(*(F.when(F.col("ref") == a, F.col(c)) for a, c in list(sizes.items())[:4]))
    rows = count.withColumn("_r", rank).withColumn("ref_count", ref)
    rows = rows.withColumns({"major": F.col("_r")[0]["a"], "major_count": -F.col("_r")[0]["n"], "minor": F.col("_r")[1]["a"], "minor_count": -F.col("_r")[1]["n"]}).drop("_r")
    ok = (F.col("depth") >= min_depth) & (F.col("depth") > 0)
    share = lambda n: F.when(ok, F.col(n) / F.col("depth"))
    depth_bin = F.least(F.lit(DEPTH_BINS - 1), F.length(F.bin(F.greatest(F.lit(1), F.floor(F.col("depth") / max(min_depth, 1))))) - 1)
    rows = rows.withColumns({"called": ok, "major_af": share("major_count"), "minor_af": share("minor_count"), "ins_af": F.least(F.lit(1.0), share("ins")), "depth_bin": F.when(ok, depth_bin)})
    return rows.withColumn("candidate", F.coalesce(F.col("minor_af") >= het, F.lit(False)))


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The nine counters per class and further keys."""
    s = lambda c: F.sum(c).cast("long")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("positions"), F.count_if("called").alias("called_positions"), s("depth").alias("depth_sum"), s("ref_count").alias("ref_sum"), s(F.col("depth") - F.col("ref_count") - F.col("del")).alias("mismatch_sum"),
        s("del").alias("del_sum"), s("ins").alias("ins_sum"), F.count_if(F.col("called") & (F.col("major") != F.col("ref"))).alias("major_nonref"), F.count_if("candidate").alias("candidate_sites"),
    )


def depth_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, F.least(F.col("depth"), F.lit(MAX_DEPTH)).cast("long").alias("bin")).agg(F.count("*").alias("count"))


def share_histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, depth_bin, kind, bin, count`` over the called positions; 100 bins for shares of major, minor and inserted alleles."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_af").alias("af")) for k in ("major", "minor", "ins")))).alias("x")
    bin_ = F.least(F.floor(F.col("x.af") * AF_BINS), F.lit(AF_BINS - 1)).cast("long").alias("bin")
    return rows.where("called").select(*keys, "depth_bin", kinds).groupBy(*keys, F.col("depth_bin").cast("long").alias("depth_bin"), F.col("x.kind").alias("kind"), bin_).agg(F.count("*").alias("count"))


def window_depth(count: DataFrame, lengths: DataFrame, window: int, min_mapq: int = 20) -> DataFrame:
    """``chrom, start, end, positions, mean_depth_all, mean_depth_q``; windows without a valid position are there with zeros. ``lengths (chrom, length)``."""
    at = (F.floor(F.col("pos") / window) * window).alias("start")
    sums = count.groupBy("chrom", at).agg(F.count_if(F.col("class") == "all").alias("positions"), *(F.sum(F.when(F.col("class") == c, F.col("depth"))).alias(n) for c, n in (("all", "a"), (f"q{min_mapq}", "q"))))
    grid = lengths.where("length > 0").select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1, F.lit(window).cast("long"))).alias("start"))
    mean = lambda c: F.round(F.coalesce(F.col(c) / F.col("positions"), F.lit(0.0)), 6)
    joined = grid.join(sums, ["chrom", "start"], "left")
    return joined.select("chrom", "start", F.least(F.col("start") + window, F.col("length").cast("long")).alias("end"), F.coalesce("positions", F.lit(0)).alias("positions"), mean("a").alias("mean_depth_all"), mean("q").alias("mean_depth_q"))


def disjoint(strata: DataFrame, width: int) -> DataFrame:
    """``chrom, start, end, stratum``: overlapping strata (``stratum, priority, chrom, start, end``) cut into pieces, each of the stratum of least priority that covers it."""
    held = strata.where("end > start")
    cuts = held.select("chrom", F.explode(F.array("start", "end")).alias("start")).distinct()
    pieces = cuts.withColumn("end", F.lead("start").over(Window.partitionBy("chrom").orderBy("start"))).where("end is not null")
    named = contains_point(pieces.select("chrom", F.col("start").alias("at"), F.col("end").alias("upto")), held, ["chrom"], "at", width)
    return named.groupBy("chrom", "at", "upto").agg(F.min_by("stratum", F.struct("priority", "stratum")).alias("stratum")).select("chrom", F.col("at").alias("start"), F.col("upto").alias("end"), "stratum")


def stratified(rows: DataFrame, strata: DataFrame, width: int = 1000, other: str = "other") -> DataFrame:
    """Positions ``chrom, pos, ...`` with the ``stratum`` of least priority that holds them, or ``other``; a position meets one piece at the most."""
    spread = disjoint(strata, width).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    spread = spread.select(F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end"), "stratum", "_bin")
    meet = (F.col("chrom") == F.col("_chrom")) & (F.floor(F.col("pos") / width) == F.col("_bin")) & (F.col("pos") >= F.col("_start")) & (F.col("pos") < F.col("_end"))
    return rows.join(spread, meet, "left").select(*rows.columns, F.coalesce("stratum", F.lit(other)).alias("stratum"))
