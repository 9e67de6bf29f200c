"""Checks of alignment records, and pieces of reads and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar


def problems(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """``read, rank, problem``: one row for each rule that a record breaks.

    Records ``read, rank, chrom, rs, mapq, cigar, seq_len``; contigs ``chrom, length``. All rules are
    columns of one pass, after a join with the contigs.
    """
    ops = cigar.parse(F.col("cigar"))
    known = records.join(contigs.select("chrom", F.col("length").alias("_length")), "chrom", "left").withColumn("_ops", ops)
    query = cigar.total(F.col("_ops"), cigar.QUERY)
    rules: dict[str, Column] = {
        "unknown_contig": F.col("_length").isNull(), "bad_cigar": cigar.text(F.col("_ops")) != F.col("cigar"), "query_length": query != F.col("seq_len"),
        "beyond_contig": (F.col("rs") < 0) | (F.col("rs") + cigar.reference_span(F.col("_ops")) > F.col("_length")), "mapq_range": ~F.col("mapq").between(0, 254),
        "inner_hard_clip": F.col("cigar").rlike(r"[MIDNS=XP][0-9]+H[0-9]"), "ends_in_gap": F.col("cigar").rlike(r"^([0-9]+[SH])*[0-9]+[DN]|[0-9]+[DN]([0-9]+[SH])*$"),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return known.select("read", "rank", F.explode(found).alias("problem"))


def tiles(reads: DataFrame, size: int, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """``parent, start, end, seq``: consecutive pieces of ``size``; a rest counts if it is half a piece or longer."""
    n = F.length(seq_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    cut = reads.select(F.col(id_col).alias("parent"), seq_col, n.alias("_n"), F.explode(starts).alias("start"))
    end = F.least(F.col("start") + size, F.col("_n"))
    return cut.withColumn("end", end).where((F.col("end") - F.col("start") == size) | ((F.col("end") - F.col("start")) * 2 >= size)).select("parent", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.substring(seq_col, F.col("start") + 1, F.lit(size)).alias("seq"))


def variant_sequences(variants: DataFrame) -> DataFrame:
    """``id, kind, start, end, seq``: what a variant (``id, pos`` from 1, ``ref, alt, info``) inserts, deletes or copies.

    An inserted sequence is the part of ALT after REF, or INSSEQ; deletions run from POS to END (or by
    SVLEN), duplications from POS - 1.
    """
    info = lambda k: F.col("info")[k]
    kind = F.coalesce(info("SVTYPE"), F.when(F.length("alt") > F.length("ref"), "INS").when(F.length("alt") < F.length("ref"), "DEL"))
    end = F.coalesce(info("END").cast("long"), F.col("pos") + F.abs(info("SVLEN").cast("long")))
    inserted = F.when((kind == "INS") & F.col("alt").rlike("^[ACGTNacgtn]+$") & F.startswith(F.col("alt"), F.col("ref")), F.expr("substring(alt, length(ref) + 1)"))
    seq = F.coalesce(F.nullif(inserted, F.lit("")), F.when(kind == "INS", info("INSSEQ")))
    start = F.when(kind == "DUP", F.col("pos") - 1).otherwise(F.col("pos"))
    return variants.select("id", kind.alias("kind"), start.alias("start"), F.when(kind == "INS", F.col("pos")).otherwise(end).alias("end"), seq.alias("seq")).where("kind is not null")


def truth_segments(reads: DataFrame, name: str = "name") -> DataFrame:
    """``name, chrom, start, end, reverse`` parsed from names like ``sim_1:chr1_100_200_+,chr2_5_90_-`` (from 1, ends included), as half-open."""
    part = F.explode(F.split(F.regexp_extract(name, r"^[^:]*:([^:]*)", 1), ","))
    field = lambda i: F.regexp_extract("p", r"^(.+)_([0-9]+)_([0-9]+)_([+-])$", i)
    rows = reads.select(name, part.alias("p")).where(F.col("p").rlike(r"^.+_[0-9]+_[0-9]+_[+-]$"))
    return rows.select(name, field(1).alias("chrom"), (field(2).cast("long") - 1).alias("start"), field(3).cast("long").alias("end"), (field(4) == "-").alias("reverse"))


def sample_by_alt(variants: DataFrame, each: int, seed: int = 42) -> DataFrame:
    """``each`` variants per ALT, drawn with weights ``af``: the smallest of -ln(u) / af. A sampling operator."""
    from pyspark.sql.window import Window

    key = -F.log(F.rand(seed)) / F.when(F.col("af") > 0, F.col("af"))
    rank = F.row_number().over(Window.partitionBy("alt").orderBy(F.col("_key").asc_nulls_last()))
    return variants.withColumn("_key", key).withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_key", "_rank")
