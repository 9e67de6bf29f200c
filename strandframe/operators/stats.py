"""Rollups of alignments, reads and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar
from ..functions.scalars import size_band
from .intervals import merge


def indel_spectrum(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, kind, band, events, bases`` of the insertions and deletions of ``cigar``."""
    ops = alignments.select(*keys, F.explode(cigar.parse(F.col("cigar"))).alias("o")).where(F.col("o.op").isin("I", "D"))
    kind = F.when(F.col("o.op") == "I", "ins").otherwise("del")
    return ops.groupBy(*keys, kind.alias("kind"), size_band(F.col("o.len")).alias("band")).agg(F.count("*").alias("events"), F.sum("o.len").alias("bases"))


def split_events(alignments: DataFrame, read: str = "read", slack: int = 100, most: int = 10_000) -> DataFrame:
    """``read, kind, size``: indels implied by neighbouring colinear records of a read."""
    w = Window.partitionBy(read).orderBy("qs", "rank", "chrom", "reverse", "rs", "re")
    nxt = {c: F.lead(c).over(w) for c in ("chrom", "reverse", "qs", "rs", "re")}
    rows = alignments.select(read, "chrom", "reverse", "qe", "rs", "re", *(v.alias(f"n_{c}") for c, v in nxt.items()))
    gap_q = F.col("n_qs") - F.col("qe")
    gap_r = F.when(F.col("reverse"), F.col("rs") - F.col("n_re")).otherwise(F.col("n_rs") - F.col("re"))
    ok = (F.col("chrom") == F.col("n_chrom")) & (F.col("reverse") == F.col("n_reverse")) & gap_q.between(-slack, most) & gap_r.between(-slack, most) & (gap_r != gap_q)
    return rows.where(ok).select(read, F.when(gap_r > gap_q, "del").otherwise("ins").alias("kind"), F.abs(gap_r - gap_q).alias("size"))


def read_summary(alignments: DataFrame, read: str = "read") -> DataFrame:
    """``read, records, aligned_union, aligned_sum, interior_gap, clip5, clip3``."""
    union = merge(alignments.select(read, F.col("qs").alias("start"), F.col("qe").alias("end")), [read]).groupBy(read).agg(F.sum(F.col("end") - F.col("start")).alias("aligned_union"))
    sums = alignments.groupBy(read).agg(F.count("*").alias("records"), F.sum(F.col("qe") - F.col("qs")).alias("aligned_sum"), F.min("qs").alias("clip5"), F.max("qe").alias("last"), F.max("read_len").alias("length"))
    return sums.join(union, read).select(read, "records", "aligned_union", "aligned_sum", (F.col("last") - F.col("clip5") - F.col("aligned_union")).alias("interior_gap"), "clip5", (F.col("length") - F.col("last")).alias("clip3"))


def read_segments(alignments: DataFrame, read: str = "read") -> DataFrame:
    """``read, type, start, end``: the mapped islands of each read and what is left of, between and right of them."""
    lengths = alignments.groupBy(read).agg(F.max("read_len").alias("length"))
    w = Window.partitionBy(read).orderBy("start")
    islands = merge(alignments.select(read, F.col("qs").alias("start"), F.col("qe").alias("end")), [read]).join(lengths, read).withColumn("before", F.lag("end").over(w)).withColumn("after", F.lead("start").over(w))
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    parts = F.array(
        piece("mapped", F.col("start"), F.col("end")),
        F.when(F.col("before").isNull(), piece("left", F.lit(0), F.col("start"))).otherwise(piece("interior", F.col("before"), F.col("start"))),
        F.when(F.col("after").isNull(), piece("right", F.col("end"), F.col("length"))),
    )
    return islands.select(read, F.explode(parts).alias("p")).where("p is not null and p.end > p.start").select(read, "p.type", "p.start", "p.end")


def mad_outliers(df: DataFrame, key: str, value: str, k: float = 5.0, drop: float = 0.05, least: int = 3) -> DataFrame:
    """Rows under median - max(k * 1.4826 * MAD, drop) of their key, for keys of ``least`` rows or more."""
    center = df.groupBy(key).agg(F.median(value).alias("median"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = df.join(center, key)
    spread = rows.groupBy(key).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return rows.join(spread, key).where(F.col(value) < F.col("median") - F.greatest(k * 1.4826 * F.col("mad"), F.lit(drop)))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def quantiles(df: DataFrame, keys: list[str], value: str, n: int = 10) -> DataFrame:
    """The values at floor(q * (count - 1)) of each key's sorted values, for q = 0, 1/n, ..., 1.

    Ranks come from a sort within the key, so no key's values are gathered in one row.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.count("*") - 1).alias("_last"))
    wanted = sizes.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("_i", F.expr(f"(q * _last) div {n}"))
    return wanted.join(ranked, [*keys, "_i"]).select(*keys, "q", F.col(value).alias("value"))


def histogram(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.groupBy(*keys, value.cast("long").alias("bin")).agg(F.count("*").alias("count"))


def report(df: DataFrame, key: str, stratum: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``key, stratum, metric, value``: ratios of sums by key and by key and stratum (``all`` for the former), in one pass of grouping sets."""
    sums = [f(F.sum(c)).alias(f"{m}_{p}") for m, (a, b) in metrics.items() for p, c, f in (("a", a, F.coalesce), ("b", b, F.coalesce))]
    rolled = df.groupingSets([[F.col(key)], [F.col(key), F.col(stratum)]], F.col(key), F.col(stratum)).agg(F.grouping(stratum).alias("_g"), *sums)
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col(f"{m}_b") > 0, F.round(F.col(f"{m}_a") / F.col(f"{m}_b"), 6)).alias("value")) for m in metrics))).alias("x")
    return rolled.select(key, F.when(F.col("_g") == 1, "all").otherwise(F.col(stratum)).alias("stratum"), parts).select(key, "stratum", "x.metric", "x.value")


def pivot(rows: DataFrame, key: str) -> DataFrame:
    """One row per metric and stratum, one column per key value."""
    return rows.groupBy("metric", "stratum").pivot(key).agg(F.first("value"))


def quantile_filter(df: DataFrame, key: str, value: str, q: float = 0.75) -> DataFrame:
    """Rows whose value is at or above their key's exact ``q`` quantile, linearly interpolated."""
    cut = df.groupBy(key).agg(F.percentile(value, q).alias("cut"))
    return df.join(cut, key).where(F.col(value) >= F.col("cut"))
