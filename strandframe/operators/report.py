"""Report metrics: named ratios of the summaries that other operators make, as rows ``key, metric, stratum, value``.

Every table is rolled up once, by key and, where it has strata, by key and stratum (``all`` for the former), and its
sums become rows. A ratio without a denominator has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands of long and short indels, distances that are interior and near an end.
LONG, SHORT, INTERIOR, NEAR = 64, 4, 1024, 32
ALL = "all"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def _sum(value: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))


def _long(sums: DataFrame, metrics: dict[str, Column], stratum: Column | None = None) -> DataFrame:
    """A row for each metric that has a value."""
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items())))
    out = sums.select("key", (stratum if stratum is not None else F.lit(ALL)).alias("stratum"), rows.alias("r"))
    return out.select("key", "r.metric", "stratum", "r.value").where("value is not null and not isnan(value)")


def _rolled(rows: DataFrame, stratum: str, sums: dict[str, Column]) -> tuple[DataFrame, Column]:
    """Sums by key, and by key and stratum, in one pass, and the column that names the stratum."""
    sets = [[F.col("key")], [F.col("key"), F.col(stratum)]]
    rolled = rows.groupingSets(sets, F.col("key"), F.col(stratum)).agg(F.grouping(stratum).alias("_g"), *(c.alias(n) for n, c in sums.items()))
    return rolled, F.when(F.col("_g") == 1, ALL).otherwise(F.col(stratum))


def read_metrics(reads: DataFrame) -> DataFrame:
    """Of ``key, read_len, mapped, aligned_union, aligned_sum, interior_gap, clip5, clip3, n_primary, n_supplementary, n_secondary, n_outlier_windows, split_events``: one row a read."""
    c, on = F.col, F.col("mapped")
    sums = reads.groupBy("key").agg(
        F.count("*").alias("n"), _sum(c("read_len")).alias("len"), F.count_if(on).alias("on"), _sum(c("aligned_union")).alias("u"), _sum(c("aligned_sum")).alias("s"), _sum(c("interior_gap")).alias("gap"),
        _sum(c("clip5") + c("clip3"), on).alias("clip"), _sum(c("n_primary") + c("n_supplementary"), on).alias("a"), F.count_if(on & (c("n_supplementary") > 0)).alias("split"), _sum(c("n_secondary"), on).alias("sec"),
        _sum(c("n_outlier_windows")).alias("w"), F.count_if(on & (c("n_outlier_windows") > 0)).alias("rw"), _sum(c("split_events")).alias("e"),
    )
    return _long(sums, {
        "reads": c("n"), "read_bases": c("len"), "frac_reads_mapped": _ratio(c("on"), c("n")), "frac_bases_aligned": _ratio(c("u"), c("len")), "frac_bases_multiply_aligned": _ratio(c("s") - c("u"), c("len")),
        "frac_bases_interior_gap": _ratio(c("gap"), c("len")), "frac_bases_end_clipped": _ratio(c("clip"), c("len")), "alignments_per_mapped_read": _ratio(c("a"), c("on")), "frac_mapped_reads_split": _ratio(c("split"), c("on")),
        "secondary_per_mapped_read": _ratio(c("sec"), c("on")), "outlier_windows_per_Mb_aligned": 1e6 * _ratio(c("w"), c("u")), "frac_reads_with_outlier_window": _ratio(c("rw"), c("on")), "split_indels_per_Mb_aligned": 1e6 * _ratio(c("e"), c("u")),
    })


def class_metrics(records: DataFrame) -> DataFrame:
    """Count, median length on the read and mean mapping quality of each class of ``key, class, qs, qe, mapq``; the median of lengths is exact."""
    length = F.col("qe") - F.col("qs")
    lengths = records.groupBy("key", "class", length.alias("v")).agg(F.count("*").alias("n"))  # counted first: a class is not one task's
    median = lengths.groupBy("key", "class").agg(F.expr("percentile(v, 0.5, n)").alias("median"))
    sums = records.groupBy("key", "class").agg(F.count("*").alias("n"), F.avg("mapq").alias("mapq")).join(median, ["key", "class"])
    named = lambda m: F.concat("class", F.lit(f"_{m}"))
    rows = F.explode(F.array(*(F.struct(named(m).alias("metric"), v.cast("double").alias("value")) for m, v in (("count", F.col("n")), ("median_qlen", F.col("median")), ("mean_mapq", F.col("mapq"))))))
    return sums.select("key", rows.alias("r")).select("key", "r.metric", F.lit(ALL).alias("stratum"), "r.value").where("value is not null")


def indel_metrics(indels: DataFrame, aligned: DataFrame) -> DataFrame:
    """Rates of long and short indels of ``key, class, kind (ins, del), band, source (cigar, split), events``, secondary records left out; ``aligned (key, bases)``."""
    c, main = F.col, F.coalesce(F.col("class") != "secondary", F.lit(True))
    parts = {f"{k}_{n}": _sum(c("events"), main & (c("kind") == k) & w) for k in ("ins", "del") for n, w in (("long", c("band") >= LONG), ("split", (c("band") >= LONG) & (c("source") == "split")), ("short", c("band") < SHORT))}
    sums = indels.groupBy("key").agg(*(v.alias(n) for n, v in parts.items())).join(aligned, "key")
    metrics = {}
    for k in ("ins", "del"):
        metrics |= {f"{k}_ge{LONG}_per_Mb": 1e6 * _ratio(c(f"{k}_long"), c("bases")), f"{k}_ge{LONG}_frac_as_split": _ratio(c(f"{k}_split"), c(f"{k}_long")), f"{k}_lt{SHORT}_per_kb": 1e3 * _ratio(c(f"{k}_short"), c("bases"))}
    return _long(sums, metrics)


def error_metrics(errors: DataFrame) -> DataFrame:
    """Error rates of ``key, end_kind, dist_bin, positions, mismatches, ins_events, del_events``: far from any end, and near each kind of end, also over the former."""
    wrong = F.col("mismatches") + F.col("ins_events") + F.col("del_events")
    far, near = F.col("dist_bin") >= INTERIOR, F.col("dist_bin") < NEAR
    by_kind = errors.groupBy("key", "end_kind").agg(_sum(wrong, far).alias("fe"), _sum(F.col("positions"), far).alias("fp"), _ratio(_sum(wrong, near), _sum(F.col("positions"), near)).alias("near"))
    base = by_kind.groupBy("key").agg(_ratio(F.sum("fe"), F.sum("fp")).alias("base"))
    both = by_kind.join(base, "key")
    named = lambda m: F.concat(F.lit(f"error_{m}_within{NEAR}_"), F.col("end_kind"))
    rows = F.explode(F.array(F.struct(named("rate").alias("metric"), F.col("near").alias("value")), F.struct(named("excess").alias("metric"), _ratio(F.col("near"), F.col("base")).alias("value"))))
    per = both.where("end_kind is not null").select("key", rows.alias("r")).select("key", "r.metric", F.lit(ALL).alias("stratum"), "r.value").where("value is not null")
    return _long(base, {"error_rate_interior": F.col("base")}).unionByName(per)


def invariance_metrics(classes: DataFrame) -> DataFrame:
    """Shares of the classes of ``key, variant, class, score, stratum`` and their mean score; of tiles (variants that begin with ``frag``) also the agreeing and the confidently disagreeing of each stratum."""
    c = F.col
    counts = classes.groupBy("key", "variant", "class").agg(F.count("*").alias("n"))
    totals = classes.groupBy("key", "variant").agg(F.count("class").alias("all"), F.avg("score").alias("mean"))
    named = lambda *m: F.concat("variant", F.lit("_"), *m)
    shares = counts.where("class is not null").join(totals, ["key", "variant"]).select("key", named(F.lit("frac_"), c("class")).alias("metric"), F.lit(ALL).alias("stratum"), _ratio(c("n"), c("all")).alias("value"))
    means = totals.select("key", named(F.lit("mean_score")).alias("metric"), F.lit(ALL).alias("stratum"), c("mean").alias("value"))
    tiles = classes.where(c("variant").startswith("frag") & c("stratum").isNotNull()).groupBy("key", "variant", "stratum").agg(F.count("*").alias("n"), *(F.count_if(c("class") == x).alias(x) for x in ("agree", "disagree_confident")))
    rows = F.explode(F.array(*(F.struct(named(F.lit(f"frac_{x}")).alias("metric"), _ratio(c(x), c("n")).alias("value")) for x in ("agree", "disagree_confident"))))
    split = tiles.select("key", "stratum", rows.alias("r")).select("key", "r.metric", "stratum", "r.value")
    return shares.unionByName(means).unionByName(split).where("value is not null")


def pileup_metrics(totals: DataFrame) -> DataFrame:
    """Ratios of pileup totals ``key, mapq_class, stratum, positions, called_positions, depth_sum, mismatch_sum, del_sum, ins_sum, candidate_sites, major_nonref``, by mapping-quality class, overall and by stratum."""
    names = ("positions", "called_positions", "depth_sum", "mismatch_sum", "del_sum", "ins_sum", "candidate_sites", "major_nonref")
    c = F.col
    keyed = totals.withColumn("key", F.struct("key", "mapq_class"))
    rolled, stratum = _rolled(keyed, "stratum", {n: _sum(c(n)) for n in names})
    metrics = {
        "mean_depth": _ratio(c("depth_sum"), c("positions")), "nonref_rate": _ratio(c("mismatch_sum") + c("del_sum"), c("depth_sum")), "ins_rate": _ratio(c("ins_sum"), c("depth_sum")),
        "candidate_sites_per_Mb": 1e6 * _ratio(c("candidate_sites"), c("called_positions")), "major_nonref_per_Mb": 1e6 * _ratio(c("major_nonref"), c("called_positions")), "frac_called": _ratio(c("called_positions"), c("positions")),
    }
    out = _long(rolled, metrics, stratum)
    return out.select(c("key.key").alias("key"), F.concat(F.lit("pileup_"), c("key.mapq_class"), F.lit("_"), c("metric")).alias("metric"), "stratum", "value")


def depth_metrics(histogram: DataFrame, windows: DataFrame) -> DataFrame:
    """Median and low shares of the depth histogram ``key, bin, count``, and the spread of window depths ``key, positions, depth``; windows without positions are left out."""
    from pyspark.sql.window import Window

    c = F.col
    bins = histogram.groupBy("key", "bin").agg(F.sum("count").alias("n"))  # one row a depth
    upto = bins.withColumns({"upto": F.sum("n").over(Window.partitionBy("key").orderBy("bin")), "all": F.sum("n").over(Window.partitionBy("key"))})
    median = upto.groupBy("key").agg(F.min(F.when(c("upto") * 2 >= c("all"), c("bin"))).alias("median"), F.max("all").alias("all"))
    low = bins.join(median, "key").groupBy("key", "median", "all").agg(_sum(c("n"), c("bin") == 0).alias("none"), _sum(c("n"), c("bin") < 0.2 * c("median")).alias("low"))
    first = _long(low, {"pileup_median_depth": c("median"), "pileup_frac_depth0": _ratio(c("none"), c("all")), "pileup_frac_depth_lt_0.2x_median": _ratio(c("low"), c("all"))})
    held = windows.where("positions > 0")
    counted = held.groupBy("key", "depth").agg(F.count("*").alias("n"))
    middle = counted.groupBy("key").agg(F.expr("percentile(depth, 0.5, n)").alias("median"))
    spread = held.join(middle.where("median > 0"), "key").groupBy("key").agg(F.stddev("depth").alias("sd"), F.avg("depth").alias("mean"), F.count("*").alias("n"), F.count_if(c("depth") > 3 * c("median")).alias("high"), F.count_if(c("depth") < 0.2 * c("median")).alias("low"))
    return first.unionByName(_long(spread, {"window_depth_cv": _ratio(c("sd"), c("mean")), "frac_windows_gt_3x_median": _ratio(c("high"), c("n")), "frac_windows_lt_0.2x_median": _ratio(c("low"), c("n"))}))
