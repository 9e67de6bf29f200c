"""Two sets of alignments against each other, against the truth, and the curation of their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts set by people, and buckets that are set by the comparison.
BY_HAND, BUCKETS = ("lhs", "rhs", "neither"), ("clip", "ends")


def fingerprints(alignments: DataFrame, read: str = "read") -> DataFrame:
    """``read, fingerprint, segments``: sorted ``chrom:rs-re:strand:qs-qe`` of a read, joined by semicolons."""
    part = F.concat("chrom", F.lit(":"), "rs", F.lit("-"), "re", F.lit(":"), F.when(F.col("reverse"), "-").otherwise("+"), F.lit(":"), "qs", F.lit("-"), "qe")
    return alignments.groupBy(read).agg(F.array_join(F.sort_array(F.collect_list(part)), ";").alias("fingerprint"), F.count("*").alias("segments"))


def outer(lhs: DataFrame, rhs: DataFrame, read: str = "read") -> DataFrame:
    """``read, state, lhs_fp, rhs_fp, lhs_n, rhs_n`` of every read of either side: lhs, rhs, agree or both. A true outer join."""
    a = fingerprints(lhs, read).select(read, F.col("fingerprint").alias("lhs_fp"), F.col("segments").alias("lhs_n"))
    b = fingerprints(rhs, read).select(read, F.col("fingerprint").alias("rhs_fp"), F.col("segments").alias("rhs_n"))
    state = F.when(F.col("rhs_fp").isNull(), "lhs").when(F.col("lhs_fp").isNull(), "rhs").when(F.col("lhs_fp") == F.col("rhs_fp"), "agree").otherwise("both")
    return a.join(b, read, "full_outer").select(read, state.alias("state"), F.coalesce("lhs_fp", F.lit("")).alias("lhs_fp"), F.coalesce("rhs_fp", F.lit("")).alias("rhs_fp"), F.coalesce("lhs_n", F.lit(0)).alias("lhs_n"), F.coalesce("rhs_n", F.lit(0)).alias("rhs_n"))


def end_difference(a: str, b: str, most: int = 100) -> Column:
    """Whether two alignments (struct columns) share chromosome and strand and all four ends lie within ``most``."""
    x, y = F.col(a), F.col(b)
    apart = F.greatest(*(F.abs(x[c] - y[c]) for c in ("qs", "qe", "rs", "re")))
    return (x["chrom"] == y["chrom"]) & (x["reverse"] == y["reverse"]) & (apart <= most)


def concordance(lhs: DataFrame, rhs: DataFrame, reads: DataFrame, read: str = "read", tolerance: int = 100) -> DataFrame:
    """``read, category``: nine ways two sets can agree on a read's alignments (``rank, chrom, reverse, rs`` each, first one primary).

    Alignments are matched in rank order, each to the alignment of its rank; unmatched ones make a partial match.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        one = F.struct("rank", "chrom", "reverse", "rs")
        return df.groupBy(read).agg(F.sort_array(F.collect_list(one)).alias(p))

    both = reads.select(read).distinct().join(side(lhs, "l"), read, "left").join(side(rhs, "r"), read, "left")
    a, b = F.col("l")[0], F.col("r")[0]
    near = lambda x, y: (x["chrom"] == y["chrom"]) & (x["reverse"] == y["reverse"]) & (F.abs(x["rs"] - y["rs"]) <= tolerance)
    all_near = F.forall(F.zip_with("l", "r", near), lambda v: v)
    category = (
        F.when(F.col("l").isNull() & F.col("r").isNull(), "both_unmapped").when(F.col("l").isNull(), "only_2_mapped").when(F.col("r").isNull(), "only_1_mapped")
        .when(a["chrom"] != b["chrom"], "discordant_chrom").when(a["reverse"] != b["reverse"], "discordant_strand").when(F.abs(a["rs"] - b["rs"]) > tolerance, "discordant_pos")
        .when(F.size("l") != F.size("r"), "different_count").when(all_near, "concordant").otherwise("partial_match")
    )
    return both.select(read, category.alias("category"))


def truth_outcome(truth: DataFrame, alignments: DataFrame, read: str = "read", tolerance: int = 50) -> DataFrame:
    """``read, outcome``: OK if the primary is where the truth says, SECONDARY if only another is, MISMATCH, or UNMAPPED without a primary."""
    t = truth.select(read, F.col("chrom").alias("t_chrom"), F.col("reverse").alias("t_reverse"), F.col("rs").alias("t_rs"), F.col("re").alias("t_re"))
    hit = (F.col("chrom") == F.col("t_chrom")) & (F.col("reverse") == F.col("t_reverse")) & (F.abs(F.col("rs") - F.col("t_rs")) <= tolerance) & (F.abs(F.col("re") - F.col("t_re")) <= tolerance)
    joined = t.join(alignments, read, "left").groupBy(read).agg(F.max(F.col("rank") == 1).alias("mapped"), F.max((F.col("rank") == 1) & hit).alias("first"), F.max(hit).alias("any"))
    outcome = F.when(~F.coalesce("mapped", F.lit(False)), "UNMAPPED").when(F.col("first"), "OK").when(F.col("any"), "SECONDARY").otherwise("MISMATCH")
    return joined.select(read, outcome.alias("outcome"))


def confusion(a: DataFrame, b: DataFrame, read: str = "read") -> DataFrame:
    """``a, b, count``: how often outcome a of one set meets outcome b of the other."""
    return a.select(read, F.col("outcome").alias("a")).join(b.select(read, F.col("outcome").alias("b")), read).groupBy("a", "b").agg(F.count("*").alias("count"))


def curate(existing: DataFrame, compared: DataFrame) -> DataFrame:
    """Merges a comparison (``read_name, state, lhs_fp, rhs_fp``) into a curation table, as a new table.

    ``read_name, verdict, lhs_fingerprint, rhs_fingerprint, notes``. Agreement sets ``agree``; a bucket is
    set unless a person has judged the read; a disagreement starts ``uncurated``, and goes back to it if
    the verdict was not a person's or the left fingerprint has changed. Other rows stay as they are.
    """
    both = existing.join(compared, "read_name", "full_outer")
    by_hand = F.col("verdict").isin(*BY_HAND)
    reset = F.col("verdict").isin("agree", *BUCKETS) | ((F.col("lhs_fingerprint") != F.col("lhs_fp")) & (F.col("verdict") != "uncurated"))
    verdict = (
        F.when(F.col("state").isNull(), F.col("verdict")).when(F.col("state").isin(*BUCKETS), F.when(by_hand, F.col("verdict")).otherwise(F.col("state")))
        .when(F.col("state") == "agree", "agree").when(F.col("verdict").isNull() | reset, "uncurated").otherwise(F.col("verdict"))
    )
    return both.select("read_name", verdict.alias("verdict"), F.coalesce("lhs_fp", "lhs_fingerprint").alias("lhs_fingerprint"), F.coalesce("rhs_fp", "rhs_fingerprint").alias("rhs_fingerprint"), F.coalesce("notes", F.lit("")).alias("notes"))


def invariance(sampled: DataFrame, n: Column) -> DataFrame:
    """Classes of reads by how far two placements agree: ``read, agree, either, n_orig, n_var`` gives ``read, class, score``."""
    score = F.when(F.col("either") > 0, F.col("agree") / F.col("either"))
    cls = (
        F.when((F.col("n_orig") == 0) & (F.col("n_var") == 0), "both_unmapped").when(F.col("n_var") == 0, "orig_only").when(F.col("n_orig") == 0, "variant_only").when(F.col("either") == 0, "disjoint")
        .when((score == 1) & (F.col("n_orig") == F.col("n_var")), "identical").when(score >= 0.95, "near").when(score > 0, "partial").otherwise("disjoint")
    )
    return sampled.select("read", cls.alias("class"), F.round(score, 4).alias("score"))


def tile_invariance(sums: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Classes of tiles: ``read, tile, agree, either, n_o, n_v, mapq`` gives ``parent, tile, class, score``. n_o, n_v: placed positions of parent and tile."""
    score = F.col("agree") / F.col("either")
    cls = (
        F.when((F.col("n_o") == 0) & (F.col("n_v") == 0), "both_unaligned").when(F.col("n_o") == 0, "parent_unaligned").when(F.col("n_v") == 0, "unaligned").when(score >= 0.9, "agree")
        .when(score > 0, "partial").when(F.col("mapq") >= min_mapq, "disagree_confident").otherwise("disagree_lowmapq")
    )
    return sums.select(F.col("read").alias("parent"), "tile", cls.alias("class"), F.round(score, 4).alias("score"))


def matched(l: str, r: str, tolerance: int) -> Column:
    """Whether the placements of two arrays (``chrom, reverse, rs``) match one to one in any order: each of the left, in turn, takes the first that is left and near."""
    near = lambda x, y: (x["chrom"] == y["chrom"]) & (x["reverse"] == y["reverse"]) & (F.abs(x["rs"] - y["rs"]) <= tolerance)

    def take(state: Column, x: Column) -> Column:
        at = F.array_position(F.transform(state["left"], lambda y: near(x, y)), F.lit(True)).cast("int")
        rest = F.concat(F.slice(state["left"], 1, F.greatest(at - 1, F.lit(0))), F.slice(state["left"], at + 1, F.size(state["left"])))
        return F.struct(F.when(at > 0, rest).otherwise(state["left"]).alias("left"), (state["ok"] & (at > 0)).alias("ok"))

    return F.aggregate(l, F.struct(F.col(r).alias("left"), F.lit(True).alias("ok")), take, lambda s: s["ok"] & (F.size(s["left"]) == 0))


def concordance_any_order(lhs: DataFrame, rhs: DataFrame, reads: DataFrame, read: str = "read", tolerance: int = 100) -> DataFrame:
    """``read, category`` as ``concordance`` gives it, but the placements of a read are matched in any order.

    The first of each side (least ``rank``) decides on chromosome, strand and position; with as many placements on
    both sides they are concordant if each finds a partner of its own within ``tolerance``. A read's placements
    are one array, which its length bounds.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(read).agg(F.sort_array(F.collect_list(F.struct("rank", "chrom", "reverse", "rs"))).alias(p))

    both = reads.select(read).distinct().join(side(lhs, "l"), read, "left").join(side(rhs, "r"), read, "left")
    a, b = F.col("l")[0], F.col("r")[0]
    category = (
        F.when(F.col("l").isNull() & F.col("r").isNull(), "both_unmapped").when(F.col("l").isNull(), "only_2_mapped").when(F.col("r").isNull(), "only_1_mapped")
        .when(a["chrom"] != b["chrom"], "discordant_chrom").when(a["reverse"] != b["reverse"], "discordant_strand").when(F.abs(a["rs"] - b["rs"]) > tolerance, "discordant_pos")
        .when(F.size("l") != F.size("r"), "different_count").when(matched("l", "r", tolerance), "concordant").otherwise("partial_match")
    )
    return both.select(read, category.alias("category"))


def interval_measures(lhs: DataFrame, rhs: DataFrame, read: str = "read", width: int = 1000) -> DataFrame:
    """How two sets of records cover each read: ``read, read_len``, for each side (``a_, b_``) ``n_primary, n_secondary, primary_frac, secondary_frac, mapq, chrom``, and the shares of a side's primary bases that the other's primary or secondary records place alike.

    Records ``read, read_len, chrom, reverse, qs, qe, mapq, secondary, supplementary``; ranges of the read count once
    for each chromosome and strand. A read of one side only has zeros on the other; ``chrom`` is that of its primary record
    (the least of several), or a dot.
    """
    from .intervals import merge, shared_length

    place = [read, "chrom", "reverse", "secondary"]
    frac = lambda n, d: F.when(F.coalesce(d, F.lit(0)) > 0, F.coalesce(n, F.lit(0)) / d).otherwise(F.lit(0.0))

    def side(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        spans = df.select(read, "chrom", "reverse", "secondary", F.col("qs").alias("start"), F.col("qe").alias("end"))
        covered = merge(spans, place).groupBy(read).agg(*(F.sum(F.when(F.col("secondary") == s, F.col("end") - F.col("start"))).alias(f"{p}_{n}") for s, n in ((False, "primary"), (True, "secondary"))))
        counts = df.groupBy(read).agg(
            F.max("read_len").alias(f"{p}_len"), F.count_if(~F.col("secondary")).alias(f"{p}_n_primary"), F.count_if("secondary").alias(f"{p}_n_secondary"),
            F.coalesce(F.max(F.when(~F.col("secondary"), F.col("mapq"))), F.lit(0)).alias(f"{p}_mapq"), F.coalesce(F.min(F.when(~F.col("secondary") & ~F.col("supplementary"), F.col("chrom"))), F.lit(".")).alias(f"{p}_chrom"),
        )
        return counts.join(covered, read, "left"), spans

    (a, a_spans), (b, b_spans) = side(lhs, "a"), side(rhs, "b")
    both = a.join(b, read, "full_outer")
    pick = lambda spans, s: spans.where(F.col("secondary") == s).drop("secondary")
    for name, x, y in (("pp", pick(a_spans, False), pick(b_spans, False)), ("ps", pick(a_spans, False), pick(b_spans, True)), ("sp", pick(b_spans, False), pick(a_spans, True))):
        met = shared_length(x, y, [read, "chrom", "reverse"], width).groupBy(read).agg(F.sum("shared").alias(f"_{name}"))
        both = both.join(met, read, "left")
    length = F.coalesce("a_len", "b_len")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sides = [x for p in "ab" for x in (zero(f"{p}_n_primary"), zero(f"{p}_n_secondary"), frac(F.col(f"{p}_primary"), length).alias(f"{p}_primary_frac"), frac(F.col(f"{p}_secondary"), length).alias(f"{p}_secondary_frac"), zero(f"{p}_mapq"), F.coalesce(f"{p}_chrom", F.lit(".")).alias(f"{p}_chrom"))]
    shares = [frac(F.col(n), F.col(d)).alias(x) for n, d, x in (("_pp", "a_primary", "a_in_b_primary"), ("_pp", "b_primary", "b_in_a_primary"), ("_ps", "a_primary", "a_in_b_secondary"), ("_sp", "b_primary", "b_in_a_secondary"))]
    return both.select(read, length.alias("read_len"), *sides, *shares)


#: Fixed value: how far two ends may lie apart, on read and reference, to differ by clipping alone.
CLIP = 15


def _clip_end(longer: Column, shorter: Column, left: bool, most: int) -> Column:
    """Whether ``shorter`` ends where ``longer`` has its first mismatch or indel from that end of the read (structs ``qs, qe, rs, re, reverse, ops``)."""
    back = longer["reverse"]
    low = ~back if left else back  # the read's end lies at the low end of the reference
    q = shorter["qs"] - longer["qs"] if left else longer["qe"] - shorter["qe"]
    r = F.when(low, shorter["rs"] - longer["rs"]).otherwise(longer["re"] - shorter["re"])
    inward = F.filter(F.when(low, longer["ops"]).otherwise(F.reverse(longer["ops"])), lambda o: ~o["op"].isin("S", "H"))
    start = F.struct(F.lit(0).cast("long").alias("lead"), F.lit(None).cast("long").alias("size"))

    def step(s: Column, o: Column) -> Column:
        match = s["size"].isNull() & o["op"].isin("M", "=")
        return F.struct(F.when(match, s["lead"] + o["len"]).otherwise(s["lead"]).alias("lead"), F.when(s["size"].isNotNull() | match, s["size"]).otherwise(F.when(o["op"].isin("X", "I", "D"), o["len"]).otherwise(F.lit(-1))).alias("size"))

    found = F.aggregate(inward, start, step)
    return (q <= most) & (q == r) & F.coalesce((found["size"] > 0) & q.between(found["lead"], found["lead"] + found["size"]), F.lit(False))


def clip_difference(a: str, b: str, most: int = CLIP) -> Column:
    """Whether two alignments (structs ``chrom, reverse, qs, qe, rs, re, ops``) differ by where they are clipped only.

    At each end that differs on the read, the longer one goes on along the same diagonal for ``most`` bases at the most,
    and the shorter one stops at or within the first mismatch or indel that the longer one meets from there. Ends
    that are equal on the read are not compared on the reference.
    """
    x, y = F.col(a), F.col(b)
    left = F.when(x["qs"] == y["qs"], True).when(x["qs"] < y["qs"], _clip_end(x, y, True, most)).otherwise(_clip_end(y, x, True, most))
    right = F.when(x["qe"] == y["qe"], True).when(x["qe"] > y["qe"], _clip_end(x, y, False, most)).otherwise(_clip_end(y, x, False, most))
    return (x["chrom"] == y["chrom"]) & (x["reverse"] == y["reverse"]) & left & right


def outer_states(lhs: DataFrame, rhs: DataFrame, read: str = "read") -> DataFrame:
    """``read, state, lhs_n, rhs_n`` of every read of either side: lhs, rhs, agree, clip, ends or both.

    Records ``read, chrom, reverse, qs, qe, rs, re, cigar``. Reads whose records are the same on both sides agree; reads of
    one record each that differ by clipping alone, or by ends within 100 bases, are told apart from the rest. A true
    outer join: no read of either side is lost.
    """
    from ..functions import cigar

    fields = F.struct("chrom", "reverse", "qs", "qe", "rs", "re", cigar.parse(F.col("cigar")).alias("ops"))
    part = F.concat_ws(":", "chrom", F.col("rs").cast("string"), F.col("re").cast("string"), F.col("reverse").cast("string"), F.col("qs").cast("string"), F.col("qe").cast("string"))

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(read).agg(F.array_join(F.sort_array(F.collect_list(part)), ";").alias(f"_{p}"), F.count("*").alias(f"{p}_n"), F.first(fields).alias(p))

    both = side(lhs, "lhs").join(side(rhs, "rhs"), read, "full_outer")
    single = (F.col("lhs_n") == 1) & (F.col("rhs_n") == 1)
    state = (
        F.when(F.col("_rhs").isNull(), "lhs").when(F.col("_lhs").isNull(), "rhs").when(F.col("_lhs") == F.col("_rhs"), "agree")
        .when(single & clip_difference("lhs", "rhs"), "clip").when(single & end_difference("lhs", "rhs"), "ends").otherwise("both")
    )
    return both.select(read, state.alias("state"), F.coalesce("lhs_n", F.lit(0)).alias("lhs_n"), F.coalesce("rhs_n", F.lit(0)).alias("rhs_n"))


def curation_queue(curation: DataFrame, verdict: str = "uncurated") -> DataFrame:
    """Reads that wait for a verdict, by name."""
    return curation.where(F.col("verdict") == verdict).orderBy("read_name")


def set_verdicts(curation: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``curation`` with the ``verdicts (read_name, verdict, notes)`` of people put in, as a new table.

    The last of several verdicts on a read (by ``at``, if there is such a column) counts; null notes leave the notes as
    they are. Reads that the table does not know are added without fingerprints.
    """
    order = F.struct(F.col("at") if "at" in verdicts.columns else F.lit(0), "verdict", F.coalesce("notes", F.lit("")))
    last = verdicts.groupBy("read_name").agg(F.max_by(F.struct("verdict", "notes"), order).alias("_v"))
    both = curation.join(last, "read_name", "full_outer")
    new = {"verdict": F.coalesce("_v.verdict", "verdict"), "notes": F.coalesce("_v.notes", "notes", F.lit("")), "lhs_fingerprint": F.coalesce("lhs_fingerprint", F.lit("")), "rhs_fingerprint": F.coalesce("rhs_fingerprint", F.lit(""))}
    return both.select(*((new[c].alias(c) if c in new else F.col(c)) for c in curation.columns))
