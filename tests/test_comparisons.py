"""Small cases of comparisons, filters and strata, nulls and empty tables among them; the shared folder of a plain session."""

import pytest
from pyspark.sql import functions as F

from strandframe import session
from strandframe.operators import compare, filters, intervals, pileup

RECORD = "read string, chrom string, reverse boolean, qs long, qe long, rs long, re long, cigar string"


def states(spark, lhs, rhs):
    return {r.read: r.state for r in compare.outer_states(spark.createDataFrame(lhs, RECORD), spark.createDataFrame(rhs, RECORD)).collect()}


def test_clip_and_end_states(spark):
    whole = ("c", False, 0, 100, 1000, 1100, "10=2X88=")
    lhs = [(n, *whole) for n in "abcdefg"] + [("only", *whole), ("rev", "c", True, 0, 100, 1000, 1100, "88=2X10=")] + [("two", *whole), ("two", "d", False, 100, 120, 5, 25, "20=")]
    rhs = [
        ("a", *whole), ("b", "c", False, 12, 100, 1012, 1100, "12S88="),  # stops at the mismatch
        ("c", "c", False, 5, 100, 1005, 1100, "5S5=2X88="),  # stops within a match
        ("d", "c", False, 12, 100, 1015, 1100, "12S85=3D"), ("e", "c", False, 90, 100, 1090, 1100, "90S10="), ("f", "d", False, 12, 100, 1012, 1100, "12S88="), ("g", "c", False, 0, 100, 1300, 1400, "100="),
        ("other", *whole), ("rev", "c", True, 11, 100, 1000, 1089, "88=1X11S"), ("two", *whole), ("two", "d", False, 100, 120, 6, 26, "20="),
    ]
    got = states(spark, lhs, rhs)
    assert got == {"a": "agree", "b": "clip", "c": "ends", "d": "ends", "e": "ends", "f": "both", "g": "clip", "only": "lhs", "other": "rhs", "rev": "clip", "two": "both"}
    assert states(spark, [], rhs[:1]) == {"a": "rhs"} and states(spark, [], []) == {}


def test_verdicts_are_put_in(spark):
    table = spark.createDataFrame([("a", "uncurated", "x", "y", "old"), ("b", "agree", "x", "x", ""), ("c", "uncurated", "p", "q", "")], "read_name string, verdict string, lhs_fingerprint string, rhs_fingerprint string, notes string")
    assert [r.read_name for r in compare.curation_queue(table).collect()] == ["a", "c"]
    new = spark.createDataFrame([("a", "lhs", None, 1), ("a", "rhs", "seen", 2), ("z", "neither", None, 1)], "read_name string, verdict string, notes string, at int")
    got = {r.read_name: (r.verdict, r.notes) for r in compare.set_verdicts(table, new).collect()}
    assert got == {"a": ("rhs", "seen"), "b": ("agree", ""), "c": ("uncurated", ""), "z": ("neither", "")}


def test_placements_match_in_any_order(spark):
    kind = "read string, rank int, chrom string, reverse boolean, rs long"
    lhs = [("a", 1, "c", False, 100), ("a", 2, "d", False, 5), ("a", 3, "e", True, 7), ("b", 1, "c", False, 100), ("b", 2, "c", False, 150), ("n", 1, None, False, 1)]
    rhs = [("a", 1, "c", False, 150), ("a", 2, "e", True, 90), ("a", 3, "d", False, 50), ("b", 1, "c", False, 100), ("b", 2, "c", False, 400), ("n", 1, None, False, 1)]
    reads = spark.createDataFrame([(x,) for x in ("a", "b", "gone", "n")], "read string")
    got = {r.read: r.category for r in compare.concordance_any_order(spark.createDataFrame(lhs, kind), spark.createDataFrame(rhs, kind), reads).collect()}
    assert (got["a"], got["b"], got["gone"]) == ("concordant", "partial_match", "both_unmapped")


@pytest.mark.parametrize("width", [1, 7, 10, 1000])
def test_touching_intervals_meet_once(spark, width):
    kind = "k string, start long, end long"
    left = [("a", 0, 10), ("a", 10, 10), ("a", 30, 40), ("b", 0, 10), ("a", 9, 3), (None, 0, 10), ("a", None, 4)]
    right = [("a", 10, 20), ("a", 20, 30), ("a", 45, 50), ("c", 0, 10), ("a", 20, 30)]
    for gap in (0, 5):
        got = sorted((r.k, r.start, r.end, r.r_start, r.r_end) for r in intervals.touching_join(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["k"], width, gap).collect())
        want = sorted((*x, *y[1:]) for x in left for y in right if x[0] == y[0] and x[1] is not None and x[2] >= x[1] and x[2] + gap >= y[1] and y[2] + gap >= x[1])
        assert got == want and want


def test_strata_of_positions(spark):
    strata = spark.createDataFrame([("low", 2, "c", 0, 100), ("high", 1, "c", 40, 60), ("high", 1, "c", 55, 70), ("none", 0, "c", 5, 5), ("d", 0, "d", 0, 3)], "stratum string, priority int, chrom string, start long, end long")
    rows = spark.createDataFrame([("c", p) for p in (0, 39, 40, 59, 69, 70, 99, 100)] + [("d", 2), ("d", 3), ("e", 1), (None, 1)], "chrom string, pos long")
    for width in (7, 1000):
        got = {(r.chrom, r.pos): r.stratum for r in pileup.stratified(rows, strata, width).collect()}
        assert [got["c", p] for p in (0, 39, 40, 59, 69, 70, 99, 100)] == ["low", "low", "high", "high", "high", "low", "low", "other"]
        assert (got["d", 2], got["d", 3], got["e", 1], got[None, 1]) == ("d", "other", "other", "other")


def test_accepted_groups_and_qualities(spark):
    rows = spark.createDataFrame([("r", 0, 0, 60, 40), ("r", 0, 60, 90, 30), ("r", 1, 0, 80, 10), ("s", 0, 0, 60, 60)], "read string, group int, qs long, qe long, matches long")
    lengths = spark.createDataFrame([("r", 500), ("s", 1000)], "read string, length long")
    assert [(r.read, r.group, r.qs) for r in filters.accepted(rows, lengths).collect()] == [("r", 0, 0)]
    first = spark.createDataFrame([("a", 0, 100, 5.0), ("b", 0, 100, 5.0), ("c", 0, 0, 0.0)], "read string, qs long, qe long, divergence double")
    others = spark.createDataFrame([("a", 50, 150, 10.0)], "read string, qs long, qe long, divergence double")
    got = {r.read: r.mapq for r in filters.mapq_by_divergence(first, others).collect()}
    assert got == {"a": 60, "b": 60, "c": 0}  # 5 + 50 uncovered - 5, and 100 - 5, each over the limit
    near = spark.createDataFrame([("a", 0, 100, 12.0)], "read string, qs long, qe long, divergence double")
    assert filters.mapq_by_divergence(first.where("read = 'a'"), near).first().mapq == round(7 * 10 / 2.302585)


def test_a_session_without_a_shared_folder_keeps_one(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None, real=type(spark.conf).get: None if key == "spark.checkpoint.dir" else real(self, key, default) if default is not None else real(self, key))
    folder = session.shared_dir(spark)
    assert folder.startswith("file:///") and session.shared_dir(spark) == folder
    assert session.materialize(spark.range(5).select(F.col("id") + 1)).count() == 5
