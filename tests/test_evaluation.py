"""Hand-made cases of the measures along CIGAR strings."""

import re

from pyspark.sql import functions as F

from strandframe.operators import evaluation
from strandframe.plans.inputs import lines

SCHEMA = "read string, rank long, chrom string, reverse boolean, read_len long, rs long, re long, qs long, qe long, cigar string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_positions_lift_through_gaps_and_strands(spark):
    one = spark.createDataFrame([("a", 1, "c", False, 60, 100, 153, 5, 60, "5H20=2D25=10I"), ("b", 1, "c", True, 60, 100, 160, 0, 60, "60="), ("n", 1, "c", False, 60, 0, 0, 0, 0, None), ("e", 1, "c", False, 60, 0, 0, 0, 0, "*")], SCHEMA)
    assert rows(evaluation.lifted(one), "read", "t") == [("a", 25, "c", False, 122), ("b", 0, "c", True, 159), ("b", 25, "c", True, 134), ("b", 50, "c", True, 109)]
    turned = one.where("read = 'b'").selectExpr("read", "rank", "chrom", "not reverse AS reverse", "read_len", "rs", "re", "qs", "qe", "cigar")
    assert {r[0]: r[1] for r in rows(evaluation.flipped_invariance(one, turned), "read")} == {"a": "orig_only", "b": "identical"}


def test_windows_take_errors_where_they_lie(spark):
    one = spark.createDataFrame([("a", 1, "c", False, 40, 0, 37, 0, 40, "8=2X10=1D5=5I10=")], SCHEMA)
    assert rows(evaluation.identity_windows(one, 10).selectExpr("window", "round(identity, 4)"), "window") == [(0, 0.8), (1, 1.0), (2, 0.4545), (3, 1.0)]


def test_boxes_share_area_on_one_strand_only(spark):
    box = lambda reverse, q, r: spark.createDataFrame([("a", 1, "c", reverse, 100, r, r + 10, q, q + 10, "10=")], SCHEMA)
    assert rows(evaluation.box_jaccard(box(False, 0, 0), box(False, 5, 0)), "read") == [("a", 50 / 150)]
    assert rows(evaluation.box_jaccard(box(False, 0, 0), box(True, 0, 0)), "read") == [("a", 0.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for found in (evaluation.outlier_windows(none), evaluation.error_by_distance(none), evaluation.flipped_invariance(none, none), evaluation.base_agreement(none, none), evaluation.box_jaccard(none, none)):
        assert found.count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_hashed_and_keep_their_side_of_f(spark, tmp_path):
    rows_ = [(1, 1, 5, 6, 7.0, "A"), (1, 1, 4, 8, 2.0, "F"), (2, 1, 1, 1, 1.0, "O"), (2, 1, 1, 1, 1.0, "F"), (3, 1, 1, 1, 1.0, None), (4, 1, 1, 1, 1.0, "B")]
    spark.createDataFrame(rows_, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = lines(spark, str(tmp_path))
    assert "SortAggregate" not in plan(found)
    assert rows(found.selectExpr("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_linestatus = 'F'", "l_linestatus <> 'F'"), "l_orderkey") == [(1, 5, 8, 7.0, True, False), (2, 1, 1, 1.0, False, True), (3, 1, 1, 1.0, None, None), (4, 1, 1, 1.0, False, True)]


def test_positions_are_not_exchanged_and_tiles_and_batches_do_not_show(spark, monkeypatch):
    some = [("a", 3 - k % 4, f"c{k % 3}", k % 5 == 0, 900, 1000 * k, 0, 0, 0, f"{k * 7}S{100 + k}=3I20X4D{200}M{900 - 323 - 8 * k}H") for k in range(60)] + [("b", None, None, None, None, None, 0, 0, 0, "10=x5y7=")]
    one = spark.createDataFrame(some, SCHEMA)
    assert "SortAggregate" not in plan(evaluation.lifted(one))
    best = {}
    for read, rank, chrom, reverse, length, rs, _, _, _, text in some:
        q = r = 0
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", text):
            n = int(n)
            for i in range(n if op in "M=X" else 0):
                t = length - 1 - q - i if reverse else q + i
                place = ((rank is not None, rank), (chrom is not None, chrom), (reverse is not None, reverse), (rs is not None, None if rs is None else rs + r + i))
                if t % 25 == 0 and ((read, t) not in best or place < best[read, t]):
                    best[read, t] = place
            q, r = q + n * (op in "MIS=X"), r + n * (op in "MDN=X")
    wanted = sorted((read, t, *(p[1] for p in place[1:])) for (read, t), place in best.items())
    other = one.selectExpr("read", "rank", "chrom", "not reverse AS reverse", "read_len", "rs + rank % 2 AS rs", "re", "qs", "qe", "cigar").where("rank > 0 or rank is null")
    assert rows(evaluation.lifted(one), "read", "t") == wanted
    whole = rows(evaluation.flipped_invariance(one, other), "read")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    monkeypatch.setattr(evaluation, "TILE", 4)
    try:
        assert rows(evaluation.lifted(one), "read", "t") == wanted
        assert rows(evaluation.flipped_invariance(one, other), "read") == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def test_strings_are_parsed_once(spark):
    one = spark.createDataFrame([("a", 1, "c", False, 40, 0, 37, 0, 40, "8=2X10=1D5=5I10=")], SCHEMA).withColumns({"mapq": F.lit(20), "primary": F.lit(True)})
    for found, times in ((evaluation.identity_windows(one, 10), 1), (evaluation.alignment_report(one, "chrom", "read"), 1), (evaluation.error_by_distance(one), 3)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == times
