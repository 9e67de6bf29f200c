"""Overlaps counted without their pairs: against all pairs, at bins' borders, and on one place that holds every row."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals
from strandframe.plans import QUERIES

KIND = "k string, i long, start long, end long"


def _make(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, s := rng.randrange(-20, 60), s + rng.randrange(-1, 12)) for i in range(80)]
    return rows + [("a", 90, 10, 10), ("a", 91, 10, 10), (None, 92, 0, 30), ("a", 93, None, 5), ("a", 94, 5, None), ("c", 95, 0, 9)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_sums_against_all_pairs(spark, width):
    left, right = _make(1), [r for r in _make(2) if r[0] != "c"]
    a, b = spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)
    known = lambda rows, least: [r for r in rows if None not in r and r[3] - r[2] >= least]
    got = {r.i: (r.hits, r.bases) for r in intervals.overlap_sums(a, b, ["k"], width).collect()}
    met = {x[1]: [min(x[3], y[3]) - max(x[2], y[2]) for y in known(right, 1) if x[0] == y[0] and y[2] < x[3] and x[2] < y[3]] for x in known(left, 0)}
    assert got == {i: (len(m), sum(m)) for i, m in met.items() if m}
    for gap in (0, 5):
        got = {r.i: (r.hits, r.touching) for r in intervals.touching_sums(a, b, ["k"], width, gap).collect()}
        met = {x[1]: [y[2] == x[3] or y[3] == x[2] for y in known(right, 0) if x[0] == y[0] and y[2] <= x[3] + gap and x[2] <= y[3] + gap] for x in known(left, 0)}
        assert got == {i: (len(m), sum(m)) for i, m in met.items() if m}
    assert intervals.overlap_sums(a, b.limit(0), ["k"], width).count() == intervals.touching_sums(a.limit(0), b, ["k"], width).count() == 0


@pytest.fixture(scope="module")
def one_place(spark, tmp_path_factory):
    """Regions and records of one place: 10 billion pairs of 100,000 rows a side."""
    root, n = tmp_path_factory.mktemp("place"), 100_000
    spark.range(n).select((F.col("id") * 50_000).alias("p_partkey"), F.lit(30).alias("p_size")).write.parquet(f"{root}/part.parquet")
    line = {"l_orderkey": "id", "l_partkey": "id * 10000", "l_suppkey": "id * 5", "l_linenumber": "1", "l_quantity": "20D", "l_discount": "0.1D", "l_linestatus": "'F'"}
    spark.range(n).selectExpr(*(f"{e} AS {c}" for c, e in line.items())).write.parquet(f"{root}/lineitem.parquet")
    return str(root), n


@pytest.mark.parametrize("name, column, value", [("range_join_overlap", "bases", 20), ("touching_intervals", "touching", 0)])
def test_pairs_of_one_place_are_not_made(spark, one_place, name, column, value):
    root, n = one_place
    got = QUERIES[name](spark, root).agg(F.count("*"), F.min("hits"), F.max("hits"), F.min(column), F.max(column)).first()
    assert tuple(got) == (n, n, n, n * value, n * value)
