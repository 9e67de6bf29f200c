import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import compare, intervals, pileup, seeds, similarity, stats
from strandframe.operators.components import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merge_touching_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 9, 10), ("b", 1, 2)], "k string, start long, end long")
    assert rows(intervals.merge(df, ["k"])) == [("a", 0, 8, 2), ("a", 9, 10, 1), ("b", 1, 2, 1)]
    assert rows(intervals.gaps(df, ["k"])) == [("a", 8, 9)]
    assert rows(intervals.merge(df.limit(0), ["k"])) == []


@pytest.mark.parametrize("gap", [0, 3])
def test_range_join_against_all_pairs(spark, gap):
    rng = random.Random(gap)
    def make():
        return [(rng.choice("ab"), i, s := rng.randrange(100), s + rng.randrange(1, 40)) for i in range(60)]
    a, b = make(), make()
    schema = "k string, i long, start long, end long"
    got = rows(intervals.range_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], 10, gap).select("i", "r_i"))
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] + gap and y[2] < x[3] + gap)


def test_bands_are_anchored_at_their_first_seed(spark):
    rng = random.Random(5)
    data = [(rng.randrange(3), rng.randrange(5000), float(rng.randrange(1, 4))) for _ in range(300)]
    got = rows(seeds.bands(spark.createDataFrame(data, "read long, diagonal long, weight double"), ["read"], 800).select("read", "low", "high", "n", "weight"))
    want = []
    for read in range(3):
        first = None
        for d, w in sorted((d, w) for r, d, w in data if r == read):
            if first is None or d - first >= 800:
                first = d
                want.append([read, d, d, 0, 0.0])
            want[-1][2:] = [d, want[-1][3] + 1, want[-1][4] + w]
    assert got == sorted(map(tuple, want))


def test_pileup_golden(spark):
    reads = [("c", 0, 30, "4=1I1X2D2=", "ACGTTTGT"), ("c", 1, 10, "5=", "CGTAC")]
    aln = spark.createDataFrame(reads, "chrom string, start long, mapq int, cigar string, seq string")
    ref = spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string")
    called = pileup.called(pileup.counts(aln, ref), 2, 0.2)
    t = {r["class"]: r for r in pileup.totals(called, ["class"]).collect()}
    a = t["all"]
    assert (a.positions, a.mismatch_sum, a.del_sum, a.ins_sum) == (10, 3, 2, 1)
    assert a.depth_sum == 14 and t["q20"].candidate_sites == 0
    windows = rows(pileup.window_depth(pileup.counts(aln, ref), spark.createDataFrame([("c", 10)], "chrom string, length long"), 4).select("start", "end", "positions"))
    assert windows == [(0, 4, 4), (4, 8, 4), (8, 10, 2)]


def test_components_and_representatives(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i % 10] + [(50, 50), (None, 3), (7, 5)], "src long, dst long")
    found = dict(rows(connected_components(edges)))
    assert found[9] == 1 and found[19] == 11 and found[50] == 50 and len(found) == 41
    members = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 9), (4, 4, 1)], "cluster long, id long, size long")
    assert rows(similarity.representatives(members, "cluster", "size", "id")) == [(1, 2, 9, 3), (4, 4, 1, 1)]
    assert connected_components(edges.limit(0)).count() == 0


def test_cosine_pairs_and_farthest_first(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(40)] + [(90, [0.0] * 4, 0), (91, None, 0)]
    df = spark.createDataFrame(data, "id long, v array<double>, g int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 if any(a) and any(b) else 0.0
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[2] == b[2] and a[1] and b[1] and cos(a[1], b[1]) >= 0.6)
    assert rows(similarity.cosine_pairs(df, "id", "v", "g", 0.6, block=8).select("a", "b")) == want
    first = similarity.farthest_first(df.where("id < 90"), "id", "v", "g", 0.5, 100).collect()
    for g in (0, 1):
        taken = [next(d[1] for d in data if d[0] == r.id) for r in sorted(first, key=lambda r: r["rank"]) if r.group == g]
        assert all(max(cos(t, d[1]) for t in taken) >= 0.5 for d in data if d[2] == g and d[0] < 90)


def test_curation_rules(spark):
    existing = spark.createDataFrame([("a", "lhs", "x", "", "n"), ("b", "agree", "x", "", ""), ("c", "lhs", "old", "", ""), ("d", "clip", "", "", ""), ("e", "neither", "", "", "")], "read_name string, verdict string, lhs_fingerprint string, rhs_fingerprint string, notes string")
    compared = spark.createDataFrame([("a", "both", "x", "y"), ("b", "rhs", "", "y"), ("c", "both", "new", "y"), ("d", "agree", "z", "z"), ("e", "clip", "p", "q"), ("f", "lhs", "m", "")], "read_name string, state string, lhs_fp string, rhs_fp string")
    got = {r.read_name: (r.verdict, r.lhs_fingerprint) for r in compare.curate(existing, compared).collect()}
    assert got == {"a": ("lhs", "x"), "b": ("uncurated", ""), "c": ("uncurated", "new"), "d": ("agree", "z"), "e": ("neither", "p"), "f": ("uncurated", "m")}


def test_quantiles_and_outliers(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(11)], "k string, v double")
    assert [r.value for r in stats.quantiles(df, ["k"], "v", 2).orderBy("q").collect()] == [0.0, 5.0, 10.0]
    low = spark.createDataFrame([("k", 0.9)] * 9 + [("k", 0.2)], "k string, v double")
    assert [r.v for r in stats.mad_outliers(low, "k", "v").collect()] == [0.2]


def test_invariance_classes(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, 0), ("b", 0, 5, 1, 0), ("c", 5, 5, 1, 1), ("d", 4, 5, 1, 1), ("e", 0, 9, 1, 1)], "read string, agree long, either long, n_orig long, n_var long")
    got = {r.read: r["class"] for r in compare.invariance(df, F.lit(1)).collect()}
    assert got == {"a": "both_unmapped", "b": "orig_only", "c": "identical", "d": "partial", "e": "disjoint"}


def test_vectors_are_exchanged_as_narrow_as_they_came(spark):
    texts = ["ACGT" * 9, "ACGT" * 8 + "ACGA", "TTTT" * 100, None, "AC"]
    made = spark.createDataFrame([(i, t, "s" if i < 3 else None) for i, t in enumerate(texts)], "id long, seq string, source string")
    vectors = similarity.kmer_vectors(made, "id", "seq", 2, ["source"])
    assert vectors.schema["vector"].dataType.simpleString() == "array<smallint>" and vectors.columns == ["id", "source", "vector"]
    short = similarity.cosine_pairs(vectors, "id", "vector", "source", 0.9)
    wide = similarity.cosine_pairs(vectors.withColumn("vector", F.col("vector").cast("array<double>")), "id", "vector", "source", 0.9)
    assert rows(short) == rows(wide) and [r[:2] for r in rows(short)] == [(0, 1)]
    assert "array<double>" not in short._jdf.queryExecution().optimizedPlan().toString()


def test_bands_come_from_one_sorted_pass(spark, monkeypatch):
    rng = random.Random(8)
    data = []
    for _ in range(400):
        start = rng.randrange(200)
        data.append((rng.choice(["a", "b", None]), rng.random() < 0.5, rng.choice([rng.randrange(-60, 60), 7, 1 << 40]), rng.choice([1.0, 2.0, None]), start, start + rng.randrange(1, 12)))
    df = spark.createDataFrame(data, "read string, reverse boolean, diagonal long, weight double, read_start long, read_end long")
    bands = {}
    for row in sorted(data, key=lambda r: ((r[0] is not None, r[0]), r[1], r[2])):
        of = bands.setdefault(row[:2], [])
        if not of or row[2] >= of[-1][0][2] + 20:
            of.append([])
        of[-1].append(row)
    bands = {(*key, band[0][2]): band for key, of in bands.items() for band in of}
    places = lambda band: len({p for r in band for p in range(r[4], r[5])})
    total = lambda band: sum(r[3] for r in band if r[3]) if any(r[3] for r in band) else None
    wanted = {key: (band[0][2], band[-1][2], len(band), total(band), places(band), places(band) / 200) for key, band in bands.items() if key[0] and places(band) >= 10}
    lengths = spark.createDataFrame([("a", 200), ("b", 200)], "read string, length int")
    monkeypatch.setattr(seeds, "GATHERED", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = seeds.in_bands(df, ["read", "reverse"], 20)
        assert sorted(str(tuple(r)) for r in found.collect()) == sorted(str((*r, key[2])) for key, band in bands.items() for r in band)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan
        covered = seeds.band_coverage(df, ["read", "reverse"], lengths, "read", 20, 0.05)
        assert {tuple(r[:3]): tuple(r[3:]) for r in covered.collect()} == wanted
        assert "Window" not in covered._jdf.queryExecution().optimizedPlan().toString()
        assert seeds.in_bands(df.limit(0), ["read"], 20).count() == 0 == seeds.band_coverage(df.limit(0), ["read", "reverse"], lengths, "read", 20).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
