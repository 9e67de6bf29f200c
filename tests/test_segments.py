"""Bridged breaks and merged segments on small cases."""

import random

import pytest

from strandframe.operators import reference, segments

TURN = str.maketrans("ACGT", "TGCA")


def seg(start, end, read_start, read_end, cigar, reverse=True, chrom="c"):
    return {"chrom": chrom, "reverse": reverse, "read_start": read_start, "read_end": read_end, "ref_start": start, "ref_end": end, "cigar": cigar}


def spans(row):
    ops = segments.parse(row["cigar"])
    return segments.total(ops, "MDN=X") == row["ref_end"] - row["ref_start"], segments.total(ops, "MIS=X") == row["read_end"] - row["read_start"]


@pytest.mark.parametrize(
    ("prev", "following"),
    [
        (seg(2255803, 2256041, 16829, 16947, "2D46="), seg(2255851, 2256072, 16948, 17139, "25=1X13=1X37=")),  # CIGAR shorter than the span
        (seg(25159116, 25159221, 2823, 2933, "57=5I48="), seg(25159125, 25159312, 2965, 3037, "23=1X4=63D")),
        (seg(0, 100, 0, 100, "100=", False), seg(50, 150, 100, 200, "100=", True)),  # other strand
        (seg(0, 100, 0, 100, "100=", False), seg(50, 150, 100, 200, "100=", False, "d")),  # other chromosome
        (seg(0, 100, 0, 100, "100=", False), seg(100, 200, 100, 200, "100=", False)),  # touching
        (seg(0, 100, 0, 100, "100=", False), seg(20, 90, 100, 170, "70=", False)),  # contained
        (seg(0, 100, 0, 100, "100=", False), seg(50, 150, 90, 190, "100=", False)),  # overlap on the read
    ],
)
def test_segments_that_stay_apart(prev, following):
    assert segments.merged(prev, following, 0.5, 0) is None


def test_merging_of_hand():
    a, b = seg(0, 100, 0, 100, "60=40X", False), seg(60, 160, 103, 203, "100=", False)
    got = segments.merged(a, b, 0.5, 0)
    assert got["cigar"] == "60=43I100=" and (got["read_start"], got["read_end"], got["ref_start"], got["ref_end"]) == (0, 203, 0, 160)
    got = segments.merged(seg(0, 100, 0, 100, "100=", False), seg(60, 160, 100, 200, "30X70=", False), 0.5, 0)
    assert got["cigar"] == "100=40I60="
    assert segments.merged(seg(0, 100, 0, 100, "100=", False), seg(60, 160, 100, 200, "100=", False), 0.5, 0) is None  # equally good
    assert segments.merged(seg(0, 100, 0, 100, "100=", False), seg(60, 160, 100, 200, "100=", False), 0.5, 4000)["cigar"] == "60=40I100="  # forced, the earlier loses
    # the reverse strand is the mirror image
    assert segments.merged(seg(60, 160, 0, 100, "60=40X"), seg(0, 100, 103, 203, "100="), 0.5, 0)["cigar"] == "60=43I100="


def test_a_long_pair_merges_with_its_order_kept():
    prev = seg(2255851, 2256072, 16829, 16829 + 191, "25=1X13=1X37=1X21=1X1=1X27=1X1=1X5=30D22=1X2=1X28=")
    following = seg(2255803, 2256041, 17021, 17021 + 118, "46=1X25=120D46=")
    got = segments.merged(prev, following, 0.5, 0)
    assert got is not None and all(spans(got)) and (got["ref_start"], got["ref_end"]) == (2255803, 2256072)


def plain_merge(rows, ratio, forced):
    out = []
    for row in rows:
        one = segments.merged(out[-1], row, ratio, forced) if out else None
        if one:
            out[-1] = one
        else:
            out.append(row)
    return out


def test_reads_are_merged_in_order(spark):
    rng, rows = random.Random(4), []
    for read in range(40):
        at, ref, reverse = 0, 500, read % 2 == 0
        for part in range(rng.randrange(1, 7)):
            size, bad = rng.randrange(50, 90), rng.randrange(0, 25)
            cigar = segments.text([(size - 2 * bad, "="), (bad, "X"), (bad, "=")])
            rows.append({"read": read, "part": part} | seg(ref, ref + size, at, at + size, cigar, reverse))
            at += size + rng.randrange(0, 9)
            ref += (-1 if reverse else 1) * rng.randrange(20, 90)
    kind = "read long, part int, chrom string, reverse boolean, read_start long, read_end long, ref_start long, ref_end long, cigar string"
    names = [f.split()[0] for f in kind.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kind).repartition(6)
    got = segments.merge_overlaps(df, ratio=0.8, forced=25).collect()
    want = [r for read in range(40) for r in plain_merge([x for x in rows if x["read"] == read], 0.8, 25)]
    assert sorted(tuple(r) for r in got) == sorted(tuple(r[n] for n in names) for r in want) and len(want) < len(rows)
    assert all(all(spans(r.asDict())) for r in got)
    assert segments.merge_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_a_detour_is_bridged(spark, reverse):
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGT") for _ in range(400))
    other = "".join(rng.choice("ACGT") for _ in range(200))
    read = ref[50:250]  # the stretch 120..140 of the reference also stands elsewhere
    place = lambda a, b: (250 - b, 250 - a) if reverse else (a - 50, b - 50)
    seq = read[::-1].translate(TURN) if reverse else read
    seeds = [(50, 110), (120, 140), (150, 250)]
    seeds = seeds[::-1] if reverse else seeds
    rows = [("r", i, "c" if i != 1 else "d", reverse, *place(a, b), a if i != 1 else 30, None if i == 0 else "break") for i, (a, b) in enumerate(seeds)]
    rows += [("far", 0, "c", False, 0, 20, 0, None), ("far", 1, "d", False, 20, 40, 0, "break"), ("far", 2, "c", False, 40, 60, 20_000, "break"), ("one", 0, "c", False, 0, 20, 0, None), ("one", 1, "d", False, 30, 60, 0, "break"), ("sound", 0, "c", False, 0, 20, 0, None), ("sound", 1, "d", False, 20, 170, 0, "break"), ("sound", 2, "c", False, 190, 210, 40, "break")]
    chain = spark.createDataFrame(rows, "read string, place int, chrom string, reverse boolean, read_start long, read_end long, ref_start long, step string")
    reads = spark.createDataFrame([("r", seq), ("far", "A" * 60), ("one", "A" * 60), ("sound", ref[:20] + other[:150] + "T" * 20 + ref[40:60])], "read string, seq string")
    held = reference.blocks(spark.createDataFrame([("c", ref), ("d", other)], "name string, seq string"), 64)
    got = {}
    for r in segments.collapse_breaks(chain, reads, held, width=64).orderBy("place").collect():
        got.setdefault(r.read, []).append((r.place, r.step, r.bridge_cigar))
    assert got["r"] == [(0, None, None), (2, "bridge", "40=")]
    assert got["far"] == [(0, None, None), (1, "break", None), (2, "break", None)]  # too far apart
    assert got["one"] == [(0, None, None), (1, "break", None)]  # a single break stays
    assert [p for p, *_ in got["sound"]] == [0, 1, 2]  # a well-supported detour stays
