"""Rescue, isolation and chain filters against plain Python on small and odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals, isolation, rescue, seed_filters

KINDS = "read string, " + ", ".join(f"{n} {t}" for n, t in seed_filters.SEED.items())


def plain_rescue(gaps, places, k, spacing):
    """The recursion as it is told: the rarest place of a gap, then both sides."""
    found, stack = [], [g for g in gaps if g[1] - g[0] > spacing]
    while stack:
        a, b = stack.pop()
        inside = [p for p in places if p[0] >= a and p[0] + k <= b]
        if inside:
            pos = min(inside, key=lambda p: (p[1], p[0]))[0]
            found.append(pos)
            stack += [g for g in ((a, pos), (pos + k, b)) if g[1] - g[0] > spacing]
    return sorted(found)


@pytest.mark.parametrize("spacing", [30, 100])
def test_rescue_equals_the_recursion(spark, spacing):
    rng, k, reads = random.Random(spacing), 12, {}
    for r in range(12):
        gaps, at = [], 0
        while at < 2500:
            n = rng.randrange(5, 900)
            gaps.append((at, at + n))
            at += n + rng.randrange(1, 60)
        reads[r] = gaps, [(p, rng.randrange(3, 40)) for p in sorted(rng.sample(range(2600), 300))]
    reads[12] = [(0, 500)], [(p, 2000 - p) for p in range(0, 490)]  # every split leaves all but a few bases
    gaps = spark.createDataFrame([(r, a, b) for r, (g, _) in reads.items() for a, b in g], "read long, start long, end long")
    places = spark.createDataFrame([(r, p, n) for r, (_, x) in reads.items() for p, n in x], "read long, pos long, n_hits long")
    got = {r: [] for r in reads}
    for row in rescue.split_gaps(gaps, places, ["read"], k, spacing).collect():
        got[row.read].append(row.pos)
    for r, (g, x) in reads.items():
        assert sorted(got[r]) == plain_rescue(g, x, k, spacing)
    assert rescue.split_gaps(gaps, places.limit(0), ["read"], k, spacing).count() == 0


def test_uncovered_gaps_and_ends(spark):
    rows = spark.createDataFrame([("a", 5, 10), ("a", 8, 20), ("a", 20, 25), ("b", 0, 100), ("d", 90, 130), ("e", 4, 4)], "read string, start long, end long")
    lengths = spark.createDataFrame([("a", 40), ("b", 100), ("c", 7), ("d", 100), ("e", 9), ("f", 0)], "read string, length long")
    got = sorted(tuple(r) for r in intervals.uncovered(rows, lengths, ["read"], "length").collect())
    assert got == [("a", 0, 5), ("a", 25, 40), ("c", 0, 7), ("d", 0, 90), ("e", 0, 9)]


def test_isolated_seeds_of_hand(spark):
    rows = [("r", 1, False, 0, 0, 20), ("r", 1, False, 30, 100, 120), ("r", 1, True, 30, 100, 120), ("r", 1, False, 5000, 110, 130), ("r", 1, False, 9000, 0, 101), (None, 1, False, 0, 0, 20), (None, 1, False, 0, 50, 70), ("r", 1, False, 0, 0, 20)]
    seeds = spark.createDataFrame([(*r, "x") for r in rows], "read string, chrom long, reverse boolean, diagonal long, read_start long, read_end long, _kept2 string")
    got = {(r.read, r.reverse, r.diagonal, r.read_start): r.isolated for r in isolation.isolated(seeds, "read", isolation.BY_GAPS).collect()}
    assert isolation.isolated(seeds, "read", isolation.BY_GAPS).count() == len(rows)
    assert not got["r", False, 0, 0] and not got["r", False, 30, 100] and got["r", True, 30, 100] and got["r", False, 5000, 110] and not got["r", False, 9000, 0]
    assert not got[None, False, 0, 0] and not got[None, False, 0, 50]


def seed(step, start, length, chrom, ref, reverse=False, weight=10.0, frequency=1):
    return {"read": "r", "step": step, "chrom": chrom, "reverse": reverse, "read_start": start, "read_end": start + length, "ref_start": ref, "diagonal": ref + start + length if reverse else ref - start, "weight": weight, "frequency": frequency}


def plain_chain(rows, bridge):
    """Segment numbers by looking at neighbours."""
    n = 0
    for i, r in enumerate(rows):
        if i and (r["chrom"] != rows[i - 1]["chrom"] or r["reverse"] != rows[i - 1]["reverse"] or abs(r["diagonal"] - rows[i - 1]["diagonal"]) > bridge):
            n += 1
        r["segment"] = n
    return rows


def plain_trim(rows):
    for a, b in zip(rows, rows[1:]):
        for where in ("read", "ref"):
            if where == "ref" and a["segment"] != b["segment"]:
                continue
            if where == "read":
                over = a["read_end"] - b["read_start"]
            else:
                low, high = (b, a) if a["reverse"] else (a, b)
                over = low["ref_start"] + low["read_end"] - low["read_start"] - high["ref_start"]
            while over > 0 and a["read_end"] > a["read_start"]:
                a["read_end"] -= 1
                a["ref_start"] += a["reverse"]
                over -= 1
            while over > 0 and b["read_end"] > b["read_start"]:
                b["read_start"] += 1
                b["ref_start"] += not b["reverse"]
                over -= 1
    return rows


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["segment"], []).append(r)
    return out.values()


def plain_frequent(rows, t):
    return [b["step"] for g in groups(rows) for a, b, c in zip(g, g[1:], g[2:]) if b["weight"] / b["frequency"] < 50 and max(abs(a["diagonal"] - b["diagonal"]), abs(c["diagonal"] - b["diagonal"])) > t]


def plain_excursion(rows, t):
    out = []
    for g in groups(rows):
        for a, b, c in zip(g, g[1:], g[2:]):
            x, y = a["diagonal"] - b["diagonal"], c["diagonal"] - b["diagonal"]
            if abs(x) > t and abs(y) > t and (x > 0) != (y > 0):
                out.append(b["step"])
    return out


def plain_terminal(rows, t):
    out = set()
    for g in groups(rows):
        if len(g) < 3:
            continue
        total, upto = sum(r["weight"] for r in g), 0.0
        for r in sorted(g, key=lambda r: (r["diagonal"], r["step"])):
            upto += r["weight"]
            if upto * 2 >= total:
                median = r["diagonal"]
                break
        for side in (g, g[::-1]):
            for r in side:
                if abs(r["diagonal"] - median) <= t:
                    break
                out.add(r["step"])
    return list(out)


def plain_prune(rows, t, bridge):
    rows = plain_chain([dict(r) for r in sorted(rows, key=lambda r: r["step"])], bridge)
    for find, again in ((plain_frequent, True), (plain_excursion, True), (plain_terminal, False)):
        while True:
            gone = set(find(rows, t))
            if gone:
                rows = plain_trim(plain_chain([r for r in rows if r["step"] not in gone], bridge))
            if not gone or not again:
                break
    return rows


def frame(spark, rows):
    names = [f.name for f in spark.createDataFrame([], KINDS).schema]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], KINDS)


@pytest.mark.parametrize(
    ("rows", "left"),
    [
        ([seed(0, 0, 10, 0, 50), seed(1, 100, 10, 0, 100), seed(2, 200, 10, 0, 150)], [50, 150]),  # opposite shifts
        ([seed(0, 0, 10, 0, 20), seed(1, 100, 10, 0, 120), seed(2, 200, 10, 0, 220)], [20, 120, 220]),  # one diagonal
        ([seed(0, 0, 10, 0, 5), seed(1, 100, 10, 0, 100), seed(2, 200, 10, 0, 195)], [5, 100, 195]),  # small shifts
        ([seed(0, 0, 10, 1, 50), seed(1, 100, 10, 0, 100), seed(2, 200, 10, 1, 150)], [50, 100, 150]),  # other chromosomes
        ([seed(0, 0, 10, 0, 50)], [50]),
    ],
)
def test_prune_of_hand(spark, rows, left):
    got = seed_filters.prune_repetitive(frame(spark, rows), 10).orderBy("step").collect()
    assert [r.ref_start for r in got] == left


@pytest.mark.parametrize("length", [10, 25])
def test_short_segments_of_hand(spark, length):
    rows = [seed(0, 0, 30, 0, 100), seed(1, 100, length, 1, 200), seed(2, 200, 30, 0, 300)]
    got = seed_filters.drop_flagged(frame(spark, rows), lambda s: seed_filters.short_alone(s, least=20))
    assert got.count() == (2 if length < 20 else 3)
    pair = frame(spark, [seed(0, 0, 10, 0, 100), seed(1, 10, 10, 0, 110)])
    assert seed_filters.drop_flagged(pair, lambda s: seed_filters.short_alone(s, least=20)).count() == 2


def test_excursion_segment_of_hand(spark):
    # a detour to another chromosome between two parts of one diagonal goes, and the parts become one segment
    rows = [seed(0, 0, 50, 0, 1000), seed(1, 60, 20, 3, 7), seed(2, 100, 50, 0, 1100)]
    got = seed_filters.until_stable(frame(spark, rows), seed_filters.excursion_segments).orderBy("step").collect()
    assert [(r.step, r.segment) for r in got] == [(0, 0), (2, 0)]
    wide = frame(spark, [rows[0], seed(1, 60, 120, 3, 7), seed(2, 200, 50, 0, 1200)])
    assert seed_filters.until_stable(wide, seed_filters.excursion_segments).count() == 3  # spans over 100 bases


def test_prune_until_stable_equals_a_loop(spark):
    rng = random.Random(4)
    reads = {}
    for name in ("a", "b", "c", None):
        at, rows = 0, []
        for step in range(60):
            at += rng.randrange(5, 40)
            reverse = step // 15 % 2 == 1
            rows.append(seed(step, at, rng.randrange(8, 45), step // 25, 0, reverse, float(rng.randrange(1, 200)), rng.randrange(1, 6)) | {"read": name})
            diagonal = rng.choice([0, 0, 0, 30, -30, 80, 400])
            rows[-1] |= {"diagonal": diagonal, "ref_start": diagonal - rows[-1]["read_end"] if reverse else diagonal + rows[-1]["read_start"]}
        reads[name] = rows
    got = seed_filters.prune_repetitive(frame(spark, [r for rows in reads.values() for r in rows]), 25, bridge=100)
    columns = ["step", "read_start", "read_end", "ref_start", "segment"]
    for name, rows in reads.items():
        here = sorted(tuple(r[c] for c in columns) for r in got.where(F.col("read").eqNullSafe(F.lit(name))).collect())
        assert here == sorted(tuple(r[c] for c in columns) for r in plain_prune(rows, 25, 100)), name
    assert seed_filters.prune_repetitive(frame(spark, []), 25).count() == 0


def test_prune_in_one_pass_equals_rounds_by_windows(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for name in range(12):
        at = 0
        for step in range(rng.randrange(1, 50)):
            at += rng.randrange(5, 40)
            row = seed(step, at, rng.randrange(8, 60), rng.choice([0, 0, 0, 0, 1, None]), 0, rng.random() < 0.1, float(rng.randrange(1, 200)), rng.randrange(1, 6))
            rows.append(row | {"read": str(name), "diagonal": rng.choice([0, 0, 0, 30, -30, 80, 400]), "ref_start": at + rng.randrange(-30, 30)})
            if rng.random() < 0.1:
                rows[-1] |= {rng.choice(["diagonal", "weight", "frequency"]): None}
    made = frame(spark, rows).withColumn("more", F.concat("read", F.lit("x")))
    light, stray, ends = (lambda s: seed_filters.frequent(s, 25), lambda s: seed_filters.excursion(s, 25), lambda s: seed_filters.terminal(s, 25))
    rounds = seed_filters.until_stable(seed_filters.until_stable(made, light, bridge=100), stray, bridge=100)
    rounds = seed_filters.drop_flagged(rounds, ends, bridge=100).drop("changed")
    key = lambda df: sorted(tuple(r) for r in df.select("read", "step", "read_start", "read_end", "ref_start", "segment", "more").collect())
    wanted = key(rounds)
    assert 0 < len(wanted) < len(rows)
    monkeypatch.setattr(seed_filters, "GATHERED", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = seed_filters.prune_repetitive(made, 25, bridge=100)
        assert found.columns == rounds.columns and key(found) == wanted
        assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
