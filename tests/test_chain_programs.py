"""Chaining programs against all chains of small cases."""

import itertools
import random

import numpy as np
import pytest

from strandframe.operators import chain_programs as cp

KIND = "read string, chrom long, reverse boolean, diagonal long, read_start long, read_end long, weight double"


def seeds(rng, n, span=300):
    rows = []
    for _ in range(n):
        start = rng.randrange(span)
        rows.append((rng.randrange(2), rng.random() < 0.3, rng.choice([0, 5, 150, 900, 1200, -420]) + rng.randrange(4), start, start + rng.randrange(8, 40), float(rng.randrange(5, 60))))
    rows.sort(key=lambda r: (r[3], r[4], r[0], r[1], r[2], r[5]))
    return {c: np.array([r[i] for r in rows]) for i, c in enumerate(cp.COLUMNS)}, rows


def slope(x, base, steps):
    return max(x, 0) * base + sum(more * max(x - at, 0) for at, more in steps)


def overlap_cut(a, b):
    over = max(0, a[4] - b[3])
    same = a[0] == b[0] and a[1] == b[1]
    shift = (b[2] - a[2]) * (-1 if b[1] else 1)
    ok = over < b[4] - b[3] if same else over < min(a[4] - a[3], b[4] - b[3])
    return max(0, b[3] - a[4]), shift, same, over * min(a[5] / (a[4] - a[3]), b[5] / (b[4] - b[3])), ok


def break_step(a, b, scheme):
    gap, shift, same, cut, ok = overlap_cut(a, b)
    if not ok:
        return None
    if not same:
        return slope(gap, *scheme.read_gap), True
    forward = gap + shift >= -scheme.tolerance
    cost = slope(gap, *scheme.read_gap) + cut
    if abs(shift) > (scheme.most_deviation if forward else scheme.repeat_window):
        return cost, True
    return cost + slope(abs(shift), *scheme.deviation) + (0 if forward else scheme.repeat), False


def break_score(rows, chain, scheme, most):
    score, breaks = rows[chain[0]][5], 0
    for a, b in zip(chain, chain[1:]):
        step = break_step(rows[a], rows[b], scheme)
        if step is None:
            return None
        if step[1]:
            breaks = min(breaks + 1, most)
            score -= breaks * scheme.penalty
        score += rows[b][5] - step[0]
    return score


@pytest.mark.parametrize("most", [1, 2, 8])
def test_break_chains_equal_all_chains(most):
    rng, scheme = random.Random(most), cp.BreakScheme()
    for case in range(60):
        s, rows = seeds(rng, rng.randrange(1, 9))
        found = cp.by_breaks(s, scheme, most)
        scores = [x for n in range(1, len(rows) + 1) for c in itertools.combinations(range(len(rows)), n) if (x := break_score(rows, c, scheme, most)) is not None]
        assert found.score == pytest.approx(max(scores)) == pytest.approx(break_score(rows, found.seeds, scheme, most)), case
        kinds = [k == cp.BREAK for k in found.kinds]
        assert kinds == [break_step(rows[a], rows[b], scheme)[1] for a, b in zip(found.seeds, found.seeds[1:])]
    assert cp.by_breaks({c: np.array([]) for c in cp.COLUMNS}) is None


def test_break_chains_of_many_reads_share_their_steps(monkeypatch):
    rng, scheme, steps = random.Random(9), cp.BreakScheme(), [0]
    reads = [seeds(rng, rng.randrange(0, 12))[0] if k % 7 else {c: np.array([]) for c in cp.COLUMNS} for k in range(300)]
    alone = [cp.by_breaks(s, scheme) for s in reads]
    taken = cp.BreakScheme.steps
    monkeypatch.setattr(cp.BreakScheme, "steps", lambda *a: (steps.__setitem__(0, steps[0] + 1), taken(*a))[1])
    assert cp.by_breaks_all(reads, scheme) == alone
    assert steps[0] < 20  # one for each rank of a seed, not for each seed


def test_the_second_break_costs_twice(spark):
    rows = [(0, False, 0, 0, 50, 50.0), (1, False, 0, 50, 70, 15.0), (0, False, 0, 70, 120, 50.0)]
    s = {c: np.array([r[i] for r in rows]) for i, c in enumerate(cp.COLUMNS)}
    # the detour earns 15 and its two breaks cost 6 and 12; the step over it costs 0.02 * 20 + 0.03 * 5
    assert cp.by_breaks(s).seeds == [0, 2] and cp.by_breaks(s).score == pytest.approx(100 - 0.55)
    s["weight"][1] = 30.0
    assert cp.by_breaks(s).seeds == [0, 1, 2] and cp.by_breaks(s).score == pytest.approx(130 - 18)


def segment_step(a, b, scheme):
    gap, shift, same, cut, ok = overlap_cut(a, b)
    again = same and gap + shift < -(b[4] - b[3])
    if not ok:
        return None
    if isinstance(scheme, cp.BandScheme):
        if not same or not again and gap > scheme.reach:
            return gap * scheme.gap_cost + scheme.penalty
        return gap * scheme.gap_cost + (scheme.penalty / 2**0.5 if again else abs(shift) * scheme.deviation_cost + cut)
    return None if not same else gap * scheme.gap_cost + (scheme.repeat if again else abs(shift) * scheme.deviation_cost + cut)


def plain_extraction(rows, weights, scheme):
    """The best chain by trying all, taken away, and again."""
    active, out = list(range(len(rows))), []
    while len(active) > 1:
        best = None
        for n in range(1, len(active) + 1):
            for c in itertools.combinations(active, n):
                steps = [segment_step(rows[a], rows[b], scheme) for a, b in zip(c, c[1:])]
                if None not in steps:
                    score = sum(weights[i] for i in c) - sum(steps)
                    if best is None or score > best[0] + 1e-9:
                        best = score, c
        if best[0] <= 0 or len(best[1]) < 2:
            break
        out.append(best[0])
        active = [i for i in active if i not in best[1]]
    return out, active


@pytest.mark.parametrize("band", [False, True])
def test_component_chains_equal_all_chains(band):
    rng = random.Random(9)
    for case in range(50):
        s, rows = seeds(rng, rng.randrange(1, 8))
        rows = [(*r[:5], r[5] + rng.random()) for r in rows]  # no equal scores
        s["weight"] = np.array([r[5] for r in rows])
        scheme = cp.BandScheme(chrom=0, center=3.0, variance=400.0, reach=100) if band else cp.SegmentScheme(repeat=3.0)
        weights = scheme.weights(s)
        if band:
            assert weights[0] == pytest.approx(max(0, rows[0][5] - (15.0 if rows[0][0] or rows[0][1] else 15 * np.tanh((rows[0][2] - 3) ** 2 / 400))))
        found = cp.chains_of(s, np.arange(len(rows)), scheme)
        want, left = plain_extraction(rows, weights, scheme)
        assert [c.score for c in found if len(c.seeds) > 1] == pytest.approx(want), case
        assert sorted(i for c in found if len(c.seeds) == 1 for i in c.seeds) == left
        assert sorted(i for c in found for i in c.seeds) == list(range(len(rows)))


def test_components_equal_reachability():
    rng = random.Random(11)
    for _ in range(40):
        s, rows = seeds(rng, rng.randrange(1, 25))
        scheme = cp.SegmentScheme(least_span=0)
        label = list(range(len(rows)))
        for _ in rows:
            for i, j in itertools.combinations(range(len(rows)), 2):
                a, b = rows[i], rows[j]
                if b[3] - a[4] <= 40 and a[0] == b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 200:
                    label[i] = label[j] = min(label[i], label[j])
        want = sorted([i for i in range(len(rows)) if label[i] == x] for x in set(label))
        assert sorted(g.tolist() for g in cp.components(s, scheme)) == want
        kept = cp.components(s, cp.SegmentScheme(least_span=40))
        assert sorted(g.tolist() for g in kept) == [g for g in want if rows[g[-1]][4] - rows[g[0]][3] >= 40]


def test_reads_come_whole_over_batches(spark):
    rng = random.Random(3)
    data = {}
    for name in ("a", "b", None, ""):
        data[name] = seeds(rng, 30)
    df = spark.createDataFrame([(name, *(x.item() if hasattr(x, "item") else x for x in r), 1) for name, (_, rows) in data.items() for r in rows], KIND + ", chain int").repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = cp.chain_by_breaks(df.drop("chain")).collect()
        parts = cp.chain_components(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    for name, (s, _) in data.items():
        mine = sorted((r for r in got if r.read == name), key=lambda r: r.place)
        want = cp.by_breaks(s)
        assert [r.read_start for r in mine] == s["read_start"][want.seeds].tolist() and mine[0].score == pytest.approx(want.score) and mine[0].step is None
        assert len([r for r in parts if r.read == name]) == sum(len(g) for g in cp.components(s, cp.SegmentScheme()))
    assert cp.chain_by_breaks(df.limit(0)).count() == 0


def test_split_point_of_hand(spark):
    """All split points of two overlapping seeds, by trying them."""
    rng = random.Random(2)
    atoms, pairs, want = [], [], {}
    for n in range(30):
        left = sorted(rng.sample(range(0, 60), rng.randrange(1, 8)))
        right = sorted(rng.sample(range(30, 110), rng.randrange(1, 8)))
        l = [(a, a + 10, rng.choice([0.25, 0.5, 1.0])) for a in left]
        r = [(a, a + 10, rng.choice([0.25, 0.5, 1.0])) for a in right]
        atoms += [(f"l{n}", *x) for x in l] + [(f"r{n}", *x) for x in r]
        pairs.append((n, f"l{n}", f"r{n}"))
        end, start = l[-1][1], r[0][0]
        if start < end:
            points = sorted({x[1] for x in l if x[1] > start} | {x[0] for x in r if x[0] < end})
            cost = {p: sum(x[2] for x in l if x[1] > p) + sum(x[2] for x in r if x[0] < p) for p in points}
            p = min(points, key=lambda p: (cost[p], p))
            want[n] = (p, cost[p], max((x[1] for x in l if x[1] <= p), default=end), min((x[0] for x in r if x[0] >= p), default=start))
    got = cp.split_overlaps(spark.createDataFrame(pairs, "n long, left string, right string"), spark.createDataFrame(atoms, "seed string, start long, end long, weight double"), ["n"])
    assert {r.n: (r.split, r.trimmed, r.left_end, r.right_start) for r in got.collect()} == want


def test_components_take_a_step_a_seed_and_not_a_pair():
    import sys

    n, calls = 600, 0
    start = np.arange(n)
    s = {"read_start": start, "read_end": start + 12, "chrom": np.zeros(n, int), "reverse": np.zeros(n, bool), "diagonal": np.zeros(n, int), "weight": np.ones(n)}

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = cp.components(s, cp.BandScheme())
    finally:
        sys.setprofile(None)
    assert [len(g) for g in found] == [n] and calls < 10 * n  # 179,700 pairs reach each other


def test_reads_that_batches_cut_are_solved_whole(spark):
    rows = spark.createDataFrame([(r, i) for r in [None, 3, 10, 7] for i in range(5)], "read long, v long").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = cp.by_read(rows, "read", {"v": "long"}, ["v"], lambda read, s: [(int(s["v"].sum()), len(s["v"]))], "total long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(((r.read, r.total, r.n) for r in got), key=str) == [(10, 10, 5), (3, 10, 5), (7, 10, 5), (None, 10, 5)]
