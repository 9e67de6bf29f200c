"""Isolated seeds against all pairs in plain Python."""

import random

import pytest

from strandframe.operators import isolation


def plain(rows, rule):
    """Whether each of ``read, chrom, reverse, diagonal, read_start, read_end`` has a neighbour."""

    def follows(a, b):
        if a[:3] != b[:3] or None in a[3:] or None in b[3:] or not (b[4], b[5], b[3]) > (a[4], a[5], a[3]) or b[4] - a[5] > rule.read_gap or a[5] >= b[5]:
            return False
        gap, step = max(b[4] - a[5], 0), (-1 if a[2] else 1) * (b[3] - a[3])
        within = all((rule.low is None or gap + step >= rule.low, rule.high is None or gap + step <= rule.high, rule.shift is None or abs(step) <= rule.shift))
        within = within or rule.expansion is not None and gap + step < rule.low and abs(step) <= rule.expansion
        return within and not (rule.apart and b[4] < a[5] and step)

    return [any(follows(a, b) or follows(b, a) for b in rows) for a in rows]


@pytest.mark.parametrize("rule", [isolation.BY_GAPS, isolation.BY_DEVIATION, isolation.by_edge(expansion=300), isolation.by_edge(50)])
def test_isolated_without_joins(spark, rule, monkeypatch):
    monkeypatch.setattr(isolation, "GATHERED", 40)
    rng = random.Random(4)
    pick = lambda *some: rng.choice([None, *some, *some, *some])
    rows = []
    for _ in range(500):
        start = rng.randrange(6000)
        rows.append((pick("a", "b", "c, d"), pick("x", "y"), pick(True, False), rng.randrange(-2000, 2000), start, start + rng.randrange(10, 160)))
    rows += [(*r[:3], None, *r[4:]) for r in rows[:5]] + rows[5:20]
    df = spark.createDataFrame(rows, "read string, chrom string, reverse boolean, diagonal long, read_start long, read_end long")
    found = isolation.isolated(df, "read", rule)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(*r, not met and (rule.long is None or r[5] - r[4] <= rule.long)) for r, met in zip(rows, plain(rows, rule))]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
