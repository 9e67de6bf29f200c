"""Schedules of many reads at once: against the program a read at a time, over batches that cut reads."""

import random

import numpy as np
import pytest

from strandframe.operators import filters


def _plain(rows, overlap, gap_cost):
    """``chain, place, score`` of one read by the program in plain loops; ``rows (chain, start, end, score)``."""
    rows = sorted(sorted(rows), key=lambda r: (r[2], -r[1]))
    value, came = [], []
    for i, (_, start, _, weight) in enumerate(rows):
        value.append(weight)
        came.append(-1)
        for j in range(i):
            joined = value[j] + weight - gap_cost * max(0, start - rows[j][2])
            if rows[j][2] <= start + overlap and joined > value[i]:
                value[i], came[i] = joined, j
    at = value.index(max(value))
    top, picked = value[at], []
    while at >= 0:
        picked.append(rows[at][0])
        at = came[at]
    return [(c, p, top) for p, c in enumerate(picked[::-1])]


@pytest.mark.parametrize("batch", [1, 4, 1000])
def test_reads_of_a_batch_go_together(spark, batch):
    rng = random.Random(batch)
    reads = {r: [(c, s := rng.randrange(60), s + rng.randrange(1, 30), float(rng.randrange(1, 20))) for c in range(rng.randrange(1, 10))] for r in [None, *range(80)]}
    rows = spark.createDataFrame([(r, *c) for r, chains in reads.items() for c in chains], "name long, chain long, start long, end long, score double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, filters.schedule(rows, "name", 5, 0.1).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == sorted(((r, *x) for r, chains in reads.items() for x in _plain(chains, 5, 0.1)), key=str)
    assert filters.schedule(rows.limit(0), "name").count() == 0


def test_many_reads_are_one_program():
    start = np.random.default_rng(1).integers(0, 60, (1000, 6))
    end, weight = start + 1 + start[::-1] % 30, (start[:, ::-1] % 19 + 1).astype(float)
    top, picked = filters.best_schedules(start, end, weight, 5, 0.1)
    for i in range(1000):
        want = _plain([(c, *x) for c, x in enumerate(zip(start[i].tolist(), end[i].tolist(), weight[i].tolist()))], 5, 0.1)
        assert [(c, p, top[i]) for p, c in enumerate(picked[i][picked[i] >= 0])] == want
