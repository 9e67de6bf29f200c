"""Extension of alignments until the score drops: an anti-diagonal program with a band that follows the best cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar
from ..functions.sequence import revcomp
from ..session import prepare
from .reference import WIDTH, windows

EXTENDED = T.StructType([T.StructField("score", T.LongType()), T.StructField("query", T.LongType()), T.StructField("target", T.LongType()), T.StructField("cigar", T.StringType())])
#: Fixed value: how far the score may fall below the best before an extension ends.
X_DROP = 400
_NONE = -(1 << 29)


def extend(query: str, target: str, x: int = X_DROP, match: int = 1, mismatch: int = 1, open_: int = 6, extend_: int = 2) -> tuple[int, int, int, str]:
    """``score, query bases, target bases, CIGAR`` of the best alignment that begins at both starts.

    A gap of n costs ``open_ + extend_ * (n - 1)``. Cells whose score is more than ``x`` below the best so far are
    left, and the program ends when an anti-diagonal has none left. Of equal ends the nearest counts.
    """
    return extend_all([query], [target], x, match, mismatch, open_, extend_)[0]


def _flat(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts, and where each starts and how long it is."""
    lengths = np.array([len(s) for s in texts], np.int64)
    return np.frombuffer(("".join(texts) + "\0").encode("utf-32-le"), np.uint32), np.cumsum(lengths) - lengths, lengths


def extend_all(queries: Sequence[str], targets: Sequence[str], x: int = X_DROP, match: int = 1, mismatch: int = 1, open_: int = 6, extend_: int = 2) -> list[tuple[int, int, int, str]]:
    """``extend`` of many pairs, one anti-diagonal of all of them at a time.

    An anti-diagonal holds the rows from each pair's first to its last live cell, and pairs without any are left out.
    One byte of each cell is kept for the way back, so memory goes with the bands.
    """
    (q, q0, n_all), (t, t0, m_all) = _flat(queries), _flat(targets)
    count = len(n_all)
    best, end = np.zeros(count, np.int32), np.zeros((count, 2), np.int64)
    ids, n, m, qs, ts = np.arange(count), n_all, m_all, q0, t0
    # of the last two anti-diagonals: the row of the first column; score, best ending in a query gap (up), in a target gap (left)
    none = lambda: np.full((count, 1), _NONE, np.int32)
    base, score, up, left = np.zeros(count, np.int64), np.zeros((count, 1), np.int32), none(), none()
    before_base, before = base, none()
    first, last = base, base  # live rows
    where = ids
    ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(base, np.zeros((count, 1), np.uint8), where)]

    def at(low: np.ndarray, rows: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        spot, width = rows - low[:, None], values[0].shape[1]
        outside, spot = (spot < 0) | (spot >= width), np.clip(spot, 0, width - 1)
        found = [np.take_along_axis(v, spot, axis=1) for v in values]
        for f in found:
            f[outside] = _NONE
        return found

    d = 0
    while True:
        d += 1
        low, high = np.maximum(first, d - m), np.minimum(np.minimum(last + 1, n), d)
        go = low <= high
        if not go.all():
            ids, n, m, qs, ts, base, score, up, left, before_base, before, low, high = (v[go] for v in (ids, n, m, qs, ts, base, score, up, left, before_base, before, low, high))
            where = np.full(count, -1)  # shared by the anti-diagonals of the same pairs
            where[ids] = np.arange(len(ids))
        if not len(ids):
            break
        rows = low[:, None] + np.arange(int((high - low).max()) + 1)
        above, above_up = at(base, rows - 1, score, up)
        beside, beside_left = at(base, rows, score, left)
        (corner,) = at(before_base, rows - 1, before)
        up, left = np.maximum(above - open_, above_up - extend_), np.maximum(beside - open_, beside_left - extend_)
        inner = (rows > 0) & (rows < d)
        same = q[qs[:, None] + np.clip(rows - 1, 0, np.maximum(n - 1, 0)[:, None])] == t[ts[:, None] + np.clip(d - rows - 1, 0, np.maximum(m - 1, 0)[:, None])]
        diagonal = np.where(inner, corner + np.where(same, np.int32(match), np.int32(-mismatch)), np.int32(_NONE))
        before_base, before = base, score
        base, score = low, np.maximum(diagonal, np.maximum(up, left))
        way = (diagonal == score).astype(np.uint8) | (up == score).astype(np.uint8) << 1 | (up == above - open_).astype(np.uint8) << 2 | (left == beside - open_).astype(np.uint8) << 3
        live = (score >= (best[ids] - x)[:, None]) & (rows <= high[:, None])
        for v in (score, up, left):
            v[~live] = _NONE
        ways.append((low.astype(np.int32), way, where))
        top = np.argmax(score, axis=1)
        value = score[np.arange(len(ids)), top]
        better = value > best[ids]  # a cell that is dead is never above the best
        best[ids[better]] = value[better]
        end[ids[better], 0], end[ids[better], 1] = (low + top)[better], (d - low - top)[better]
        first, last = low + np.argmax(live, axis=1), low + live.shape[1] - 1 - np.argmax(live[:, ::-1], axis=1)
        ended = ~live.any(axis=1)
        first[ended], last[ended] = d + 2, -1
    return [(int(best[k]), int(end[k, 0]), int(end[k, 1]), _way_back(k, *end[k].tolist(), ways, q[q0[k]:], t[t0[k]:])) for k in range(count)]


def _way_back(k: int, i: int, j: int, ways: list[tuple[np.ndarray, np.ndarray, np.ndarray]], q: np.ndarray, t: np.ndarray) -> str:
    """CIGAR of pair ``k`` from its best cell back to the starts."""
    runs, state = [], "H"
    while i or j:
        low, way, where = ways[i + j]
        row = where[k]
        bits = int(way[row, i - low[row]])
        if state == "H":
            state = "H" if bits & 1 else "I" if bits & 2 else "D"
            if bits & 1:
                op, i, j = "=" if q[i - 1] == t[j - 1] else "X", i - 1, j - 1
            else:
                continue
        elif state == "I":
            op, i, state = "I", i - 1, "H" if bits & 4 else "I"
        else:
            op, j, state = "D", j - 1, "H" if bits & 8 else "D"
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return "".join(f"{k}{op}" for k, op in reversed(runs))


#: Pairs, and anti-diagonals of all pairs, that go through the program together.
TOGETHER, STEPS = 512, 1 << 18


def xdrop(query: Column, target: Column, x: int = X_DROP) -> Column:
    """``struct<score, query, target, cigar>`` of ``extend``; null where either is null. Pairs of a batch that are alike in length go together."""

    @F.pandas_udf(EXTENDED)
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None,) * 4] * len(q)
        steps = [0 if a is None or b is None else min(2 * min(len(a), len(b)) + x, len(a) + len(b)) for a, b in zip(q, t)]
        left = sorted((k for k, (a, b) in enumerate(zip(q, t)) if a is not None and b is not None), key=steps.__getitem__)
        while left:
            taken, size = 0, 0
            while taken < min(len(left), TOGETHER) and (not taken or size + steps[left[taken]] <= STEPS):
                size += steps[left[taken]]
                taken += 1
            group, left = left[:taken], left[taken:]
            for k, found in zip(group, extend_all([q[k] for k in group], [t[k] for k in group], x)):
                out[k] = found
        return pd.DataFrame(out, columns=EXTENDED.names)

    return run(query, target)


def extend_ends(parts: DataFrame, reads: DataFrame, reference: DataFrame, read: str = "read", x: int = X_DROP, pad: int = 10_000, width: int = WIDTH) -> DataFrame:
    """``parts (read, part, chrom, reverse, read_start, read_end, ref_start, ref_end)`` grown into the read's unaligned ends: the same columns, and ``left_cigar, right_cigar, left_score, right_score``.

    The first part of a read grows to the left of the read, the last to the right (by ``read_start``), over as much of
    the reference as twice the end's length or ``pad`` beyond it, whichever is less. CIGARs are in the order of the
    reference: ``left_cigar`` goes before the part's own. Ends without a gain stay, with an empty CIGAR.
    Windows of the reference come from its blocks. Parts without a read or contig stay as they are.
    """
    prepare(parts.sparkSession)
    keys = [read, "part"]
    ends = parts.groupBy(read).agg(F.min(F.struct("read_start", "part"))["part"].alias("_first"), F.max(F.struct("read_start", "part"))["part"].alias("_last"))
    rows = parts.join(ends, read).join(reads.select(read, F.col("seq").alias("_seq")), read, "left")
    n = F.length("_seq")
    head = F.when(F.col("part") == F.col("_first"), F.col("read_start")).otherwise(F.lit(0))
    tail = F.when(F.col("part") == F.col("_last"), F.greatest(n - F.col("read_end"), F.lit(0))).otherwise(F.lit(0))
    back = F.col("reverse")
    # on the reference's low side stands the read's head, or its tail turned round
    low_n, high_n = F.when(back, tail).otherwise(head), F.when(back, head).otherwise(tail)
    text = lambda start, size: F.substring("_seq", (start + 1).cast("int"), size.cast("int"))
    before, after = text(F.col("read_start") - head, head), text(F.col("read_end"), tail)
    room = lambda k: F.least(2 * k, k + pad)
    sides = F.array(
        F.struct(F.lit("low").alias("side"), F.when(back, revcomp(after)).otherwise(before).alias("flank"), (F.col("ref_start") - room(low_n)).alias("start"), F.col("ref_start").alias("end")),
        F.struct(F.lit("high").alias("side"), F.when(back, revcomp(before)).otherwise(after).alias("flank"), F.col("ref_end").alias("start"), (F.col("ref_end") + room(high_n)).alias("end")),
    )
    asked = rows.select(*keys, "chrom", F.explode(sides).alias("e")).select(*keys, "chrom", "e.*").where(F.length("flank") > 0)
    met = windows(asked, reference, [*keys, "side"], ["flank"], width)
    low = F.col("side") == "low"
    turn = lambda c: F.when(low, F.reverse(c)).otherwise(F.col(c))
    grown = met.withColumn("x", xdrop(turn("flank"), turn("bases"), x))
    way = F.when(low, cigar.text(F.reverse(cigar.parse(F.col("x.cigar"))))).otherwise(F.col("x.cigar"))
    per = grown.select(*keys, "side", F.struct(F.col("x.query").alias("q"), F.col("x.target").alias("t"), F.col("x.score").alias("score"), way.alias("cigar")).alias("g"))
    wide = per.groupBy(*keys).agg(*(F.max(F.when(F.col("side") == s, F.col("g"))).alias(f"_{s}") for s in ("low", "high")))
    got = lambda s, f, other: F.coalesce(F.col(f"_{s}.{f}"), F.lit(other))
    out = parts.join(wide, keys, "left")
    grow = {
        "read_start": F.col("read_start") - F.when(back, got("high", "q", 0)).otherwise(got("low", "q", 0)), "read_end": F.col("read_end") + F.when(back, got("low", "q", 0)).otherwise(got("high", "q", 0)),
        "ref_start": F.col("ref_start") - got("low", "t", 0), "ref_end": F.col("ref_end") + got("high", "t", 0),
    }
    more = [got("low", "cigar", "").alias("left_cigar"), got("high", "cigar", "").alias("right_cigar"), got("low", "score", 0).alias("left_score"), got("high", "score", 0).alias("right_score")]
    return out.select(*(grow[c].alias(c) if c in grow else F.col(c) for c in parts.columns), *more)
