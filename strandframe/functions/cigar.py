"""CIGAR strings as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

QUERY, REFERENCE, ALIGNED = "MIS=X", "MDN=X", "M=X"


def parse(cigar: Column) -> Column:
    """``array<struct<op, len>>`` of a CIGAR string; ``*`` and the empty string have no operations."""
    pairs = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), p.substr(F.lit(1), F.length(p) - 1).cast("long").alias("len")))


_KINDS = np.isin(np.arange(256), np.frombuffer(b"MIDNSHP=X", np.uint8))


def runs(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, operation (its byte) and length of every operation of a batch of CIGAR strings, as ``parse`` finds them."""
    texts = strings.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    at = np.flatnonzero((b < 48) | (b > 57))
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, bounds)))
    width = at - np.maximum(np.concatenate(([-1], at[:-1]))[: len(at)] + 1, bounds[row])
    known = (width > 0) & _KINDS[b[at]]
    at, row, width = at[known], row[known], width[known]
    length = np.zeros(len(at), np.int64)
    for d in range(int(width.max(initial=0))):
        has = width > d
        digit = b[at[has] - 1 - d].astype(np.int64) - 48
        if d >= 18 and digit.any():
            raise OverflowError("a CIGAR operation of 10^18 bases or more")
        length[has] += digit * 10 ** min(d, 18)
    return row, b[at], length


def among(op: np.ndarray, kinds: str) -> np.ndarray:
    """Which of the operations of ``runs`` are of these kinds."""
    return np.isin(op, np.frombuffer(kinds.encode(), np.uint8))


def before(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of ``n`` over the earlier operations of the same row."""
    sums = np.cumsum(n) - n
    first = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    return sums - np.maximum.accumulate(np.where(first, sums, 0)) if len(row) else sums


def total(ops: Column, kinds: str) -> Column:
    """Bases over the operations of these kinds."""
    chosen = F.filter(ops, lambda o: F.lit(kinds).contains(o["op"]))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda n, o: n + o["len"])


def events(ops: Column, kinds: str) -> Column:
    return F.size(F.filter(ops, lambda o: F.lit(kinds).contains(o["op"]))).cast("long")


def text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def query_length(ops: Column, hard: bool = True) -> Column:
    return total(ops, QUERY + "H" * hard)


def reference_span(ops: Column) -> Column:
    return total(ops, REFERENCE)


def edit_distance(ops: Column) -> Column:
    return total(ops, "XID")


def identity(ops: Column) -> Column:
    """Matches over columns; M counts as a column that does not match; 0 without columns."""
    columns = total(ops, "MID=X")
    return F.when(columns > 0, total(ops, "=") / columns).otherwise(F.lit(0.0))


def identity_phred(identity: Column) -> Column:
    """-20 log10(1 - identity), kept within 0 and 60."""
    return F.when(identity >= 1, F.lit(60.0)).otherwise(F.least(F.lit(60.0), F.greatest(F.lit(0.0), -20 * F.log10(1 - identity))))


def query_range(ops: Column, reverse: Column) -> Column:
    """``start, end`` of the aligned part on the forward read, hard clips included."""
    n = F.size(ops)
    first, last = F.get(ops, F.lit(0)), F.get(ops, n - 1)

    def clip(o: Column, then: Column) -> Column:
        inner = F.when(F.lit("SH").contains(then["op"]), then["len"]).otherwise(0)
        return F.coalesce(F.when(F.lit("SH").contains(o["op"]), o["len"] + F.coalesce(inner, F.lit(0))), F.lit(0))

    left, right = clip(first, F.get(ops, F.lit(1))), F.when(n > 1, clip(last, F.get(ops, n - 2))).otherwise(F.lit(0))
    length = query_length(ops)
    return F.struct(F.when(reverse, right).otherwise(left).alias("start"), (length - F.when(reverse, left).otherwise(right)).alias("end"))


OPS = "array<struct<op:string,len:bigint>>"


def normalize(ops: Column) -> Column:
    """Without empty operations, and with neighbours of one kind joined."""

    def join(out: Column, o: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.array(F.struct(o["op"].alias("op"), (last["len"] + o["len"]).alias("len")))
        return F.when(F.coalesce(last["op"] == o["op"], F.lit(False)), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), longer)).otherwise(F.concat(out, F.array(o)))

    return F.aggregate(F.filter(ops, lambda o: o["len"] > 0), F.array().cast(OPS), join)


def basic(cigar: Column) -> Column:
    """The string with = and X as M, neighbouring M runs joined."""
    return text(normalize(F.transform(parse(cigar), lambda o: F.struct(F.when(F.lit("=X").contains(o["op"]), "M").otherwise(o["op"]).alias("op"), o["len"].alias("len")))))


def join(*parts: Column) -> Column:
    """The operations of the parts one after the other, normalised."""
    return normalize(F.concat(*parts))


def placed(ops: Column) -> Column:
    """Operations with the read and reference offsets where they begin: ``op, len, q, r``."""
    empty = F.array().cast("array<struct<op:string,len:bigint,q:bigint,r:bigint>>")
    zero = F.lit(0).cast("long")

    def step(acc: Column, o: Column) -> Column:
        q = acc["q"] + F.when(F.lit(QUERY).contains(o["op"]), o["len"]).otherwise(zero)
        r = acc["r"] + F.when(F.lit(REFERENCE).contains(o["op"]), o["len"]).otherwise(zero)
        return F.struct(q.alias("q"), r.alias("r"), F.concat(acc["out"], F.array(F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["q"].alias("q"), acc["r"].alias("r")))).alias("out"))

    return F.aggregate(ops, F.struct(zero.alias("q"), zero.alias("r"), empty.alias("out")), step, lambda acc: acc["out"])


def split_at(ops: Column, pos: Column) -> Column:
    """``head, tail``: the operations before and from the reference offset ``pos`` on; null if there are fewer reference bases.

    An insertion or clip right at the border goes to the tail, one before it to the head.
    """
    at = placed(ops)
    on = lambda o: F.lit(REFERENCE).contains(o["op"])
    part = lambda o, n: F.struct(o["op"].alias("op"), n.cast("long").alias("len"))
    head = F.transform(F.filter(at, lambda o: o["r"] < pos), lambda o: part(o, F.when(on(o), F.least(o["len"], pos - o["r"])).otherwise(o["len"])))
    rest = F.filter(at, lambda o: (o["r"] >= pos) | on(o) & (o["r"] + o["len"] > pos))
    tail = F.transform(rest, lambda o: part(o, F.when(on(o), o["len"] - F.greatest(pos - o["r"], F.lit(0))).otherwise(o["len"])))
    return F.when(reference_span(ops) >= pos, F.struct(head.alias("head"), tail.alias("tail")))


def identity_longest(ops: Column) -> Column:
    """Matches over the longer of read and reference, clips left out; 1 without either."""
    longest = F.greatest(total(ops, "=XI"), total(ops, "=XD"))
    return F.when(longest > 0, total(ops, "=") / longest).otherwise(F.lit(1.0))


def indel_cost(n: Column, opens: tuple[float, float], extends: tuple[float, float]) -> Column:
    """The less of two affine prices of an indel: one for short, one for long gaps."""
    return F.least(*(F.lit(float(a)) + F.lit(float(b)) * n for a, b in zip(opens, extends)))


def _priced(ops: Column, price: Callable[[Column], Column]) -> Column:
    return F.aggregate(ops, F.lit(0.0), lambda t, o: t + F.coalesce(price(o).cast("double"), F.lit(0.0)))


def divergence(ops: Column, mismatch: float = 4.0, opens: tuple[float, float] = (6.0, 26.0), extends: tuple[float, float] = (2.0, 1.0)) -> Column:
    """Price of mismatches and indels; matches and clips are free."""
    return _priced(ops, lambda o: F.when(o["op"] == "X", o["len"] * mismatch).when(F.lit("ID").contains(o["op"]), indel_cost(o["len"], opens, extends)))


def quality(ops: Column, match: float = 2.0, mismatch: float = 4.0, opens: tuple[float, float] = (6.0, 26.0), extends: tuple[float, float] = (2.0, 1.0)) -> Column:
    """What matches earn less the price of the rest."""
    return total(ops, "=") * match - divergence(ops, mismatch, opens, extends)


def alignment_bits(ops: Column, match: float = 2.0, mismatch: float = 8.0, gap_open: float = 6.0, gap_extend: float = 1.0) -> Column:
    """Score in bits: matches (= and M) earn, mismatches and indels cost, clips are free."""
    return _priced(ops, lambda o: F.when(F.lit("=M").contains(o["op"]), o["len"] * match).when(o["op"] == "X", -o["len"] * mismatch).when(F.lit("ID").contains(o["op"]), -(gap_open + gap_extend * o["len"])))


def left_aligned(cigar: str, query: str, reference: str) -> str:
    """The string with each indel as far left as equal bases let it go through = and X before it."""
    query, reference = query.upper(), reference.upper()
    out: list[tuple[str, int]] = []  # runs so far
    q = r = 0
    runs = [(op, int(n)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar) if int(n)]
    for op, group in groupby(runs, key=lambda x: x[0]):
        n = sum(size for _, size in group)
        shift = 0
        if op in "ID":
            bases, at = (query, q) if op == "I" else (reference, r)
            room = sum(size for _, size in takewhile(lambda x: x[0] in "=X", reversed(out)))
            while shift < min(room, at) and bases[at - 1 - shift] == bases[at + n - 1 - shift]:
                shift += 1
        passed, left = [], shift
        while left:  # the columns that the indel goes past
            kind, size = out.pop()
            if size > left:
                out.append((kind, size - left))
            passed.append((kind, min(size, left)))
            left -= passed[-1][1]
        out += [(op, n), *reversed(passed)]
        q += n * (op in QUERY)
        r += n * (op in REFERENCE)
    return "".join(f"{sum(size for _, size in group)}{op}" for op, group in groupby(out, key=lambda x: x[0]))


@F.pandas_udf(StringType())
def left_align(cigar: pd.Series, query: pd.Series, reference: pd.Series) -> pd.Series:
    """Column form of ``left_aligned``; null where an argument is."""
    return pd.Series([None if None in row else left_aligned(*row) for row in zip(cigar, query, reference)], dtype=object)


def picture(cigar: str, query: str, reference: str) -> str:
    """Three lines: the reference, bars under equal bases, the read; clips left out."""
    top, bars, low, q, r = "", "", "", 0, 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        a = reference[r : r + n] if op in REFERENCE else "-" * n
        b = query[q : q + n] if op in QUERY else "-" * n
        if op not in "SHP":
            top, low = top + a, low + b
            bars += "".join("|" if x == y else " " for x, y in zip(a, b))
        q += n * (op in QUERY)
        r += n * (op in REFERENCE)
    return f"{top}\n{bars}\n{low}"
