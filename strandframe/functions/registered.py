"""The package's functions under names that SQL text can use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import alignment
from ..session import prepare
from . import cigar
from .sequence import codes_of, syncmer_mask, windows

#: Name, arguments, result and body of the SQL functions: plain expressions, which the optimiser sees through.
EXPRESSIONS = (
    ("sf_revcomp", "bases STRING", "STRING", "reverse(translate(regexp_replace(bases, '[^ACGTacgt]', 'N'), 'ACGTacgt', 'TGCATGCA'))"),
    ("sf_size_band", "n BIGINT", "BIGINT", "CASE WHEN n < 1 THEN 0 ELSE shiftleft(1L, length(bin(n)) - 1) END"),
    ("sf_query_length", "cigar STRING", "BIGINT", "aggregate(regexp_extract_all(cigar, '([0-9]+)[MISHX=]', 1), 0L, (n, x) -> n + cast(x AS BIGINT))"),
    ("sf_edit_distance", "cigar STRING", "BIGINT", "aggregate(regexp_extract_all(cigar, '([0-9]+)[XID]', 1), 0L, (n, x) -> n + cast(x AS BIGINT))"),
    ("sf_identity", "cigar STRING", "DOUBLE", "aggregate(regexp_extract_all(cigar, '([0-9]+)[=]', 1), 0L, (n, x) -> n + cast(x AS BIGINT)) / nullif(aggregate(regexp_extract_all(cigar, '([0-9]+)[=XID]', 1), 0L, (n, x) -> n + cast(x AS BIGINT)), 0)"),
    ("sf_ref_span", "cigar STRING", "BIGINT", "aggregate(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), 0L, (n, x) -> n + cast(x AS BIGINT))"),
    ("sf_overlap", "a BIGINT, b BIGINT, c BIGINT, d BIGINT", "BIGINT", "greatest(0L, least(b, d) - greatest(a, c))"),
)


def _found(text: str | None, k: int, s: int | None) -> Iterator[tuple[int, int]]:
    """``pos, kmer`` of the valid k-mers, or of the syncmers if ``s`` is given; a null sequence has none."""
    codes = codes_of(text or "")
    code, good = windows(codes, k)
    if s is not None and len(good):
        good = good & syncmer_mask(codes, k, s, both=True)
    at = np.flatnonzero(good)
    return zip(at.tolist(), code[at].astype(np.int64).tolist())


class Kmers:
    """``sf_kmers(seq, k)``: one row for each k-mer of valid bases, ``pos`` (from 0) and ``kmer`` (its code)."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, int]]:
        yield from _found(seq, k, None)


class Syncmers:
    """``sf_syncmers(seq, k, s)``: the k-mers that are open syncmers of s-mers on either strand."""

    def eval(self, seq: str, k: int, s: int) -> Iterator[tuple[int, int]]:
        yield from _found(seq, k, s)


def _align(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if a is None or b is None else alignment.align(a, b) for a, b in zip(query, target)]
    return pd.DataFrame(rows, columns=["score", "cigar"])


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL: expressions as SQL functions, byte loops as Arrow UDFs and table functions.

    Table functions are called as ``FROM t, LATERAL sf_kmers(t.seq, 20)``, which adds their rows to each row of ``t`` where it
    stands; nothing is shuffled.
    """
    prepare(spark)
    for name, arguments, result, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("sf_left_align", cigar.left_align)
    spark.udf.register("sf_align", F.pandas_udf(_align, alignment.ALIGNED))
    spark.udtf.register("sf_kmers", F.udtf(Kmers, returnType="pos bigint, kmer bigint", useArrow=True))
    spark.udtf.register("sf_syncmers", F.udtf(Syncmers, returnType="pos bigint, kmer bigint", useArrow=True))
