"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of every operator: the class [\x20\x09-\x0D].
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def by_size(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``most`` at the most (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def prefix_sum(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``key``, in (bucket, order) order, as column ``out``.

    Rows are windowed per (key, bucket) only, so a key with a third of all rows is spread over its
    buckets; the bucket totals, one row each, carry the sums across. Null keys form one key.
    """
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy(F.col(key).alias("_k"), F.col(bucket).alias("_b")).agg(F.sum(value).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    )
    rows = df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col(bucket) == F.col("_b"))
    return rows.join(totals, same).withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_k", "_b", "_n", "_base")


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, ``_row``, so that no name of theirs can clash with a helper column."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``k1, k2``: the id and a hash of id and text. Rows that share both are repeats of one row."""
    return [F.col(id_col).cast("long").alias("k1"), F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).alias("k2")]


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is in ``keys (k1, k2)``, one for each key, with their columns as they were.

    The texts are exchanged once: the window over the keys finds them as the join left them.
    """
    k1, k2 = row_key(id_col, text_col)
    some = F.lit(-(1 << 63))  # k2 holds whether the id is null, so any number will do for it
    rows = docs.select(whole_row(docs), F.coalesce(k1, some).alias("k1"), k2)
    wanted = keys.select(F.coalesce("k1", some).alias("k1"), "k2").distinct()
    found = rows.join(wanted, ["k1", "k2"], "left_semi")
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return found.withColumn("_n", first).where("_n = 1").select("_row.*")
