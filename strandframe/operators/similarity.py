"""Vectors: frequency vectors, cosine joins, clusters, representatives, farthest-first traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import connected_components


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


#: Numbers that are exchanged as they are.
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def cosine_pairs(vectors: DataFrame, id_col: str, vector_col: str, group_col: str | None, threshold: float, block: int = 8192) -> DataFrame:
    """``a, b, cosine`` for all pairs a < b of a group with a cosine of ``threshold`` or more.

    Vectors are dealt to blocks; each pair of blocks of a group is one matrix product in a task, so a
    group of any size is spread over tasks and only pairs over the threshold leave them. A vector goes to as
    many cells as its group has blocks, as wide as its numbers came: short ones stay short. Null or empty
    vectors take no part; a zero vector has cosine 0 with any other.
    """
    group = F.lit(0) if group_col is None else F.col(group_col)
    kind = vectors.schema[vector_col].dataType.elementType
    held = F.col(vector_col) if isinstance(kind, _PLAIN) else F.col(vector_col).cast("array<double>")
    rows = vectors.select(group.alias("g"), F.col(id_col).cast("long").alias("id"), held.alias("v")).where("v is not null and size(v) > 0")
    blocks = rows.groupBy(F.col("g").alias("g2")).agg((1 + F.floor(F.count("*") / block)).cast("int").alias("n"))  # each group has its own number
    rows = rows.join(blocks, F.col("g").eqNullSafe(F.col("g2"))).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    cells = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("g", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "id", "v")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        k, ids = table["k"].to_numpy(), table["id"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        unit = (x / np.where(size > 0, size, 1)[:, None]).astype(np.float32)
        least = threshold - (x.shape[1] + 8) * 2.0**-23  # what single precision may lose; the score of those over it is made in double
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        found, other = [], unit[right].T
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            a, b = np.nonzero(unit[part] @ other >= least)
            a, b = part[a], right[b]
            if i == j:
                once = ids[a] < ids[b]
                a, b = a[once], b[once]
            score = (x[a] * x[b]).sum(axis=1) / np.where(size[a] * size[b] > 0, size[a] * size[b], 1)
            ok = score >= threshold
            found.append((np.minimum(ids[a], ids[b])[ok], np.maximum(ids[a], ids[b])[ok], score[ok]))
        return pa.table(dict(zip(("a", "b", "cosine"), (np.concatenate(c) for c in zip(*found))))) if found else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    return cells.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long, cosine double")


def clusters(vectors: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """``id, cluster``: components of the pairs, every vector in one; a cluster is its least id."""
    found = connected_components(pairs, "a", "b")
    return vectors.select(F.col(id_col).cast("long").alias("id")).join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


def representatives(members: DataFrame, cluster: str, size: str, id_col: str) -> DataFrame:
    """The longest member of each cluster, the least id on ties, with the cluster's size. By partial aggregation."""
    best = F.max(F.struct(F.col(size).alias("size"), (-F.col(id_col)).alias("i")))
    return members.groupBy(cluster).agg(best.alias("b"), F.count("*").alias("members")).select(cluster, (-F.col("b.i")).alias("representative"), F.col("b.size").alias("size"), "members")


def log_band(n: Column) -> Column:
    """Lower bound of the size bands 1, 2, 3-5, 6-11, 12-23, ... (each begins at twice the last, from 3)."""
    return F.when(n <= 2, n).otherwise(3 * F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2((n + 0.5) / 3)).cast("int"))).cast("long")


def farthest_first(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, least: float, most: int, size_col: str | None = None) -> DataFrame:
    """``group, rank, id, similarity``: from the longest member on, the one least similar to all taken, until every one is within ``least``.

    ``size_col`` says how long a member is (else its vector's norm does). Null and zero vectors take no
    part. Each group is one task that holds its vectors once: groups must fit a worker.
    """
    size = F.lit(None).cast("double") if size_col is None else F.col(size_col).cast("double")
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(group_col).alias("group"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), size.alias("size"))
    rows = rows.where(F.exists("v", lambda x: x != 0))

    def traverse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.vstack(pdf["v"].to_numpy())
        size = np.sqrt((x * x).sum(axis=1))
        unit = x / np.where(size > 0, size, 1)[:, None]
        first = size if size_col is None else pdf["size"].to_numpy()
        at, near, out = int(np.argmax(first)), np.full(len(x), -np.inf), []
        score = 1.0
        while len(out) < most:
            out.append((pdf["group"].iloc[0], len(out), int(pdf["id"].iloc[at]), float(score)))
            near = np.maximum(near, unit @ unit[at])
            near[at] = np.inf
            at = int(np.argmin(near))
            score = near[at]
            if not score < least:
                break
        return pd.DataFrame(out, columns=["group", "rank", "id", "similarity"])

    return rows.groupBy("group").applyInPandas(traverse, f"group {rows.schema['group'].dataType.simpleString()}, rank int, id long, similarity double")


def kmer_vectors(df: DataFrame, id_col: str, seq_col: str, k: int = 5, kept: list[str] | None = None) -> DataFrame:
    """``id, *kept, vector``: counts of all 4**k k-mers; scaled down to 255 where one is over it."""
    kept = kept or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.sequence import _CODES, windows

        for batch in batches:
            out = []
            for seq in batch.column(1).to_pylist():
                code, good = windows(_CODES[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)], k)
                n = np.minimum(np.bincount(code[good].astype(np.int64), minlength=4**k), 65535)
                out.append(n if n.max(initial=0) <= 255 else n * 255 // n.max())
            flat = np.concatenate(out).astype(np.int16) if out else np.zeros(0, np.int16)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * 4**k), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], counts], names=[id_col, *kept, "vector"])

    more = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(F.col(id_col).cast("long").alias(id_col), seq_col, *kept).mapInArrow(run, f"`{id_col}` long, {more}vector array<short>")


def top_candidates(hits: DataFrame, query: str, target: str, n_query: str, n_target: str, least: float = 0.15, most: int = 5, strand: str | None = None) -> DataFrame:
    """Targets that share ``least`` of the smaller side's seeds with a query, the best ``most`` of each query, or of each query and ``strand``."""
    of = [query, *([strand] if strand else [])]
    shared = hits.groupBy(*of, target).agg(F.countDistinct("kmer").alias("shared"), F.first(n_query).alias("nq"), F.first(n_target).alias("nt"))
    score = F.col("shared") / F.least("nq", "nt")
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), target))
    return shared.withColumn("score", score).where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most).select(*of, "rank", target, "shared", "score")
