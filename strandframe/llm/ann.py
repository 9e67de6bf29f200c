"""Approximate nearest neighbours by a forest of hash prefixes (operator 5).

Vectors are dealt to shards. In a shard every tree is a sorted array of long hash strings, one bit for
each random hyperplane. A query descends each tree to its longest matching prefix and then ascends all
trees together, one bit at a time, until the prefixes hold enough candidates; the candidates are scored
exactly in double precision. All shards are asked, in blocks of queries, and their best are merged.

How many candidates are enough depends on the vectors, so it is measured: a shard is cut into bands of
similar length, and each band's number is doubled until a sample of the queries finds nearly all that exact
scores find, up to the whole band. A band whose lengths cannot reach a query's best is not asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a shard and queries of a block, about: bounds of a task's memory.
SHARD, BLOCK = 16384, 16384
#: Trees, bits of a hash string, and candidates that a query wants of a band at first, repeats over the trees counted.
TREES, BITS, WANTED = 96, 24, 2500
#: Share of the true neighbours that a sample of SAMPLE queries must find before the number of candidates is settled.
RECALL, SAMPLE = 0.97, 64
#: A band's longest vector is at most so many times as long as its shortest; bands of up to SMALL vectors are scored as a whole.
SPREAD, SMALL = 1.2, 512


def planes(dimension: int, trees: int = TREES, bits: int = BITS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, trees * bits))


def hash_strings(x: np.ndarray, normals: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row for each tree: the hash string of each vector, first bit highest."""
    trees = normals.shape[1] // bits
    out = np.empty((trees, len(x)), np.uint32)
    for at in range(0, len(x), 1024):
        signs = np.zeros((min(1024, len(x) - at), trees, 32), bool)
        signs[:, :, 32 - bits :] = (x[at : at + 1024] @ normals > 0).reshape(-1, trees, bits)
        out[:, at : at + 1024] = np.packbits(signs, axis=2).view(">u4")[:, :, 0].T
    return out


class Forest:
    """Sorted arrays of hash strings over the vectors of a shard."""

    def __init__(self, x: np.ndarray, bits: int = BITS, trees: int = TREES):
        self.bits, self.normals = bits, planes(x.shape[1] + 1, trees, bits)
        size = (x * x).sum(axis=1)
        # one more component makes all vectors equally long, so the largest inner product is the least angle
        keys = hash_strings(np.column_stack([x, np.sqrt(size.max(initial=0) - size)]), self.normals, bits)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def depths(self, strings: np.ndarray) -> np.ndarray:
        """For each query the longest prefix that any tree matches: the descent."""
        best = np.zeros(strings.shape[1], np.int64)
        for keys, wanted in zip(self.keys, strings):
            at = np.searchsorted(keys, wanted)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(keys) - 1)):
                _, length = np.frexp((keys[near] ^ wanted).astype(float))
                best = np.maximum(best, self.bits - length)
        return best

    def candidates(self, queries: np.ndarray, wanted: int = WANTED) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the shard for all queries in order, and where each query's begin: all trees ascend together until their prefixes hold ``wanted``."""
        strings = hash_strings(np.column_stack([queries, np.zeros(len(queries))]), self.normals, self.bits)
        level = self.depths(strings)
        low = np.zeros(strings.shape, np.int64)
        high = np.zeros(strings.shape, np.int64)
        rising = np.arange(len(queries))
        while len(rising):
            shift = (self.bits - level[rising]).astype(np.uint32)
            for t, keys in enumerate(self.keys):
                first = strings[t, rising] >> shift << shift
                low[t, rising] = np.searchsorted(keys, first)
                high[t, rising] = np.searchsorted(keys, first + ((np.uint32(1) << shift) - np.uint32(1)), side="right")
            enough = (high[:, rising] - low[:, rising]).sum(axis=0) >= wanted
            rising = rising[~enough & (level[rising] > 0)]
            level[rising] -= 1
        n = (high - low).T.ravel()  # query by query, tree by tree
        at = np.repeat(low.T.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
        tree = np.repeat(np.tile(np.arange(len(self.keys)), len(queries)), n)
        query = np.repeat(np.repeat(np.arange(len(queries)), len(self.keys)), n)
        mask = np.zeros((len(queries), self.keys.shape[1]), bool)
        mask[query, self.order[tree, at]] = True
        return np.nonzero(mask)[1], np.concatenate([[0], np.cumsum(mask.sum(axis=1))])


def bands(lengths: np.ndarray) -> list[np.ndarray]:
    """Rows by falling length, cut where a vector is more than SPREAD times shorter than the band's longest and the band is not small."""
    order = np.argsort(-lengths, kind="stable")
    falling, out, at = lengths[order], [], 0
    while at < len(order):
        end = max(int(np.searchsorted(-falling, -falling[at] / SPREAD, side="right")), min(at + SMALL, len(order)))
        out.append(order[at:end])
        at = end
    return out


class Shard:
    """The bands of a shard, each with its forest and the number of candidates that the sample asked for; None scores the whole band."""

    def __init__(self, x: np.ndarray, sample: np.ndarray, k: int, recall: float = RECALL, wanted: int = WANTED):
        self.x, self.lengths = x, np.sqrt((x * x).sum(axis=1))
        self.bands, self.scored, self.asked = bands(self.lengths), 0, 0
        self.forests: list[tuple[Forest, int] | None] = [None] * len(self.bands)
        top = np.argsort(-(sample @ x.T), axis=1, kind="stable")[:, : k + 1]  # a query may be its own nearest
        for b, rows in enumerate(self.bands):
            true = np.zeros((len(sample), len(x)), bool)
            np.put_along_axis(true, top, True, axis=1)
            true = true[:, rows]
            if len(rows) <= SMALL or not true.any():
                continue
            forest, want = Forest(x[rows]), wanted
            while True:
                found, cuts = forest.candidates(sample, want)
                hits = true[np.repeat(np.arange(len(sample)), np.diff(cuts)), found].sum()
                if hits >= recall * true.sum():
                    self.forests[b] = forest, want
                    break
                if cuts[-1] > 0.9 * len(sample) * len(rows):
                    break  # prefixes tell nothing here
                want *= 2

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the rows to score. Bands come by falling length, and one that cannot hold a better vector than the ``k`` + 1 found is passed over."""
        held: list[list[np.ndarray]] = [[] for _ in queries]
        sizes, least = np.sqrt((queries * queries).sum(axis=1)), np.full(len(queries), -np.inf)
        best = np.full((len(queries), k + 1), -np.inf)
        for b, rows in enumerate(self.bands):
            asked = np.flatnonzero(sizes * self.lengths[rows[0]] * (1 + 1e-9) >= least)
            if not len(asked):
                break
            if self.forests[b] is None:
                found, cuts = np.tile(np.arange(len(rows)), len(asked)), np.arange(len(asked) + 1) * len(rows)
            else:
                forest, want = self.forests[b]
                found, cuts = forest.candidates(queries[asked], want)
            for i, q in enumerate(asked):
                some = rows[found[cuts[i] : cuts[i + 1]]]
                held[q].append(some)
                self.scored += len(some)
                if b + 1 < len(self.bands):
                    best[q] = np.sort(np.concatenate([best[q], self.x[some] @ queries[q]]))[::-1][: k + 1]
                    least[q] = best[q, -1]
        self.asked += len(queries)
        return [np.concatenate(h) if h else np.zeros(0, np.int64) for h in held]


def nearest(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and scores of the ``k`` best candidates of each query; ties go to the smaller id. Only candidates are scored, but for a sample of the queries."""
    some = np.unique(np.linspace(0, len(queries) - 1, min(SAMPLE, len(queries))).astype(int))
    shard = Shard(x, queries[some], k, recall)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(queries), 64):
        block = queries[at : at + 64]
        for q, found in enumerate(shard.candidates(block, k)):
            found = found[ids[found] != query_ids[at + q]]
            score = (x[found] * block[q]).sum(axis=1)
            if len(found) > 4 * k:  # only what reaches the k-th best is sorted
                kept = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[kept], score[kept]
            best = np.lexsort((ids[found], -score))[:k]
            out.append((np.full(len(best), query_ids[at + q]), ids[found[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each id divisible by ``every``, by inner product.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a
    null id; vectors meet only vectors of their length. A query's own id is no candidate; repeated rows
    are candidates each, and a query is asked once. With fewer candidates all come back; an empty table
    gives an empty result. Every other row is indexed, and there is no cap on shards or blocks.
    """
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x")).where(
        "id is not null and size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)"
    ).withColumn("d", F.size("x"))
    n = rows.count()
    shards, parts = 1 + n // SHARD, 1 + n // every // BLOCK
    held = rows.withColumn("shard", F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(_: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = nearest(_matrix(shard["x"]), shard["id"].to_numpy(), _matrix(block["x"]), block["id"].to_numpy(), k, recall)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    cells = held.groupBy("d", "shard", "part").cogroup(asked.groupBy("d", "shard", "part")).applyInArrow(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
