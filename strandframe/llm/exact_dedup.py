"""Exact dedup by a minimal perfect hash over historical digests (operator 3).

The rows that arrived first are the history. Their distinct digests are dealt to shards, and each
shard gets a minimal perfect hash whose slots hold the full digest and a locator of the winning row.
Later rows are reduced to distinct digests before they are shuffled, looked up shard by shard and
compared byte for byte with the slot; digests that are not members stay groups of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BLANK, keep_rows, row_key

#: Digests a shard holds at the most, about: bounds the memory of a lookup task.
SHARD = 100_000
ENTRY = "digest binary, points long, keep_id long, keep_row long, size long"


class PerfectHash:
    """Levels of bit maps: a key's slot is the rank of its bit on the first level where it was alone.

    A level holds 64-bit words and, for each, the number of bits set before it.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        left = keys
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, self.n + np.cumsum(counts) - counts))
            self.n += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (keys[:, 0] + np.uint64(level) * keys[:, 1]) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for a key that was not built in, so callers compare the bytes."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            alone = (word >> bit & np.uint64(1)).astype(bool)
            rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[alone]] = rank[alone]
            left = left[~alone]
        return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest`` (SHA-256 of the text without white space) ``, points`` (code points of the text)``, row, k2``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, f"{BLANK}+", "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("row"),
        row_key(id_col, text_col)[1],
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row for each digest: its winner (most code points, then least id, then first row) and its size.

    ``bitnot`` turns least into greatest without overflow; a null id loses against any other.
    """
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("i"), F.bitwise_not("row").alias("r")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("size")).select(
        "digest", F.col("b.points").alias("points"), F.bitwise_not("b.i").alias("keep_id"), F.bitwise_not("b.r").alias("keep_row"), "size"
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(entries: DataFrame, shards: int) -> DataFrame:
    """``shard, hash, slots``: for each shard the pickled hash and its slots, a table in Arrow's stream format."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        found = PerfectHash(_words(table["digest"]))
        order = np.empty(table.num_rows, np.int64)
        order[found.slots(_words(table["digest"]))] = np.arange(table.num_rows)
        sink = pa.BufferOutputStream()
        slots = table.drop_columns(["shard"]).take(pa.array(order))
        with pa.ipc.new_stream(sink, slots.schema) as writer:
            writer.write_table(slots)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "hash": [pickle.dumps(found)], "slots": [sink.getvalue().to_pybytes()]})

    return entries.select(_shard(shards), "digest", "points", "keep_id", "keep_row", "size").groupBy("shard").applyInArrow(build, "shard int, hash binary, slots binary")


def merge(entries: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Looks the distinct ``entries`` up in ``index``; returns the entries of both, members merged with their slot."""
    names = ["digest", "points", "keep_id", "keep_row", "size"]

    def look(_: tuple, new: pa.Table, shard: pa.Table) -> pa.Table:
        new = new.select(names)
        if not shard.num_rows:
            return new
        with pa.ipc.open_stream(shard["slots"][0].as_py()) as reader:
            old = reader.read_all().select(names).cast(new.schema)
        if not new.num_rows:
            return old
        found, held = pickle.loads(shard["hash"][0].as_py()), _words(old["digest"])
        keys = _words(new["digest"])
        slot = found.slots(keys)
        member = slot >= 0
        member[member] = (held[slot[member]] == keys[member]).all(axis=1)
        now, here = new.filter(pa.array(member)), slot[member]  # a slot comes up once, as new digests are distinct
        was = old.take(pa.array(here))
        wins, tied = np.zeros(len(here), bool), np.ones(len(here), bool)
        for x, y in zip(_rank(now), _rank(was)):
            wins |= tied & (x > y)
            tied &= x == y
        merged = {"digest": old["digest"]}
        for name in names[1:4]:
            if name == "keep_id":  # may be null
                values, none = old[name].fill_null(0).to_numpy().copy(), old[name].is_null().to_numpy().copy()
                values[here[wins]], none[here[wins]] = now[name].fill_null(0).to_numpy()[wins], now[name].is_null().to_numpy()[wins]
                merged[name] = pa.array(values, mask=none)
            else:
                values = old[name].to_numpy().copy()
                values[here[wins]] = now[name].to_numpy()[wins]
                merged[name] = pa.array(values)
        sizes = old["size"].to_numpy().copy()
        sizes[here] += now["size"].to_numpy()
        return pa.concat_tables([pa.table({**merged, "size": sizes}).cast(new.schema), new.filter(pa.array(~member))])

    return entries.select(_shard(shards), *names).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, ENTRY)


def _rank(winners: pa.Table) -> tuple[np.ndarray, ...]:
    """What decides between winners, the first column first; greater is better."""
    i = winners["keep_id"]
    return winners["points"].to_numpy(), i.is_valid().to_numpy(), ~i.fill_null(0).to_numpy(), ~winners["keep_row"].to_numpy()


def exact_dedup(docs: DataFrame, history_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when they are the same without white space; null counts as empty. Of equal texts the
    row with most code points stays, then the least id (null last), then the first row: one row exactly,
    repeated rows included. ``history_share`` says which part of the id range has been indexed before
    the rest is looked up (rows with a null id come last); it has no effect on the result. An empty
    table gives an empty result. Only the two named columns are read.
    """
    rows, groups = _grouped(docs, history_share, id_col, text_col)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    rows, groups = _grouped(docs, 0.5, id_col, text_col)
    kept = rows.join(groups, "digest").where(F.col("row") == F.col("keep_row"))
    return keep_rows(docs, kept.select(F.col("doc_id").alias("k1"), "k2"), id_col, text_col)


def _grouped(docs: DataFrame, history_share: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The digest rows of ``docs``, and one row for each digest with its winner."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    mark = F.lit(low + int((high - low) * history_share) if low is not None else 0)
    early = F.coalesce(F.col("doc_id") <= mark, F.lit(False))
    history, later = (materialize(winners(rows.where(part)), "winners") for part in (early, ~early))
    shards = 1 + max(history.count(), later.count()) // SHARD
    groups = merge(later, build_index(history, shards), shards).select("digest", "keep_id", "keep_row", F.col("size").alias("group_size"))
    return rows, groups
