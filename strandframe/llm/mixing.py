"""Mixing sources to target weights by sampled blocks (operator 2).

The words of a source, document after document, are cut into blocks of fixed length. Output shards of
a fixed number of slots draw multinomial counts over the sources; running sums turn the counts into
slot numbers of each source; slot numbers pass through the source's pseudorandom permutation of its
block numbers, once around per epoch; slots and blocks are joined by source and block number.

A multinomial draw only comes near its target, so slots beyond a source's last one are void and one
more shard holds the slots that the draws left over: every source takes its target to the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize
from .common import WORD, prefix_sum, whole_row

BLOCK, SLOTS, WEIGHTS, SHARE, MOST = 256, 1024, (5, 2, 1), 1.5, 2
PLAN = "source_no int, source string, source_size long, target double, blocks long, slots long, tail long"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares ``total`` by weight; no target is over ``most`` times its size, and the excess goes on to the others by weight."""
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] >= most * sizes[i]]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= set(over)
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel network, walked until inside."""
    sizes, which = np.unique(n, return_inverse=True)
    half = np.array([max(1, (x - 1).bit_length() + 1 >> 1) for x in sizes.tolist()], dtype=np.uint64)[which]
    mask = (np.uint64(1) << half) - np.uint64(1)
    at, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = at[todo] >> half[todo], at[todo] & mask[todo]
        for r in range(4):
            h = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask[todo])
        at[todo] = left << half[todo] | right
        todo = todo[at[todo] >= n[todo].astype(np.uint64)]
    return at.astype(np.int64)


def word_stream(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, text_hash, copy, size, start``: sizes in words and each row's place in its source's stream.

    Rows equal in id and text hash are told apart by ``copy``, by falling order of source, so these three columns name a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    )
    same = Window.partitionBy("doc_id", "text_hash").orderBy(F.desc("source"))
    rows = rows.withColumn("copy", F.row_number().over(same)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(256)))
    return materialize(prefix_sum(rows, "source", "bucket", ["doc_id", "text_hash", "copy"], "size", "start").drop("bucket"), "words")


def mix_plan(stream: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: its target, blocks and slots. ``tail``: words its last slot takes.

    The list of source names and sizes is the only thing gathered on the driver, some 100 bytes a source:
    sources may number some hundred thousand, not one for each document of a large corpus.
    """
    spark = stream.sparkSession
    found = [(r[0], int(r[1])) for r in stream.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))  # Python orders strings by code point
    sizes = [n for _, n in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    rows = []
    for i, ((source, size), aim) in enumerate(zip(found, aims)):
        words = round(aim)
        whole, part = divmod(words, size) if size else (0, 0)
        blocks, more = -(-size // block), -(-part // block)
        tail = part - (more - 1) * block if more else block
        rows.append((i, source, size, aim, blocks, whole * blocks + more, tail))
    return spark.createDataFrame(rows, PLAN)


def mix_slots(plan: DataFrame, seed: int = 7, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """``shard, source_no, slot, epoch, block, take``: the mix, slot by slot. ``take``: words of the block, from its start."""
    spark = plan.sparkSession
    rows = plan.collect()  # one row for each source
    total = sum(r.slots for r in rows)
    share = np.array([r.slots for r in rows], dtype=float) / max(total, 1)
    shards = -(-total // slots)
    size = np.zeros((len(rows), 4), np.int64)  # a row for each source, by its number
    for r in rows:
        size[r.source_no] = r.slots, r.blocks, r.source_size // block, r.tail
    size = spark.sparkContext.broadcast(size)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts = np.random.Generator(np.random.Philox([seed, int(shard)])).multinomial(slots, share)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source_no": some.astype(np.int32), "count": counts[some]})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source_no int, count long").withColumn("bucket", F.floor(F.col("shard") / 4096))
    placed = materialize(prefix_sum(drawn, "source_no", "bucket", ["shard"], "count", "first").drop("bucket"), "drawn")
    reached = placed.groupBy("source_no").agg(F.sum("count").alias("n"))
    left = plan.join(reached, "source_no", "left").select(F.lit(shards).cast("long").alias("shard"), "source_no", (F.col("slots") - F.coalesce("n", F.lit(0))).alias("count"), F.coalesce("n", F.lit(0)).alias("first"))
    parts = 256  # a long row is cut up, so that exploding it is not one task's work
    runs = placed.select("shard", "source_no", "count", "first").union(left.where("count > 0"))
    runs = runs.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(parts)))).select(
        "shard", "source_no", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(parts), F.col("count") - F.col("at")).alias("count")
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + 256] for b in batches for at in range(0, len(b), 256)):
            count = batch["count"].to_numpy()
            row = np.repeat(np.arange(len(batch)), count)
            slot = batch["first"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            source = batch["source_no"].to_numpy()[row]
            limit, blocks, full, tail = size.value[source].T
            here = slot < limit
            row, slot, source, limit, blocks, full, tail = (x[here] for x in (row, slot, source, limit, blocks, full, tail))
            epoch, index = np.divmod(slot, blocks) if len(slot) else (slot, slot)
            # a short last block stays last: only whole blocks are permuted
            moved = index < full
            index[moved] = permute(index[moved], full[moved], (source[moved].astype(np.uint64) << np.uint64(8)) + epoch[moved].astype(np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
            yield pd.DataFrame({"shard": batch["shard"].to_numpy()[row], "source_no": source, "slot": slot, "epoch": epoch.astype(np.int32), "block": index, "take": np.where(slot == limit - 1, tail, block)})

    return runs.mapInPandas(number, "shard long, source_no int, slot long, epoch int, block long, take long")


def block_pieces(stream: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """``source_no, block, doc_id, text_hash, copy, word, low, high``: where each document lies in the blocks of its source.

    ``word``: the first word of the piece within its document; ``low, high``: its words within the block.
    """
    named = stream.where("size > 0").join(F.broadcast(plan.select("source_no", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s")))
    at = named.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    base = F.col("block") * block
    return at.select(
        "source_no", "block", "doc_id", "text_hash", "copy", F.greatest(base - F.col("start"), F.lit(0)).alias("word"),
        F.greatest(F.col("start") - base, F.lit(0)).alias("low"), F.least(F.col("start") + F.col("size") - base, F.lit(block)).alias("high"),
    )


def mix_pieces(stream: DataFrame, plan: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``shard, slot, epoch, doc_id, text_hash, copy, word, words``: the runs of words of the mix, in slot order within a source."""
    slots = mix_slots(plan, seed, block)
    joined = slots.join(block_pieces(stream, plan, block), ["source_no", "block"])
    words = F.least("high", "take") - F.col("low")
    return joined.select("shard", "slot", "epoch", "doc_id", "text_hash", "copy", "word", words.alias("words")).where("words > 0")


def mix_report(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Sizes are words; a null text has none and takes none. Sources are weighed in code-point order, the
    null source last. The same seed and rows give the same mix. Repeated rows are rows of their own; an
    empty table, or one without words, takes nothing. Only the three named columns are read.
    """
    stream = word_stream(docs, id_col, text_col, source_col)
    plan = mix_plan(stream)
    taken = mix_pieces(stream, plan, seed).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("copy").alias("c")).agg(F.sum("words").alias("words"))
    by_source = F.broadcast(plan.select(F.col("source").alias("s"), "source_size", "target"))
    rows = stream.join(by_source, F.col("source").eqNullSafe(F.col("s")))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("copy") == F.col("c"))
    return rows.join(taken, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: for each row and epoch one row with the words taken, other columns as they were.

    A text taken whole stays as it is; of a text taken in part, the runs of words taken are kept with the
    white space inside them and joined by a line break. A column ``n_chars`` is set to the new length.
    Rows that are null in text or without words give no rows; an empty table gives an empty result.
    """
    stream = word_stream(docs, id_col, text_col, source_col)
    plan = mix_plan(stream)
    runs = (
        mix_pieces(stream, plan, seed)
        .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("copy").alias("c"), "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias("runs"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(source_col).cast("string").alias("_source"))
    if stream.where("copy > 1").isEmpty():  # without repeats the texts need no exchange for numbering
        keyed = keyed.withColumn("_copy", F.lit(1))
    else:
        keyed = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.desc("_source"))))
    same = F.col("_id").eqNullSafe(F.col("d")) & (F.col("_hash") == F.col("h")) & (F.col("_copy") == F.col("c"))
    joined = keyed.join(runs, same).select("_row", "runs")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t or "", [(r["word"], r["words"]) for r in found]) for t, found in zip(texts, runs)])

    mixed = joined.select("_row", cut(F.col("_row").getField(text_col), F.col("runs")).alias("_text"))
    changed = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*(changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The words of the runs (first word, number), sorted by first word; runs that touch become one."""
    import re

    spans = [m.span() for m in re.finditer(WORD, text)]
    merged: list[list[int]] = []
    for first, n in runs:
        if merged and merged[-1][1] == first:
            merged[-1][1] = first + n
        else:
            merged.append([first, first + n])
    if merged == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)
