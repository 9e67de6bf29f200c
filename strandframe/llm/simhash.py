"""SimHash near-dedup by tiled exact comparison (operator 7).

Distinct fingerprints are sorted by their bit counts and cut into tiles. A pair of tiles is compared
only if its bit counts allow a distance within the radius: the distance is at least the difference of
the two bit counts, and at least the sum of those differences over the four 16-bit quarters. Within
a pair every fingerprint meets every other by numpy exclusive-or and bit counts; a spanning forest of
the links leaves the task, so a large group of near copies costs links in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize
from .common import keep_rows, row_key, text_bytes

#: Fingerprints of a tile, and tiles of a cell: neighbours in order, so their bit counts are near.
TILE, CELL = 1024, 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
QUARTERS = range(4)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the ``width``-word shingles of a UTF-8 text."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        part = hashes[a : a + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, k2, fp`` (the row's key, the fingerprint as a signed long). A null text counts as empty: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in text_bytes(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "k2", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col)[1], F.col(text_col)).mapInArrow(run, "doc_id long, k2 long, fp long")


def tiles(fps: DataFrame) -> DataFrame:
    """``p, cell, tile, fps, lo, hi``: at most TILE fingerprints of bit count ``p``, with the range of each quarter's bit count.

    CELL tiles that follow each other share a ``cell``.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))).alias(f"q{q}") for q in QUARTERS]
    keyed = fps.select("fp", F.bit_count("fp").alias("p"), *quarter)
    order = ["p", "q0", "q1", "q2", "fp"]

    def tile_rows(p: np.ndarray, fp: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(p)) + 1
        spans = [(x, min(x + TILE, b), a + (x - a) // (TILE * CELL) * TILE * CELL) for a, b in zip([0, *edges], [*edges, len(p)]) for x in range(a, b, TILE)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(p[a]) for a, _, _ in spans], pa.int32()),
                pa.array([int(fp[c]) for _, _, c in spans], pa.int64()),
                pa.array([int(fp[a]) for a, _, _ in spans], pa.int64()),
                pa.array([fp[a:b].tobytes() for a, b, _ in spans], pa.binary()),
                pa.array([q[a:b].min(axis=0).tolist() for a, b, _ in spans], pa.list_(pa.int32())),
                pa.array([q[a:b].max(axis=0).tolist() for a, b, _ in spans], pa.list_(pa.int32())),
            ],
            names=["p", "cell", "tile", "fps", "lo", "hi"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch["p"].to_numpy(), batch["fp"].to_numpy(), np.stack([batch[f"q{i}"].to_numpy() for i in QUARTERS], axis=1)))
            n += batch.num_rows
            if n >= TILE * CELL:
                yield tile_rows(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield tile_rows(*map(np.concatenate, zip(*held)))

    schema = "p int, cell long, tile long, fps binary, lo array<int>, hi array<int>"
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links i-j among n nodes: (node, its least node)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all fingerprints of a and b within the radius."""
    found = []
    for at in range(0, len(a), 128):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 128, None] ^ b[None, :]) <= radius)
        found.append((i + at, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``src, dst``: for each pair of tiles a spanning forest of its fingerprints within ``radius`` bits."""
    cut = materialize(tiles(fps), "tiles")
    most = cut.groupBy("p").count().agg(F.max("count"), F.sum("count")).first()
    parts = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), (most[1] or 0) // 16)
    salts = 1 + (most[0] or 0) // 1024  # so that no bit count is one task

    def apart(q: int) -> Column:
        return F.greatest(F.lit(0), F.col("lo2")[q] - F.col("hi")[q], F.col("lo")[q] - F.col("hi2")[q])

    near = sum((apart(q) for q in QUARTERS), F.lit(0)) <= radius
    # bit counts alone say which tiles a cell must meet; only then do fingerprints move
    least = lambda c, f: F.array(*(f(F.col(c)[q]) for q in QUARTERS)).alias(c)
    cells = cut.groupBy("p", "cell").agg(least("lo", F.min), least("hi", F.max)).withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(salts)).cast("int"))
    others = cut.select(F.explode(F.sequence(F.col("p") - radius, F.col("p"))).alias("p"), F.col("p").alias("p2"), F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    others = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    routes = materialize(cells.join(others, ["p", "salt"]).where(near).select("p", "cell", "p2", "tile2", "lo2", "hi2"), "routes")
    right = routes.join(cut.select(F.col("p").alias("p2"), F.col("tile").alias("tile2"), F.col("fps").alias("fps2")), ["p2", "tile2"])
    pairs = cut.repartition(parts, "p", "cell").join(right.repartition(parts, "p", "cell"), ["p", "cell"]).where(((F.col("p2") > F.col("p")) | (F.col("tile2") >= F.col("tile"))) & near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for x, y in zip(batch["fps"], batch["fps2"]):
                a, b = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                i, j = compare(a.view(np.uint64), b.view(np.uint64), radius)
                if len(i):
                    u, v = forest(len(a) + len(b), i, j + len(a))
                    both = np.concatenate([a, b])
                    src.append(both[u])
                    dst.append(both[v])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return pairs.select("fps", "fps2").mapInArrow(run, "src long, dst long").where("src <> dst").distinct()


def simhash_groups(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Rows link when their fingerprints differ in ``radius`` bits at the most; the component is the least
    id that links reach. Texts without words have fingerprint zero and link like any other. Null texts
    count as empty; rows with a null id take part but give a component no id (null if all are null).
    Repeated rows give repeated results, an empty table an empty one. Only the two named columns are read.
    """
    rows, roots = _grouped(docs, radius, id_col, text_col)
    component = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(component, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that of the least id (null last), with all its columns."""
    rows, roots = _grouped(docs, radius, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k2"))
    by_print = rows.groupBy("fp").agg(first.alias("one"))
    kept = by_print.join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("one").alias("one"))
    return keep_rows(docs, kept.select(F.col("one.doc_id").alias("k1"), F.col("one.k2").alias("k2")), id_col, text_col)


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs``, and for each distinct one its least id and the root of its component."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(materialize(links(distinct, radius), "links"))
    roots = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return rows, materialize(roots, "roots")
