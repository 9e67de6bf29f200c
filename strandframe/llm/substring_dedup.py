"""Removal of repeated long substrings by hash-compared suffix sorting (operator 10).

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. No suffix of the
whole corpus is sorted; suffixes are sampled so that equal strings are always sampled alike:

1. Anchors. Every LENGTH-byte string owns the leftmost least hash of the GRAM-byte strings in it (from
   prefix polynomial hashes). Equal strings own equal anchors at equal offsets. An anchor's context is
   all that a string which owns it can hold: LENGTH - GRAM bytes before it and LENGTH from it on.
2. Anchors that occur once are dropped by a pre-aggregated count, and equal contexts are counted.
   A context that occurs twice is repeated as a whole. Contexts are told apart by a 128-bit BLAKE2b
   digest: where bytes of many texts would have to meet, a cryptographic digest stands for them.
3. The different contexts of an anchor are sorted as suffixes at the anchor: a merge sort whose
   comparisons find the common extension by binary search over prefix hashes, with the bytes checked
   afterwards. From a suffix, its neighbours are visited outwards while a common extension to the left
   and to the right may still add up to LENGTH bytes.
4. A sort that would be too large for one task is split by the bytes around the anchor: contexts are
   dealt out by ranges of string starts and the bytes that all strings of a range hold, the ranges are
   narrowed until their groups are small enough, and each group is sorted like that of an anchor.
5. The repeated stretches go back to all occurrences and are cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LENGTH, GRAM = 400, 100
#: Bytes hashed at once, and different contexts that are sorted together.
SEGMENT, GROUP = 1 << 20, 500
INDEX_BITS = np.uint64(21)
BASE = 0x9E3779B97F4A7C15
ANCHORS = "k1 long, k2 long, anchor long, c1 long, c2 long, before int, after int, at array<int>"
KEY = ["anchor", "c1", "c2", "before", "after"]
STRETCH = "anchor long, c1 long, c2 long, before int, after int, begin int, end int"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[b] - H[a] the hash of data[a:b], weighted by position; along the last axis."""
    up, _ = _powers(SEGMENT + 2 * LENGTH)
    terms = (data.astype(np.uint64) + np.uint64(1)) * up[: data.shape[-1]]
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(terms, axis=-1, out=out[..., 1:])
    return out


def anchor_positions(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all ``length``-byte strings that end within their text.

    ``ends[i]``: the end of the text that holds byte i.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = prefix_hashes(data)
    _, down = _powers(SEGMENT + 2 * LENGTH)
    g = (h[gram:] - h[:-gram]) * down[: len(data) - gram + 1]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    least = (g >> INDEX_BITS << INDEX_BITS) | np.arange(len(g), dtype=np.uint64)
    width, want = 1, length - gram + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    starts = np.arange(len(least))
    owned = least[starts + length <= ends[: len(least)]] & np.uint64((1 << int(INDEX_BITS)) - 1)
    if not len(owned):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = owned[np.concatenate([[True], owned[1:] != owned[:-1]])].astype(np.int64)  # leftmost minima never step back
    return at, g[at].view(np.int64)


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of (text, from, to) of about SEGMENT bytes; long texts are cut with ``length`` bytes of overlap."""
    run, held = [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 0), SEGMENT):
            b = min(len(text), a + SEGMENT + length - 1)
            if run and held + b - a > SEGMENT:
                yield run
                run, held = [], 0
            run.append((i, a, b))
            held += b - a
    if run:
        yield run


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.large_binary())]


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The anchors of ``docs (k1, k2, text)``: hash, context hash, bytes of context before and after, positions in the text."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text_bytes(batch.column(2))
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            last = (-1, -1)  # text and position of the anchor before: two pieces of a text may own one anchor
            for segment in _segments(texts, length):
                data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in segment), np.uint8)
                sizes = np.array([b - a for _, a, b in segment])
                stops = np.cumsum(sizes)
                at, hashes = anchor_positions(data, np.repeat(stops, sizes), length, gram)
                which = np.searchsorted(stops, at, side="right")
                found: dict[tuple, list[int]] = {}
                for p, g, s in zip((at - (stops - sizes)[which]).tolist(), hashes.tolist(), which.tolist()):
                    i, a, _ = segment[s]
                    p += a
                    if (i, p) <= last:
                        continue
                    last = (i, p)
                    text = texts[i]
                    before, after = min(p, reach), min(len(text) - p, length)
                    found.setdefault((i, g, _digest(text[p - before : p + after]), before, after), []).append(p)
                keys = list(found)
                halves = np.frombuffer(b"".join(k[2] for k in keys), np.int64).reshape(-1, 2)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k1[k[0]] for k in keys], pa.int64()), pa.array([k2[k[0]] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                            pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                            pa.array([k[3] for k in keys], pa.int32()), pa.array([k[4] for k in keys], pa.int32()), pa.array(list(found.values()), pa.list_(pa.int32())),
                        ],
                        names=[x.split()[0] for x in ANCHORS.split(", ")],
                    )

    return docs.select("k1", "k2", "text").mapInArrow(run, ANCHORS)


class Suffixes:
    """Contexts of one anchor, framed so that the anchor stands at ``reach`` in each; common extensions by prefix hashes."""

    def __init__(self, contexts: list[bytes], before: list[int], length: int, reach: int):
        frames = np.zeros((len(contexts), reach + length), np.uint8)
        for row, context, b in zip(frames, contexts, before):
            row[reach - b : reach - b + len(context)] = np.frombuffer(context, np.uint8)
        self.bytes = [row.tobytes() for row in frames]
        hashes = prefix_hashes(frames)
        self.hashes = hashes.tolist() if len(hashes) > 4 else [memoryview(row) for row in hashes]  # few look-ups do not repay a list
        self.before, self.reach = before, reach
        self.after = [len(c) - b for c, b in zip(contexts, before)]

    def right(self, i: int, j: int) -> int:
        """Bytes from the anchor on that suffixes i and j have in common."""
        h, k, at = self.hashes[i], self.hashes[j], self.reach
        low, high, shift = 0, min(self.after[i], self.after[j]), h[at] - k[at]
        while low < high:
            middle = (low + high + 1) // 2
            if (h[at + middle] - k[at + middle] - shift) & 0xFFFFFFFFFFFFFFFF == 0:
                low = middle
            else:
                high = middle - 1
        a, b = self.bytes[i][at : at + low], self.bytes[j][at : at + low]
        return low if a == b else next(n for n, (x, y) in enumerate(zip(a, b)) if x != y)

    def left(self, i: int, j: int) -> int:
        """Bytes before the anchor that the contexts have in common."""
        h, k, at = self.hashes[i], self.hashes[j], self.reach
        low, high, shift = 0, min(self.before[i], self.before[j]), h[at] - k[at]
        while low < high:
            middle = (low + high + 1) // 2
            if (h[at - middle] - k[at - middle] - shift) & 0xFFFFFFFFFFFFFFFF == 0:
                low = middle
            else:
                high = middle - 1
        a, b = self.bytes[i][at - low : at], self.bytes[j][at - low : at]
        return low if a == b else next(n for n, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y)

    def exceeds(self, i: int, j: int, n: int) -> bool:
        """Whether more than n bytes before the anchor may agree: a hash comparison, without bytes."""
        if min(self.before[i], self.before[j]) <= n:
            return False
        h, k, at = self.hashes[i], self.hashes[j], self.reach
        return (h[at] - h[at - n - 1] - k[at] + k[at - n - 1]) & 0xFFFFFFFFFFFFFFFF == 0

    def compare(self, i: int, j: int) -> int:
        n = self.right(i, j)
        x = self.bytes[i][self.reach + n] if n < self.after[i] else -1
        y = self.bytes[j][self.reach + n] if n < self.after[j] else -1
        return (x > y) - (x < y)

    def order(self) -> list[int]:
        return sorted(range(len(self.bytes)), key=cmp_to_key(self.compare))  # Python's sort merges runs


def repeated(contexts: list[bytes], before: list[int], length: int = LENGTH, gram: int = GRAM, first: int = 0, last: int | None = None) -> list[tuple[int, int, int]]:
    """(context, begin, end): the stretch, relative to the anchor, of all strings that a different context holds too.

    Only strings that start ``first`` to ``last`` bytes before the anchor are looked at. Every such
    string covers the anchor, so their union is one stretch.
    """
    last = length - gram if last is None else last
    suffixes = Suffixes(contexts, before, length, length - gram)
    order = suffixes.order()
    common = [suffixes.right(i, j) for i, j in zip(order, order[1:])]
    out = []
    for place, i in enumerate(order):
        begin = end = 0
        reach = min(before[i], last)
        for step in (1, -1):
            right, most, at = length - first, -1, place
            while 0 <= at + step < len(order) and most < reach:
                right = min(right, common[at if step > 0 else at - 1])
                if right + reach < length:
                    break
                at += step
                if not suffixes.exceeds(i, order[at], most):
                    continue
                left = min(suffixes.left(i, order[at]), last)
                if left > most:
                    most = left
                    if left >= first and left + right >= length:
                        begin, end = max(begin, left), max(end, right)
        if end:
            out.append((i, -begin, end))
    return out


GROUPED = [*KEY, "first", "last", "core", "context"]


def _sort_groups(length: int, gram: int):
    """Over rows GROUPED, sorted by anchor, first, last and core: the repeated stretches. A group may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(rows) > 1:
                for i, begin, end in repeated([r[8] for r in rows], [r[3] for r in rows], length, gram, rows[0][5], rows[0][6]):
                    out.append((*rows[i][:5], begin, end))
            rows.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in STRETCH.split(", ")])
                out.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if rows and (rows[0][0] != row[0] or rows[0][5:8] != row[5:8]):
                    close()
                rows.append(row)
            yield from flush()
        close()
        yield from flush()

    return run


def _sorted(groups: DataFrame, length: int, gram: int) -> DataFrame:
    """The repeated stretches of bounded groups of contexts."""
    place = ["anchor", "first", "last", "core"]
    return groups.select(*GROUPED).repartition(*place).sortWithinPartitions(*place).mapInArrow(_sort_groups(length, gram), STRETCH)


def _split(contexts: DataFrame, length: int, gram: int, group: int, widths: tuple[int, ...] = (60, 12, 1)) -> DataFrame:
    """The stretches of anchors with more contexts than are sorted together; no large group meets in a task.

    A string's start is ``o`` bytes before the anchor. For a range of starts, contexts can share a string
    only if they share the bytes that all its strings hold. Groups of up to ``group`` contexts that do are
    sorted; in a larger one, contexts equal in all bytes of the range are repeated there, and the others
    are cut into narrower ranges, down to single strings, unless the range lies between ranges that are
    repeated: a context's stretch is one, from its first repeated string to its last. While any context
    is unsure of a range, all that share its bytes go on with it, so that none lacks a partner.
    """
    reach = length - gram

    def ranges(width: int, whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                    before, after, context = row[3:6]
                    first, last, asked = (0, reach, True) if whole else row[6:9]
                    for a in range(first, last + 1, width):
                        b = min(a + width - 1, last)
                        if max(a, length - after) > min(b, before):
                            continue  # no string starts here
                        core = _digest(context[before - a : before + length - b])
                        span = core if a == b else _digest(context[before - b : before + length - a]) if b <= before and length - a <= after else None
                        out.append((*row[:5], a, b, core, span, asked))
                if out:
                    kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()] * 2 + [pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        names = [*KEY, "first", "last", "core", "span", "asked"]
        return run

    schema = "anchor long, c1 long, c2 long, before int, after int, first int, last int, core binary, span binary, asked boolean"
    contexts = contexts.select(*KEY, "context")
    found = small = None
    todo = contexts
    for depth, width in enumerate(widths):
        rows = materialize(todo.mapInArrow(ranges(width, depth == 0), schema), "ranges")
        place = ["anchor", "first", "last"]
        shared = materialize(rows.groupBy(*place, "core").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        if width > 1:
            live = materialize(rows.join(shared, [*place, "core"]), "live")
            few = live.where(F.col("n") <= group).select(*KEY, "first", "last", "core")
            small = few if small is None else small.union(few)
            live = live.where(F.col("n") > group)
            spanned = materialize(live.where("span is not null").groupBy(*place, "span").count().where("count > 1").select(*place, "span", F.lit(True).alias("hit")), "spanned")
            live = materialize(live.join(spanned, [*place, "span"], "left"), "ranges")
        else:
            live = rows.where("asked").join(shared, [*place, "core"], "left_semi").withColumn("hit", F.lit(True))
        hits = live.where("hit").groupBy(*KEY).agg((-F.max("last")).alias("begin"), (F.lit(length) - F.min("first")).alias("end"))
        found = hits if found is None else found.union(hits)
        if width > 1:
            known = found.groupBy(*KEY).agg(F.max(-F.col("begin")).alias("far"), F.min(F.lit(length) - F.col("end")).alias("near"))
            outside = F.col("far").isNull() | (F.col("last") > F.col("far")) | (F.col("first") < F.col("near"))
            alone = live.where("hit is null").join(known, KEY, "left").select(*place, "core", *KEY[1:], outside.alias("asked"))
            open_ = materialize(alone.where("asked").select(*place, "core").distinct(), "open")
            # partners that ask nothing more for themselves go on too; of those equal in the range one stands for all
            equal = live.where("hit").groupBy(*place, "core", "span").agg(F.min(F.struct(*KEY[1:])).alias("one")).select(*place, "core", *(f"one.{k}" for k in KEY[1:]), F.lit(False).alias("asked"))
            passed = alone.unionByName(equal).join(open_, [*place, "core"], "left_semi").select(*KEY, "first", "last", "asked")
            todo = contexts.join(materialize(passed, "passed"), KEY)
    return found.union(_sorted(contexts.join(small, KEY), length, gram))


def stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``k1, k2, runs``: for each text of ``docs (k1, k2, text)`` with repeated strings, its runs (positions, begin, end)."""
    all_anchors = materialize(anchors(docs, length, gram), "anchors")
    # counts are written before they are joined back: then both sides of a join are plain exchanges, which can be split where an anchor is hot
    twice = materialize(all_anchors.groupBy("anchor").agg(F.sum(F.size("at")).alias("n")).where("n > 1").select("anchor"), "twice")
    some = materialize(all_anchors.join(twice, "anchor"), "candidates")
    contexts = materialize(some.groupBy(*KEY).agg(F.sum(F.size("at")).alias("n"), F.min(F.struct("k1", "k2", F.col("at")[0].alias("p"))).alias("one")), "contexts")
    whole = contexts.where((F.col("n") > 1) & (F.col("before") + F.col("after") >= length)).select(*KEY, (-F.col("before")).alias("begin"), F.col("after").alias("end"))

    several = materialize(contexts.groupBy("anchor").count().where("count > 1"), "several")
    wanted = contexts.join(several, "anchor").where(F.col("before") + F.col("after") >= length)
    by_text = wanted.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct(*KEY, "count", "one.p")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rows in zip(_text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                columns = [pa.array([r[c] for r in rows], k) for c, k in zip([*KEY, "count"], [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[r["p"] - r["before"] : r["p"] + r["after"]] for r in rows], pa.binary())], names=[*KEY, "count", "context"])

    schema = "anchor long, c1 long, c2 long, before int, after int, count long, context binary"
    fetched = materialize(docs.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(by_text, ["k1", "k2"]).select("text", "wanted").mapInArrow(fetch, schema), "fetched")
    all_starts = [F.lit(0).alias("first"), F.lit(length - gram).alias("last"), F.lit(b"").alias("core")]
    parts = whole.union(_sorted(fetched.where(F.col("count") <= group).select(*KEY, *all_starts, "context"), length, gram))
    large = fetched.where(F.col("count") > group)
    if not large.isEmpty():
        parts = parts.union(_split(large, length, gram, group))
    parts = materialize(parts.groupBy(*KEY).agg(F.min("begin").alias("begin"), F.max("end").alias("end")), "stretches")
    return some.join(parts, KEY).groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "begin", "end")).alias("runs"))


def covered(n: int, runs: list[dict]) -> np.ndarray:
    """The bytes of a text of n bytes that the runs cover."""
    edge = np.zeros(n + 1, np.int64)
    for run in runs:
        at = np.asarray(run["at"])
        np.add.at(edge, at + run["begin"], 1)
        np.add.at(edge, at + run["end"], -1)
    return np.cumsum(edge)[:-1] > 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows equal in id and text get one key ``k1, k2``: they have one result, but each counts as an occurrence."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes that stay) for every row of ``docs``.

    Strings are judged on the texts as given, in UTF-8, and never cross documents. A null text counts as
    empty; texts under ``length`` bytes stay. A row repeated with its id and text repeats all of its
    strings. Null ids and extra columns pass; an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    runs = stretches(rows, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                out = []
                for text, found in zip(_text_bytes(part.column(1)), part.column(2)):
                    gone = covered(len(text), found.as_py()) if found.is_valid else np.zeros(0, bool)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(gone) else text
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
                    out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_text])
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
