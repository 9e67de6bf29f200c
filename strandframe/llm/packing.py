"""Packing token sequences by first-fit decreasing over a tournament tree (operator 8).

Documents are dealt to partitions by a hash, so every group of consecutive documents of a partition is
a random one; each group is packed on its own. Whole sequences are cut off the long documents, the
rests are placed by first-fit decreasing, and the emptiest bins are then cut up to fill the gaps of
the others. The last bin of a group becomes sequences whose lengths are powers of two, which need no
padding either.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import by_size
from .token_counts import SCAN, SHORT, PreTokens, _byte_names, distinct_spans, load_spec

#: Tokens of a group, about: bounds the memory of a task, whatever its partition holds.
GROUP = 2_000_000
#: Short and long words whose ids a worker keeps.
KNOWN, LONG = 500_000, 20_000

Piece = tuple[int, int, int]  # document of the group, start, length


class Capacities:
    """A tournament tree over the free room of bins: the first bin with enough room in log steps."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        return at - self.leaves

    def take(self, leaf: int, n: int) -> None:
        tree, at = self.tree, leaf + self.leaves
        tree[at] -= n
        at //= 2
        while at:
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
            at //= 2


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the first bin where it fits."""
    free = Capacities(max(1, len(sizes)), room)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = free.first_with(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
        free.take(at, sizes[i])
    return bins


def pack(lengths: list[int], room: int) -> list[list[Piece]]:
    """Sequences of pieces for documents of these lengths; every sequence is full or a power of two long."""
    full = [[(d, at, room)] for d, n in enumerate(lengths) for at in range(0, n - n % room, room)]
    rests = [(d, n - n % room, n % room) for d, n in enumerate(lengths) if n % room]
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    held = [sum(p[2] for p in b) for b in bins]
    full += [b for b, n in zip(bins, held) if n == room]
    gaps = sorted((n, k) for k, n in enumerate(held) if n < room)
    loose = 0  # gaps[loose] is the emptiest bin, being cut up for the others
    last = len(gaps) - 1
    while loose < last:
        n, k = gaps[last]
        while n < room and loose < last:
            source = bins[gaps[loose][1]]
            d, at, size = source.pop()
            used = min(size, room - n)
            bins[k].append((d, at, used))
            if used < size:
                source.append((d, at + used, size - used))
            n += used
            if not source:
                loose += 1
        gaps[last] = (n, k)
        if n == room:
            full.append(bins[k])
            last -= 1
    if loose == last:
        full += powers_of_two(bins[gaps[last][1]])
    return full


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces of an unfilled sequence, cut into sequences by the binary digits of its length."""
    out, queue = [], pieces[::-1]
    total = sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        want = total & 1 << bit
        here: list[Piece] = []
        while want:
            d, at, size = queue.pop()
            used = min(size, want)
            here.append((d, at, used))
            if used < size:
                queue.append((d, at + used, size - used))
            want -= used
        if here:
            out.append(here)
    return out


class WordTable:
    """Token ids of short words met before, by the words themselves: open addressing in arrays, some 50 bytes a word."""

    def __init__(self, most: int):
        self.most, self.bits = most, (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((self.most, 2), np.uint64)
        self.begin, self.size = np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.pool, self.used, self.words = np.zeros(4 * self.most, "<u4"), 0, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out, at, todo = np.full(len(keys), -1), self._slot(keys), np.arange(len(keys))
        while len(todo):
            entry = self.slots[at[todo]]
            hit = (entry >= 0) & (self.keys[entry] == keys[todo]).all(axis=1)
            out[todo[hit]] = entry[hit]
            todo = todo[(entry >= 0) & ~hit]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        return out

    def add(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """New, different keys, whose ids lie in the pool from ``used`` on; there must be room for them."""
        entry = self.words + np.arange(len(keys), dtype=np.int32)
        self.keys[entry], self.begin[entry], self.size[entry] = keys, begin, size
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = entry[free]  # of several one is written; the others go on
            todo = todo[self.slots[at[todo]] != entry[todo]]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
        self.words += len(keys)
        self.used += int(size.sum())


class Encoder:
    """Token ids as the tokenizers library gives them: its model sees each different word of a batch once; ids of words are kept for their next use."""

    def __init__(self, spec: bytes, most: int = KNOWN):
        from tokenizers import Tokenizer

        self.pre, self.tokenizer = PreTokens(spec), Tokenizer.from_str(spec.decode())
        self.names = _byte_names()
        self.special = {t["content"].encode(): [t["id"]] for t in json.loads(spec)["added_tokens"]}
        self.known = WordTable(most)
        self.long: dict[bytes, list[int]] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        data, starts, ends, owner = self.pre.split(texts)
        first, number, keys = distinct_spans(data, starts, ends)
        known, names, model = self.known, self.names, self.tokenizer.model
        if known.words > known.most - known.most // 16:
            known.clear()
        entry = known.find(keys)
        begin, size = known.begin[entry], known.size[entry]
        long = (ends - starts)[first] >= SHORT
        entry[long] = -1
        new = np.flatnonzero(entry < 0)  # long words come last, and are not kept in the table
        if len(self.long) > LONG:
            self.long.clear()
        flat, sizes = [], []
        for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist()):
            word = data[a:b]
            ids = self.special.get(word) or self.long.get(word)
            if ids is None:
                ids = [t.id for t in model.tokenize(word.decode("latin-1").translate(names))]
                if SHORT <= b - a < 64:
                    self.long[word] = ids
            flat += ids
            sizes.append(len(ids))
        size[new] = sizes
        begin[new] = known.used + np.cumsum(size[new]) - size[new]
        short = known.used + len(flat) - len(known.pool)
        if short > 0:
            known.pool = np.concatenate([known.pool, np.zeros(short, "<u4")])
        known.pool[known.used : known.used + len(flat)] = flat
        kept = new[: min(int((~long[new]).sum()), known.most - known.words)]
        known.add(keys[kept], begin[kept], size[kept])
        n = size[number]
        at = np.cumsum(n)
        ids = known.pool[np.repeat(begin[number] - at + n, n) + np.arange(at[-1] if len(at) else 0)]
        cuts = np.concatenate([[0], at])[np.searchsorted(owner, np.arange(len(texts) + 1))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(spec: bytes) -> Encoder:
    return Encoder(spec)


def pack_documents(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``room`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``, the tokens, if
    ``with_ids``). A document is its tokens, then ``end_id``; a null text is the end token alone. Every
    sequence is full or a power of two long. Null ids and repeated rows are packed like any other; an
    empty table gives an empty result. Only the two named columns are read. One shuffle deals the
    documents out by a hash of id and text, so neither a hot id nor a hot text is one task.
    """
    prepare(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(vocabulary))
    end = np.array([end_id], dtype="<u4").tobytes()
    dealt = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")
    ).withColumn("deal", F.xxhash64("doc_id", "text", F.pmod("row", F.lit(1024))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec.value)
        sequence = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, tokens, held, sequence
            rows: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for pieces in pack([len(t) // 4 for t in tokens], room):
                offset = 0
                for d, at, n in pieces:
                    part = tokens[d][4 * at : 4 * (at + n)]
                    row = [ids[d], at, n, zlib.crc32(part), len(tokens[d]) // 4, sequence, offset]
                    for column, value in zip(rows, [*row, np.frombuffer(part, "<u4")] if with_ids else row):
                        column.append(value)
                    offset += n
                sequence += 1
            ids, tokens, held = [], [], 0
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        for batch in batches:
            texts, doc_ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for a, b in by_size([len(t) for t in texts], SCAN):
                found = [t + end for t in encode(texts[a:b])]
                ids += doc_ids[a:b]
                tokens += found
                held += sum(map(len, found)) // 4
                if held >= GROUP:
                    yield from flush()
        if tokens:
            yield from flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return dealt.repartition("deal").sortWithinPartitions("deal", "row").select("doc_id", "text").mapInArrow(run, schema)
