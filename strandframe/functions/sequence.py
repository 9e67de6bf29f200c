"""Base sequences as column expressions, and their k-mers and syncmers as Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Letters of both cases and the space stand for bases, so that ordinary text has k-mers; anything else breaks them.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
AS_BASES = "".join("ACGT"[i % 26 % 4] for i in range(52)) + "G"


def encode_bases(text: Column) -> Column:
    return F.translate(text, LETTERS, AS_BASES)


def revcomp(bases: Column) -> Column:
    """Reverse complement in upper case; whatever is no A, C, G or T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(bases, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca".upper()))


def gc_content(bases: Column) -> Column:
    """Share of G and C among the valid bases; null without any."""
    valid = F.length(F.regexp_replace(bases, "[^ACGTacgt]", ""))
    return F.when(valid > 0, F.length(F.regexp_replace(bases, "[^GCgc]", "")) / valid)


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, A 0 to T 3, first base highest."""
    return F.conv(F.translate(F.upper(kmer), "ACGTU", "01233"), 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def revcomp_kmer(code: Column, k: int) -> Column:
    """The code of a k-mer's reverse complement."""
    return F.conv(F.translate(F.reverse(kmer_text(code, k)), "ACGT", "3210"), 4, 10).cast("long")


def fnv64(x: Column) -> Column:
    """FNV-1a over the eight little-endian bytes of a long, as a signed long. Multiplies modulo 2**64 by halves."""

    def times_prime(a: Column) -> Column:  # 1099511628211 = 2**40 + 435; no term may overflow under ANSI rules
        low = a.bitwiseAND(F.lit(0xFFFFFFFF)) * 435
        high = (F.shiftrightunsigned(a, 32) * 435).bitwiseAND(F.lit(0xFFFFFFFF))
        return _wrap_add(F.shiftleft(a, 40), _wrap_add(F.shiftleft(high, 32), low))

    shifts = F.array(*(F.lit(8 * i) for i in range(8)))
    byte = lambda i: F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(255))
    return F.aggregate(shifts, F.lit(-3750763034362895579), lambda a, i: times_prime(a.bitwiseXOR(byte(i))))


def _wrap_add(a: Column, b: Column) -> Column:
    """Sum modulo 2**64 of two longs, without overflow: low and high halves apart."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv64_array(x: np.ndarray) -> np.ndarray:
    out = np.full(x.shape, 14695981039346656037, np.uint64)
    for i in range(8):
        out = (out ^ ((x >> np.uint64(8 * i)) & np.uint64(255))) * np.uint64(1099511628211)
    return out


def mix64_array(x: np.ndarray) -> np.ndarray:
    """The finaliser of Murmur3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def splitmix64_array(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


HASHES = {"fnv64": fnv64_array, "mix64": mix64_array, "splitmix64": splitmix64_array, "identity": lambda x: x}
_CODES = np.full(256, 4, np.uint8)
for _c, _v in zip(b"ACGTUacgtu", (0, 1, 2, 3, 3) * 2):
    _CODES[_c] = _v


def codes_of(text: str) -> np.ndarray:
    """The base code of each character, 4 or more where it is no base."""
    return _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all k-base windows (invalid bases as 0), and which of them hold valid bases only."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    good = codes < 4
    value = np.where(good, codes, 0).astype(np.uint64)
    out, have = value, 1
    power = {1: value}
    while have * 2 <= k:  # windows of doubled length
        out = (out[:-have] << np.uint64(2 * have)) | out[have:]
        have *= 2
        power[have] = out
    rest = k - have
    for width in sorted(power, reverse=True):
        if rest >= width:
            out = (out[: len(codes) - have - width + 1] << np.uint64(2 * width)) | power[width][have : have + len(codes) - have - width + 1]
            have += width
            rest -= width
    bad = np.concatenate([[0], np.cumsum(~good)])
    return out, bad[k:] == bad[:-k]


def revcomp_codes(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(k):
        out = (out << np.uint64(2)) | (np.uint64(3) - (x & np.uint64(3)))
        x = x >> np.uint64(2)
    return out


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(out) - (width - have)], out[width - have :])


def syncmer_mask(codes: np.ndarray, k: int, s: int, both: bool, hasher: str = "fnv64") -> np.ndarray:
    """Which k-mers are open syncmers: the hash of the last s-mer is the least, ties included; with ``both`` on either strand."""
    h = HASHES[hasher]
    smers, _ = windows(codes, s)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    forward = h(smers)
    mask = forward[k - s : k - s + n] <= rolling_min(forward, k - s + 1)
    if both:
        reverse = h(revcomp_codes(smers, s))
        mask |= reverse[:n] <= rolling_min(reverse, k - s + 1)
    return mask


#: Bases of sequences that are worked on together.
JOINED = 1 << 20


def kmers(df: DataFrame, id_col: str, seq_col: str, k: int, s: int | None = None, both: bool = True, hasher: str = "fnv64") -> DataFrame:
    """``id_col, pos, kmer`` for each valid k-mer, or each syncmer if ``s`` is given. Positions count characters from 0.

    Null and short sequences have none. One Arrow pass; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(s or "").encode("latin-1", "replace") for s in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):  # sequences of a batch go together, a base that breaks k-mers between them
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) < JOINED):
                    size += len(texts[last]) + 1
                    last += 1
                codes = _CODES[np.frombuffer(b"-".join(texts[first:last]), np.uint8)]
                code, good = windows(codes, k)
                if s is not None:
                    good = good & syncmer_mask(codes, k, s, both, hasher)
                at = np.flatnonzero(good)
                lengths = np.array([len(t) + 1 for t in texts[first:last]])
                starts = np.cumsum(lengths) - lengths
                of = np.searchsorted(starts, at, side="right") - 1
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + first)), pa.array(at - starts[of], pa.int64()), pa.array(code[at].astype(np.int64))], names=[id_col, "pos", "kmer"])
                first = last

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, seq_col).mapInArrow(run, f"`{id_col}` {kind}, pos long, kmer long")


def kmer_counts(df: DataFrame, seq_col: str, k: int) -> DataFrame:
    """``kmer, n``: valid k-mers, counted within each Arrow batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for seq in batch.column(0).to_pylist():
                if seq and len(seq) >= k:
                    code, good = windows(_CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)], k)
                    parts.append(code[good])
            if parts:
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kmer", "n"])

    return df.select(seq_col).mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


#: Columns of the totals of a sequence's k-mers.
TOTALS = ["kmers", "different", "first", "last"]


def _totals(pieces: Iterator[tuple[object, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """``id, *TOTALS`` of ``id, positions, k-mers``, where pieces of one id follow each other; ids without k-mers have none."""
    held, name = [], None

    def sums() -> tuple:
        first, last = min(int(p.min()) for p, _ in held), max(int(p.max()) for p, _ in held)
        return name, sum(len(p) for p, _ in held), len(np.unique(np.concatenate([k for _, k in held]))), first, last

    for key, pos, kmer in pieces:
        if not len(pos):
            continue
        if held and key != name:
            yield sums()
            held = []
        name = key
        held.append((pos, kmer))
    if held:
        yield sums()


def _totals_in_arrow(df: DataFrame, id_col: str, pieces: Callable[[pa.RecordBatch], Iterator[tuple[object, np.ndarray, np.ndarray]]]) -> DataFrame:
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _totals(piece for batch in batches for piece in pieces(batch))
        while rows := list(islice(found, 2000)):
            ids, *sums = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), *(pa.array(x, pa.int64()) for x in sums)], names=[id_col, *TOTALS])

    return df.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, " + ", ".join(f"{c} long" for c in TOTALS))


def by_id(df: DataFrame, id_col: str) -> DataFrame:
    """Rows of one id next to each other in one partition, as the totals ask."""
    return df.repartition(id_col).sortWithinPartitions(id_col)


def kmer_totals(found: DataFrame, id_col: str) -> DataFrame:
    """``id_col, kmers, different, first, last`` of k-mers ``id_col, pos, kmer`` whose sequences came ``by_id``: how many, how many different ones, least and greatest place.

    K-mers are not exchanged; a task holds those of one id.
    """

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        runs = pc.run_end_encode(batch.column(0))
        ends, ids = runs.run_ends.to_numpy(), runs.values.to_pylist()
        pos, kmer = (batch.column(i).to_numpy() for i in (1, 2))
        for key, a, b in zip(ids, [0, *ends], ends):
            yield key, pos[a:b], kmer[a:b]

    return _totals_in_arrow(found.select(id_col, "pos", "kmer"), id_col, pieces)


def different_kmers(df: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    """``kmer_totals`` of sequences, ids that repeat counted together: sequences are exchanged, not k-mers."""

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for key, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            code, good = windows(codes_of(seq or ""), k)
            at = np.flatnonzero(good)
            yield key, at, code[at]

    return _totals_in_arrow(by_id(df.select(id_col, seq_col), id_col), id_col, pieces)


def fnv32(x: Column) -> Column:
    """FNV-1a of 32 bits over the eight bytes of a long, least byte first; from 0 to 2**32 - 1."""
    h = F.lit(2166136261).cast("long")
    for b in range(8):
        h = (h.bitwiseXOR(F.shiftrightunsigned(x.cast("long"), 8 * b).bitwiseAND(F.lit(0xFF))) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return h


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings begin with alike."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n < 1, F.when(n.isNotNull(), F.lit(0))).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n)).cast("long")


def common_prefix_by_halves(a: Column, b: Column, most: int) -> Column:
    """Characters that two strings begin with alike, up to ``most``: steps of halving length are taken while the parts are equal. Null if either is."""
    steps = [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]
    n = F.least(F.length(a), F.length(b), F.lit(most))
    part = lambda x, at, step: F.substring(x, at + 1, step)
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.when(a.isNotNull() & b.isNotNull(), F.lit(0)), lambda at, step: F.when((at + step <= n) & (part(a, at, step) == part(b, at, step)), at + step).otherwise(at))
