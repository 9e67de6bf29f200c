"""Reads from FASTQ and unaligned BAM files, in as many tasks as the files have splits."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..session import prepare

READ = "name string, seq string, qual string"


def _records(lines: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Columns of whole FASTQ records."""
    heads, seqs, marks, quals = (lines[i::4] for i in range(4))
    if any(not x.startswith("@") for x in heads) or any(not x.startswith("+") for x in marks):
        raise ValueError("a FASTQ record does not begin with @ or lacks its +")
    if any(len(x) != len(y) for x, y in zip(seqs, quals)):
        raise ValueError("a FASTQ record has not as many qualities as bases")
    return [(x[1:].split() or ["unnamed"])[0] for x in heads], seqs, quals


def first_record(lines: list[str]) -> int | None:
    """The first line that begins a record: an @, and a + two lines on. A line of qualities may begin with @, but two lines on stand bases. None if no line shows it."""
    return next((i for i in range(len(lines) - 2) if lines[i].startswith("@") and lines[i + 2].startswith("+")), None)


def read_fastq_splits(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, qual`` of plain, gzip or bzip2 files, a file in as many splits as Spark cuts it into.

    Each split finds its first whole record and keeps the lines before it and after its last one as fragments; the
    fragments between two splits, a few lines each, are put together by file and parsed. A record that is cut
    off, or lacks its @ or +, is an error. Names end at the first blank; blank lines at a file's end do not count.
    A split without any record start (inside a very long read) is a fragment as a whole.
    """
    prepare(spark)
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    names = ["name", "seq", "qual", "file", "split", "known", "head", "tail"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        held: list[str] = []
        known, head = False, []

        def records(lines: list[str]) -> pa.RecordBatch:
            columns = _records(lines)
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), *(pa.nulls(n, t) for t in kinds[3:])], names=names)

        def fragment() -> pa.RecordBatch:
            row = (None, None, None, *place, known, head if known else held, held if known else [])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            values, files, splits = (batch.column(i).to_pylist() for i in range(3))
            cuts = [0, *(i for i in range(1, len(values)) if (files[i], splits[i]) != (files[i - 1], splits[i - 1])), len(values)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if place != (files[a], splits[a]):
                    if place is not None:
                        yield fragment()
                    place, held, head = (files[a], splits[a]), [], []
                    known = splits[a] == 0  # a file begins with a record
                held += [v.rstrip("\r") for v in values[a:b]]
                if not known:
                    at = first_record(held)
                    if at is not None:
                        known, head, held = True, held[:at], held[at:]
                if known:
                    whole = len(held) // 4 * 4
                    while whole and not held[whole - 4]:  # blank lines at the end of a file
                        whole -= 4
                    if whole:
                        yield records(held[:whole])
                        held = held[whole:]
        if place is not None:
            yield fragment()

    found = text.mapInArrow(run, f"{READ}, file string, split long, known boolean, head array<string>, tail array<string>")
    pieces = found.where("file is not null")
    # a split's tail, splits of unknown phase and the next head belong together
    group = F.sum(F.col("known").cast("int")).over(Window.partitionBy("file").orderBy("split"))
    numbered = pieces.withColumn("g", group)
    parts = numbered.select("file", F.explode(F.array(F.struct(F.when(F.col("known"), F.col("g") - 1).otherwise(F.col("g")).alias("g"), (F.col("split") * 2).alias("o"), F.col("head").alias("lines")), F.struct("g", (F.col("split") * 2 + 1).alias("o"), F.col("tail").alias("lines")))).alias("p")).select("file", "p.*")
    joined = parts.where(F.size("lines") > 0).groupBy("file", "g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "lines"))), lambda x: x["lines"])).alias("lines"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in batch.column(0).to_pylist():
                while lines and not lines[-1] and len(lines) % 4:
                    lines.pop()
                if len(lines) % 4 == 3:
                    lines.append("")  # an empty quality line at the end
                while lines and not any(lines[-4:]):
                    del lines[-4:]
                if len(lines) % 4:
                    raise ValueError("a FASTQ file ends within a record")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in _records(lines)], names=names[:3])

    return found.where("file is null").select("name", "seq", "qual").unionByName(joined.select("lines").mapInArrow(mend, READ))


# -- unaligned BAM ---------------------------------------------------------------------------------------------

#: Bytes of a split, and of a compressed block at the most.
SPLIT, BLOCK = 64 << 20, 1 << 16
_NIBBLES = "=ACMGRSVTWYHKDBN"
_PAIRS = np.array([[a, b] for a in _NIBBLES.encode() for b in _NIBBLES.encode()], np.uint8)
_TURN = bytes.maketrans(b"ACGTMRWSYKVHDBN=", b"TGCAKYWSRMBDHVN=")
REVERSE = 0x10


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def block_size(data: bytes, at: int) -> int | None:
    """Bytes of the compressed block that begins here, by its header's extra field; None if none does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    i, end = at + 12, min(at + 12 + extra, len(data))
    while i + 4 <= end:
        tag, size = data[i : i + 2], struct.unpack_from("<H", data, i + 2)[0]
        if tag == b"BC" and size == 2 and i + 6 <= len(data):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + size
    return None


def blocks_from(handle: object, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """``offset, contents`` of the blocks from the first one that begins at ``start`` or later, and an empty one at the end; a cut-off block is an error."""
    at, data = start, b""
    searching = start > 0
    while True:
        while len(data) < 2 * BLOCK and at + len(data) < length:
            handle.seek(at + len(data))
            more = handle.read(min(1 << 20, length - at - len(data)))
            if not more:
                break
            data += more
        if not data:
            yield length, b""
            return
        size = block_size(data, 0)
        if searching:
            # a block is told by its header and that of the next, or the file's end
            follows = size is not None and (at + size == length or size <= len(data) - 4 and block_size(data, size) is not None)
            if not follows:
                step = data.find(b"\x1f\x8b\x08\x04", 1)
                step = step if step >= 0 else max(len(data) - 3, 1)
                at, data = at + step, data[step:]
                continue
            searching = False
        if size is None or size > len(data):
            raise ValueError(f"a BAM file is cut off or damaged at byte {at}")
        yield at, zlib.decompress(data[12 + struct.unpack_from("<H", data, 10)[0] : size - 8], wbits=-15)
        at, data = at + size, data[size:]


def plausible(data: bytes, at: int) -> int | None:
    """Where the next record begins if one that is sound begins here; None if not, or if it cannot be told."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 33 or name < 1 or bases < 0 or min(ref, mate, pos, mate_pos) < -1 or 32 + name + 4 * ops + (bases + 1) // 2 + bases > size:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(c < 33 or c > 126 for c in text[:-1])):
        return None
    return at + 4 + size


def first_bam_record(data: bytes, ended: bool, need: int = 3) -> int | None:
    """The first place from which ``need`` sound records follow each other, or fewer up to the end of a file that ``ended``; None without any."""
    n = len(data) - 36
    if n < 0:
        return None
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    word = lambda k: (raw[k : k + n + 1] | raw[k + 1 : k + n + 2] << 8 | raw[k + 2 : k + n + 3] << 16 | raw[k + 3 : k + n + 4] << 24).astype(np.int32)
    likely = (word(0) >= 33) & (word(4) >= -1) & (word(8) >= -1) & (raw[12 : 12 + n + 1] > 0) & (word(20) >= 0) & (word(24) >= -1) & (word(28) >= -1)
    for at in np.flatnonzero(likely):
        i, found = int(at), 0
        while i is not None and found < need and i < len(data):
            i, found = plausible(data, i), found + 1
        if i is not None and (found == need or ended and i == len(data)):
            return int(at)
    return None


def bases_of(packed: bytes, n: int) -> bytes:
    return _PAIRS[np.frombuffer(packed, np.uint8)].tobytes()[:n]


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, length: int, header: int):
        self.path, self.start, self.end, self.length, self.header = path, start, end, length, header


class BamReader(DataSourceReader):
    """Ranges of bytes; each reads the records that begin in the blocks that begin in its range."""

    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            store, name = _open(path)
            length = store.get_file_info(name).size
            if not length:
                continue
            header = _header(store, name, length)
            out += [Range(path, at, min(at + self.split, length), length, header) for at in range(0, length, self.split)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, name = _open(part.path)
        with store.open_input_file(name) as handle:
            data, base, synced, over = b"", 0, part.start == 0, False
            stop: int | None = None  # records that begin at this place of ``data`` or later are the next range's
            if synced:
                base = -part.header
            rows: list[tuple] = []
            for offset, block in blocks_from(handle, part.start, part.length):
                if offset >= part.end and stop is None:
                    stop, over = len(data), True
                data += block
                if not synced:
                    at = first_bam_record(data, not block)
                    if at is None:
                        continue  # with one more block
                    data, synced = data[at:], True
                    stop = stop - at if stop is not None else None
                elif base < 0:  # the header comes first
                    skip = min(-base, len(data))
                    data, base = data[skip:], base + skip
                    stop = max(stop - skip, 0) if stop is not None else None
                    if base < 0:
                        continue
                i = 0
                while i + 4 <= len(data) and (stop is None or i < stop):
                    size = struct.unpack_from("<i", data, i)[0]
                    if i + 4 + size > len(data):
                        break
                    row = self._row(data, i, size, f"{part.start}_{len(rows)}")
                    rows += [row] if row else []
                    i += 4 + size
                data = data[i:]
                stop = stop - i if stop is not None else None
                if len(rows) >= 2000 or sum(len(r[1]) for r in rows[-50:]) > BLOCK * 50:
                    yield _batch(rows)
                    rows = []
                if stop is not None and stop <= 0:
                    break
            else:
                if synced and data and (stop is None or stop > 0) and base == 0:
                    raise ValueError(f"{part.path} ends within a record")
            if rows:
                yield _batch(rows)

    def _row(self, data: bytes, at: int, size: int, place: str) -> tuple[str, str, str] | None:
        _, _, name_n, _, _, ops, flag, n = struct.unpack_from("<iiBBHHHi", data, at + 4)
        if n == 0:
            return None
        name = data[at + 36 : at + 35 + name_n].decode("utf-8", "replace")
        seq_at = at + 36 + name_n + 4 * ops
        seq = bases_of(data[seq_at : seq_at + (n + 1) // 2], n)
        qual = np.frombuffer(data, np.uint8, n, seq_at + (n + 1) // 2)
        qual = (np.where(qual == 255, 0, np.minimum(qual, 93)) + 33).astype(np.uint8)
        if flag & REVERSE:
            seq, qual = seq.translate(_TURN)[::-1], qual[::-1]
        return (name if name not in ("", "*") else f"unnamed_{place}", seq.decode(), qual.tobytes().decode())


def _header(store: fs.FileSystem, name: str, length: int) -> int:
    """Bytes of the header: magic, text and the list of references."""
    with store.open_input_file(name) as handle:
        data, need = b"", 12
        blocks = blocks_from(handle, 0, length)

        def upto(n: int) -> None:
            nonlocal data
            while len(data) < n:
                block = next(blocks, None)
                if block is None:
                    raise ValueError("a BAM file ends within its header")
                data += block[1]

        upto(need)
        if data[:4] != b"BAM\x01":
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        upto(at + 4)
        count = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(count):
            upto(at + 4)
            at += 8 + struct.unpack_from("<i", data, at)[0]
            upto(at)
        return at


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["name", "seq", "qual"])


class BamSource(DataSource):
    """Options: ``path`` (a file, a folder or a comma-separated list) and ``split``, bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "unaligned_bam"

    def schema(self) -> str:
        return READ

    def reader(self, schema: object) -> BamReader:
        paths = []
        for path in self.options["path"].split(","):
            store, name = _open(path)
            info = store.get_file_info(name)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            if info.type == fs.FileType.Directory:
                inside = store.get_file_info(fs.FileSelector(name))
                prefix = path.rstrip("/")
                paths += sorted(f"{prefix}/{x.base_name}" for x in inside if x.type == fs.FileType.File and x.base_name.endswith((".bam", ".ubam")))
            else:
                paths.append(path)
        return BamReader(paths, int(self.options.get("split", SPLIT)))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``name, seq, qual`` of unaligned BAM files, a file in ranges of ``split`` bytes.

    A range reads the records that begin in its blocks: it finds its first block by the headers of two, and its first
    record by three sound ones in a row. Reads stored reversed are turned back; reads without bases are left out;
    those without a name become ``unnamed_`` and their place; missing qualities are 0. A file that is cut off raises.
    Files are opened by URI, so any store that Arrow knows will do.
    """
    prepare(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format("unaligned_bam").option("split", split).load(path)
