"""FASTQ and BAM files read in any number of splits."""

import bz2
import gzip
import random
import struct
import zlib

import pytest

from strandframe.sources import reads


def some_reads(rng, n, long=400):
    out = []
    for i in range(n):
        size = rng.randrange(1, long) if i % 17 else 0
        qual = "".join(chr(rng.choice([64, 43, *range(33, 90)])) for _ in range(size))
        if size and i % 3 == 0:
            qual = ("@" if i % 2 else "+") + qual[1:]
        out.append((f"read{i}", "".join(rng.choice("ACGTN") for _ in range(size)), qual))
    return out


def fastq(rows, end="\n"):
    return "".join(f"@{n} extra {i}{end}{s}{end}+{n if i % 2 else ''}{end}{q}{end}" for i, (n, s, q) in enumerate(rows))


def with_splits(spark, size, f):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        return f()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["350b", "1k", "9k", "128m"])
def test_fastq_in_splits(spark, tmp_path, size):
    rng = random.Random(1)
    rows = some_reads(rng, 120)
    a, b = rows[:70], rows[70:]
    (tmp_path / "a.fastq").write_text(fastq(a) + "\n\n")
    (tmp_path / "b.fastq").write_text(fastq(b, "\r\n"))
    (tmp_path / "c.fastq").write_text("")
    got = with_splits(spark, size, lambda: [tuple(r) for r in reads.read_fastq_splits(spark, str(tmp_path / "*.fastq")).collect()])
    assert sorted(got) == sorted(rows)


def test_fastq_with_very_long_reads_and_compressed(spark, tmp_path):
    rng = random.Random(2)
    rows = some_reads(rng, 12, 9000)
    (tmp_path / "a.fq").write_text(fastq(rows))
    assert sorted(with_splits(spark, "1k", lambda: [tuple(r) for r in reads.read_fastq_splits(spark, str(tmp_path / "a.fq")).collect()])) == sorted(rows)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(fastq(rows).encode()))
    (tmp_path / "b.fq.bz2").write_bytes(bz2.compress(fastq(rows).encode()))
    for name in ("b.fq.gz", "b.fq.bz2"):
        assert sorted(tuple(r) for r in reads.read_fastq_splits(spark, str(tmp_path / name)).collect()) == sorted(rows)


@pytest.mark.parametrize("text", ["@a\nAC\n+\nII\n@b\nACG\n", "@a\nAC\n+\nI\n", "a\nAC\n+\nII\n", "@a\nAC\nx\nII\n"])
def test_fastq_that_is_cut_off_or_odd(spark, tmp_path, text):
    (tmp_path / "a.fq").write_text(text)
    with pytest.raises(Exception, match="FASTQ"):
        reads.read_fastq_splits(spark, str(tmp_path / "a.fq")).collect()


NIBBLE = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


def record(name, seq, qual, flag=4):
    codes = [NIBBLE[c] for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 4680, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + bytes(qual) + b"RGZgroup\0"
    return struct.pack("<i", len(body)) + body


def bgzf(data, sizes):
    out, at = b"", 0
    while at < len(data) or not data:
        n = sizes()
        part = data[at : at + n]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
        at += n
        if not data:
            break
    return out


END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    rng = random.Random(7)
    turn = str.maketrans("ACGTN", "TGCAN")
    header = b"BAM\x01" + struct.pack("<i", 40) + b"@HD\tVN:1.6\tSO:unsorted".ljust(40, b" ") + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)
    data, want = header, []
    for i in range(400):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 900) if i % 9 else 0))
        qual = [rng.randrange(0, 60) for _ in seq]
        back = i % 5 == 0
        stored = (seq[::-1].translate(turn), qual[::-1]) if back else (seq, qual)
        data += record(f"r{i}", *stored, 0x10 if back else 4)
        if seq:
            want.append((f"r{i}", seq, "".join(chr(q + 33) for q in qual)))
    folder = tmp_path_factory.mktemp("bam")
    (folder / "a.bam").write_bytes(bgzf(data, lambda: rng.randrange(500, 5000)) + END)
    return folder, data, want, header


@pytest.mark.parametrize("split", [3000, 20_000, 1 << 26])
def test_bam_in_splits(spark, bam, split):
    folder, _, want, _ = bam
    df = reads.read_bam(spark, str(folder / "a.bam"), split)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    if split == 3000:
        assert df.rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in reads.read_bam(spark, f"file://{folder}", split).collect()) == sorted(want)


def test_bam_that_is_cut_off_empty_or_unnamed(spark, bam, tmp_path):
    folder, data, _, header = bam
    whole = (folder / "a.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="cut off|within a record"):
        reads.read_bam(spark, str(tmp_path / "cut.bam")).collect()
    (tmp_path / "ends.bam").write_bytes(bgzf(data[:-20], lambda: 4000) + END)
    with pytest.raises(Exception, match="within a record"):
        reads.read_bam(spark, str(tmp_path / "ends.bam")).collect()
    (tmp_path / "open.bam").write_bytes(bgzf(data, lambda: 3000))  # without the empty block at the end
    assert reads.read_bam(spark, str(tmp_path / "open.bam"), 2000).count() == reads.read_bam(spark, str(folder / "a.bam")).count()
    (tmp_path / "none.bam").write_bytes(bgzf(header, lambda: 4000) + END)
    assert reads.read_bam(spark, str(tmp_path / "none.bam")).count() == 0
    (tmp_path / "text.bam").write_bytes(bgzf(b"not a header, but long enough", lambda: 4000))
    with pytest.raises(Exception, match="not a BAM"):
        reads.read_bam(spark, str(tmp_path / "text.bam")).collect()
    (tmp_path / "star.bam").write_bytes(bgzf(header + record("*", "AC", [255, 255]), lambda: 4000) + END)
    assert [tuple(r) for r in reads.read_bam(spark, str(tmp_path / "star.bam")).collect()] == [("unnamed_0_0", "AC", "!!")]
