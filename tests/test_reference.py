"""References in blocks: reading in splits, pruned ranges, extension, base checks."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import reference
from strandframe.sources import reference as source


def bases(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def contigs():
    rng = random.Random(2)
    return {"chr1": bases(rng, 5000), "chr2": "", "chr3": bases(rng, 1), "chr4": bases(rng, 40_000), "scaffold_5": bases(rng, 777, "ACGTN")}


@pytest.fixture(scope="module")
def fasta(contigs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fasta")
    lines = ["; before any header", "ACGT"]
    for i, (name, seq) in enumerate(contigs.items()):
        lines.append(f">{name} description {i}, chromosome {i}, Test Primary Assembly")
        width = (60, 61, 70)[i % 3]
        lines += [seq[a : a + width].lower() if i % 2 else seq[a : a + width] for a in range(0, len(seq), width)] + [""]
    (folder / "a.fa").write_text("\n".join(lines))
    (folder / "b.fa").write_text(">other\nACGTACGT\r\nAC GT")
    return str(folder)


@pytest.mark.parametrize("split", ["700b", "10k", "128m"])
def test_fasta_in_splits(spark, fasta, contigs, split):
    want = contigs | {"other": "ACGTACGTACGT"}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        blocks, listed = source.read_fasta_blocks(spark, fasta, 100)
        got = {}
        for r in blocks.orderBy("chrom", "block").collect():
            assert len(got.get(r.chrom, "")) == r.block * 100
            got[r.chrom] = got.get(r.chrom, "") + r.bases
        lengths = {r.name: (r.length, r.description[:13]) for r in listed.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {k: v for k, v in want.items() if v}
    assert {k: n for k, (n, _) in lengths.items()} == {k: len(v) for k, v in want.items()} and lengths["chr4"][1] == "description 3"


def test_a_range_reads_its_own_folders(spark, fasta, contigs, tmp_path):
    blocks, listed = source.read_fasta_blocks(spark, fasta, 100)
    path = str(tmp_path / "ref")
    source.save_reference(blocks, listed, path, width=100, shelves=64, group=4)
    seq = contigs["chr4"]
    ranges = [("chr4", 350, 1250), ("chr4", -5, 10), ("chr4", 39_990, 50_000), ("chr4", 10, 10), ("chr4", 50_000, 60_000), ("chr1", 99, 101), ("none", 0, 5)]
    want = [{"chr4": seq, "chr1": contigs["chr1"]}.get(c, "")[max(a, 0) : max(b, 0)] for c, a, b in ranges]
    assert [source.fetch_range(spark, path, *r).first().seq for r in ranges] == want
    held, _, width = source.load_reference(spark, path)
    assert width == 100 and held.count() == sum(-(-len(s) // 100) for s in contigs.values()) + 1
    df = source.fetch_range(spark, path, "chr4", 350, 1250)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "shelf" in plan.split("PartitionFilters")[1].split("]")[0]
    import zlib

    needed = {f"shelf={zlib.crc32(f'chr4:{g}'.encode()) % 64}" for g in range(0, 4)}
    for folder in (tmp_path / "ref" / "blocks").iterdir():  # the others may as well not be there
        if folder.is_dir() and folder.name not in needed:
            shutil.rmtree(folder)
    spark.catalog.clearCache()
    assert source.fetch_range(spark, path, "chr4", 350, 1250).first().seq == seq[350:1250]


def test_windows_of_odd_ranges(spark, contigs):
    rows = spark.createDataFrame([(n, s) for n, s in contigs.items()] + [("null", None)], "name string, seq string")
    held = reference.blocks(rows, 64)
    ranges = [(0, "chr1", 60, 70), (1, "chr1", 0, 5000), (2, "chr1", 64, 128), (3, "chr1", 128, 64), (4, "chr2", 0, 10), (5, None, 0, 10), (6, "chr3", -3, 7), (7, "chr1", None, 5)]
    df = spark.createDataFrame([(*r, "k") for r in ranges], "id int, chrom string, start long, end long, block string")
    got = {r.id: (r.bases, r.block) for r in reference.windows(df, held, ["id"], ["block"], 64).collect()}
    assert got == {i: (contigs.get(c, "")[max(a, 0) : b] if a is not None and b > a else "", "k") for i, c, a, b in ranges[:7]} | {7: (contigs["chr1"][:5], "k")}


def plain_extension(read, ref, reverse, rs, re_, fs, fe, most):
    turn = {"A": "T", "C": "G", "G": "C", "T": "A"}
    steps = {"left": 0, "right": 0}
    for side in steps:
        while steps[side] < most:
            n = steps[side]
            q = rs - 1 - n if side == "left" else re_ + n
            t = (fe + n if side == "left" else fs - 1 - n) if reverse else (fs - 1 - n if side == "left" else fe + n)
            if not (0 <= q < len(read) and 0 <= t < len(ref)) or (turn[read[q]] if reverse else read[q]) != ref[t]:
                break
            steps[side] += 1
    return steps["left"], steps["right"]


@pytest.mark.parametrize("most", [7, 500])
def test_exact_extension_of_hand(spark, most):
    rng = random.Random(5)
    ref = bases(rng, 900)
    reads, seeds = [], []
    for i in range(40):
        a = rng.randrange(0, 500)
        piece = list(ref[a : a + rng.randrange(60, 400)])
        for _ in range(rng.randrange(3)):
            piece[rng.randrange(len(piece))] = rng.choice("ACGT")
        reverse = i % 2 == 1
        s = rng.randrange(0, len(piece) - 20)
        read = "".join(piece)
        n = len(read)
        if reverse:
            read = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
        reads.append((f"r{i}", read))
        seeds.append((f"r{i}", "c", reverse, n - s - 20 if reverse else s, n - s if reverse else s + 20, a + s, a + s + 20))
    kind = "read string, chrom string, reverse boolean, read_start long, read_end long, ref_start long, ref_end long"
    rows = spark.createDataFrame([*seeds, seeds[0], ("lost", "c", False, 0, 20, 0, 20), ("r1", "gone", False, 5, 25, 0, 20)], kind)
    held = reference.blocks(spark.createDataFrame([("c", ref)], "name string, seq string"), 64)
    got = reference.extend_exact(rows, spark.createDataFrame(reads, "read string, seq string"), held, most=most, width=64).collect()
    texts = dict(reads)
    assert len(got) == 43
    for r in got:
        want = plain_extension(texts[r.read], ref, r.reverse, r.read_start, r.read_end, r.ref_start, r.ref_end, most) if r.read in texts and r.chrom == "c" else (0, 0)
        assert (r.left_ext, r.right_ext) == want


def test_exact_extension_cuts_the_reference_once_a_place(spark, monkeypatch):
    rng = random.Random(6)
    ref = bases(rng, 700)
    reads = [(f"r{i}", ref[100 : 300 + i] + "N") for i in range(20)]
    seeds = [(r, "c", False, 50, 70, 150, 170) for r, _ in reads] + [(r, "c", False, 80, 95, 180, 195) for r, _ in reads]
    asked, cut = [], reference.windows
    monkeypatch.setattr(reference, "windows", lambda ranges, *rest, **more: (asked.append(ranges.count()), cut(ranges, *rest, **more))[1])
    rows = spark.createDataFrame(seeds, "read string, chrom string, reverse boolean, read_start long, read_end long, ref_start long, ref_end long")
    held = reference.blocks(spark.createDataFrame([("c", ref)], "name string, seq string"), 64)
    got = reference.extend_exact(rows, spark.createDataFrame(reads, "read string, seq string"), held, width=64).collect()
    assert asked == [4, 4]  # two places, two sides, near and far
    texts = dict(reads)
    assert len(got) == 40 and all((r.left_ext, r.right_ext) == (r.read_start, len(texts[r.read]) - 1 - r.read_end) for r in got)


def test_common_prefix_by_halves(spark):
    rows = [("", "a", 0), ("abc", "abd", 2), ("abc", "abc", 3), ("abcdefghij", "abcdefghijk", 6), (None, "a", None), ("x", "y", 0)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert all(r.n == r.p for r in df.withColumn("p", S.common_prefix_by_halves(F.col("a"), F.col("b"), 6)).collect())


def test_bases_along_cigars_of_hand(spark):
    ref = "ACGTACGTAC"
    rows = [
        ("ok", "c", 2, "2S4=1X1I2=", "TTGTACTGTA"), ("m", "c", 0, "10M", "ACGTACGTAA"), ("eq", "c", 0, "3=", "ACT"), ("x", "c", 0, "2=1X", "ACG"), ("gone", "d", 0, "3M", "ACG"), ("far", "c", 8, "4M", "ACGT"), ("start", "c", 10, "1M", "A"),
        ("short", "c", 0, "4M", "ACG"), ("zero", "c", 0, "2M0D1M", "ACG"), ("twice", "c", 0, "1M2M", "ACG"), ("clip", "c", 0, "1M1S1M", "ACG"), ("none", "c", 0, "*", None), ("null", None, None, None, None), ("del", "c", 0, "2=3D2=", "ACCG"), ("hard", "c", 0, "5H3=2H", "ACG"),
    ]
    records = spark.createDataFrame([(*r, 1) for r in rows], "read string, chrom string, start long, cigar string, seq string, _length int").drop("_length")
    held = reference.blocks(spark.createDataFrame([("c", ref)], "name string, seq string"), 3)
    checked = reference.check_bases(records, spark.createDataFrame([("c", 10)], "chrom string, length long"), held, ["read"], 3)
    got = {r.read: ((r.m_matches, r.m_mismatches, r.eq_mismatches, r.x_matches), sorted(r.problems)) for r in checked.collect()}
    assert got["ok"] == ((0, 0, 0, 0), []) and got["m"] == ((9, 1, 0, 0), []) and got["eq"] == ((0, 0, 1, 0), ["match_mismatch"]) and got["x"] == ((0, 0, 0, 1), ["mismatch_match"])
    assert got["gone"][1] == ["unknown_contig"] and got["far"] == ((2, 0, 0, 0), ["end_out_of_range"]) and got["start"][1] == ["end_out_of_range", "start_out_of_range"]
    assert got["short"] == ((3, 0, 0, 0), ["query_length"]) and got["zero"][1] == ["zero_length"] and got["twice"][1] == ["repeated_operation"] and got["clip"][1] == ["inner_clip"]
    assert got["none"] == ((0, 0, 0, 0), []) and got["null"][0] == (0, 0, 0, 0) and got["del"] == ((0, 0, 0, 0), []) and got["hard"] == ((0, 0, 0, 0), [])
    total = reference.validation(checked).first()
    assert (total.records, total.problems, total.passed) == (15, sum(len(p) for _, p in got.values()), False)
    with pytest.raises(ValueError, match="problems"):
        reference.require_valid(checked)
    reference.require_valid(checked.where("read in ('ok', 'del')"))
    assert reference.validation(checked.limit(0)).first().passed


@pytest.mark.parametrize("smer", [None, 5])
def test_kmers_of_blocks_equal_those_of_contigs(spark, contigs, smer):
    rows = spark.createDataFrame([*contigs.items(), ("none", None)], "name string, seq string")
    whole = sorted(tuple(r) for r in S.kmers(rows, "name", "seq", 11, smer).collect())
    blocked = sorted(tuple(r) for r in reference.kmers_of_blocks(reference.blocks(rows, 100), 11, smer, 100).collect())
    assert blocked == whole and len(whole) > 1000


def test_kmers_of_many_short_sequences(spark, monkeypatch):
    monkeypatch.setattr(S, "JOINED", 50)
    rng = random.Random(8)
    rows = [(i, bases(rng, rng.randrange(0, 30), "ACGTN")) for i in range(300)] + [(400, None), (401, "ACGTACGTACGTAC")]
    want = sorted((i, p, sum("ACGT".index(c) * 4 ** (5 - j) for j, c in enumerate(s[p : p + 6]))) for i, s in rows if s for p in range(len(s) - 5) if "N" not in s[p : p + 6])
    assert sorted(tuple(r) for r in S.kmers(spark.createDataFrame(rows, "i long, s string"), "i", "s", 6).collect()) == want


def test_aligned_records_do_not_overlap_and_hold_their_bases(spark):
    from strandframe.plans.inputs import sequences
    from strandframe.plans.references import aligned

    data = "/root/testdata/sf0.01"
    records, parts = aligned(spark, data)
    rows = sorted(tuple(r) for r in parts.select("read", "read_start", "read_end").collect())
    assert len(rows) > 100 and all(a < b for _, a, b in rows)
    assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(rows, rows[1:]))
    passages = sequences(spark, data, "benchmark", "item_id")
    contigs = passages.select(F.col("id").alias("chrom"), F.length("seq").cast("long").alias("length"))
    checked = reference.check_bases(parts.select("read", "part", "chrom", F.col("ref_start").alias("start"), "cigar", "seq"), contigs, reference.blocks(passages, 100, "id"), ["read", "part"], 100)
    assert [tuple(r) for r in checked.where(F.size("problems") > 0).collect()] == []
    got = records.join(parts.select("read", "part", "read_len"), ["read", "part"]).collect()
    import re

    for r in got:  # with its clips a record accounts for the whole read
        ops = [(int(n), op) for n, op in re.findall(r"([0-9]+)([=XIDH])", r.cigar)]
        assert sum(n for n, op in ops if op in "=XIH") == r.read_len
    per = {}
    for r in got:
        per.setdefault(r.read, []).append(r)
    assert all(sum(not x.flag & 0x800 for x in v) == 1 and all((x.sa or "").count(";") == len(v) - 2 for x in v if len(v) > 1) for v in per.values())


def test_records_are_compared_together_as_each_alone(monkeypatch):
    monkeypatch.setattr(reference, "COMPARED", 3)
    ops = [["M"], None, ["S", "=", "I", "X", "D", "M"], ["M", "="], [], ["="]]
    lengths = [[4], None, [1, 2, 1, 2, 1, 9], [2, 2], [], [3]]
    seqs, refs = ["ACGT", "AC", "TACGGTAA", "AC", "", "AAA"], ["AGGT", "AC", "AGGACAT", "ACGT", "AC", None]
    # M same, M different, = different, X same
    assert reference._compare(ops, lengths, seqs, refs).T.tolist() == [[3, 1, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1], [2, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
