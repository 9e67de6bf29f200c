import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import cigar, scalars
from strandframe.functions import sequence as S


def value(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("x")).first()["x"]


def kmers_of(spark, seq, k, **more):
    df = spark.createDataFrame([(1, seq)], "id long, seq string")
    return [(r.pos, r.kmer) for r in S.kmers(df, "id", "seq", k, **more).orderBy("pos").collect()]


def code(kmer):
    return int("".join("0123"["ACGT".index(c)] for c in kmer), 4)


def test_forward_kmers(spark):
    assert kmers_of(spark, "ACGTAC", 3) == [(i, code(k)) for i, k in enumerate(["ACG", "CGT", "GTA", "TAC"])]


def test_invalid_base_resets(spark):
    assert kmers_of(spark, "ACNACG", 3, s=2) in ([], [(3, code("ACG"))])
    assert kmers_of(spark, "ACNAC", 3) == []
    assert kmers_of(spark, None, 3) == kmers_of(spark, "", 3) == []


def test_syncmer_golden(spark):
    found = kmers_of(spark, "ACGTACGTA", 4, s=2, both=False, hasher="identity")
    assert [k for _, k in found] == [code("GTAC")]


@given(st.text("ACGTNacgtu", max_size=60), st.integers(3, 9))
def test_syncmers_against_plain_python(seq, k):
    s = k // 2 + 1 if k > 3 else 2

    def fnv(x):
        h = 14695981039346656037
        for i in range(8):
            h = (h ^ (x >> (8 * i) & 255)) * 1099511628211 % 2**64
        return h

    def least(kmer):
        hashes = [fnv(code(kmer[i : i + s])) for i in range(k - s + 1)]
        return hashes[-1] <= min(hashes)

    bases = seq.upper().replace("U", "T")
    rc = str.maketrans("ACGT", "TGCA")
    want = [i for i in range(len(bases) - k + 1) if set(bases[i : i + k]) <= set("ACGT") and (least(bases[i : i + k]) or least(bases[i : i + k][::-1].translate(rc)))]
    codes = S._CODES[np.frombuffer(seq.encode(), np.uint8)]
    _, good = S.windows(codes, k)
    assert np.flatnonzero(good & S.syncmer_mask(codes, k, s, True)).tolist() == want


def test_hashes(spark):
    df = spark.createDataFrame([(0,), (1,), (123456789012,), (-5,), (2**63 - 1,)], "x long")
    got = [r[0] for r in df.select(S.fnv64(F.col("x"))).collect()]
    want = S.fnv64_array(np.array([0, 1, 123456789012, -5, 2**63 - 1], dtype=np.int64).view(np.uint64)).view(np.int64).tolist()
    assert got == want
    assert S.mix64_array(np.array([0], dtype=np.uint64))[0] == 0
    assert int(S.splitmix64_array(np.array([0], dtype=np.uint64))[0]) == 0xE220A8397B1DCDAF


def test_revcomp_and_gc(spark):
    assert value(spark, S.revcomp(F.col("s")), s="AACGTNxu") == "NNNACGTT"
    assert value(spark, S.gc_content(F.col("s")), s="GGAANN") == 0.5
    assert value(spark, S.gc_content(F.col("s")), s="") is None
    assert value(spark, S.kmer_text(S.kmer_code(F.col("s")), 5), s="ACGTA") == "ACGTA"


@pytest.mark.parametrize("identity, phred", [(1.0, 60.0), (0.0, 0.0), (0.9, 20.0), (0.99, 40.0)])
def test_phred_of_identity(spark, identity, phred):
    assert value(spark, cigar.identity_phred(F.col("i")), i=identity) == pytest.approx(phred)


@pytest.mark.parametrize("text, identity", [("90=10X", 0.9), ("90=5I5D", 0.9), ("", 0.0), ("*", 0.0)])
def test_identity(spark, text, identity):
    assert value(spark, cigar.identity(cigar.parse(F.col("c"))), c=text) == pytest.approx(identity)


@pytest.mark.parametrize("text, reverse", [("5S20=10H", False), ("10H20=5S", True)])
def test_query_range_counts_hard_clips(spark, text, reverse):
    ops = cigar.parse(F.col("c"))
    got = value(spark, F.struct(cigar.query_length(ops), cigar.query_range(ops, F.col("r"))["start"], cigar.query_range(ops, F.col("r"))["end"]), c=text, r=reverse)
    assert tuple(got) == (35, 5, 25)


def test_basic_joins_matches(spark):
    assert value(spark, cigar.basic(F.col("c")), c="5S3=2X4=1I2=") == "5S9M1I2M"


def test_scalars(spark):
    assert [value(spark, scalars.size_band(F.col("n")), n=n) for n in (0, 1, 2, 3, 4, 1023)] == [0, 1, 2, 2, 4, 512]
    cost = lambda x: value(spark, scalars.piecewise_cost(F.col("x"), 0.02, [(15, 0.03), (60, 0.15)]), x=float(x))
    assert [round(cost(x), 6) for x in (15, 60, 70, -1)] == [0.3, 2.55, 4.55, 0.0]
    kinds = {("chr1", ""): "Chromosome", ("chr1_x_alt", ""): "AltScaffold", ("chrUn_K", ""): "Unplaced", ("HLA-A", ""): "Other", ("x", "rl:unlocalized rg:chr1:1-2"): "Unlocalized"}
    for (name, text), kind in kinds.items():
        assert value(spark, scalars.localization(F.col("n"), F.col("d")), n=name, d=text) == kind
    assert value(spark, scalars.reference_group(F.col("d")), d="AC:1 rg:chr1:1-2") == "chr1"
