import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.operators import alignment, chaining, validate
from strandframe.sources import genomic as G


@settings(deadline=None, max_examples=60)
@given(st.text("ACG", max_size=9), st.text("ACG", max_size=9))
def test_global_alignment_is_optimal(q, t):
    low = -(10**9)
    m, d, i = {}, {}, {}
    for a, b in itertools.product(range(len(q) + 1), range(len(t) + 1)):
        m[a, b] = 0 if a == b == 0 else low if not a or not b else max(x[a - 1, b - 1] for x in (m, d, i)) + (1 if q[a - 1] == t[b - 1] else -1)
        i[a, b] = max(max(m[a - 1, b], d[a - 1, b]) - 6, i[a - 1, b] - 2) if a else low
        d[a, b] = max(max(m[a, b - 1], i[a, b - 1]) - 6, d[a, b - 1] - 2) if b else low
    score, cigar = alignment.align(q, t)
    assert score == max(x[len(q), len(t)] for x in (m, d, i))
    ops = [(int(n), op) for n, op in __import__("re").findall(r"(\d+)([=XID])", cigar)]
    a = b = total = 0
    for n, op in ops:
        if op in "=X":
            assert all((q[a + k] == t[b + k]) == (op == "=") for k in range(n))
            total += n if op == "=" else -n
        else:
            total -= 6 + 2 * (n - 1)
        a, b = a + n * (op in "=XI"), b + n * (op in "=XD")
    assert (a, b, total) == (len(q), len(t), score)


def seeds_of(rows):
    names = ("chrom", "reverse", "diagonal", "read_start", "read_end", "entry", "exit")
    out = []
    for q, n, r, chrom, rev in rows:
        out.append((chrom, rev, r + q + n if rev else r - q, q, q + n, r + n if rev else r, r if rev else r + n))
    out.sort(key=lambda s: (s[4], s[3], s[0]))
    return {k: np.array([s[i] for s in out]) for i, k in enumerate(names)}


def parts(s, chain):
    return [(int(s["chrom"][p[0]]), bool(s["reverse"][p[0]])) for p in chaining.split(s, chain, 120)]


C = chaining.ChainConfig()


def test_overlap_is_not_counted_twice():
    s = seeds_of([(0, 60, 1000, 0, False), (100, 60, 1100, 0, False), (50, 60, 5050, 1, False)])
    _, chain = chaining.explain(s, np.ones(3, bool), C)
    assert [int(s["chrom"][i]) for i in chain] == [0, 0]


def test_nearby_inversion_is_preferred():
    s = seeds_of([(0, 200, 10000, 0, False), (320, 200, 10360, 0, False), (200, 120, 9000, 0, True), (200, 120, 50000, 1, True)])
    _, chain = chaining.explain(s, np.ones(4, bool), C)
    assert parts(s, chain) == [(0, False), (0, True), (0, False)]


def test_map_quality():
    one = seeds_of([(0, 400, 1000, 0, False)])
    score, chain = chaining.explain(one, np.ones(1, bool), C)
    assert chaining.map_quality(one, score, chain, C) == 60
    two = seeds_of([(0, 400, 1000, 0, False), (0, 400, 900000, 0, False)])
    score, chain = chaining.explain(two, np.ones(2, bool), C)
    assert chaining.map_quality(two, score, chain, C) == 3


def test_best_chain_against_all_chains():
    rng = random.Random(8)
    for _ in range(40):
        s = seeds_of([(rng.randrange(300), rng.randrange(20, 90), rng.randrange(2000), rng.randrange(2), rng.random() < 0.3) for _ in range(6)])
        n = len(s["chrom"])

        def value(chain):
            total = C.match_bits * (s["read_end"][chain[0]] - s["read_start"][chain[0]])
            for j, i in zip(chain, chain[1:]):
                if s["read_end"][j] >= s["read_end"][i]:
                    return -1e9
                shift, gap = abs(s["diagonal"][i] - s["diagonal"][j]), s["read_start"][i] - s["read_end"][j]
                if s["chrom"][i] != s["chrom"][j]:
                    cost = 35 + 31.5
                elif s["reverse"][i] != s["reverse"][j]:
                    cost = 36 + np.log2(1 + abs(s["entry"][i] - s["exit"][j]))
                else:
                    cost = min(6 + shift if shift else 8 if gap > 0 else 0, 35 + np.log2(1 + shift))
                total += 2 * (s["read_end"][i] - max(s["read_start"][i], s["read_end"][j])) - cost
            return total

        best = max(value(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k))
        score, chain = chaining.best_chain(s, np.arange(n), C)
        assert score == pytest.approx(best) and value(chain) == pytest.approx(best)


def test_compound_seeds(spark):
    hits = [("r", 1, False, q, 100 + q) for q in (0, 3, 10, 40)] + [("r", 1, True, 50, 500), ("r", 1, True, 55, 495)]
    df = spark.createDataFrame(hits, "read_id string, chrom long, reverse boolean, read_pos long, ref_pos long")
    got = sorted(tuple(r) for r in chaining.compound_seeds(df, 10).select("reverse", "read_start", "read_end", "entry", "exit", "hits").collect())
    assert got == [(False, 0, 20, 100, 120, 3), (False, 40, 50, 140, 150, 1), (True, 50, 65, 510, 495, 2)]


def test_tiles_and_truth(spark):
    df = spark.createDataFrame([("a", "AACGTTTG"), ("b", ""), ("c", None)], "id string, seq string")
    assert [(r.parent, r.start, r.end, r.seq) for r in validate.tiles(df, 3).orderBy("start").collect()] == [("a", 0, 3, "AAC"), ("a", 3, 6, "GTT"), ("a", 6, 8, "TG")]
    names = spark.createDataFrame([("sim_1:chr1_101_200_+,chr_2_x_5_9_-",), ("plain",)], "name string")
    assert sorted(tuple(r)[1:] for r in validate.truth_segments(names).collect()) == [("chr1", 100, 200, False), ("chr_2_x", 4, 9, True)]


def test_record_problems(spark):
    rows = [("ok", 1, "c", 0, 60, "5S10=", 15), ("a", 1, "d", 0, 60, "15=", 15), ("b", 1, "c", 95, 255, "4=2D", 5), ("c", 1, "c", 0, 1, "3=2H4=z", 9)]
    df = spark.createDataFrame(rows, "read string, rank int, chrom string, rs long, mapq int, cigar string, seq_len int")
    contigs = spark.createDataFrame([("c", 100)], "chrom string, length long")
    got = {(r.read, r.problem) for r in validate.problems(df, contigs).collect()}
    assert got == {("a", "unknown_contig"), ("b", "beyond_contig"), ("b", "mapq_range"), ("b", "query_length"), ("b", "ends_in_gap"), ("c", "bad_cigar"), ("c", "query_length"), ("c", "inner_hard_clip")}


def test_variants(spark):
    rows = [(1, 10, "A", "ACGTACG", {"SVTYPE": "INS"}), (2, 10, "ACGT", "A", {"SVLEN": "-3"}), (3, 10, "A", "<DUP>", {"SVTYPE": "DUP", "END": "30"}), (4, 5, "A", "<INS>", {"SVTYPE": "INS", "INSSEQ": "TTT"})]
    df = spark.createDataFrame(rows, "id long, pos long, ref string, alt string, info map<string,string>")
    got = {r.id: (r.kind, r.start, r.end, r.seq) for r in validate.variant_sequences(df).collect()}
    assert got == {1: ("INS", 10, 10, "CGTACG"), 2: ("DEL", 10, 13, None), 3: ("DUP", 9, 30, None), 4: ("INS", 5, 5, "TTT")}


def test_sequence_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1 rl:Chromosome rg:chr1\nacgt\nAC\n>chr1_k_alt\nGGG\n>HLA-A*01:01 x\nA\n")
    fa = {r.name: (r.localization, r.length, r.seq) for r in G.read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert fa == {"chr1": ("Chromosome", 6, "ACGTAC"), "chr1_k_alt": ("AltScaffold", 3, "GGG"), "HLA-A*01:01": ("Other", 1, "A")}
    contigs = G.read_fasta(spark, str(tmp_path / "x.fa"), primary_only=True)
    assert contigs.count() == 1 and G.fetch(contigs, "chr1", -3, 2).first().seq == "AC" and G.fetch(contigs, "chr1", 4, 4).first().seq == ""
    reads = spark.createDataFrame([(f"r{i}", "ACGT" * 3, "@III" * 3) for i in range(5)], "name string, seq string, qual string")
    G.write_fastq_chunks(reads.coalesce(1), str(tmp_path / "fq"), 2)
    assert len(list((tmp_path / "fq").glob("part*"))) == 3
    assert sorted(map(tuple, G.read_fastq(spark, str(tmp_path / "fq")).collect())) == sorted(map(tuple, reads.collect()))
    import gzip

    (tmp_path / "z.fq.gz").write_bytes(gzip.compress(b"@a x\nAC\n+\nII\n"))
    assert [tuple(r) for r in G.read_fastq(spark, str(tmp_path / "z.fq.gz")).collect()] == [("a", "AC", "II")]
    G.write_fasta(spark.createDataFrame([("a", "A" * 61)], "name string, seq string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == ">a\n" + "A" * 60 + "\nA\n"


def test_alignment_and_interval_files(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\nr1\t16\tchr1\t11\t60\t4=\t*\t0\t0\tACGT\tIIII\tNM:i:0\tSA:Z:x:y\nshort\t1\n")
    sam = G.read_sam(spark, str(tmp_path / "x.sam"))
    r = sam.first()
    assert (r.read, r.flag, r.start, r.tags) == ("r1", 16, 10, {"NM": "i:0", "SA": "Z:x:y"}) and sam.count() == 1
    G.write_sam(sam, spark.createDataFrame([("chr1", 100)], "name string, length long"), str(tmp_path / "sam"))
    again = G.read_sam(spark, str(tmp_path / "sam"))
    assert again.first().start == 10 and again.count() == 1 and G.region(again, "chr1").count() == 1
    (tmp_path / "x.bed").write_text("track x\n#c\nchr1\t0\t5\tAlu|SINE|AluY\t0\t-\nchr1\t5\t9\n")
    assert [tuple(x) for x in G.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 0, 9)]
    assert [x.rep_class for x in G.read_repeats(spark, str(tmp_path / "x.bed")).collect()] == ["SINE"]
    (tmp_path / "x.vcf").write_text("##h\n#CHROM\nchr1\t7\tv\tA\tAC\t.\tPASS\tSVTYPE=INS;FLAG;END=7\n")
    v = G.read_vcf(spark, str(tmp_path / "x.vcf")).first()
    assert (v.pos, v.info["SVTYPE"], "FLAG" in v.info) == (7, "INS", True)
    (tmp_path / "strata.tsv").write_text(f"name\tbed\n# c\nrep\t{tmp_path}/x.bed\n")
    assert G.read_strata(spark, str(tmp_path / "strata.tsv")).first().stratum == "rep"
    index = spark.createDataFrame([(5, 1, 2, 1)], "kmer long, chrom long, ref_pos long, n_hits long")
    G.save_index(index, str(tmp_path / "idx"), 20, 10)
    assert G.load_index(spark, str(tmp_path / "idx"), 20, 10).count() == 1
    with pytest.raises(ValueError):
        G.load_index(spark, str(tmp_path / "idx"), 21, 10)
    with pytest.raises(ValueError):
        G.check_compatible(spark.createDataFrame([("a", 1)], "name string, length long"), spark.createDataFrame([("a", 2)], "name string, length long"))


def test_events_stream_like_tables(spark, tmp_path):
    from strandframe.streaming import events as E

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    out = E.tumbling(E.stream(spark, source), "1 hour", "365 days")
    run = out.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.start.replace(tzinfo=None), r.event_type): r.n for r in spark.table("tumbled").collect()}
    assert got == {(r.start, r.event_type): r.n for r in E.tumbling(events).collect()}
    rate = E.rolling_rate(E.stream(spark, source)).writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).start()
    rate.awaitTermination(120)
    assert spark.table("rates").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.count()


def test_quality_is_capped_where_copies_cannot_be_told_apart():
    s = seeds_of([(0, 400, 1000, 0, False)])
    score, chain = chaining.explain(s, np.ones(1, bool), C)
    assert chaining.map_quality(s | {"multiplicity": np.array([50])}, score, chain, C) == 60
    assert chaining.map_quality(s | {"multiplicity": np.array([100])}, score, chain, C) == 0


def test_places_are_linked_within_a_chromosome():
    s = seeds_of([(0, 50, 100, 0, False), (60, 50, 30_000, 0, False), (120, 50, 12_000, 0, True), (180, 50, 10, 1, False)])
    assert chaining.places(s, np.arange(4), 20_000).tolist() == [[0, 100, 30050], [1, 10, 60]]
    assert chaining.places(s, np.arange(0), 20_000).shape == (0, 3)
    assert chaining.touching(s, np.array([[1, 0, 5]]), 10).sum() == 1


@settings(deadline=None, max_examples=200)
@given(st.text("AC", min_size=1, max_size=30), st.integers(0, 29), st.integers(1, 6), st.booleans())
def test_left_aligned(text, at, n, insert):
    from strandframe.functions import cigar

    at = min(at, len(text))
    short, long = text[:at] + text[at + n :], text
    if len(short) == len(long) or at == 0:
        return
    k = len(long) - len(short)
    before = f"{at}={k}{'I' if insert else 'D'}" + (f"{len(short) - at}=" if len(short) > at else "")
    got = cigar.left_aligned(before, *((long, short) if insert else (short, long)))
    first = next(a for a in range(at + 1) if long[:a] + long[a + k :] == short)
    assert got == (f"{first}=" if first else "") + f"{k}{'I' if insert else 'D'}" + (f"{len(short) - first}=" if len(short) > first else "")


def test_cigar_editing_of_strings():
    from strandframe.functions import cigar

    assert cigar.left_aligned("4=1X2D3=", "ACGTAAAA", "ACGTGAAAAA") == "4=1X2D3="
    assert cigar.left_aligned("2S5=1I3=", "TTACGGGGACT", "ACGGGACT") == "2S2=1I6="
    assert cigar.left_aligned("*", "", "") == ""
    assert cigar.picture("2S2=1X1I1D1=", "NNACGTA", "ACTGA") == "ACT-GA\n||   |\nACGT-A"


def test_schedule_against_all_subsets():
    from strandframe.operators import filters

    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        start = np.array([rng.randrange(100) for _ in range(n)])
        end = start + np.array([rng.randrange(1, 60) for _ in range(n)])
        weight = np.array([float(rng.randrange(1, 40)) for _ in range(n)])

        def value(chosen):
            total = weight[chosen[0]]
            for j, i in zip(chosen, chosen[1:]):
                if end[j] > start[i] + 5:
                    return -1e9
                total += weight[i] - 0.1 * max(0, start[i] - end[j])
            return total

        order = sorted(range(n), key=lambda i: (end[i], -start[i]))
        best = max(value(list(c)) for k in range(1, n + 1) for c in itertools.combinations(order, k))
        top, picked = filters.best_schedule(start, end, weight, 5, 0.1)
        assert top == pytest.approx(best) and value(picked) == pytest.approx(best)
    assert filters.best_schedule(np.array([]), np.array([]), np.array([])) == (0.0, [])


def test_merge_by_bins_is_merge(spark):
    from strandframe.operators import intervals

    rng = random.Random(6)
    data = [(rng.choice(["a", "b", None]), x := rng.randrange(5000), x + rng.choice([1, 5, 30, 900])) for _ in range(400)] + [("a", 10, 10), ("b", None, 5)]
    df = spark.createDataFrame(data, "chrom string, start long, end long").where("start is not null")
    want = sorted(map(repr, intervals.merge(df, ["chrom"]).select("chrom", "start", "end", "n").collect()))
    for width in (7, 100, 10_000):
        assert sorted(map(repr, intervals.merge_binned(df, ["chrom"], width).select("chrom", "start", "end", "n").collect())) == want


def test_sam_lines_come_back_as_they_were(spark, tmp_path):
    head = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:100", "@RG\tID:g\tSM:s", "@PG\tID:strandframe\tPN:strandframe"]
    lines = ["r1\t16\tchr1\t11\t60\t4=\t=\t31\t24\tACGT\tIIII\tNM:i:3\tSA:Z:x:y", "r2\t0\tchr1\t12\t0\t4=\t*\t0\t0\tACGT\t*", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tXF:f:0.5"]
    (tmp_path / "x.sam").write_text("\n".join(head + lines) + "\n")
    contigs, groups = spark.createDataFrame([("chr1", 100)], "name string, length long"), spark.createDataFrame([("g", "s")], "id string, sample string")
    G.write_sam(G.read_sam(spark, str(tmp_path / "x.sam")), contigs, str(tmp_path / "out"), groups=groups)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert [x for f in files for x in f.read_text().splitlines()] == head + lines
    bare = spark.createDataFrame([("r", None, None, None, None, None, None, None, None)], "read string, flag int, chrom string, start long, mapq int, cigar string, seq string, qual string, tags map<string,string>")
    G.write_sam(bare, contigs, str(tmp_path / "bare"), by_place=False)
    assert any("r\t0\t*\t0\t255\t*\t*\t0\t0\t*\t*" == x for f in (tmp_path / "bare").glob("part-*") for x in f.read_text().splitlines())


def test_fastq_that_is_cut_off_is_an_error(spark, tmp_path):
    for i, text in enumerate(["@a\nAC\n+\nII\n@b\nAC\n", "@a\nAC\n+\nI\n", "a\nAC\n+\nII\n", "@a\nAC\nII\n@b\n"]):
        (tmp_path / f"{i}.fq").write_text(text)
        with pytest.raises(Exception, match="FASTQ"):
            G.read_fastq(spark, str(tmp_path / f"{i}.fq")).collect()
    (tmp_path / "ok.fq").write_bytes("@a\r\nA\x85C\r\n+\r\nIII\r\n@e\r\n\r\n+\r\n\r\n".encode())
    assert [tuple(r) for r in G.read_fastq(spark, str(tmp_path / "ok.fq")).collect()] == [("a", "A\x85C", "III"), ("e", "", "")]


def test_vcf_and_repeat_tables(spark, tmp_path):
    text = '##fileformat=VCFv4.2\n##INFO=<ID=LIBRARY,Number=1,Type=String,Description="Name">\n##contig=<ID=chr1,length=100>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t5\tv\tA\t<DEL>\t.\tPASS\tIMPRECISE;SVLEN=-9\n'
    (tmp_path / "x.vcf").write_text(text)
    contigs = spark.createDataFrame([("chr1", 100)], "name string, length long")
    G.write_vcf(G.read_vcf(spark, str(tmp_path / "x.vcf")), contigs, str(tmp_path / "out"), {"LIBRARY": ("1", "String", "Name")})
    assert "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*"))) == text
    row = ["585", "1504", "13", "4", "13", "chr1", "10000", "10468", "-249240153", "+", "(CCCTAA)n", "Simple_repeat", "Simple_repeat", "1", "463", "-50", "1"]
    (tmp_path / "r.tsv").write_text("#bin\tx\n" + "\t".join(row) + "\n" + "\t".join(["genoName"] * 17) + "\nshort\trow\n")
    (got,) = G.read_repeat_table(spark, str(tmp_path / "r.tsv")).collect()
    assert (got.chrom, got.start, got.end, got.rep_name, got.rep_left) == ("chr1", 10000, 10468, "(CCCTAA)n", -50) and got.coverage == pytest.approx(463 / 513)
    reads = spark.createDataFrame([("a", "AC", "II"), ("b", "G", "I")], "name string, seq string, qual string")
    G.write_per_read(reads, str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").glob("name=*")) == ["name=a", "name=b"]
    assert G.write_debug(reads, None).count() == 2


def test_alignments_made_together_equal_those_made_alone(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [tuple("".join(rng.choice(list("ACGé"), n)) for n in rng.integers(0, 60, 2)) for _ in range(150)]
    alone = [alignment.align(q, t, 2, 3, 4, 1) for q, t in pairs]
    sizes, whole = [], alignment._align_together
    monkeypatch.setattr(alignment, "_align_together", lambda group, *costs: sizes.append(len(group)) or whole(group, *costs))
    assert alignment.align_all([*pairs, *pairs], 2, 3, 4, 1) == [*alone, *alone]
    assert len(sizes) < 10 and sum(sizes) == len({p for p in pairs if all(p)})
    monkeypatch.setattr(alignment, "ABREAST", 100)
    assert alignment.align_all(pairs, 2, 3, 4, 1) == alone


def test_steps_scored_once_lead_to_the_same_chains():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 30, 300):
        start = np.sort(rng.integers(0, 40 * n + 1, n))
        s = {"chrom": rng.integers(0, 2, n), "reverse": rng.random(n) < 0.3, "diagonal": rng.integers(0, 50, n), "read_start": start, "read_end": start + rng.integers(14, 30, n), "entry": start + 7, "exit": start + 30}
        order = np.lexsort((s["read_start"], s["read_end"]))
        s = {k: v[order] for k, v in s.items()}
        config = chaining.ChainConfig()
        known = chaining.with_steps(s, config)
        assert ("step_cost" in known) == (n <= chaining.LOOK)
        for use in (np.arange(n), np.flatnonzero(rng.random(n) < 0.6)):
            assert chaining.best_chain(known, use, config) == chaining.best_chain(s, use, config)
