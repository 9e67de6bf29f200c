"""Gap scores of the bits-scored chaining, tandem copies and the kinds of steps."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import alignment, chaining, gap_scores, reference

C = chaining.ChainConfig()


def seeds_of(rows):
    """Seeds ``(read start, length, reference start, chromosome, reverse)`` in the order of a read's seeds."""
    out = []
    for q, n, r, chrom, rev in rows:
        out.append((chrom, rev, r + q + n if rev else r - q, q, q + n, r + n if rev else r, r if rev else r + n))
    out.sort(key=lambda s: (s[4], s[3], s[0], s[1], s[2]))
    names = ("chrom", "reverse", "diagonal", "read_start", "read_end", "entry", "exit")
    return {k: np.array([s[i] for s in out]) for i, k in enumerate(names)}


def pairs_by_definition(s, c):
    """All pairs looked at one by one: the nearest three seeds before each that a gap may be aligned from."""
    out = []
    for i in range(len(s["chrom"])):
        near = []
        for j in reversed(range(i)):
            on_read = s["read_start"][i] - s["read_end"][j]
            on_ref = s["exit"][j] - s["entry"][i] if s["reverse"][i] else s["entry"][i] - s["exit"][j]
            if s["chrom"][i] == s["chrom"][j] and s["reverse"][i] == s["reverse"][j] and 20 <= on_read <= 2000 and 0 <= on_ref <= 2000 and len(near) < 3:
                near.append(j)
        out += [(i, j) for j in sorted(near)]
    return out


def random_seeds(rng, n, width=400):
    return seeds_of([(rng.randrange(width), rng.randrange(14, 60), rng.randrange(3 * width), rng.randrange(2), rng.random() < 0.4) for _ in range(n)])


def test_candidates_by_definition():
    rng = random.Random(3)
    found = 0
    for _ in range(60):
        s = random_seeds(rng, rng.randrange(0, 30))
        got = [(g[0], g[1]) for g in gap_scores.nearest_before(s, C)]
        assert got == pairs_by_definition(s, C)
        found += len(got)
    assert found > 300


def value(s, chain, gaps):
    """The score of a chain by the rule, each step the better of its move and its gap's bits; None if a step is not one."""
    total = C.match_bits * (s["read_end"][chain[0]] - s["read_start"][chain[0]])
    for j, i in zip(chain, chain[1:]):
        if s["read_end"][j] >= s["read_end"][i]:
            return None
        shift, gap = abs(s["diagonal"][i] - s["diagonal"][j]), s["read_start"][i] - s["read_end"][j]
        if s["chrom"][i] != s["chrom"][j]:
            cost = 35 + 31.5
        elif s["reverse"][i] != s["reverse"][j]:
            cost = 36 + np.log2(1 + abs(s["entry"][i] - s["exit"][j]))
        else:
            cost = min(6 + shift if shift else 8 if gap > 0 else 0, 35 + np.log2(1 + shift))
        step = 2 * (s["read_end"][i] - max(s["read_start"][i], s["read_end"][j])) - cost
        if (i, j) in gaps:
            step = max(step, 2 * (s["read_end"][i] - s["read_start"][i]) + gaps[i, j])
        total += step
    return total


def with_gaps(s, gaps):
    n = len(s["chrom"])
    s = dict(s, gap_from=np.full((n, 3), -1), gap_bits=np.zeros((n, 3)))
    for i in range(n):
        for k, j in enumerate(sorted((j for a, j in gaps if a == i), reverse=True)):
            s["gap_from"][i, k], s["gap_bits"][i, k] = j, gaps[i, j]
    return s


@pytest.mark.parametrize("look", [1, 3, 256])
def test_best_chain_with_gaps_against_all_chains(monkeypatch, look):
    monkeypatch.setattr(chaining, "LOOK", look)
    rng = random.Random(look)
    used = 0
    for _ in range(60):
        s = random_seeds(rng, 7)
        n = len(s["chrom"])
        gaps = {p: rng.randrange(-60, 200) for p in pairs_by_definition(s, C)}
        use = np.array(sorted(rng.sample(range(n), rng.randrange(1, n + 1))))
        best = max(v for k in range(1, len(use) + 1) for c in itertools.combinations(use, k) if (v := value(s, c, gaps)) is not None)
        score, chain = chaining.best_chain(with_gaps(s, gaps), use, C)
        assert score == pytest.approx(best) and value(s, chain, gaps) == pytest.approx(best)
        assert set(chain) <= set(use)
        used += any((i, j) in gaps for j, i in zip(chain, chain[1:]))
    assert used > 5


def test_look_back_stops_without_a_change():
    rng = random.Random(5)
    s = random_seeds(rng, 600, 6000)
    use = np.arange(600)
    whole = chaining.best_chain(s, use, C)
    chaining.LOOK, kept = 7, chaining.LOOK
    try:
        assert chaining.best_chain(s, use, C) == whole
    finally:
        chaining.LOOK = kept


def test_kinds_of_steps():
    def kind(a, b, bridge=120):
        s = seeds_of([a, b])
        return chaining.KINDS[chaining.step_kind(s, 0, 1, bridge)]

    one = (0, 50, 1000, 0, False)
    assert kind(one, (60, 50, 1060, 0, False)) == "continuation"
    assert kind(one, (60, 50, 1060, 1, False)) == kind(one, (60, 50, 1060, 0, True)) == "break"
    assert kind(one, (170, 50, 1170, 0, False)) == "continuation" and kind(one, (171, 50, 1171, 0, False)) == "break"
    assert kind(one, (50, 50, 1170, 0, False)) == "continuation" and kind(one, (50, 50, 1171, 0, False)) == "break"
    assert kind(one, (50, 50, 1000, 0, False)) == "continuation" and kind(one, (50, 50, 999, 0, False)) == "repeat"
    assert kind((0, 50, 1000, 0, True), (60, 50, 940, 0, True)) == "continuation"
    assert kind((0, 50, 1000, 0, True), (50, 50, 1001, 0, True)) == "repeat"


def test_tandem_copies_are_inlined_only_between_seeds_that_continue():
    copies = [(0, 100, 1000, 0, False), (100, 40, 1060, 0, False), (140, 40, 1060, 0, False)]
    s = seeds_of([*copies, (180, 100, 1100, 0, False)])
    assert chaining.inline_copies(s, [0, 1, 2, 3], 120) == [0, 3]
    s = seeds_of(copies)
    assert chaining.inline_copies(s, [0, 1, 2], 120) == [0, 1, 2]  # nothing after the run
    s = seeds_of([*copies, (180, 100, 9000, 0, False)])
    assert chaining.inline_copies(s, [0, 1, 2, 3], 120) == [0, 1, 2, 3]  # the flanks do not continue
    s = seeds_of([(0, 100, 1000, 0, False), (100, 40, 800, 0, False), (140, 100, 1100, 0, False)])
    assert chaining.inline_copies(s, [0, 1, 2], 120) == [0, 1, 2]  # too far back
    s = seeds_of([(0, 100, 1000, 0, True), (100, 40, 1000, 0, True), (140, 100, 900, 0, True)])
    assert chaining.inline_copies(s, [0, 1, 2], 120) == [0, 2]
    assert chaining.inline_copies(s, [], 120) == []


def revcomp(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bits_of(cigar):
    price = {"=": lambda n: 2 * n, "X": lambda n: -8 * n, "I": lambda n: -6 - n, "D": lambda n: -6 - n}
    return sum(price[op](int(n)) for n, op in re.findall(r"(\d+)([=XID])", cigar))


COLUMNS = "read_id string, chrom long, reverse boolean, diagonal long, read_start long, read_end long, entry long, exit long"


def frame(spark, reads):
    rows = [(read, *(v.item() for v in values)) for read, s in reads.items() for values in zip(*(s[k] for k in ("chrom", "reverse", "diagonal", "read_start", "read_end", "entry", "exit")))]
    return spark.createDataFrame(rows, COLUMNS)


def test_scored_gaps_and_explanations_from_bases(spark):
    rng = random.Random(11)
    contigs = {c: "".join(rng.choices("ACGT", k=1500)) for c in (0, 1)}
    seeds, texts = {}, {}
    for n in range(25):
        s = random_seeds(rng, rng.randrange(2, 9))
        seeds[f"r{n}"], texts[f"r{n}"] = s, "".join(rng.choices("ACGT", k=600))
    # seeds that flank a gap with a difference every ten bases, which only its alignment credits
    for name, reverse in (("gapped", False), ("turned", True)):
        bases = list(contigs[0][100:400])
        for p in range(65, 235, 10):
            bases[p] = "ACGT"[("ACGT".index(bases[p]) + 1) % 4]
        text = "".join(bases)
        texts[name] = revcomp(text) if reverse else text
        seeds[name] = seeds_of([(0, 60, 340, 0, True), (240, 60, 100, 0, True)] if reverse else [(0, 60, 100, 0, False), (240, 60, 340, 0, False)])
    df = frame(spark, seeds)
    gaps = gap_scores.candidates(df)
    reads = spark.createDataFrame(list(texts.items()), "read_id string, seq string")
    blocks = reference.blocks(spark.createDataFrame(list(contigs.items()), "name long, seq string"), 64)
    scored = gap_scores.scored(gaps, reads, blocks, width=64)
    got = {(r.read_id, r.seed, r.before): (r.bits, r.cigar) for r in scored.collect()}
    want = {}
    for name, s in seeds.items():
        for i, j in pairs_by_definition(s, C):
            piece = texts[name][s["read_end"][j] : s["read_start"][i]]
            low, high = sorted((s["exit"][j], s["entry"][i]))
            _, text = alignment.align(revcomp(piece) if s["reverse"][i] else piece, contigs[int(s["chrom"][i])][low:high])
            want[name, i, j] = (bits_of(text), text)
    assert got == want and len(want) > 30 and got["gapped", 1, 0][0] > 100

    plain = {r.read: r for r in chaining.explain_reads(df).where("part = 0").collect()}
    for r in chaining.explain_reads(df, gaps=scored).where("part = 0").collect():
        s = with_gaps(seeds[r.read], {(i, j): b for (name, i, j), (b, _) in want.items() if name == r.read})
        score, _ = chaining.explain(s, np.ones(len(s["chrom"]), bool), C)
        assert r.score == pytest.approx(score) and r.score >= plain[r.read].score - 1e-9
        if r.read in ("gapped", "turned"):
            assert r.score == pytest.approx(240 + got[r.read, 1, 0][0]) and r.score > plain[r.read].score + 100


def test_gaps_of_nulls_empty_tables_and_missing_sequences(spark):
    s = seeds_of([(0, 60, 100, 0, False), (100, 60, 200, 0, False)])
    df = frame(spark, {"a": s, "b": s})
    df = df.unionByName(df.where("read_id = 'a'").withColumn("read_id", F.lit(None).cast("string")))
    gaps = gap_scores.candidates(df)
    assert {(r.read_id, r.seed, r.before) for r in gaps.collect()} == {("a", 1, 0), ("b", 1, 0), (None, 1, 0)}
    blocks = reference.blocks(spark.createDataFrame([(0, "A" * 500)], "name long, seq string"), 64)
    reads = spark.createDataFrame([("a", "A" * 200), ("b", None), (None, "A" * 200)], "read_id string, seq string")
    scored = gap_scores.scored(gaps, reads, blocks, width=64).collect()
    assert [(r.read_id, r.bits, r.cigar) for r in scored] == [("a", 80.0, "40=")]
    assert gap_scores.scored(gaps, reads, blocks.where("false"), width=64).count() == 0
    none = frame(spark, {"a": s}).where("false")
    assert gap_scores.candidates(none).count() == 0 and chaining.explain_reads(none, gaps=gap_scores.scored(gaps, reads, blocks, width=64).where("false")).count() == 0
    same = chaining.explain_reads(df, gaps=gap_scores.scored(gap_scores.candidates(df), reads, blocks, width=64))
    assert {r.read: r.score for r in same.collect()} == {"a": 320.0, "b": 232.0, None: 232.0}
