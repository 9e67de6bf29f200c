"""Extension by x-drop against the full matrix."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandframe.operators import extension, reference

TURN = str.maketrans("ACGT", "TGCA")


def full(q, t, match=1, mismatch=1, open_=6, extend_=2):
    """Best score over all cells of the whole affine matrix."""
    low = -(10**9)
    h = {(0, 0): 0}
    e, f, best = {}, {}, 0
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            if i or j:
                f[i, j] = max(h.get((i - 1, j), low) - open_, f.get((i - 1, j), low) - extend_)
                e[i, j] = max(h.get((i, j - 1), low) - open_, e.get((i, j - 1), low) - extend_)
                d = h[i - 1, j - 1] + (match if q[i - 1] == t[j - 1] else -mismatch) if i and j else low
                h[i, j] = max(d, e[i, j], f[i, j])
                best = max(best, h[i, j])
    return best


def score(ops, q, t):
    """Score of a CIGAR, its bases checked."""
    i = j = total = 0
    for n, op in ops:
        if op in "=X":
            assert all((q[i + k] == t[j + k]) == (op == "=") for k in range(n))
            total += n if op == "=" else -n
        else:
            total -= 6 + 2 * (n - 1)
        i, j = i + n * (op in "=XI"), j + n * (op in "=XD")
    return total, i, j


def mutated(rng, text):
    out = []
    for c in text:
        r = rng.random()
        out.append(rng.choice("ACGT") if r < 0.06 else "" if r < 0.09 else c + "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 9))) if r < 0.12 else c)
    return "".join(out)


def test_extension_equals_the_full_matrix():
    rng = random.Random(1)
    for _ in range(150):
        q = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60)))
        t = mutated(rng, q)[: rng.randrange(0, 70)] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 20)))
        got, n, m, text = extension.extend(q, t)
        ops = [(int(k), op) for k, op in re.findall(r"(\d+)([=XID])", text)]
        assert score(ops, q, t) == (got, n, m) and got == full(q, t), (q, t)
        small = extension.extend(q, t, 8)
        ops = [(int(k), op) for k, op in re.findall(r"(\d+)([=XID])", small[3])]
        assert score(ops, q, t) == small[:3] and small[0] <= got


def test_extension_stops_and_keeps_to_its_band():
    rng = random.Random(2)
    same = "".join(rng.choice("ACGT") for _ in range(3000))
    q, t = same + "".join(rng.choice("ACGT") for _ in range(6000)), same + "".join(rng.choice("ACGT") for _ in range(6000))
    got = extension.extend(q, t, 40)
    assert got[1] >= 3000 and got[1] < 3100 and got[3].startswith("3000=")
    import tracemalloc

    tracemalloc.start()
    extension.extend(same * 2, same * 2, 40)
    assert tracemalloc.get_traced_memory()[1] < 4_000_000  # the whole matrix would be 36 MB
    tracemalloc.stop()
    # a drop of more than x ends it, a larger x goes over it
    assert extension.extend("A" * 20 + "C" * 15 + "A" * 50, "A" * 20 + "G" * 15 + "A" * 50, 10)[1] == 20
    assert extension.extend("A" * 20 + "C" * 15 + "A" * 50, "A" * 20 + "G" * 15 + "A" * 50, 40)[1] == 85


@pytest.mark.parametrize("reverse", [False, True])
def test_ends_of_reads_grow(spark, reverse):
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(1000))
    piece = ref[300:600]
    seq = piece[::-1].translate(TURN) if reverse else piece
    a, b = (100, 150) if not reverse else (150, 200)
    parts = spark.createDataFrame([("r", 0, "c", reverse, a, b, 400, 450), ("lost", 0, "c", reverse, 5, 9, 1, 5), ("none", 0, "x", reverse, 10, 20, 10, 20)], "read string, part int, chrom string, reverse boolean, read_start long, read_end long, ref_start long, ref_end long")
    reads = spark.createDataFrame([("r", seq), ("none", "ACGT" * 10)], "read string, seq string")
    held = reference.blocks(spark.createDataFrame([("c", ref)], "name string, seq string"), 64)
    got = {r.read: r for r in extension.extend_ends(parts, reads, held, width=64).collect()}
    r = got["r"]
    assert (r.read_start, r.read_end, r.ref_start, r.ref_end, r.left_cigar, r.right_cigar) == (0, 300, 300, 600, "100=", "150=")
    assert (got["lost"].read_start, got["lost"].left_cigar) == (5, "") and (got["none"].read_end, got["none"].right_cigar) == (20, "")


@pytest.mark.parametrize("x", [1, 5, 30, 400])
def test_pairs_extended_together_are_as_alone(spark, x):
    rng = random.Random(x)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [("", ""), ("", "A"), ("A", ""), ("é\U0001f600A", "é\U0001f600C")]
    for n in (1, 3, 20, 60, 200) * 8:
        a = word(n)
        cut = rng.randrange(n)
        pairs += [(a, a[:cut] + word(rng.randrange(4)) + a[cut:]), (a, a[:cut] + a[cut + 3:]), (a, word(50)), (word(n // 2), a)]
    alone = [extension.extend(*p, x) for p in pairs]
    assert extension.extend_all(*zip(*pairs), x) == alone
    rows = spark.createDataFrame([*enumerate(pairs), (-1, (None, "A")), (-2, ("A", None))], "i long, p struct<q: string, t: string>").coalesce(1)
    got = {r.i: r.e and tuple(r.e) for r in rows.select("i", extension.xdrop(F.col("p.q"), F.col("p.t"), x).alias("e")).collect()}
    assert got.pop(-1) in (None, (None,) * 4) and got.pop(-2) in (None, (None,) * 4)
    assert got == dict(enumerate(alone))
