"""Conversation repair, whitening and chat formatting against brute force, numpy and exact round trips."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import chat_format, conversation_repair, embedding_whitening
from strandframe.llm.conversation_repair import ASSISTANT, LETTERS, START, Machine, compose
from strandframe.session import table

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def cheapest(kinds: bytes) -> tuple[int, str]:
    """By trying every list of edits: up to two inserts before each turn and at the end."""
    best = None
    for runs in itertools.product(range(3), repeat=len(kinds) + 1):
        for edits in itertools.product("DKR", repeat=len(kinds)):
            outs, cost = [""], 0
            for run, edit, kind in zip(runs, [*edits, None], [*kinds, None]):
                cost += 2 * run
                outs = [o + "".join(x) for o in outs for x in itertools.product("ua", repeat=run)]
                if edit == "D":
                    cost += 3
                elif edit is not None:
                    if kind % 3 == 2:
                        break
                    cost += (kind % 3 == 1) + 2 * (edit == "R")
                    outs = [o + x for o in outs for x in ("ua" if edit == "R" else LETTERS[kind // 3])]
            else:
                if any(o == "" or (o.removeprefix("s") and o.removeprefix("s") == "ua" * (len(o.removeprefix("s")) // 2)) for o in outs):
                    audit = "".join("I" * run + edit for run, edit in zip(runs, [*edits, ""]))
                    best = min(best or (cost, audit), (cost, audit))
    return best


def machine_edits(kinds: bytes, cuts: list[int]) -> tuple[int, str]:
    m = Machine()
    stretches = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)])]
    cost, ways, run = compose([m.condense(k) for k in stretches])
    return cost, "".join("I" * n + edit for k, way in zip(stretches, ways) for _, n, edit in m.trace(k, *way)) + "I" * run


def test_op11_edits_equal_all_lists_of_edits():
    rng = random.Random(3)
    some = [bytes(k) for n in range(3) for k in itertools.product(range(12), repeat=n)] + [bytes(rng.randrange(12) for _ in range(3)) for _ in range(40)]
    for kinds in some:
        assert machine_edits(kinds, []) == cheapest(kinds), kinds


def by_texts(kinds: bytes) -> tuple[int, str]:
    """The same program with the audit texts themselves instead of ranks."""
    rows = {START: (0, "")}
    for kind in kinds:
        new: dict[int, tuple[int, str]] = {}
        for s, (c, text) in rows.items():
            for t, cost, code, _ in conversation_repair._moves(s, LETTERS[kind // 3], kind % 3):
                new[t] = min(new.get(t, (1 << 60, "")), (c + cost, text + code))
        rows = new
    return min((c + 2 * n, text + "I" * n) for s, (c, text) in rows.items() for n in range(3) if conversation_repair._inserted(s, n) in (START, ASSISTANT))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_op11_stretches_compose(kinds, cuts):
    kinds = bytes(kinds)
    want = by_texts(kinds)
    assert machine_edits(kinds, []) == want
    assert machine_edits(kinds, sorted(min(c, len(kinds)) for c in cuts)) == want


def test_op11_layers_are_few():
    m, rng = Machine(), random.Random(1)
    for _ in range(40):
        m.condense(bytes(rng.randrange(12) for _ in range(500)))
    assert len(m.layers) < 3000


def plain_report(rows: list[tuple]) -> dict:
    """conv -> report, row by row, with texts for ranks."""
    some = lambda x: " " if x is None else str(x)
    convs: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text, d = some(role), some(text), zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        if d:
            text = "" if d == 1 else text.translate(str.maketrans("", "", ".!?")) if d == 2 else text
            convs[conv] += [(turn is not None, turn or 0, "user" if d == 4 else role, hashlib.sha256(text.encode()).digest(), text, turn)] * (2 if d == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        seen, faults = set(), []
        for _, _, role, _, text, _ in turns:
            end = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        letters = [t[2][:1] for t in turns]
        kinds = bytes((LETTERS.index(x) if x and x in "sua" else 3) * 3 + {"": 0, "truncated": 1}.get(f, 2) for x, f in zip(letters, faults))
        cost, audit = by_texts(kinds)
        lines, at, expect = [], 0, "u"
        for edit in audit:
            if edit == "I":
                lines.append({"u": "user:", "a": "assistant:"}[expect])
            else:
                role, text = turns[at][2], turns[at][4]
                at += 1
                if edit == "D":
                    continue
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[expect]}:{text}")
                if edit == "K" and role[0] == "s":
                    continue
            expect = "ua"[expect == "u"]
        known = [t[5] for t in turns if t[5] is not None]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def reported(df) -> dict:
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def odd_turns(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", None, " \t\n", "ends. \n", "Ünïcode!", "?", " ", "line\nline"]
    roles = ["system", "user", "assistant", None, "", "tool", "u", "ärger"]
    rows = [(rng.choice([1, 2, 3, None, -5]), rng.choice([None, 0, 1, 2, 3, 7, 40]), rng.choice(roles), rng.choice(texts)) for _ in range(90)]
    rows += [(77, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(300)] + [(9, 1, "user", "x" * 200_000 + ".")] + rows[:20]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op11_odd_rows(spark, seed):
    rows = odd_turns(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", digest string")
    assert reported(conversation_repair.report(conversation_repair.damage(df), df)) == plain_report(rows)


def test_op11_conversations(spark):
    df = table(spark, DATA, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert reported(conversation_repair.report(conversation_repair.damage(df), df)) == plain_report(rows)
    none = df.limit(0)
    assert conversation_repair.report(conversation_repair.damage(none), none).count() == 0


def test_op11_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "system", "Be kind."), (1, 2, "user", "A"), (1, 3, "assistant", "B.")], TURNS)
    rows, marked = conversation_repair.diagnose(df)
    edits, _ = conversation_repair.plan(marked)
    got = [(r.position, r.role, r.text) for r in conversation_repair.repaired(rows, edits).collect()]
    assert got == [(0, "system", "Be kind."), (1, "user", "A"), (2, "assistant", "B.")]


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<double>, whitened double")


def plain_whitening(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    total, n = x.sum(axis=0), len(x)
    d = (n * x - total)
    v = np.array((d.T.dot(d)) / n**3, dtype=float)
    values, axes = np.linalg.eigh(v)
    return values[::-1], (np.array(d / n, dtype=float) @ axes[:, ::-1]) / np.sqrt(np.maximum(values[::-1], 1e-30)), (d**2).sum(axis=1).tolist()


def test_op12_against_exact_numbers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=40) * np.linspace(1, 9, 40) + 50).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600, rows[0][1]), (600, rows[0][1])]
    got = embedding_whitening.whiten(embeddings(spark, rows).repartition(7)).toPandas().sort_values(["vec_id", "component"])
    values, y, deviations = plain_whitening(rows)
    assert len(got) == 602 * 32 and set(got.n) == {602} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert np.allclose(got.explained.to_numpy()[:32], (values / values.sum())[:32], rtol=1e-9)
    first = got.drop_duplicates(["vec_id", "component"]).whitened.to_numpy().reshape(601, 32)
    sign = np.sign((first * y[:601, :32]).sum(axis=0))
    assert np.allclose(first * sign, y[:601, :32], atol=1e-8)
    assert got.drop_duplicates("vec_id").deviation.tolist() == deviations[:601]


def test_op12_merging_keeps_precision():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, size=(3000, 5)) + 10**9
    parts = [embedding_whitening.Moments.of(p) for p in np.array_split(x, 37)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    d = (x - x.mean(axis=0)).astype(float)
    assert whole.total.tolist() == x.sum(axis=0).tolist() and np.allclose(whole.scatter, d.T @ d, rtol=1e-10)


def test_op12_odd_vectors(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 1.0]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0]), (104, [])]
    got = embedding_whitening.whiten(embeddings(spark, [*good, *bad, (None, [0.0, 0.0, 1.0]), (200, [5.0, 5.0]), (201, [1e12, 0.0])])).toPandas()
    assert set(got.vec_id.dropna()) == {*range(30), 200, 201} and got.vec_id.isna().sum() == 3
    three = got[got.n == 31]
    assert three[three.component == 3].whitened.isna().all() and three[three.component < 3].whitened.notna().all()  # the last entry is the same everywhere
    assert got.identity_error.max() < 1e-9
    alone = embedding_whitening.whiten(embeddings(spark, [(1, [1.0, 2.0])])).toPandas()
    assert alone.deviation.tolist() == [0, 0] and alone.whitened.isna().all() and alone.explained.isna().all() and alone.identity_error.isna().all()
    assert embedding_whitening.whiten(embeddings(spark, [])).count() == 0
    assert embedding_whitening.whiten(embeddings(spark, bad)).count() == 0


tricky = st.text(alphabet=st.sampled_from(list("<>[]/\\sINTROLEUY ü€😀\n")), max_size=30)
pieces = st.lists(st.one_of(tricky, st.sampled_from([*chat_format.CONTROL, "\\", "\\\\"])), max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), pieces), pieces), min_size=1, max_size=6))
def test_op13_assembly_reads_back(turns):
    out, bounds, texts = chat_format.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    whole = out.tobytes().decode()
    assert [(r, t) for r, t, _, _ in chat_format.turns_of(whole)] == turns
    for i, (_, text) in enumerate(turns):
        assert chat_format.unescape(out[texts[i, 0] : texts[i, 1]].tobytes().decode()) == text
        assert chat_format.turns_of(out[bounds[i] : bounds[i + 1]].tobytes().decode())[0][1] == text


def test_op13_slices_of_the_gather(monkeypatch):
    monkeypatch.setattr(chat_format, "SLICE", 50)
    turns = [("user", "x" * n) for n in (0, 3, 200, 49, 50, 51, 1)] + [("tool", "y" * 70)]
    out, _, _ = chat_format.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    assert [(r, t) for r, t, _, _ in chat_format.turns_of(out.tobytes().decode())] == turns


def plain_format(rows: list[tuple]) -> dict:
    convs: dict = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", chat_format.SAMPLE), (-1, 1, "assistant", chat_format.SAMPLE)]:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[:3])
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def read(df) -> dict:
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_op13_conversations(spark):
    df = table(spark, DATA, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert read(chat_format.round_trip(df)) == plain_format(rows)
    assert set(read(chat_format.round_trip(df.limit(0)))) == {-1}


@pytest.mark.parametrize("most", [4096, 7])
def test_op13_long_conversations_and_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(chat_format, "LONG_TURNS", most)
    rows = [(5, i, ("user", "assistant", "tool")[i % 3], f"<s>{i} \\ [INST]€") for i in range(500)] + [(None, None, None, None), (None, 3, "assistant", "x"), (6, 1, "assistant", "y" * 300_000), (7, 2, "assistant", ""), (8, 1, "", "</s>")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS + ", part string, c int").repartition(5)
    assert read(chat_format.round_trip(df)) == plain_format(rows)
    whole, parts = chat_format.chat_format(df)
    assert whole.groupBy("conv_id").count().where("count > 1").count() == 0 and (parts.where("conv_id = 5").count() > 0) == (most == 7)
