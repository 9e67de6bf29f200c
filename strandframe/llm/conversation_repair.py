"""Conversation structure repair (operator 11): faults of turns, and the cheapest edits that mend their order.

A conversation is sound when the first letters of its roles read ``(s?(ua)+)?``. Each turn is kept, reroled
or deleted, and runs of empty turns may be inserted before it or at the end. The edits of one turn are one
macro, ``I...IX``: such codes are prefix-free, so comparing two equally long lists of macros compares their
texts. The program goes turn by turn over four states; a layer holds for each state the cost and the *rank*
of its audit text among the layer's texts, never the text, and a pointer to the state before. Costs lie
within a few units of the layer's least and ranks are dense, so there are few different layers: they are
made once, as a machine whose steps are looked up.

A layer may start from all four states at once. So a stretch of a conversation is a small table from states
to states, tables of neighbouring stretches compose, and a conversation with a third of all rows is spread:
rows are dealt out by range, each task condenses its stretches, the tables of a conversation (one for each
task at the most) are composed, and every stretch then writes its own edits between the states found.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, prepare

KEEP, REROLE, DELETE, INSERT, UNSURE = 0, 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user, after an assistant. The last and the first may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
#: By state, the letter -> the state after it.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
#: More inserts in a row never help: two make a pair, and a third could start in its place.
RUN = 2
#: A state this much dearer than the least of its layer is never on a cheapest path: any other state reaches the same turns for 5 more.
SLACK = 5
#: Classes of a turn: letter (s, u, a, other) times fault (none, truncated, to be deleted).
LETTERS, FREE, TRUNCATED, DOOMED = "sua-", 0, 1, 2
WHITE = " \t\n\v\f\r"

Layer = tuple[tuple[tuple[int, int] | None, ...], ...]  # by entry state, by state: cost, rank
Came = tuple[int, int, str]  # state before, inserts, edit


def _inserted(state: int, run: int) -> int | None:
    """The state after ``run`` inserts, which the order of roles determines."""
    for _ in range(run):
        state = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}[state]
    return state


def _moves(state: int, letter: str, fault: int) -> Iterator[tuple[int, int, str, str]]:
    """``state after, cost, code, edit`` of every macro."""
    for run in range(RUN + 1):
        at, paid = _inserted(state, run), run * INSERT
        yield at, paid + DELETE, "I" * run + "D", "D"
        if fault == DOOMED:
            continue
        more = UNSURE if fault == TRUNCATED else 0
        if letter in NEXT[at]:
            yield NEXT[at][letter], paid + KEEP + more, "I" * run + "K", "K"
        for to in NEXT[at]:
            if to in ROLES:
                yield NEXT[at][to], paid + REROLE + more, "I" * run + "R", "R"


#: The identity: each state reaches itself for nothing.
IDENTITY: Layer = tuple(tuple((0, 0) if s == t else None for t in STATES) for s in STATES)


def _ranked(found: dict[tuple[int, int], tuple[int, object]]) -> tuple[int, Layer]:
    """Costs less the least of all, texts as dense ranks; hopeless states go."""
    least = min(c for c, _ in found.values())
    floor = {s: min(c for (e, _), (c, _) in found.items() if e == s) for s, _ in found}
    alive = {k: v for k, v in found.items() if v[0] <= floor[k[0]] + SLACK}
    order = {text: i for i, text in enumerate(sorted({text for _, text in alive.values()}))}
    return least, tuple(tuple((alive[s, t][0] - least, order[alive[s, t][1]]) if (s, t) in alive else None for t in STATES) for s in STATES)


class Machine:
    """Layers by number, and what a class of turn makes of each; both are made when first met."""

    def __init__(self) -> None:
        self.layers: list[Layer] = []
        self.numbers: dict[Layer, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, dict[tuple[int, int], Came]]] = {}

    def number(self, layer: Layer) -> int:
        if layer not in self.numbers:
            self.numbers[layer] = len(self.layers)
            self.layers.append(layer)
        return self.numbers[layer]

    def step(self, layer: int, kind: int) -> tuple[int, int, dict[tuple[int, int], Came]]:
        """``layer after, cost to add, pointers`` by entry and state."""
        if (layer, kind) not in self.steps:
            found: dict[tuple[int, int], tuple[int, object]] = {}
            came: dict[tuple[int, int], Came] = {}
            for s, row in enumerate(self.layers[layer]):
                for m, held in enumerate(row):
                    for t, cost, code, edit in _moves(m, LETTERS[kind // 3], kind % 3) if held else ():
                        new = (held[0] + cost, (held[1], code))
                        if (s, t) not in found or new < found[s, t]:
                            found[s, t], came[s, t] = new, (m, len(code) - 1, edit)
            least, after = _ranked(found)
            self.steps[layer, kind] = self.number(after), least, came
        return self.steps[layer, kind]

    def condense(self, kinds: bytes) -> tuple[int, Layer]:
        """``cost, table`` of a stretch of turns."""
        layer, cost = self.number(IDENTITY), 0
        for kind in kinds:
            layer, more, _ = self.step(layer, kind)
            cost += more
        return cost, self.layers[layer]

    def trace(self, kinds: bytes, entry: int, end: int) -> list[Came]:
        """The macros of a stretch on the way from state ``entry`` to ``end``."""
        layer, pointers = self.number(IDENTITY), []
        for kind in kinds:
            layer, _, came = self.step(layer, kind)
            pointers.append(came)
        macros, at = [], end
        for came in reversed(pointers):
            macros.append(came[entry, at])
            at = macros[-1][0]
        return macros[::-1]


def compose(tables: list[tuple[int, Layer]]) -> tuple[int, list[tuple[int, int]], int]:
    """``cost, (entry, end) of each stretch, inserts at the end`` of a conversation's cheapest, ASCII-least edits."""
    base, row = 0, {START: (0, 0)}
    backs: list[dict[int, int]] = []
    for more, table in tables:
        found: dict[int, tuple[int, object]] = {}
        back: dict[int, int] = {}
        for s, (cost, rank) in row.items():
            for t, held in enumerate(table[s]):
                if held and (t not in found or (cost + held[0], (rank, held[1])) < found[t]):
                    found[t], back[t] = (cost + held[0], (rank, held[1])), s
        order = {text: i for i, text in enumerate(sorted({text for _, text in found.values()}))}
        row = {t: (c, order[text]) for t, (c, text) in found.items()}
        base += more
        backs.append(back)
    cost, _, run, at = min((c + run * INSERT, (rank, "I" * run), run, t) for t, (c, rank) in row.items() for run in range(RUN + 1) if _inserted(t, run) in ENDS)
    ways = []
    for back in reversed(backs):
        ways.append((back[at], at))
        at = back[at]
    return base + cost, ways[::-1], run


@functools.cache
def machine() -> Machine:
    """The machine of this worker."""
    return Machine()


def _pack(cost: int, table: Layer) -> bytes:
    return struct.pack("<q32b", cost, *(x for row in table for held in row for x in (held or (-1, 0))))


def _unpack(data: bytes) -> tuple[int, Layer]:
    cost, *x = struct.unpack("<q32b", data)
    held = [(x[i], x[i + 1]) if x[i] >= 0 else None for i in range(0, 32, 2)]
    return cost, tuple(tuple(held[4 * s : 4 * s + 4]) for s in STATES)


def damage(conversations: DataFrame) -> DataFrame:
    """The test damage of ``conversations (conv_id, turn, role, text)`` by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats
    it, 4 makes its role user. A null counts as one space in every column; ids and turns stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c")
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("_c")


def _key(conv: str) -> Column:
    """A conversation as text: null is a conversation too, equal to itself."""
    return F.coalesce(F.concat(F.lit("i"), F.col(conv).cast("string")), F.lit("n"))


#: The order of a conversation's rows: by turn, nulls first; equal turns by role and digest of the text, and equal rows stay beside each other.
ORDER = ["c", "turn", "role", "digest", "id"]


def diagnose(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows, marked`` of ``turns (conv_id, turn, role, text)``, both written to the shared folder.

    ``rows``: ``c, conv_id, turn, role, text, digest, id``; ``marked``: the same with ``fault`` for the text, the
    first that holds of ``blank``, ``duplicate`` (a row before it has the same role and text), ``truncated``, or
    null. Null roles and texts count as one space. The first row of a role and text is found by a minimum, so
    a text repeated in a third of the rows is not one task's; ids of the input's rows tell equal rows apart.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(_key("conv_id").alias("c"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"))
    rows = materialize(rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "id": F.monotonically_increasing_id()}), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")
    first = rows.groupBy("c", "role", "digest").agg(F.min(place).alias("p")).select(F.col("p.id").alias("id"), F.lit(True).alias("first"))
    end = F.rtrim("text", F.lit(WHITE))
    marks = rows.select("id", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), "c", "conv_id", "turn", "role", "digest")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    marked = materialize(marks.join(first, "id", "left").select("c", "conv_id", "turn", "role", "digest", "id", fault.alias("fault")), "faults")
    return rows, marked


def plan(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edits, totals`` of rows with faults, as ``diagnose`` marks them.

    ``edits``: ORDER's columns with ``edit`` (K, R, D), ``role_after`` (null if deleted) and ``before``, the
    roles' letters of the turns inserted before; a row without a turn's id carries those at the end.
    ``totals``: ``c, cost, illegal, audit``. A task holds one stretch: the rows of a conversation in one
    range partition.
    """
    letter = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("-")
    kind = (F.instr(F.lit(LETTERS), letter) - 1) * 3 + F.when(F.col("fault").isin("blank", "duplicate"), DOOMED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(FREE)
    ranged = marked.withColumn("kind", kind.cast("byte")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("at", F.monotonically_increasing_id())
    one = F.struct("at", "kind", "turn", "role", "digest", "id")
    stretches = ranged.groupBy("c", F.shiftright("at", 33).alias("part")).agg(F.array_sort(F.collect_list(one)).alias("rows"))

    @F.pandas_udf("binary")
    def condensed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: _pack(*machine().condense(bytes(x))))

    stretches = materialize(stretches.select("c", "part", "rows", condensed(F.col("rows.kind")).alias("packed")), "stretches")
    step = F.struct("part", "packed", F.element_at("rows.kind", 1).alias("first"), F.element_at("rows.kind", -1).alias("last"))
    gathered = stretches.groupBy("c").agg(F.array_sort(F.collect_list(step)).alias("parts"))
    ways = "cost long, run int, ways array<struct<part:long,entry:int,leave:int>>"

    @F.pandas_udf(ways)
    def composed(parts: pd.Series, packed: pd.Series) -> pd.DataFrame:
        out = []
        for names, tables in zip(parts, packed):
            cost, way, run = compose([_unpack(b) for b in tables])
            out.append((cost, run, [{"part": int(p), "entry": e, "leave": x} for p, (e, x) in zip(names, way)]))
        return pd.DataFrame(out, columns=["cost", "run", "ways"])

    solved = materialize(gathered.select("c", composed(F.col("parts.part"), F.col("parts.packed")).alias("w")).select("c", "w.*"), "ways")
    states = solved.select("c", F.explode("ways").alias("w")).select("c", "w.*")

    @F.pandas_udf("audit string, macros array<struct<edit:string,role:string,before:string>>")
    def traced(kinds: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.DataFrame:
        out = []
        for k, e, x in zip(kinds, entry, leave):
            macros = machine().trace(bytes(k), e, x)
            done = []
            for at, run, edit in macros:
                letters = "".join("a" if (at == USER) ^ (i % 2 == 1) else "u" for i in range(run))
                to = "a" if _inserted(at, run) == USER else "u"
                done.append({"edit": edit, "role": ROLES[to] if edit == "R" else None, "before": letters})
            out.append(("".join("I" * run + edit for _, run, edit in macros), done))
        return pd.DataFrame(out, columns=["audit", "macros"])

    written = materialize(stretches.join(states, ["c", "part"]).select("c", "part", "rows", traced(F.col("rows.kind"), "entry", "leave").alias("t")), "edits")
    both = written.select("c", F.explode(F.arrays_zip(F.col("rows"), F.col("t.macros").alias("macros"))).alias("r"))
    field = lambda a, b: F.col(f"r.{a}.{b}").alias(b)
    kept = F.when(F.col("r.macros.edit") == "D", None).otherwise(F.coalesce("r.macros.role", "r.rows.role"))
    edits = both.select("c", *(field("rows", n) for n in ORDER[1:]), field("macros", "edit"), kept.alias("role_after"), field("macros", "before"), F.lit(False).alias("tail"))
    # at the end of a conversation an odd insert can only be an assistant; two are a pair
    tail = solved.where("run > 0").select("c", *(F.lit(None).cast(t).alias(n) for n, t in edits.dtypes[1:7]), F.when(F.col("run") == 1, "a").otherwise("ua").alias("before"), F.lit(True).alias("tail"))
    lost = lambda a, b: ~F.concat(*(F.substring(F.lit(LETTERS), (F.floor(x / 3) + 1).cast("int"), F.lit(1)) for x in (a, b))).isin("su", "ua", "au")
    inside = F.aggregate("rows", F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("n")), lambda s, r: F.struct(r["kind"].cast("int").alias("k"), (s["n"] + F.when((s["k"] >= 0) & lost(s["k"], r["kind"]), 1).otherwise(0)).cast("long").alias("n")), lambda s: s["n"])
    between = F.aggregate("parts", F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p["last"].cast("int").alias("k"), (s["n"] + F.when((s["k"] >= 0) & lost(s["k"], p["first"]), 1).otherwise(0)).cast("long").alias("n")), lambda s: s["n"])
    illegal = stretches.groupBy("c").agg(F.sum(inside).alias("inside")).join(gathered.select("c", between.alias("between")), "c").select("c", (F.col("inside") + F.col("between")).alias("illegal"))
    audit = written.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t.audit"))), lambda x: x["audit"]), "").alias("audit"))
    totals = solved.select("c", "cost", "run").join(audit, "c").join(illegal, "c").select("c", "cost", "illegal", F.concat("audit", F.repeat(F.lit("I"), F.col("run"))).alias("audit"))
    return edits.unionByName(tail), totals


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``c, conv_id, position, role, text`` of the repaired conversations, inserted turns with empty texts; each partition in order.

    Texts and edits are brought together by one exchange and a sort, and streamed: a task holds a batch, however long the conversation.
    """
    prepare(rows.sparkSession)
    texts = rows.select("c", F.lit(False).alias("tail"), "turn", "role", "digest", "id", F.lit(1).alias("what"), "conv_id", F.col("text"), F.lit(None).cast("string").alias("role_after"), F.lit("").alias("before"))
    marks = edits.select("c", "tail", "turn", "role", "digest", "id", F.lit(0).alias("what"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("string").alias("text"), "role_after", "before")
    dealt = marks.unionByName(texts).repartition("c").sortWithinPartitions("c", "tail", *ORDER[1:], "what").select("c", "what", "conv_id", "text", "role_after", "before")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, to, known = None, 0, None, None
        for batch in batches:
            out: list[tuple] = []
            for c, what, conv_id, text, role, before in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if c != conv:
                    conv, position, known = c, 0, int(c[1:]) if c != "n" else None
                if what == 0:
                    for x in before:
                        out.append((c, known, position, ROLES[x], ""))
                        position += 1
                    to = role
                elif to is not None:
                    out.append((c, known, position, to, text))
                    position += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["c", "conv_id", "position", "role", "text"])

    return dealt.mapInArrow(merge, "c string, conv_id long, position long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``c, sha256`` of ``repaired``'s turns as ``role:text`` lines, read in the order that it left them; a digest is carried over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            names, done = [], []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("c", "role", "text"))):
                if c != conv:
                    if state is not None:
                        names.append(conv)
                        done.append(state.hexdigest())
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.string())], names=["c", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["c", "sha256"])

    return turns.mapInArrow(run, "c string, sha256 string")


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``conversations``.

    ``turns`` are the rows to repair, ``conversations`` those whose ids count; a null id is one conversation. A conversation
    without rows to repair has zeros, an empty audit and the digest of nothing. An empty table gives no rows.
    """
    rows, marked = diagnose(turns)
    edits, totals = plan(marked)
    kinds = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    faults = marked.groupBy("c").agg(gaps, *kinds)
    ids = conversations.select(_key("conv_id").alias("c"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = ids.join(faults, "c", "left").join(totals, "c", "left").join(digests(repaired(rows, edits)), "c", "left")
    numbers = (F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
