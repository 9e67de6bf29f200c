"""Chat formatting (operator 13): turns as one marked text, with a mask of what is learnt from, and back.

A turn is an opening mark, its text and a closing mark; roles other than system, user and assistant are
written between marks of their own. Inside roles and texts a backslash is doubled, and a control string gets
one behind its first character, so no mark ever stands in a text and reading undoes it.

Assembly is columnar: for a batch of turns the lengths of all segments (marks, roles, texts) give the
offsets of the output by a running sum, and one gather of numpy copies marks and contents from one source
buffer into the buffer that becomes the Arrow column. No text is touched one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare

#: role -> opening and closing mark; other roles stand between OTHER[0] and OTHER[1], their texts before OTHER[2].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROL = [m for pair in MARKS.values() for m in pair] + list(OTHER)
#: Turns and bytes from which a conversation is written in parts, so that a task never holds a whole one of any size.
LONG_TURNS, LONG_BYTES = 4096, 16 << 20
#: Bytes of output that are gathered at a time.
SLICE = 4 << 20
PARTS = "conv_id long, part long, turns int, text string, loss_start array<int>, loss_end array<int>"

_HIDE = "(" + "|".join(re.escape(m[0]) for m in ("<", "[")) + ")(" + "|".join(re.escape(m[1:]) for m in sorted(CONTROL, key=len, reverse=True)) + ")"
_MARK = re.compile("|".join(re.escape(m) for m in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    """Texts without any control string in them; reversible."""
    return pc.replace_substring_regex(pc.replace_substring(texts, "\\", "\\\\"), _HIDE, r"\1\\\2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``buffer, bounds, text_bounds``: the bytes of all turns, where each turn begins (and the last ends), and where its text begins and ends."""
    known = list(MARKS)
    kind = pc.fill_null(pc.index_in(roles, pa.array(known)), len(known)).to_numpy(zero_copy_only=False)
    marks = [MARKS[r][0].encode() for r in known] + [MARKS[r][1].encode() for r in known] + [x.encode() for x in OTHER]
    names, bodies = (escape(x).cast(pa.large_binary()) for x in (roles, texts))

    def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        return data, offsets[:-1], np.diff(offsets)

    (name_data, name_at, name_n), (body_data, body_at, body_n) = buffer(names), buffer(bodies)
    table = np.frombuffer(b"".join(marks), np.uint8)
    mark_n = np.array([len(m) for m in marks])
    mark_at = np.cumsum(mark_n) - mark_n
    source = np.concatenate([table, name_data, body_data])
    other = kind == len(known)
    # five segments a turn: opening mark, role, mark behind the role, text, closing mark
    opening, closing = np.where(other, 2 * len(known), kind), np.where(other, 2 * len(known) + 2, kind + len(known))
    behind = 2 * len(known) + 1
    start = np.stack([mark_at[opening], len(table) + name_at, np.full(len(kind), mark_at[behind]), len(table) + len(name_data) + body_at, mark_at[closing]], axis=1).ravel()
    length = np.stack([mark_n[opening], np.where(other, name_n, 0), np.where(other, mark_n[behind], 0), body_n, mark_n[closing]], axis=1).ravel()
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    shift = start - (ends - length)
    first = 0
    while first < len(length):  # a stretch of segments at a time, so that the indices stay small
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - length[first] + SLICE)))
        if last == first + 1:  # one very long segment is a plain copy
            out[ends[first] - length[first] : ends[first]] = source[start[first] : start[first] + length[first]]
        else:
            low, high = int(ends[first] - length[first]), int(ends[last - 1])
            out[low:high] = source[np.repeat(shift[first:last], length[first:last]) + np.arange(low, high)]
        first = last
    ends = ends.reshape(-1, 5)
    return out, np.append(ends[:, 0] - length[::5], ends[-1:, 4]), np.stack([ends[:, 2], ends[:, 3]], axis=1)


def characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many characters of UTF-8 ``data`` begin before each of the ascending places ``at``."""
    if not len(at):
        return np.zeros(0, np.int64)
    begins = np.append((data & 0xC0) != 0x80, False)
    places = np.unique(np.append(0, at))
    return np.append(0, np.cumsum(np.add.reduceat(begins, places, dtype=np.int64)))[np.searchsorted(places, at)]


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("i"), F.col(column).cast("string")), F.lit("n"))


#: The order of a conversation's turns: nulls first; equal turns by role and digest of the text.
ORDER = ["c", "turn", "role", "digest"]


def _format(turns: DataFrame, cut: bool) -> DataFrame:
    """Parts of ordered turns ``c, conv_id, role, text``. Each partition holds whole conversations, or, with ``cut``, stretches of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33 if cut else 0
        held: pa.Table | None = None

        def parts(rows: pa.Table) -> pa.RecordBatch:
            nonlocal part
            rows = rows.combine_chunks()
            out, bounds, texts = assemble(*(rows.column(n).combine_chunks() for n in ("role", "text")))
            ids = np.asarray(rows.column("c").combine_chunks().dictionary_encode().indices)
            fresh = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            learnt = np.flatnonzero(np.asarray(pc.equal(rows.column("role").combine_chunks(), "assistant")))
            whose = np.searchsorted(fresh, learnt, side="right") - 1
            base = characters(out, bounds[fresh])[whose]
            lists = np.searchsorted(whose, np.arange(len(fresh) + 1)).astype(np.int32)
            span = [pa.ListArray.from_arrays(lists, pa.array((characters(out, texts[learnt, i]) - base).astype(np.int32))) for i in (0, 1)]
            offsets = bounds[np.append(fresh, len(ids))]
            text = pa.LargeStringArray.from_buffers(len(fresh), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            conv = rows.column("conv_id").combine_chunks().take(pa.array(fresh))
            number = np.arange(part, part + len(fresh)) if cut else np.zeros(len(fresh), np.int64)
            part += len(fresh)
            return pa.RecordBatch.from_arrays([conv, pa.array(number), pa.array(np.diff(np.append(fresh, len(ids))).astype(np.int32)), text, *span], names=["conv_id", "part", "turns", "text", "loss_start", "loss_end"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            held = None
            if cut:
                yield parts(rows)
                continue
            ids = rows.column("c").to_numpy()
            last = int(np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[-1])
            if last:  # the last conversation may go on in the next batch
                yield parts(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield parts(held)

    return turns.select("c", "conv_id", "role", "text").mapInArrow(run, PARTS)


def with_sample(conversations: DataFrame, text: str, conv_id: int = -1) -> DataFrame:
    """``conversations`` and one more: a user and an assistant who both say ``text``."""
    spark = conversations.sparkSession
    more = spark.createDataFrame([(conv_id, i, role, text) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, conv_id, turn, role, text, digest`` of short and of long conversations. Null roles and texts are empty; a null id is a conversation."""
    rows = conversations.select(_key("conv_id").alias("c"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long") + F.octet_length("role")).alias("b"))
    large = sizes.where((F.col("n") > LONG_TURNS) | (F.col("b") > LONG_BYTES)).select("c")
    rows = rows.withColumn("digest", F.xxhash64("text"))
    return rows.join(large, "c", "left_anti"), rows.join(large, "c", "left_semi")


def chat_format(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, turns, text, loss_start, loss_end`` of the conversations, one row for each short one, parts of the long ones.

    The loss mask holds the character ranges of assistant texts (as written, escaped). Turns go by number,
    nulls first, equal ones by role and text. Parts of a conversation follow each other by ``part``: the long
    are dealt out by range of their turns, equal rows by place of origin, so a conversation with a third of
    all rows is many tasks'. An empty table gives no rows; other columns are left out.
    """
    prepare(conversations.sparkSession)
    short, large = ordered(conversations)
    whole = _format(short.repartition("c").sortWithinPartitions(*ORDER, "text"), cut=False)
    spread = [*ORDER, F.monotonically_increasing_id()]
    return whole, _format(large.repartitionByRange(*spread).sortWithinPartitions(*ORDER, "text"), cut=True)


def turns_of(text: str) -> list[tuple[str, str, int, int]]:
    """``role, text, start, end`` of the turns of a formatted text; start and end bound the text as written."""
    openings = {a: (role, b) for role, (a, b) in MARKS.items()} | {OTHER[0]: (None, OTHER[2])}
    found, at = [], 0
    marks = _MARK.finditer(text)
    for mark in marks:
        role, closing = openings[mark.group()]
        if mark.start() != at:
            raise ValueError("text between two turns")
        if role is None:
            behind = next(marks)
            role, mark = unescape(text[mark.end() : behind.start()]), behind
        end = next(marks)
        if end.group() != closing:
            raise ValueError(f"a turn is closed by {end.group()}")
        found.append((role, unescape(text[mark.end() : end.start()]), mark.end(), end.start()))
        at = end.end()
    if at != len(text):
        raise ValueError("a turn is cut off")
    return found


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of parts in order within their partition.

    Digests are carried from part to part, so a task holds one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, n, chars, size, turns, loss = False, None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        result = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        for batch in batches:
            out = []
            for conv_id, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))):
                if not began or conv_id != conv:
                    if began:
                        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    began, conv, n, chars, size, turns, loss = True, conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(starts, ends):
                    learnt = unescape(text[a:b])
                    loss.update(learnt.encode())
                    chars += len(learnt)
                size += len(text)
            yield result(out)
        if began:
            yield result([(conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)])

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SAMPLE = "</s>[INST] ok [/INST]"


def round_trip(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations and the sample (conversation -1, whose text is made of marks)."""
    whole, parts = chat_format(with_sample(conversations, SAMPLE))
    return read_back(whole).unionByName(read_back(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")))
