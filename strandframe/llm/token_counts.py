"""Token counts by a compiled finite-state transducer (operator 1).

Two deterministic machines replace the tokenizer:

* a pre-token machine over twelve character classes. Text is cut into equal chunks; every chunk
  yields its state map (entry state -> exit state), the maps are composed by a parallel prefix scan,
  and a second pass marks the pre-token starts from the then known entry states;
* a byte-pair machine over bytes. A state holds every vocabulary prefix that the bytes read so far
  may still extend, with the last token before it and the count there; a transition carries the
  number of tokens it adds (it may be negative when a longer token swallows earlier ones). States
  are determinised when first met and kept for the life of the worker.

A pre-token boundary resets the second machine, so counts of chunks simply add up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size

END = 0x110000
CHUNK = 256
#: Work memory bounds of a worker: code points scanned at once, cached words, transitions.
SCAN, WORDS, TRANSITIONS = 1 << 19, 300_000, 600_000

#: Character classes: other letter, s t m d, r, v, l, e, number, other, apostrophe, space, other white space, end.
OTHER_LETTER, STMD, R, V, L, E, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, STOP = range(12)
LETTERS = (OTHER_LETTER, STMD, R, V, L, E)
#: States: fresh start; in letters, numbers, others; one space, one other white; more white space
#: ending in a space, in another; an apostrophe that starts a token, and r, v, l after it.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
HERE, BEFORE = 1, 2  # marks on a transition: a token starts at this character, at the one before


def _fresh(c: int) -> tuple[int, int]:
    if c == STOP:
        return FRESH, 0
    if c in LETTERS:
        return IN_LETTERS, HERE
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, WHITE: ONE_WHITE}[c], HERE


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|white+(?!nonwhite)|white+."""
    after_quote = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}
    if state in after_quote:
        if c == after_quote[state]:
            return FRESH, 0
        to, marks = _step(IN_LETTERS, c)
        return to, marks | BEFORE
    if state == QUOTE:
        if c == STMD:
            return FRESH, 0
        if c in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        return (IN_OTHERS, 0) if c in (OTHER, APOSTROPHE) else _fresh(c)
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if c in (SPACE, WHITE):
            return (RUN_SPACE if c == SPACE else RUN_WHITE), 0
        if c == STOP:
            return FRESH, 0
        last = BEFORE if state in (RUN_SPACE, RUN_WHITE) else 0
        if state in (ONE_SPACE, RUN_SPACE):  # the space joins what follows
            return (IN_LETTERS if c in LETTERS else IN_NUMBERS if c == NUMBER else IN_OTHERS), last
        to, marks = _fresh(c)
        return to, marks | last
    goes_on = {IN_LETTERS: LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, APOSTROPHE)}.get(state, ())
    return (state, 0) if c in goes_on else _fresh(c)


class PreTokens:
    """Pre-token spans of texts, exactly as the tokenizer's own pre-tokenizer cuts them."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.cut = Tokenizer.from_str(spec.decode()).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"] for t in json.loads(spec)["added_tokens"]}
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        moves = np.array([[_step(s, c) for c in range(12)] for s in range(12)])
        self.next = moves[:, :, 0].astype(np.uint8).ravel()
        self.marks = moves[:, :, 1].astype(np.uint8).ravel()
        self.classes = np.full(END + 1, 255, np.uint8)
        self.classes[END] = STOP
        for chars, c in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", APOSTROPHE), (" ", SPACE)):
            for x in chars:
                self.classes[ord(x)] = c

    def classify(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == 255).any():
            for p in np.unique(points[found == 255]).tolist():
                x = chr(p)
                self.classes[p] = next((c for c, probe in ((OTHER_LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.cut(probe + x + probe)) == 1), WHITE)
            found = self.classes[points]
        return found

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Marks token starts. Chunk state maps, their prefix scan, then one pass with known states."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        rows = np.full(chunks * CHUNK, STOP, np.uint8)
        rows[:n] = classes
        columns = np.ascontiguousarray(rows.reshape(chunks, CHUNK).T)
        maps = np.tile(np.arange(12, dtype=np.uint8), (chunks, 1))
        for i, column in enumerate(columns):
            if i % 8 == 0 and (maps == maps[:, :1]).all():  # all entry states have met: one exit state says the whole map
                state = maps[:, 0]
                for column in columns[i:]:
                    state = self.next[state * np.uint8(12) + column]
                maps = np.repeat(state[:, None], 12, axis=1)
                break
            maps = self.next[maps * np.uint8(12) + column[:, None]]
        step = 1
        while step < chunks:  # composition is associative: log(chunks) rounds
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
            step *= 2
        state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
        marks = np.empty_like(columns)
        for i, column in enumerate(columns):
            at = state * np.uint8(12) + column
            marks[i] = self.marks[at]
            state = self.next[at]
        flat = marks.T.reshape(-1)[:n]
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return begins

    def split(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 of all texts, byte spans (starts, ends) of their pre-tokens in order, each span's text.

        Special strings inside a text are tokens of their own: they come as spans too.
        """
        pieces: list[str] = []
        owner: list[int] = []
        special: list[bool] = []
        for i, text in enumerate(texts):
            at = 0
            for m in self.special_re.finditer(text) if self.special_re else ():
                pieces += [text[at : m.start()], m[0]]
                owner += [i, i]
                special += [False, True]
                at = m.end()
            pieces.append(text[at:])
            owner.append(i)
            special.append(False)
        lengths = np.array([len(p) for p in pieces])
        points = np.full(int(lengths.sum()) + len(pieces), END, np.uint32)
        joined = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(points), bool)
        inside[ends] = False
        points[inside] = joined
        begins = self.starts(self.classify(points))
        for k in np.flatnonzero(special).tolist():  # one span for the whole special string
            begins[ends[k] - lengths[k] : ends[k]] = False
            begins[ends[k] - lengths[k]] = True
        width = np.where(inside, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 0)
        offset = np.concatenate([[0], np.cumsum(width)])
        cuts = np.flatnonzero(begins | ~inside)
        first = np.flatnonzero(begins[cuts])
        piece = np.searchsorted(ends, cuts[first])
        return "".join(pieces).encode("utf-8", "surrogatepass"), offset[cuts[first]], offset[cuts[first + 1]], np.array(owner)[piece]


class State(dict):
    """A state of the machine: byte -> (next state, tokens added), each made when first asked for.

    ``reach``: vocabulary prefixes that may go on, with the last token before each and the count there,
    relative to here; the empty prefix comes last, with the last token of all bytes so far.
    """

    __slots__ = ("machine", "reach")

    def __init__(self, machine: CountMachine, reach: tuple):
        self.machine, self.reach = machine, reach

    def __missing__(self, byte: int) -> tuple[State, int]:
        made = self[byte] = self.machine.move(self.reach, byte)
        return made


class CountMachine:
    """The byte-pair merges of a vocabulary as a deterministic transducer that counts tokens."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)["model"]
        vocab = model["vocab"]
        to_byte = {c: b for b, c in _byte_names().items()}
        ids = {s: i for s, i in vocab.items() if all(c in to_byte for c in s)}
        self.merge, self.parts, self.rank = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            self.merge[ids[a], ids[b]] = r
            self.parts[made], self.rank[made] = (ids[a], ids[b]), r
        self.trie: dict[int, int] = {}
        self.token: dict[int, int] = {}
        inner, nodes = set(), 1
        for s, i in ids.items():
            if len(s) > 1 and i not in self.parts:
                continue  # no merge makes it
            node = 0
            for c in s:
                inner.add(node)
                at = node << 8 | to_byte[c]
                if at not in self.trie:
                    self.trie[at] = nodes
                    nodes += 1
                node = self.trie[at]
            self.token[node] = i
        self.inner = inner
        self.reset()

    def reset(self) -> None:
        self.known: dict[tuple, State] = {}
        self.moves, self.fits = 0, {}
        self.root = self.state(((0, -1, 0),))

    def state(self, reach: tuple) -> State:
        found = self.known.get(reach)
        if found is None:
            found = self.known[reach] = State(self, reach)
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """True if the merges leave tokens a and b side by side: no merge across their border comes first.

        Walks back the merges that built a's right edge and b's left edge, latest first.
        """
        bound = 1 << 60
        while True:
            if self.merge.get((a, b), bound) < bound:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # when b's edge forms, a is still in two parts
                bound, a = ra, self.parts[a][1]
            else:  # at equal rank the left one is merged first
                bound, b = rb + 1, self.parts[b][0]

    def move(self, reach: tuple, byte: int) -> tuple[State, int]:
        """The state after ``byte``, and the tokens that the transition adds."""
        token, added, after = -1, 0, []
        for node, last, count in reach:
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            if token < 0 and (t := self.token.get(child)) is not None:
                fits = last < 0
                if not fits and (fits := self.fits.get(last << 32 | t)) is None:
                    fits = self.fits[last << 32 | t] = self.adjacent(last, t)
                if fits:
                    token, added = t, count + 1
            if child in self.inner:
                after.append((child, last, count))
        self.moves += 1
        return self.state(tuple([(node, last, count - added) for node, last, count in after] + [(0, token, 0)])), added

    def start(self) -> State:
        if self.moves > TRANSITIONS:
            self.reset()
        return self.root

    def count(self, word: bytes) -> int:
        state, total = self.start(), 0
        for byte in word:
            state, added = state[byte]
            total += added
        return total


def _byte_names() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Byte masks of contents of 0 to 15 bytes, and the length in the last byte.
_KEEP = np.array([[0xFF] * n + [0] * (16 - n) for n in range(16)], np.uint8).view("<u8")
_SIZE = np.array([[0] * 15 + [n] for n in range(16)], np.uint8).view("<u8")
SHORT = 16


def distinct_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One span of each different content, for every span the number of its content, and a key of each content.

    Contents of under SHORT bytes come first; their key, two 64-bit numbers, is the bytes and the length
    themselves. Longer ones are told apart by their bytes; their keys are 0.
    """
    size = ends - starts
    short, long = np.flatnonzero(size < SHORT), np.flatnonzero(size >= SHORT)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(SHORT), np.uint8), SHORT)
    keys = windows[starts[short]].view("<u8") & _KEEP[size[short]] | _SIZE[size[short]]
    mixed = (keys[:, 0] ^ keys[:, 0] >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + (keys[:, 1] ^ keys[:, 1] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, place = np.unique(mixed, return_index=True, return_inverse=True)
    odd = np.flatnonzero((keys != keys[first][place]).any(axis=1))
    more: dict[tuple, tuple[int, int]] = {}
    for k in odd.tolist():  # different contents whose mixed keys agree
        place[k] = more.setdefault(tuple(keys[k].tolist()), (len(first) + len(more), k))[0]
    first = np.concatenate([first, np.array([k for _, k in more.values()], np.int64)])
    number = np.empty(len(size), np.int64)
    number[short] = place
    found: dict[bytes, tuple[int, int]] = {}
    for k, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        number[k] = found.setdefault(data[a:b], (len(first) + len(found), k))[0]
    own = keys[first]
    first = np.concatenate([short[first], np.array([k for _, k in found.values()], np.int64)])
    return first, number, np.concatenate([own, np.zeros((len(found), 2), own.dtype)])


class Counter:
    """Counts the tokens of texts; one for each worker process and vocabulary."""

    def __init__(self, spec: bytes):
        self.pre, self.machine = PreTokens(spec), CountMachine(spec)
        self.words: dict[bytes, int] = dict.fromkeys((s.encode() for s in self.pre.special), 1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        data, starts, ends, owner = self.pre.split(texts)
        first, number, _ = distinct_spans(data, starts, ends)
        if len(self.words) > WORDS:
            self.words = dict.fromkeys((s.encode() for s in self.pre.special), 1)
        known, count = self.words, self.machine.count
        counts = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            word = data[a:b]
            n = known.get(word)
            if n is None:
                n = count(word)
                if len(word) < 64:
                    known[word] = n
            counts.append(n)
        return np.bincount(owner, weights=np.array(counts, dtype=np.float64)[number], minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(spec: bytes) -> Counter:
    return Counter(spec)


def load_spec(path: str) -> bytes:
    """The vocabulary file, read on the driver and sent to the workers: a few MB at most."""
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file (tokenizers JSON). No special tokens are added;
    special strings inside a text count as one token each. A null text counts as empty: 0 bytes, 0
    tokens. Null ids, repeated rows and extra columns pass: one output row for each input row, and only
    the two named columns are read. A narrow map without a shuffle.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = counter(spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_size([len(t) for t in texts], SCAN):
                part = texts[a:b]
                n = run(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
