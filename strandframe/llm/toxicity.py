"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams (operator 6).

Features of a text are the sets of its hashed words, word pairs and pairs that skip one word. Training
passes over a bounded sample of labelled rows with a rate of its own for each coordinate and an L1
penalty; the few weights that are not zero are broadcast, and every text is scored by a sorted lookup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size

BITS = 20
#: Labelled rows that training sees at the most: those of least hash. Passes over them.
SAMPLE, EPOCHS = 16_000, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
WORDS = re.compile(r"\w+")


class Hasher:
    """Word hashes, remembered within bounds."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all texts, and the text of each. A feature may come up more than once."""
        if len(self.known) > 50_000:
            self.known.clear()
        known, words, counts = self.known, [], []
        for text in texts:
            found = WORDS.findall(text.lower())
            words += found
            counts.append(len(found))
        for w in set(words):
            if w not in known:
                known[w] = crc32(w.encode("utf-8", "surrogatepass"))
        h = np.array([known[w] for w in words], dtype=np.uint64)
        doc = np.repeat(np.arange(len(texts)), counts)
        parts, owners = [_mix(h)], [doc]
        for gap, salt in ((1, 0x51), (2, 0xA7)):  # neighbours; one word skipped
            same = doc[:-gap] == doc[gap:]
            parts.append(_mix(h[:-gap][same] * np.uint64(0x100000001B3) + h[gap:][same] + np.uint64(salt << 32)))
            owners.append(doc[:-gap][same])
        return np.concatenate(parts), np.concatenate(owners)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    return Hasher()


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """The different features of each text, as 32-bit numbers."""
    rows = []
    for a, b in by_size([len(t) for t in texts], 1 << 18):
        f, doc = hasher()(texts[a:b])
        pairs = np.unique(doc << BITS | f)
        cuts = np.searchsorted(pairs >> BITS, np.arange(b - a + 1))
        f = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        rows += [f[x:y].copy() for x, y in zip(cuts, cuts[1:])]
    return rows


def fit(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the feature sets, in order: numbers and weights of the features that are not zero, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for row, y in zip(rows, labels):
            zr, nr = z[row], n[row]
            w = weight(zr, nr)
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[row] = zr + g - (np.sqrt(nr + g * g) - np.sqrt(nr)) / ALPHA * w
            n[row] = nr + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    w = weight(z, n)
    some = np.flatnonzero(w)
    return some, w[some], float(-bias_z / ((BETA + bias_n**0.5) / ALPHA))


class Weights:
    """The weights as a dense table, for scoring."""

    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float):
        self.table, self.bias = np.zeros(1 << BITS), bias
        self.table[at] = w

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in by_size([len(t) for t in texts], 1 << 18):
            f, doc = hasher()(texts[a:b])
            hit = np.flatnonzero(self.table[f])
            pairs = np.unique(doc[hit] << BITS | f[hit])  # a feature counts once in a text
            total = self.bias + np.bincount(pairs >> BITS, weights=self.table[pairs & ((1 << BITS) - 1)], minlength=b - a)
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float] | None:
    """Fits on the ``sample`` labelled rows of least hash that are not held out; one task, bounded by ``sample``.

    Rows without an id or with another label than 0 or 1 are not learnt from. Of labels repeated for an
    id the largest counts, of texts the least, so an id is learnt from once. Without any labelled row
    nothing is learnt, and the result is None.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    known = known.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) != 0)
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("i") == F.col("_id")).groupBy("_id", "_y").agg(F.min("text").alias("text")).select("text", "_y", F.xxhash64("_id").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # texts become features batch by batch
        for batch in batches:
            held += zip(batch["h"].tolist(), batch["_y"].tolist(), feature_sets(batch["text"].tolist()))
        if not held:
            return
        held.sort(key=lambda r: (r[0], r[2].tobytes()))
        at, w, bias = fit([r[2] for r in held], [r[1] for r in held])
        yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(w, bias)})

    got = rows.repartition(1).mapInPandas(run, "at long, w double").toPandas().sort_values("at")
    at, w = got["at"].to_numpy(), got["w"].to_numpy()
    return (at[1:], w[1:], float(w[0])) if len(w) else None


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Only the text enters a score; null counts as empty and scores by the bias. Ids whose CRC-32, as text,
    is divisible by five are held out from training; a null id is neither held out nor learnt from.
    Repeated rows score alike; an empty table gives an empty result.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0), 0.0
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample, id_col=id_col, text_col=text_col) or nothing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Weights(*sent.value)
        for batch in batches:
            score = table.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts do not score 0.5 or more, with all their columns; all rows if nothing was learnt."""
    learnt = train(docs, labels, id_col=id_col, text_col=text_col)
    if learnt is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(learnt)

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Weights(*sent.value)
        for texts in batches:
            yield pd.Series(table.scores([t or "" for t in texts]) >= 0.5)

    return docs.where(~toxic(F.col(text_col)))
