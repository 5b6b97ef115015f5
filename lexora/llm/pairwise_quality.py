"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text.  Weights are
learnt from preference pairs, a document labelled 1 against one labelled 0, by
the logistic loss of the features' differences.  The threshold is a quantile of
the strengths of labelled documents: as many lie below it as are labelled 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexora.llm.chunk_pool import slices
from lexora.llm.common import lowest

#: Labelled rows that the fit reads at most, chosen by hash; preference pairs drawn from them.
SAMPLE = 20_000
PAIRS = 200_000
#: The score that the threshold gets.
AT = 0.3
#: Pull of the weights to 0.
RIDGE = 1e-3
SEED = 11

_SPACE = re.compile("[ \t\n\x0b\f\r]+")
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "mark": b"#*$%&<>@^~=+_\\{}[]", "pipe": b"|", "loud": b"!?", "stop": b".,;:", "quote": b"\"'()-/", "line": b"\n", "control": bytes([*range(9), *range(14, 32), 127])}
_BYTES = np.stack([np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in _CLASSES.values()] + [np.arange(256) >= 128]).astype(np.float64)
NAMES = ("length", *_CLASSES, "high", "word_length", "distinct", "growth", "adjacent", "duplicate_lines")


def features(text: str) -> np.ndarray:
    """A vector by NAMES; shares are of words or bytes, logarithms damp long tails.  An empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(len(NAMES))
    words = [w for w in _SPACE.split(text) if w]
    n, distinct = max(1, len(words)), len(set(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    by = _BYTES @ np.bincount(raw, minlength=256)
    adjacent = sum(map(str.__eq__, words[1:], words))
    return np.array([np.log1p(n), *np.log1p(by / n), np.log1p(len(raw) / n), distinct / n, np.log(max(1, distinct)) / np.log(n + 1), adjacent / n, (len(lines) - len(set(lines))) / max(1, len(lines))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, AT at the threshold; features far outside the sample count as its border."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight - self.threshold + np.log(AT / (1 - AT))
        return np.exp(-np.logaddexp(0, -z))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Model:
    """Newton's method on the loss of random pairs; without both labels all scores are 0.5."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Model(mean, scale, w, float(np.log(AT / (1 - AT))))
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the pair's order being wrong
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w)), d.T @ p / pairs - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, float(np.quantile(z @ w, (y == 0).mean())))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _featured(docs: DataFrame, extra: str) -> DataFrame:
    """docs: one column that is kept, and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                x = [features(t or "").tolist() for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(x, pa.list_(pa.float64()))], names=[b.schema.names[0], "x"])

    return docs.mapInArrow(run, f"{extra}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents that aren't held out: those of the smallest hashes.

    A doc_id with labels of both kinds counts as 0, null ids and labels not at
    all.  The chosen ids are at most `sample` rows and so can be broadcast.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = lowest(known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), ["doc_id"], sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = _featured(rows, "quality int").orderBy(F.xxhash64("x", "quality")).limit(2 * sample).collect()  # more rows than ids only where ids repeat
    x = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    return fit(x, np.array([r["quality"] for r in got]))


def scored(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with the score; all columns stay (one named `to` is replaced)."""
    kept = docs.drop(to)
    schema = kept.withColumn(to, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            for i, j in slices(texts):
                s = model.score(np.stack([features(t or "") for t in texts[i:j]]))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, to])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with a score of at least 0.3, with their columns, whatever their names."""
    to = "_score"
    while to in (c.lower() for c in docs.columns):
        to += "_"
    return scored(docs, train(docs, labels, sample), to).where(F.col(to) >= AT).drop(to)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row of docs.

    Scores come from texts alone.  A null or empty text has the features of no
    words and a score like any other; null and repeated doc_ids stay (a null
    isn't held out); an empty table gives an empty result.
    """
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
