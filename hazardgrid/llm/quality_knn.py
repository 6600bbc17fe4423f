"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are the shapes of its words (letters by case, digits, signs as they are, repeats
collapsed), pairs of neighbouring shapes, and words that repeat the one before. Terms are hashed,
weighted by inverse document frequency and projected on the singular vectors of the labelled
documents. Every document's cosines with all labelled vectors are computed block by block.

Terms, axes and unit vectors are whole numbers of so many bits that every sum of products is exact: a
score depends on its text only, not on the batch that the text is scored in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity_svm import fold
from .word_tokens import Numbered

#: Bound of the labelled vectors, which are broadcast: at most this many, of DIMENSIONS numbers each.
LABELLED = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Hashed shapes, pairs of them, and repeats.
SHAPES = 256
TERMS = 2 * SHAPES + 2
#: A vote is the cosine squared this often.
SQUARINGS = 3
#: Whole units of a weighted term, an axis and a unit vector; a sum of products stays below 2**53.
TERM_UNIT, AXIS_UNIT, VECTOR_UNIT = 2.0**13, 2.0**20, 2.0**19
#: Above LABELLED: makes room for a vector's number below its cosine.
PLACES = 2.0**13
#: Words that a worker remembers.
REMEMBERED = 1_000_000
RUN = re.compile(r"(.)\1+")


def _kinds() -> dict[int, str]:
    out = {}
    for c in range(0x250):
        char = chr(c)
        if char.isalpha():
            out[c] = "A" if char.isupper() else "a"
        elif char.isdigit():
            out[c] = "0"
    return out


KINDS = _kinds()


def shape(word: str) -> str:
    return RUN.sub(r"\1", word.translate(KINDS))


class Terms:
    """Term counts of texts; remembers the shapes of words."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.number, self.shapes = Numbered(), np.zeros(0, dtype=np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Square roots of the terms' shares, a row for each text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        had = len(self.number)
        which = [np.fromiter(map(self.number.__getitem__, w), dtype=np.int64, count=len(w)) for w in (t.split() for t in texts)]
        self.shapes = np.concatenate([self.shapes, np.array([zlib.crc32(shape(w).encode()) for w in islice(self.number, had, None)], dtype=np.int64)])
        out = np.zeros((len(texts), TERMS), dtype=np.float32)
        for row, w in zip(out, which, strict=True):
            if not len(w):
                continue
            s = self.shapes[w]
            row[:SHAPES] = np.bincount(s % SHAPES, minlength=SHAPES)
            if len(w) > 1:
                row[SHAPES : 2 * SHAPES] = np.bincount((s[:-1] * 31 + s[1:]) % SHAPES, minlength=SHAPES)
                again = int((w[1:] == w[:-1]).sum())
                row[-2], row[-1] = 4 * again, len(w) - 1 - again
            row /= len(w)
        return np.sqrt(out)


class Voters:
    """Labelled latent-semantic vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        if len(x) > PLACES:
            raise ValueError(f"at most {int(PLACES)} labelled vectors")
        self.prior = float(y.mean()) if len(y) else 0.5
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1 if len(x) else np.ones(TERMS)
        self.units = idf * TERM_UNIT
        weighted = np.rint(x * self.units)
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        self.axes = np.rint(vectors[:, ::-1][:, :DIMENSIONS] * AXIS_UNIT)
        self.labels = y.astype(np.float64)
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in whole units of 1 / VECTOR_UNIT."""
        z = np.rint((np.rint(x * self.units) @ self.axes) / AXIS_UNIT)
        return np.rint(z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1.0) * VECTOR_UNIT)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity; of equally near
        ones the first count. The prior for a text without terms."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        numbers = np.arange(len(self.labels), dtype=np.float64)
        for at in range(0, len(x), 512):
            near = self.project(x[at : at + 512]) @ self.vectors.T
            ranked = near * PLACES - numbers  # all different
            top = np.argpartition(ranked, len(self.labels) - k, axis=1)[:, -k:]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(ranked, top, axis=1), axis=1), axis=1)
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) / VECTOR_UNIT**2
            for _ in range(SQUARINGS):
                weight = weight * weight
            weight += 1e-12
            out[at : at + 512] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(x.any(axis=1), out, self.prior)


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Voters:
    """From at most LABELLED documents, by a hash of their ids, for which ``allowed`` (of doc_id) holds.
    Repeated ids give one vector, of the smallest text and the highest label."""
    picked = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    # LABELLED rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for part in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in terms.counts(common.texts_of(part))])], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(features, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, TERMS)
    return Voters(x, got["y"].to_numpy())


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for part in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.vote(terms.counts(common.texts_of(part))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted. Trained on
    labels outside the held-out fold (remainder 0 of 5). A null doc_id is not held out; null and empty
    texts get the share of label 1 among the labelled, 0.5 if none are. Repeated texts get equal scores,
    however rows are partitioned; long ones are read whole. Other columns are not read."""
    common.prepare(docs.sparkSession)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score(docs, train(docs, labels, ~held)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
