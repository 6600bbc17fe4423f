"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nyström landmarks.

The kernel of two words sums, over all common subsequences of three or four characters that span at
most SPAN places, DECAY to the number of gaps on either side; it is normalised. So a word with
inserted or missing characters still resembles the insult it hides. A sentence resembles a landmark
as much as its closest word does. A document is as toxic as its worst word, or, where no single one
decides, as its three worst together: some insults are common words' stems that only
their repetition gives away.

The examples are labelled sentences: those of clean documents, and those of toxic documents that hold
a word with a piece that tells toxic documents apart (``train``). A word stands for the sentences
it is in, with a weight on either side.

The machine is trained on the kernel's Nyström features for a bounded set of landmarks. Its decision
is linear in subsequences that some landmark has, so it is evaluated exactly as a table of their
weights, without a kernel call a landmark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .word_tokens import Numbered

DECAY = 0.5
SPAN = 7
#: Character classes: 0 nothing, 1 to 26 letters, 27 the start of a word, the others by code point.
CLASSES = 48
#: Bounds of the training set: labelled documents, words of either kind, landmarks.
TRAIN_DOCUMENTS = 8000
TRAIN_WORDS = 6000
LANDMARKS = 320
#: Added to a word's squared norm, so that words of a letter or two resemble nothing closely.
FLOOR = 3.0
#: Weight of an insult among the examples, for each doubling of the documents it is in.
POSITIVE = 2.0
#: Words that a worker remembers.
REMEMBERED = 200_000
#: Longer words are scored in overlapping parts.
PART = 24
#: Times up to which a document's uses of a piece are told apart, and a probability that decides alone.
TIMES, SURE = 3, 0.9
#: Characters of the pieces (starts and ends of words) that tell toxic documents apart.
PIECES = (4, 5, 6, 7)
SENTENCE = re.compile(r"[.!?\n]+")

OFFSETS = [(*o,) for n in (2, 3) for o in combinations(range(1, SPAN), n)]
WEIGHTS = np.array([DECAY ** (o[-1] - len(o)) for o in OFFSETS])
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W\d_]+")


def units(word: str) -> list[str]:
    """What of a word is scored: its core, the core's letters alone, and parts of a long one."""
    core = EDGES.sub("", word)
    out = [core]
    if not core.isalpha():
        out.append(INNER.sub("", core))
    return [u[at : at + PART] for u in out for at in range(0, max(1, len(u) - PART // 2), PART // 2)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters, each word marked at its start and followed by a gap; word starts."""
    gap = "\0" * (SPAN - 1)
    raw = np.frombuffer(("".join("\1" + w + gap for w in words)).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    out = 28 + raw % (CLASSES - 28)
    out[raw == 0] = 0
    out[raw == 1] = 27
    letter = (raw >= 97) & (raw <= 122)
    out[letter] = raw[letter] - 96
    size = np.array([len(w) + 1 for w in words])
    return out, np.cumsum(size + SPAN - 1) - (size + SPAN - 1)


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
    """(subsequence number, where, weight, ...) for each pattern of offsets; number 0 is none."""
    codes, _ = _codes(words)
    at = np.flatnonzero(codes)
    padded = np.concatenate([codes, np.zeros(SPAN, dtype=np.int64)])
    col = [padded[at + k] for k in range(SPAN)]
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    for offsets, weight in zip(OFFSETS, WEIGHTS, strict=True):
        number = col[0]
        whole = np.ones(len(at), dtype=bool)
        for o in offsets:
            number = number * CLASSES + col[o]
            whole &= col[o] > 0
        if len(offsets) == 2:
            number = number + CLASSES**4
        yield np.where(whole, number, 0), owner, weight


def norms(words: list[str]) -> np.ndarray:
    """Length of each word in the kernel's space, taking its subsequences as different."""
    total = np.zeros(len(words))
    for number, owner, weight in _subsequences(words):
        total += np.bincount(owner, weights=(number > 0) * weight**2, minlength=len(words))
    return np.sqrt(total + FLOOR)


class Kernel:
    """Features of words against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        numbers = np.unique(np.concatenate([n for n, _, _ in _subsequences(landmarks)]))
        self.numbers = numbers[numbers > 0]
        #: a row for each subsequence of a landmark: its weight in every landmark, normalised
        self.columns = np.zeros((len(self.numbers), len(landmarks)), dtype=np.float32)
        for number, owner, weight in _subsequences(landmarks):
            at, ok = self._known(number)
            np.add.at(self.columns, (at[ok], owner[ok]), weight)
        self.columns /= norms(landmarks).astype(np.float32)
        values, vectors = np.linalg.eigh((self.columns.T @ self.columns).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def _known(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        return at, self.numbers[at] == number

    def values(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark, by the subsequences they share."""
        out = np.zeros((len(words), len(self.landmarks)))
        for number, owner, weight in _subsequences(words):
            at, ok = self._known(number)
            at, owner = at[ok], owner[ok]
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first]] += weight * np.add.reduceat(self.columns[at], first, axis=0)
        return out / norms(words)[:, None]

    def features(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.values(words[i : i + 500]) for i in range(0, len(words), 500)]) @ self.root

    def weights(self, w: np.ndarray) -> np.ndarray:
        """What a linear machine over the features gives each subsequence."""
        return self.columns @ (self.root @ w)


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 100.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; y is 1 or -1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (z @ w) < 1
        zs, ws = z[on], cost * weight[on]
        new = np.linalg.solve(ridge + zs.T @ (zs * ws[:, None]), zs.T @ (ws * y[on]))
        done = np.allclose(new, w, atol=1e-7)
        w = w + (new - w) * (1.0 if on.any() else 0.0)
        if done:
            break
    return w[:-1], float(w[-1])


class Machine:
    """Weights of subsequences, an offset, and the logistic links of a document's worst margins: of the
    worst alone, and, where that isn't sure, of the TIMES worst."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray, offset: float, links: tuple = ((2.0, 0.0), (2.0, 0.0))):
        self.numbers, self.weights, self.offset, self.links = numbers, weights.astype(np.float32), offset, links

    def table(self) -> np.ndarray:
        out = np.zeros(CLASSES**4 + CLASSES**3, dtype=np.float32)
        out[self.numbers] = self.weights
        return out

    def margins(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Of whole words: the worst of their units."""
        if not words:
            return np.zeros(0)
        parts = [units(w) for w in words]
        flat = [u for p in parts for u in p]
        total = np.zeros(len(flat))
        square = np.zeros(len(flat))
        for at in range(0, len(flat), 20_000):
            some = flat[at : at + 20_000]
            for number, owner, weight in _subsequences(some):
                total[at : at + len(some)] += np.bincount(owner, weights=table[number] * weight, minlength=len(some))
                square[at : at + len(some)] += np.bincount(owner, weights=(number > 0) * weight**2, minlength=len(some))
        value = total / np.sqrt(square + FLOOR) + self.offset
        first = np.cumsum([0] + [len(p) for p in parts[:-1]])
        return np.maximum.reduceat(value, first)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        """Of documents' worst margins, a row each."""
        alone, all_of_them = (logistic(margins[:, : len(link) - 1], link) for link in self.links)
        return np.where(alone >= SURE, alone, all_of_them)

    @staticmethod
    def constant(toxic: bool) -> Machine:
        least = 30.0 if toxic else -30.0
        return Machine(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, ((0.0, least), (0.0,) * TIMES + (least,)))


def logistic(x: np.ndarray, link: tuple) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(link[:-1]) + link[-1], -30, 30)))


def worst_margins(texts: list[str], machine: Machine, table: np.ndarray, memory: dict) -> np.ndarray:
    """The TIMES largest margins of words of each text, largest first; -4 where there is no word."""
    if not memory or len(memory["number"]) > REMEMBERED:
        memory.update(number=Numbered(), margin=np.zeros(0, dtype=np.float32), single=np.zeros(0, dtype=bool))
    number = memory["number"]
    had = len(number)
    split = [t.lower().split() for t in texts]
    which = [np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)) for w in split]
    new = list(islice(number, had, None))
    memory["margin"] = np.concatenate([memory["margin"], machine.margins(new, table).astype(np.float32)])
    memory["single"] = np.concatenate([memory["single"], np.array([len(w) == 1 and w.isalpha() for w in new], dtype=bool)])
    out = np.full((len(texts), TIMES), -4.0)
    for k, (w, words) in enumerate(zip(which, split, strict=True)):
        if not len(w):
            continue
        margins = memory["margin"][w]
        single = memory["single"][w]
        if single.any():  # letters set apart by white space
            a, b = common.runs_of(single)
            spelled = ["".join(words[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if j - i >= 4]
            margins = np.concatenate([margins, machine.margins(spelled, table)])
        if len(margins) > TIMES:
            margins = np.partition(margins, len(margins) - TIMES)[-TIMES:]
        out[k, : len(margins)] = np.maximum(np.sort(margins)[::-1], -4.0)
    return out


def _training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents, by a hash of their ids. The ids are few, so
    they go to every task and the table is read once."""
    picked = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Machine:
    """A machine from labelled documents for which ``allowed`` (of doc_id) holds.

    Sentences of clean documents are clean. A sentence of a toxic document is toxic if it has a word
    with a piece that significantly often stands in toxic documents only, or stands there several times.
    """
    rows = common.durable(_training_rows(docs, labels, "toxic", allowed, TRAIN_DOCUMENTS))
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not toxic or toxic == n:
        return Machine.constant(bool(n and toxic))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: words by sentence; kinds 1 to TIMES: pieces that so many of a document's words have."""
        for part in common.chunks(batches):
            out: list[tuple[str, int, int]] = []
            for text, y in zip(common.texts_of(part), part.column("y").to_pylist(), strict=True):
                held: Counter[str] = Counter()
                for sentence in SENTENCE.split(text.lower()):
                    words = [u for w in sentence.split() for u in units(w) if u]
                    out += [(w, 0, y) for w in set(words)]
                    held.update(p for w in words for k in PIECES if len(w) >= k for p in ("^" + w[:k], w[-k:]))
                out += [(p, k, y) for p, times in held.items() for k in range(1, min(times, TIMES) + 1)]
            if out:
                w, kind, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(kind, pa.int32()), pa.array(y, pa.int64())], names=["w", "kind", "y"])

    counts = rows.mapInArrow(pieces, "w string, kind int, y long").groupBy("kind", "w").agg(F.sum("y").alias("toxic"), F.count("*").alias("all"))
    counts = common.durable(counts)
    least = max(3, int(np.ceil(np.log(5e7) / -np.log(toxic / n))))
    marks = [r["w"] for r in counts.where((F.col("kind") > 0) & (F.col("toxic") >= least) & (F.col("toxic") >= 0.98 * F.col("all"))).groupBy("w").agg(F.max("toxic").alias("toxic")).orderBy(F.desc("toxic"), "w").limit(TRAIN_WORDS).collect()]
    if not marks:  # too few examples for significance
        marks = [r["w"] for r in counts.where((F.col("kind") == 1) & (F.col("toxic") == F.col("all"))).orderBy(F.desc("toxic"), "w").limit(20).collect()]
    marked = set(marks)

    def has_mark(w: str) -> bool:
        return any("^" + w[:k] in marked or w[-k:] in marked for k in PIECES if len(w) >= k)

    words = counts.where("kind = 0")
    both = words.where("2 * toxic > all").orderBy(F.desc(F.col("toxic") / F.col("all") * F.least(F.col("toxic"), F.lit(50))), "w").limit(8 * TRAIN_WORDS).collect()
    good = [(r["w"], r["toxic"], r["all"] - r["toxic"]) for r in both if has_mark(r["w"])][:TRAIN_WORDS]
    known = {w for w, _, _ in good}
    clean = [r["w"] for r in words.where("all > toxic").orderBy(F.desc("all"), "w").limit(TRAIN_WORDS // 2).collect()]
    clean += [r["w"] for r in words.where("all > toxic").orderBy(F.xxhash64("w"), "w").limit(TRAIN_WORDS).collect()]
    clean = [w for w in clean if w not in known]
    if not good:
        return Machine.constant(False)
    doubtful = [(w, k) for w, _, k in good if k]  # stand in clean sentences too
    rng = np.random.default_rng(7)
    bad_words = [w for w, _, _ in good]
    stems = list(dict.fromkeys([*bad_words[:40], *[m.strip("^") for m in marks if m.startswith("^")]]))[: LANDMARKS // 3]
    machine = None
    extra: list[str] = []
    for last in (False, False, True):
        # landmarks: the insults' stems, the clean words closest to them so far, and others by chance
        near = extra[: LANDMARKS // 3]
        other = rng.choice(clean, min(LANDMARKS - len(stems) - len(near), len(clean)), replace=False).tolist()
        kernel = Kernel(list(dict.fromkeys([*stems, *near, *other])))
        negatives = list(dict.fromkeys(clean + extra))
        x = kernel.features(bad_words + [w for w, _ in doubtful] + negatives)
        y = np.concatenate([np.ones(len(bad_words)), -np.ones(len(doubtful) + len(negatives))])
        weight = [POSITIVE * np.log2([1 + n for _, n, _ in good]), POSITIVE * np.log2([1 + n for _, n in doubtful]), np.ones(len(negatives))]
        w, offset = train_svm(x, y, np.concatenate(weight))
        machine = Machine(kernel.numbers, kernel.weights(w), offset)
        del kernel, x
        common.give_back()
        if last:
            break
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def closest(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            table = shared.value.table()
            for part in parts:
                yield pd.DataFrame({"w": part["w"], "m": shared.value.margins(part["w"].to_list(), table)})

        nearest = words.where("all > toxic").select("w").mapInPandas(closest, "w string, m double").orderBy(F.desc("m"), "w").limit(TRAIN_WORDS // 3).collect()
        extra = list(dict.fromkeys([*[r["w"] for r in nearest if r["w"] not in known], *extra]))
    # the links: worst margins of the training documents against their labels
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    seen = rows.mapInArrow(lambda it: _margins(it, shared, ["y"]), "y int, margins array<double>").toPandas()
    common.discard(counts)
    common.discard(rows)
    margins, y = np.stack(seen["margins"].to_list()), seen["y"].to_numpy()
    alone = fit_link(margins[:, :1], y)
    unsure = logistic(margins[:, :1], alone) < SURE
    machine.links = (alone, fit_link(margins[unsure], y[unsure]))
    return machine


def fit_link(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of the label on margins, with a weak prior on the slopes."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([0.02] * x.shape[1] + [0.001])
    w = np.array([1.0 / x.shape[1]] * x.shape[1] + [0.0])
    for _ in range(60):
        p = logistic(x, tuple(w))
        h = (z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(prior)
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - y) + prior * w), -2, 2)
    return tuple(w.tolist())


def _margins(batches: Iterator[pa.RecordBatch], shared, carried: list[str]) -> Iterator[pa.RecordBatch]:
    machine = shared.value
    table, memory = machine.table(), {}
    for part in common.chunks(batches):
        margins = worst_margins(common.texts_of(part), machine, table, memory)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(margins.tolist(), pa.list_(pa.float64()))], names=[*carried, "margins"])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text)``: the probability that it is toxic. Null and
    empty texts score as texts without words."""
    return with_score(docs.select(F.col("doc_id").cast("long"), "text"), machine, "score").drop("text")


def with_score(docs: DataFrame, machine: Machine, name: str) -> DataFrame:
    """``docs`` with one more column, the score of its text; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memory = shared.value.table(), {}
        for part in common.chunks(batches):
            margins = worst_margins([x or "" for x in part.column(at).to_pylist()], shared.value, table, memory)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.probability(margins))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def fold(column: str, of: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted. Trained on
    labels outside the held-out fold (remainder 2 of 4). A null doc_id is not held out."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    machine = train(docs, labels, ~held)
    return score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
