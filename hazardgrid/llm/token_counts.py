"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers count the tokens. The first, over character classes, says where words
start; long inputs are cut into blocks whose state maps compose through a parallel prefix scan
(``word_cutter``). The second, over the bytes of a word, is compiled from the tokenizer's merges: each
of its transitions carries the number of tokens that the byte adds, which may be none or negative where
earlier tokens join. Transitions are compiled when a text first takes them, so the machine grows with
what occurs, not with the vocabulary; no library counts anything.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

from . import common  # noqa: E402
from .word_cutter import BLANK, LETTER, NUMBER, OTHER, QUOTE, SINGLE, SPACE, Cutter  # noqa: E402
from .word_tokens import Numbered  # noqa: E402

#: Words whose counts a worker remembers, and compiled transitions; beyond either it starts anew.
REMEMBERED = 500_000
TRANSITIONS = 600_000
LAST = 1 << 60


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the
    others in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class WordMachine:
    """Counts tokens of a word byte by byte.

    The encoding of a word's beginning is that of a shorter beginning and one more token, and the only
    such token is the one that, joined to the last token there, stays apart from it. So a state is all
    that later bytes can ask for: each end of the word that some token starts with, the last token
    before it, and how many tokens fewer there are up to it.
    """

    def __init__(self, spec: dict):
        names = byte_names()
        raw = lambda t: bytes(names[c] for c in t)
        vocabulary = {raw(t) for t in spec["vocab"] if all(c in names for c in t)}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["merges"]]
        self.merges: dict[tuple[bytes, bytes], int] = {}
        rank, halves = {}, {}
        for k, (left, right) in enumerate(pairs):
            a, b = raw(left), raw(right)
            if a + b in rank or a + b not in vocabulary or max(rank.get(a, -1), rank.get(b, -1)) >= k:
                raise ValueError("merges that give a token twice or before its parts")
            self.merges[a, b], rank[a + b], halves[a + b] = k, k, (a, b)
        self.first, self.last = {}, {}  # a token's first and last parts as it grows, and when
        self.tokens: set[bytes] = set()
        for token in [*(bytes([b]) for b in range(256)), *rank]:
            a, b = halves.get(token, (token, token))
            at = rank.get(token, -1)
            self.first[token] = (*self.first.get(a, ()), (token, at))
            self.last[token] = (*self.last.get(b, ()), (token, at))
            if at < 0 or (a in self.tokens and b in self.tokens and self.apart(a, b, at)):
                self.tokens.add(token)
        if any(bytes([b]) not in vocabulary for b in range(256)):
            raise ValueError("every byte is a token")
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.forget()

    def apart(self, a: bytes, b: bytes, until: int = LAST) -> bool:
        """Whether no merge across the border comes before both tokens are whole (up to ``until``)."""
        xs, ys = self.last[a], self.first[b]
        i = j = 0
        while True:
            grow_x = xs[i + 1][1] if i + 1 < len(xs) else LAST
            grow_y = ys[j + 1][1] if j + 1 < len(ys) else LAST
            across = self.merges.get((xs[i][0], ys[j][0]), LAST)
            # of equal ranks the leftmost pair merges first
            if across < grow_x and across <= grow_y and across < until:
                return False
            if grow_x == grow_y == LAST:
                return True
            if grow_x <= grow_y:
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        self.states: list[tuple] = [((b"", None, 0),)]
        self.number = {self.states[0]: 0}
        self.next: dict[int, tuple[int, int]] = {}
        self.known: dict[tuple, bool] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state under a byte: (state, tokens gained)."""
        c = bytes([byte])
        kept, found = [], None
        for end, before, fewer in self.states[state]:  # the longest end first
            token = end + c
            if found is None and token in self.tokens:
                fits = before is None or self.known.get((before, token))
                if fits is None:
                    fits = self.known[before, token] = self.apart(before, token)
                if fits:
                    found = token, fewer + 1
            if token in self.starts:
                kept.append((token, before, fewer))
        last, gain = found
        key = (*((end, before, fewer - gain) for end, before, fewer in kept), (b"", last, 0))
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        self.next[state << 8 | byte] = out = (to, gain)
        return out

    def count(self, words: list[str]) -> list[int]:
        out = []
        for word in words:
            if len(self.next) > TRANSITIONS:
                self.forget()
            state = tokens = 0
            step = self.next.get
            for byte in word.encode():
                state, gain = step(state << 8 | byte) or self.compile(state, byte)
                tokens += gain
            out.append(tokens)
        return out


class Counter:
    """Tokens of texts under a tokenizers file with byte-level words."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("this tokenizer cuts words in another way")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("this tokenizer merges in another way")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("this tokenizer's special strings take their surroundings in")
        self.cutter = Cutter(self.class_of)
        self.machine = WordMachine(model)
        self.number, self.counts = Numbered(), np.zeros(0, dtype=np.int64)

    @staticmethod
    def class_of(char: str) -> int:
        """As the library's own word pattern sees the character."""
        if char == " ":
            return SPACE
        if char == "'":
            return QUOTE
        if char in SINGLE:
            return SINGLE[char]
        cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(cut(before + char)) == 1:
                return kind
        return BLANK

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [q for p in pieces for q in p.split(s)]
                    extra[k] += len(pieces) - 1
                    if len(self.special) > 1:
                        raise ValueError("one special string is supported")
            parts += pieces
            owner += [k] * len(pieces)
        words, which, n_words = self.cutter.cut(parts)
        if not len(which):
            return extra
        if len(self.number) > REMEMBERED:
            self.number, self.counts = Numbered(), self.counts[:0]
        had = len(self.number)
        known = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        new = [words[k] for k in np.flatnonzero(known >= had).tolist()]
        self.counts = np.concatenate([self.counts, np.array(self.machine.count(new), dtype=np.int64)])
        # tokens up to each word by a prefix sum; a text's are those between its first and last word
        upto = np.concatenate([[0], np.cumsum(self.counts[known][which])])
        end = np.cumsum(n_words)
        np.add.at(extra, owner, upto[end] - upto[end - n_words])
        return extra


_compiled: dict[int, Counter] = {}


def counter_of(tokenizer_json: str) -> Counter:
    """A worker's machine outlives its tasks: what one has compiled serves the next."""
    key = hash(tokenizer_json)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Counter(tokenizer_json)
    return _compiled[key]


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 1024) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit. Null and
    empty texts have no tokens; a special string inside a text is one token."""
    common.prepare(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(content.value)
        for part in common.chunks(batches):
            size = pc.binary_length(part.column(1)).fill_null(0).cast(pa.int64())
            tokens = counter.count(common.texts_of(part))
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
