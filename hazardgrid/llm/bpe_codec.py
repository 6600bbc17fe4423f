"""Byte-level BPE encoding and decoding: higher-order functions fold ranked merges over distinct words.

Texts are cut into words by the tokenizer's pattern, and words that are no tokens into parts that no token
lies across; each different part of a task goes once, as an array of byte tokens, through a fold that applies
the merge of lowest rank until none is left. Ranks come from a literal map in the plan. Documents are then put together from their words'
tokens, and decoded by concatenating the tokens' bytes. Each text is read and cut once, and nothing is
shuffled, broadcast or collected but the vocabulary.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_cutter import Cutter, pattern_class
from .word_tokens import Numbered

#: Different words that a task remembers; beyond that it starts anew.
REMEMBERED = 600_000
#: Bytes of the texts that are cut at once.
CHUNK = 1 << 19
#: Words of a row of the fold.
FOLD_WORDS = 4096
#: Longer parts (bytes) are looked through for tokens one by one, and merged by a heap if they stay longer.
LONG = 96
#: Bytes of the longest runs that tell where tokens lie, bits of a table of runs, and bytes that are looked at at once.
RUN, RUN_BITS, AT_ONCE = 6, 21, 1 << 18
#: A value between words, which no run of a token holds.
BETWEEN = 300
#: Fixed value: the pattern that the transducer stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a token id, and of the smallest table of merges.
BITS = 17
NONE = (1 << BITS) - 1


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def splitter(pattern: str):
    """A function from texts to (different words, which each word is, words of each text)."""
    if pattern == PATTERN:
        return Cutter(pattern_class).cut
    general = regex.compile(pattern).findall

    def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        number = Numbered()
        which = [np.array([number[w] for w in general(t)], dtype=np.int64) for t in texts]
        return list(number), np.concatenate([np.zeros(0, dtype=np.int64), *which]), np.array([len(w) for w in which])

    return cut


def merges_of(ranks: dict[bytes, int]) -> tuple[list[tuple[int, int, int]], dict[str, list[int]]]:
    """(left, right, merged) of the last merge of each token, and the tokens that can be whole words, which are
    looked up before any merge, as the library does. Merges in a longer word go as they go in the token alone, so no
    other pair ever makes it; tokens that merging their own bytes doesn't give are whole words only."""
    merges, whole = [], {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
        with contextlib.suppress(UnicodeDecodeError):  # parts of a character are no word
            whole[token.decode()] = [rank]
    return merges, whole


def rank_table(merges: list[tuple[int, int, int]], ids: int) -> tuple[list[int], list[int]]:
    """Literal map of the merges: entry shift[left] + right of the table holds left and merged, if there
    is such a merge. The rows of the left tokens lie over each other without meeting."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for left, right, merged in merges:
        rows.setdefault(left, []).append((right, merged))
    size = 1 << max(BITS, (2 * len(merges)).bit_length())
    table = np.full(size + ids + 1, NONE << BITS, dtype=np.int64)
    used = np.zeros(len(table), dtype=bool)
    shift = np.zeros(ids + 1, dtype=np.int64)
    rng = np.random.default_rng(1)
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        right = np.array([a for a, _ in row])
        at = int(rng.integers(0, size))
        while used[at + right].any():
            at = int(rng.integers(0, size))
        used[at + right] = True
        table[at + right] = [left << BITS | merged for _, merged in row]
        shift[left] = at
    return shift.tolist(), table.tolist()


def _let(value: Column, body) -> Column:
    """Binds an array or number to a lambda variable, so that it is computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def fold_merges(words: Column, shift: list[int], table: list[int]) -> Column:
    """``words``: array of arrays of byte tokens, each between two end marks (the id after the last one).
    In the result the lower BITS bits of an element are a token's id; the rank of its merge with
    the next one stands above them, so after a merge two ranks are looked up."""
    shift_of, entry_of = F.from_json(F.lit(json.dumps(shift)), "array<int>"), F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    end = len(shift) - 1

    def ranked(x: Column, y: Column) -> Column:
        x_long = x.cast("long")
        return F.shiftleft(F.get(entry_of, F.get(shift_of, x) + y).bitwiseXOR(F.shiftleft(x_long, BITS)), BITS).bitwiseOR(x_long)

    def token(e: Column) -> Column:
        return e.bitwiseAND(F.lit(NONE)).cast("int")

    def step(a: Column) -> Column:
        def merge(least: Column) -> Column:
            def put(i: Column) -> Column:
                new = F.shiftright(least, BITS).cast("int")
                pair = F.array(ranked(token(F.get(a, i - 2)), new), ranked(new, token(F.get(a, i + 1))))
                return F.flatten(F.array(F.slice(a, F.lit(1), i - 2), pair, F.slice(a, i + 2, F.size(a))))

            return F.when(least >= F.lit(NONE << BITS), a).otherwise(_let(F.array_position(a, least).cast("int"), put))

        return _let(F.array_min(a), merge)

    def fold(a: Column) -> Column:
        start = F.zip_with(a, F.slice(a, F.lit(2), F.size(a)), lambda x, y: ranked(x, F.coalesce(y, F.lit(end))))
        rounds = lambda x: F.aggregate(F.sequence(F.lit(4), F.size(x)), x, lambda acc, _: step(acc))
        return _let(start, lambda x: F.when(F.array_min(x) >= F.lit(NONE << BITS), x).otherwise(rounds(x)))

    return F.transform(words, fold)


def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words with BETWEEN behind each, where each word begins, its length)."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(words), BETWEEN, dtype=np.uint16)
    out[np.repeat(first, size) + common.ramp(size)] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return out, first, size


def _runs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n values from each place on) for n from 2 to RUN."""
    hashed, power = np.zeros(len(values), dtype=np.uint32), 1
    for n in range(1, min(RUN, len(values)) + 1):
        hashed = hashed[: len(values) - n + 1] + (values[n - 1 :].astype(np.uint32) + np.uint32(1)) * np.uint32(power)
        power = power * 2654435761 & 0xFFFFFFFF
        if n > 1:
            yield n, (hashed * np.uint32(2246822519)) >> np.uint32(32 - RUN_BITS)


class Seams:
    """Places in words that no token lies across: parts between them are merged apart from each other. A token
    of fewer bytes than RUN is found as it is, a longer one by its runs of RUN bytes; these, and runs that hash
    alike, may keep parts together that no token joins, but never part what one could."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [t for t in ranks if len(t) > 1]
        self.held = {n: np.zeros(1 << RUN_BITS, dtype=bool) for n in range(2, RUN + 1)}
        values, first, size = _laid_out(tokens)
        left = np.repeat(first + size, size + 1) - np.arange(len(values))  # bytes of the token from here on
        whole = np.repeat(size, size + 1)
        for n, run in _runs(values):
            some = (left[: len(run)] >= n) & ((whole[: len(run)] == n) | (n == RUN))
            self.held[n][run[some]] = True

    def parts(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """(the parts of all words in turn, how many each word has)."""
        out: list[bytes] = []
        counts = [np.zeros(0, dtype=np.int64)]
        group = np.cumsum([len(w) for w in words]) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)]
        for some in (words[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b):
            values, first, size = _laid_out(some)
            begins = np.ones(len(values), dtype=bool)
            for n, run in _runs(values):
                hit = ~self.held[n][run]
                for k in range(1, n):
                    begins[k : k + len(run)] &= hit
            begins[first], begins[first + size] = True, False
            at = np.flatnonzero(begins)
            stop = np.append(at[1:], len(values))
            stop = stop - (values[stop - 1] == BETWEEN)
            raw = values.astype(np.uint8).tobytes()
            out += [raw[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
            counts.append(np.diff(np.append(np.searchsorted(at, first), len(at))))
        return out, np.concatenate(counts)


class Pieces:
    """Parts of long words that are merged apart from each other."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.tokens = ahocorasick.Automaton()
        for token in ranks:
            if len(token) > 1:
                self.tokens.add_word(token.decode("latin-1"), len(token))
        self.tokens.make_automaton()
        self.merges = {(left, right): merged for left, right, merged in merges}
        self.one = [ranks[bytes([i])] for i in range(256)]

    def of(self, word: bytes) -> list[bytes]:
        """Parts that no token crosses wherever it might lie."""
        inside = np.zeros(len(word) + 1, dtype=np.int32)
        for last, size in self.tokens.iter(word.decode("latin-1")):
            inside[last - size + 2] += 1
            inside[last + 1] -= 1
        cuts = [*np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merged(self, part: bytes) -> list[int]:
        """Ids of a part that is long still, by a heap of its pairs: the fold has nothing left to do."""
        ids: list[int] = [self.one[b] for b in part]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.merges.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids):
                    new = self.merges.get((ids[k], ids[after[k]]))
                    if new is not None:
                        heapq.heappush(heap, (new, k))
        return [x for x in ids if x >= 0]


def framed(words: list[str | bytes], one: np.ndarray, merged: dict, end: int) -> pa.ListArray:
    """Byte tokens of each word, or its ids in ``merged``, between two end marks."""
    raw = [w if isinstance(w, bytes) else w.encode() for w in words]
    known = [k for k, w in enumerate(words) if w in merged] if merged else []
    size = np.array([len(w) for w in raw], dtype=np.int64)
    size[known] = [len(merged[words[k]]) for k in known]
    ends = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.full(ends[-1], end, dtype=np.int32)
    for k in known:
        raw[k] = bytes(size[k])
    out[np.repeat(ends[:-1] + 1, size) + common.ramp(size)] = one[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    for k in known:
        out[ends[k] + 1 : ends[k + 1] - 1] = merged[words[k]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def bpe_roundtrip(docs: DataFrame, rank_lines: bytes, pattern: str = PATTERN) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_tokens, ids_sha256, decoded_sha256,
    n_bytes. ``rank_lines`` is the content of a rank file. Null and empty texts have no ids. Words of
    any length are encoded exactly."""
    return _coded(docs, rank_lines, pattern, digest=True)


def bpe_encode(docs: DataFrame, rank_lines: bytes, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text, and the bytes they decode to."""
    return _coded(docs, rank_lines, pattern, digest=False)


def _coded(docs: DataFrame, rank_lines: bytes, pattern: str, digest: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    common.prepare(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", "400000")  # the literal map is not worth printing; other plans of the session are
    ranks = read_ranks(rank_lines)
    end = max(ranks.values()) + 1
    if end >= NONE:
        raise ValueError(f"ids of {BITS} bits at most")
    merges, _ = merges_of(ranks)
    vocabulary = [b""] * end
    for token, rank in ranks.items():
        vocabulary[rank] = token
    shared = spark.sparkContext.broadcast((vocabulary, np.array(merges, dtype=np.int32).reshape(-1, 3)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of new parts to fold; the last row of a chunk has its documents as numbers of parts."""
        vocabulary, merges = shared.value
        ranks = {token: rank for rank, token in enumerate(vocabulary) if token}
        one = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        cut, seams = splitter(pattern), Seams(ranks)
        pieces: Pieces | None = None
        numbers = Numbered()
        names = ["fresh", "words", "doc_ids", "counts", "which"]
        for batch in common.chunks(batches, limit=CHUNK):
            words, which, counts = cut(common.texts_of(batch))
            fresh = len(numbers) > REMEMBERED or not len(numbers)
            if fresh:  # of each word its parts: size of them from first on in flat
                numbers, parts = Numbered(), Numbered()
                first, size, flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<i4")
            had, had_parts = len(numbers), len(parts)
            which = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))[which] if len(words) else np.zeros(0, dtype=np.int32)
            new = list(islice(reversed(numbers), len(numbers) - had))[::-1]
            del words
            raw = [w.encode() for w in new]
            token = np.array([w in ranks for w in raw], dtype=bool)
            cut_up, of_each = seams.parts([w for w, known in zip(raw, token.tolist(), strict=True) if not known])
            # ids that need no fold: of tokens, known by their word, and of parts that stay long
            ready: dict[str | bytes, list[int]] = {w: [ranks[x]] for w, x, known in zip(new, raw, token.tolist(), strict=True) if known}
            if max(map(len, cut_up), default=0) > LONG:
                pieces = pieces or Pieces(ranks, merges.tolist())
                finer = [pieces.of(x) if len(x) > LONG else [x] for x in cut_up]
                of_each = np.add.reduceat([len(x) for x in finer], np.cumsum(of_each) - of_each)
                cut_up = [x for f in finer for x in f]
                ready |= {x: pieces.merged(x) for x in cut_up if len(x) > LONG}
            n = np.ones(len(new), dtype=np.int64)
            n[~token] = of_each
            start = np.cumsum(n) - n
            own = np.zeros(int(n.sum()), dtype="<i4")
            own[start[token]] = [parts[w] for w in islice(ready, int(token.sum()))]
            own[np.repeat(start[~token], of_each) + common.ramp(of_each)] = np.fromiter(map(parts.__getitem__, cut_up), dtype="<i4", count=len(cut_up))
            first, size, flat = np.concatenate([first, start + len(flat)]), np.concatenate([size, n.astype(np.int32)]), np.concatenate([flat, own])
            n = size[which]
            ends = np.append(0, np.cumsum(n, dtype=np.int64))[np.append(0, np.cumsum(counts)).astype(np.int64)]
            own = flat[np.repeat(first[which], n) + common.ramp(n)]
            spelled = framed(list(islice(reversed(parts), len(parts) - had_parts))[::-1], one, ready, end)
            del new, raw, cut_up, ready, n, start, which  # the rows are on their way for long
            cuts = list(range(0, len(spelled), FOLD_WORDS)) or [0]
            offsets = pa.array([*cuts, len(spelled)], pa.int32())
            none = [None] * (len(cuts) - 1)
            cols = [pa.array([fresh] + [False] * len(none)), pa.ListArray.from_arrays(offsets, spelled), pa.array([*none, batch.column(0).to_pylist()], pa.list_(pa.int64()))]
            for x in (np.diff(ends).astype("<i4"), own):
                cols.append(pa.array([*none, x.tobytes()], pa.binary()))
            for k in range(len(cuts)):
                yield pa.RecordBatch.from_arrays([c.slice(k, 1) for c in cols], names=names)
            del cols, spelled, own, ends
        numbers = parts = first = size = flat = None
        common.give_back()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[0]
        text_of = list(map(str, range(len(vocabulary)))).__getitem__
        bytes_of = vocabulary.__getitem__
        first, size, flat = [], [], []
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"] if digest else ["doc_id", "ids", "decoded"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] if digest else [pa.list_(pa.int32()), pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("fresh")[k].as_py():
                    first, size, flat = [], [], []
                found = batch.column("words").slice(k, 1).flatten()
                ends = found.offsets.to_numpy().astype(np.int64)
                first.append(ends[:-1] - ends[0] + 1 + sum(map(len, flat)))
                size.append(np.diff(ends) - 2)
                flat.append((found.flatten().to_numpy() & NONE).astype(np.int32))
                if not batch.column("doc_ids")[k].is_valid:
                    continue
                first, size, flat = [np.concatenate(first)], [np.concatenate(size)], [np.concatenate(flat)]
                which = np.frombuffer(batch.column("which")[k].as_buffer(), dtype="<i4")
                rows, at = [], 0
                for stop in np.cumsum(np.frombuffer(batch.column("counts")[k].as_py(), dtype="<i4")).tolist():
                    w = which[at:stop]
                    at = stop
                    n = size[0][w]
                    own = flat[0][np.repeat(first[0][w], n) + common.ramp(n)].tolist()
                    raw = b"".join(map(bytes_of, own))
                    rows.append((len(own), hashlib.sha256(",".join(map(text_of, own)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)) if digest else (own, raw))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").slice(k, 1).flatten(), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)
                del rows, cols
        first = size = flat = found = None
        common.give_back()

    numbered = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(number, "fresh boolean, words array<array<int>>, doc_ids array<long>, counts binary, which binary")
    done = numbered.withColumn("words", fold_merges(F.col("words"), *rank_table(merges, end)))
    return done.mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" if digest else "doc_id long, ids array<int>, decoded binary")
