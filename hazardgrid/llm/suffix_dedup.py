"""Suffix-array dedup by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases. Each window of ``width`` bytes belongs to one
trigger, the smallest rolling hash of TRIGGER bytes among its first REACH positions, so equal windows
have equal triggers at equal offsets. The windows of one trigger form a run: the end of a phrase of
the dictionary, then the parse from that trigger on.

1. Runs are counted in Spark by the hash of the bytes that all their windows share (``core``) and by
   the hash of all their bytes (``full``). A run whose core is nowhere else is unique; a run whose
   full context is elsewhere repeats throughout. Both are decided without suffixes.
2. What is left are the ends of repeated passages. Their contexts meet by core; the suffix array of
   the dictionary's phrases and the order of the parse's right contexts combine into corpus order,
   where the common prefix of neighbours says which windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BYTE_BASE, U64, mix

TRIGGER = 16
REACH = 128
#: Longer texts are parsed in pieces that overlap by a window.
PIECE = 2 << 20

FULL, OPEN, OPEN_FULL = 1, 2, 3


def parse_runs(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, trigger, core hash, full hash) of each run of windows."""
    raw, begin = common.joined_bytes(texts, b"\0")
    out = np.zeros(0, dtype=np.int64)
    if len(raw) < width:
        return out, out, out, out, out.astype(U64), out.astype(U64)
    prefix = common.prefix_hash(raw.astype(U64) + U64(1), BYTE_BASE)
    rolling = mix(common.window_hash(prefix, TRIGGER, BYTE_BASE))
    trigger = common.sliding_argmin(rolling, REACH)
    n = len(raw) - width + 1
    sizes = np.diff(begin) - 1
    inside = np.zeros(n + 1, dtype=np.int8)
    has = sizes >= width
    np.add.at(inside, begin[:-1][has], 1)
    np.add.at(inside, begin[:-1][has] + sizes[has] - width + 1, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    a, b = common.runs_of(inside, trigger[:n])
    t = trigger[a]
    core = mix(common.range_hash(prefix, t, t + width - REACH + 1, BYTE_BASE))
    full = mix(common.range_hash(prefix, a, b - 1 + width, BYTE_BASE) + (t - a).astype(U64) * U64(1 << 32) + (b - a).astype(U64))
    text = np.searchsorted(begin, a, side="right") - 1
    first = begin[text]
    return text, a - first, b - a, t - first, core, full


def _pieces(part: pa.RecordBatch, width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts or their pieces, the row of each and its offset."""
    texts, rows, offsets = [], [], []
    for k, text in enumerate(common.bytes_of(part)):
        for at in range(0, max(1, len(text) - width + 1), PIECE):
            texts.append(text[at : at + PIECE + width - 1])
            rows.append(k)
            offsets.append(at)
    return texts, np.array(rows), np.array(offsets)


def _block(kind: int, bucket: int, cols: list[np.ndarray]) -> tuple:
    return (bucket, kind, *(c.tobytes() for c in cols))


def _parse(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs by core, a row for each bucket. Runs that this chunk holds twice are decided here and
    sent once."""
    names = ["bucket", "twice", "keys", "counts", "starts", "sizes", "triggers", "cores", "fulls"]
    for part in common.chunks(batches):
        keys = np.frombuffer(b"".join(part.column(0).to_pylist()), dtype="V16")
        texts, row, offset = _pieces(part, width)
        text, start, size, trigger, core, full = parse_runs(texts, width)
        if not len(text):
            continue
        start, trigger, doc = start + offset[text], trigger + offset[text], row[text]
        order = np.argsort(full, kind="stable")
        head = np.concatenate([[True], full[order][1:] != full[order][:-1]])
        more = np.diff(np.append(np.flatnonzero(head), len(order)))
        sent = np.sort(order[head])
        twice = np.zeros(len(order), dtype=bool)
        twice[order] = np.repeat(more > 1, more)
        rows = []
        bucket = (core[sent] % U64(buckets)).astype(np.int64)
        for again in (False, True):
            mine = sent[twice[sent] == again]
            at = bucket[twice[sent] == again]
            by = np.argsort(at, kind="stable")
            mine, at = mine[by], at[by]
            cuts = np.searchsorted(at, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                i = mine[cuts[k] : cuts[k + 1]]
                docs, count = np.unique(doc[i], return_counts=True)
                rows.append(_block(int(again), int(k), [keys[docs], count.astype("<u4"), start[i].astype("<u4"), size[i].astype("<u2"), (trigger[i] - start[i]).astype("<u2"), core[i], full[i]]))
        left = np.ones(len(order), dtype=bool)
        left[sent] = False
        i = np.flatnonzero(left)
        if len(i):
            docs, count = np.unique(doc[i], return_counts=True)
            rows.append(_block(2, int(core[i[0]] % U64(buckets)), [keys[docs], count.astype("<u4"), start[i].astype("<u4"), size[i].astype("<u2"), (trigger[i] - start[i]).astype("<u2"), core[:0], full[:0]]))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=names)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def key_array(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * 16).astype("<i4").tobytes()), pa.py_buffer(keys.tobytes())])


def _decide(table: pa.Table) -> pa.Table:
    """The runs of a bucket that repeat or may: FULL runs repeat throughout, OPEN ones share their
    core with another context; one of each context is OPEN_FULL if it is both."""
    mult = np.repeat(np.array(table.column("twice").to_pylist(), dtype=np.int64), [len(x) // 4 for x in table.column("starts").to_pylist()])
    keys = np.repeat(_joined(table, "keys", "V16"), _joined(table, "counts", "<u4"))
    start, size, lead = (_joined(table, n, k).astype(np.int64) for n, k in (("starts", "<u4"), ("sizes", "<u2"), ("triggers", "<u2")))
    flag = np.where(mult == 2, FULL, 0).astype(np.int8)
    cores, fulls = _joined(table, "cores", "<u8"), _joined(table, "fulls", "<u8")
    sent = np.flatnonzero(mult < 2)
    core_of = np.zeros(len(keys), dtype=np.int64)
    if len(sent):
        core_of[sent] = cores.view(np.int64)
        order = np.lexsort((fulls, cores))
        c, f = cores[order], fulls[order]
        new_core = np.concatenate([[True], c[1:] != c[:-1]])
        new_full = new_core | np.concatenate([[True], f[1:] != f[:-1]])
        at = np.flatnonzero(new_full)
        count = np.add.reduceat(1 + mult[sent][order], at)
        contexts = np.add.reduceat(new_full.astype(np.int64), np.flatnonzero(new_core))
        contested = np.repeat(contexts > 1, np.diff(np.append(np.flatnonzero(new_core), len(c))))
        repeats = np.repeat(count > 1, np.diff(np.append(at, len(c))))
        flag[sent[order]] = np.where(repeats, FULL, 0) + np.where(contested & new_full, OPEN, 0)
    on = flag > 0
    return pa.table({"key": key_array(keys[on]), "flag": pa.array(flag[on].astype(np.int32)), "s": pa.array(start[on], pa.int32()), "size": pa.array(size[on], pa.int32()), "lead": pa.array(lead[on], pa.int32()), "core": pa.array(core_of[on])})


def _contexts(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of OPEN runs, a row for each bucket."""
    for part in common.chunks(batches):
        held: dict[int, list[tuple]] = {}
        for key, text, runs in zip(part.column("key").to_pylist(), common.bytes_of(part), part.column("runs").to_pylist(), strict=True):
            for r in runs or ():
                if r["flag"] >= OPEN:
                    context = text[r["s"] : r["s"] + r["size"] - 1 + width]
                    held.setdefault(r["core"] % buckets, []).append((key, r["flag"] == OPEN_FULL, r["s"], r["size"], r["lead"], len(context), context))
        if held:
            cols: list[list] = [[] for _ in range(8)]
            for bucket, rows in held.items():
                key, done, s, size, lead, n, context = zip(*rows, strict=True)
                packed = [b"".join(key), np.array(done, dtype=np.uint8).tobytes(), *(np.array(x, dtype="<u4").tobytes() for x in (s, size, lead, n)), b"".join(context)]
                for col, x in zip(cols, [bucket, *packed], strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "done", "starts", "sizes", "leads", "lengths", "bytes"])


def phrase_suffix_ranks(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffix array order of a dictionary: for each byte, the rank of the suffix of its phrase from
    there on; equal suffixes of different phrases have one rank. By prefix doubling."""
    n = len(raw)
    end = np.repeat(begin[1:], np.diff(begin))
    left = end - np.arange(n)
    rank = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([raw.astype(np.int64) + 1, np.zeros(8, dtype=np.int64)])
    for k in range(7):  # seven bytes fit one sort key of 63 bits
        rank = rank * 257 + np.where(left > k, padded[k : k + n], 0)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
    span, most = 7, int(left.max(initial=0))
    while span < most:
        after = np.zeros(n, dtype=np.int64)
        after[:-span] = rank[span:] if n > span else 0
        rank = np.unique(rank * (n + 2) + np.where(left > span, after, 0), return_inverse=True)[1].astype(np.int64) + 1
        span *= 2
    return rank


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair, lo < hi."""
    levels = [values]
    while 2 << len(levels) - 1 <= len(values):
        step = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    out = np.empty(len(lo), dtype=values.dtype)
    level = np.frexp(hi - lo)[1] - 1
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k)])
    return out


def repeated_windows(contexts: list[bytes], leads: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start in it, whether it repeats) for each window of each context.

    ``leads`` are the triggers' offsets. A window is the suffix of a phrase (up to and with its
    trigger) and a prefix of the parse from the trigger on. Sorted by the rank of the first in the
    dictionary's suffix array and by the rank of the second among the parse's suffixes, windows stand
    in corpus order; neighbours with one phrase suffix share as many bytes as the parse suffixes
    between them do.
    """
    phrases = [c[: d + TRIGGER] for c, d in zip(contexts, leads.tolist(), strict=True)]
    dictionary = {p: k for k, p in enumerate(dict.fromkeys(phrases))}
    phrase = np.array([dictionary[p] for p in phrases])
    begin = np.zeros(len(dictionary) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in dictionary], out=begin[1:])
    suffix = phrase_suffix_ranks(np.frombuffer(b"".join(dictionary), dtype=np.uint8), begin)
    right = np.frombuffer(b"".join(c[d : d + width].ljust(width, b"\0") for c, d in zip(contexts, leads.tolist(), strict=True)), dtype=f"V{width}")
    order, at = np.unique(right, return_inverse=True)
    table = np.frombuffer(order.tobytes(), dtype=np.uint8).reshape(len(order), width)
    differ = table[1:] != table[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)  # between neighbouring parse suffixes
    who = np.repeat(np.arange(len(contexts)), sizes)
    start = common.ramp(sizes)
    key = suffix[begin[phrase[who]] + start] * (len(order) + 1) + at[who]
    corpus = np.argsort(key, kind="stable")
    who_c, group = who[corpus], key[corpus] // (len(order) + 1)
    r = at[who_c]
    near = np.flatnonzero(group[1:] == group[:-1])
    common_prefix = np.full(len(near), width, dtype=np.int64)
    apart = r[near] < r[near + 1]
    if apart.any():
        common_prefix[apart] = _range_min(shared, r[near][apart], r[near + 1][apart])
    need = width - (leads[who_c] - start[corpus])
    hit = near[common_prefix >= need[near]]
    again = np.zeros(len(who), dtype=bool)
    again[corpus[hit]] = again[corpus[hit + 1]] = True
    return who, start, again


def _resolve(table: pa.Table, width: int) -> pa.Table:
    common.give_back()
    keys, done = _joined(table, "keys", "V16"), _joined(table, "done", "u1").astype(bool)
    start, size, lead, length = (_joined(table, n, "<u4").astype(np.int64) for n in ("starts", "sizes", "leads", "lengths"))
    raw = b"".join(table.column("bytes").to_pylist())
    end = np.cumsum(length)
    contexts = [raw[e - n : e] for e, n in zip(end.tolist(), length.tolist(), strict=True)]
    who, at, again = repeated_windows(contexts, lead, size, width)
    a, b = common.runs_of(again & ~done[who], who)
    run = who[a]
    return pa.table({"key": key_array(keys[run]), "s": pa.array(start[run] + at[a], pa.int32()), "e": pa.array(start[run] + at[b - 1] + width if len(a) else at[:0], pa.int32())})


def _apply(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in common.chunks(batches):
        rows = []
        for text, n, runs, spans in zip(common.bytes_of(part), part.column("n").to_pylist(), part.column("runs").to_pylist(), part.column("spans").to_pylist(), strict=True):
            change = np.zeros(len(text) + 1, dtype=np.int64)
            if n > 1 and len(text) >= width:
                change[0], change[-1] = 1, -1
            else:
                cut = [(r["s"], r["s"] + r["size"] - 1 + width) for r in runs or () if r["flag"] != OPEN] + [(x["s"], x["e"]) for x in spans or ()]
                if cut:
                    s, e = zip(*cut, strict=True)
                    np.add.at(change, list(s), 1)
                    np.add.at(change, list(e), -1)
            gone = np.cumsum(change[:-1]) > 0
            n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[:1].sum() if len(gone) else 0))
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if n_spans else text
            rows.append((len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def suffix_dedup(docs: DataFrame, width: int = 200) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept_text) for each different text of
    ``docs(doc_id, text)``; ``common.text_key`` names a row's.

    A byte goes if a string of ``width`` bytes covers it that also starts anywhere else, in the same
    text or another row; strings are judged on the input and may overlap. A text with copies loses
    all its bytes if it has ``width`` of them. Texts, their pieces and hot passages are spread by
    hash; texts move once, the rest are hashes and the contexts of passages' ends. kept_text drops
    the parts of characters that a cut splits.
    """
    assert width >= REACH + TRIGGER
    buckets = common.shuffle_width(docs.sparkSession)
    texts = common.distinct_texts(docs)
    block = "bucket int, twice int, keys binary, counts binary, starts binary, sizes binary, triggers binary, cores binary, fulls binary"
    blocks = texts.mapInArrow(lambda it: _parse(it, width, buckets), block)
    runs = blocks.groupBy("bucket").applyInArrow(_decide, "key binary, flag int, s int, size int, lead int, core long")
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("flag", "s", "size", "lead", "core")).alias("runs"))
    held = texts.join(runs, "key", "left")
    block = "bucket int, keys binary, done binary, starts binary, sizes binary, leads binary, lengths binary, bytes binary"
    contexts = held.mapInArrow(lambda it: _contexts(it, width, buckets), block)
    spans = contexts.groupBy("bucket").applyInArrow(lambda t: _resolve(t, width), "key binary, s int, e int")
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return held.join(spans, "key", "left").mapInArrow(lambda it: _apply(it, width), schema)


def suffix_dedup_rows(docs: DataFrame, width: int = 200) -> DataFrame:
    """The digest of ``suffix_dedup`` for each row: doc_id (null included), n_bytes, n_removed,
    n_spans, kept_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("key"))
    return rows.join(suffix_dedup(docs, width), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
