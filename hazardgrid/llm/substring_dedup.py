"""Substring dedup: Rabin-Karp hashes of every window of so many words, counted in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, UNIT_BASE, mix
from .word_tokens import Numbered

#: Of the words' hashes.
SEED = 42
#: Words of the pieces whose smallest hash deals a window out.
GRAM = 4


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word of each text in turn, and the text's index of each word. A polynomial of the
    bytes modulo 2**64 would give the same value to some long words of two letters."""
    number = Numbered()
    which = [np.fromiter(map(number.__getitem__, t.split()), dtype=np.int64) for t in texts]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), dtype=U64, count=len(number))
    if not which:
        return hashes, np.zeros(0, dtype=np.int64)
    return hashes[np.concatenate(which)], np.repeat(np.arange(len(texts)), [len(w) for w in which])


def _windows(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of windows, a row for each bucket. Neighbouring windows share their smallest piece of
    GRAM words and so go to one bucket as a run, which is stored as document, start and hashes."""
    names = ["bucket", "keys", "lows", "runs", "starts", "sizes", "hashes"]
    for part in common.chunks(batches):
        part = part.filter(part.column(1).is_valid())
        if not part.num_rows:
            continue
        keys = np.frombuffer(b"".join(part.column(0).to_pylist()), dtype="V16")
        lows = part.column(1).to_numpy(zero_copy_only=False)
        word, doc = word_hashes(common.bytes_of(part))
        n = len(word) - width + 1
        if n <= 0:
            continue
        whole = doc[:n] == doc[width - 1 :]
        first = np.searchsorted(doc, np.arange(part.num_rows))  # of each document
        hashes = mix(common.window_hash(common.prefix_hash(word, UNIT_BASE), width, UNIT_BASE))
        grams = mix(common.window_hash(common.prefix_hash(word, UNIT_BASE), GRAM, UNIT_BASE))
        anchor = common.sliding_argmin(grams, width - GRAM + 1)
        # map-side combine: a window that a smaller document of this chunk has goes without counting
        order = np.lexsort((lows[doc[:n]], hashes))
        order = order[whole[order]]
        h, low = hashes[order], lows[doc[order]]
        head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
        least = low[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
        sent, gone = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        sent[order], gone[order] = low == least, low > least
        a, b = common.runs_of(sent, anchor, doc[:n])
        bucket = (grams[anchor[a]] % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, b, bucket = a[order], b[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows: list[tuple] = []
        for k in np.flatnonzero(np.diff(cuts)):
            s, e = a[cuts[k] : cuts[k + 1]], b[cuts[k] : cuts[k + 1]]
            docs, count = np.unique(doc[s], return_counts=True)
            at = np.repeat(s, e - s) + common.ramp(e - s)
            rows.append((int(k), keys[docs].tobytes(), lows[docs].astype("<i8").tobytes(), count.astype("<u4").tobytes(), (s - first[doc[s]]).astype("<u4").tobytes(), (e - s).astype("<u2").tobytes(), hashes[at].tobytes()))
        a, b = common.runs_of(gone, doc[:n])
        if len(a):  # already decided; negative size marks them
            docs, count = np.unique(doc[a], return_counts=True)
            rows.append((-1 - int(grams[0] % U64(buckets)), keys[docs].tobytes(), b"", count.astype("<u4").tobytes(), (a - first[doc[a]]).astype("<u4").tobytes(), (b - a).astype("<u4").tobytes(), b""))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)


def _count(table: pa.Table, width: int) -> pa.Table:
    """The spans (in words) of a bucket's windows that start in a smaller document too."""
    counts = _joined(table, "runs", "<u4").astype(np.int64)
    keys = np.repeat(_joined(table, "keys", "V16"), counts)
    start = _joined(table, "starts", "<u4").astype(np.int64)
    if table.column("bucket")[0].as_py() < 0:
        size = _joined(table, "sizes", "<u4").astype(np.int64)
        return _spans(keys, start, start + size - 1 + width)
    size = _joined(table, "sizes", "<u2").astype(np.int64)
    hashes = _joined(table, "hashes", "<u8")
    low = np.repeat(np.repeat(_joined(table, "lows", "<i8"), counts), size)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    least = np.minimum.reduceat(low[order], head)
    gone = np.zeros(len(h), dtype=bool)
    gone[order] = low[order] > np.repeat(least, np.diff(np.append(head, len(h))))
    run = np.repeat(np.arange(len(size)), size)
    at = np.repeat(start, size) + common.ramp(size)
    a, b = common.runs_of(gone, run)
    return _spans(keys[run[a]], at[a], at[b - 1] + width) if len(a) else _spans(keys[:0], start[:0], start[:0])


def _spans(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    key = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((np.arange(len(keys) + 1) * 16).astype("<i4").tobytes()), pa.py_buffer(keys.tobytes())])
    return pa.table({"key": key, "s": pa.array(start, pa.int32()), "e": pa.array(end, pa.int32())})


def kept_mask(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units no span covers; spans may overlap."""
    change = np.zeros(n + 1, dtype=np.int32)
    if spans:
        np.add.at(change, [x["s"] for x in spans], 1)
        np.add.at(change, [x["e"] for x in spans], -1)
    return np.cumsum(change[:n]) == 0


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for part in common.chunks(batches):
        rows = []
        for text, spans, n, n_ids in zip(common.bytes_of(part), part.column("spans").to_pylist(), part.column("n").to_pylist(), part.column("n_ids").to_pylist(), strict=True):
            words = text.split()
            keep = kept_mask(len(words), spans)
            kept = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            out = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), out.decode(), sha(out), sha(b" ".join(words)) if n_ids < n else None))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("low"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True))], names=["key", "low", "n_words", "n_removed", "kept_text", "kept_sha256", "whole_sha256"])


def removal_spans(texts: DataFrame, width: int) -> DataFrame:
    """(key, s, e): spans of words of ``texts(key, low, ...)`` that windows of ``width`` words cover
    which also start in a text of a smaller document."""
    buckets = common.shuffle_width(texts.sparkSession) // 2
    block = "bucket int, keys binary, lows binary, runs binary, starts binary, sizes binary, hashes binary"
    blocks = texts.mapInArrow(lambda it: _windows(it, width, buckets), block)
    return blocks.groupBy("bucket").applyInArrow(lambda t: _count(t, width), "key binary, s int, e int")


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of ``width`` words covers it whose words also start in a row with a
    smaller doc_id; windows are judged on the input. Every window of every text is hashed (64 bits
    beside its bucket) and counted. Equal texts are one text with the smallest of their doc_ids; the
    others lose all their words, if they have a window at all. A null doc_id is neither smaller nor
    larger: such a row loses nothing and costs others nothing; rows of the same doc_id don't either.
    """
    texts = common.distinct_texts(docs)
    spans = removal_spans(texts, width).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    schema = "key binary, low long, n_words long, n_removed long, kept_text string, kept_sha256 string, whole_sha256 string"
    done = texts.join(spans, "key", "left").mapInArrow(_apply, schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("key"))
    copy = (F.col("doc_id") > F.col("low")) & (F.col("n_words") >= width)
    lone = F.col("doc_id").isNull()
    whole = F.when(lone, F.lit(0)).when(copy, F.col("n_words")).otherwise(F.col("n_removed"))
    sha = F.when(lone, F.col("whole_sha256")).when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256"))
    text = F.when(copy, F.lit("")).otherwise(F.col("kept_text"))
    return rows.join(done, "key").select("doc_id", "n_words", whole.cast("long").alias("n_removed"), sha.alias("kept_sha256"), F.when(~lone, text).alias("kept_text"))
