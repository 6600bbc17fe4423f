"""Token packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_tokens import word_encoder

#: Pieces of one length are ranked in groups of about so many, so that a frequent length is not one task.
GROUP = 50_000
#: Patterns' slots up to which they are broadcast (some 40 bytes each); beyond, they are joined by length.
SLOTS = 200_000


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (count, lengths in order) of each packing pattern.

    Lengths are placed longest first, all pieces of a length at once, each time into the shortest
    packs so far (those with the most room), as far as they fit; else new packs are opened. A pattern
    with more packs than pieces are left is split.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    open_rooms: set[int] = set()

    def add(count: int, lengths: tuple[int, ...], left: int) -> None:
        stack = room.setdefault(left, [])
        if stack and stack[-1][1] == lengths:
            stack[-1] = (stack[-1][0] + count, lengths)
        else:
            stack.append((count, lengths))
        open_rooms.add(left)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fit = max(open_rooms, default=0)
            if fit < length:
                add(left, (length,), capacity - length)
                break
            count, lengths = room[fit].pop()
            if not room[fit]:
                open_rooms.discard(fit)
            take = min(count, left)
            if take < count:
                add(count - take, lengths, fit)
            add(take, (*lengths, length), fit - length)
            left -= take
    return [(c, list(x)) for left in sorted(room) for c, x in room[left] if c]


def token_pieces(docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], capacity: int) -> DataFrame:
    """(doc_id, row_key, start, length, ids_crc32, doc_tokens): each document's ids cut every
    ``capacity``. Only sums of the ids leave the workers."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for part in common.chunks(batches):
            rows: list[tuple] = []
            for doc, key, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(common.texts_of(part)), strict=True):
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                n = len(ids)
                rows += [(doc, key, at, min(capacity, n - at), zlib.crc32(raw[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("row_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to ``pieces(doc_id, row_key, start, length, ...)`` (stored, so that
    ranks are stable). The driver sees the histogram only, ``capacity`` lengths at most and a count more
    for each GROUP pieces, and the patterns made of it."""
    spark = pieces.sparkSession
    sizes = [(r["length"], 1 + r["n"] // GROUP) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]
    groups = spark.createDataFrame(sizes, "length long, __groups int")  # a row a length: ``capacity`` at most
    salted = pieces.join(F.broadcast(groups), "length").withColumn("__salt", F.pmod(F.xxhash64("row_key", "start"), F.col("__groups")).cast("int")).drop("__groups")
    counts = {(r["length"], r["__salt"]): r["n"] for r in salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()}
    histogram: dict[int, int] = {}
    starts = []
    for (length, salt), n in sorted(counts.items()):
        starts.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    patterns = plan_packs(histogram, capacity)
    # every slot of a pattern takes the next `count` ranks of its length
    used: dict[int, int] = {}
    slots, base = [], 0
    for count, lengths in patterns:
        at = 0
        for length in lengths:
            slots.append((length, used.get(length, 0), used.get(length, 0) + count, base, at))
            used[length] = used.get(length, 0) + count
            at += length
        base += count
    by_length = spark.createDataFrame(starts, "length long, __salt int, __first long")
    # one row a length: its slots in rank order; arrays keep the lookup a plain equi join
    slot_table = spark.createDataFrame(slots, "length long, lo long, hi long, base long, at long").groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "at"))).alias("__slots"))
    from pyspark.sql import Window

    w = Window.partitionBy("length", "__salt").orderBy("row_key", "doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(w) - 1).join(F.broadcast(by_length), ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__first"))
    placed = ranked.join(F.broadcast(slot_table) if len(slots) <= SLOTS else slot_table, "length").withColumn("__slot", F.expr("filter(__slots, s -> s.lo <= __rank and __rank < s.hi)[0]"))
    return placed.select(*pieces.columns, (F.col("__slot.base") + F.col("__rank") - F.col("__slot.lo")).alias("sequence_id"), F.col("__slot.at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_length.

    A document is its ids and ``end_id``; an empty or null text is ``end_id`` alone. ``tokenizer_json``
    is the content of a tokenizer file. A sequence is padded to ``capacity`` unless its tokens are
    already a power of two. Repeated rows are packed as often as they occur.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encoder():
        encode = word_encoder(content.value)
        tail = np.array([end_id], dtype=np.uint32)
        return lambda texts: [np.concatenate([x, tail]) for x in encode(texts)]

    stored = common.durable(token_pieces(docs, encoder, capacity))
    packed = pack(stored, capacity)
    total = packed.groupBy("sequence_id").agg(F.sum("length").alias("__sum"))
    power = F.col("__sum").bitwiseAND(F.col("__sum") - 1) == 0
    out = packed.join(total, "sequence_id").withColumn("padded_length", F.when(power, F.col("__sum")).otherwise(F.lit(capacity)).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")
