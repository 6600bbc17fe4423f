"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by multi-index hashing, in pairs or as components
of wider links for the pipeline; and near copies by the exact similarity of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z only
SEED = 42
#: Shingles whose bits are added up in bytes.
BLOCK = 255
#: Tables of ``joining_links``; fingerprints dealt out at once; cells up to this size are compared place by place;
#: pairs that are held at once.
BYTE_PAIRS = list(combinations(range(8), 2))
DEALT_AT_ONCE, LISTED_CELL, PAIRS_AT_ONCE = 1 << 16, 512, 1 << 20


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter than one."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    one = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([one(b" ".join(words), seed)], dtype="<u8")
    join = b" ".join
    return np.fromiter((one(join(s), seed) for s in zip(*(words[k:] for k in range(width)), strict=False)), dtype="<u8", count=len(words) - width + 1)


def majority(words: np.ndarray) -> np.ndarray:
    """Which bits are set in over half of the rows of 64-bit words (n rows of some words)."""
    n = len(words)
    total = np.zeros(64 * words.shape[1], dtype=np.int64)
    raw = np.ascontiguousarray(words, dtype="<u8").view(np.uint8)
    for at in range(0, n, BLOCK):
        total += np.add.reduce(np.unpackbits(raw[at : at + BLOCK], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * total > n


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    hashes = shingle_hashes(text, width, seed)
    return int(np.packbits(majority(hashes[:, None]), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp) for each row of ``docs(doc_id, text)``, with its text's key if ``keyed``; fp holds the 64 bits in a
    signed long."""
    more = [common.text_key().alias("key")] if keyed else []
    rows = docs.select(F.col("doc_id").cast("long"), *more, "text")
    names = [c for c in rows.columns if c != "text"] + ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            fps = np.array([fingerprint(x, width) for x in common.bytes_of(part)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps)], names=names)

    return rows.mapInArrow(run, "doc_id long, key binary, fp long" if keyed else "doc_id long, fp long")


def _ball(segment: Column, bits: int) -> Column:
    """A segment value and those one bit above it; a pair one bit apart meets once, from its lower end."""
    up = [F.when(F.shiftright(segment, j).bitwiseAND(F.lit(1)) == 0, segment + F.lit(1 << j)) for j in range(bits)]
    return F.array_compact(F.array(segment, *up))


def hamming_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``fps(fp)`` (distinct) with at most two differing bits.

    Multi-index hashing over two 32-bit segments: of two differing bits, the upper segment holds at
    most one (found by enumerating its ball of radius one) or the lower one holds none (found by its
    exact value). Table matches are then verified on all 64 bits. The exact tables are cut further
    by quarters of the other half: if the upper halves agree, the lower halves differ in at most two
    bits, so one of three pieces of the lower half agrees too; this keeps families of near copies,
    which share a segment, from meeting in full.
    """
    assert distance == 2
    hi = F.shiftrightunsigned("fp", 32)
    lo = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    third = lambda x: [x.bitwiseAND(F.lit(0x7FF)), F.shiftright(x, 11).bitwiseAND(F.lit(0x7FF)), F.shiftright(x, 22)]
    half = lambda x: [x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)]

    def keyed(kind: int, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("k1"), b.alias("k2"))

    # equal upper half (0-2), equal lower half (3-5): the other half agrees in a third of its bits;
    # one bit apart above (6, 7): the lower halves differ in at most one bit and agree in a half
    same = [keyed(i, hi, p) for i, p in enumerate(third(lo))] + [keyed(3 + i, lo, p) for i, p in enumerate(third(hi))]
    table = fps.select("fp", F.explode(F.array(*same, *[keyed(6 + i, hi, p) for i, p in enumerate(half(lo))])).alias("k"))

    def near(kind: int, piece: Column) -> Column:
        return F.transform(F.expr("slice(ball, 2, 32)"), lambda s: keyed(kind, s, piece))

    ball = fps.withColumn("ball", _ball(hi, 32))
    probes = ball.select("fp", F.explode(F.concat(F.array(*same), *[near(6 + i, p) for i, p in enumerate(half(lo))])).alias("k"))
    t = table.select("k.*", F.col("fp").alias("b"))
    p = probes.select("k.*", F.col("fp").alias("a"))
    met = p.join(t, ["kind", "k1", "k2"]).where(((F.col("kind") >= 6) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _dealt(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints in the cells of all pairs of their bytes, dealt out by cell."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.concatenate(held)
        byte = fps.view(np.uint8).reshape(-1, 8).astype("<u4")
        cell = np.concatenate([np.uint32(t << 16) | byte[:, i] << np.uint32(8) | byte[:, j] for t, (i, j) in enumerate(BYTE_PAIRS)])
        bucket = common.mix(cell.astype("<u8")) % common.U64(width)
        order = np.argsort(bucket, kind="stable")
        bucket, cell, fps = bucket[order], cell[order], np.tile(fps, len(BYTE_PAIRS))[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + common.U64(1)))
        ends = [*cut[1:].tolist(), len(bucket)]
        blobs = [pa.array([x[s:e].tobytes() for s, e in zip(cut.tolist(), ends, strict=True)], pa.binary()) for x in (cell, fps)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *blobs], names=["bucket", "cells", "fps"])

    held, n = [], 0
    for part in batches:
        held.append(part.column(0).to_numpy().astype("<i8").view("<u8"))
        n += part.num_rows
        if n >= DEALT_AT_ONCE:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def _spanned(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links among ``x`` join: what is found to belong to a component is compared only with
    what belongs to none yet."""
    out, open_ = [(x[:0], x[:0])], x
    while len(open_) > 1:
        front, open_ = open_[:1], open_[1:]
        while len(front) and len(open_):
            some, front = np.split(front, [max(1, PAIRS_AT_ONCE // len(open_))])
            near = np.bitwise_count(some[:, None] ^ open_[None, :]) <= distance
            hit = near.any(axis=0)
            out.append((some[near[:, hit].argmax(axis=0)], open_[hit]))
            front, open_ = np.concatenate([front, open_[hit]]), open_[~hit]
    a, b = zip(*out, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _joined(table: pa.Table, distance: int) -> pa.Table:
    """(a, b): each fingerprint b that links in a cell of this bucket, with one that it is joined to, so that rows
    follow the fingerprints and not their pairs."""
    common.give_back()
    cell, fps = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("cells", "<u4"), ("fps", "<u8")))
    order = np.argsort(cell, kind="stable")
    cell, x = cell[order], fps[order]
    begin = np.flatnonzero(np.diff(cell.astype(np.int64), prepend=-1))
    count = np.diff(np.append(begin, len(cell)))
    names, at = np.unique(x, return_inverse=True)
    links, n = [], 0

    def reduced() -> list[tuple[np.ndarray, np.ndarray]]:
        root = common.local_components(len(names), *(np.concatenate(c) for c in zip(*links, strict=True)))
        other = np.flatnonzero(root != np.arange(len(names)))
        return [(root[other], other)]

    after = np.repeat(count, count) - common.ramp(count) - 1  # entries of the cell that follow
    alive = np.flatnonzero((after > 0) & (np.repeat(count, count) <= LISTED_CELL))
    for k in range(1, LISTED_CELL):
        alive = alive[after[alive] >= k]
        if not len(alive):
            break
        i = alive[np.bitwise_count(x[alive] ^ x[alive + k]) <= distance]
        links.append((at[i], at[i + k]))
        n += len(i)
        if n > PAIRS_AT_ONCE:
            links, n = reduced(), 0
    for k in np.flatnonzero(count > LISTED_CELL):
        a, b = _spanned(x[begin[k] : begin[k] + count[k]], distance)
        links.append((np.searchsorted(names, a), np.searchsorted(names, b)))
    if not links:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ((a, b),) = reduced()
    return pa.table({"a": names[a].view(np.int64), "b": names[b].view(np.int64)})


def joining_links(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of fingerprints of ``fps(fp)`` (distinct) that have the components of all links: those with at most
    ``distance`` differing bits, 6 at most.

    Multi-index hashing over pairs of bytes: six differing bits leave two of the eight bytes alike, so each link meets
    in one of 28 tables of 65,536 cells. Cells are compared in full by their tasks, which return links that join
    what these join and no more, so a family of near copies gives a row a fingerprint and table, not a pair.
    """
    assert distance <= 6
    width = common.shuffle_width(fps.sparkSession)
    packed = fps.select("fp").mapInArrow(lambda it: _dealt(it, width), "bucket int, cells binary, fps binary")
    return packed.groupBy("bucket").applyInArrow(lambda table: _joined(table, distance), "a long, b long")


def similar_prints(docs: DataFrame, width: int = 3, distance: int = 6) -> DataFrame:
    """(doc_id, key, component_id, kept) for each row of ``docs(doc_id, text)``: texts whose fingerprints differ in at
    most ``distance`` bits share a component, named by its smallest doc_id; ``kept`` holds for one text of it
    (``common.text_key``) with that doc_id. No such pair is missed. Texts without words have fingerprint zero."""
    rows = common.durable(fingerprints(docs, width, keyed=True))
    one = common.durable(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low")))
    parts = common.connected_components(joining_links(one.select("fp"), distance))
    named = one.join(parts, one["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    # written, so that adaptive execution can split a component that a third of all nodes are in
    lowest = common.durable(named.groupBy("component").agg(F.min("low").alias("least")))
    label = common.durable(named.join(lowest, "component").select("fp", "least"))
    out = rows.join(label, "fp")
    return out.select("doc_id", "key", F.col("least.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))).alias("kept"))


def simhash_dedup(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links, itself included), kept (doc_id is that one).

    Texts with the same fingerprint are one node, so copies cost nothing. Texts without words have
    fingerprint zero and link like any other. Nulls among doc_ids are ignored in the smallest one; a
    component of nulls alone has a null id.
    """
    rows = common.durable(fingerprints(docs, width))
    nodes = common.durable(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = common.connected_components(hamming_links(nodes.select("fp"), distance))
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    # written, so that adaptive execution can split a component that a third of all nodes are in
    lowest = common.durable(named.groupBy("component").agg(F.min("low").alias("component_id")))
    label = named.join(lowest, "component").select("fp", "component_id")
    out = rows.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Near copies by similarity of sets: words of a shingle, least similarity as a fraction.
SIMILAR_WIDTH, SIMILAR = 5, (4, 5)
#: Texts whose shingles are counted to find frequent ones, and frequent shingles that are told to workers.
SAMPLE, FREQUENT = 10_000, 1 << 17
#: Texts of a cell up to which all of its pairs are listed at once; texts of a block of a crowded group.
SMALL_CELL, GROUP_BLOCK = 8, 1024
#: Bits of a set's parities.
PARITIES = 2048


def shingle_set(text: bytes) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    return np.unique(shingle_hashes(text, SIMILAR_WIDTH))


def prefix_size(n: int) -> int:
    """Of sets of n shingles, so many that come first in any order common to all sets: two sets similar
    to SIMILAR or more have one of these in common, as they share at least that part of either."""
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1 if n else 0


def parities(shingles: np.ndarray) -> bytes:
    """Whether an odd number of hashes fall in each of PARITIES classes. Two sets differ in at least
    as many shingles as their parities do in bits."""
    odd = np.bincount((shingles >> common.U64(20)) % common.U64(PARITIES), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def similar(both: Column, either: Column) -> Column:
    return both * SIMILAR[1] >= either * SIMILAR[0]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles (ascending) and their texts in a sample. They come last in the
    order, which any list leaves right: it only decides how many texts share a cell."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            for text in common.bytes_of(part):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view("<i8"))], names=["cell"])

    share = int(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 20))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).select("text")
    counts = common.durable(some.mapInArrow(cells, "cell long").groupBy("cell").agg(F.count("*").alias("n")).where("n > 2"))
    least, total = 0, 0
    for n, k in sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True):
        total += k
        if total > FREQUENT:
            break
        least = n
    told = counts.where(F.col("n") >= least).toArrow() if least else None
    common.discard(counts)
    if told is None:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype=np.int64)
    hashes = told.column("cell").to_numpy().astype("<i8").view("<u8")
    order = np.argsort(hashes)
    return hashes[order], told.column("n").to_numpy().astype(np.int64)[order]


def prefix_of(shingles: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The prefix of a set in the order by (texts in the sample, hash)."""
    n = prefix_size(len(shingles))
    if not len(hashes) or not n:
        return shingles[:n]
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    often = np.where(hashes[at] == shingles, counts[at], 0)
    return shingles[np.argsort(often, kind="stable")[:n]] if often.any() else shingles[:n]


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Prefixes dealt out by cell. A bucket tells cells apart by 32 bits; cells that fall together
    only add pairs, which are verified."""
    for part in common.chunks(batches, "prefix"):
        prefixes = part.column("prefix").to_pylist()
        cells = np.frombuffer(b"".join(prefixes), dtype="<u8")
        if not len(cells):
            continue
        count = [len(p) // 8 for p in prefixes]
        node, size = (np.repeat(part.column(c).to_numpy().astype(t), count) for c, t in (("node", "<i8"), ("size", "<u4")))
        place = np.minimum(common.ramp(np.array(count)), 65535).astype("<u2")
        bucket = (cells >> common.U64(32)) % common.U64(width)
        order = np.argsort(bucket, kind="stable")
        bucket, cells, node, size, place = bucket[order], cells[order].astype("<u4"), node[order], size[order], place[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + common.U64(1)))
        ends = [*cut[1:].tolist(), len(bucket)]
        blobs = [pa.array([x[s:e].tobytes() for s, e in zip(cut.tolist(), ends, strict=True)], pa.binary()) for x in (cells, node, size, place)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *blobs], names=["bucket", "cells", "nodes", "sizes", "places"])


def _meet(table: pa.Table) -> pa.Table:
    """(a, b, left): pairs a < b of a small cell, with a null for left and without those for which too few
    shingles are left from here on (the first cell that a similar pair shares lists it); of a crowded cell
    each text b with the cell's first text a, this one with itself, and the shingles left to b."""
    common.give_back()
    kinds = (("cells", "<u4"), ("nodes", "<i8"), ("sizes", "<u4"), ("places", "<u2"))
    cell, node, size, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in kinds)
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    twin = np.zeros(len(c), dtype=bool)
    twin[1:] |= c[1:] == c[:-1]
    twin[:-1] |= c[1:] == c[:-1]
    order = order[twin]
    order = order[np.lexsort((node[order], cell[order]))]
    cell, node, size = cell[order].astype(np.int64), node[order], size[order].astype(np.int64)
    left = size - place[order]
    fresh = np.ones(len(cell), dtype=bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
    cell, node, size, left = cell[fresh], node[fresh], size[fresh], left[fresh]
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    count = np.diff(np.append(begin, len(cell)))
    group = np.repeat(np.arange(len(begin)), count)
    small = count[group] <= SMALL_CELL
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for k in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[k:] == cell[:-k]) & small[k:])
        i = i[np.minimum(left[i], left[i + k]) * sum(SIMILAR) >= (size[i] + size[i + k]) * SIMILAR[0]]
        pairs.append(np.stack([node[i], node[i + k]], axis=1))
    few = np.unique(np.concatenate(pairs), axis=0)
    many = np.flatnonzero(~small)
    hub = begin[group][many]
    a, b = np.concatenate([few[:, 0], node[hub]]), np.concatenate([few[:, 1], node[many]])
    rest = pa.chunked_array([pa.nulls(len(few), pa.int64()), pa.array(left[many], pa.int64())])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "left": rest})


def _possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs(a, b)`` without those whose parities differ in more bits than similar sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype="<u8").reshape(part.num_rows, -1) for c in ("x", "y"))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            most = (part.column("m").to_numpy().astype(np.int64) + part.column("n").to_numpy()) * (SIMILAR[1] - SIMILAR[0])
            yield part.select(["a", "b"]).filter(pa.array(differ * sum(SIMILAR) <= most))

    sets = rows.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").groupBy("node").agg(F.first("parity").alias("parity"), F.first("size").alias("size"))
    x, y = (sets.select(F.col("node").alias(n), F.col("parity").alias(p), F.col("size").alias(z)) for n, p, z in (("a", "x", "m"), ("b", "y", "n")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a long, b long")


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): shingles in both sets and in either, for each of ``pairs(a, b)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, "x"):
            both, either = [], []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                both.append(len(np.intersect1d(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), assume_unique=True)))
                either.append((len(x) + len(y)) // 8 - both[-1])
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, both long, either long")


def _unmet(a: pa.Table) -> pa.Table:
    """(a, b): pairs a < b of two blocks of a crowded group (of one, if the blocks are the same) that are in
    different components so far and can be similar: by the shingles left to both, by their distances to
    the group's first text, which are a metric, and by their parities. Only these pairs leave the task."""
    col = lambda c, t: a.column(c).to_numpy().astype(t)
    block, node, part, left, size = (col(c, np.int64) for c in ("block", "node", "part", "left", "size"))
    apart = np.asarray(a.column("apart").fill_null(np.nan), dtype=np.float64)
    parity = np.frombuffer(b"".join(a.column("parity").to_pylist()), dtype="<u8").reshape(len(node), -1)
    order = np.lexsort((node, block))
    block, node, part, left, size, apart, parity = (x[order] for x in (block, node, part, left, size, apart, parity))
    one, two = np.flatnonzero(block == block[0]), np.flatnonzero(block == block[-1])
    bound, met = 1 - SIMILAR[0] / SIMILAR[1] + 1e-9, [np.zeros((0, 2), dtype=np.int64)]
    for k, i in enumerate(one):
        js = two[k + 1 :] if block[0] == block[-1] else two
        both = size[i] + size[js]
        js = js[(part[js] != part[i]) & (np.minimum(left[js], left[i]) * sum(SIMILAR) >= both * SIMILAR[0]) & ~(np.abs(apart[js] - apart[i]) > bound)]
        differ = np.bitwise_count(parity[js] ^ parity[i]).sum(axis=1, dtype=np.int64)
        js = js[differ * sum(SIMILAR) <= (size[i] + size[js]) * (SIMILAR[1] - SIMILAR[0])]
        met.append(np.stack([np.minimum(node[i], node[js]), np.maximum(node[i], node[js])], axis=1))
    found = np.concatenate(met)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def _sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``pairs(a, b)``, made again from one text of each."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(text).tobytes() for text in common.bytes_of(part)], pa.binary())], names=["node", "shingles"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = rows.select("node", "key").join(asked, "node").groupBy("node").agg(F.min("key").alias("key"))
    texts = docs.select("key", "text").join(wanted, "key").groupBy("key", "node").agg(F.first("text").alias("text")).select("node", "text")
    return common.durable(texts.mapInArrow(again, "node long, shingles binary"))


def _cross_pairs(hubs: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs that ``_unmet`` finds among the texts of crowded cells. Cells of the same first text are one
    group, as relatives share many cells: ``hubs(a, b, left, apart)`` names each text b of the group a once,
    with the most that any cell leaves to it. A large group is cut into blocks, each pair of which is a
    task's; texts are copied once a block, pairs are not written."""
    members = hubs.join(parts, hubs["b"] == parts["node"], "left").select("a", F.col("b").alias("node"), "left", "apart", F.coalesce("component", "b").alias("part"))
    mixed = members.groupBy("a").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks")).where("lo <> hi")
    sets = rows.join(members.join(mixed, "a", "left_semi").select("node").distinct(), "node").groupBy("node").agg(F.first("parity").alias("parity"), F.first("size").cast("long").alias("size"))
    held = members.join(mixed.select("a", "blocks"), "a").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [F.col("a").alias("hub"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    dealt = held.select(*keys, "block", "node", "part", "left", "apart", "size", "parity")
    return dealt.groupBy("hub", "lo", "hi").applyInArrow(_unmet, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component_id, kept) for each row of ``docs(doc_id, text)``: texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more share a component, named by its
    smallest doc_id; ``kept`` holds for one text of it (``common.text_key``) with that doc_id.

    No pair is missed: texts meet in cells of the shingles that come first in a common order, rare ones
    before frequent ones (prefix filtering), so a shared passage brings nobody together as long as
    a fifth of a text is its own. Each pair is decided by its two sets. A crowded cell's texts first
    meet its first text alone; where that leaves several components in the cell, pairs between different
    ones are tested by parities inside blocks, and those that can be similar follow. Equal sets are one
    node, known by 64 bits.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("key"), "text")
    hashes, counts = _frequent(docs)
    told = spark.sparkContext.broadcast((hashes, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches):
            sets = [shingle_set(text) for text in common.bytes_of(part)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype="<u8").view("<i8")
            prefix = [prefix_of(s, *told.value).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array(prefix, pa.binary()), pa.array([parities(s) for s in sets], pa.binary())], names=["doc_id", "key", "node", "size", "prefix", "parity"])

    rows = common.durable(docs.mapInArrow(run, "doc_id long, key binary, node long, size int, prefix binary, parity binary"))
    width = common.shuffle_width(spark) // 4
    packed = rows.select("node", "size", "prefix").mapInArrow(lambda it: _pack(it, width), "bucket int, cells binary, nodes binary, sizes binary, places binary")
    met = common.durable(packed.groupBy("bucket").applyInArrow(_meet, "a long, b long, left long"))
    met_once = common.durable(met.where("a <> b").select("a", "b").distinct())
    pairs = common.durable(_possible(met_once, rows))
    crowded = met.where("left is not null").groupBy("a", "b").agg(F.max("left").alias("left"))
    scored = common.durable(_scored(pairs, _sets(docs, rows, pairs)))
    links = scored.where(similar(F.col("both"), F.col("either"))).select("a", "b")
    parts = common.durable(common.connected_components(links))
    apart = F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.col("both") / F.col("either"))
    hubs = crowded.join(scored, ["a", "b"], "left").select("a", "b", "left", apart.alias("apart"))
    more = common.durable(_cross_pairs(hubs, parts, rows).join(met_once, ["a", "b"], "left_anti"))
    more = common.durable(_scored(more, _sets(docs, rows, more)).where(similar(F.col("both"), F.col("either"))).select("a", "b"))
    if not more.isEmpty():
        parts = common.connected_components(links.unionByName(more))
    named = rows.select("doc_id", "key", "node").join(parts, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("component"))
    lowest = common.durable(named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("low")))
    out = named.join(lowest, "component")
    return out.select("doc_id", "key", F.col("low.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("key") == F.col("low.key"))).alias("kept"))
