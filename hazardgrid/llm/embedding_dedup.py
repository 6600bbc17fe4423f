"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification,
connected components. Only ids and sketches go through the tables; vectors are fetched where a
bucket holds somebody whose sketch is near."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common

#: A pair at the threshold is missed by all tables with at most this probability; closer pairs by less.
MISS = 1e-5
#: Sign bits of a sketch, and the probability that a pair at the threshold differs in more than is allowed.
SKETCH, SKETCH_MISS = 128, 1e-7
#: Vectors of one bucket that meet in one task; larger buckets are split into blocks.
BLOCK = 2048
#: Rows of a block that are compared with all others at once.
STEP = 512
#: Large buckets up to whose number their list is broadcast.
LISTED = 200_000
SEED = 20240607


def table_plan(vectors_per_label: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets of some 16 vectors, and as many tables as MISS asks for."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(20, max(3, round(math.log2(max(vectors_per_label, 1) / 16 + 1))))
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree**bits)))


def sketch_bound(threshold: float) -> int:
    """Differing sketch bits that vectors at the threshold exceed with probability SKETCH_MISS at most."""
    p, tail = math.acos(threshold) / math.pi, 1.0
    for k in range(SKETCH):
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if tail <= SKETCH_MISS:
            return k
    return SKETCH


def _signs(x: np.ndarray, bits: int, stream: int) -> np.ndarray:
    """Sides of ``bits`` hyperplanes on which the rows lie. Rows and planes are rounded to integers, whose
    products and sums are exact, so a vector has the same signs in any batch."""
    planes = np.rint(np.random.default_rng([SEED, stream, x.shape[1]]).standard_normal((x.shape[1], bits)) * 1024)
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 32768) @ planes > 0


def _signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    return (_signs(x, bits * tables, 0).reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _sketches(x: np.ndarray) -> np.ndarray:
    return np.packbits(_signs(x, SKETCH, 1), axis=1).view("<i8")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _near_sketches(part: pd.DataFrame, bound: int) -> pd.DataFrame:
    """The rows of blocks ``part`` that have a partner in their block whose sketch is near. All rows are
    compared with the next one, the next but one and so on, as far as their blocks reach."""
    part = part.sort_values(UNIT, ignore_index=True)
    ids = part[UNIT].to_numpy()
    head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
    size = np.diff(np.append(head, len(ids)))
    end = np.repeat(head + size, size)
    # unsigned, as bits are counted in the absolute value of a signed number
    one, two, mine = part["s0"].to_numpy().astype(np.uint64), part["s1"].to_numpy().astype(np.uint64), part["mine"].to_numpy()
    whole = (part["b0"] == part["b1"]).to_numpy()
    near = np.zeros(len(part), dtype=bool)
    at = np.arange(len(part))
    for step in range(1, int(size.max(initial=1))):
        at = at[at + step < end[at]]
        apart = np.bitwise_count(one[at] ^ one[at + step]) + np.bitwise_count(two[at] ^ two[at + step])
        ok = at[(apart <= bound) & (whole[at] | (mine[at] != mine[at + step]))]
        near[ok] = near[ok + step] = True
    return part.loc[near, [*UNIT, "mine", "node"]]


#: What names a block of a bucket, or a pair of blocks.
UNIT = ["grp", "tbl", "bucket", "b0", "b1"]


def _links(block: pd.DataFrame, plan: tuple[int, int], tbl: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of a block's rows: partners by exact cosine that no earlier table brings together,
    with their copies, and the smallest row reached."""
    raw = _matrix(block["v"])
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mult, mine = block["mult"].to_numpy(), block["mine"].to_numpy()
    whole = block["b0"].iloc[0] == block["b1"].iloc[0]
    links, label = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    sig = None
    for at in range(0, len(x), STEP):
        i, j = np.nonzero(x[at : at + STEP] @ x.T >= threshold)
        i = i + at
        ok = i < j if whole else (i < j) & (mine[i] != mine[j])
        i, j = i[ok], j[ok]
        if tbl and len(i):
            sig = _signatures(raw, *plan) if sig is None else sig
            for t in range(tbl):
                new = sig[i, t] != sig[j, t]
                i, j = i[new], j[new]
        np.add.at(links, i, mult[j])
        np.add.at(links, j, mult[i])
        if len(i):
            label = common.local_components(len(x), np.concatenate([i, np.arange(len(x))]), np.concatenate([j, label]))
    return links, label


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row for each row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in double precision is at
    least ``threshold``; those that are null, empty, zero or hold null or non-finite components, and
    those of different lengths, link with nothing. Equal vectors of a label are one node with a count
    (a vector that a third of all rows hold is one node), so copies are never paired. A table holds
    each node's id and sketch; a bucket of more than BLOCK nodes is split into pairs of blocks. Nodes
    with a near sketch in their block meet there with their vectors. A pair is counted in the first
    table where its signatures agree. A null vec_id takes part, but never names a component.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(kind, FloatType) else "double"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0)
    plain = F.transform("embedding", lambda v: v.cast(kind) + F.lit(0.0).cast(kind))  # without negative zeros
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(F.coalesce(good, F.lit(False)), F.struct("label", plain.alias("v"))).alias("u"))
    key = F.unhex(F.sha2(F.to_json("u"), 256))
    unit = rows.where("u is not null").select("vec_id", key.alias("key"), "u")
    nodes = unit.groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"), F.first("u").alias("u"))
    nodes = common.durable(nodes.select(F.xxhash64("key").alias("node"), "low", "mult", F.xxhash64("u.label", F.size("u.v")).alias("grp"), F.col("u.v").alias("v")))
    most = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    plan, bound = table_plan(most, threshold), sketch_bound(threshold)

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sigs = np.zeros((len(part), plan[1]), dtype=np.int32)
            sketch = np.zeros((len(part), 2), dtype=np.int64)
            size = part["v"].map(len).to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = _matrix(part["v"].iloc[at])
                sigs[at], sketch[at] = _signatures(x, *plan), _sketches(x)
            yield pd.DataFrame({"node": part["node"], "grp": part["grp"], "s0": sketch[:, 0], "s1": sketch[:, 1], "sig": list(sigs)})

    signed = common.durable(nodes.select("node", "grp", "v").mapInPandas(sign, "node long, grp long, s0 long, s1 long, sig array<int>"))
    each = signed.select("node", "grp", "s0", "s1", F.posexplode("sig").alias("tbl", "bucket"))
    full = each.groupBy("grp", "tbl", "bucket").count().where(F.col("count") > BLOCK)
    full = common.durable(full.select("grp", "tbl", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    dealt = each.join(F.broadcast(full) if full.count() <= LISTED else full, ["grp", "tbl", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "s0", "s1", "grp", "tbl", "bucket", "mine", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"))
    task = F.pmod(F.xxhash64(*UNIT), F.lit(common.shuffle_width(spark))).cast("int")
    near = dealt.groupBy(task.alias("task")).applyInPandas(lambda t: _near_sketches(t, bound), "grp long, tbl int, bucket int, b0 int, b1 int, mine int, node long")

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, tbl, *_), block in part.groupby(UNIT, sort=False):
            links, label = _links(block, plan, tbl, threshold)
            on, node = links > 0, block["node"].to_numpy()
            found.append(pd.DataFrame({"node": node[on], "links": links[on], "to": node[label[on]]}))
        return pd.concat(found)

    brought = near.join(nodes.select("node", "mult", "v"), "node")
    met = common.durable(brought.groupBy(task.alias("task")).applyInPandas(verify, "node long, links long, to long"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    parts = common.connected_components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = nodes.select("node", "low", "mult").join(parts, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written, so that adaptive execution can split a component that a third of all nodes are in
    lowest = common.durable(named.groupBy("component").agg(F.min("low").alias("component_id")))
    label = named.join(lowest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = unit.select("vec_id", F.xxhash64("key").alias("node")).join(label, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("u is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
