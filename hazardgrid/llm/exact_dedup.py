"""Exact dedup against an immutable snapshot, screened by static binary-fuse filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

#: Bits of a filter's fingerprints; about 1 in 2**16 unknown digests passes the screen for nothing.
FINGERPRINT = np.uint16
#: A filter cell array has this many cells for each key, plus a constant for small sets.
CELLS = 1.23


def _cells(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three cells of each key in three consecutive segments."""
    h = mix(keys + U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    first = ((h >> U64(40)) * U64(segments - 2)) >> U64(24)
    parts = [mix(h + U64(k)) & U64(segment - 1) for k in (1, 2, 3)]
    return np.stack([(first + U64(k)) * U64(segment) + parts[k] for k in range(3)]).astype(np.int64)


def _print(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix(keys ^ U64(seed * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) & U64(0xFFFF)).astype(FINGERPRINT)


def fuse_build(keys: np.ndarray) -> bytes:
    """A static binary-fuse filter (three-wise, 16 bits) of distinct 64-bit keys.

    Layout: seed, segment length and number of segments as three 32-bit integers, then the cells.
    Keys are peeled in rounds, all cells that hold one key at a time; a seed that leaves a core is
    replaced by the next.
    """
    keys = np.unique(np.asarray(keys, dtype=U64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    segments = max(3, int(np.ceil((CELLS * n + 32) / segment)) + 2)
    for seed in range(1, 100):
        cells = _cells(keys, seed, segment, segments)
        size = segment * segments
        count = np.bincount(cells.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)  # xor of the keys' indices in a cell
        for row in cells:
            np.bitwise_xor.at(held, row, np.arange(n))
        order, alone, left = [], np.flatnonzero(count == 1), n
        while len(alone):
            who, at = np.unique(held[alone], return_index=True)
            where = alone[at]
            order.append((who, where))
            left -= len(who)
            for row in cells[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, who)
            touched = np.unique(cells[:, who])
            alone = touched[count[touched] == 1]
        if left:
            continue
        table = np.zeros(size, dtype=FINGERPRINT)
        prints = _print(keys, seed)
        for who, where in reversed(order):
            value = prints[who].copy()
            for row in cells[:, who]:
                value ^= np.where(row == where, 0, table[row]).astype(FINGERPRINT)
            table[where] = value
        return np.array([seed, segment, segments], dtype="<u4").tobytes() + table.astype("<u2").tobytes()
    raise RuntimeError("no seed peels this key set")


def fuse_contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; every key it was built of is."""
    seed, segment, segments = np.frombuffer(filter_, dtype="<u4", count=3).tolist()
    table = np.frombuffer(filter_, dtype="<u2", offset=12)
    keys = np.asarray(keys, dtype=U64)
    a, b, c = _cells(keys, seed, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == _print(keys, seed)


def _key(digest: str = "digest"):
    """The digest's first 60 bits as a number, and the shard from other bits of it."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) over the distinct digests of ``snapshot(digest)``; one filter a shard, so no
    task holds more than its shard and nothing is broadcast."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "filter": [fuse_build(part["key"].to_numpy().astype(U64))]})

    keyed = snapshot.select(_key().alias("key")).distinct().withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``incoming(digest, ...)`` with ``maybe``: false where the snapshot certainly lacks the digest."""
    names = [f.name for f in incoming.schema.fields]
    keyed = incoming.withColumn("__key", _key()).withColumn("__shard", F.pmod(F.hash("__key"), F.lit(shards)))

    def ask(part: pd.DataFrame, filter_: pd.DataFrame) -> pd.DataFrame:
        hit = fuse_contains(filter_["filter"].iloc[0], part["__key"].to_numpy().astype(U64)) if len(filter_) and len(part) else np.zeros(len(part), dtype=bool)
        return part[names].assign(maybe=hit)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema.fields) + ", maybe boolean"
    return keyed.groupBy("__shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, schema)


def _representatives(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(digest, name): the text of one row for each of ``wanted(digest, top)``. Joined by digest and
    doc_id, so that a text with very many copies spreads out; the same way at every size."""
    rows = docs.select("doc_id", common.text_digest().alias("digest"), F.coalesce("text", F.lit("")).alias("__text"))
    found = rows.join(wanted.withColumnRenamed("digest", "__d").hint("shuffle_merge"), (F.col("digest") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("top")))
    return found.groupBy("digest").agg(F.first("__text").alias(name))


def exact_dedup(incoming: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Groups equal texts of an incoming batch and an immutable snapshot, both ``(doc_id, text)``.

    Returns (digest, keep_id, group_size, text_sha256), a row for each different text of either.
    Equal texts of a side meet first (map-side combined, so a text that a third of all rows hold is a
    few rows a task); then filters screen the incoming digests. Only positives join the snapshot's
    exact buckets (SHA-256 and length), where one text of each side is compared byte by byte; two
    texts of one digest stop the job. The largest doc_id of a text is kept; a null doc_id counts below
    every other.
    """
    spark = incoming.sparkSession
    shards = common.shuffle_width(spark)

    def grouped(df: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        return df.select("doc_id", common.text_digest().alias("digest"), F.octet_length(text).alias("bytes")).groupBy("digest", "bytes").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))

    old, new = common.durable(grouped(snapshot)), grouped(incoming)
    asked = common.durable(screen(new, build_filters(old.select("digest"), shards), shards))
    exact = old.select("digest", "bytes", F.col("top").alias("old_top"), F.col("n").alias("old_n"))
    both = common.durable(asked.where("maybe").drop("maybe").join(exact, ["digest", "bytes"], "left"))
    met = both.where("old_n is not null")
    ours = _representatives(incoming, met.select("digest", "top"), "__new")
    theirs = _representatives(snapshot, met.select("digest", F.col("old_top").alias("top")), "__old")
    equal = F.when(F.col("__new") == F.col("__old"), True).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("boolean"))
    same = ours.join(theirs, "digest").select("digest", equal.alias("same")).where("same").select("digest")
    merged = met.join(same, "digest").select("digest", F.greatest("top", "old_top").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("group_size"))
    plain = lambda df: df.select("digest", F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    fresh = plain(asked.where("not maybe")).unionByName(plain(both.where("old_n is null")))
    only_old = plain(old.join(met.select("digest", "bytes"), ["digest", "bytes"], "left_anti"))
    return merged.unionByName(fresh).unionByName(only_old).withColumn("text_sha256", F.lower(F.hex("digest")))


def dedup_documents(docs: DataFrame, snapshot_share: int = 2) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    The table is taken as an immutable snapshot (doc_id divisible by ``snapshot_share``, nulls too)
    and an incoming batch (the rest). Rows that share both text and doc_id can't be told apart and
    are kept or dropped together.
    """
    old = F.coalesce(F.col("doc_id") % snapshot_share, F.lit(0)) == 0
    groups = exact_dedup(docs.where(~old), docs.where(old))
    rows = docs.select("doc_id", common.text_digest().alias("digest"))
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
