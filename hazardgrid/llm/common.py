"""Helpers shared by the corpus operators: durable scratch tables, bounded text chunks,
rolling hashes and distributed connected components.

Conventions of every operator in this package:

* a null text counts as the empty text;
* only the named input columns are read, so further columns of any name do no harm;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid.shipping import ship_package

#: Bytes of text that a Python worker holds at once, besides one single longer text.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
#: Odd multipliers of the rolling hashes; any odd number works, both sides need the same.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
UNIT_BASE = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


#: Rows of an Arrow batch at most: texts can be long, and each batch is held on both sides.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """What every operator needs of a session."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. A folder of this machine is used only where the
    session names none, as in local tests."""
    prepare(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{tempfile.gettempdir()}/hazardgrid-scratch"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the frame as a table in the shared folder and reads it back.
    Any executor can read it, so a lost one costs nothing but its running tasks."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table of ``durable`` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    """Reduce-side buckets for blocks that Python packs itself; follows the cluster's setting."""
    prepare(spark)
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on between tasks, idle ones too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice holds about ``limit`` bytes of text. Workers are used
    again by later tasks, so what earlier ones freed is first given back to the system."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        at = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            yield batch.slice(at, end - at)
            at = end
    give_back()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply), so that sums of mixed values don't cancel."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = n + n // 8 + 4096
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, dtype=U64)
            done, step = 1, b
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = out[:more] * U64(step)
                done, step = 2 * done, step * step & _MASK
            pair.append(out)
        _powers[base] = have = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp prefix sums: out[i] = sum of values[k] * base**k for k < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(base, len(values))[0], dtype=U64, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    inverse = powers(base, len(prefix))[1]
    return (prefix[end] - prefix[start]) * inverse[start]


def window_hash(prefix: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of ``width`` values."""
    n = len(prefix) - width
    return (prefix[width:] - prefix[:n]) * powers(base, n)[1] if n > 0 else np.zeros(0, dtype=U64)


def sliding_argmin(keys: np.ndarray, width: int, block: int = 1 << 23) -> np.ndarray:
    """Index of the smallest of keys[i : i + width] for each full window; of equal ones the first.
    Looks at the upper 40 bits of each key."""
    if len(keys) > block + width:
        parts = [sliding_argmin(keys[at : at + block + width - 1], width, block) + at for at in range(0, len(keys) - width + 1, block)]
        return np.concatenate(parts)
    n = len(keys)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    x = (keys >> U64(24) << U64(24)) | np.arange(n, dtype=U64)
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: n - width + 1], x[width - span : n - span + 1])
    return (x[: n - width + 1] & U64((1 << 24) - 1)).astype(np.int64)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges(a, b)``; component is the smallest node reached.

    Alternating large-star and small-star rounds, each a min per node with map-side combine and an
    equi join that adaptive execution can split. Rounds are written to the shared folder, and only a
    count and a checksum come to the driver.
    """
    spark = edges.sparkSession
    cur = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = durable(small.where("u <> v").distinct())
        discard(cur)
        cur = new
        row = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError("connected components did not settle")
    # at the fixed point every edge is (node, smallest node of its component)
    return spark.createDataFrame([], "node long, component long").unionAll(cur.select(F.col("u").alias("node"), F.col("v").alias("component"))).unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, low, n, n_ids, text): each different text once, with its smallest doc_id, its rows and
    those with a doc_id. Copies collapse on the map side. The key is half of the text's SHA-256."""
    one = docs.select(text_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return one.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.count("doc_id").alias("n_ids"), F.first("text").alias("text"))


def text_key(text: str = "text"):
    return F.substring(text_digest(text), 1, 16)


def joined_bytes(texts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, ``gap`` after each, and where each begins (one entry more at the end)."""
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=begin[1:])
    return np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8), begin


def runs_of(mask: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs where ``mask`` holds and each of ``same`` stays equal."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.ones(len(mask) + 1, dtype=bool)
    cut[1:-1] = mask[1:] != mask[:-1]
    for s in same:
        cut[1:-1] |= s[1:] != s[:-1]
    at = np.flatnonzero(cut)
    on = mask[at[:-1]]
    return at[:-1][on], at[1:][on]


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
