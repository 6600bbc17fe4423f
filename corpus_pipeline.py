"""Corpus cleaning pipeline: toxicity, exact dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the
columns they got. Nulls: a null text counts as empty, a null doc_id equals another null. Of rows that
share a doc_id and a text, the dedup stages keep one at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid.llm import common, exact_dedup, packing, simhash_dedup, suffix_dedup, toxicity_svm

#: Documents of this score and above are toxic.
TOXIC = 0.3
#: Bits in which fingerprints of near copies differ at most.
NEAR_BITS = 6
SEQUENCE = 4096
TOKENIZER, END = "word_bpe_49k.json", 2
ORACLE_SQL = None


def packed(docs: DataFrame, **more) -> DataFrame:
    """``docs`` as one column ``row`` beside ``more``, so that no names clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go. It learns from the labelled documents
    outside the held-out fold that are still in ``docs``. Null and empty texts are scored as any other,
    long ones whole; repeated rows get equal scores, so they stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity_svm.train(docs.select("doc_id", "text"), labels, toxicity_svm.fold("doc_id", 4) != 2)
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # no names clash
    return toxicity_svm.with_score(plain, machine, "score").where(F.col("score") < TOXIC).drop("score").toDF(*docs.columns)


def one_row_a_text(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The columns of ``rows(digest, row)``; of each digest of ``groups(digest)`` only the row that is the
    smallest in order. Such digests are few; the others' rows are not moved when there are none."""
    groups = common.durable(groups)
    if groups.isEmpty():
        return rows.select("row.*")
    tied = rows.join(groups, "digest", "left_semi").groupBy("digest").agg(F.min("row").alias("row"))
    return rows.join(groups, "digest", "left_anti").select("row").unionByName(tied.select("row")).select("row.*")


def repeated_rows(marked: DataFrame) -> DataFrame:
    """The digests that stand more than once with one id, or with none."""
    return marked.groupBy("digest", "id").agg(F.count("*").alias("n")).where("n > 1").select("digest").distinct()


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones among them, one row with the largest doc_id stays; of several
    such rows, or where all ids are null, the smallest in the order of its columns."""
    old = F.coalesce(F.col("doc_id") % 2, F.lit(0)) == 0
    plain = docs.select("doc_id", "text")
    groups = exact_dedup.exact_dedup(plain.where(~old), plain.where(old)).select("digest", "keep_id")
    marked = packed(docs, digest=common.text_digest(), id=F.col("doc_id"))
    kept = marked.join(groups, "digest").where(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", "row")
    return one_row_a_text(kept, repeated_rows(marked))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash of three-word shingles, at most NEAR_BITS of 64 bits differ), one row
    with the smallest doc_id stays; of rows that share it, one with the smallest text key, then the smallest in the
    order of its columns. Texts without words are one component."""
    kept = simhash_dedup.similar_prints(docs.select("doc_id", "text"), 3, NEAR_BITS).where("kept").select(F.col("key").alias("kept_key"), F.col("doc_id").alias("kept_id")).distinct()
    marked = packed(docs, digest=common.text_digest(), key=common.text_key(), id=F.col("doc_id"))
    rows = marked.join(kept, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return one_row_a_text(rows.select("digest", "row"), repeated_rows(marked))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go from the texts; n_chars follows where there is such a column. No row
    goes; rows that share a text lose the same bytes, a null text becomes empty."""
    cut = suffix_dedup.suffix_dedup(docs.select("doc_id", "text")).select(F.col("key").alias("cut_key"), "kept_text")
    joined = packed(docs, key=common.text_key()).join(cut, F.col("key") == F.col("cut_key"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences, for every row; an empty or null text is its end token."""
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return packing.pack_documents(docs.select("doc_id", "text"), f.read(), END, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
