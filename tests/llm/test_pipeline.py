"""The stages on a small table against plain versions."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ta", "re", "no", "li", "su", "ke"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    passage = text(60)
    for i in range(300):
        bad = i % 6 == 0
        body = text(80) + (" grubsnout wormbrain" if bad else "") + (" " + passage if i % 50 == 1 else "")
        rows.append((i, body, "en", "src", len(body)))
        labels.append((i, 1, int(bad)))
    near = rows[2][1].split()
    near[3] = "changed"
    rows += [(1001, rows[1][1], "en", "src", 1), (1002, " ".join(near), None, None, None), (1003, None, None, None, None), (1004, "", "en", "src", 0)]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows, passage


def test_stages(spark, folder):
    sf_dir, rows, passage = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.common.durable(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        kept.append({t.doc_id: t for t in out.collect()})
        docs = out
    clean, exact, near, cut = kept
    assert set(clean) == {r[0] for r in rows if not (r[0] % 6 == 0 and r[0] < 300)}
    assert set(exact) == set(clean) - {1, 1003}
    assert set(near) == set(exact) - {1002}
    assert set(cut) == set(near)
    with_passage = [i for i in near if passage in (near[i].text or "")]
    assert with_passage and all(passage not in cut[i].text and len(cut[i].text) < len(near[i].text) for i in with_passage)
    assert all(cut[i].text == near[i].text for i in near if i not in with_passage)
    assert all(t.n_chars == len(t.text) for t in cut.values() if t.n_chars is not None)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {t.doc_id for t in pieces.collect()} == set(cut)
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]


def test_one_of_repeated_rows_stays(spark, tmp_path):
    """Rows that share text and doc_id, null ids, and near copies that share a doc_id."""
    r = random.Random(5)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(120))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    twice, unnamed, same_id, null_id, alone = (text() for _ in range(5))
    rows = [(1, twice, "en"), (1, twice, "en"), (1, twice, None), (None, unnamed, "en"), (None, unnamed, "de"), (3, same_id, "en"), (3, near(same_id), "en"), (None, null_id, "en"), (None, near(null_id), "en"), (9, alone, "en")]
    docs = spark.createDataFrame([(d, t, lang, "src", len(t)) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.common.durable(corpus_pipeline.drop_copies(spark, docs, ""))
    assert sorted(t.text for t in exact.collect()) == sorted({t for _, t, _ in rows})
    for start in (docs, exact):
        kept = corpus_pipeline.common.durable(corpus_pipeline.drop_near_copies(spark, start, ""))
        assert kept.schema == docs.schema and kept.count() == 5
    cut = corpus_pipeline.drop_repeated_passages(spark, kept, "").collect()
    assert len(cut) == 5 and all(len(t.text) > 500 for t in cut)


NAMES = "__digest __key __score __keep __kept __id __text __row digest key row id keep_id kept kept_key kept_id cut_key kept_text toxic_score".split()


def test_columns_of_any_name_and_long_texts(spark, folder):
    """Columns named as helpers are come through unchanged; a text of 1 MB is kept whole; no rows give none."""
    sf_dir, rows, _ = folder
    r = random.Random(9)
    long = " ".join(f"v{r.randrange(10**7)}" for _ in range(130_000))
    docs = spark.createDataFrame([x[:2] for x in rows[:60]] + [(5000, long), (5001, None), (5001, None)], "doc_id long, text string")
    docs = docs.select(*[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES], "doc_id", "text", F.col("doc_id").alias("n_chars"), F.lit(1).alias("a.b"))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = (corpus_pipeline.common.durable(stage(spark, x, sf_dir)) for x in (docs, empty))
        got = docs.collect()
        assert docs.columns == [*NAMES, "doc_id", "text", "n_chars", "a.b"] == empty.columns and empty.isEmpty()
        assert got and all(t[n] == f"{n}{t.doc_id}" for t in got for n in NAMES) and all(t["a.b"] == 1 for t in got)
        assert [t.text for t in got if t.doc_id == 5000] == [long]
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, empty, sf_dir).isEmpty() and pack(spark, docs, sf_dir).where("doc_id = 5000").count() > 20


def test_names():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
