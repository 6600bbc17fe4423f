"""Fill-in-the-middle, whitening and quality rules against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardgrid.llm import fill_in_middle as fim
from hazardgrid.llm import quality_rules as qr
from hazardgrid.llm import whitening as wh

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    line = lambda n: " ".join(r.choice(["alpha", "beta.", "naïve", "das", "x|y", "😀"]) for _ in range(n))
    rows = [(i, "\n".join(line(r.randrange(12)) for _ in range(r.randrange(9))) + r.choice(["", "\n", "\n\n"])) for i in range(120)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (None, None), (500, None), (501, ""), (502, "\n"), (503, " \t\r\n\x0b"), (504, "one"), (505, "a\x01b\x02\nc\x02c\x01\n\x02ed"), (506, "has <P> marker"), (507, "ends with <"), (508, "<S"), (509, "x<M>"), (-7, "minus\nid\n")]
    rows += [(600, "w" * 300_000 + "\n" + "\n".join(f"row {i} of a long text ends here." for i in range(20_000))), (601, "same line\n" * 5000)]
    return rows


def docs_of(spark, rows, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in ("n", "form", "words", "lines", "marked", "kept", "windows", "head")]) if extra else docs


def middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_version(spark, texts):
    got = fim.fill_in_middle(docs_of(spark, texts)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(middle(*t)) for t in texts)
    assert {g.form for g in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_is_undone(spark, texts):
    out = fim.fill_in_middle_rows(docs_of(spark, texts)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert collections.Counter((o.doc_id, o.restored_sha256) for o in out) == collections.Counter((d, sha(t)) for d, t in texts)


def test_fill_in_middle_parameters(spark, texts):
    out = fim.fill_in_middle(docs_of(spark, texts), seed=3, rate=0).collect()
    assert {o.form for o in out} == {"plain"}
    markers = ("[pre]", "{suf}", "(mid)")
    out = fim.fill_in_middle(docs_of(spark, texts), spm=100, markers=markers)
    assert {o.form for o in out.collect()} <= {"plain", "spm"}
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"), markers).alias("t")).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((d, t or "") for d, t in texts)
    for bad in (("<P>", "<P>", "<M>"), ("<", "<S>", "<M>"), ("ab", "ba", "c"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs_of(spark, texts), markers=bad)
    assert fim.fill_in_middle_rows(docs_of(spark, [])).collect() == []


def rules_row(doc_id, text, r=qr.Rules()):
    text = text or ""
    words = re.findall(SPACE, text)
    n = len(words)
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    failed = []
    for x in lines:
        w = len(re.findall(SPACE, x))
        over = lambda pattern, share: 100 * len(re.findall(pattern, x)) > round(100 * share) * w  # noqa: B023, E731
        unmarked = not re.search(qr.END.replace(r"\z", r"\Z"), x.rstrip(qr.SPACE)) and len(re.findall(qr.MARK.replace(r"\z", r"\Z"), x)) * r.words_a_mark < w
        separated = len(re.findall(qr.SEPARATOR, x)) >= 2 and over(qr.SEPARATOR, r.most_separators)
        if unmarked or separated or over(qr.SYMBOL, r.most_symbols) or over(qr.HEAPED, r.most_heaped) or (w < r.boilerplate_words and re.search(qr.BOILERPLATE, x)):
            failed.append(w)
    base = n < 50 or 100 * len(covered) > 50 * n
    kept = not base and 100 * sum(failed) <= round(100 * r.most_lost) * n
    return doc_id, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base, kept, len(lines), len(failed), sum(failed)


def test_quality_rules_equal_plain_version(spark, texts):
    r = random.Random(5)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" + ("." if k % 8 == 7 else "") for k in range(n)) + "."
    more = [(700, prose(80)), (701, "\n".join([prose(60), "Home | About | News | Help", "Copyright (c) 2020. All rights reserved."])), (702, " ".join(f"{w}###" for w in prose(90).split())), (703, prose(60) + "\n" + "no end mark here " * 40), (704, (prose(30) + "\n") * 3), (705, prose(50)[:-1] + "!!\n" + prose(20)), (706, "word " * 200)]
    rows = texts + more
    got = qr.quality_rules(docs_of(spark, rows)).drop("cleaned_text")
    want = sorted(repr(rules_row(*t)) for t in rows)
    assert sorted(repr(tuple(g)) for g in got.collect()) == want
    kept = {g.doc_id: g.kept for g in got.collect()}
    assert kept[700] and kept[701] and not kept[702] and not kept[703] and not kept[704] and kept[705] and not kept[706]


def test_quality_rules_clean_lines(spark):
    text = "A good line of prose stands here.\nHome | About | News | Help\n\nAnother one ends well!\nread our privacy policy now."
    row = qr.quality_rules(docs_of(spark, [(1, text)])).first()
    assert row.cleaned_text == "A good line of prose stands here.\n\nAnother one ends well!" and row.n_failed_lines == 2
    assert qr.quality_rules(docs_of(spark, [])).collect() == []
    assert "Python" not in qr.quality_rules(docs_of(spark, [(1, text)]))._jdf.queryExecution().executedPlan().toString()


def plain_whitening(rows):
    """(rows kept, n, deviations, covariance) by the standard library and NumPy."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    a = np.array(x, dtype=np.float64)
    a -= a.mean(axis=0)
    return good, n, dev, a.T @ a / n, a


def test_whitening_equals_plain_version(spark):
    r = np.random.default_rng(2)
    mix = r.normal(size=(12, 12)) * np.geomspace(3, 0.02, 12)
    vectors = (r.normal(size=(400, 12)) @ mix + 5).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0]), (None, vectors[1]), (900, None), (901, []), (902, [None] + vectors[2][1:]), (903, [float("nan")] + vectors[2][1:]), (904, [float("inf")] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("n"), F.lit("x").alias("w"), F.lit("y").alias("component"))
    good, n, dev, cov, centred = plain_whitening(rows)
    got = wh.whiten(frame.repartition(7)).collect()
    assert len(got) == 8 * n and {g.n for g in got} == {n}
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    want = centred @ basis[:, :8] / np.sqrt(values[:8])
    mine = {}
    for g in got:
        mine.setdefault((g.vec_id, g.deviation), {})[g.component] = g.whitened
        assert abs(g.explained - values[g.component - 1] / values.sum()) < 1e-9
        assert g.identity_error < 1e-9
    sign = np.sign([mine[good[0][0], dev[0]][k + 1] * want[0, k] for k in range(8)])
    for (i, _), t, w in zip(good, dev, want, strict=True):
        assert np.allclose([mine[i, t][k + 1] for k in range(8)], w * sign, atol=1e-7)
    again = wh.whiten(frame.coalesce(1)).collect()
    assert sorted(repr((g.vec_id, g.component, g.whitened)) for g in again) == sorted(repr((g.vec_id, g.component, g.whitened)) for g in got)


def test_whitening_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert wh.whiten(frame([])).collect() == [] and wh.whiten(frame([(1, None), (2, [])])).collect() == []
    one = wh.whiten(frame([(1, [0.5, 0.25])])).collect()
    assert [(g.component, g.n, g.deviation, g.whitened, g.identity_error) for g in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    line = wh.whiten(frame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)] + [(9, [1.0])])).collect()
    first = [g for g in line if g.component == 1]
    assert len(line) == 15 and {g.vec_id for g in line} == set(range(5)) and all(g.whitened is None for g in line if g.component > 1)
    assert abs(sum(g.whitened**2 for g in first) / 5 - 1) < 1e-12 and abs(first[0].explained - 1) < 1e-12
    far = wh.whiten(frame([(1, [1e9]), (2, [-1e9])])).collect()
    assert all(g.deviation == (2 * 1024 * 10**9) ** 2 if (2 * 1024 * 10**9) ** 2 < 2**63 else g.deviation is None for g in far)
    with pytest.raises(Exception, match="too large"):
        wh.whiten(frame([(1, [1e20]), (2, [0.0])])).collect()


def test_jacobi_keeps_small_eigenvalues():
    r = np.random.default_rng(0)
    scale = np.geomspace(1, 1e-9, 16)
    b = r.normal(size=(16, 16)) / 4 + np.eye(16)
    a = (b @ b.T) * scale[:, None] * scale
    values, basis = wh.jacobi(a)
    assert np.all(np.diff(values) <= 0) and np.allclose(basis.T @ basis, np.eye(16), atol=1e-13)
    assert abs(np.sum(np.log(values)) - np.sum(2 * np.log(scale)) - np.linalg.slogdet(b @ b.T)[1]) < 1e-9
    assert np.allclose(wh.jacobi(np.zeros((3, 3)))[0], 0) and wh.jacobi(np.array([[4.0]]))[0][0] == 4
