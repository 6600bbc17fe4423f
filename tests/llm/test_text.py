import base64
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from hazardgrid.llm import packing, quality_knn, token_counts, toxicity_svm, word_cutter  # noqa: E402
from hazardgrid.llm.bpe_codec import Pieces, Seams, bpe_encode, bpe_roundtrip, merges_of, splitter  # noqa: E402
from hazardgrid.llm.word_tokens import word_encoder  # noqa: E402

PIECES = list(" \n\t'strevmldxA19!") + ["é", "中", "　", " ", " ", "²", "́", " ", "'", "\x01", "\x00", "\x1c", "\x85", "😀", "<|endoftext|>", "<|startoftext|>", "'s", "'re", "É", "ß", "İ", "€", "á", "½", "×"]


def strings(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 16))) for _ in range(n)]


def read(name, mode="rb"):
    with open(P.path(name), mode) as f:
        return f.read()


def frame(spark, texts):
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(900001, None, "c"), (900002, "", "c"), (None, "a b", "c"), (0, texts[0], "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), rows


def test_counts_equal_the_library(spark):
    texts = strings(3000) + ["x" * 5000, " " * 3000, "a\n" * 4000]
    docs, rows = frame(spark, texts)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs, read("byte_bpe_50k.json").decode()).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows]
    assert sorted(map(str, [(g.doc_id, g.n_bytes, g.n_tokens) for g in got])) == sorted(map(str, want))
    assert all(g.over_limit == (g.n_tokens > 1024) for g in got)


def test_machine_equals_plain_merging():
    """Every transition's gain against the library, over words of few letters that merge in many ways."""
    spec = read("byte_bpe_50k.json").decode()
    library, machine = Tokenizer.from_str(spec), token_counts.Counter(spec).machine
    r = random.Random(4)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 14))) for _ in range(4000)] + ["e" * n for n in range(1, 70)] + ["=" * 130, "in" * 40, "\u4e2d\u6587" * 30]
    assert machine.count(words) == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_blocks_compose():
    lexer = word_cutter.Lexer()
    r = np.random.default_rng(1)
    classes = r.integers(0, word_cutter.CLASSES, 5000).astype(np.uint8)
    state, starts = word_cutter.FRESH, set()
    for i, c in enumerate(classes.tolist()):
        out = lexer.out[state, c]
        if out & word_cutter.HERE:
            starts.add(i)
        if out & word_cutter.BACK:
            starts.add(i - 1)
        state = lexer.to[state, c]
    assert lexer.starts(classes).tolist() == sorted(starts)


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = strings(5000, 2)
    got = word_encoder(read("word_bpe_49k.json").decode())(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library_and_decodes(spark):
    lines = read("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = strings(400, 3) + ["z" * 300, "the quick brown fox " * 40]
    docs, rows = frame(spark, texts)
    got = bpe_encode(docs, lines, P.PATTERN).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows]
    assert sorted(str((g.doc_id, list(g.ids), bytes(g.decoded))) for g in got) == sorted(map(str, want))
    assert {g.doc_id: g.n_tokens for g in bpe_roundtrip(docs.where("doc_id < 5"), lines, P.PATTERN).collect()} == {d: len(i) for d, i, _ in want if d is not None and d < 5}


def test_words_of_equal_hashes_stay_apart(spark):
    one, two = brute.thue_morse(2048, "a", "b")
    words, which, counts = splitter(P.PATTERN)([one, two, one + " x"])
    assert [words[k] for k in which] == [one, two, one, " x"] and counts.tolist() == [1, 1, 2]
    texts = [one, two]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(frame(spark, texts)[0], read("byte_bpe_50k.json").decode()).where("doc_id in (0, 1)").collect()
    assert sorted({(g.doc_id, g.n_tokens) for g in got}) == [(i, len(library.encode(t).ids)) for i, t in enumerate(texts)]


def test_long_words_are_encoded_exactly(spark):
    lines = read("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "z" * 100_000, "the" * 3000 + " " + "\u4e2d\u6587" * 400, "=" * 500 + "\u00e9" * 300, "".join(chr(r.randint(0x4e00, 0x4fff)) for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for g in bpe_encode(docs, lines, P.PATTERN).collect():
        assert list(g.ids) == library.encode_ordinary(texts[g.doc_id]) and bytes(g.decoded).decode() == texts[g.doc_id]


def test_words_are_folded_in_parts_that_no_token_crosses():
    """Words made of the same parts share them, so that less is folded than whole words."""
    lines = read("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines())}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    seams, pieces = Seams(ranks), Pieces(ranks, merges_of(ranks)[0])
    r = random.Random(11)
    heads, tails = [["".join(r.choice("aeinrstkwzqx") for _ in range(6)) for _ in range(60)] for _ in range(2)]
    words = [(" " + a + b).encode() for a in heads for b in tails] + ["\u4e2d\u6587\u00e9".encode() * 9, b"x", bytes(range(256))]
    parts, counts = seams.parts(words)
    at = 0
    for w, n in zip(words, counts.tolist(), strict=True):
        own, at = parts[at : at + n], at + n
        ends = lambda some: set(np.cumsum([len(x) for x in some]).tolist())
        assert b"".join(own) == w and ends(own) <= ends(pieces.of(w))
        if w.decode(errors="ignore").encode() == w and w not in ranks:
            assert [i for x in own for i in pieces.merged(x)] == library._encode_single_piece(w)
    assert at == len(parts) and sum(map(len, set(parts))) < sum(map(len, set(words))) / 2
    assert [len(x) for x in seams.parts([])] == [0, 0]


def test_splitter_paths_agree():
    import regex

    cut, plain = splitter(P.PATTERN), regex.compile(P.PATTERN)
    texts = strings(5000, 4)
    words, which, counts = cut(texts)
    assert [words[k] for k in which] == [w for t in texts for w in plain.findall(t)]
    assert counts.tolist() == [len(plain.findall(t)) for t in texts]


def test_packs_fill_and_keep_everything(spark):
    texts = strings(300, 5) + ["word " * 9000, "one two three " * 700]
    docs, rows = frame(spark, texts)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, read("word_bpe_49k.json").decode(), 2, 256).collect()
    import zlib

    total = {}
    for g in got:
        ids = np.array([*library.encode((rows[0][1] if g.doc_id == 0 else dict((d, t) for d, t, _ in rows)[g.doc_id]) or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert g.doc_tokens == len(ids) and g.ids_crc32 == zlib.crc32(ids[g.start : g.start + g.length].tobytes())
        total[g.doc_id] = total.get(g.doc_id, 0) + g.length
    assert total[0] == 2 * [g for g in got if g.doc_id == 0][0].doc_tokens and total[900001] == total[900002] == 1
    by = {}
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert by.get(g.sequence_id, 0) == g.offset
        by[g.sequence_id] = g.offset + g.length
    assert max(by.values()) <= 256
    for g in got:
        full = by[g.sequence_id]
        assert g.padded_length == (full if full & full - 1 == 0 else 256)


def test_plan_packs():
    r = random.Random(1)
    histogram = {r.randint(1, 64): r.randint(1, 500) for _ in range(40)}
    packs = packing.plan_packs(histogram, 64)
    count = {}
    for n, lengths in packs:
        assert sum(lengths) <= 64
        for x in lengths:
            count[x] = count.get(x, 0) + n
    assert count == histogram
    assert packing.plan_packs({}, 64) == []


def words(r, n):
    return " ".join("".join(r.choice(["ta", "re", "no", "li", "su", "ke"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        bad, junk = r.random() < 0.2, r.random() < 0.2
        text = words(r, 60)
        if bad:
            text += " " + r.choice(["idiot", "grubsnout", "wormbrain"]) + ". " + words(r, 20) + " " + r.choice(["idiot", "grubsnout", "wormbrain"])
        if junk:
            text = " ".join(w + "$$$" for w in text.split()[:30]) + " " + "no no no no no " * 6 + text
        rows.append((i, text, i))
        labels.append((i, int(not junk), int(bad)))
    rows += [(9000, None, 0), (9001, "", 0), (None, "ta re", 0), (9002, words(r, 20000), 0), (9003, "ta re gr-ubsnout li", 0), (9004, "ta w o r m b r a i n no", 0), (9005, "ta grubsn0out li", 0)]
    labels += [(9001, None, None), (None, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check(result, labels, column):
    rows = result.join(labels.groupBy("doc_id").agg(F.max(column).alias("y")), "doc_id").where("held_out and y is not null").collect()
    assert len(rows) > 50
    return sum(t.predicted == t.y for t in rows) / len(rows)


def test_toxicity(spark, labelled):
    docs, labels = labelled
    got = toxicity_svm.toxicity(docs, labels)
    assert check(got, labels, "toxic") > 0.95
    by = {t.doc_id: t for t in got.collect()}
    assert len(by) == docs.count() and all(0 <= t.score <= 1 for t in by.values())
    assert by[9000].predicted == by[9001].predicted == by[9002].predicted == 0
    assert by[9003].predicted == by[9004].predicted == 1
    assert by[9005].score > by[9002].score


def test_quality(spark, labelled):
    docs, labels = labelled
    got = quality_knn.quality(docs, labels)
    assert check(got, labels, "quality") > 0.95
    by = {t.doc_id: t for t in got.collect()}
    assert len(by) == docs.count() and all(0 <= t.score <= 1 for t in by.values())
    assert by[9000].score == by[9001].score


def test_classifiers_without_labels(spark, labelled):
    docs, labels = labelled
    none = labels.limit(0)
    assert toxicity_svm.toxicity(docs, none).where("predicted = 1").count() == 0
    assert quality_knn.quality(docs, none).count() == docs.count()
    empty = docs.limit(0)
    assert toxicity_svm.toxicity(empty, labels).count() == quality_knn.quality(empty, labels).count() == 0


def test_voting_equals_plain_cosines():
    r = np.random.default_rng(0)
    x, y = np.abs(r.standard_normal((80, quality_knn.TERMS))).astype(np.float32), r.integers(0, 2, 80)
    voters = quality_knn.Voters(x, y)
    a = voters.project(x[:10])
    for k, got in enumerate(voters.vote(x[:10])):
        near = voters.vectors @ a[k] / quality_knn.VECTOR_UNIT**2
        top = np.argsort(-near, kind="stable")[: quality_knn.NEIGHBOURS]
        weight = np.maximum(near[top], 0) ** 8
        assert abs(got - (weight * y[top]).sum() / weight.sum()) < 1e-3


def test_quality_is_a_function_of_the_text(spark, labelled):
    """Whatever the partitions, with repeated documents and labels, ties among neighbours and the ends of
    long words."""
    docs, labels = labelled
    more = docs.unionByName(docs.where("doc_id % 3 = 0"))
    want = {r.doc_id: r.score for r in quality_knn.quality(more, labels.unionByName(labels)).collect()}
    for parts in (1, 7):
        got = quality_knn.quality(more.repartition(parts, "text"), labels).collect()
        assert len(got) == more.count() and all(want[r.doc_id] == r.score for r in got)
    long = ["a1" * 40 + "Z", "a1" * 40 + "z"]
    assert len({quality_knn.shape(w) for w in long}) == 2
    x = np.repeat(np.abs(np.random.default_rng(1).standard_normal((2, quality_knn.TERMS))), 30, axis=0).astype(np.float32)
    voters = quality_knn.Voters(x, np.tile([1, 0], 30))
    whole = voters.vote(x)
    assert all(voters.vote(x[k : k + 1])[0] == whole[k] for k in range(60)) and abs(whole[0] - 8 / 15) < 1e-6


def test_quality_query_equals_a_plain_version(spark, labelled):
    docs, labels = labelled
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(rows)
    known = {r.doc_id: r.quality for r in labels.collect() if None not in (r.doc_id, r.quality) and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    ids = sorted(known)
    terms = quality_knn.Terms()
    x, y = terms.counts([texts[i] or "" for i in ids]).astype(float), np.array([known[i] for i in ids])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    axes = np.linalg.svd(x * idf, full_matrices=True)[2][: quality_knn.DIMENSIONS]
    got = {r.doc_id: r.score for r in quality_knn.quality(docs, labels).collect()}
    base = (x * idf) @ axes.T
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    differ = 0
    for i, text in rows:
        one = terms.counts([text or ""]).astype(float)[0]
        if not one.any():
            assert abs(got[i] - y.mean()) < 1e-9
            continue
        z = axes @ (one * idf)
        near = base @ (z / np.linalg.norm(z))
        top = np.argsort(-near, kind="stable")[: quality_knn.NEIGHBOURS]
        weight = np.maximum(near[top], 0) ** 8
        differ += abs(got[i] - (weight * y[top]).sum() / weight.sum()) > 1e-3
    assert differ <= len(rows) // 100  # near ties in the plain version's last places


def test_machine_equals_its_kernel():
    good, bad = ["idiot", "moron", "stupid"], ["ta", "reno", "liket", "sukeno"]
    kernel = toxicity_svm.Kernel([*good, *bad])
    w, offset = toxicity_svm.train_svm(kernel.features([*good, *bad]), np.array([1, 1, 1, -1, -1, -1, -1]), np.ones(7))
    machine = toxicity_svm.Machine(kernel.numbers, kernel.weights(w), offset)
    some = ["idiot", "idixot", "moronta", "liket", "no"]
    assert np.allclose(machine.margins(some, machine.table()), kernel.features(some) @ w + offset, atol=1e-4)
    table = machine.table()
    assert machine.margins(["idxiot"], table)[0] > machine.margins(["liket"], table)[0]


def test_kernel_equals_plain_subsequences():
    marks = ["idiot", "moron", "abcdab"]
    kernel = toxicity_svm.Kernel(marks)
    some = ["idixot", "moon", "mo-ron", "aabbccdd", "no"]
    got = kernel.values(some) * toxicity_svm.norms(some)[:, None] * toxicity_svm.norms(marks)
    for i, a in enumerate(some):
        for j, b in enumerate(marks):
            plain = brute.subsequence_kernel("^" + a, "^" + b, toxicity_svm.DECAY, toxicity_svm.SPAN)
            assert abs(got[i, j] - plain) < 1e-4


def test_repeated_stems_are_toxic_together(spark):
    """A stem that clean documents use once and toxic ones several times."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.25
        stems = ["gruv" + words(r, 1) for _ in range(4 if bad else r.random() < 0.15)]
        text = (words(r, 40) + " " + " ".join(stems)).split()
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = toxicity_svm.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [t.predicted for t in seen if t.toxic]
    clean = [t.predicted for t in seen if not t.toxic]
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.05 * len(clean)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, read("byte_bpe_50k.json").decode()).count() == 0
    assert packing.pack_documents(none, read("word_bpe_49k.json").decode(), 2).count() == 0
    assert bpe_roundtrip(none, read("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_words_that_are_tokens_need_no_merge():
    """Whole words of the vocabulary are looked up; tokens that are no text stand for no word, not even for U+FFFD."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"xyz": 258, b"\xef\xbf": 259, b"\xff\xfe\xfd": 260}
    merges, whole = merges_of(ranks)
    assert sorted(merges) == [(97, 98, 256), (239, 191, 259), (256, 99, 257)]
    assert (whole["ab"], whole["abc"], whole["xyz"]) == ([256], [257], [258])
    assert not any("\ufffd" in w for w in whole)
