import collections
import os
import random
import sys

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from hazardgrid.llm import common  # noqa: E402
from hazardgrid.llm.embedding_dedup import embedding_dedup  # noqa: E402
from hazardgrid.llm.exact_dedup import dedup_documents, fuse_build, fuse_contains  # noqa: E402
from hazardgrid.llm.simhash_dedup import LOWER, near_copies, simhash_dedup  # noqa: E402
from hazardgrid.llm.substring_dedup import substring_dedup  # noqa: E402
from hazardgrid.llm.suffix_dedup import repeated_windows, suffix_dedup_rows  # noqa: E402


def test_substring_tells_long_words_apart(spark):
    for n in (1024, 2048):
        one, two = brute.thue_morse(n, "a", "b")
        rows = [(1, "same " * 12 + one), (2, "same " * 12 + two), (3, "same " * 12 + two)]
        got = [(g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in substring_dedup(docs(spark, rows)).collect()]
        assert brute.ordered(got) == brute.ordered(brute.substring(rows))


def docs(spark, rows):
    """With columns whose names clash with results."""
    full = [(d, t, "x", 1, "y") for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, kept string, component_id int, key string")


def corpus(seed):
    """Words with shared passages, copies, nulls, empty and very long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ñ"[:5]) for _ in range(r.randint(1, 4)))
    text = lambda n: r.choice([" ", "\n"]).join(word() for _ in range(n))
    passages = [text(60) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [text(r.randint(0, 80))]
        for p in passages:
            if r.random() < 0.4:
                at = r.randint(0, 20)
                parts += [p[at : at + r.randint(30, 400)], text(r.randint(0, 30))]
        rows.append((i * 3, " ".join(parts)))
    long = text(3000)
    near = long[:4000] + "zz" + long[4000:]
    extra = [(500, long), (501, near), (502, rows[0][1]), (-7, rows[1][1]), (503, ""), (504, None), (505, ""), (506, "Of " * 800), (507, "a" * 900), (508, "a" * 200), (509, "a" * 199), (None, rows[2][1]), (None, passages[0])]
    return rows + extra + [rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring(spark, seed):
    rows = corpus(seed)
    got = substring_dedup(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert brute.ordered(got) == brute.ordered(brute.substring(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup_rows(docs(spark, rows)).collect()
    assert brute.ordered(got) == brute.ordered(brute.suffix(rows))


def test_corpus_order_finds_repeated_windows():
    r = random.Random(4)
    base = bytes(r.choice(b"ab") for _ in range(400))
    contexts, leads, sizes = [], [], []
    for _ in range(30):
        at, size = r.randint(0, 100), r.randint(1, 30)
        piece = bytearray(base[at : at + size - 1 + 200])
        if r.random() < 0.5:
            piece[r.randrange(len(piece))] ^= 1
        contexts.append(bytes(piece))
        leads.append(r.randint(size - 1, 100))
        sizes.append(size)
    who, start, again = repeated_windows(contexts, np.array(leads), np.array(sizes), 200)
    windows = [(leads[w] - s, contexts[w][s : s + 200]) for w, s in zip(who.tolist(), start.tolist(), strict=True)]
    count = {w: windows.count(w) for w in windows}
    assert again.tolist() == [count[w] > 1 for w in windows]


def test_exact(spark):
    rows = corpus(5)
    got = dedup_documents(docs(spark, rows)).collect()
    size, top = {}, {}
    for d, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        top[t] = max([x for x in (top.get(t), d) if x is not None], default=None)
    want = [(d, top[t or ""], size[t or ""], d == top[t or ""], brute.sha((t or "").encode())) for d, t in rows]
    assert brute.ordered(got) == brute.ordered(want)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 20000])
def test_fuse_filter(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 60, n).astype(np.uint64)
    made = fuse_build(keys)
    assert fuse_contains(made, keys).all()
    assert fuse_contains(made, r.integers(0, 1 << 60, 50000).astype(np.uint64)).mean() < 1e-3


def slow_fingerprint(text, width=3):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rows = corpus(6)
    r = random.Random(1)
    long = "word".join(str(r.random()) + " " for _ in range(20000))
    rows += [(900 + k, long.replace("7 ", "7x ", k)) for k in range(4)] + [(920, long.upper())]
    prints = [slow_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = brute.components(len(rows), links)
    low = {}
    for (d, _), g in zip(rows, group, strict=True):
        low[g] = min([x for x in (low.get(g), d) if x is not None], default=None)
    want = [(d, f"{p:016x}", low[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)]
    got = simhash_dedup(docs(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert brute.ordered(got) == brute.ordered(want)
    assert len(set(group)) < len(set(prints))


def test_hamming_links(spark):
    from hazardgrid.llm.simhash_dedup import hamming_links

    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for k in range(3):
            w = v
            for b in r.sample(range(64), k + 1):
                w ^= 1 << b
            values.append(w)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    got = {(p.a, p.b) for p in hamming_links(spark.createDataFrame([(v,) for v in values], "fp long")).distinct().collect()}
    assert got == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_joining_links(spark):
    """Components of all fingerprints up to six bits apart, in sparse cells and in crowded ones, and no more rows than
    fingerprints a task."""
    from hazardgrid.llm import simhash_dedup as sd

    r = random.Random(4)
    flipped = lambda v, n: v ^ sum(1 << b for b in r.sample(range(64), n))
    family = r.getrandbits(64)
    values = [r.getrandbits(64) for _ in range(60)] + [flipped(family, r.randint(2, 5)) for _ in range(150)]
    for v in values[:60]:
        values += [flipped(v, 6), flipped(v, 7)]
    values = sorted(set(values))
    want = brute.components(len(values), [(i, j) for i, a in enumerate(values) for j in range(i) if (a ^ values[j]).bit_count() <= 6])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for cell in (sd.LISTED_CELL, 4):
        old, sd.LISTED_CELL = sd.LISTED_CELL, cell
        try:
            found = sd.joining_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 6).collect()
        finally:
            sd.LISTED_CELL = old
        place = {v: i for i, v in enumerate(signed)}
        links = [(place[p.a], place[p.b]) for p in found]
        assert brute.components(len(values), links) == want and len(links) < len(values) * len(sd.BYTE_PAIRS)
    assert len(set(want)) < len(values) - 150


def test_near_copies(spark):
    r = random.Random(8)
    text = lambda n: [f"w{r.randrange(100000)}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(30):
        words = text(200)
        rows.append((2 * k, " ".join(words)))
        words[r.randrange(200)] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
        pairs.append((2 * k, 2 * k + 1))
    rows += [(100, ""), (101, None), (102, "one"), (103, "one two"), (None, "three four five six seven")]
    got = {t.doc_id: (t.component_id, t.kept) for t in near_copies(docs(spark, rows)).collect()}
    assert all(got[b] == (a, False) and got[a] == (a, True) for a, b in pairs)
    assert got[100][0] == got[101][0] == 100 and got[102][1] and got[103][1]


def links_and_components(spark, rows):
    """Components of the exact similarity, and those that were found."""
    def shingles(text):
        w = (text or "").encode().translate(LOWER).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = {d: rows[g][0] for (d, _), g in zip(rows, brute.components(len(rows), links), strict=True)}
    got = {t.doc_id: (t.component_id, t.kept) for t in near_copies(docs(spark, rows)).collect()}
    assert all(kept == (d == c) for d, (c, kept) in got.items())
    return len(links), want, {d: c for d, (c, _) in got.items()}


def passage_family(shared, pairs, seed):
    """Texts of 200 words, ``shared`` of them one passage, in pairs with two words changed."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    passage, rows = [word() for _ in range(shared)], []
    for k in range(pairs):
        own = [word() for _ in range(200 - shared)]
        twin = list(own)
        for at in r.sample(range(len(own)), 2):
            twin[at] = word()
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + twin))]
    return rows


def test_similar_prints_by_fingerprints(spark):
    """The pipeline's near copies are those of the fingerprints, whatever their sets of shingles are."""
    from hazardgrid.llm.simhash_dedup import fingerprint, similar_prints

    rows = passage_family(150, 40, 6) + [(900, ""), (901, None), (None, "one two three"), (None, "one two three")]
    prints = [fingerprint((t or "").encode()) for _, t in rows]
    group = brute.components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 6])
    low = {}
    for (d, _), g in zip(rows, group, strict=True):
        low[g] = min([x for x in (low.get(g), d) if x is not None], default=None)
    got = similar_prints(docs(spark, rows)).collect()
    assert brute.ordered([(t.doc_id, t.component_id) for t in got]) == brute.ordered([(d, low[g]) for (d, _), g in zip(rows, group, strict=True)])
    assert all(t.kept == (t.doc_id == t.component_id) for t in got if t.doc_id != 901) and len(set(group)) < len(rows) - 10


@pytest.mark.parametrize("shared", [100, 150])
def test_near_copies_with_a_shared_passage(spark, shared):
    n, want, got = links_and_components(spark, passage_family(shared, 150, 4))
    assert n == 150 and got == want


def test_near_copies_in_crowded_cells(spark):
    """One family whose texts link in chains, and texts that share nearly all with it and don't link."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(10**6)}"
    base = [word() for _ in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4, 5])):
            words[at] = word()
        rows.append((k, " ".join(words)))
    n, want, got = links_and_components(spark, rows)
    assert got == want and 1 < len(set(want.values())) < 60


def test_near_copies_beside_unlinked_relatives(spark):
    """Pairs in families of several pairs that share half of their shingles."""
    rows = []
    for family in range(5):
        rows += [(60 * family + d, t) for d, t in passage_family(110, 30, 100 + family)]
    n, want, got = links_and_components(spark, rows)
    assert n == 150 and got == want


def test_pairs_of_unlinked_relatives_are_not_written(spark):
    """Texts of a family that share most shingles but never link: their pairs stay in the tasks that test
    them; linked pairs across blocks are found."""
    from hazardgrid.llm import simhash_dedup as sd

    r = np.random.default_rng(8)
    common_part = r.integers(1, 1 << 62, 300)
    sets = [np.unique(np.concatenate([common_part, r.integers(1, 1 << 62, 60)])).astype("<u8") for _ in range(300)]
    sets += [np.unique(np.append(s[:-1], np.uint64(7 + i))) for i, s in enumerate(sets[:5])]  # five that do link
    rows = spark.createDataFrame([(i, len(s), bytearray(sd.parities(s))) for i, s in enumerate(sets)], "node long, size int, parity binary")
    hubs = spark.createDataFrame([(0, i, len(s), None if i else 0.0) for i, s in enumerate(sets)], "a long, b long, left long, apart double")
    parts = spark.createDataFrame([], "node long, component long")
    for block in (1024, 64):
        old, sd.GROUP_BLOCK = sd.GROUP_BLOCK, block
        try:
            got = {tuple(t) for t in sd._cross_pairs(hubs, parts, rows).collect()}
        finally:
            sd.GROUP_BLOCK = old
        assert got == {(i, 300 + i) for i in range(5)}


def test_near_copies_at_the_bound(spark):
    """90 shingles each, of which 80 (0.8 exactly), 79 or 78 are shared; repeats count once."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for k in range(150):
        words = [word() for _ in range(94)]
        shared = 84 - k % 3
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:shared] + [word() for _ in range(94 - shared)]))]
    rows += [(1000, "a b c d e f " * 3 + "g h i j k l"), (1001, "a b c d e f " * 30 + "g h i j k l")]
    n, want, got = links_and_components(spark, rows)
    assert n == 51 and got == want


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.25 * r.standard_normal((20, 16)), base[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in row], int(i % 3)) for i, row in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [None] + [1.0] * 15, 0), (104, rows[0][1], None), (105, [], 0), (106, [float("inf")] * 16, 0), (107, rows[0][1][:8], 0)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    good = [k for k, (i, v, lab) in enumerate(rows) if lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1], dtype=float) / np.linalg.norm(np.array(rows[k][1], dtype=float)) for k in good}
    links = [(a, b) for a in good for b in good if b < a and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93]
    group = brute.components(len(rows), links)
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    low = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        low[g] = min(low.get(g, i), i)
    want = [(i, count[k], low[group[k]], i == low[group[k]]) for k, (i, _, _) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert brute.ordered(embedding_dedup(frame).collect()) == brute.ordered(want)


def test_embeddings_in_split_buckets(spark, monkeypatch):
    """One family of near vectors in one bucket: blocks of it meet in pairs. Null ids and further columns do no harm."""
    from hazardgrid.llm import embedding_dedup as module

    monkeypatch.setattr(module, "BLOCK", 7)
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal(16) + 0.26 * r.standard_normal((60, 16)), r.standard_normal((20, 16))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(a, b) for a in range(80) for b in range(a) if unit[a] @ unit[b] >= 0.93]
    assert 200 < len(links) < 1700
    group, count = brute.components(80, links), collections.Counter(k for p in links for k in p)
    rows = [(None if i == 3 else i, [float(v) for v in x[i]], 1, 0, "x") for i in range(80)]
    low = {}
    for (i, *_), g in zip(rows, group, strict=True):
        low[g] = min((k for k in (low.get(g), i) if k is not None), default=None)
    want = [(i, count[k], low[group[k]], i == low[group[k]]) for k, (i, *_) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, bucket string")
    assert brute.ordered(embedding_dedup(frame).collect()) == brute.ordered(want)


def test_near_sketches_count_every_bit():
    """Each single bit of a sketch is one bit of distance, the sign bit too."""
    import pandas as pd

    from hazardgrid.llm.embedding_dedup import _near_sketches

    words = [np.array([0, 1 << k], dtype=np.uint64).view(np.int64) for k in range(64)]
    for bit, pair in enumerate(words):
        part = pd.DataFrame({"grp": 1, "tbl": 0, "bucket": 0, "b0": 0, "b1": 0, "mine": 0, "node": [1, 2], "s0": pair, "s1": pair ^ np.int64(-1)})
        assert len(_near_sketches(part, 2)) == 2, bit
        assert len(_near_sketches(part, 1)) == 0, bit


def test_connected_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)]
    got = {t.node: t.component for t in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.components(300, links)
    assert got == {n: want[n] for n in {x for p in links for x in p if p[0] != p[1]}}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert substring_dedup(none).count() == suffix_dedup_rows(none).count() == dedup_documents(none).count() == simhash_dedup(none).count() == near_copies(none).count() == 0
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pieces_of_a_long_text(spark, monkeypatch):
    from hazardgrid.llm import suffix_dedup as module

    monkeypatch.setattr(module, "PIECE", 500)
    r = random.Random(9)
    long = "".join(r.choice("abc") for _ in range(2600))
    rows = [(1, long), (2, long[700:1900] + "x" + long[:300]), (3, long[:100])]
    texts = [(t or "").encode() for _, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": [b"k"] * 3, "text": texts})
    pieces, row, offset = module._pieces(batch, 200)
    whole = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199)}
    cut = {(int(row[p]), int(offset[p]) + i) for p, t in enumerate(pieces) for i in range(len(t) - 199)}
    assert cut == whole
