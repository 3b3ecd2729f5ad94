import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from corpusql.llm import words
from corpusql.llm.minhash import keep_first, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows) if d is not None)


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows, texts = [], []
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(15, 120))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 7))):
                t[r.randrange(len(t))] = r.choice(vocab)
            texts.append(" ".join(t))
    texts += ["", None, "one", "One", "one\ttwo", "\x0b", "ONE two", texts[0].upper(), texts[0], "a" * 5000]
    for i, t in enumerate(r.sample(texts, len(texts))):
        rows.append((i * 3 + 1, t))
    return rows


def got(spark, rows, n):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=n).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None), out


def test_groups_equal_brute_force(spark):
    rows = corpus()
    assert got(spark, rows, 2)[0] == brute(rows, 2)
    assert got(spark, rows, 5)[0] == brute(rows, 5)


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (7, None), (8, "")]
    want, out = got(spark, rows, 2)
    assert want == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 0, 7), (8, 0, 8)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert got(spark, [], 2)[0] == []


def test_words_hash_alike_over_segments():
    long = " ".join(f"w{i}" for i in range(300_000))
    h, at = words.word_hashes(["x y", long, None, "W7 x"])
    assert len(h) == 300_004 and list(at) == [0, 2, 300_002, 300_002, 300_004]
    assert h[0] == h[-1] and h[-2] == h[2 + 7] and len(np.unique(h)) == 300_002


def test_flat_sets_equal_single_ones():
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None, "x\ny  z\n\n", "\n"]
    h, at = words.word_hashes(texts)
    for n in (1, 2, 5):
        values, off = words.shingles(h, at, n)
        for i, t in enumerate(texts):
            assert off[i + 1] - off[i] == len(shingles(t, n))
        sets = {}
        for i, k in enumerate(words.sequence_hashes(values, off).tolist()):
            assert sets.setdefault(k, shingles(texts[i], n)) == shingles(texts[i], n)
        assert len(sets) == len({frozenset(shingles(t, n)) for t in texts})
    h2, at2, first, owner = words.line_hashes(texts)
    lines = [(i, len(ln.split())) for i, t in enumerate(texts) for ln in (t or "").split("\n") if ln.split()]
    assert (h2 == h).all() and (at2 == at).all() and list(zip(owner.tolist(), np.diff(first).tolist(), strict=True)) == lines
    a, b = np.array([0, 5]), np.array([3, 8])
    both = np.concatenate([h[:10], h[:10]])
    assert (words.slices(both, a, b) == words.slices(both, a + 10, b + 10)).all()


def test_one_row_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "another text of quite other words than that"
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (5, b, 4), (6, a + " ", 5), (None, a, 6), (None, a, 7), (7, "", 8), (8, None, 9), (9, "\t ", 10), (10, "alone here", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h_ int").withColumn("ID_", F.lit("x")).withColumn("__text", F.lit(1))
    out = keep_first(spark, docs, "")
    got = sorted(out.collect(), key=str)
    assert out.columns == docs.columns and sorted(r.h_ for r in got) == [1, 2, 6, 7, 8, 9, 10, 11]
    again = spark.createDataFrame([(1, a, 1), (1, a, 2), (1, a + " x", 3)], "doc_id long, text string, z int")
    assert len(keep_first(spark, again, "").collect()) in (1, 2) and {r.text for r in keep_first(spark, again.where("z < 3"), "").collect()} == {a}
    assert len(keep_first(spark, again.where("z < 3"), "").collect()) == 1
    assert keep_first(spark, docs.limit(0), "").collect() == []


def test_stage_equals_brute_force(spark):
    rows = [x for x in corpus(8)]
    want = sorted(d for d, n, c in brute(rows, 5) if not n or c == d)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_first(spark, docs, "").collect()) == want
