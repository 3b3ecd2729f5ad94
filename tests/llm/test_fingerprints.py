import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusql.llm.fingerprints import PIECES, SECTION, differing, fingerprint, op1_fingerprints, with_edits


def corpus():
    r = random.Random(9)
    texts = [None, "", "a", "abc", "é\n\n# H\nx", "same", "same", "😀" * 9]
    texts += ["\n".join(" ".join(r.choice(["The", "cat.", "Öl", "ran!", "far"]) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 9))) for _ in range(60)]
    return [(i * 5 - 20, t) for i, t in enumerate(texts)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op1_fingerprints(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    texts = [t or "" for _, t in rows]
    for k, (d, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = out[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        sets = [set(re.findall(PIECES, x)) for x in (t, edited, after)]
        dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(r.near_edited - (1.0 if t == edited else dice(sets[0], sets[1]))) < 1e-9 and abs(r.near_next - dice(sets[0], sets[2])) < 1e-9
        if t == edited:
            assert r.near_edited == 1 and r.edited_section is None and r.edited_paragraph is None
        else:
            a, b = ([s.split("\n") for s in re.split(SECTION, x)] for x in (t, edited))
            k = next(i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1])
            x, y = (v[k] if k < len(v) else [""] for v in (a, b))
            assert r.edited_section == k and r.edited_paragraph == next((i for i in range(max(len(x), len(y))) if x[i : i + 1] != y[i : i + 1]), None)
        for j, (e, _) in enumerate(rows):
            assert (out[e].fingerprint == r.fingerprint) == (texts[j] == t)
    long = [out[d].near_edited for d, t in rows if t and len(t) > 400]
    assert sum(long) / len(long) > 0.6


def test_likeness_of_next_and_ties(spark):
    rows = [(1, "one. two. three. four."), (1, "one. two. three. four."), (None, "zzz"), (2, "one. two. five. six.")]
    for ranges in (1, 2, 7):
        out = with_edits(spark.createDataFrame(rows, "doc_id long, text string"), ranges).collect()
        assert sorted((str(r.doc_id), r.next_text) for r in out) == [("1", "one. two. five. six."), ("1", "one. two. three. four."), ("2", "zzz"), ("None", "one. two. three. four.")]
    assert with_edits(spark.createDataFrame([], "doc_id long, text string"), 4).collect() == []
    assert with_edits(spark.createDataFrame([(3, "x")], "doc_id long, text string"), 4).first().next_text == "x"


def test_differing_branches(spark):
    a = "p1\np2\n\n# H\nq1\nq2"
    pairs = spark.createDataFrame([(1, a, a), (2, a, a.replace("q2", "Q2")), (3, a, a + "\nq3"), (4, None, "")], "pair_id long, a string, b string")
    assert sorted(tuple(r) for r in differing(pairs, "a", "b").collect()) == [(2, 2, 3), (3, 2, 4)]


def test_long_text(spark):
    df = spark.createDataFrame([("word. " * 200_000,), ("w" * 1_000_000,)], "text string")
    assert fingerprint(df, "text").select(F.length("fingerprint")).count() == 2
