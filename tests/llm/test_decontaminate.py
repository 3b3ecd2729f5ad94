import hashlib
import random
import re

from corpusql.llm.decontaminate import Searcher, decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, bench, window=10):
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for i, b in bench:
            p = words(b)
            if i is None or not p:
                continue
            m = min(window, len(p))
            for k in range(len(p) - m + 1):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == p[k : k + m]:
                        hit.update(range(at, at + m))
                        items.add(i)
        names = ",".join(sorted(map(str, items)))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    v = ["a", "b", "É", "zz9", "Ab", "c"]
    bench = [(i, r.choice([" ", "-", ", "]).join(r.choice(v) for _ in range(r.choice([1, 2, 9, 10, 11, 25])))) for i in range(12)]
    bench += [(3, "a b c a b c a b c a b c"), (100, None), (101, "..."), (None, "a b"), (12, "unicorn")]
    docs = []
    for i in range(60):
        parts = [r.choice(v) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            parts[r.randint(0, len(parts)) : 0] = words(r.choice(bench)[1])
        docs.append((i, "\n".join(parts)))
    return docs + [(0, "a b"), (70, None), (71, ""), (None, "UNICORN"), (72, "x " * 3000 + "unicorn")], bench


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_equals_brute_force_in_one_block_and_in_several(spark):
    docs, bench = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert got(decontaminate(d, b)) == brute(docs, bench)
    assert got(decontaminate(d, b, block=4)) == brute(docs, bench)
    assert got(decontaminate(d, b.limit(0))) == brute(docs, [])
    assert got(decontaminate(d.limit(0), b)) == []


def test_spans_are_the_hit_words():
    s = Searcher([(1, "one two three four five six seven eight nine ten eleven")])
    n, items, spans = s.scan("zero one two three four five six seven eight nine ten eleven twelve")
    assert (n, items, spans) == (13, [1], [1, 12])


def test_stage_keeps_clean_documents_and_columns(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x W3 w4 w5 w6 w7 w8 w9 w10 w11 y", "en", 1), (2, "x w3 w4 w5 w6 w7 w8 w9 w10 y", "en", 1), (3, None, None, None), (4, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "en", 1)], "doc_id long, text string, lang string, hits int")
    out = drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
