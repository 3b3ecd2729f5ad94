import random
import zlib

from corpusql.llm.toxicity import drop_toxic, fit, score, subwords, train

BAD = ["blorgface", "grumpnit", "snarkwad"]


def corpus(n=700, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        bad = r.random() < 0.3
        for _ in range(max(2, len(w) // 20) if bad else 0):
            w.insert(r.randint(0, len(w)), r.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_unseen_misspellings(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (10_000, "a fine text of grumpnitt and snarkwadd folk"), (10_001, None), (10_002, ""), (None, "x")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(out) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in held) for i, _ in rows) and not out[None].held_out
    assert sum(out[i].predicted == labels[i][2] for i in held) >= 0.95 * len(held)
    assert out[10_000].predicted == 1 and out[10_001].score == out[10_002].score < 0.5


def test_labels_of_held_out_rows_are_never_read(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert (one.table == two.table).all() and one.bias == two.bias


def test_missing_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert score(docs, fit(docs, labels)).collect()[0].score == 0.5
    assert score(docs.limit(0), fit(docs.limit(0), labels.limit(0))).collect() == []
    assert train(["a"], [1]).scores([""])[0] > 0.99 and list(subwords(None)) == []


def test_the_order_of_rows_and_repeated_ids_change_nothing(spark):
    rows, labels = corpus(150)
    rows += [(3, "another text of the same id"), (4, None)]
    labels = spark.createDataFrame([*labels, (5, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    one, two = (fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels) for x, n in ((rows, 1), (rows[::-1], 3)))
    assert (one.table == two.table).all() and one.bias == two.bias


def test_the_bound_in_bytes_and_weights_without_a_cut(spark):
    rows, labels = corpus(120)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert not fit(docs, marks, sample_bytes=0).table.any() and fit(docs, marks, sample_bytes=20_000).table.any()
    weight = lambda t: sum(float(w.sum()) for _, w in subwords(t))
    alone = weight("abc")
    assert [round(weight(" ".join(["abc"] * n)) / alone, 4) for n in (1, 10, 1000)] == [1.0, round(1 + 2.302585, 4), round(1 + 6.907755, 4)]
    long = " ".join(f"w{i}x" for i in range(300_000))
    assert abs(weight(long + " w7x") - weight(long) - 0.6931472 * weight("w7x")) < 1


def test_stage_drops_what_the_model_predicts(spark, tmp_path):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, None, "y"), (7, "", "z")], "doc_id long, text string, Toxic string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = drop_toxic(spark, docs, str(tmp_path))
    model = fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    want = sorted((r.text or "") for r in docs.collect() if model.scores([r.text])[0] < 0.5)
    assert out.columns == docs.columns and sorted((r.text or "") for r in out.collect()) == want and 0 < len(want) < 302
    assert drop_toxic(spark, docs.limit(0), str(tmp_path)).collect() == []
