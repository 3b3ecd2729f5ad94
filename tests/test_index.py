from corpusql.operators import index_queries as I

STORED = "path string, size long, mtime double, status string, failures int, failed_at double"


def test_changes(spark):
    now, day = 1e9, 86_400.0
    stored = [
        ("same", 1, 5.0, "ok", 0, None), ("grown", 1, 5.0, "ok", 0, None), ("touched", 1, 5.0, "ok", 0, None), ("gone", 1, 5.0, "ok", 0, None), ("waits", 1, 5.0, "pending", 0, None),
        ("due", 1, 5.0, "error", 1, now - day), ("early", 1, 5.0, "error", 2, now - day), ("late", 1, 5.0, "error", 2, now - 7 * day), ("closed", 1, 5.0, "error", 3, 0.0), ("unknown", None, None, "ok", 0, None), (None, 1, 5.0, "ok", 0, None),
    ]
    seen = [(p, 2 if p == "grown" else 1, 6.0 if p == "touched" else 5.0) for p, *_ in stored if p != "gone" and p] + [("fresh", 1, 5.0)]
    got = {r.path: r.change for r in I.changes(spark.createDataFrame(stored, STORED), spark.createDataFrame(seen, "path string, size long, mtime double"), now).collect()}
    assert got == {
        "same": "unchanged", "grown": "changed", "touched": "changed", "gone": "vanished", "waits": "changed", "due": "retry", "early": "unchanged", "late": "retry", "closed": "unchanged", "unknown": "changed", "fresh": "new", None: "vanished",
    }


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, text string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "file_id long, text string")
    assert sorted(map(tuple, I.upsert(old, new, "file_id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, I.replace_pages(old, new.where("file_id = 3"), old.where("file_id = 1")).collect())) == [(2, "b"), (3, "d")]
    left = I.cascade_delete({"files": old, "pages": new}, old.where("file_id = 2"))
    assert [[r.file_id for r in left[k].collect()] for k in ("files", "pages")] == [[1], [3]]


def test_bursts_of_a_batch_and_a_stream(spark, tmp_path):
    rows = [("a", 0.0), ("a", 1.0), ("a", 9.0), ("b", 0.5), ("z", 500.0)]
    e = spark.createDataFrame(rows, "path string, s double").selectExpr("path", "timestamp_millis(cast(s * 1000 as bigint)) as ts")
    e.write.parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r.path, r.since.second, r["last"].second, r.n) for r in df.collect())
    want = [("a", 0, 1, 2), ("a", 9, 9, 1), ("b", 0, 0, 1)]
    assert key(I.bursts(e, "path").where("path <> 'z'")) == want
    s = I.bursts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "path", late="1 second")
    run = s.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert key(spark.table("bursts")) == want  # z is still open: nothing later has come
