import random
import zlib
from collections import defaultdict

from corpusql.llm.sharding import shard_by_bytes


def check(spark, rows, whole=True, largest=0):
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(len((t or "").encode()) + 1)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((d is None, d or 0, s) for d, ss in text.items() for s in ss)
    by = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard <= 7
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    share = sum(r.size for r in out) / 8
    for s in range(8):
        assert abs(sum(r.size for r in by[s]) - share) <= 0.004 * share + largest + 1
    if whole:
        one = {d: t for d, t in rows}
        at = defaultdict(set)
        for r in out:
            at[one[r.doc_id]].add(r.shard)
            assert r.text_crc32 == zlib.crc32((one[r.doc_id] or "").encode())
        assert all(len(v) == 1 for v in at.values())
    return by


def test_near_equal_bytes_and_groups_together(spark):
    r = random.Random(1)
    rows = [(i * 7 - 50, "é" * r.randint(0, 400) + str(i)) for i in range(3000)]
    rows += [(100_000 + i, "same text " * 30) for i in range(60)] + [(200_000 + i, "") for i in range(20)] + [(300_000, None)]
    check(spark, rows, largest=60 * 301)


def test_a_group_beyond_a_shard_is_split_by_doc_id(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(50, 150) + str(i)) for i in range(1000)] + [(5000 + i, "copy" * 25) for i in range(1500)]
    check(spark, rows, whole=False, largest=200)


def test_small_tables(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = shard_by_bytes(spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string")).collect()
    assert len(out) == 3
    assert sorted((r.shard, r.slot) for r in out) == sorted({(r.shard, r.slot) for r in out})


def test_a_smaller_group_across_a_target_is_split_too(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randint(50, 150) + str(i)) for i in range(4000)]
    rows += [(10_000 + 1000 * g + i, f"copy {g} " * 12) for g in range(12) for i in range(350)]  # of 0.6 shards each: some lie across targets
    by = check(spark, rows, whole=False, largest=200)
    sizes = [sum(x.size for x in xs) for xs in by.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.008 * sum(sizes) / 8 + 400
    one = dict(rows)
    at = defaultdict(set)
    for s, xs in by.items():
        for x in xs:
            at[one[x.doc_id]].add(s)
    assert sum(len(v) > 1 for v in at.values()) <= 7 and all(len(v) <= 2 for v in at.values())
