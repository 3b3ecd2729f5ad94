"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows: WINDOW consecutive words of an item, or a shorter item whole. Patterns of one length m
form a searcher: blocks are two adjacent words (one, if m = 1); the shift table says how far the search may
move on when a block ends at the current word; where it says nothing, a block of no pattern, the search
skips m - 1 words. Where the shift is 0 the block picks a bucket of patterns that end so, and direct
comparison confirms them.

The benchmark is read in blocks of at most BLOCK_ITEMS items and about BLOCK_BYTES of text (an item is never cut),
each sent to the executors once, so what is broadcast has a bound however large the benchmark grows. A single block
is scanned in one pass over the documents, without a shuffle. Of several blocks one at a time is on the driver and
the executors; rows are written first, with a number each, and each pass's hits are written and united by it.

Nulls and edges: a null or wordless text has n_words 0 and isn't contaminated; items without words or id
are no patterns; repeated rows give a row each; items of one id count once; an empty benchmark finds
nothing; columns other than doc_id, text, item_id aren't read. Texts are never cut."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import Staged, settle, stage, table
from corpusql.llm.words import BY_LETTER

WINDOW, BLOCK_ITEMS, BLOCK_BYTES = 10, 20_000, 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(BY_LETTER).split()


class WuManber:
    """Searches word ids for patterns of one length."""

    def __init__(self, patterns: dict[tuple[int, ...], list[int]]):
        self.m = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p, items in patterns.items():
            for end in range(b - 1, m):
                key = p[end] if b == 1 else (p[end - 1], p[end])
                self.shift[key] = min(self.shift.get(key, self.default), m - 1 - end)
            self.buckets.setdefault(key, {})[p] = items

    def search(self, ids: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of each occurrence, overlapping ones too. Ids of -1 are in no pattern."""
        m, n, pair, default, at = self.m, len(ids), self.block == 2, self.default, self.m - 1
        get = self.shift.get
        while at < n:
            last = ids[at]
            if last < 0:  # no window holds this word
                at += m
                continue
            key = (ids[at - 1], last) if pair else last
            skip = get(key, default)
            if skip:
                at += skip
                continue
            found = self.buckets[key].get(tuple(ids[at - m + 1 : at + 1]))
            if found:
                yield at - m + 1, found
            at += 1


class Searcher:
    """All windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text))
            m = min(window, len(ids))
            for k in range(len(ids) - m + 1) if m else ():
                owners = by_length.setdefault(m, {}).setdefault(ids[k : k + m], [])
                if item not in owners:
                    owners.append(item)
        self.engines = [WuManber(p) for p in by_length.values()]

    def scan(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """Words, ids of items with an occurring window, and the hit words as sorted [first, end, first, end, ...]."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words]
        items, spans = set(), []
        for e in self.engines:
            for first, found in e.search(ids):
                items.update(found)
                spans.append((first, first + e.m))
        hit: list[int] = []
        for first, end in sorted(spans):
            if hit and first <= hit[-1]:
                hit[-1] = max(hit[-1], end)
            else:
                hit += [first, end]
        return len(words), sorted(items), hit


def _scanner(searcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = searcher.value
        for x in batches:
            found = [s.scan(t) for t in x["text"].to_pylist()]
            n, items, hit = zip(*found, strict=True) if found else ((), (), ())
            n_hit = [sum(h[1::2]) - sum(h[::2]) for h in hit]
            names = [",".join(sorted(map(str, i))) for i in items]
            yield pa.RecordBatch.from_arrays(
                [x["doc_id"], pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(i.encode()).hexdigest() for i in names]), pa.array([h > 0 for h in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.int64())), pa.array(hit, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return run


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<long>"


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks, one on the driver at a time; at least one, maybe empty."""
    got: list[tuple[int, str]] = []
    size, any_ = 0, False
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if got and (len(got) >= block or size + len(r.text) > BLOCK_BYTES):
            yield got
            got, size, any_ = [], 0, True
        got.append((r.item_id, r.text))
        size += len(r.text)
    if got or not any_:
        yield got


def _in_turn(benchmark: DataFrame, window: int, block: int) -> Iterator[tuple[object, bool]]:
    """A broadcast searcher for each block, and whether it is the only one; each is freed when the next is asked for."""
    blocks, sent = _blocks(benchmark, block), None
    now = next(blocks)
    alone = True
    while now is not None:
        after = next(blocks, None)
        sent = benchmark.sparkSession.sparkContext.broadcast(Searcher(now, window))
        yield sent, alone and after is None
        if after is not None or not alone:
            sent.unpersist()
        now, alone = after, False


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): n_words, n_hit (words inside an occurring window), n_items
    and items_sha256 (of the ids, sorted as strings, comma-joined), contaminated, items, spans (the hit words,
    [first, end) pairs in one list)."""
    settle(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows, marks = None, None
    for sent, alone in _in_turn(benchmark, window, block):
        if alone:
            return docs.mapInArrow(_scanner(sent), OUT)
        rows = rows or Staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
        keyed = rows.df.select(F.struct("row", "doc_id").alias("doc_id"), "text")
        one = stage(keyed.mapInArrow(_scanner(sent), OUT.replace("doc_id long", "doc_id struct<row: long, doc_id: long>")), "marks")
        marks = one if marks is None else marks.unionByName(one)
    rows.drop()
    return _united(marks)


def _united(marks: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.col("spans")[2 * i].alias("a"), F.col("spans")[2 * i + 1].alias("b")))
    none = F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)")
    marks = marks.select("doc_id", "n_words", "items", F.when(F.size("spans") > 0, pairs).otherwise(none).alias("hit"))
    rows = marks.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"))
    merged = F.expr(
        "aggregate(hit, cast(array() as array<bigint>), (s, x) -> case when size(s) > 0 and x.a <= s[size(s) - 1] "
        "then concat(slice(s, 1, size(s) - 1), array(greatest(s[size(s) - 1], x.b))) else concat(s, array(x.a, x.b)) end)"
    )
    rows = rows.withColumn("spans", merged).withColumn("items", F.array_sort(F.array_distinct("items")))
    rows = rows.withColumn("n_hit", F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return rows.select("doc_id.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM p),
g AS (SELECT r, k, m, array_to_string(w[k : k + m - 1], ' ') AS g FROM d, lens, LATERAL (SELECT unnest(generate_series(1, len(w) - m + 1)) AS k) WHERE len(w) >= m),
hits AS (SELECT r, k, m, item_id FROM g JOIN p USING (m, g)),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS x FROM (SELECT DISTINCT r, k, m FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS i FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, block: int = BLOCK_ITEMS) -> DataFrame:
    """The pipeline's stage: documents that hold a window of a benchmark item go; the others stay as they are.

    Null and wordless texts stay; repeated rows are judged each, alike; an empty table or benchmark changes nothing;
    columns may have any names, all come back as they are. What is left after each of several blocks is written."""
    settle(spark)
    before = None
    for sent, alone in _in_turn(table(spark, sf_dir, "benchmark"), WINDOW, block):

        @F.arrow_udf("boolean")
        def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for t in texts:
                yield pa.array([not s.scan(x)[1] for s in [sent.value] for x in t.to_pylist()], pa.bool_())

        docs = docs.where(clean("text"))
        if not alone:
            now = Staged(docs, "clean")
            docs = now.df
            if before:
                before.drop()
            before = now
    return docs
