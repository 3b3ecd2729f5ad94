"""Histogram sort: shards of near equal bytes, equal texts side by side, in one exchange.

The key of a row is the 64-bit hash of its text. Each round counts, in one aggregation whose result has a row
an interval, the exact bytes and rows below PROBES candidate keys around every splitter that isn't settled,
and puts the next probes into the interval that holds the splitter's target. It ends when each splitter is
within TOLERANCE of a shard's size, or when no key lies between its bounds: then a group of equal texts
straddles the target. If both of its sides are further off than TOLERANCE, it is split by doc_id (key = hash,
then doc_id); no other group is, and rows of one doc_id and text stay together.

Only then do rows move, once, to (shard, lane); lanes of a hash of doc_id number the rows of a shard in
parallel whatever group they belong to, and a lane's first slot comes from the counts of lanes, one row each.

Nulls and edges: a null text has size 1 and its own key, as have empty texts (size 1); rows of a null doc_id
and repeated rows are placed and numbered too; an empty table gives no rows; other columns aren't read."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.common import Staged, table, text_or_empty

SHARDS, PROBES, TOLERANCE, LANES = 8, 31, 0.002, 64
LOW, HIGH = -(2**63), 2**63  # no key is below LOW or at HIGH


@dataclass
class Cut:
    """Keys from ``splitter`` on lie beyond a target. ``group``: bytes of the key ``low`` if it straddles the target; ``before``: bytes below it."""

    target: int
    splitter: int
    low: int = 0
    before: int = 0
    group: int = 0


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at or below the key: comparisons only, so it stays in generated code."""
    out = F.lit(0)
    for b in bounds:
        out = out + (key >= F.lit(b).cast("long")).cast("int")
    return out


def _below(rows: DataFrame, key: str, probes: list[int]) -> list[int]:
    """Exact bytes of keys below each of the sorted probes; the driver gets a row an interval."""
    found = dict(rows.groupBy(_rank(F.col(key), probes).alias("at")).agg(F.sum("size")).collect())
    return list(accumulate(found.get(i, 0) for i in range(len(probes))))


def splitters(rows: DataFrame, targets: list[int], total: int, slack: float, key: str = "key") -> list[Cut]:
    """A Cut for each target, of rows(``key``: long, size: long) that have ``total`` bytes."""
    box = {t: (LOW, 0, HIGH, total) for t in targets}  # the greatest known key with at most t bytes below it, the least with more
    done: dict[int, Cut] = {}
    while len(done) < len(box):
        probes = sorted({p for t, (a, _, b, _) in box.items() if t not in done for k in range(1, PROBES + 1) if a < (p := a + (b - a) * k // (PROBES + 1)) < b})
        counts = list(zip(probes, _below(rows, key, probes), strict=True))
        for t, (a, ca, b, cb) in box.items():
            if t in done:
                continue
            a, ca = max([(a, ca), *((p, c) for p, c in counts if a < p < b and c <= t)])
            b, cb = min([(b, cb), *((p, c) for p, c in counts if a < p < b and c > t)])
            box[t] = (a, ca, b, cb)
            near = a if t - ca <= cb - t else b
            if min(t - ca, cb - t) <= slack:
                done[t] = Cut(t, near)
            elif b - a == 1:
                done[t] = Cut(t, near, a, ca, cb - ca)
    return [done[t] for t in targets]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of each row; slim, so the text is read once."""
    text = text_or_empty()
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("key"))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs(doc_id, text, ...)."""
    rows = Staged(keyed(docs), "keys").df
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    cuts = splitters(rows, sorted({round(share * k) for k in range(1, shards)} - {0, total}), total, share * TOLERANCE)
    astride = [c for c in cuts if c.group]  # no side of the group is within the tolerance
    plain = [c.splitter for c in cuts if not c.group]
    key = F.col("key")
    shard = _rank(key, plain + [c.low for c in astride])
    for low in {c.low for c in astride}:
        inside = [c for c in astride if c.low == low]
        own = rows.where(key == F.lit(low).cast("long")).where("doc_id is not null")
        ends = splitters(own, [c.target - c.before for c in inside], inside[0].group, share * TOLERANCE, "doc_id")
        base = sum(p <= low for p in plain) + sum(c.low < low for c in astride)
        place = F.coalesce(_rank(F.col("doc_id"), [e.splitter for e in ends if e.splitter < HIGH]), F.lit(0)) + base
        shard = F.when(key == F.lit(low).cast("long"), place).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(LANES)).cast("int"))
    lanes = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))  # at most shards x LANES rows
    before = W.partitionBy("shard").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    lanes = F.broadcast(lanes.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = W.partitionBy("shard", "lane").orderBy("doc_id", "key")
    out = placed.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(lanes, ["shard", "lane"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
