"""Links from MinHash buckets without emitting all pairs of a bucket.

Each member of a bucket is paired with two members alone, its pivots: the one that sits in the largest buckets, which
is near the middle of a group of copies, so that most copies are linked with it, and one by its hash. Confirmed
links give components.
What then still shares a bucket across components, texts that are linked with no pivot they were held against, is
paired across components by a prefix filter, which loses no pair of the similarity asked for. So a bucket of n
copies costs about 2 n pairs, and no candidate that could join two components is left out; buckets are never capped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.common import Staged, drop_since, staged
from corpusql.llm.graph import components
from corpusql.llm.words import MinHash, pack_low_bits, shingle_sets, shingles, word_hashes

#: Tokens that a row of the prefix filter remembers, so that a pair is made once and not at each common token.
EARLIER = 64


def similarity(a: list[Column], b: list[Column], bits: int) -> Column:
    """Jaccard estimated from packed b-bit minima, corrected for the 2^-bits of minima that collide by chance."""
    per, differ = 64 // bits, F.lit(0)
    mask = F.lit(sum(1 << (bits * i) for i in range(per))).cast("long")  # below 2^63 for 2 bits or more
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        folded = z
        for k in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(z, k))
        differ = differ + F.bit_count(folded.bitwiseAND(mask))
    n, chance = per * len(a), 2.0**-bits
    return ((1 - differ / F.lit(float(n))) - chance) / (1 - chance)


def _confirmed(n: int, percent: int):
    """Of rows (a, b, x, y) the pairs (a, b) whose texts x and y have sets that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            ids = p["a"].to_pylist()
            heads = dict(zip(ids, p["x"].to_pylist(), strict=True))  # a head stands in many pairs: its set is made once
            known = dict(zip(heads, shingle_sets(list(heads.values()), n), strict=True))
            keep = []
            for a, t in zip(ids, shingle_sets(p["y"].to_pylist(), n), strict=True):
                both = len(np.intersect1d(known[a], t, assume_unique=True))
                keep.append(100 * both >= percent * (len(known[a]) + len(t) - both))
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tokens(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            values, at = shingles(*word_hashes(x["text"].to_pylist()), n)
            yield pa.RecordBatch.from_arrays([x["id"], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "token"])

    return run


def _signed(n: int, minima: int, bits: int):
    family = MinHash(1, 1, seed=5, total=minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            values, at = shingles(*word_hashes(x["text"].to_pylist()), n)
            sig = pack_low_bits(family.minima(values, at), bits) if len(at) > 1 else np.zeros((0, minima * bits // 64), np.int64)
            yield pa.RecordBatch.from_arrays([x["id"], x["text"], pa.array(np.diff(at)), *(pa.array(s) for s in sig.T)], ["id", "text", "size", *(f"s{k}" for k in range(sig.shape[1]))])

    return run


def linked(keyed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], n: int, percent: int, minima: int, margin: float, bits: int = 4) -> DataFrame:
    """keyed(id: long, key: long; a row may be repeated) -> components(id, root) of the links.

    ``texts_of``: the texts (id, text) of some ids, fetched once for all that share a bucket; none is without words.
    They get signatures of ``minima`` minima of ``bits`` bits; pairs whose similarity these estimate below ``percent``
    by more than ``margin`` are left out, the others confirmed on full sets of ``n``-word shingles."""
    before, words = staged(), minima * bits // 64
    # keys are counted first, in slim rows; an id may be counted twice, so what is left is counted by ids again
    often = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = Staged(keyed.join(often, "key").distinct(), "keys")
    buckets = some.df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = Staged(some.df.join(buckets, "key"), "buckets").df  # only buckets of several members
    some.drop()
    schema = "id long, text string, size long, " + ", ".join(f"s{k} long" for k in range(words))
    signed = Staged(texts_of(shared.select("id").distinct()).mapInArrow(_signed(n, minima, bits), schema), "signed").df
    texts, side = signed.select("id", "text"), signed.drop("text")

    def alike(x: str, y: str) -> Column:
        a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
        sig = [[F.col(f"{t}.s{k}") for k in range(words)] for t in (x, y)]
        return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (similarity(*sig, bits) >= percent / 100 - margin)

    def confirmed(pairs: DataFrame) -> DataFrame:
        p = pairs.distinct()
        p = p.join(side.alias("x"), p.a == F.col("x.id")).join(side.alias("y"), p.b == F.col("y.id")).where(alike("x", "y")).select("a", "b")
        p = p.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        return Staged(p.select("a", "b", "x", "y").mapInArrow(_confirmed(n, percent), "a long, b long"), "links").df

    # a text that sits in many large buckets is near the middle of its copies: it stands for its buckets
    central = shared.withColumn("w", F.sum("n").over(W.partitionBy("id")))
    pivots = central.groupBy("key").agg(F.max_by("id", F.struct("w", F.hash("id"))).alias("middle"), F.min_by("id", F.xxhash64("id")).alias("any"))
    pivots = pivots.select("key", F.explode(F.array("middle", "any")).alias("pivot"))
    links = confirmed(shared.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")))
    comps = Staged(components(links), "components").df
    rooted = shared.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = Staged(rooted.join(apart, "key").select("id", "root").distinct(), "open").df
    if not left.isEmpty():
        tokens = texts.join(left.select("id"), "id").mapInArrow(_tokens(n), "id long, token array<long>")
        more = confirmed(_prefix_pairs(left.join(side, "id"), tokens.select("id", F.explode("token").alias("token")), alike, percent))
        comps = components(comps.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))
    out = Staged(comps, "components")
    drop_since(before, out)
    return out.df


def _prefix_pairs(left: DataFrame, tokens: DataFrame, alike: Callable[[str, str], Column], percent: int) -> DataFrame:
    """All pairs of left(id, root, what ``alike`` needs) of different roots that can have the similarity; tokens(id, token): their full sets.

    Of two such sets the rarest |S| - ceil(percent |S| / 100) + 1 tokens of each, in one order for all, have one in
    common; and from the first common token on, both have enough left for the overlap that is needed. A pair is made
    at that token, and not again where one of the EARLIER tokens before is common too."""
    tok = Staged(tokens, "tokens").df
    often = tok.groupBy("token").agg(F.count("*").alias("df"))
    by_rank = W.partitionBy("id").orderBy("df", "token")
    ranked = tok.join(often, "token").withColumn("rank", F.row_number().over(by_rank)).withColumn("length", F.count("*").over(W.partitionBy("id")))
    prefix = ranked.where(F.col("rank") <= F.col("length") - F.expr(f"(length * {percent} + 99) div 100") + 1)
    prefix = prefix.withColumn("earlier", F.collect_list("token").over(by_rank.rowsBetween(-EARLIER, -1))).where("df > 1")
    prefix = Staged(prefix.select("token", "id", "length", "rank", "earlier").join(left, "id"), "prefixes").df
    x, y = prefix.alias("x"), prefix.alias("y")
    most = F.least(F.col("x.length") - F.col("x.rank"), F.col("y.length") - F.col("y.rank")) + 1
    enough = most * (100 + percent) >= (F.col("x.length") + F.col("y.length")) * percent
    first = ~F.arrays_overlap("x.earlier", "y.earlier")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & enough & alike("x", "y") & first)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
