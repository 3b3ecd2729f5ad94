"""MinHash near-dedup with b-bit signatures.

1. Each text becomes its set of hashed word shingles; texts of equal sets are one class from then on.
2. Each class gets BANDS x ROWS minima; bands of them are its bucket keys.
3. Candidates come from buckets (see lsh). Classes that share a bucket get signatures: the low BITS bits of MINIMA
   further minima, packed into 64-bit words. Their differing bits, counted and corrected for chance, estimate the
   similarity; pairs MARGIN, five standard errors, below the threshold are left out.
4. The rest is confirmed on full sets, and components of links make the groups.

With 20 bands of 4 rows a pair at similarity 0.8 misses every bucket with probability 3e-5.

Nulls and edges: a null or wordless text has an empty set and links with nothing; a null doc_id keeps its
row, alone (component_id null, kept true); repeated rows are one class, repeated ids keep a row each; an
empty table gives no rows; columns other than doc_id and text aren't read. Texts are never cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import Staged, fresh, settle, table
from corpusql.llm.lsh import linked
from corpusql.llm.words import MinHash, parts, sequence_hashes, shingles, word_hashes

BANDS, ROWS, MINIMA, BITS, MARGIN = 20, 4, 128, 4, 0.18
#: Ids that a partition remembers, so as to sign equal sets once.
SEEN = 500_000
SKETCH = "doc_id long, h long, id long, size long, keys array<long>"


def lists(values: np.ndarray, at: list[int], rows: int) -> pa.ListArray:
    """A list in each of ``rows`` rows: a row of ``values`` in those of ``at`` (ascending), an empty one elsewhere."""
    size = np.zeros(rows + 1, np.int32)
    size[np.asarray(at, np.int64) + 1] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(values.ravel()))


def band_keys(family: MinHash, values: np.ndarray, at: np.ndarray, ids: np.ndarray, wanted: np.ndarray, seen: set[int]) -> pa.ListArray:
    """Band keys of the wanted sets whose id isn't in ``seen`` yet, empty lists for the others.

    A partition so signs equal sets once; ``seen`` starts anew beyond SEEN ids."""
    first = []
    for i in np.flatnonzero(wanted).tolist():
        if (k := int(ids[i])) not in seen:
            seen.add(k)
            first.append(i)
    if len(seen) > SEEN:
        seen.clear()
    m = family.minima(*parts(values, at, np.array(first, np.int64))) if first else np.zeros((0, len(family.a)), np.uint32)
    return lists(family.keys(m), first, len(ids))


def _sketch(n: int):
    family = MinHash(BANDS, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for x in batches:
            values, at = shingles(*word_hashes(x["text"].to_pylist()), n)
            ids, size = sequence_hashes(values, at), np.diff(at)
            wanted = (size > 0) & x["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["h"], pa.array(ids), pa.array(size), band_keys(family, values, at, ids, wanted, seen)], ["doc_id", "h", "id", "size", "keys"])

    return run


def grouped(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows(doc_id, h, size), groups(doc_id, h, size, root)) of docs(doc_id, text, ...): h is the text's hash.

    rows has each row of docs; groups those that can be linked, of a doc_id and with words, and what they are linked with: root."""
    settle(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = Staged(docs.mapInArrow(_sketch(n), SKETCH), "sketch").df
    able = rows.where("size > 0 and doc_id is not null")
    signed = able.where("size(keys) > 0")

    def texts_of(ids: DataFrame) -> DataFrame:
        want = signed.join(ids, "id").groupBy("id").agg(F.min(F.struct("doc_id", "h")).alias("of")).select("id", "of.doc_id", "of.h")
        return docs.join(want, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("id", "text")

    comps = linked(signed.select("id", F.explode("keys").alias("key")), texts_of, n, percent, MINIMA, MARGIN, BITS)
    return rows.select("doc_id", "h", "id", "size"), able.select("doc_id", "h", "id", "size").join(comps, "id", "left").select("doc_id", "h", "id", "size", F.coalesce("root", "id").alias("root"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    ``n``: words of a shingle; texts are linked whose sets have 100 |A & B| >= percent |A | B|."""
    rows, groups = grouped(docs, n, percent)
    low = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = groups.select("id", "root").distinct().join(low, "root").select("id", "component_id")
    out = rows.withColumn("id", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("id"))).join(of, "id", "left")
    group = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each group of near-duplicates one row stays, that of the smallest doc_id.

    Of rows of that id the one of the smallest text hash stays; of rows that repeat id and text one, whichever
    their other columns (they are the same document). Rows of a null doc_id and of texts without words are in no
    group and all stay. An empty table stays empty; columns may have any names; all columns come back as they are."""
    _, groups = grouped(docs)
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("x"), F.count("*").alias("n"))
    first = Staged(first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.h").alias("h"), "n"), "first")
    h, doc = fresh(docs, "h_"), fresh(docs, "id_")
    able = F.col("doc_id").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    keys = first.df.select(F.col("doc_id").alias(doc), F.col("h").alias(h))
    stay = keyed.where(able).join(keys.withColumnRenamed(h, h + "_"), (F.col("doc_id") == F.col(doc)) & (F.col(h) == F.col(h + "_")))
    again = groups.join(first.df.select("doc_id", "h"), ["doc_id", "h"]).groupBy("doc_id", "h").count().where("count > 1")
    if not again.isEmpty():
        stay = stay.dropDuplicates([doc, h + "_"])
    return stay.select(*docs.columns).unionByName(docs.where(~F.coalesce(able, F.lit(False))))
