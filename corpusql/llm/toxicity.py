"""Toxicity: hashed character n-gram embeddings, averaged, into a linear softmax; both trained jointly in numpy.

A word's subwords are its byte n-grams of 3 to 5 letters, the spaces around it included, so a misspelling
that was never seen shares most of its vectors with the word. A text's hidden vector is the weighted average over the
n-grams of its distinct words, a word that occurs c times weighing 1 + ln c, so that a line repeated a hundred times
isn't all that is seen; the softmax over it gives the score. No count is cut off, and whole texts are read.

The model is fitted on at most SAMPLE labelled rows and SAMPLE_BYTES of text (of each class at most half of them; the
smaller class leaves its room to the other), taken by a hash of doc_id, in one task of an executor, which returns
the table of weights; the bias is then corrected to the share of classes among all labelled rows. As the softmax
is linear in the average, scoring needs one number an n-gram.

Labels: rows of crc32(doc_id as text) mod 5 = 0 never serve to learn. Null labels and ids don't either. Of a doc_id
with several labels the greater one counts, with several texts the one of the smallest hash, so the model doesn't
depend on the order of rows.
Nulls and edges: a null or empty text gets the score of the bias; repeated rows are scored each; without
labels of both classes the score is the class share (0.5 without any); an empty table gives no rows; only
doc_id and text are read, and doc_id only for held_out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.common import settle, table
from corpusql.llm.words import BY_LETTER, SEGMENT

BITS, DIM, SAMPLE, EPOCHS, BATCH, RATE = 18, 8, 8_000, 8, 64, 0.03
#: The bound on the sample's texts, in bytes.
SAMPLE_BYTES = 48 << 20
STEPS = 500
#: Texts that an n-gram needs to be learned (a share of the sample, 2 at least), and the decay of its vector at each step that leaves it alone.
RARE, DECAY = 0.0004, 0.2
GRAMS = (3, 4, 5)


def subwords(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, weight) of each n-gram of the text's distinct words, segment by segment."""
    words = Counter((text or "").lower().encode("utf-8", "replace").translate(BY_LETTER).split())
    each = 1 + np.log(np.fromiter(words.values(), np.float32, len(words)))
    whole, lo, done = b" " + b" ".join(words) + b" ", 0, 0
    while lo < len(whole) - 2:
        hi = whole.find(b" ", min(lo + SEGMENT, len(whole) - 1)) + 1 or len(whole)
        b = np.frombuffer(whole[lo:hi], np.uint8)
        space = np.zeros(len(b) + 1, np.int32)
        np.cumsum(b == 32, out=space[1:])
        h = b.astype(np.uint32)
        for n in range(2, max(GRAMS) + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :]
            if n in GRAMS:
                own = space[n - 1 : len(b)] == space[1 : len(b) - n + 2]  # no space but at either end
                x = (h[own] + np.uint32(n)) * np.uint32(0x9E3779B1)
                of = done + space[1 : len(b) - n + 2][own] - 1
                yield ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), each[of]
        done += int(space[-1]) - 1
        lo = hi - 1


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for t in texts:
            total, n = 0.0, 0.0
            for b, w in subwords(t):
                total += float(np.dot(self.table[b], w))
                n += float(w.sum(dtype=np.float64))
            z = self.bias + total / max(n, 1.0)
            out.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
        return out


def _weighed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and the share that each has of its weight."""
    pieces = list(subwords(text))
    if not pieces:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    ids, at = np.unique(np.concatenate([b for b, _ in pieces]), return_inverse=True)
    weight = np.bincount(at, weights=np.concatenate([w for _, w in pieces]))
    return ids, (weight / weight.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """Embeddings E (2^BITS x DIM) and softmax W (DIM x 2), b by Adam on cross-entropy; rare n-grams aren't learned."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), {(): 0.0, (0,): -6.0, (1,): 6.0}[tuple(set(labels))])
    df = np.zeros(1 << BITS, np.int32)
    for t in texts:  # n-grams are made twice, so that those which aren't learned are never held
        df[_weighed(t)[0]] += 1
    new = np.full(1 << BITS, -1, np.int32)
    known = np.flatnonzero(df >= max(2, RARE * len(texts)))
    new[known] = np.arange(len(known))
    kinds, shares = [], []
    texts = list(texts)
    for i in range(len(texts)):
        k, c = _weighed(texts[i])
        texts[i] = ""
        at = new[k]
        kinds.append(at[at >= 0])
        shares.append(c[at >= 0])
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (len(known), DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    params, step = [e, w, b], 0
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scale = np.float32(20.0)  # averages are small: hidden vectors are taken times this
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(texts)))  # small samples need more of them
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            sizes = np.array([len(kinds[d]) for d in docs])
            ids, x = np.concatenate([kinds[d] for d in docs]), np.concatenate([shares[d] for d in docs]) * scale
            of = np.repeat(np.arange(len(docs)), sizes)
            h = np.stack([np.bincount(of, weights=e[ids, j] * x, minlength=len(docs)) for j in range(DIM)], axis=1).astype(np.float32)
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(docs)), y[docs]] -= 1
            g /= len(docs)
            gh = (g @ w.T)[of] * x[:, None]
            ge = np.stack([np.bincount(ids, weights=gh[:, j], minlength=len(e)) for j in range(DIM)], axis=1).astype(np.float32)
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, grad in enumerate((ge, h.T @ g, g.sum(axis=0))):
                m1[k] += 0.1 * (grad - m1[k])
                m2[k] += 0.001 * (grad * grad - m2[k])
                params[k] -= DECAY * rate * params[k] if k == 0 else 0
                params[k] -= (rate * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = scale * (e @ (w[:, 1] - w[:, 0]))
    return Model(weights, float(b[1] - b[0]))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, text, toxic), all of the sample -> one row: the model's table and bias."""
    rows = [r for x in batches for r in zip(x["place"].to_pylist(), x["text"].to_pylist(), x["toxic"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: r[0])
    m = train([t or "" for _, t, _ in rows], [int(y) for *_, y in rows])
    yield pa.RecordBatch.from_arrays([pa.array([m.table.tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], ["weights", "bias"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model from at most ``sample`` rows and ``sample_bytes`` of docs(doc_id, text) with labels(doc_id, toxic)."""
    spark = settle(docs.sparkSession)
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(marked.groupBy("toxic").count().collect())
    few, many = sorted((0, 1), key=lambda k: counts.get(k, 0))
    room = {few: min(counts.get(few, 0), sample // 2)}
    room[many] = min(counts.get(many, 0), sample - room[few])
    picked = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in room.items() if n]
    if not picked:
        return train([], [])
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    ids = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen.collect()], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", F.lit("order"))).withColumn("so_far", F.sum(F.octet_length("text")).over(W.orderBy("place", "doc_id")))
    rows = rows.where(F.coalesce("so_far", F.lit(0)) <= sample_bytes)  # at most ``sample`` rows are in that window
    got = rows.select("place", "text", "toxic").coalesce(1).mapInArrow(_trained, "weights binary, bias double").collect()
    if not got:
        return train([], [])
    model = Model(np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias)
    if all(room.values()):
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(room[1] / room[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...)."""
    spark = settle(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = sent.value.scores(x["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["held_out"], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents predicted toxic go; the others stay as they are.

    Null and empty texts get the score of the bias; repeated rows are judged each, alike; an empty table stays
    empty; columns may have any names, all come back as they are. Labels are those of the rows that came in."""
    settle(spark)
    sent = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))

    @F.arrow_udf("double")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(sent.value.scores(t.to_pylist()), pa.float64())

    return docs.where(toxic("text") < 0.5)
