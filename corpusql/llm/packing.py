"""Vector bin packing by the dot-product heuristic, for documents that may be cut and for examples that may not.

An item is a vector (tokens, segments, loss-bearing tokens); a bin has a limit in each dimension. The packer
fills one bin at a time: of the kinds of items that still fit, it takes the one whose vector has the largest
dot product with what the bin has left, each dimension weighed by its share of the demand. Items of equal
vectors are one kind, so a choice looks at kinds, not at items.

Where cutting is allowed and nothing fits, the best item is cut so that the bin is full; the rest goes back.
The items of a partition pass through a pool of POOL items; the last, partly filled bin waits for the next
pool, and what is left at a partition's end is cut into sequences whose lengths are powers of two, which
need no padding. Partitions are packed on their own: there is no shuffle, and a partition that is computed
again gives the same sequences. sequence_id: the partition number in the high bits, a counter below.

Ids come from the tokenizers file given. Where the file is a byte-level BPE whose ids are in order of its
merges, its vocabulary runs in tiktoken's encoder, four times as fast, after a comparison on PROBES.

Nulls and edges: a null text is an empty one, the id 0 alone; repeated rows and ids are packed each; an
empty table gives no rows; columns other than doc_id and text aren't read; texts of any length are cut."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import settle, table

TOKENS, SEGMENTS, POOL = 1024, 256, 2048
END = 0
PROBES = ["It's  3 déjà-vus,\n\n\t\"naïve\" 漢字 🙂…", " a<|endoftext|>b ", "x" * 300 + "\r\n \n1234567 'll 're   z"]


@functools.lru_cache(2)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """texts -> ids, as tokenizers gives them for the file with add_special_tokens=False."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def plain(texts: list[str]) -> list[list[int]]:
        return [t.encode(x, add_special_tokens=False).ids for x in texts]

    fast = _ranked(path)
    return fast if fast and fast(PROBES) == plain(PROBES) else plain


def _ranked(path: str) -> Callable[[list[str]], list[list[int]]] | None:
    try:
        import tiktoken
        from public_tokenizers import PATTERN
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = d.get("pre_tokenizer") or {}
    if d["model"].get("type") != "BPE" or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"]: x["id"] for x in d["added_tokens"]}
    ranks = {bytes(byte[c] for c in w): i for w, i in d["model"]["vocab"].items() if w not in special}
    e = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [e.encode(x, allowed_special="all") for x in texts]


class Packer:
    """Bins for items of any number of dimensions; dimension 0 is the one that may be cut."""

    def __init__(self, limits: tuple[int, ...], cut: Callable | None = None):
        """cut(item, n) -> (head of n tokens, its vector, rest, its vector); None: items stay whole."""
        self.limits, self.cut = np.array(limits, float), cut
        self.at: dict[tuple, int] = {}
        self.kinds = np.zeros((64, len(limits)))
        self.items: list[list] = []
        self.alive = np.zeros(64, bool)
        self.n = 0
        self.demand = np.zeros(len(limits))

    def add(self, vector: tuple[int, ...], item) -> None:
        k = self.at.setdefault(vector, len(self.at))
        if k == len(self.items):
            self.items.append([])
            if k == len(self.kinds):
                self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
                self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
            self.kinds[k] = vector
        self.items[k].append(item)
        self.alive[k] = True
        self.n += 1
        self.demand += np.array(vector) / self.limits

    def _take(self, k: int):
        self.n -= 1
        item = self.items[k].pop()
        self.alive[k] = bool(self.items[k])
        self.demand -= self.kinds[k] / self.limits
        return item

    def fill(self) -> tuple[list, list[tuple]]:
        """(items, vectors) of the next bin; call while n > 0."""
        left, inside, vectors = self.limits.copy(), [], []
        while self.n:
            kinds = self.kinds[: len(self.items)]
            fits = self.alive[: len(self.items)] & (kinds <= left).all(axis=1)
            weight = np.maximum(self.demand, 0) / self.limits * left / self.limits
            if fits.any():
                k = int(np.argmax(np.where(fits, kinds @ weight, -1.0)))
                vector, item = tuple(int(x) for x in kinds[k]), self._take(k)
            elif self.cut and left.min() >= 1:
                part = np.minimum(kinds, left)
                k = int(np.argmax(np.where(self.alive[: len(self.items)], part @ weight, -1.0)))
                item, vector, rest, of_rest = self.cut(self._take(k), int(left.min() if len(left) == 1 else min(left[0], left[-1])))
                self.add(of_rest, rest)
            else:
                if not inside:  # larger than a bin in some dimension, and whole: a bin of its own
                    k = int(np.flatnonzero(self.alive)[0])
                    inside, vectors = [self._take(k)], [tuple(int(x) for x in kinds[k])]
                break
            inside.append(item)
            vectors.append(vector)
            left = left - vector
            if left.min() < 1:
                break
        return inside, vectors


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids[:n], self.start, self.total), Piece(self.doc, self.ids[n:], self.start + n, self.total)


def _vector(p: Piece) -> tuple[int, int, int]:
    return len(p.ids), 1, len(p.ids)


def _cut(p: Piece, n: int):
    a, b = p.split(n)
    return a, _vector(a), b, _vector(b)


def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in order, cut into sequences of falling powers of two."""
    n = sum(len(p.ids) for p in pieces)
    rest = pieces[::-1]
    while n:
        size = want = 1 << (n.bit_length() - 1)
        seq = []
        while want:
            p = rest.pop()
            if len(p.ids) > want:
                p, q = p.split(want)
                rest.append(q)
            seq.append(p)
            want -= len(p.ids)
        n -= size
        yield seq


def sequences(docs: Iterator[tuple[object, np.ndarray]], tokens: int = TOKENS, segments: int = SEGMENTS, pool: int = POOL) -> Iterator[list[Piece]]:
    """Sequences of pieces from (doc, ids) pairs; all are ``tokens`` long but the last few, whose lengths are powers of two."""
    packer = Packer((tokens, segments, tokens), _cut)

    def flush(last: bool) -> Iterator[list[Piece]]:
        while packer.n:
            inside, vectors = packer.fill()
            if sum(v[0] for v in vectors) == tokens:
                yield inside
            elif last or packer.n:  # at the end, or full of segments
                yield from _powers(inside)
            else:
                for v, p in zip(vectors, inside, strict=True):
                    packer.add(v, p)
                return

    for doc, ids in docs:
        p = Piece(doc, ids, 0, len(ids))
        while len(p.ids) >= tokens:
            full, p = p.split(tokens)
            yield [full]
        if len(p.ids):
            packer.add(_vector(p), p)
        if packer.n >= pool:
            yield from flush(False)
    yield from flush(True)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, tokens: int, segments: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path), TaskContext.get().partitionId() << 36

        def docs():
            for x in batches:
                ids, texts = x["doc_id"].to_pylist(), x["text"].to_pylist()
                for lo in range(0, len(ids), 64):
                    for d, i in zip(ids[lo : lo + 64], encode([t or "" for t in texts[lo : lo + 64]]), strict=True):
                        i.append(END)
                        yield d, np.array(i, "<u4")

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in (zip(*(r[:7] for r in rows), strict=True) if rows else [[]] * 7)]
            names = [f.split()[0] for f in OUT.split(", ")]
            if with_ids:
                cols.append(pa.array([r[7].astype("i4") for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        rows: list[tuple] = []
        for k, seq in enumerate(sequences(docs(), tokens, segments)):
            offset = 0
            for p in seq:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, base + k, offset, p.ids))
                offset += len(p.ids)
            if len(rows) >= 2000:
                yield made(rows)
                rows = []
        yield made(rows)

    return run


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, with_ids: bool = False) -> DataFrame:
    """A row for each piece of docs(doc_id, text, ...): OUT, and the ids themselves if ``with_ids``."""
    settle(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packed(tokenizer, tokens, segments, with_ids), OUT + ", ids array<int>" * with_ids)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (4096, 64, 2048)) -> DataFrame:
    """Instruction examples(example_id, n_tokens, n_segments, n_loss: long), never cut -> example_id, bin_id, slot.

    Nulls count as 0. An example beyond a limit by itself gets a bin of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, packer = TaskContext.get().partitionId() << 36, 0, Packer(limits)

        def flush(last: bool) -> list[tuple]:
            nonlocal k
            out = []
            while packer.n:
                inside, vectors = packer.fill()
                if not packer.n and not last:
                    for v, i in zip(vectors, inside, strict=True):
                        packer.add(v, i)
                    break
                out += [(i, base + k, s) for s, i in enumerate(inside)]
                k += 1
            return out

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["example_id", "bin_id", "slot"])

        for x in batches:
            for i, *v in zip(*(x[c].to_pylist() for c in ("example_id", "n_tokens", "n_segments", "n_loss")), strict=True):
                packer.add(tuple(y or 0 for y in v), i)
            if packer.n >= POOL:
                yield made(flush(False))
        yield made(flush(True))

    settle(examples.sparkSession)
    cols = [F.col(c).cast("long") for c in ("example_id", "n_tokens", "n_segments", "n_loss")]
    return examples.select(*cols).mapInArrow(run, "example_id long, bin_id long, slot long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def conversation_examples(turns: DataFrame, tokenizer: str) -> DataFrame:
    """example_id, n_tokens, n_segments, n_loss of turns(conv_id, turn, role, text): only an assistant's tokens bear loss.

    A null text has no tokens but the id 0 after each turn; turns of a null conv_id are one example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for x in batches:
            n = [len(i) + 1 for i in encode([t or "" for t in x["text"].to_pylist()])]
            loss = [k if r == "assistant" else 0 for k, r in zip(n, x["role"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x["conv_id"], pa.array(n, pa.int64()), pa.array(loss, pa.int64())], ["conv_id", "n", "loss"])

    settle(turns.sparkSession)
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text").mapInArrow(run, "conv_id long, n long, loss long")
    return t.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_segments"), F.sum("loss").alias("n_loss"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in bins under limits of tokens, segments and loss-bearing tokens at once: example_id, bin_id, slot."""
    return pack_examples(conversation_examples(table(spark, sf_dir, "conversations"), tokenizer_file()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: pieces of sequences, with their ids.

    Null and empty texts give the id 0 alone; repeated rows and ids are packed each; an empty table gives no rows;
    only doc_id and text are read, so other columns may have any names."""
    return pack_documents(docs, tokenizer_file(), with_ids=True)
