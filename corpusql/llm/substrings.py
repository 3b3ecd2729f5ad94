"""Substring dedup: passages that documents share, as paragraphs alike or as exact runs inside longer ones.

1. Paragraphs (all lines that aren't blank) become sets of five-word shingles; of fewer words the whole line is
   one. Paragraphs of equal sets are one class, however short; each class gets minima in BANDS bands of ROWS;
   colliding paragraphs are joined (see lsh) and confirmed by exact Jaccard on full sets; components of links
   are clusters. 12 bands of 3 rows miss a pair at similarity 0.8 with probability 2e-4. Sets of fewer than
   LEAST shingles can't be PERCENT alike unless they are equal, so they need no minima.
2. A passage may sit in the middle of a paragraph. Every run of GUARANTEE words that two documents share,
   wherever it stands, is found by winnowing: of all windows of WINDOW words that start within the same
   GUARANTEE - WINDOW + 1 places the one of least hash is kept (one minimum a place: MinHash of a row), and
   equal windows are joined. A run's other words lie within REACH words of one of its kept windows. So each window
   has hashes of the REACH words before and after it: where the keeper has the window with the same ones, all of
   them belong to the run; where it hasn't, at the ends of a run, the windows are held against each other word by
   word, and so are the words around them. Documents of equal word sequences are one run without that.
3. Clusters of paragraphs and runs that lie in more than one document are repeats: what the document of the
   smallest doc_id holds of one stays; what the others hold are removals.

Result: a row for each row of docs: doc_id, n_words, n_paragraphs, n_links (passages of GUARANTEE words or more that
it shares, overlapping ones counted as one), n_short_links (shorter ones: repeated lines, and runs found by chance),
n_removed (words covered by removals), repeats (n_links > 0), sources (the doc_ids that keep the removals,
sorted), component_id (the smallest doc_id reachable over shared passages of any length), spans (removed words,
[first, end) pairs in one list).

Nulls and edges: a null or empty text has no links; rows of a null doc_id link with nothing; rows of one id
count as one document and carry the same links; an empty table gives no rows; other columns aren't read;
whole texts are read. A passage that one document repeats within itself only isn't a link."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.common import Staged, drop_since, fresh, settle, staged, table
from corpusql.llm.graph import components
from corpusql.llm.lsh import linked
from corpusql.llm.minhash import band_keys
from corpusql.llm.words import MinHash, grams, line_hashes, parts, sequence_hashes, shingles, slices, word_hashes

WINDOW, GUARANTEE = 25, 50
REACH = GUARANTEE - WINDOW + 1
BANDS, ROWS, MINIMA, BITS, MARGIN, SHINGLE, PERCENT = 12, 3, 192, 4, 0.15, 5, 80
#: Of two sets that differ and are PERCENT alike, the smaller one has LEAST shingles or more.
LEAST = -(-PERCENT // (100 - PERCENT))
#: Parts that the rows of a passage are dealt over where they meet its keeper: one passage may be in a third of all documents.
SALTS = 16


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """The least (or, with np.maximum, the greatest) of each n neighbours, by doubling."""
    have = 1
    while 2 * have <= n:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def winnow(h: np.ndarray, places: int) -> np.ndarray:
    """Indices of the least hashes (all, if equal) within each ``places`` neighbours; all of them fall within one if fewer."""
    if not len(h):
        return np.zeros(0, np.int64)
    places = min(places, len(h))
    low = _sliding(h, places, np.minimum)
    edge = np.zeros(places - 1, h.dtype)
    return np.flatnonzero(h == _sliding(np.concatenate([edge, low, edge]), places, np.maximum))


UNIT = "kind int, doc_id long, id long, first long, words long, size long, before long, after long, keys array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document (id: paragraphs, size: hash of its words); 1: a paragraph, with band keys
    where its set has LEAST shingles and is new in the partition; 2: a window (words: how many of REACH follow it,
    and bits of the words next to it; before, after: hashes of the words around it)."""
    family, seen = MinHash(BANDS, ROWS, seed=11), set()
    for x in batches:
        h, at, lines, owner = line_hashes(x["text"].to_pylist())
        ids, known = x["doc_id"].to_pylist(), x["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        doc = x["doc_id"].fill_null(0).to_numpy()
        own = np.flatnonzero(known[owner])  # the lines of documents with an id
        values, off = parts(*shingles(h, lines, SHINGLE), own)
        line_ids, size = sequence_hashes(values, off), np.diff(off)
        keys = band_keys(family, values, off, line_ids, size >= LEAST, seen)
        g, windows = grams(h, WINDOW), []
        for i in np.flatnonzero(known).tolist():
            windows.append(at[i] + winnow(g[at[i] : max(at[i], at[i + 1] - WINDOW + 1)], REACH))
        place = np.concatenate([np.zeros(0, np.int64), *windows])
        of = np.searchsorted(at, place, "right") - 1
        left, last = np.maximum(place - REACH, at[of]), np.minimum(place + WINDOW + REACH, at[of + 1])
        before, after = (slices(h, lo, hi).view(np.int64) for lo, hi in ((left, place), (place + WINDOW, last)))
        # the words next to a window, as 16 bits each, stand above the count of those that follow it
        near = [np.where(there, h[np.clip(i, 0, max(len(h) - 1, 0))] >> np.uint64(48), 0).astype(np.int64) if len(h) else np.zeros(0, np.int64) for i, there in ((place - 1, left < place), (place + WINDOW, last > place + WINDOW))]
        follow = (last - place - WINDOW) | near[0] << 8 | near[1] << 24
        a, b, c = len(ids), len(own), len(place)
        none, paragraphs = np.zeros(a, np.int64), np.bincount(owner, minlength=a)
        spread = lambda u, v, w: pa.array(np.concatenate([u, v, w]).astype(np.int64))
        padded = lambda v: pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(a, np.int32), v.offsets.to_numpy(), np.full(c, v.offsets[-1].as_py(), np.int32)])), v.values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1, 2], np.int32), [a, b, c])), pa.array([*ids, *doc[owner[own]].tolist(), *doc[of].tolist()], pa.int64()),
                spread(paragraphs, line_ids, g[place].view(np.int64)), spread(none, lines[own] - at[owner[own]], place - at[of]),
                spread(np.diff(at), np.diff(lines)[own], follow), spread(sequence_hashes(h, at), size, np.zeros(c)),
                spread(none, np.zeros(b), before), spread(none, np.zeros(b), after), padded(keys),
            ],
            [c.split()[0] for c in UNIT.split(", ")],
        )


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, ids): the paragraphs of the text whose sets hash to one of ids."""
    for x in batches:
        texts = x["text"].to_pylist()
        lines = [ln for t in texts for ln in (t or "").split("\n")]
        owner = [i for i, t in enumerate(texts) for _ in range((t or "").count("\n") + 1)]
        found = sequence_hashes(*shingles(*word_hashes(lines), SHINGLE)).tolist()
        want = [set(w) for w in x["ids"].to_pylist()]
        ids, out = [], []
        for k, i, ln in zip(found, owner, lines, strict=True):
            if k in want[i]:
                want[i].discard(k)
                ids.append(k)
                out.append(ln)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "text"])


def _clusters(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(id, root) of linked classes of paragraphs; classes of smaller sets link with none."""
    signed = units.where("kind = 1 and size(keys) > 0")

    def texts_of(ids: DataFrame) -> DataFrame:
        reps = signed.join(ids, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
        want = reps.groupBy("doc_id").agg(F.collect_list("id").alias("ids"))
        return docs.join(want, "doc_id").select("text", "ids").mapInArrow(_wanted, "id long, text string").dropDuplicates(["id"])

    return linked(signed.select("id", F.explode("keys").alias("key")), texts_of, SHINGLE, PERCENT, MINIMA, MARGIN, BITS)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, places): for each place that has a window its words, and up to REACH words to either side, the left ones backwards."""
    for x in batches:
        h, at = word_hashes(x["text"].to_pylist())
        h = h.view(np.int64)
        out: list[tuple] = []
        for i, (d, places) in enumerate(zip(x["doc_id"].to_pylist(), x["places"].to_pylist(), strict=True)):
            w = h[at[i] : at[i + 1]]
            out += [(d, p, w[p : p + WINDOW], w[max(0, p - REACH) : p][::-1], w[p + WINDOW : p + WINDOW + REACH]) for p in places if p + WINDOW <= len(w)]
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[2:])], ["doc_id", "place", "own", "left", "right"])


def _equal(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(n)


def _runs(docs: DataFrame, rows: DataFrame, found: Staged) -> DataFrame:
    """Of repeated windows (id, doc_id, kept, first, words, before, after), which are removed then, the runs around them.

    (doc_id, kept, first, words, away): what documents share with the keeper, and (away false) what keepers have of it.
    Runs are verified and not whole ones yet: those of one document overlap."""
    windows = found.df
    texts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("words_id").alias("is"), F.max("words_id").alias("to"), F.max("n_words").alias("n")).where("is = to")
    away = windows.where("doc_id > kept")
    copies = away.select("doc_id", "kept").distinct().join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("kept"), F.col("is").alias("as")), "kept").where("is = as")
    copies = Staged(copies.select("doc_id", "kept", "n"), "copies")
    mine = windows.where("doc_id = kept")
    bits = {"before": 8, "after": 24}

    def near(words: Column, c: str) -> Column:
        return F.shiftright(words, bits[c]).bitwiseAND(F.lit(0xFFFF))

    sides = {c: mine.groupBy("id", c).agg(F.min("first").alias("at"), F.first(near(F.col("words"), c)).alias("near")).groupBy("id").agg(F.collect_list(F.struct(F.col(c).alias("h"), "at", "near")).alias(f"{c}s")) for c in bits}
    keeper = sides["before"].join(sides["after"], "id").withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    met = away.join(copies.df.select("doc_id", "kept"), ["doc_id", "kept"], "left_anti").withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(keeper, ["id", "salt"])

    def place(c: str) -> Column:  # of the keeper's window with the same words on that side
        return F.try_element_at(F.filter(f"{c}s", lambda x: x["h"] == F.col(c)), F.lit(1))["at"]

    def others(c: str) -> Column:
        """Else its windows next to which the same word may stand; where there is none, one of them, for the words of the window."""
        like = F.filter(f"{c}s", lambda x: x["near"] == near(F.col("words"), c))
        return F.when(place(c).isNull(), F.transform(F.when(F.size(like) > 0, like).otherwise(F.slice(f"{c}s", 1, 1)), lambda x: x["at"])).otherwise(F.array().cast("array<long>"))

    met = met.select("doc_id", "kept", "first", F.col("words").bitwiseAND(F.lit(0xFF)).alias("words"), place("before").alias("lo_at"), place("after").alias("hi_at"), others("before").alias("lo_of"), others("after").alias("hi_of"))
    met = Staged(met, "met")
    found.drop()
    open_ = met.df.where("size(lo_of) + size(hi_of) > 0")
    there = open_.select(F.col("kept").alias("doc_id"), F.explode(F.concat("lo_of", "hi_of")).alias("place"))
    wanted = open_.select("doc_id", F.col("first").alias("place")).unionByName(there).distinct().groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    words = docs.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(_around, "doc_id long, place long, own array<long>, left array<long>, right array<long>").dropDuplicates(["doc_id", "place"])
    words = Staged(words, "around")

    def ends(of: str, side: str) -> DataFrame:
        """(doc_id, kept, first, at, more): equal words beyond windows that are equal word by word."""
        rows = open_.select("doc_id", "kept", "first", F.explode(of).alias("at"))
        a = words.df.select("doc_id", F.col("place").alias("first"), F.col("own").alias("a"), F.col(side).alias("x"))
        b = words.df.select(F.col("doc_id").alias("kept"), F.col("place").alias("at"), F.col("own").alias("b"), F.col(side).alias("y"))
        return rows.join(a, ["doc_id", "first"]).join(b, ["kept", "at"]).where("a = b").select("doc_id", "kept", "first", "at", _equal(F.col("x"), F.col("y")).cast("long").alias("more"))

    w, reach = F.lit(WINDOW).cast("long"), F.least(F.col("first"), F.lit(REACH).cast("long"))
    zero = F.lit(0).cast("long")

    def spans(rows: DataFrame, first: Column, at: Column, words: Column) -> DataFrame:
        """A row of the document and one of its keeper."""
        of = F.struct("doc_id", "kept", first.alias("first"), words.cast("long").alias("words"), F.lit(True).alias("away"))
        has = F.struct(F.col("kept").alias("doc_id"), "kept", at.alias("first"), words.cast("long").alias("words"), F.lit(False).alias("away"))
        return rows.select(F.explode(F.array(of, has)).alias("x")).select("x.*").where("first is not null")

    reach = F.when(F.col("lo_at").isNotNull(), reach).otherwise(zero)
    follow = F.when(F.col("hi_at").isNotNull(), F.col("words")).otherwise(zero)
    same = met.df.where("lo_at is not null or hi_at is not null")
    both = F.when(F.col("lo_at").isNotNull() & F.col("hi_at").isNotNull() & (F.col("lo_at") != F.col("hi_at")), F.lit(None)).otherwise(F.coalesce("lo_at", "hi_at") - reach)
    apart = same.where("lo_at <> hi_at")  # the keeper has the window twice: each side stands elsewhere
    out = [
        spans(same, F.col("first") - reach, both, w + reach + follow), spans(apart, F.lit(None).cast("long"), F.col("lo_at") - reach, w + reach), spans(apart, F.lit(None).cast("long"), F.col("hi_at"), w + follow),
        spans(copies.df.withColumnRenamed("n", "words"), zero, zero, F.col("words")),
    ]
    for of, side, back in (("lo_of", "left", F.col("more")), ("hi_of", "right", zero)):
        out.append(spans(ends(of, side), F.col("first") - back, F.col("at") - back, w + F.col("more")))
    return reduce(DataFrame.unionByName, out)


def _repeated(held: DataFrame) -> DataFrame:
    """held(id, doc_id, ...) with kept, the smallest doc_id, of the ids that more than one document holds."""
    seen = held.groupBy("id").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("most")).where("kept < most").select("id", "kept")
    seen = seen.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    return held.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(seen, ["id", "salt"]).drop("salt")


#: Sorted [first, end) pairs, as one list, of an array of them: those that touch (<=) or overlap (<) become one.
_MERGED = (
    "aggregate({spans}, cast(array() as array<bigint>), (s, x) -> case when size(s) > 0 and x.first {by} s[size(s) - 1] "
    "then concat(slice(s, 1, size(s) - 1), array(greatest(s[size(s) - 1], x.end))) else concat(s, array(x.first, x.end)) end)"
)


def _merged(spans: DataFrame) -> DataFrame:
    """Of spans(doc_id, kept, first, end, away) a row a document: held, spans (merged [first, end) lists), sources.

    Spans that follow on one another are joined in their order first, so that few of a document meet in its lists."""
    order = W.partitionBy("doc_id").orderBy("first", "end")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = spans.withColumn("new", (F.col("first") >= F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    s = s.withColumn("newer", (F.col("first") > F.coalesce(F.max(F.when(F.col("away"), F.col("end"))).over(before), F.lit(-1))).cast("int"))
    s = s.withColumn("held", F.sum("new").over(order)).withColumn("gone", F.sum(F.when(F.col("away"), F.col("newer")).otherwise(0)).over(order))
    few = s.groupBy("doc_id", "held", "gone", "away").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.collect_set("kept").alias("kept"))
    span, away = F.struct("first", "end"), F.col("away")
    of = few.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(away, F.col("kept")))))).alias("sources"), F.array_sort(F.collect_list(F.when(away, span))).alias("gone"), F.array_sort(F.collect_list(span)).alias("held"))
    return of.withColumn("spans", F.expr(_MERGED.format(spans="gone", by="<="))).withColumn("held", F.expr(_MERGED.format(spans="held", by="<")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """See above."""
    settle(docs.sparkSession)
    before = staged()
    docs = docs.select("doc_id", "text")
    units = Staged(docs.mapInArrow(_scan, UNIT), "units")
    comps = _clusters(docs, units.df)
    lines = units.df.where("kind = 1").select("id", "doc_id", "first", "words").join(comps, "id", "left").select(F.coalesce("root", "id").alias("id"), "doc_id", "first", "words")
    lines = Staged(_repeated(lines).select("doc_id", "kept", "first", "words"), "lines").df
    windows = Staged(_repeated(units.df.where("kind = 2").select("id", "doc_id", "first", "words", "before", "after")), "windows")
    rows = Staged(units.df.where("kind = 0").select("doc_id", F.col("words").alias("n_words"), F.col("id").alias("n_paragraphs"), F.col("size").alias("words_id")), "rows").df
    units.drop()
    found = Staged(_runs(docs, rows, windows).unionByName(lines.withColumn("away", F.lit(True))), "found").df
    mine = found.where("away").drop("away")
    held = mine.unionByName(found.where("not away").drop("away").distinct())  # a popular keeper's rows are the same over and over
    joined = components(mine.select(F.col("doc_id").alias("a"), F.col("kept").alias("b")))
    of = _merged(held.select("doc_id", "kept", "first", (F.col("first") + F.col("words")).alias("end"), (F.col("doc_id") > F.col("kept")).alias("away")))
    long = F.expr(f"size(filter(transform(held, (x, i) -> i % 2 = 1 and x - held[i - 1] >= {GUARANTEE}), x -> x))").cast("long")
    of = of.withColumn("n_links", long).withColumn("n_short_links", (F.size("held") / 2).cast("long") - F.col("n_links")).drop("gone", "held")
    out = rows.join(of, "doc_id", "left").join(joined.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
    none = F.array().cast("array<long>")
    covered = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    zero = F.lit(0).cast("long")
    out = Staged(out.select(
        "doc_id", "n_words", "n_paragraphs", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_short_links", zero).alias("n_short_links"), F.coalesce(covered, zero).alias("n_removed"),
        F.coalesce(F.col("n_links") > 0, F.lit(False)).alias("repeats"), F.coalesce("sources", none).alias("sources"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("spans", none).alias("spans"),
    ), "passages")
    drop_since(before, out)
    return out.df


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the removed words of repeated_passages(docs) taken out; other columns stay, whatever their names.

    Words are parted by single spaces where one was taken out. Null texts and rows of a null doc_id stay as they are."""
    key, name = fresh(docs, "id_"), fresh(docs, "spans_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for t, spans in zip(x["text"].to_pylist(), x[name].to_pylist(), strict=True):
                if t and spans:
                    at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                    for first, end in reversed(list(zip(spans[::2], spans[1::2], strict=True))):
                        t = t[: at[first][0]].rstrip(" ") + " " * (at[first][0] > 0) + t[at[end - 1][1] :].lstrip(" ")
                out.append(t)
            rest = [c for c in x.schema.names if c not in ("text", name)]
            yield pa.RecordBatch.from_arrays([*(x[c] for c in rest), pa.array(out, pa.string())], [*rest, "text"])

    spans = found.where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("spans").alias(name)).dropDuplicates([key])
    joined = docs.join(spans, F.col("doc_id") == F.col(key), "left").select(*docs.columns, name)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string"
    return joined.mapInArrow(cut, schema).select(*docs.columns)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
