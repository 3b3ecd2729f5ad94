"""Merkle fingerprints of documents, in DataFrame functions alone.

The tree: a document's sections (parted before blank lines and headings, which belong to them, so that sections
in a row are the whole text), their paragraphs (lines, blank ones too), and pieces of paragraphs (up to a sentence's
end or PIECE characters). A paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes, the
root that of its sections' nodes; so equal texts, and no others, have equal roots by their nodes alone. Pieces
carry 32-bit hashes for likeness below paragraphs; equal branches have equal pieces.

A fingerprint is a string: root:section.section...:piece piece ... (hex; sections by 16 digits, pieces by 8).
Likeness of two is 1 for equal roots, else Dice's coefficient of their sets of pieces: both come from the
strings' own nodes. ``differing`` walks two trees from the root and names the paragraphs that differ; the query's
edited_section and edited_paragraph are the first of them between a text and its edited one (null: equal).

The next document of each comes from a window over ranges of doc_id, never over one task: the driver reads
splitters (approximate quantiles, ids that exist), each range also gets the first row of the range after it,
the last range the first row of all.

Nulls and edges: a null text is an empty one; rows of a null doc_id come first; repeated ids are ordered by
their texts' hashes; a lone row is its own next one; an empty table gives no rows; an empty text's likeness
is 1 to an empty one and 0 to others; columns other than doc_id and text aren't read. Texts are never cut."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.common import table, text_or_empty

PIECE = 64
SECTION = r"(?=\n[ \t]*\n)|(?=\n#{1,6} )"
PIECES = r"[^.!?\n]{1,%d}+(?:[.!?]++[ \t]*+)?|[.!?\n]++[ \t]*+" % PIECE


def nodes(text: Column) -> Column:
    """Sections as arrays of paragraph nodes."""
    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def section_nodes(text: Column) -> Column:
    return F.transform(nodes(text), lambda ps: F.sha2(F.array_join(ps, ""), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def first_difference(a: Column, b: Column) -> Column:
    """The place, from 0, of the first nodes in which two arrays differ; null if they are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(at > 0, at - 1)


def pieces(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda x: F.hash(x)))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two sets of pieces; 1 if both are empty."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def _string(root_: str, sections: str, own: str) -> Column:
    heads = F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 16)), ".")
    hexes = F.array_join(F.transform(own, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), " ")
    return F.concat_ws(":", root_, heads, F.lower(hexes))


def fingerprint(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds {prefix}root, {prefix}pieces and {prefix}fingerprint of the column ``text`` (not null)."""
    df = df.withColumn(f"{prefix}sections", section_nodes(F.col(text))).withColumn(f"{prefix}pieces", pieces(F.col(text)))
    df = df.withColumn(f"{prefix}root", root(F.col(f"{prefix}sections")))
    return df.withColumn(f"{prefix}fingerprint", _string(f"{prefix}root", f"{prefix}sections", f"{prefix}pieces"))


def differing(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pair_id, section, paragraph (from 0) where the trees of the texts ``a`` and ``b`` differ.

    Only branches whose nodes differ are opened: equal roots give no rows, equal sections no paragraphs."""
    t = pairs.select("pair_id", text_or_empty(a).alias("a"), text_or_empty(b).alias("b")).where("a <> b")
    t = t.select("pair_id", nodes(F.col("a")).alias("a"), nodes(F.col("b")).alias("b"))
    t = t.select("pair_id", F.posexplode(F.arrays_zip("a", "b")).alias("section", "s")).where("not s.a <=> s.b")
    t = t.select("pair_id", "section", F.coalesce("s.a", F.array().cast("array<string>")).alias("a"), F.coalesce("s.b", F.array().cast("array<string>")).alias("b"))
    t = t.select("pair_id", "section", F.posexplode(F.arrays_zip("a", "b")).alias("paragraph", "p")).where("not p.a <=> p.b")
    return t.select("pair_id", F.col("section").cast("long"), F.col("paragraph").cast("long"))


def _ranges(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below doc_id, in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    whole = F.array(*(F.lit(b[0]).cast("long") for b in blocks))
    rest = F.array(*(F.array(*(F.lit(x).cast("long") for x in b)) for b in blocks))
    block = F.size(F.filter(whole, lambda x: x <= doc_id))
    inside = F.size(F.filter(F.element_at(rest, F.greatest(block, F.lit(1))), lambda x: x <= doc_id))
    return F.when(doc_id.isNull() | (block == 0), 0).otherwise((block - 1) * step + inside)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by (doc_id, hash of the text), cyclically."""
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    marks = [i / ranges for i in range(1, ranges)]
    stats = docs.agg(F.percentile_approx("doc_id", marks, 10_000).alias("q"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    low = None if stats.nulls else stats.low
    bounds = sorted({b for b in stats.q or [] if b != stats.low})
    at = _ranges(F.col("doc_id"), bounds).alias("range")
    own = F.struct(at, F.lit(0).alias("guest"))
    is_bound = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    guest = F.struct((_ranges(F.col("doc_id"), bounds) - 1).alias("range"), F.lit(1).alias("guest"))
    wrap = F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(F.lit(low).cast("long")), F.array(own, wrap)).when(is_bound, F.array(own, guest)).otherwise(F.array(own))
    dealt = docs.withColumn("place", F.explode(places)).select("doc_id", "text", "tie", "place.range", "place.guest")
    order = W.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def with_edits(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds to with_next the edited text: the last quarter replaced by as much of the next text's start."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    return with_next(docs, ranges).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = with_edits(table(spark, sf_dir, "documents"), ranges)
    df = fingerprint(fingerprint(df, "text"), "edited", "edited_")
    df = df.withColumn("next_pieces", pieces(F.col("next_text")))
    near = F.when(F.col("root") == F.col("edited_root"), 1.0).otherwise(likeness(F.col("pieces"), F.col("edited_pieces")))
    at = first_difference(F.col("sections"), F.col("edited_sections"))
    branch = lambda c: F.coalesce(F.get(F.split(c, SECTION), at.cast("int")), F.lit(""))
    lines = first_difference(*(F.transform(F.split(branch(c), "\n"), lambda p: F.sha2(p, 256)) for c in ("text", "edited")))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near.alias("near_edited"), likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
        at.cast("long").alias("edited_section"), F.when(at.isNotNull(), lines.cast("long")).alias("edited_paragraph"),
    )
