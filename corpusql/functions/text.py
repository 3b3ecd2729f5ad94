"""Text functions: normalisation, tokens, trigrams, query compilation, phrase predicates, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[a-z0-9]+|[一-鿿]"
_ASCII = re.compile(r"[a-z0-9]+\Z")
_QUOTES = str.maketrans({c: '"' for c in "“”„‟«»「」『』＂"})


def normalize_text(s: str, case_sensitive: bool = False) -> str:
    """NFKC, then case folding unless asked otherwise; punctuation stays."""
    out = unicodedata.normalize("NFKC", s)
    return out if case_sensitive else out.casefold()


@F.pandas_udf(StringType())
def normalize_full(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Full Unicode normalisation, Arrow-batched; nulls stay null."""
    for t in texts:
        yield t.map(lambda x: None if x is None else normalize_text(x))


#: NFKC's rule for full-width forms: U+FF01 to U+FF5E stand for U+0021 to U+007E, the ideographic space for a space.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def normalize(col: Column) -> Column:
    """Native form: lower case, ß as ss, full-width forms as ASCII; other compatibility characters need normalize_full."""
    narrow = F.when(col.rlike("[　！-～]"), F.translate(col, _WIDE, _NARROW)).otherwise(col)
    return F.replace(F.lower(narrow), F.lit("ß"), F.lit("ss"))


def base_tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(TOKEN), F.lit(0))


def trigrams(tokens: Column) -> Column:
    long = F.filter(tokens, lambda t: (F.length(t) >= 3) & t.rlike("^[a-z0-9]+$"))
    return F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))))


def index_tokens(norm: Column) -> Column:
    """Base tokens, then the trigrams of those of three ASCII letters or more."""
    t = base_tokens(norm)
    return F.concat(t, trigrams(t))


def padded(tokens: Column) -> Column:
    """Tokens as ' a b c ', in which a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


@dataclass(frozen=True)
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)

    @property
    def pieces(self) -> list[str]:
        return [normalize_text(x) for x in [*self.phrases, *self.terms] if x.strip()]


def parse_query(text: str) -> Query:
    """Quoted runs are phrases (any kind of quotes), the rest splits at white space; an open quote is dropped."""
    text = text.translate(_QUOTES)
    phrases = [p.strip() for p in re.findall(r'"([^"]*)"', text) if p.strip()]
    rest = re.sub(r'"[^"]*"', " ", text).replace('"', " ")
    return Query(rest.split(), phrases)


def whole_phrase(query: Query) -> str:
    """What the query asks for as one phrase: its terms, or its only quoted run; a mixed query has none."""
    if query.phrases:
        return "" if query.terms or len(query.phrases) > 1 else query.phrases[0]
    return " ".join(query.terms)


def query_stem(text: str) -> str:
    """The query as the name of a file, without .pptx or .ppt."""
    return re.sub(r"\.pptx?\Z", "", normalize_text(text).strip())


def letters(text: str) -> str:
    """What ``compact`` leaves of a normalised text."""
    return "".join(re.findall(r"[0-9a-z一-鿿]", normalize_text(text)))


def clauses(piece: str, exact: bool = False) -> list[str]:
    """What a normalised piece asks of padded tokens: adjacent tokens, or all trigrams of one ASCII word."""
    tokens = re.findall(TOKEN, piece)
    if not tokens:
        return []
    if len(tokens) == 1 and _ASCII.match(tokens[0]) and len(tokens[0]) >= 3 and not exact:
        return list(dict.fromkeys(tokens[0][i : i + 3] for i in range(len(tokens[0]) - 2)))
    return [" ".join(tokens)]


def match(pad: Column, query: Query, exact: bool = False) -> Column:
    """All clauses of all pieces; a query without any token matches nothing."""
    found = [c for p in query.pieces for c in clauses(p, exact)]
    if not found:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.contains(pad, F.lit(f" {c} ")) for c in found])


def holds_all(norm: Column, query: Query) -> Column:
    """The raw check behind recall: every normalised piece is a substring."""
    return reduce(lambda a, b: a & b, [F.contains(norm, F.lit(p)) for p in query.pieces], F.lit(bool(query.pieces)))


def compact(col: Column) -> Column:
    return F.regexp_replace(col, r"(?i)[^0-9a-z一-鿿]", "")


def contains_compact(col: Column, text: str) -> Column:
    """The letters of ``text`` in order with anything but letters and digits between them, not inside a longer ASCII word."""
    chars = letters(text)
    if not chars:
        return F.lit(False)
    body = r"[^0-9a-zA-Z一-鿿]*".join(re.escape(c) for c in chars)
    return col.rlike("(?i)" + _bounded(body, chars[0], chars[-1]))


def contains_phrase(col: Column, text: str) -> Column:
    """``text``, its white space joined, not inside a longer ASCII word."""
    words = normalize_text(text).split()
    if not words:
        return F.lit(False)
    body = r"\s+".join(re.escape(w) for w in words)
    return col.rlike(_bounded(body, words[0][0], words[-1][-1]))


def _bounded(body: str, first: str, last: str) -> str:
    edge = re.compile(r"[0-9A-Za-z]")
    return ("(?<![0-9A-Za-z])" if edge.match(first) else "") + body + ("(?![0-9A-Za-z])" if edge.match(last) else "")


def snippet(raw: Column, norm: Column, query: Query, around: int = 34, none: int = 68) -> Column:
    """The first piece that occurs, phrases before terms, in 【】 with its surroundings; else the text's start."""
    flat, out = F.replace(raw, F.lit("\n"), F.lit(" ")), None
    for p in query.pieces:
        at = F.instr(norm, p)
        start = F.greatest(at - around, F.lit(1))
        end = F.least(at + len(p) - 1 + around, F.length(flat))
        made = F.concat(
            F.when(start > 1, "…").otherwise(""), F.substring(flat, start, at - start), F.lit("【"), F.substring(flat, at, F.lit(len(p))), F.lit("】"),
            F.substring(flat, at + len(p), end - at - len(p) + 1), F.when(end < F.length(flat), "…").otherwise(""),
        )
        out = F.when(at > 0, made) if out is None else out.when(at > 0, made)
    start = F.substring(flat, 1, none)
    return start if out is None else out.otherwise(start)


def stem_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(pptx?|potx?|ppsx?)$", "")


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out
