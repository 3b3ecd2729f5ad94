"""Search queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql import adapters as A
from corpusql.functions import text as T
from corpusql.plans import search as S

TEXT = "that with"


def search_and_same_page(spark, d):
    q = T.parse_query(TEXT)
    p = A.pages(spark, d)
    return p.where(T.match(T.padded(T.index_tokens(F.col("norm"))), q) & T.holds_all(F.col("norm"), q)).select("file_id", "page_no")


def search_bm25_top(spark, d):
    r = S.bm25(S.tokenised(A.pages(spark, d)), T.parse_query(TEXT))
    return r.select("file_id", "page_no", F.round("rank", 5).alias("rank")).orderBy("rank", "file_id", "page_no").limit(50)


def search_phrase(spark, d):
    p = A.pages(spark, d)
    return p.where(T.contains_phrase(F.col("norm"), "of the")).select("file_id", "page_no", T.snippet(F.col("raw_text"), F.col("norm"), T.Query([], ["of the"])).alias("snippet"))


def search_ranked(spark, d):
    return S.search(A.pages(spark, d), A.files(spark, d).drop("text"), TEXT)


def search_scoped(spark, d):
    return S.search(A.pages(spark, d), A.files(spark, d).drop("text"), "\"of the\" thand", scope="/LIB/src1", exts=["pptx", "docx"])


def name_hits(spark, d):
    return S.name_hits(A.files(spark, d).drop("text"), T.parse_query("report final"))


def recent_files(spark, d):
    return A.files(spark, d).orderBy(F.col("mtime").desc(), "file_id").limit(20).select("file_id", "path", "mtime")


def page_titles(spark, d):
    first = F.substring(F.trim(F.regexp_replace("raw_text", r"\s+", " ")), 1, 38)
    p = A.pages(spark, d).where("file_id = 8")
    return p.orderBy("page_no").limit(40).select("page_no", F.when(first == "", F.concat(F.lit("第 "), F.col("page_no"), F.lit(" 页"))).otherwise(first).alias("title"))


def page_titles_by_file(spark, d):
    """The titles of the first 40 pages of every file."""
    first = F.substring(F.trim(F.regexp_replace("raw_text", r"\s+", " ")), 1, 38)
    p = A.pages(spark, d).withColumn("k", F.row_number().over(W.partitionBy("file_id").orderBy("page_no"))).where("k <= 40")
    return p.select("file_id", "page_no", F.when(first == "", F.concat(F.lit("第 "), F.col("page_no"), F.lit(" 页"))).otherwise(first).alias("title"))


def dup_collapse(spark, d):
    f = A.files(spark, d)
    g = f.groupBy("content_hash").agg(F.max_by("path", F.struct("mtime", "path")).alias("kept"), F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    return g.where("n > 1").select("content_hash", "kept", "n", F.array_join("paths", "|").alias("paths"))


def top_terms(spark, d):
    w = A.read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(T.normalize(F.col("text")), F.lit("[a-z][a-z0-9+._-]{1,20}"), F.lit(0))).alias("w"))
    w = w.withColumn("term", F.regexp_replace("w", r"^[._+-]+|[._+-]+$", "")).where(F.length("term") >= 2)
    return w.groupBy("term").agg(F.count("*").alias("tf"), F.count_distinct("doc_id").alias("df")).orderBy(F.col("tf").desc(), "term").limit(10)


def repeated_sentences(spark, d):
    s = A.read(spark, d, "documents").select(F.explode(F.split("text", r"[。！？!?；;\r\n]+")).alias("s"))
    s = s.select(F.trim(F.regexp_replace("s", r"\s+", " ")).alias("sentence")).where(F.length("sentence").between(6, 80))
    return s.groupBy("sentence").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "sentence").limit(20)


def language_ratios(spark, d):
    t = A.read(spark, d, "documents")
    c = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return t.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), c("[A-Za-z]").alias("latin"), c("[0-9]").alias("digits"), c("[!?]").alias("marks"), c("[一-鿿]").alias("cjk"))


QUERIES = {f.__name__: f for f in (search_and_same_page, search_bm25_top, search_phrase, search_ranked, search_scoped, name_hits, recent_files, page_titles, page_titles_by_file, dup_collapse, top_terms, repeated_sentences, language_ratios)}

_TOK = r"""tok AS (SELECT file_id, page_no, norm, t, list_concat(t, flatten(list_transform(list_filter(t, lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z0-9]+')),
  lambda x: list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))))) AS toks FROM (SELECT *, regexp_extract_all(norm, '[a-z0-9]+|[一-鿿]') AS t FROM pages_raw))"""
_IDF = "greatest(ln((n - {c} + 0.5) / ({c} + 0.5)), 1e-6)"
_TERMS = ["tha", "hat", "wit", "ith"]
_SCORE = " + ".join(f"{_IDF.format(c='c' + w)} * ({w} * 2.2) / ({w} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for w in _TERMS)
_BM25 = f"""{_TOK}, tf AS (SELECT file_id, page_no, norm, len(toks) AS dl, {', '.join(f"CAST(len(list_filter(toks, lambda x: x = '{w}')) AS DOUBLE) AS {w}" for w in _TERMS)} FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER ({w} > 0) AS c{w}' for w in _TERMS)} FROM tf),
ranked AS (SELECT file_id, page_no, norm, -({_SCORE}) AS rank FROM tf, stats WHERE {' AND '.join(f'{w} > 0' for w in _TERMS)})"""

ORACLE_SQL = {
    "search_and_same_page": f"WITH {A.PAGES_CTE}, {_TOK} SELECT file_id, page_no FROM tok WHERE {' AND '.join(f'''list_contains(toks, '{w}')''' for w in _TERMS)} AND contains(norm, 'that') AND contains(norm, 'with')",
    "search_bm25_top": f"WITH {A.PAGES_CTE}, {_BM25} SELECT file_id, page_no, round(rank, 5) AS rank FROM ranked ORDER BY 3, 1, 2 LIMIT 50",
    "name_hits": f"WITH {A.FILES_CTE} SELECT file_id FROM files WHERE contains(lower(name), 'report') AND contains(lower(name), 'final')",
    "recent_files": f"WITH {A.FILES_CTE} SELECT file_id, path, mtime FROM files ORDER BY mtime DESC, file_id LIMIT 20",
    "page_titles": f"WITH {A.PAGES_CTE} SELECT page_no, substr(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), 1, 38) AS title FROM pages_raw WHERE file_id = 8 ORDER BY page_no LIMIT 40",
    "page_titles_by_file": f"WITH {A.PAGES_CTE} SELECT file_id, page_no, substr(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')), 1, 38) AS title FROM pages_raw QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY page_no) <= 40",
    "dup_collapse": f"WITH {A.FILES_CTE} SELECT content_hash, arg_max(path, struct_pack(m := mtime, p := path)) AS kept, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM files GROUP BY 1 HAVING count(*) > 1",
    "top_terms": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z][a-z0-9+._-]{1,20}')) AS w FROM documents),
t AS (SELECT doc_id, regexp_replace(w, '^[._+-]+|[._+-]+$', '', 'g') AS term FROM w) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t WHERE length(term) >= 2 GROUP BY 1 ORDER BY tf DESC, term LIMIT 10""",
    "repeated_sentences": r"""WITH s AS (SELECT unnest(regexp_split_to_array(text, '[。！？!?；;\r\n]+')) AS s FROM documents), t AS (SELECT trim(regexp_replace(s, '\s+', ' ', 'g')) AS sentence FROM s)
SELECT sentence, count(*) AS n FROM t WHERE length(sentence) BETWEEN 6 AND 80 GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, sentence LIMIT 20""",
    "language_ratios": "SELECT lang, sum(length(text))::BIGINT AS chars, " + ", ".join(f"sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS {n}" for p, n in [("[A-Za-z]", "latin"), ("[0-9]", "digits"), ("[!?]", "marks"), ("[一-鿿]", "cjk")]) + " FROM documents GROUP BY lang",
}
