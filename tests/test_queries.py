"""Queries against their SQL on the smallest tables, and literal cases of the text functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusql import registry
from corpusql.functions import text as T
from corpusql.plans import search as S

DIR = "/root/testdata/sf0.001"
TABLES = "lineitem orders events documents conversations part".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, DIR)
    rel = db.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def library(spark, files):
    rows = [(i, f"/lib/{n}", n, n.rsplit(".", 1)[-1], float(i if len(x) < 3 else x[2]), f"sha256:{i}" if len(x) < 4 else x[3]) for i, (n, *x) in enumerate(((f[0], *f) for f in files))]
    f = spark.createDataFrame([(i, p, n, e, 1e9 + k, h) for i, (_, p, n, e, k, h) in enumerate(rows)], "file_id long, path string, name string, ext string, mtime double, content_hash string")
    pages = [(i, k + 1, t, T.normalize_text(t)) for i, x in enumerate(files) for k, t in enumerate(x[1])]
    return spark.createDataFrame(pages, "file_id long, page_no long, raw_text string, norm string"), f


def found(spark, files, text, **kw):
    p, f = library(spark, files)
    return S.search(p, f, text, **kw).orderBy("pos").collect()


def test_locates_the_page_and_marks_the_hit(spark):
    r = found(spark, [("a.pptx", ["无关", "昇腾"])], "昇腾")
    assert [(x.name, x.best_page) for x in r] == [("a.pptx", 2)] and "【昇腾】" in r[0].snippet


def test_all_words_on_the_same_page(spark):
    files = [("both.pptx", ["算力 与 昇腾"]), ("only.pptx", ["算力", "昇腾"])]
    assert [x.name for x in found(spark, files, "算力 昇腾")] == ["both.pptx"]


def test_a_phrase_is_adjacent(spark):
    files = [("yes.pptx", ["建设算力集群中心"]), ("no.pptx", ["算力与集群"])]
    assert [x.name for x in found(spark, files, '"算力集群"')] == ["yes.pptx"]


def test_phrase_before_compact_before_partial(spark):
    files = [("split.pptx", ["SP and AI apart"]), ("punctuation.pptx", ["the AI-SP plan"]), ("phrase.pptx", ["the AI SP plan"])]
    assert [(x.name, x.match_kind) for x in found(spark, files, "AI SP")] == [("phrase.pptx", "content_phrase"), ("punctuation.pptx", "content_exact"), ("split.pptx", "partial")]


def test_names_come_before_contents(spark):
    files = [("other.pptx", ["AI SP here"]), ("AI-SP.pptx", ["nothing"])]
    assert [(x.name, x.match_kind) for x in found(spark, files, "AI SP")] == [("AI-SP.pptx", "filename_exact"), ("other.pptx", "content_phrase")]


def test_kinds_of_accented_names_and_mixed_queries(spark):
    kinds = lambda files, q: [(x.name, x.match_kind) for x in found(spark, files, q)]
    assert kinds([("résumé.pptx", ["nothing"])], "résumé") == [("résumé.pptx", "filename_exact")]
    page = [("a.pptx", ["the AI SP plan"])]
    assert kinds(page, '"AI SP"') == [("a.pptx", "content_phrase")]
    assert kinds(page, '"AI" SP') == [("a.pptx", "content_exact")]
    assert kinds(page, 'SP "AI"') == [("a.pptx", "partial")]


def test_a_query_may_name_the_file_with_its_extension(spark):
    assert [x.score for x in found(spark, [("deck.pptx", ["nothing"])], "deck.pptx")] == [2.25]


def test_newer_first_and_literal_wildcards(spark):
    files = [("old.pptx", ["same words"]), ("new.pptx", ["same words"])]
    assert [x.name for x in found(spark, files, "same words")] == ["new.pptx", "old.pptx"]
    for q in ("%", "_", '"', "foo*(", "a_", ""):
        assert found(spark, files, q) == []


def test_filters_stand_before_the_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "CANDIDATES", 2)
    files = [(f"x{i}.pptx", ["common"]) for i in range(6)] + [("y.pdf", ["common"])]
    assert [x.name for x in found(spark, files, "common", exts=["PDF"])] == ["y.pdf"]


def test_every_name_hit_is_returned(spark, tmp_path):
    """More names match than a search takes as candidates."""
    spark.range(40_000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ids = sorted(r.file_id for r in registry.QUERIES["name_hits"](spark, str(tmp_path)).collect())
    assert len(ids) > S.CANDIDATES and ids == sorted(r[0] for r in c.sql(registry.ORACLE_SQL["name_hits"]).fetchall())


def test_normalisation(spark):
    df = spark.createDataFrame([("ＡＢＣ ﬁn Straße 昇腾",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_full("t")).collect()] == ["abc fin strasse 昇腾", None]
    assert [r[0] for r in df.select(T.normalize(F.concat(F.col("t"), F.lit("　１")))).collect()] == ["abc ﬁn strasse 昇腾 1", None]
    assert df.select(T.index_tokens(F.lit("ai spark 昇"))).first()[0] == ["ai", "spark", "昇", "spa", "par", "ark"]
    assert T.parse_query("“a b” c \"d") == T.Query(["c", "d"], ["a b"])
    r = df.select(T.contains_phrase(F.lit("ai spark"), "AI SP"), T.contains_compact(F.lit("x ai--sp y"), "AI SP"), T.human_bytes(F.lit(1536)), T.human_bytes(F.lit(5))).first()
    assert tuple(r) == (False, True, "1.5 KB", "5 B")


def test_retention_keeps_branch_bases_outside_the_count(spark):
    from corpusql.operators.version_queries import retained

    rows = [(i, 2, 1000.0 * i, "ok" if i != 7 else "invalid") for i in range(1, 201)] + [(1000 + i, 3, 1000.0 * i, "ok") for i in range(1, 31)]
    v = spark.createDataFrame(rows, "version_id long, doc_id long, ts double, health string")
    at = lambda keep: {(r.doc_id, r.version_id): (r.place, r.exempt) for r in retained(v, keep).collect()}
    out = at(100)
    assert out[2, 20] == (None, "branch base") and out[2, 7] == (None, "quarantined")
    assert sum(d == 2 and e is None for (d, _), (_, e) in out.items()) == 100 and (2, 101) in out and (2, 19) not in out
    assert sum(d == 3 for d, _ in out) == 30 and len(at(0)) == len(rows)
    assert sum(d == 3 for d, _ in at(20)) == 20 and at(20)[2, 20] == (None, "branch base")


def test_titles_of_every_file(spark):
    got = registry.QUERIES["page_titles_by_file"](spark, DIR).collect()
    one = sorted((r.page_no, r.title) for r in registry.QUERIES["page_titles"](spark, DIR).collect())
    assert len({r.file_id for r in got}) > 1 and sorted((r.page_no, r.title) for r in got if r.file_id == 8) == one


def test_lists_of_results(spark):
    from corpusql.operators import result_queries as R

    rows = [(1, 10, "b.pptx", 5.0, "x"), (2, 11, "A.pptx", 9.0, None), (3, 12, "a.pptx", 9.0, "x"), (4, 13, None, None, None)]
    r = spark.createDataFrame(rows, "pos long, file_id long, name string, mtime double, g string")
    order = lambda *keys, **kw: [x.file_id for x in R.sorted_results(r, *keys, **kw).orderBy("place").collect()]
    assert order() == order("size") == order("relevance", "relevance") == [10, 11, 12, 13]
    assert order(group="g") == [10, 12, 11, 13] and order("recent", group="g") == [11, 12, 10, 13]
    assert order("name") == [13, 11, 12, 10] and order("recent", "name") == [11, 12, 10, 13]
    assert R.sorted_results(r.where("false"), "name").count() == R.by_time(r.where("false")).count() == 0
    hits = spark.createDataFrame([(1, True, 0), (2, False, 3), (3, True, 1)], "file_id long, name_hit boolean, n_hits long")
    assert [[x.file_id for x in R.of_mode(hits, m).orderBy("file_id").collect()] for m in ("filename", "content", "all", "?")] == [[1, 3], [2, 3], [1, 2, 3], [1, 2, 3]]
    f = spark.createDataFrame([("top.pptx", "PPTX", 0.0, None), ("/a/b/c.ppt", "ppt", 0.0, 11), ("/a/b/d.pptx", "pptx", 0.0, 31)], "path string, ext string, mtime double, page_count long")
    some = lambda **kw: sorted(x.path for x in R.of_facets(f, **kw).collect())
    assert some() == some(time=["更早"], folder=[]) == ["/a/b/c.ppt", "/a/b/d.pptx", "top.pptx"]
    assert some(folder=["b"], pages=["30+", "1-10"]) == ["/a/b/d.pptx"] and some(folder=["top.pptx"], type=["pptx"], pages=["1-10"]) == ["top.pptx"]
    t = spark.createDataFrame([(1, 1672531199.0), (2, 1672531200.0), (3, 1704067199.5), (4, 1704067200.0), (5, None)], "i long, mtime double")
    when = lambda **kw: [x.i for x in R.in_window(t, **kw).orderBy("i").collect()]
    assert when(year=2023) == [2, 3] and when(since=1672531200, until=1704067200) == [2, 3] and when() == [1, 2, 3, 4, 5] and when(until=1672531200) == [1]
