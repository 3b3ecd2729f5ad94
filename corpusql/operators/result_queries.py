"""Tools on a list of results: mode and facet filters, time window, sort modes, groups of time; with their SQL.

Filters are row by row and take lists of any size; order and groups are for what a search returns, at most
``RESULTS`` rows (pos: their place by relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql import adapters as A
from corpusql.adapters import FILES_CTE as FC
from corpusql.adapters import PAGES_CTE as PC
from corpusql.functions import text as T
from corpusql.operators.stats_queries import facet_columns
from corpusql.plans.search import RESULTS

Q: dict = {}
S: dict = {}
#: The sort modes that a list knows.
SORTS = ("relevance", "recent", "name")


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = sql
        return f

    return add


def of_mode(results: DataFrame, mode: str = "all") -> DataFrame:
    """Of results(name_hit, n_hits) those whose name matched (filename) or that have hits on pages (content); else all."""
    return results.where({"filename": "name_hit", "content": "n_hits > 0"}.get(mode, "true"))


def of_facets(results: DataFrame, **asked: list[str]) -> DataFrame:
    """Of results(path, ext, mtime, page_count) those with one of the values asked for in each facet; none asked for: any.

    Facets: time, type, pages, folder. An unknown one is an error."""
    cols = facet_columns()
    for facet, values in asked.items():
        if values:
            results = results.where(cols[facet].isin(list(values)))
    return results


def in_window(files: DataFrame, year: int | None = None, since: float | None = None, until: float | None = None) -> DataFrame:
    """files(mtime) of a year of the session's time zone and from ``since`` up to, without, ``until``; null times are in none."""
    if year is not None:
        first = [F.unix_timestamp(F.lit(f"{y:04d}-01-01 00:00:00")) for y in (year, year + 1)]
        files = files.where((F.col("mtime") >= first[0]) & (F.col("mtime") < first[1]))
    if since is not None:
        files = files.where(F.col("mtime") >= float(since))
    return files if until is None else files.where(F.col("mtime") < float(until))


def sorted_results(results: DataFrame, *keys: str, group: str | None = None) -> DataFrame:
    """results(pos, mtime, name, ...) with ``place`` by the sort modes in turn, then newer first, by name, by pos.

    Unknown and repeated modes are left out, none left means relevance. Under relevance first, members of a ``group``
    (a column, null: alone) follow the first of them."""
    modes = [k for k in dict.fromkeys(keys) if k in SORTS] or ["relevance"]
    newest, name = F.coalesce("mtime", F.lit(0.0)).desc(), F.lower(F.coalesce("name", F.lit("")))
    by = {"relevance": F.col("pos"), "recent": newest, "name": name}
    out = results.withColumn("place", F.row_number().over(W.orderBy(*(by[k] for k in modes), newest, name, "pos")).cast("long"))
    if group and modes[0] == "relevance":
        first = F.when(F.col(group).isNull(), F.col("place")).otherwise(F.min("place").over(W.partitionBy(group)))
        out = out.withColumn("place", F.row_number().over(W.orderBy(first, "place")).cast("long"))
    return out


def by_time(results: DataFrame) -> DataFrame:
    """label, place, n: the groups of time in results(pos, mtime), as they are met."""
    g = results.groupBy(facet_columns()["time"].alias("label")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return g.select("label", F.row_number().over(W.orderBy("first")).cast("long").alias("place"), "n")


def _found(spark, d):
    """Every file with what its name and pages hold of a query."""
    p = A.pages(spark, d).where(F.contains("norm", F.lit("that"))).groupBy("file_id").agg(F.count("*").alias("n_hits"))
    f = A.files(spark, d).select("file_id", "path", "name", "ext", "mtime", "page_count", F.contains(T.normalize(F.col("name")), F.lit("report")).alias("name_hit"))
    return f.join(p, "file_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def _listed(spark, d):
    """The list of a search for a name: pos by time."""
    top = A.files(spark, d).select("file_id", "name", "mtime", "content_hash").where(F.contains(T.normalize(F.col("name")), F.lit("report"))).orderBy(F.col("mtime").desc(), "file_id").limit(RESULTS)
    return top.withColumn("pos", F.row_number().over(W.orderBy(F.col("mtime").desc(), "file_id")).cast("long"))


_DAYS = f"floor(({A.NOW} - floor(mtime / 86400) * 86400) / 86400)"
_LABEL = f"CASE WHEN {_DAYS} <= 0 THEN '今天' WHEN {_DAYS} = 1 THEN '昨天' WHEN {_DAYS} < 7 THEN '本周' WHEN {_DAYS} < 30 THEN '本月' ELSE '更早' END"
_FOUND = f"{FC}, {PC}, hits AS (SELECT file_id, count(*) AS n_hits FROM pages_raw WHERE contains(norm, 'that') GROUP BY 1), found AS (SELECT f.*, contains(lower(name), 'report') AS name_hit, coalesce(n_hits, 0) AS n_hits FROM files f LEFT JOIN hits USING (file_id))"
_LIST = f"{FC}, listed AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, file_id) AS pos FROM files WHERE contains(lower(name), 'report') QUALIFY pos <= {RESULTS})"


@query(f"WITH {_FOUND} SELECT 'all' AS mode, file_id FROM found UNION ALL SELECT 'filename', file_id FROM found WHERE name_hit UNION ALL SELECT 'content', file_id FROM found WHERE n_hits > 0")
def results_by_mode(spark, d):
    r = _found(spark, d)
    each = [of_mode(r, m).select(F.lit(m).alias("mode"), "file_id") for m in ("all", "filename", "content")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {_FOUND} SELECT file_id FROM found WHERE n_hits > 0 AND {_LABEL} IN ('本月', '更早') AND ext <> 'pptx' AND page_count <= 30")
def results_of_facets(spark, d):
    return of_facets(of_mode(_found(spark, d), "content"), time=["本月", "更早"], type=["ppt"], pages=["1-10", "10-30"], folder=[]).select("file_id")


@query(f"WITH {FC} SELECT file_id, mtime FROM files WHERE year(ts) = 2023 AND mtime >= 1680000000 AND mtime < 1700000000")
def files_in_window(spark, d):
    return in_window(A.files(spark, d), 2023, 1_680_000_000, 1_700_000_000).select("file_id", "mtime")


@query(f"WITH {_LIST} SELECT file_id, row_number() OVER (ORDER BY lower(name), mtime DESC, pos) AS place FROM listed")
def results_by_name(spark, d):
    return sorted_results(_listed(spark, d), "name", "recent", "name", "size").select("file_id", "place")


@query(f"WITH {_LIST}, g AS (SELECT file_id, pos, min(pos) OVER (PARTITION BY content_hash) AS first FROM listed) SELECT file_id, row_number() OVER (ORDER BY first, pos) AS place FROM g")
def results_grouped(spark, d):
    return sorted_results(_listed(spark, d), group="content_hash").select("file_id", "place")


@query(f"WITH {_LIST}, g AS (SELECT {_LABEL} AS label, min(pos) AS first, count(*) AS n FROM listed GROUP BY 1) SELECT label, row_number() OVER (ORDER BY first) AS place, n FROM g")
def results_by_time(spark, d):
    return by_time(_listed(spark, d))


QUERIES, ORACLE_SQL = Q, S
