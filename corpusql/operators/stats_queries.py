"""Statistics of a library: counts, rhythm, shape, health, groups; each a lazy DataFrame, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql import adapters as A
from corpusql.adapters import FILES_CTE as FC

FLOOR = 315_532_800.0  # 1980: earlier times are unknown
Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def valid(f: DataFrame) -> DataFrame:
    return f.where(F.col("mtime") >= FLOOR)


@query(f"WITH {FC} SELECT status, count(*) AS n, sum(page_count)::BIGINT AS pages FROM files GROUP BY status")
def status_counts(spark, d):
    return A.files(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("page_count").alias("pages"))


@query(f"WITH {FC} SELECT ext, count(*) FILTER (status <> 'pending') AS built, count(*) AS total FROM files GROUP BY ext")
def type_counts(spark, d):
    return A.files(spark, d).groupBy("ext").agg(F.count_if(F.col("status") != "pending").alias("built"), F.count("*").alias("total"))


@query(f"WITH {A.PAGES_CTE} SELECT file_id, sum(length(raw_text))::BIGINT AS chars, count(*) AS pages FROM pages_raw GROUP BY file_id")
def char_counts(spark, d):
    return A.pages(spark, d).groupBy("file_id").agg(F.sum(F.length("raw_text")).alias("chars"), F.count("*").alias("pages"))


@query(f"""WITH {FC}, h AS (SELECT *, hour(ts) AS h FROM files) SELECT count(*) FILTER (h >= 22 OR h < 6) AS night, count(*) FILTER (isodow(ts) >= 6) AS weekend, count(*) AS total,
round_even(count(*) FILTER (h >= 22 OR h < 6) / count(*), 4) AS night_ratio, arg_max(name, struct_pack(k := CASE WHEN h >= 22 OR h < 6 THEN (h + 2) % 24 ELSE -1 END, i := file_id)) AS latest FROM h""")
def night_owl(spark, d):
    f = valid(A.files(spark, d)).withColumn("h", F.hour("ts"))
    night = (F.col("h") >= 22) | (F.col("h") < 6)
    late = F.struct(F.when(night, (F.col("h") + 2) % 24).otherwise(-1).alias("k"), "file_id")
    return f.agg(F.count_if(night).alias("night"), F.count_if(F.weekday("ts") >= 5).alias("weekend"), F.count("*").alias("total"), F.bround(F.count_if(night) / F.count("*"), 4).alias("night_ratio"), F.max_by("name", late).alias("latest"))


@query(f"""WITH {FC}, c AS (SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM files GROUP BY 1, 2)
SELECT w AS weekday, h AS hour, coalesce(n, 0) AS n FROM range(7) a(w), range(24) b(h) LEFT JOIN c ON w = weekday AND h = hour""")
def heatmap_7x24(spark, d):
    f = valid(A.files(spark, d)).groupBy(F.weekday("ts").cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    cells = spark.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return cells.join(F.broadcast(f), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {FC}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM files), i AS (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS island FROM d),
r AS (SELECT count(*) AS n FROM i GROUP BY island), m AS (SELECT strftime(ts, '%Y-%m') AS m, count(*) AS n FROM files GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS active_days, (SELECT max(n) FROM r) AS streak, (SELECT m FROM m ORDER BY n DESC, m DESC LIMIT 1) AS peak_month""")
def activity_streak(spark, d):
    f = valid(A.files(spark, d))
    # days, not files, meet in the window
    days = f.select(F.to_date("ts").alias("d")).distinct()
    islands = days.select(F.date_sub("d", F.row_number().over(W.orderBy("d"))).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    months = f.groupBy(F.date_format("ts", "yyyy-MM").alias("m")).agg(F.count("*").alias("n")).agg(F.max_by("m", F.struct("n", "m")).alias("peak_month"))
    return islands.agg(F.sum("n").alias("active_days"), F.max("n").alias("streak")).crossJoin(F.broadcast(months))


@query(f"""WITH {FC} SELECT arg_max(name, struct_pack(a := page_count, b := file_id)) AS longest, arg_max(name, struct_pack(a := size, b := file_id)) AS biggest, sum(page_count)::BIGINT AS pages, sum(size)::BIGINT AS bytes, count(*) AS files FROM files""")
def scale(spark, d):
    top = lambda c: F.max_by("name", F.struct(c, "file_id"))
    return A.files(spark, d).agg(top("page_count").alias("longest"), top("size").alias("biggest"), F.sum("page_count").alias("pages"), F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query(f"""WITH {FC}, b AS (SELECT CASE WHEN page_count = 0 THEN '0' WHEN page_count = 1 THEN '1' WHEN page_count <= 5 THEN '2-5' WHEN page_count <= 15 THEN '6-15' WHEN page_count <= 30 THEN '16-30' WHEN page_count <= 50 THEN '31-50' ELSE '50+' END AS bin FROM files) SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def shape_bins(spark, d):
    p, out = F.col("page_count"), F.lit("50+")
    for top, name in [(50, "31-50"), (30, "16-30"), (15, "6-15"), (5, "2-5"), (1, "1"), (0, "0")]:
        out = F.when(p <= top, name).otherwise(out)
    return A.files(spark, d).groupBy(out.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {FC}, n AS (SELECT year(ts) AS y, quarter(ts) AS q, count(*) AS n FROM files GROUP BY 1, 2) SELECT a.y AS year, a.k AS quarter, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT y, k FROM n, range(1, 5) r(k)) a LEFT JOIN n ON n.y = a.y AND n.q = a.k""")
def seasons(spark, d):
    n = valid(A.files(spark, d)).groupBy(F.year("ts").cast("long").alias("year"), F.quarter("ts").cast("long").alias("quarter")).agg(F.count("*").alias("n"))
    every = n.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("quarter"))
    return every.join(n, ["year", "quarter"], "left").select("year", "quarter", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {FC} SELECT lower(name) AS name, count(*) AS n FROM files GROUP BY 1 HAVING count(*) > 1")
def twins(spark, d):
    return A.files(spark, d).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {FC} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, folder LIMIT 8")
def top_folders(spark, d):
    return A.files(spark, d).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "folder").limit(8)


def facet_columns() -> dict:
    """time, type, pages and folder of files(path, ext, mtime, page_count); a path without a folder is its own."""
    days = F.floor((F.lit(A.NOW) - F.floor(F.col("mtime") / A.DAY) * A.DAY) / A.DAY)
    folder = F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    return {
        "time": F.when(days <= 0, "今天").when(days == 1, "昨天").when(days < 7, "本周").when(days < 30, "本月").otherwise("更早"),
        "type": F.when(F.lower("ext") == "pptx", "pptx").otherwise("ppt"),
        "pages": F.when(F.coalesce("page_count", F.lit(0)) <= 10, "1-10").when(F.col("page_count") <= 30, "10-30").otherwise("30+"),
        "folder": F.when(folder == "", F.col("path")).otherwise(folder),
    }


@query(f"""WITH {FC}, a AS (SELECT *, floor(({A.NOW} - floor(mtime / 86400) * 86400) / 86400) AS d, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder FROM files),
t AS (SELECT CASE WHEN d <= 0 THEN '今天' WHEN d = 1 THEN '昨天' WHEN d < 7 THEN '本周' WHEN d < 30 THEN '本月' ELSE '更早' END AS time, CASE WHEN ext = 'pptx' THEN 'pptx' ELSE 'ppt' END AS type, CASE WHEN page_count <= 10 THEN '1-10' WHEN page_count <= 30 THEN '10-30' ELSE '30+' END AS pages, folder FROM a)
SELECT 'time' AS facet, time AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'pages', pages, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'folder', folder, count(*) FROM t GROUP BY 2""")
def facet_counts(spark, d):
    t = A.files(spark, d).select(*(c.alias(name) for name, c in facet_columns().items()))
    # one pass over the files: grouping sets of the four dimensions
    g = t.groupingSets([["time"], ["type"], ["pages"], ["folder"]], "time", "type", "pages", "folder").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    facet = F.element_at(F.create_map(*(F.lit(x) for kv in {7: "time", 11: "type", 13: "pages", 14: "folder"}.items() for x in kv)), F.col("g").cast("int"))
    return g.select(facet.alias("facet"), F.coalesce("time", "type", "pages", "folder").alias("value"), "n")



@query(f"""WITH {FC} SELECT content_hash, count(*) AS n, arg_max(path, struct_pack(a := regexp_matches(name, '(?i)最终|final|终版|定稿|修订|修改|最新版|v\\d+'), b := mtime, c := path)) AS keep, (max(size) * (count(*) - 1))::BIGINT AS reclaimable FROM files GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    final = F.col("name").rlike(r"(?i)最终|final|终版|定稿|修订|修改|最新版|v\d+")
    g = A.files(spark, d).groupBy("content_hash").agg(F.count("*").alias("n"), F.max_by("path", F.struct(final, "mtime", "path")).alias("keep"), F.max("size").alias("s"))
    return g.where("n > 1").select("content_hash", "n", "keep", (F.col("s") * (F.col("n") - 1)).alias("reclaimable"))


@query(f"""WITH {FC}, x AS (SELECT count(*) AS files, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER ({A.NOW} - mtime > 365 * 86400) AS zombies, count(*) FILTER (regexp_matches(name, '(?i)final|v\\d+')) AS curse FROM files),
y AS (SELECT sum(n - 1)::BIGINT AS dup FROM (SELECT count(*) AS n FROM files GROUP BY content_hash))
SELECT files, failed, zombies, curse, dup, greatest(0, round_even(100 - least(35, 60 * dup / files) - least(22, 55 * failed / files) - least(18, 22 * zombies / files) - least(12, 18 * curse / files), 0))::BIGINT AS score FROM x, y""")
def health_report(spark, d):
    f = A.files(spark, d)
    counted = f.groupBy("content_hash").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.lit(A.NOW) - F.col("mtime") > 365 * A.DAY).alias("zombies"), F.count_if(F.col("name").rlike(r"(?i)final|v\d+")).alias("curse")
    )
    t = counted.agg(F.sum("n").alias("files"), F.sum("failed").alias("failed"), F.sum("zombies").alias("zombies"), F.sum("curse").alias("curse"), F.sum(F.col("n") - 1).alias("dup"))
    part = lambda top, w, c: F.least(F.lit(float(top)), w * F.col(c) / F.col("files"))
    score = F.greatest(F.lit(0), F.bround(100 - part(35, 60, "dup") - part(22, 55, "failed") - part(18, 22, "zombies") - part(12, 18, "curse"), 0))
    return t.select("files", "failed", "zombies", "curse", "dup", score.cast("long").alias("score"))


@query(f"""WITH {A.PAGES_CTE}, {FC}, o AS (SELECT p.file_id, page_no, least(length(raw_text), 1500) AS len, row_number() OVER (ORDER BY mtime DESC, p.file_id, page_no) AS rn FROM pages_raw p JOIN files f USING (file_id)),
c AS (SELECT *, sum(len) OVER (ORDER BY rn) AS cum FROM o WHERE rn <= 2500) SELECT file_id, page_no, len FROM c WHERE cum <= 400000 OR rn = 1""")
def content_budget_prefix(spark, d):
    f = A.files(spark, d).select("file_id", "mtime")
    p = A.pages(spark, d).select("file_id", "page_no", F.least(F.length("raw_text"), F.lit(1500)).cast("long").alias("len")).join(f, "file_id")
    order = [F.col("mtime").desc(), F.col("file_id"), F.col("page_no")]
    w = W.orderBy(*order)  # over at most 2,500 rows: the limit is the feature
    top = p.orderBy(*order).limit(2500).withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return top.where("cum <= 400000 or rn = 1").select("file_id", "page_no", "len")


@query(f"""WITH {FC}, t AS (SELECT strftime(ts, '%Y-%m') AS month, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]{{5,}}')) AS term FROM files), c AS (SELECT month, term, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, term) AS k FROM c WHERE month IN (SELECT DISTINCT month FROM c ORDER BY month DESC LIMIT 8)) SELECT month, term, n FROM r WHERE k <= 3""")
def keyword_trends(spark, d):
    f = A.files(spark, d).select(F.date_format("ts", "yyyy-MM").alias("month"), "text")
    last = f.select("month").distinct().orderBy(F.col("month").desc()).limit(8)
    t = f.join(F.broadcast(last), "month").select("month", F.explode(F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))
    c = t.groupBy("month", "term").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("month").orderBy(F.col("n").desc(), "term"))).where("k <= 3").select("month", "term", "n")


@query(f"""WITH {FC}, r AS (SELECT name, regexp_replace(path, '/[^/]*$', '') AS folder FROM files ORDER BY mtime DESC, file_id LIMIT 400), c AS (SELECT folder, count(*) AS n FROM r GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, folder) AS k, count(*) OVER () AS m FROM c) SELECT CASE WHEN m <= 5 OR k <= 4 THEN folder ELSE '其他' END AS folder, sum(n)::BIGINT AS n FROM k GROUP BY 1""")
def dashboard_folders(spark, d):
    c = A.files(spark, d).orderBy(F.col("mtime").desc(), "file_id").limit(400).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n"))
    k = c.withColumn("k", F.row_number().over(W.orderBy(F.col("n").desc(), "folder"))).withColumn("m", F.count("*").over(W.partitionBy()))
    return k.groupBy(F.when((F.col("m") <= 5) | (F.col("k") <= 4), F.col("folder")).otherwise("其他").alias("folder")).agg(F.sum("n").alias("n"))


@query(f"WITH {FC} SELECT file_id, path FROM files ORDER BY (file_id <= 500), file_id LIMIT 50")
def round_robin_batch(spark, d):
    return A.files(spark, d).select("file_id", "path").orderBy(F.col("file_id") <= 500, "file_id").limit(50)


@query("SELECT user_id, quantile_disc(value, 0.95) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 64 GROUP BY 1")
def latency_p95(spark, d):
    e = A.read(spark, d, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("k <= 64")
    return e.groupBy("user_id").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


QUERIES, ORACLE_SQL = Q, S
