"""The report of a library: drama, shape, persona, extremes, wording, version insights; with their SQL.

Ties that the order of a scan would settle are settled by the smaller key, as a table has no order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql import adapters as A
from corpusql.adapters import DOCS_CTE as DC
from corpusql.adapters import FILES_CTE as FC
from corpusql.adapters import PAGES_CTE as PC
from corpusql.adapters import PATHS_CTE as HC
from corpusql.adapters import VERSIONS_CTE as VC
from corpusql.operators.stats_queries import valid
from corpusql.operators.version_queries import BRANCHES, branches, by_doc

Q: dict = {}
S: dict = {}

# Names that mean a final version; names that mean nothing; words that aren't terms; thresholds and titles of personas; badges.
FINAL = r"(?i)最终|final|终版|定稿|修订|修改|最新版|v\d+"
GENERIC = r"(?i)^(演示文稿|presentation|新建(演示文稿)?|未命名|untitled|ppt)[ _-]*\d*$"
STOP = "一个 一些 以及 我们 你们 他们 这个 那个 这些 那些 进行 通过 可以 需要 相关 项目 方案 汇报 工作 内容 ppt pptx final 终版 最终版 版本 页面 谢谢 the and for with from this that are was of to in a".split()
TERM = r"[A-Za-z][A-Za-z0-9+._-]{1,20}|[一-鿿]{2,}"
STYLES = {"下划线派": "_", "横杠派": "-", "括号派": r"[()（）\[\]【】]", "版本号派": r"(?i)(?:^|[^a-z])v\d+|版本\d+", "空格派": r"\s+"}
ROLES = {
    ("夜猫子", "高产型"): "夜间作战参谋", ("夜猫子", "字海型"): "深夜笔杆子", ("夜猫子", "囤积型"): "午夜仓库管理员", ("夜猫子", "精修型"): "挑灯夜战的工匠",
    ("周末战士", "高产型"): "周末加班发动机", ("周末战士", "囤积型"): "周末囤货狂", ("周末战士", "精修型"): "周末细节控",
    ("正常作息", "高产型"): "高效流水线", ("正常作息", "字海型"): "正经码字机", ("正常作息", "囤积型"): "稳健仓鼠", ("正常作息", "精修型"): "细节控匠人",
}
#: The last year's day that stands for today, so that results don't change from day to day.
TODAY = "2026-01-01"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def groups(f: DataFrame) -> DataFrame:
    """group_id, n, newest of files that are versions of one another: here those of equal contents; two members at least."""
    g = f.groupBy("content_hash").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n"), F.max_by("name", F.struct("mtime", "file_id")).alias("newest"))
    return g.where("n > 1")


_GROUPS = "groups AS (SELECT min(file_id) AS group_id, count(*) AS n, arg_max(name, struct_pack(a := mtime, b := file_id)) AS newest FROM files GROUP BY content_hash HAVING count(*) > 1)"


def _drama(f: DataFrame) -> DataFrame:
    top = groups(f).agg(F.max_by(F.struct("newest", "n"), F.struct(F.col("n"), -F.col("group_id"))).alias("g"))
    counted = f.agg(F.count("*").alias("n"), F.count_if(F.col("name").rlike(FINAL)).alias("curse"), F.min_by(F.struct("name", "mtime"), F.struct(F.when(F.col("mtime") >= 315_532_800, F.col("mtime")).alias("m"), "file_id")).alias("z"))
    return counted.crossJoin(top).select(F.col("g.newest").alias("top_name"), F.coalesce("g.n", F.lit(0)).cast("long").alias("top_versions"), "curse", F.bround(F.col("curse") / F.col("n"), 6).alias("curse_ratio"), F.col("z.name").alias("zombie"))


@query(f"""WITH {FC}, {_GROUPS}, t AS (SELECT newest, n FROM groups ORDER BY n DESC, group_id LIMIT 1)
SELECT (SELECT newest FROM t) AS top_name, coalesce((SELECT n FROM t), 0) AS top_versions, count(*) FILTER (regexp_matches(name, '{FINAL}')) AS curse,
round_even(count(*) FILTER (regexp_matches(name, '{FINAL}')) / count(*), 6) AS curse_ratio, arg_min(name, struct_pack(a := mtime, b := file_id)) AS zombie FROM files""")
def version_drama(spark, d):
    return _drama(A.files(spark, d))


def _dna(f: DataFrame) -> DataFrame:
    fam = groups(f).agg(F.count("*").alias("families"), F.coalesce(F.sum("n"), F.lit(0)).alias("family_files"))
    p = F.col("page_count")
    t = f.agg(F.count("*").alias("files"), F.sum(p).alias("pages"), F.sum(F.length("text")).alias("chars"), F.count_if((p > 0) & (p <= 5)).alias("brief"), F.count_if(p >= 50).alias("epic"), F.count_if(F.col("status") == "ok").alias("ready"))
    ratio = lambda a, b: F.bround(F.col(a) / F.col(b), 6)
    return t.crossJoin(fam).select("files", ratio("pages", "files").alias("avg_pages"), ratio("chars", "pages").alias("avg_chars"), "brief", "epic", "families", "family_files", ratio("family_files", "files").alias("family_ratio"), "ready", ratio("ready", "files").alias("ready_ratio"))


@query(f"""WITH {FC}, {_GROUPS}, g AS (SELECT count(*) AS families, coalesce(sum(n), 0)::BIGINT AS family_files FROM groups),
t AS (SELECT count(*) AS files, sum(page_count) AS pages, sum(length(text)) AS chars, count(*) FILTER (page_count BETWEEN 1 AND 5) AS brief, count(*) FILTER (page_count >= 50) AS epic, count(*) FILTER (status = 'ok') AS ready FROM files)
SELECT files, round_even(pages / files, 6) AS avg_pages, round_even(chars / pages, 6) AS avg_chars, brief, epic, families, family_files, round_even(family_files / files, 6) AS family_ratio, ready, round_even(ready / files, 6) AS ready_ratio FROM t, g""")
def library_dna(spark, d):
    return _dna(A.files(spark, d))


def _persona(f: DataFrame) -> DataFrame:
    h, dated = F.hour("ts"), F.col("mtime") >= 315_532_800
    t = f.agg(
        (F.count_if(dated & ((h >= 22) | (h < 6))) / F.count_if(dated)).alias("night"), (F.count_if(dated & (F.weekday("ts") >= 5)) / F.count_if(dated)).alias("weekend"),
        F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"),
    ).crossJoin(_drama(f))
    avg = F.col("chars") / F.col("files")
    tags = [("深夜画师", F.col("night") >= 0.3), ("周末战士", F.col("weekend") >= 0.3), ("终版收割机", F.col("curse_ratio") >= 0.4), ("改版狂魔", F.col("top_versions") >= 10), ("字海狂魔", F.col("chars") >= 500_000), ("仓鼠囤积者", F.col("files") >= 200), ("极简主义者", avg < 200)]
    hits = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tags)))
    rhythm = F.when(F.col("night") >= 0.3, "夜猫子").when(F.col("weekend") >= 0.3, "周末战士").otherwise("正常作息")
    output = F.when(F.col("files") >= 200, "囤积型").when(avg >= 800, "字海型").when(F.col("files") >= 50, "高产型").otherwise("精修型")
    roles = F.create_map(*(F.lit(x) for (a, b), r in ROLES.items() for x in (a + b, r)))
    title = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))).otherwise("佛系做图人")
    return t.select(title.alias("title"), F.array_join(F.slice(hits, 2, 7), "|").alias("badges"), rhythm.alias("rhythm"), output.alias("output"), F.coalesce(F.try_element_at(roles, F.concat(rhythm, output)), F.lit("全能型选手")).alias("role"))


@query(f"""WITH {FC}, {_GROUPS}, t AS (SELECT count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) / count(*) AS night, count(*) FILTER (isodow(ts) >= 6) / count(*) AS weekend, count(*) FILTER (regexp_matches(name, '{FINAL}')) / count(*) AS curse,
coalesce((SELECT max(n) FROM groups), 0) AS top, sum(length(text)) AS chars, count(*) AS files FROM files),
h AS (SELECT *, list_filter([CASE WHEN night >= 0.3 THEN '深夜画师' END, CASE WHEN weekend >= 0.3 THEN '周末战士' END, CASE WHEN curse >= 0.4 THEN '终版收割机' END, CASE WHEN top >= 10 THEN '改版狂魔' END, CASE WHEN chars >= 500000 THEN '字海狂魔' END, CASE WHEN files >= 200 THEN '仓鼠囤积者' END, CASE WHEN chars / files < 200 THEN '极简主义者' END], lambda x: x IS NOT NULL) AS tags,
CASE WHEN night >= 0.3 THEN '夜猫子' WHEN weekend >= 0.3 THEN '周末战士' ELSE '正常作息' END AS rhythm, CASE WHEN files >= 200 THEN '囤积型' WHEN chars / files >= 800 THEN '字海型' WHEN files >= 50 THEN '高产型' ELSE '精修型' END AS output FROM t)
SELECT coalesce(tags[1], '佛系做图人') AS title, array_to_string(tags[2:], '|') AS badges, rhythm, output, coalesce(r, '全能型选手') AS role FROM h LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}', '{r}')" for (a, b), r in ROLES.items())}) v(a, b, r) ON a = rhythm AND b = output""")
def persona(spark, d):
    return _persona(A.files(spark, d))


def _stem(name) -> F.Column:
    return F.trim(F.regexp_replace(name, r"\.[^.]*$", ""))


@query(f"""WITH {FC}, s AS (SELECT *, trim(regexp_replace(name, '\\.[^.]*$', '')) AS stem, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, strftime(ts, '%Y-%m-%d') AS day FROM files),
b AS (SELECT day, count(*) AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1), c AS (SELECT page_count, count(*) AS n FROM s WHERE page_count > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT arg_max(name, struct_pack(a := length(stem), b := name)) AS longest_filename, arg_min(name, struct_pack(a := length(stem), b := name)) AS shortest_filename, arg_min(name, struct_pack(a := mtime, b := name)) AS oldest, arg_max(name, struct_pack(a := mtime, b := name)) AS newest,
arg_max(name, struct_pack(a := page_count, b := name)) AS most_pages, arg_max(name, struct_pack(a := size, b := name)) AS largest, arg_max(name, struct_pack(a := depth, b := name)) AS deepest, (SELECT day FROM b) AS busiest_day, (SELECT n FROM b) AS busiest_n, (SELECT page_count FROM c) AS common_pages, (SELECT n FROM c) AS common_n FROM s""")
def hall_of_fame(spark, d):
    f = A.files(spark, d).withColumn("stem", _stem("name")).withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")))
    real = F.when(F.col("mtime") >= 315_532_800, F.col("mtime"))
    top = lambda c: F.max_by("name", F.struct(c, "name"))
    low = lambda c: F.min_by("name", F.when(c.isNotNull(), F.struct(c.alias("k"), "name")))
    one = f.agg(top(F.length("stem").alias("k")).alias("longest_filename"), low(F.length("stem")).alias("shortest_filename"), low(real).alias("oldest"), top(real.alias("k")).alias("newest"), top("page_count").alias("most_pages"), top("size").alias("largest"), top("depth").alias("deepest"))
    day = valid(f).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("x")).select(F.col("x.d").alias("busiest_day"), F.col("x.count").alias("busiest_n"))
    common = f.where("page_count > 0").groupBy("page_count").count().agg(F.max(F.struct(F.col("count"), (-F.col("page_count")).alias("p"))).alias("x")).select((-F.col("x.p")).alias("common_pages"), F.col("x.count").alias("common_n"))
    return one.crossJoin(day).crossJoin(common)  # one row each


@query(f"""WITH {FC} SELECT file_id, name, 2026 - year(ts) AS years, strftime(ts, '%Y-%m-%d') AS day FROM files WHERE month(ts) = 1 AND day(ts) = 1 AND year(ts) < 2026 ORDER BY mtime DESC, file_id LIMIT 5""")
def anniversaries(spark, d):
    now = F.lit(TODAY).cast("date")
    f = valid(A.files(spark, d)).where((F.month("ts") == F.month(now)) & (F.dayofmonth("ts") == F.dayofmonth(now)) & (F.year("ts") < F.year(now)))
    return f.orderBy(F.col("mtime").desc(), "file_id").limit(5).select("file_id", "name", (F.year(now) - F.year("ts")).cast("long").alias("years"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {FC}, k AS (SELECT 'month' AS kind, strftime(ts, '%Y-%m') AS key FROM files UNION ALL SELECT 'year', strftime(ts, '%Y') FROM files UNION ALL SELECT 'season', concat('Q', quarter(ts)) FROM files), c AS (SELECT kind, key, count(*) AS n FROM k GROUP BY ALL)
SELECT coalesce(c.kind, 'season') AS kind, coalesce(c.key, q.q) AS key, coalesce(n, 0) AS n FROM c FULL JOIN (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) q(q) ON c.kind = 'season' AND c.key = q.q""")
def creation_counts(spark, d):
    t = valid(A.files(spark, d)).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("month", F.date_format("ts", "yyyy-MM")), ("year", F.date_format("ts", "yyyy")), ("season", F.concat(F.lit("Q"), F.quarter("ts"))))))).alias("x"))
    c = t.groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))
    every = spark.range(1, 5).select(F.lit("season").alias("kind"), F.concat(F.lit("Q"), F.col("id")).alias("key"), F.lit(0).cast("long").alias("n"))
    return c.unionByName(every).groupBy("kind", "key").agg(F.sum("n").alias("n"))


@query(f"""WITH {FC}, s AS (SELECT trim(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM files),
p AS (SELECT {', '.join(f"sum(len(regexp_extract_all(stem, '{p}')))::BIGINT AS p{i}" for i, p in enumerate(STYLES.values()))}, count(*) FILTER (regexp_matches(stem, '{GENERIC}')) AS generic FROM s),
l AS (SELECT generic, unnest([{', '.join(f"struct_pack(n := p{i}, label := '{k}')" for i, k in enumerate(STYLES))}]) AS x FROM p)
SELECT any_value(generic) AS generic, max(x.n) AS marks, CASE WHEN max(x.n) > 0 THEN arg_max(x.label, x) ELSE '清爽命名派' END AS style FROM l""")
def naming_style(spark, d):
    s = A.files(spark, d).select(_stem("name").alias("stem"))
    t = s.agg(F.count_if(F.col("stem").rlike(GENERIC)).alias("generic"), *(F.sum(F.regexp_count("stem", F.lit(p))).alias(f"p{i}") for i, p in enumerate(STYLES.values())))
    best = F.array_max(F.array(*(F.struct(F.col(f"p{i}").alias("n"), F.lit(k).alias("label")) for i, k in enumerate(STYLES))))
    return t.select("generic", best["n"].alias("marks"), F.when(best["n"] > 0, best["label"]).otherwise("清爽命名派").alias("style"))


def terms(text) -> F.Column:
    """The terms of a text in order: ASCII words without their outer marks, of two letters or more, and runs of Chinese characters; stop words and numbers aside."""
    found = F.transform(F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(TERM), F.lit(0)), lambda t: F.regexp_replace(t, r"^[._+-]+|[._+-]+$", ""))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOP))


_TERMS = f"list_filter(list_transform(regexp_extract_all(replace(lower(raw_text), 'ß', 'ss'), '{TERM}'), lambda t: regexp_replace(t, '^[._+-]+|[._+-]+$', '', 'g')), lambda t: length(t) >= 2 AND NOT list_contains([{', '.join(repr(s) for s in STOP)}], t))"
_TERMED = f"{PC}, t AS (SELECT file_id, page_no, raw_text, {_TERMS} AS terms FROM pages_raw)"


@query(f"WITH {_TERMED}, u AS (SELECT file_id, unnest(terms) AS term FROM t) SELECT term, count(*) AS tf, count(DISTINCT file_id) AS df FROM u GROUP BY 1 ORDER BY df DESC, term LIMIT 10")
def topics_df(spark, d):
    t = A.pages(spark, d).select("file_id", F.explode(terms(F.col("raw_text"))).alias("term")).groupBy("term", "file_id").agg(F.count("*").alias("n"))
    return t.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.col("df").desc(), "term").limit(10)


@query(f"""WITH {_TERMED}, l AS (SELECT *, max(page_no) OVER (PARTITION BY file_id) AS last FROM t),
o AS (SELECT array_to_string(terms[1:3], ' · ') AS p, count(*) AS n FROM l WHERE page_no = 1 AND len(terms) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
e AS (SELECT array_to_string(terms[-3:], ' · ') AS p, count(*) AS n FROM l WHERE page_no = last AND len(terms) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT (SELECT p FROM o) AS opening, (SELECT n FROM o) AS opening_n, (SELECT p FROM e) AS ending, (SELECT n FROM e) AS ending_n, (SELECT count(*) FROM l WHERE page_no = last AND length(regexp_replace(raw_text, '\\s+', '', 'g')) <= 30) AS low_text_endings""")
def openings_endings(spark, d):
    l = A.pages(spark, d).select("file_id", "page_no", "raw_text", terms(F.col("raw_text")).alias("terms")).withColumn("last", F.max("page_no").over(W.partitionBy("file_id")))  # noqa: E741

    def most(rows: DataFrame, part, name: str) -> DataFrame:
        c = rows.where(F.size("terms") > 0).groupBy(F.array_join(part, " · ").alias("p")).agg(F.count("*").alias("n"))
        return c.orderBy(F.col("n").desc(), "p").limit(1).select(F.col("p").alias(name), F.col("n").alias(f"{name}_n"))

    n = F.size("terms")
    first, last = most(l.where("page_no = 1"), F.slice("terms", 1, 3), "opening"), most(l.where("page_no = last"), F.slice("terms", F.greatest(n - 2, F.lit(1)), F.lit(3)), "ending")
    low = l.where("page_no = last").agg(F.count_if(F.length(F.regexp_replace("raw_text", r"\s+", "")) <= 30).alias("low_text_endings"))
    return low.crossJoin(first).crossJoin(last)  # one row each


@query(f"""WITH {PC}, c AS (SELECT sum(length(regexp_replace(raw_text, '[^A-Za-z]', '', 'g'))) AS letters, sum(length(regexp_replace(raw_text, '[^0-9]', '', 'g'))) AS digits, sum(length(regexp_replace(raw_text, '[^?？]', '', 'g')))::BIGINT AS questions, sum(length(regexp_replace(raw_text, '\\s', '', 'g'))) AS visible, count(*) AS pages FROM pages_raw)
SELECT round_even(letters / visible, 6) AS english, round_even(digits / visible, 6) AS digits, questions, CASE WHEN digits / visible >= 0.12 THEN '数据派' WHEN letters / visible >= 0.22 THEN '国际范' WHEN questions >= greatest(3, pages // 5) THEN '追问型' ELSE '叙事派' END AS persona FROM c""")
def language_persona(spark, d):
    n = lambda p: F.sum(F.length(F.regexp_replace("raw_text", p, "")))
    c = A.pages(spark, d).agg(n("[^A-Za-z]").alias("letters"), n("[^0-9]").alias("figures"), n("[^?？]").alias("questions"), n(r"\s").alias("visible"), F.count("*").alias("pages"))
    english, digits = F.col("letters") / F.col("visible"), F.col("figures") / F.col("visible")
    kind = F.when(digits >= 0.12, "数据派").when(english >= 0.22, "国际范").when(F.col("questions") >= F.greatest(F.lit(3), F.expr("pages div 5")), "追问型").otherwise("叙事派")
    return c.select(F.bround(english, 6).alias("english"), F.bround(digits, 6).alias("digits"), "questions", kind.alias("persona"))


@query(f"""WITH {VC}, {DC}, g AS (SELECT doc_id, count(*) AS n, arg_min(page_count, struct_pack(a := ts, b := version_id)) AS f, arg_max(page_count, struct_pack(a := ts, b := version_id)) AS l FROM versions WHERE health = 'ok' GROUP BY 1)
SELECT sum(n)::BIGINT AS versions, count(*) AS protected, count(*) FILTER (n >= 2) AS rollback, count(*) FILTER (status = 'deleted') AS recoverable, count(*) FILTER (l > f) AS growing, count(*) FILTER (l < f) AS slimming FROM g JOIN docs USING (doc_id)""")
def version_insights(spark, d):
    at = F.struct("ts", "version_id")
    g = A.versions(spark, d).where("health = 'ok'").groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("page_count", at).alias("f"), F.max_by("page_count", at).alias("l")).join(A.managed_docs(spark, d), "doc_id")
    return g.agg(F.sum("n").alias("versions"), F.count("*").alias("protected"), F.count_if(F.col("n") >= 2).alias("rollback"), F.count_if(F.col("status") == "deleted").alias("recoverable"), F.count_if(F.col("l") > F.col("f")).alias("growing"), F.count_if(F.col("l") < F.col("f")).alias("slimming"))


@query(f"""WITH {HC}, c AS (SELECT doc_id, count(DISTINCT lower(regexp_extract(path, '[^/]*$'))) AS names, count(DISTINCT lower(regexp_replace(path, '/[^/]*$', ''))) AS folders FROM paths GROUP BY 1)
SELECT arg_max(doc_id, struct_pack(a := names, b := -doc_id)) AS renamed, max(names) AS renamed_n, arg_max(doc_id, struct_pack(a := folders, b := -doc_id)) AS migrated, max(folders) AS migrated_n FROM c""")
def most_renamed(spark, d):
    c = A.doc_paths(spark, d).groupBy("doc_id").agg(F.count_distinct(F.lower(F.regexp_extract("path", "[^/]*$", 0))).alias("names"), F.count_distinct(F.lower(F.regexp_replace("path", "/[^/]*$", ""))).alias("folders"))
    best = lambda x: F.max_by("doc_id", F.struct(F.col(x), -F.col("doc_id")))
    return c.agg(best("names").alias("renamed"), F.max("names").alias("renamed_n"), best("folders").alias("migrated"), F.max("folders").alias("migrated_n"))


@query(f"""WITH {VC}, {DC}, {BRANCHES}, own AS (SELECT doc_id, count(*) AS n FROM versions WHERE health = 'ok' GROUP BY 1), inh AS (SELECT b.doc_id, count(*) AS n FROM branches b JOIN versions v ON v.doc_id = b.parent AND (v.ts < b.base_ts OR (v.ts = b.base_ts AND v.version_id <= b.base)) AND v.health = 'ok' GROUP BY 1),
e AS (SELECT d.doc_id, d.status, coalesce(o.n, 0) + coalesce(i.n, 0) AS n FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN inh i USING (doc_id)), v AS (SELECT count(*) AS total_versions, count(*) FILTER (health = 'ok') AS healthy_versions, count(*) FILTER (health <> 'ok') AS unhealthy_versions FROM versions)
SELECT count(*) AS managed_docs, count(*) FILTER (status = 'active') AS active_docs, count(*) FILTER (status = 'deleted') AS deleted_docs, any_value(total_versions) AS total_versions, any_value(healthy_versions) AS healthy_versions, count(*) FILTER (n >= 1) AS protected_docs, count(*) FILTER (n >= 2) AS rollback_docs, count(*) FILTER (n = 1) AS single_version_docs, any_value(unhealthy_versions) AS unhealthy_versions FROM e, v""")
def vault_summary(spark, d):
    """The nine figures of the whole vault, inherited versions included."""
    v, ok = A.versions(spark, d), F.col("health") == "ok"
    inherited = branches(v).join(v.where(ok).select(F.col("doc_id").alias("parent"), "version_id", "ts"), "parent").where("ts < base_ts or (ts = base_ts and version_id <= base)")
    own = v.groupBy("doc_id").agg(F.count_if(ok).alias("n"), F.count("*").alias("total"), F.count_if(~ok).alias("bad"))
    more = inherited.groupBy("doc_id").agg(F.count("*").alias("m"))
    e = A.managed_docs(spark, d).join(own, "doc_id", "left").join(more, "doc_id", "left").withColumn("all", F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)))
    return e.agg(
        F.count("*").alias("managed_docs"), F.count_if(F.col("status") == "active").alias("active_docs"), F.count_if(F.col("status") == "deleted").alias("deleted_docs"), F.sum("total").alias("total_versions"), F.sum("n").alias("healthy_versions"),
        F.count_if(F.col("all") >= 1).alias("protected_docs"), F.count_if(F.col("all") >= 2).alias("rollback_docs"), F.count_if(F.col("all") == 1).alias("single_version_docs"), F.sum("bad").alias("unhealthy_versions"),
    )


@query(f"""WITH {VC}, s AS (SELECT *, regexp_extract(changed, '改\\s*(\\d+)\\s*页', 1) AS m, page_count - lag(page_count) OVER w AS dp, size - lag(size) OVER w AS ds FROM versions WINDOW w AS (PARTITION BY doc_id ORDER BY ts, version_id)),
r AS (SELECT doc_id, version_id, ts, CASE WHEN m = '' THEN 0 ELSE CAST(m AS BIGINT) END + coalesce(abs(dp), 0) + least(20, coalesce(abs(ds), 0) // 5242880) AS score FROM s) SELECT doc_id, version_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id, ts, version_id LIMIT 1""")
def biggest_revision(spark, d):
    v = A.versions(spark, d)
    said = F.regexp_extract("changed", r"改\s*(\d+)\s*页", 1)
    delta = lambda c: F.coalesce(F.abs(F.col(c) - F.lag(c).over(by_doc())), F.lit(0))
    score = F.when(said == "", 0).otherwise(said.try_cast("long")) + delta("page_count") + F.least(F.lit(20), F.floor(delta("size") / 5_242_880))
    return v.withColumn("score", score.cast("long")).where("score > 0").orderBy(F.col("score").desc(), "doc_id", "ts", "version_id").limit(1).select("doc_id", "version_id", "score")


@query(f"""WITH {VC}, c AS (SELECT doc_id, count(*) AS n FROM versions GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1) SELECT doc_id, version_id, page_count, size FROM versions JOIN c USING (doc_id) ORDER BY ts DESC, version_id DESC LIMIT 100""")
def growth_points(spark, d):
    """The last 100 versions of the document that has most (of ties the greater id)."""
    v = A.versions(spark, d)
    top = v.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("doc_id").desc()).limit(1).select("doc_id")
    return v.join(F.broadcast(top), "doc_id").orderBy(F.col("ts").desc(), F.col("version_id").desc()).limit(100).select("doc_id", "version_id", "page_count", "size")


@query(f"""WITH {VC}, n AS (SELECT CASE WHEN hour("at") < 6 THEN CAST("at" AS DATE) - 1 ELSE CAST("at" AS DATE) END AS night FROM versions WHERE hour("at") >= 18 OR hour("at") < 6) SELECT strftime(night, '%Y-%m-%d') AS night, count(*) AS n FROM n GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def peak_revision_night(spark, d):
    """Saves from 18 to 6 o'clock; those before 6 are of the night that began the day before."""
    h, day = F.hour("at"), F.to_date("at")
    n = A.versions(spark, d).where((h >= 18) | (h < 6)).groupBy(F.date_format(F.when(h < 6, F.date_sub(day, 1)).otherwise(day), "yyyy-MM-dd").alias("night")).agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), F.col("night").desc()).limit(1)


@query(f"""WITH {VC}, g AS (SELECT isodow("at") - 1 AS weekday, hour("at") AS hour, count(*) AS n FROM versions GROUP BY ALL) SELECT w AS weekday, h AS hour, coalesce(n, 0) AS n FROM range(7) a(w), range(24) b(h) LEFT JOIN g ON weekday = w AND hour = h""")
def save_heatmap(spark, d):
    g = A.versions(spark, d).groupBy(F.weekday("at").cast("long").alias("weekday"), F.hour("at").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    cells = spark.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return cells.join(F.broadcast(g), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {FC}, {PC}, {VC}, {DC}, f AS (SELECT count(*) AS files, sum(page_count) AS pages, count(*) FILTER (regexp_matches(trim(regexp_replace(name, '\\.[^.]*$', '')), '{GENERIC}')) AS generic FROM files), b AS (SELECT max(n) AS busy FROM (SELECT count(*) AS n FROM files GROUP BY CAST(ts AS DATE))),
q AS (SELECT sum(length(regexp_replace(raw_text, '[^?？]', '', 'g'))) AS questions FROM pages_raw), v AS (SELECT count(*) AS versions, count(DISTINCT CASE WHEN status = 'deleted' THEN doc_id END) AS gone FROM versions JOIN docs USING (doc_id) WHERE health = 'ok')
SELECT array_to_string(list_filter(['胶片建档人', CASE WHEN files >= 100 THEN '百片馆长' END, CASE WHEN pages >= 1000 THEN '千页导演' END, CASE WHEN versions >= 10 THEN '时光机常客' END, CASE WHEN gone > 0 THEN '失而复得守护者' END, CASE WHEN questions >= 20 THEN '灵魂提问官' END, CASE WHEN busy >= 10 THEN '一日十片' END, CASE WHEN generic = 0 THEN '命名清醒者' END], lambda x: x IS NOT NULL), '|') AS badges,
concat('片库里有 ', files, ' 份 PPT、', pages, ' 页，时光机留下 ', versions, ' 个可读版本点。') AS line FROM f, b, q, v""")
def achievements(spark, d):
    f, v = A.files(spark, d), A.versions(spark, d).where("health = 'ok'").join(A.managed_docs(spark, d), "doc_id")
    t = f.agg(F.count("*").alias("files"), F.sum("page_count").alias("pages"), F.count_if(_stem("name").rlike(GENERIC)).alias("generic"))
    busy = valid(f).groupBy(F.to_date("ts")).count().agg(F.max("count").alias("busy"))
    asked = A.pages(spark, d).agg(F.sum(F.length(F.regexp_replace("raw_text", "[^?？]", ""))).alias("questions"))
    kept = v.groupBy("doc_id", "status").agg(F.count("*").alias("n")).agg(F.sum("n").alias("versions"), F.count_if(F.col("status") == "deleted").alias("gone"))
    t = reduce(DataFrame.crossJoin, [busy, asked, kept], t)  # one row each
    rules = {"胶片建档人": "files > 0", "百片馆长": "files >= 100", "千页导演": "pages >= 1000", "时光机常客": "versions >= 10", "失而复得守护者": "gone > 0", "灵魂提问官": "questions >= 20", "一日十片": "busy >= 10", "命名清醒者": "generic = 0 and files > 0"}
    badges = F.array_compact(F.array(*(F.when(F.expr(r), F.lit(n)) for n, r in rules.items())))
    return t.select(F.when(F.size(badges) > 0, F.array_join(badges, "|")).otherwise("等待第一卷胶片").alias("badges"), F.format_string("片库里有 %d 份 PPT、%d 页，时光机留下 %d 个可读版本点。", "files", "pages", "versions").alias("line"))


#: The parts of packages: each line of an order is a part of the order's package, named by its number.
PARTS_CTE = """package AS (SELECT l_orderkey AS package, CASE l_linenumber WHEN 1 THEN concat('ppt/media/image', l_partkey % 50, '.png') WHEN 2 THEN concat('ppt/slides/slide', l_partkey % 9, '.xml') WHEN 3 THEN concat('ppt/slideLayouts/layout', l_partkey % 5, '.xml')
  WHEN 4 THEN concat('ppt/media/clip', l_partkey % 7, '.mp4') WHEN 5 THEN concat('ppt/notesSlides/note', l_partkey % 9, '.xml') WHEN 6 THEN concat('ppt/charts/chart', l_partkey % 3, '.xml') ELSE concat('docProps/x', l_linenumber, '.xml') END AS name,
  l_linenumber AS line, l_suppkey % 7 AS content, CAST(l_quantity * 100 AS BIGINT) AS raw, CAST(l_quantity * 40 AS BIGINT) AS packed FROM lineitem)"""


def package_parts(spark, d) -> DataFrame:
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    names = {1: ("ppt/media/image", 50, ".png"), 2: ("ppt/slides/slide", 9, ".xml"), 3: ("ppt/slideLayouts/layout", 5, ".xml"), 4: ("ppt/media/clip", 7, ".mp4"), 5: ("ppt/notesSlides/note", 9, ".xml"), 6: ("ppt/charts/chart", 3, ".xml")}
    name = F.concat(F.lit("docProps/x"), n, F.lit(".xml"))
    for k, (a, m, b) in names.items():
        name = F.when(n == k, F.concat(F.lit(a), p % m, F.lit(b))).otherwise(name)
    return A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("package"), name.alias("name"), n.alias("line"), (F.col("l_suppkey") % 7).alias("content"), (F.col("l_quantity") * 100).cast("long").alias("raw"), (F.col("l_quantity") * 40).cast("long").alias("packed"))


# What the folders and the types of a package's parts are called.
SIZE_BUCKETS = [("ppt/(slidemasters|slidelayouts)/", "母版/版式"), ("ppt/embeddings/", "嵌入对象"), ("ppt/(notesslides|comments)/", "备注/评论"), ("ppt/slides/", "幻灯片 XML")]
MEDIA = [("png|jpe?g|gif|bmp|tiff?|webp|svg|emf|wmf", "图片"), ("mp4|mov|avi|wmv|mkv|m4v|webm", "视频"), ("mp3|wav|m4a|wma|aac|ogg|flac", "音频")]
PART_BUCKETS = [(r"ppt/slides/slide.*\.xml$", "slides"), ("ppt/notesslides/", "notes"), ("ppt/media/", "media"), ("ppt/charts/", "charts"), ("ppt/diagrams/", "diagrams"), ("ppt/theme/", "theme"), ("ppt/slide(layouts|masters)/", "layout")]
_SIZE_RULES = [*((rf"ppt/media/.*\.({e})$", n) for e, n in MEDIA), ("ppt/media/", "媒体"), *SIZE_BUCKETS]


def bucket(name, rules: list[tuple[str, str]], other: str) -> F.Column:
    out = F.lit(other)
    for p, label in reversed(rules):
        out = F.when(F.lower(name).rlike(f"^{p}"), label).otherwise(out)
    return out


def _case(rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '^{p}') THEN '{label}'" for p, label in rules) + f" ELSE '{other}' END"


@query(f"WITH {PARTS_CTE} SELECT {_case(_SIZE_RULES, '其他')} AS bucket, count(*) AS n, sum(packed)::BIGINT AS packed, sum(raw)::BIGINT AS raw FROM package GROUP BY 1")
def package_buckets(spark, d):
    return package_parts(spark, d).groupBy(bucket(F.col("name"), _SIZE_RULES, "其他").alias("bucket")).agg(F.count("*").alias("n"), F.sum("packed").alias("packed"), F.sum("raw").alias("raw"))


@query(f"WITH {PARTS_CTE} SELECT {_case(PART_BUCKETS, 'other')} AS bucket, count(*) AS n, count(DISTINCT package) AS packages FROM package GROUP BY 1")
def part_buckets(spark, d):
    return package_parts(spark, d).groupBy(bucket(F.col("name"), PART_BUCKETS, "other").alias("bucket"), "package").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("n"), F.count("*").alias("packages"))


@query(f"""WITH {PARTS_CTE}, m AS (SELECT content, regexp_extract(name, '\\.[a-z0-9]+$') AS ext, name, max(packed) AS packed FROM package WHERE starts_with(name, 'ppt/media/') GROUP BY ALL)
SELECT content, ext, count(*) AS copies, min(name) AS keep, (sum(packed) - arg_min(packed, name))::BIGINT AS reclaimable FROM m GROUP BY ALL HAVING count(*) > 1""")
def duplicate_media(spark, d):
    """Media parts of equal content and type: the first name stays."""
    m = package_parts(spark, d).where(F.startswith("name", F.lit("ppt/media/"))).groupBy("content", F.regexp_extract("name", r"\.[a-z0-9]+$", 0).alias("ext"), "name").agg(F.max("packed").alias("packed"))
    g = m.groupBy("content", "ext").agg(F.count("*").alias("copies"), F.min("name").alias("keep"), (F.sum("packed") - F.min_by("packed", "name")).alias("reclaimable"))
    return g.where("copies > 1")


@query(f"""WITH {PARTS_CTE}, l AS (SELECT DISTINCT name FROM package WHERE starts_with(name, 'ppt/slideLayouts/')), u AS (SELECT DISTINCT concat('ppt/slideLayouts/layout', l_partkey % 5, '.xml') AS name FROM lineitem WHERE l_linenumber = 2 AND l_partkey % 5 < 3) SELECT name FROM l EXCEPT SELECT name FROM u""")
def unused_layouts(spark, d):
    """Layouts that no slide refers to."""
    every = package_parts(spark, d).where(F.startswith("name", F.lit("ppt/slideLayouts/"))).select("name")
    used = A.read(spark, d, "lineitem").where("l_linenumber = 2 and l_partkey % 5 < 3").select(F.concat(F.lit("ppt/slideLayouts/layout"), F.col("l_partkey") % 5, F.lit(".xml")).alias("name"))
    return every.subtract(used)


# Words of a name that a user means to keep.
KEEP_WORDS = "终稿|定稿|final|最终"


@query(f"""WITH {FC}, g AS (SELECT content_hash, count(DISTINCT path) AS copies, arg_max(struct_pack(path := path, size := size), struct_pack(a := regexp_matches(lower(name), '{KEEP_WORDS}'), b := mtime, c := path)) AS k FROM files WHERE length(content_hash) = 71 AND starts_with(content_hash, 'sha256:') GROUP BY 1)
SELECT content_hash, copies, k.path AS keep, (k.size * (copies - 1))::BIGINT AS reclaimable FROM g WHERE copies > 1""")
def exact_duplicates(spark, d):
    """Groups of files of equal SHA-256; the one to keep has a word of KEEP_WORDS in its name, else it is the newest."""
    f = A.files(spark, d).where(F.startswith("content_hash", F.lit("sha256:")) & (F.length("content_hash") == 71))
    best = F.max_by(F.struct("path", "size"), F.struct(F.lower("name").rlike(KEEP_WORDS).alias("a"), "mtime", "path"))
    g = f.groupBy("content_hash").agg(F.count_distinct("path").alias("copies"), best.alias("k"))
    return g.where("copies > 1").select("content_hash", "copies", F.col("k.path").alias("keep"), (F.col("k.size") * (F.col("copies") - 1)).alias("reclaimable"))


@query(f"""WITH {FC}, x AS (SELECT count(*) AS files, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER ({A.NOW} - mtime > 365 * 86400) AS zombies, count(*) FILTER (regexp_matches(name, '{FINAL}')) AS curse FROM files),
y AS (SELECT sum(n - 1)::BIGINT AS dup FROM (SELECT count(*) AS n FROM files GROUP BY content_hash))
SELECT files, failed, zombies, curse, dup, greatest(0, round_even(100 - least(35, 60 * dup / files) - least(22, 55 * failed / files) - least(18, 22 * zombies / files) - least(12, 18 * curse / files), 0))::BIGINT AS score FROM x, y""")
def health_score(spark, d):
    """As health_report, by the whole rule of what a final name is."""
    counted = A.files(spark, d).groupBy("content_hash").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.lit(A.NOW) - F.col("mtime") > 365 * A.DAY).alias("zombies"), F.count_if(F.col("name").rlike(FINAL)).alias("curse"))
    t = counted.agg(F.sum("n").alias("files"), F.sum("failed").alias("failed"), F.sum("zombies").alias("zombies"), F.sum("curse").alias("curse"), F.sum(F.col("n") - 1).alias("dup"))
    part = lambda top, w, c: F.least(F.lit(float(top)), w * F.col(c) / F.col("files"))
    score = F.greatest(F.lit(0), F.bround(100 - part(35, 60, "dup") - part(22, 55, "failed") - part(18, 22, "zombies") - part(12, 18, "curse"), 0))
    return t.select("files", "failed", "zombies", "curse", "dup", score.cast("long").alias("score"))


QUERIES, ORACLE_SQL = Q, S
