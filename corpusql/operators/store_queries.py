"""The version store: details, diffs, identity, deduplication, integrity, collection, aliases; with their SQL.

Each operator is a plan over tables; nothing is written here. A hash is text; a null hash matches nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql import adapters as A
from corpusql.adapters import DOCS_CTE as DC
from corpusql.adapters import FILES_CTE as FC
from corpusql.adapters import PATHS_CTE as HC
from corpusql.adapters import VERSIONS_CTE as VC
from corpusql.operators.report_queries import PART_BUCKETS, PARTS_CTE, _case, bucket, package_parts
from corpusql.operators.version_queries import BRANCHES, branches, by_doc

Q: dict = {}
S: dict = {}
SAMPLE, RESULTS, BATCH = 6, 200, 500


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query(f"WITH {VC} SELECT version_id, lag(version_id) OVER (PARTITION BY doc_id ORDER BY ts, version_id) AS previous FROM versions")
def previous_version(spark, d):
    return A.versions(spark, d).select("version_id", F.lag("version_id").over(by_doc()).alias("previous"))


def effective(v: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, version_id, ts, health, inherited: a document's own versions and those of its parent up to the branch, by time alone."""
    own = v.select("doc_id", "version_id", "ts", "health", F.lit(False).alias("inherited"))
    parent = v.select(F.col("doc_id").alias("parent"), "version_id", "ts", "health")
    return own.unionByName(b.join(parent, "parent").where("ts <= base_ts").select("doc_id", "version_id", "ts", "health", F.lit(True).alias("inherited")))


_EFFECTIVE = f"{VC}, {BRANCHES}, effective AS (SELECT doc_id, version_id, ts, health, false AS inherited FROM versions UNION ALL SELECT b.doc_id, v.version_id, v.ts, v.health, true FROM branches b JOIN versions v ON v.doc_id = b.parent AND v.ts <= b.base_ts)"


@query(f"WITH {_EFFECTIVE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, version_id DESC) AS k FROM effective) SELECT doc_id, version_id, inherited, k FROM r WHERE k <= 50")
def version_details(spark, d):
    """The newest 50 versions of each document, inherited ones marked."""
    v = A.versions(spark, d)
    k = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("ts").desc(), F.col("version_id").desc())).cast("long")
    return effective(v, branches(v)).withColumn("k", k).where("k <= 50").select("doc_id", "version_id", "inherited", "k")


@query(f"WITH {_EFFECTIVE}, {DC} SELECT d.doc_id, d.path, arg_max(e.version_id, struct_pack(a := e.ts, b := e.version_id)) AS version_id FROM docs d JOIN effective e USING (doc_id) WHERE d.status = 'deleted' AND e.health = 'ok' GROUP BY ALL")
def recover_deleted(spark, d):
    """Of each deleted document the newest healthy version, own or inherited."""
    v = A.versions(spark, d)
    gone = A.managed_docs(spark, d).where("status = 'deleted'")
    return effective(v, branches(v)).where("health = 'ok'").join(gone, "doc_id").groupBy("doc_id", "path").agg(F.max_by("version_id", F.struct("ts", "version_id")).alias("version_id"))


@query(f"WITH {VC}, {DC} SELECT doc_id, path, count(*) AS n FROM versions JOIN docs USING (doc_id) WHERE status = 'active' AND contains(lower(path), 'deck_1') GROUP BY ALL")
def version_list(spark, d):
    """Versions of documents of a status whose path holds a text, in any case."""
    return A.versions(spark, d).join(A.managed_docs(spark, d).where((F.col("status") == "active") & F.contains(F.lower("path"), F.lit("deck_1"))), "doc_id").groupBy("doc_id", "path").agg(F.count("*").alias("n"))


@query(f"WITH {HC}, {DC} SELECT doc_id, arg_max(p.path, struct_pack(a := last_seen, b := p.path)) AS path, any_value(status) AS status FROM paths p JOIN docs USING (doc_id) GROUP BY 1")
def current_path(spark, d):
    """Where each document was seen last."""
    return A.doc_paths(spark, d).join(A.managed_docs(spark, d).drop("path"), "doc_id").groupBy("doc_id").agg(F.max_by("path", F.struct("last_seen", "path")).alias("path"), F.first("status").alias("status"))


@query(f"WITH {HC} SELECT doc_id, path, first_seen, last_seen, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY last_seen DESC, path DESC) = 1 THEN 'current' ELSE 'alias' END AS status FROM paths")
def path_aliases(spark, d):
    """A new current path demotes the others of the document to aliases."""
    newest = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("last_seen").desc(), F.col("path").desc())) == 1
    return A.doc_paths(spark, d).withColumn("status", F.when(newest, "current").otherwise("alias"))


@query(f"WITH {HC} SELECT doc_id, count(*) AS paths FROM paths GROUP BY 1 HAVING max(CASE WHEN contains(path, '/lib/0/') AND doc_id % 3 > 0 THEN 1 ELSE 0 END) = 0")
def ghost_docs(spark, d):
    """Documents none of whose known paths exists (here: those of folder 0, of two documents in three)."""
    there = F.contains("path", F.lit("/lib/0/")) & (F.col("doc_id") % 3 > 0)
    return A.doc_paths(spark, d).groupBy("doc_id").agg(F.count("*").alias("paths"), F.bool_or(there).alias("there")).where("not there").select("doc_id", "paths")


# The pages of versions: version n of a conversation's document is its turns up to 2 n.
_TURNS = "p AS (SELECT conv_id AS doc, turn AS page, text, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS terms FROM conversations)"


def turns(spark, d) -> DataFrame:
    t = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    return A.read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text", t.alias("terms"))


_DIFF = f"""{_TURNS}, j AS (SELECT coalesce(a.doc + 1, b.doc) AS doc, coalesce(a.page, b.page) AS page, a.text AS old, b.text AS new, a.terms AS was, b.terms AS now, a.doc IS NOT NULL AS l, b.doc IS NOT NULL AS r FROM p a FULL JOIN p b ON a.doc + 1 = b.doc AND a.page = b.page)"""


def page_pairs(spark, d) -> DataFrame:
    """doc, page, old, new, was, now, l, r: the pages of each document against those of the one before it."""
    p = turns(spark, d)
    a = p.select((F.col("doc") + 1).alias("doc"), "page", F.col("text").alias("old"), F.col("terms").alias("was"), F.lit(True).alias("l"))
    b = p.select("doc", "page", F.col("text").alias("new"), F.col("terms").alias("now"), F.lit(True).alias("r"))
    return a.join(b, ["doc", "page"], "full_outer").withColumn("l", F.coalesce("l", F.lit(False))).withColumn("r", F.coalesce("r", F.lit(False)))


@query(f"""WITH {_DIFF}, c AS (SELECT doc, page, list_filter(now, lambda x: NOT list_contains(was, x)) AS plus, list_filter(was, lambda x: NOT list_contains(now, x)) AS minus FROM j WHERE l AND r AND old <> new),
t AS (SELECT doc, 'added' AS kind, unnest(plus) AS term, page FROM c UNION ALL SELECT doc, 'removed', unnest(minus), page FROM c), f AS (SELECT doc, kind, term, min(page) AS page FROM t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY page, term) AS k FROM f) SELECT doc, kind, string_agg(term, ' ' ORDER BY k) AS terms FROM k WHERE k <= {SAMPLE} GROUP BY ALL""")
def term_diff(spark, d):
    """The first SAMPLE terms that changed pages gained and lost, by page, then term."""
    c = page_pairs(spark, d).where("l and r and old <> new")
    t = c.select("doc", "page", F.explode(F.array(F.struct(F.lit("added").alias("kind"), F.array_except("now", "was").alias("t")), F.struct(F.lit("removed").alias("kind"), F.array_except("was", "now").alias("t")))).alias("x"))
    f = t.select("doc", "page", "x.kind", F.explode("x.t").alias("term")).groupBy("doc", "kind", "term").agg(F.min("page").alias("page"))
    k = f.withColumn("k", F.row_number().over(W.partitionBy("doc", "kind").orderBy("page", "term"))).where(f"k <= {SAMPLE}")
    return k.groupBy("doc", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " ").alias("terms"))


@query(f"""WITH {_DIFF}, s AS (SELECT doc, count(*) FILTER (l AND r AND old <> new) AS c, count(*) FILTER (r) - count(*) FILTER (l) AS d FROM j GROUP BY 1)
SELECT doc, CASE WHEN c = 0 AND d = 0 THEN '内容微调' ELSE concat_ws(' · ', CASE WHEN c > 0 THEN concat('改 ', c, ' 页') END, CASE WHEN d > 0 THEN concat('+', d, ' 页') WHEN d < 0 THEN concat(d, ' 页') END) END AS summary FROM s""")
def change_summary(spark, d):
    """How many pages changed, and how many more or fewer there are."""
    s = page_pairs(spark, d).groupBy("doc").agg(F.count_if(F.col("l") & F.col("r") & (F.col("old") != F.col("new"))).alias("c"), (F.count_if("r") - F.count_if("l")).alias("d"))
    delta = F.when(F.col("d") > 0, F.concat(F.lit("+"), F.col("d"), F.lit(" 页"))).when(F.col("d") < 0, F.concat(F.col("d"), F.lit(" 页")))
    text = F.concat_ws(" · ", F.when(F.col("c") > 0, F.concat(F.lit("改 "), F.col("c"), F.lit(" 页"))), delta)
    return s.select("doc", F.when(text == "", "内容微调").otherwise(text).alias("summary"))


@query(f"""WITH {_TURNS}, d AS (SELECT conv_id AS doc, concat('/lib/c', conv_id, '.pptx') AS path FROM conversations WHERE conv_id % 5 > 0 GROUP BY 1), h AS (SELECT doc, page FROM p WHERE contains(concat(' ', array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), ' '), ' the ')),
n AS (SELECT count(*) AS total FROM h), t AS (SELECT * FROM h ORDER BY page DESC, doc DESC LIMIT {RESULTS}) SELECT t.doc, t.page, d.path, total FROM t JOIN d USING (doc), n""")
def history_search(spark, d):
    """Pages of versions that hold all words in their order, newest first; those of unknown documents go after the limit."""
    p = turns(spark, d)
    h = p.where(F.contains(F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" ")), F.lit(" the "))).select("doc", "page")
    docs = A.read(spark, d, "conversations").where("conv_id % 5 > 0").select(F.col("conv_id").alias("doc"), F.concat(F.lit("/lib/c"), F.col("conv_id"), F.lit(".pptx")).alias("path")).distinct()
    top = h.orderBy(F.col("page").desc(), F.col("doc").desc()).limit(RESULTS).join(docs, "doc", "left").where("path is not null")
    return top.crossJoin(h.agg(F.count("*").alias("total"))).select("doc", "page", "path", "total")  # a row on that side


def identity(seen: DataFrame, docs: DataFrame, versions: DataFrame) -> DataFrame:
    """seen(path, content_hash), docs(doc_id, path, there: does the path exist), versions(version_id, doc_id, ts, content_hash)
    -> (path, doc_id, kind, from_version): known by its path; else renamed, if a document of equal contents has lost
    its path (the newest such version's); else a branch of the newest version of equal contents; else new."""
    known = docs.groupBy("path").agg(F.min("doc_id").alias("known"))
    of = versions.join(docs, "doc_id").groupBy("content_hash").agg(
        F.max_by(F.struct("doc_id", "version_id"), F.when(~F.col("there"), F.struct("ts", "version_id"))).alias("lost"), F.max_by(F.struct("doc_id", "version_id"), F.struct("ts", "version_id")).alias("any")
    )
    j = seen.join(known, "path", "left").join(of, "content_hash", "left")
    kind = F.when(F.col("known").isNotNull(), "known").when(F.col("lost").isNotNull(), "renamed").when(F.col("any").isNotNull(), "branch").otherwise("new")
    return j.select("path", F.coalesce("known", F.when(kind == "renamed", F.col("lost.doc_id"))).alias("doc_id"), kind.alias("kind"), F.when(kind == "renamed", F.col("lost.version_id")).when(kind == "branch", F.col("any.version_id")).alias("from_version"))


@query(f"""WITH {VC}, {DC}, d AS (SELECT doc_id, path, doc_id % 4 > 0 AS there FROM docs), v AS (SELECT v.*, event_id % 3000 AS h FROM versions v JOIN (SELECT event_id FROM events) e ON e.event_id = v.version_id),
seen AS (SELECT concat('/lib/', event_id % 5, '/deck_', event_id % 211, '.pptx') AS path, event_id % 6000 AS h FROM events WHERE event_id % 3 = 0), k AS (SELECT path, min(doc_id) AS known FROM d GROUP BY 1),
o AS (SELECT h, arg_max(struct_pack(d := doc_id, v := version_id), struct_pack(a := ts, b := version_id)) FILTER (NOT there) AS lost, arg_max(struct_pack(d := doc_id, v := version_id), struct_pack(a := ts, b := version_id)) AS anyone FROM v JOIN d USING (doc_id) GROUP BY 1),
x AS (SELECT s.path, known, lost, anyone, CASE WHEN known IS NOT NULL THEN 'known' WHEN lost IS NOT NULL THEN 'renamed' WHEN anyone IS NOT NULL THEN 'branch' ELSE 'new' END AS kind FROM seen s LEFT JOIN k USING (path) LEFT JOIN o USING (h))
SELECT path, coalesce(known, CASE WHEN kind = 'renamed' THEN lost.d END) AS doc_id, kind, CASE kind WHEN 'renamed' THEN lost.v WHEN 'branch' THEN anyone.v END AS from_version FROM x""")
def snapshot_identity(spark, d):
    e = A.read(spark, d, "events")
    seen = e.where("event_id % 3 = 0").select(F.concat(F.lit("/lib/"), F.col("event_id") % 5, F.lit("/deck_"), F.col("event_id") % 211, F.lit(".pptx")).alias("path"), (F.col("event_id") % 6000).alias("content_hash"))
    docs = A.managed_docs(spark, d).withColumn("there", F.col("doc_id") % 4 > 0)
    return identity(seen, docs, A.versions(spark, d).withColumn("content_hash", F.col("version_id") % 3000))


# The store: objects of some numbers are lost or damaged.


def objects(spark, d) -> DataFrame:
    """package, name, hash of the parts of packages."""
    return package_parts(spark, d).select("package", "name", (F.col("content") * 100 + F.col("line")).alias("hash"))


@query(f"WITH {PARTS_CTE}, part AS (SELECT package, content * 100 + line AS hash FROM package) SELECT hash, min(package) AS first, count(*) AS used FROM part WHERE hash NOT IN (SELECT hash FROM part WHERE package <= 50) GROUP BY 1")
def new_objects(spark, d):
    """Content-addressed storage: each object that the store, the parts of the first 50 packages, lacks is stored once."""
    p = objects(spark, d)
    return p.join(p.where("package <= 50").select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.min("package").alias("first"), F.count("*").alias("used"))


def fsck(parts: DataFrame, stored: DataFrame) -> DataFrame:
    """parts(package, name, hash), stored(hash, actual) -> (package, missing, damaged): packages that can't be restored whole."""
    j = parts.join(stored.withColumn("there", F.lit(True)), "hash", "left")
    return j.groupBy("package").agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("hash") != F.col("actual")).alias("damaged")).where("missing + damaged > 0")


_STORED = "part AS (SELECT package, name, content * 100 + line AS hash FROM package), stored AS (SELECT DISTINCT hash, CASE WHEN hash % 13 = 5 THEN -1 ELSE hash END AS actual FROM part WHERE hash % 17 <> 3)"


def stored(parts: DataFrame) -> DataFrame:
    return parts.where("hash % 17 <> 3").select("hash", F.when(F.col("hash") % 13 == 5, F.lit(-1)).otherwise(F.col("hash")).alias("actual")).distinct()


@query(f"WITH {PARTS_CTE}, {_STORED} SELECT package, count(*) FILTER (s.hash IS NULL) AS missing, count(*) FILTER (s.hash <> s.actual) AS damaged FROM part p LEFT JOIN stored s ON p.hash = s.hash GROUP BY 1 HAVING count(*) FILTER (s.hash IS NULL OR s.hash <> s.actual) > 0")
def fsck_packages(spark, d):
    p = objects(spark, d)
    return fsck(p, stored(p))


def collectable(parts: DataFrame, live: DataFrame, pool: DataFrame) -> DataFrame:
    """Objects of the pool(hash) that no live(package) refers to; none at all if a live package's object isn't in the pool."""
    kept = parts.join(live, "package", "left_semi").select("hash").distinct()
    broken = kept.join(pool, "hash", "left_anti").agg(F.count("*").alias("broken"))
    return pool.join(kept, "hash", "left_anti").crossJoin(broken).where("broken = 0").select("hash")  # a row on that side


@query(f"WITH {PARTS_CTE}, part AS (SELECT package, content * 100 + line AS hash FROM package), live AS (SELECT DISTINCT hash FROM part WHERE package % 3000 = 1) SELECT DISTINCT hash FROM part WHERE hash NOT IN (SELECT hash FROM live) AND (SELECT count(*) FROM live WHERE hash NOT IN (SELECT hash FROM part)) = 0")
def gc_objects(spark, d):
    p = objects(spark, d)
    return collectable(p, p.where("package % 3000 = 1").select("package").distinct(), p.select("hash").distinct())


@query(f"WITH {PARTS_CTE}, {_STORED}, pool AS (SELECT hash FROM stored), live AS (SELECT DISTINCT hash FROM part WHERE package % 50 = 1) SELECT hash FROM pool WHERE hash NOT IN (SELECT hash FROM live) AND (SELECT count(*) FROM live WHERE hash NOT IN (SELECT hash FROM pool)) = 0")
def gc_aborted(spark, d):
    """A store that lacks objects of live packages: nothing is collected."""
    p = objects(spark, d)
    return collectable(p, p.where("package % 50 = 1").select("package").distinct(), stored(p).select("hash"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, unnest([p_partkey * 2, p_partkey * 2 + 1]) AS b FROM part WHERE p_size > 8), r AS (SELECT 1::BIGINT AS p UNION SELECT b FROM r JOIN e ON a = p WHERE b <= (SELECT max(p_partkey) FROM part)) SELECT p_partkey AS orphan FROM part WHERE p_partkey NOT IN (SELECT p FROM r)""")
def package_orphans(spark, d):
    """Parts that no chain of relationships leads to from the root: here part p refers to 2 p and 2 p + 1 if its size is above 8."""
    part = A.read(spark, d, "part")
    part.createOrReplaceTempView("corpusql_part")
    part.where("p_size > 8").select(F.col("p_partkey").alias("a"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1)).alias("b")).createOrReplaceTempView("corpusql_rels")
    found = spark.sql("WITH RECURSIVE r(p) AS (SELECT 1L AS p UNION ALL SELECT e.b FROM r JOIN corpusql_rels e ON e.a = r.p JOIN corpusql_part t ON t.p_partkey = e.b) SELECT DISTINCT p FROM r")
    return part.select(F.col("p_partkey").alias("orphan")).join(found, F.col("orphan") == F.col("p"), "left_anti")


def package_hash(parts: DataFrame) -> DataFrame:
    """parts(package, name, hash) -> (package, content_hash): of the sorted names and hashes; order and time don't matter."""
    pairs = F.array_sort(F.collect_list(F.concat_ws("\0", "name", F.col("hash").cast("string"))))
    return parts.groupBy("package").agg(F.concat(F.lit("pkg:"), F.sha2(F.array_join(pairs, "\0"), 256)).alias("content_hash"))


@query(f"WITH {PARTS_CTE} SELECT package, concat('pkg:', sha256(string_agg(concat(name, chr(0), content * 100 + line), chr(0) ORDER BY concat(name, chr(0), content * 100 + line)))) AS content_hash FROM package GROUP BY 1")
def package_hashes(spark, d):
    return package_hash(objects(spark, d))


@query(f"""WITH {PARTS_CTE}, h AS (SELECT package, concat('pkg:', sha256(string_agg(concat(name, chr(0), content * 100 + line), chr(0) ORDER BY concat(name, chr(0), content * 100 + line)))) AS h FROM package GROUP BY 1), v AS (SELECT o_orderkey AS package, CASE o_orderstatus WHEN 'O' THEN 'pkg:known' WHEN 'F' THEN 'file:known' ELSE concat('mtime:', o_orderkey) END AS content_hash FROM orders)
SELECT package, CASE WHEN starts_with(content_hash, 'pkg:') OR starts_with(content_hash, 'file:') THEN content_hash ELSE coalesce(h, content_hash) END AS content_hash FROM v LEFT JOIN h USING (package)""")
def hash_backfill(spark, d):
    """Versions whose hash is neither of a package nor of a file take that of their manifest."""
    status = F.col("o_orderstatus")
    v = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("package"), F.when(status == "O", "pkg:known").when(status == "F", "file:known").otherwise(F.concat(F.lit("mtime:"), F.col("o_orderkey"))).alias("was"))
    j = v.join(package_hash(objects(spark, d)), "package", "left")
    return j.select("package", F.when(F.col("was").rlike("^(pkg|file):"), F.col("was")).otherwise(F.coalesce("content_hash", "was")).alias("content_hash"))


def audited(versions: DataFrame, invalid: DataFrame, deep: bool) -> DataFrame:
    """versions(version_id, health, health_error) after an audit that found invalid(version_id, error).

    A deep audit clears every quarantine first, a quick one only those that no deep one made (error 'deep:...')."""
    stays = F.lit(False) if deep else F.startswith(F.coalesce("health_error", F.lit("")), F.lit("deep:"))
    j = versions.join(invalid, "version_id", "left")
    bad = F.when(F.col("error").isNotNull(), F.lit("invalid")).when((F.col("health") != "ok") & stays, F.col("health")).otherwise("ok")
    return j.select("version_id", bad.alias("health"), F.coalesce("error", F.when((F.col("health") != "ok") & stays, F.col("health_error")), F.lit("")).alias("health_error"))


@query(f"""WITH {VC}, v AS (SELECT version_id, health, CASE WHEN health <> 'ok' THEN CASE WHEN version_id % 2 = 0 THEN 'deep:hash' ELSE 'quick:manifest' END ELSE '' END AS e FROM versions)
SELECT version_id, CASE WHEN version_id % 29 = 0 THEN 'invalid' WHEN health <> 'ok' AND starts_with(e, 'deep:') THEN health ELSE 'ok' END AS health, CASE WHEN version_id % 29 = 0 THEN 'missing' WHEN health <> 'ok' AND starts_with(e, 'deep:') THEN e ELSE '' END AS health_error FROM v""")
def audit_marks(spark, d):
    """A quick audit over versions of which some were quarantined by a deep one."""
    v = A.versions(spark, d).select("version_id", "health", F.when(F.col("health") != "ok", F.when(F.col("version_id") % 2 == 0, "deep:hash").otherwise("quick:manifest")).otherwise("").alias("health_error"))
    return audited(v, v.where("version_id % 29 = 0").select("version_id", F.lit("missing").alias("error")), deep=False)


@query(f"""WITH {PARTS_CTE}, p AS (SELECT package, name, max(content) AS h FROM package GROUP BY ALL) SELECT {_case(PART_BUCKETS, 'other').replace('lower(name)', 'lower(coalesce(a.name, b.name))')} AS bucket, count(*) FILTER (a.name IS NULL) AS added, count(*) FILTER (b.name IS NULL) AS removed, count(*) FILTER (a.h <> b.h) AS changed FROM p a FULL JOIN p b ON a.package + 1 = b.package AND a.name = b.name GROUP BY 1""")
def part_diff(spark, d):
    """Parts added, removed and changed from each package to the next, by bucket."""
    p = package_parts(spark, d).groupBy("package", "name").agg(F.max("content").alias("h"))
    a = p.select((F.col("package") + 1).alias("package"), "name", F.col("h").alias("was"))
    j = a.join(p, ["package", "name"], "full_outer")
    return j.groupBy(bucket(F.col("name"), PART_BUCKETS, "other").alias("bucket")).agg(F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("h").isNull()).alias("removed"), F.count_if(F.col("was") != F.col("h")).alias("changed"))


def update_plan(here: DataFrame, there: DataFrame, version: tuple[int, ...], remote: tuple[int, ...]) -> DataFrame:
    """here and there(name, hash) -> (name, action: fetch or remove); nothing unless the remote version is the greater one."""
    j = here.withColumnRenamed("hash", "was").join(there, "name", "full_outer").where(F.lit(remote > version))
    return j.where("not was <=> hash").select("name", F.when(F.col("hash").isNull(), "remove").otherwise("fetch").alias("action"))


@query("""WITH a AS (SELECT p_name AS name, min(p_partkey) AS h FROM part WHERE p_size <= 30 GROUP BY 1), b AS (SELECT p_name AS name, max(p_partkey) AS h FROM part WHERE p_size >= 20 GROUP BY 1) SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'remove' ELSE 'fetch' END AS action FROM a FULL JOIN b USING (name) WHERE a.h IS DISTINCT FROM b.h""")
def update_files(spark, d):
    p = A.read(spark, d, "part")
    a = p.where("p_size <= 30").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("hash"))
    b = p.where("p_size >= 20").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("hash"))
    return update_plan(a, b, (1, 2, 7), (1, 10, 0))


@query(f"""WITH {FC}, seen AS (SELECT DISTINCT path FROM files WHERE file_id % 3 > 0), known AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM files WHERE file_id % 7 > 0)
SELECT s.path FROM seen s WHERE s.path NOT IN (SELECT path FROM known) AND regexp_replace(s.path, '/[^/]*$', '') IN (SELECT dir FROM known)""")
def new_siblings(spark, d):
    """Files in the folders of known ones that aren't known themselves."""
    f, dir_ = A.files(spark, d), F.regexp_replace("path", "/[^/]*$", "")
    known = f.where("file_id % 7 > 0").select("path", dir_.alias("dir")).distinct()
    seen = f.where("file_id % 3 > 0").select("path", dir_.alias("dir")).distinct()
    return seen.join(known.select("path"), "path", "left_anti").join(known.select("dir").distinct(), "dir", "left_semi").select("path")


@query(f"WITH {FC} SELECT file_id, concat(CAST(CAST(mtime AS BIGINT) AS VARCHAR), ':', size) AS stat_hash, length(content_hash) = 71 AND starts_with(content_hash, 'sha256:') AS exact FROM files")
def stat_hashes(spark, d):
    exact = F.startswith("content_hash", F.lit("sha256:")) & (F.length("content_hash") == 71)
    return A.files(spark, d).select("file_id", F.concat(F.col("mtime").cast("long"), F.lit(":"), F.col("size")).alias("stat_hash"), exact.alias("exact"))


def batches(docs: DataFrame, cursor: int, size: int = BATCH) -> DataFrame:
    """doc_id, batch: the documents after the cursor first, then those up to it, in batches of ``size``.

    Numbers come from counts of ranges of ids, so that no task sees all rows."""
    wide = docs.select("doc_id", (F.col("doc_id") <= cursor).alias("past"), F.floor(F.col("doc_id") / 4096).alias("range"))
    before = wide.groupBy("past", "range").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("past", "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("past", "range", "before")
    at = F.row_number().over(W.partitionBy("past", "range").orderBy("doc_id")) - 1
    return wide.withColumn("at", at).join(before, ["past", "range"]).select("doc_id", F.floor((F.col("before") + F.col("at")) / size).cast("long").alias("batch"))


@query(f"WITH {DC} SELECT doc_id, (row_number() OVER (ORDER BY doc_id <= 70, doc_id) - 1) // 40 AS batch FROM docs")
def reconcile_batches(spark, d):
    return batches(A.managed_docs(spark, d), 70, 40)


QUERIES, ORACLE_SQL = Q, S
