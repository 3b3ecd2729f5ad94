"""Version history: sessions, sprints, deltas, branches, diffs, retention, store integrity; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql import adapters as A
from corpusql.adapters import VERSIONS_CTE as VC

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def by_doc():
    return W.partitionBy("doc_id").orderBy("ts", "version_id")


#: A branch for each document of an odd id above 1: its parent is the id before, from that document's 20th version.
BRANCHES = "branches AS (SELECT v.doc_id + 1 AS doc_id, v.doc_id AS parent, v.version_id AS base, v.ts AS base_ts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, version_id) AS k FROM versions) v WHERE k = 20 AND v.doc_id % 2 = 0)"


def branches(v):
    k = v.withColumn("k", F.row_number().over(by_doc())).where("k = 20 and doc_id % 2 = 0")
    return k.select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("parent"), F.col("version_id").alias("base"), F.col("ts").alias("base_ts"))


@query(f"""WITH {VC}, w AS (SELECT doc_id, ts, version_id, count(*) OVER x AS n, min(ts) OVER x AS since FROM versions WINDOW x AS (PARTITION BY doc_id ORDER BY ts RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, since, ts, version_id) AS k FROM w) SELECT doc_id, n, round(since, 3) AS since FROM b WHERE k = 1 ORDER BY n DESC, since, doc_id LIMIT 5""")
def sprint_72h(spark, d):
    x = W.partitionBy("doc_id").orderBy("ts").rangeBetween(-259200, 0)
    w = A.versions(spark, d).select("doc_id", "ts", "version_id", F.count("*").over(x).alias("n"), F.min("ts").over(x).alias("since"))
    b = w.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("n").desc(), "since", "ts", "version_id"))).where("k = 1")
    return b.orderBy(F.col("n").desc(), "since", "doc_id").limit(5).select("doc_id", "n", F.round("since", 3).alias("since"))


@query(f"""WITH {VC}, l AS (SELECT *, page_count - lag(page_count) OVER w AS dp, size - lag(size) OVER w AS ds, ts - lag(ts) OVER w AS gap FROM versions WINDOW w AS (PARTITION BY doc_id ORDER BY ts, version_id))
SELECT doc_id, max(abs(dp)) AS biggest_pages, max(abs(ds)) AS biggest_size, round(max(gap), 3) AS revival, count(*) FILTER (dp > 0) AS grew, count(*) FILTER (dp < 0) AS shrank FROM l GROUP BY 1""")
def version_deltas(spark, d):
    v = A.versions(spark, d)
    v = v.select("doc_id", *((F.col(c) - F.lag(c).over(by_doc())).alias(n) for c, n in [("page_count", "dp"), ("size", "ds"), ("ts", "gap")]))
    return v.groupBy("doc_id").agg(F.max(F.abs("dp")).alias("biggest_pages"), F.max(F.abs("ds")).alias("biggest_size"), F.round(F.max("gap"), 3).alias("revival"), F.count_if(F.col("dp") > 0).alias("grew"), F.count_if(F.col("dp") < 0).alias("shrank"))


@query(f"""WITH {VC}, l AS (SELECT *, page_count - lag(page_count) OVER (PARTITION BY doc_id ORDER BY ts, version_id) AS dp FROM versions), s AS (SELECT *, sign(dp) <> lag(sign(dp)) OVER (PARTITION BY doc_id ORDER BY ts, version_id) AS flip FROM l WHERE dp <> 0)
SELECT doc_id, count(*) FILTER (flip) AS flips FROM s GROUP BY 1""")
def flip_flops(spark, d):
    v = A.versions(spark, d).withColumn("dp", F.col("page_count") - F.lag("page_count").over(by_doc())).where("dp <> 0")
    return v.withColumn("flip", F.signum("dp") != F.lag(F.signum("dp")).over(by_doc())).groupBy("doc_id").agg(F.count_if("flip").alias("flips"))


@query(f"""WITH {VC} SELECT doc_id, arg_min(page_count, struct_pack(a := ts, b := version_id)) AS first_pages, arg_max(page_count, struct_pack(a := ts, b := version_id)) AS last_pages, count(*) AS n FROM versions GROUP BY 1""")
def growth_balance(spark, d):
    at = F.struct("ts", "version_id")
    return A.versions(spark, d).groupBy("doc_id").agg(F.min_by("page_count", at).alias("first_pages"), F.max_by("page_count", at).alias("last_pages"), F.count("*").alias("n"))


def sessions(v):
    """Adds session: a number that grows with each gap of half an hour or more since the version before."""
    new = F.when(F.col("ts") - F.lag("ts").over(by_doc()) < 1800, 0).otherwise(1)
    return v.withColumn("new", new).withColumn("session", F.sum("new").over(by_doc())).drop("new")


_SESSIONS = "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 1800 THEN 0 ELSE 1 END AS new FROM versions WINDOW w AS (PARTITION BY doc_id ORDER BY ts, version_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts, version_id) AS session FROM g)"


@query(f"WITH {VC}, {_SESSIONS} SELECT doc_id, concat('s', strftime(min(\"at\"), '%Y%m%d-%H%M')) AS session_id, count(*) AS n FROM s GROUP BY doc_id, session")
def sessions_30m(spark, d):
    s = sessions(A.versions(spark, d))
    return s.groupBy("doc_id", "session").agg(F.concat(F.lit("s"), F.date_format(F.min("at"), "yyyyMMdd-HHmm")).alias("session_id"), F.count("*").alias("n")).drop("session")


@query(f"""WITH {VC}, {BRANCHES}, own AS (SELECT doc_id, version_id, ts, health, false AS inherited FROM versions), inh AS (SELECT b.doc_id, v.version_id, v.ts, v.health, true FROM branches b JOIN versions v ON v.doc_id = b.parent AND (v.ts < b.base_ts OR (v.ts = b.base_ts AND v.version_id <= b.base)))
SELECT doc_id, count(*) AS n, count(*) FILTER (inherited) AS inherited, count(*) FILTER (health = 'ok') AS healthy FROM (SELECT * FROM own UNION ALL SELECT * FROM inh) GROUP BY 1""")
def inherited_versions(spark, d):
    v = A.versions(spark, d)
    b, p = branches(v), v.select(F.col("doc_id").alias("parent"), "version_id", "ts", "health")
    inh = b.join(p, "parent").where("ts < base_ts or (ts = base_ts and version_id <= base)").select("doc_id", "version_id", "ts", "health", F.lit(True).alias("inherited"))
    every = v.select("doc_id", "version_id", "ts", "health", F.lit(False).alias("inherited")).unionByName(inh)
    return every.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("inherited").alias("inherited"), F.count_if(F.col("health") == "ok").alias("healthy"))


@query(f"WITH {VC}, {BRANCHES} SELECT b.doc_id, b.base FROM branches b WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.version_id = b.base AND v.health = 'ok')")
def dangling_branches(spark, d):
    v = A.versions(spark, d)
    return branches(v).join(v.where("health = 'ok'").select(F.col("version_id").alias("base")), "base", "left_anti").select("doc_id", "base")


@query(f"""WITH {VC}, {_SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, session ORDER BY ts DESC, version_id DESC) AS k, dense_rank() OVER (PARTITION BY doc_id ORDER BY session DESC) AS recent FROM s WHERE health = 'ok'),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN k = 1 THEN 0 WHEN recent <= 5 THEN 1 ELSE 2 END, ts DESC, version_id DESC) AS place FROM r) SELECT doc_id, version_id, place FROM p WHERE place <= 20""")
def retention_keep(spark, d):
    """Of each document 20 versions stay: the newest of each session, then the newest five sessions, then the rest; invalid ones are exempt."""
    s = sessions(A.versions(spark, d)).where("health = 'ok'")
    newest = [F.col("ts").desc(), F.col("version_id").desc()]
    r = s.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "session").orderBy(*newest))).withColumn("recent", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("session").desc())))
    rank = F.when(F.col("k") == 1, 0).when(F.col("recent") <= 5, 1).otherwise(2)
    return r.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(rank, *newest)).cast("long")).where("place <= 20").select("doc_id", "version_id", "place")


#: The reference's quota of healthy versions a document; 0: no limit.
KEEP = 100


def retained(v, keep: int = KEEP):
    """doc_id, version_id, place, exempt of the versions that stay; place is null where ``exempt`` says why a version doesn't count.

    The newest of each session first, then the newest five sessions, then the rest, up to ``keep``. Bases of
    branches and versions that aren't healthy stay outside the count."""
    newest = [F.col("ts").desc(), F.col("version_id").desc()]
    bases = branches(v).select(F.col("base").alias("version_id")).distinct().withColumn("is_base", F.lit(True))
    healthy = sessions(v).where("health = 'ok'")
    r = healthy.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "session").orderBy(*newest))).withColumn("recent", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("session").desc())))
    rank = F.when(F.col("k") == 1, 0).when(F.col("recent") <= 5, 1).otherwise(2)
    r = r.join(bases, "version_id", "left").withColumn("exempt", F.when(F.col("is_base"), "branch base"))
    place = F.row_number().over(W.partitionBy("doc_id", F.col("exempt").isNull()).orderBy(rank, *newest)).cast("long")
    r = r.withColumn("place", F.when(F.col("exempt").isNull(), place)).where(F.lit(keep <= 0) | F.col("exempt").isNotNull() | (F.col("place") <= keep))
    out = ["doc_id", "version_id", "place", "exempt"]
    bad = v.where("health <> 'ok'").select("doc_id", "version_id", F.lit(None).cast("long").alias("place"), F.lit("quarantined").alias("exempt"))
    return r.select(*out).unionByName(bad)


@query(f"""WITH {VC}, {BRANCHES}, {_SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, session ORDER BY ts DESC, version_id DESC) AS k, dense_rank() OVER (PARTITION BY doc_id ORDER BY session DESC) AS recent FROM s WHERE health = 'ok'),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN k = 1 THEN 0 WHEN recent <= 5 THEN 1 ELSE 2 END, ts DESC, version_id DESC) AS place FROM r WHERE version_id NOT IN (SELECT base FROM branches))
SELECT doc_id, version_id, place, NULL AS exempt FROM p WHERE place <= {KEEP} UNION ALL SELECT doc_id, version_id, NULL, CASE WHEN health = 'ok' THEN 'branch base' ELSE 'quarantined' END FROM versions WHERE health <> 'ok' OR version_id IN (SELECT base FROM branches)""")
def retention_quota(spark, d):
    """The reference's whole quota (see retained); retention_keep is the shorter one of 20 without branch bases."""
    return retained(A.versions(spark, d))


@query(r"""WITH p AS (SELECT conv_id AS doc, turn AS page, text FROM conversations) SELECT coalesce(a.doc + 1, b.doc) AS doc, coalesce(a.page, b.page) AS page, CASE WHEN a.page IS NULL THEN 'added' WHEN b.page IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM p a FULL JOIN p b ON a.doc + 1 = b.doc AND a.page = b.page WHERE a.text IS DISTINCT FROM b.text""")
def page_diff_full_outer(spark, d):
    """Each conversation against the one before it, turn by turn."""
    p = A.read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    a = p.select((F.col("doc") + 1).alias("doc"), "page", F.col("text").alias("before"), F.lit(1).alias("l"))
    j = a.join(p.withColumn("r", F.lit(1)), ["doc", "page"], "full_outer").where("not before <=> text")
    return j.select("doc", "page", F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("changed").alias("change"))


#: Manifests: an order is a version, its lines are parts; part p of supplier s has the content hash p * 31 + s % 5.
_PARTS = "parts AS (SELECT l_orderkey AS version, CASE WHEN l_linenumber = 1 THEN 'layout' WHEN l_linenumber = 2 THEN 'media' ELSE 'slides' END AS bucket, l_linenumber AS part, l_partkey * 31 + l_suppkey % 5 AS hash FROM lineitem)"


def parts(spark, d):
    bucket = F.when(F.col("l_linenumber") == 1, "layout").when(F.col("l_linenumber") == 2, "media").otherwise("slides")
    return A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("version"), bucket.alias("bucket"), F.col("l_linenumber").alias("part"), (F.col("l_partkey") * 31 + F.col("l_suppkey") % 5).alias("hash"))


@query(f"""WITH {_PARTS}, x AS (SELECT DISTINCT version, bucket, part, hash FROM parts), d AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS change
FROM x a FULL JOIN x b ON a.version + 1 = b.version AND a.part = b.part) SELECT bucket, change, count(*) AS n FROM d GROUP BY 1, 2""")
def manifest_diff(spark, d):
    x = parts(spark, d).distinct()
    a = x.select((F.col("version") + 1).alias("version"), "part", F.col("bucket").alias("old"), F.col("hash").alias("was"))
    j = a.join(x, ["version", "part"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("was") != F.col("hash"), "changed").otherwise("same")
    return j.groupBy(F.coalesce("old", "bucket").alias("bucket"), change.alias("change")).agg(F.count("*").alias("n"))


@query(f"WITH {_PARTS} SELECT DISTINCT hash FROM parts WHERE hash NOT IN (SELECT hash FROM parts JOIN orders ON version = o_orderkey AND o_orderstatus = 'O')")
def unreferenced_objects(spark, d):
    p = parts(spark, d)
    live = A.read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("version"))
    return p.select("hash").distinct().join(p.join(live, "version", "left_semi").select("hash"), "hash", "left_anti")


@query(f"""WITH {VC} SELECT doc_id, count(*) AS versions, count(*) FILTER (health = 'ok') AS healthy, sum(size)::BIGINT AS bytes, arg_max(version_id, struct_pack(a := ts, b := version_id)) FILTER (health = 'ok') AS recover FROM versions GROUP BY 1""")
def vault_kpis(spark, d):
    ok = F.col("health") == "ok"
    return A.versions(spark, d).groupBy("doc_id").agg(F.count("*").alias("versions"), F.count_if(ok).alias("healthy"), F.sum("size").alias("bytes"), F.max_by("version_id", F.when(ok, F.struct("ts", "version_id"))).alias("recover"))


@query()
def debounce_batch(spark, d):
    """Events of one user within 1.5 s of each other become the last of them."""
    e = A.read(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "1500 milliseconds").alias("w")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("at"), F.count("*").alias("n")).select("user_id", "event_type", "at", "n")


QUERIES, ORACLE_SQL = Q, S
