"""Keeping an index up to date: what changed, what to write, what to drop; and bursts of file events. With their SQL.

Tables are replaced by plans over the old and the new rows, so they work on any format Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql import adapters as A

#: Seconds after a first and a second failure; a third closes the circuit until the file's stat changes.
RETRY_AFTER = (86_400, 7 * 86_400)


def changes(stored: DataFrame, seen: DataFrame, now: float) -> DataFrame:
    """stored(path, size, mtime, status, failures, failed_at), seen(path, size, mtime) -> (path, change): new, vanished, changed, retry or unchanged.

    A row of the same size and time within a microsecond is unchanged, unless it is pending or its last error may be tried again.
    Paths are unique on each side; a null path matches nothing and counts as new or vanished."""
    s, n = (df.withColumn("there", F.lit(True)).alias(a) for df, a in ((stored, "s"), (seen, "n")))
    both = s.join(n, F.col("s.path") == F.col("n.path"), "full_outer")
    same = (F.col("s.size") == F.col("n.size")) & (F.abs(F.col("s.mtime") - F.col("n.mtime")) <= 1e-6)
    wait = F.when(F.col("s.failures") <= 1, RETRY_AFTER[0]).otherwise(RETRY_AFTER[1])
    due = (F.col("s.status") == "error") & (F.col("s.failures") < 3) & (F.lit(now) >= F.col("s.failed_at") + wait)
    change = (
        F.when(F.col("s.there").isNull(), "new").when(F.col("n.there").isNull(), "vanished")
        .when(F.coalesce(~same, F.lit(True)) | (F.col("s.status") == "pending"), "changed").when(due, "retry").otherwise("unchanged")
    )
    return both.select(F.coalesce("n.path", "s.path").alias("path"), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; columns that new lacks are null there."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)


def replace_pages(pages: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """pages without those of ``files`` (file_id), and with new: a file that has no page any more loses all."""
    return pages.join(files.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the file_ids that are gone."""
    ids = gone.select("file_id").distinct()
    return {name: t.join(ids, "file_id", "left_anti") for name, t in tables.items()}


def bursts(events: DataFrame, key: str, quiet: str = "1500 milliseconds", late: str | None = None) -> DataFrame:
    """(key, since, last, n): a row for each run of events of a key without a pause of ``quiet``; a trailing debounce.

    The same plan runs on a batch and on a stream; a stream needs ``late``, how long it waits for late events."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("since"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return g.select(key, "since", "last", "n")


def index_changes(spark, d):
    return changes(_stored(spark, d), _seen(spark, d), float(A.NOW))


def _stored(spark, d) -> DataFrame:
    f = A.files(spark, d).where("file_id % 17 <> 1")
    failed: Column = F.lit(float(A.NOW)) - (F.col("file_id") % 12) * 86_400
    return f.select(F.concat("path", F.lit("#"), F.col("file_id")).alias("path"), "size", "mtime", "status", (F.col("file_id") % 5).alias("failures"), failed.alias("failed_at"))


def _seen(spark, d) -> DataFrame:
    f = A.files(spark, d).where("file_id % 19 <> 2")
    moved = F.when(F.col("file_id") % 23 == 3, F.col("mtime") + 60).otherwise(F.col("mtime"))
    return f.select(F.concat("path", F.lit("#"), F.col("file_id")).alias("path"), "size", moved.alias("mtime"))


def event_bursts(spark, d):
    e = A.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    b = bursts(e, "user_id", "30 minutes")
    return b.select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("last").alias("last"), "n")


QUERIES = {f.__name__: f for f in (index_changes, event_bursts)}
ORACLE_SQL = {
    "index_changes": f"""WITH {A.FILES_CTE}, k AS (SELECT *, concat(path, '#', file_id) AS p FROM files), s AS (SELECT * FROM k WHERE file_id % 17 <> 1),
n AS (SELECT p, size, CASE WHEN file_id % 23 = 3 THEN mtime + 60 ELSE mtime END AS mtime FROM k WHERE file_id % 19 <> 2)
SELECT coalesce(n.p, s.p) AS path, CASE WHEN s.p IS NULL THEN 'new' WHEN n.p IS NULL THEN 'vanished' WHEN s.size <> n.size OR abs(s.mtime - n.mtime) > 1e-6 OR status = 'pending' THEN 'changed'
  WHEN status = 'error' AND file_id % 5 < 3 AND file_id % 12 >= (CASE WHEN file_id % 5 <= 1 THEN 1 ELSE 7 END) THEN 'retry' ELSE 'unchanged' END AS change FROM s FULL OUTER JOIN n ON s.p = n.p""",
    "event_bursts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM g) SELECT user_id, epoch_us(min(ts)) AS since, epoch_us(max(ts)) AS last, count(*) AS n FROM b GROUP BY user_id, b""",
}
