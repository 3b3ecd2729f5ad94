"""Session settings, staged tables and small helpers that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS = 256
_staged: list[Staged] = []


def settle(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of Python operators by rows and bytes, and free a job's shuffle files when it ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of our own only on a local master without one.

    Elsewhere a missing setting is an error: executors would write where nobody reads."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusql-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its shared folder goes with the job
        pass


class Staged:
    """A table written to the shared folder: it cuts lineage and survives lost executors.

    ``df`` reads it. ``drop()`` removes it once nothing reads it any more; what is left goes at exit."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/corpusql-{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)
        _staged.append(self)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self in _staged:
            _staged.remove(self)
            _remove(self.spark, self.path)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def staged() -> list[Staged]:
    """What is staged now, for drop_since."""
    return list(_staged)


def drop_since(before: list[Staged], *keep: Staged) -> None:
    """Remove the tables staged since ``before`` was taken, but for those to keep."""
    for s in [s for s in _staged if s not in before and s not in keep]:
        s.drop()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@atexit.register
def _clean() -> None:
    for s in list(_staged):
        if getattr(s.spark.sparkContext, "_jsc", None) is not None:
            s.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
