"""Intermediate tables in the folder that all executors share, and sizes for shuffles."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_leftovers: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, a temporary one on a local master, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return sc.getCheckpointDir()


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores added until no column has it (names differ regardless of case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one Arrow batch of texts: keeps what the JVM and a Python worker hold of them to a few MB.
BATCH_ROWS = 1_000


def text_batches(docs: DataFrame) -> DataFrame:
    """The same table; its session then sends texts to Python in batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


class Stored:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        _leftovers.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        if self in _leftovers:
            _leftovers.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the table to the shared folder and reads it back."""
    return Stored(df, name).df


@atexit.register
def drop_stored() -> None:
    """Deletes all tables stored so far; results that were not written elsewhere can't be read any more. Runs at exit, long sessions may call it."""
    for t in list(_leftovers):
        try:
            t.drop()
        except Exception:  # the session may have ended already
            return


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (file sizes for a scan); no job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else df.rdd.getNumPartitions() << 24


#: Tasks of one exchange at most; with more buckets, a task takes several, one after the other.
MAX_TASKS = 20_000


def dealt(df: DataFrame, buckets: int, column: str = "bucket") -> DataFrame:
    """The table with each bucket in the task of its number, so that tasks grow in number with the input and not in size."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(max(floor, min(buckets, MAX_TASKS)), F.col(column).cast("int"))


def buckets_for(df: DataFrame, mb: float) -> int:
    """How many hash buckets keep one of them near ``mb`` MB of input, never fewer than the session's shuffle partitions."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, int(plan_bytes(df) / (mb * 1e6)) + 1)
