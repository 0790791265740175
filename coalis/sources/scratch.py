"""Written intermediate tables in the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster, where a session without it is an error.
Only in local mode, where one machine runs everything, is a temporary folder used instead.  A written table survives the loss of any
executor and cuts the lineage of iterative plans.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ship

#: The shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="coalis-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


_roots: dict[str, "Scratch"] = {}


def close_all() -> None:
    """Delete every scratch folder of this process; results that still read them end."""
    while _roots:
        try:
            _roots.popitem()[1].close()
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


atexit.register(close_all)


@contextmanager
def released(spark: SparkSession):
    """Queries planned and run inside leave no shuffle files behind."""
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


class Scratch:
    """One job's folder of written tables.

    ``write`` stores a plan and returns it as a scan; ``drop`` removes tables that no
    later plan reads.  What a returned lazy result still reads stays on disk until the
    folder is removed by ``close``, :func:`close_all` or the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/coalis-{name}-{uuid.uuid4().hex[:12]}"
        _roots[self.root] = self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with released(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        _roots.pop(self.root, None)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows a side may have to be broadcast; beyond it the join is left to shuffle.
BROADCAST_ROWS = 100_000


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``max_rows`` rows.

    The proof is a count that stops after ``max_rows + 1`` rows.  A larger side is
    returned unchanged and joins by shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
