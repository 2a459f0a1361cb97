"""Tables of a data folder and scratch space that every executor can reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, tuple[SparkSession, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = spark, "file://" + tempfile.mkdtemp(prefix="fernwake-")
    return _own[app][1]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Removes all scratch tables of the session, once no result that reads them is needed any more."""
    for owner, path in [m for m in _made if m[0] is spark]:
        _delete(owner, path)
        _made.remove((owner, path))


@atexit.register
def _sweep() -> None:
    for spark, path in [*_made, *[(s, p) for s, p in _own.values()]]:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            pass


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation.

    ``keep`` writes a DataFrame and reads it back; ``drop`` removes one that is no longer read.
    What is left is removed by ``sweep``, or when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.made = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", {}
        _made.append((spark, self.root))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.made)}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(back)] = (path, back)
        return back

    def put(self, df: DataFrame, name: str, *by: str) -> str:
        """Writes ``df`` with a folder for each value of ``by``; the path, for tasks that read single folders."""
        path = f"{self.root}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return path

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path, _ = self.made[id(df)]
            _delete(self.spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows (counted now), else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
