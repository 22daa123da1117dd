"""Session, shared-folder and table helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import inkwell

# Functions that run in Python workers travel by value: an executor needs no copy of this package.
cloudpickle.register_pickle_by_value(inkwell)

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none (tests, local mode) one is made on this machine, and removed
    when Python ends."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        known = context._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="inkwell-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = "file://" + made
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result no longer depends on the tasks that made it."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


#: Paths that `fresh` has given and `sweep` has not removed.
_WRITTEN: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, which `sweep` removes with all that is in it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """Write `df` as Parquet under the shared folder, in files of at most `most` rows if given, and read it back: a cut that later stages read by column.
    `sweep` removes it."""
    path = fresh(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Remove what was written under the paths of `fresh`, the tables of `stored` above all, once the results that read them are no longer needed; how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def steady(spark: SparkSession) -> SparkSession:
    """Spark 4.1 plans a join over a union wrongly where the parts of the union differ in their number of partitions; without this rule it shuffles again."""
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    except Exception:  # noqa: BLE001 - a version without the setting has not the fault either
        pass
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return steady(spark).read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its input comes in so few splits that most of them would idle, as a small file does; a larger input stays as it is.

    Filters and column pruning still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for: the unit in which hot keys are split."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
