"""Tables and files that the operators keep between jobs, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from vellum.session import ship

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where it is unset, a local session gets a folder of its own."""
    named = spark.conf.get(_SETTING, None) or _own.get(spark.sparkContext.applicationId)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    made = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="vellum-shared-")
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what an operator kept; nothing happens once the session is gone."""
    try:
        system, target = _file_system(spark, path)
        system.delete(target, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner cleans it
        return


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at `path`, on any store that Spark reads."""
    system, target = _file_system(spark, path)
    return bool(system.exists(target))


def folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths of what matches `pattern` in the folder `path`."""
    system, target = _file_system(spark, f"{path}/{pattern}")
    return [str(f.getPath().toString()) for f in system.globStatus(target) or []]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once.  Spark's own 64 MB take several times that, in the JVM (outside
#: the heap, in buffers that double) and in the worker, for each task that runs.
BATCH_BYTES = 8_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches small: the session's own limit stays where it is lower."""
    ship(spark)
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(_BATCH))))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Input bytes for one partition of a shuffle whose number of partitions an operator has to name; and the most of them.
SHUFFLE_BYTES, MAX_PARTITIONS = 32_000_000, 100_000


def partitions(spark: SparkSession, rows: DataFrame, times: int = 1) -> int:
    """Partitions for a shuffle of about `times` what `rows` holds: the session's number, or more where that is little.

    `rows` is a stored table: of a join Spark's estimate is the product of both sides.  Where Spark does not know the
    size of what it reads (its guess is near the largest long), the session's number."""
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return partitions_of(spark, 0 if estimate >= 1 << 60 else times * estimate)


def partitions_of(spark: SparkSession, size: int) -> int:
    """Partitions for a shuffle of `size` bytes: the session's number, or more where that is little."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(-(-size // SHUFFLE_BYTES), MAX_PARTITIONS))
