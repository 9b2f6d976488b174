"""Session builder for local use, and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lapsewise")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="lapsewise-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a cut that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark can reach; none there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


RELEASE_EVERY = 4


class Scratch:
    """Working tables of one operator, each removed after its last reader.

    write() cuts lineage like materialise(). drop() removes tables that only tables
    already written were made from; what a result is still to be read from stays. Many
    small jobs leave the driver much garbage: it is collected every RELEASE_EVERY tables.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._writes = 0

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = scratch_path(self._spark, name)
        df.write.options(**options).parquet(path)
        table = self._spark.read.parquet(path)
        self._paths[id(table)] = (table, path)
        self._writes += 1
        if self._writes % RELEASE_EVERY == 0:
            self.release()
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table))
            remove_folder(self._spark, path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now. It does so when the
        driver collects the plans that made them, by default every half hour."""
        gc.collect()
        self._spark._jvm.System.gc()
