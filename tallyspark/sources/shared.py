"""Tables in the folder that driver and executors share: written once, read again, so nothing before them runs twice."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets one of our own."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        context.setCheckpointDir(given)
    return given.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends, or by ``remove``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _file(spark, path)
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``own_folder``, once nothing is read from it any more."""
    where, files = _file(spark, path)
    files.delete(where, True)


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Spark's setting: what a finished query shuffled is deleted at once, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """For writing rows that are read from storage from then on: their shuffles' files go with the end of the job."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stored(df: DataFrame, name: str, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read from there: cuts lineage, survives lost executors.
    A filter on the columns ``by`` reads no other folders."""
    path = path or own_folder(df.sparkSession, f"tables/{name}")
    with freed(df.sparkSession):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored or held tables that go together, once what was made of them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables, self.frames = spark, [], [], []

    def stored(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        self.paths.append(own_folder(self.spark, f"tables/{name}"))
        return stored(df, name, self.paths[-1], by)

    def held(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` kept on the executors' disks: no files of their own, however many tasks make them. A lost
        executor's rows are made again, so the stored tables that they come from must stay as long; these have paths of
        their own, so no other run's rows are taken for them."""
        self.frames.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return df

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """The rows of ``df`` stored in buckets of a key: tables with as many buckets join on it without an exchange."""
        path = own_folder(self.spark, f"tables/{name}")
        table = f"{name}_{path.rpartition('-')[2]}"
        self.paths.append(path)
        self.tables.append(table)
        with freed(self.spark):
            df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def take(self, other: Scratch) -> None:
        """The tables of another one, from now on cleared with these."""
        self.paths += other.paths
        self.tables += other.tables
        self.frames += other.frames

    def clear(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []
        for df in reversed(self.frames):
            df.unpersist()
        self.frames = []
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
