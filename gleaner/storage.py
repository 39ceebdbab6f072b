"""Tables in the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that were written in a session, by application and name.
_written: dict[tuple[str, str], str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one in /tmp only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/gleaner-work"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _at_exit(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the session's JVM ends."""
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    return path


#: Files of a folder that are listed from the driver; more are listed as a Spark job.
LISTED = 500


def state(spark: SparkSession, *paths: str) -> str:
    """The files of paths by name, length and time of their last change: another string when one is overwritten."""
    out = []
    for path in paths:
        fs, p = _file(spark, path)
        files = fs.listStatus(p)
        if len(files) <= LISTED:
            out += [f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files]
        else:
            listed = spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
            out.append("{}:{}".format(*listed.agg(F.count("*"), F.sum("h")).first()))
    return ",".join(sorted(out))


#: Setting that removes a query's shuffle files when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Setting of the bytes after which an Arrow batch for Python ends.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, what is written leaves no shuffle files: nothing reads them again."""
    return _set(spark, FREE, "true")


def batches_of(spark: SparkSession, size: str) -> AbstractContextManager[None]:
    """Inside, what is written goes to Python in batches of about size."""
    return _set(spark, BATCH, size)


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the shared folder, with the writer's options: a cut of its lineage that survives executors."""
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(_at_exit(df.sparkSession, path))


def warm(spark: SparkSession, name: str, make: Callable[[str], None], *sources: str) -> str:
    """The folder that make fills, once a session for one state of the files of sources; whoever asks again gets it."""
    key = (spark.sparkContext.applicationId, f"{name} {sources} {state(spark, *sources)}")
    if key not in _written:
        path = f"{work_dir(spark)}/warm-{uuid.uuid4().hex}"
        with freed(spark):
            make(path)
        _written[key] = _at_exit(spark, path)
    return _written[key]


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files, a few that can't be split, would leave most of them idle; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
