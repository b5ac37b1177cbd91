"""Tables written once to the folder that all machines share: they cut a plan and outlive a lost executor.

The folder is `spark.checkpoint.dir`.  Where that is unset, local mode uses a folder of its own below the warehouse;
on a cluster it is an error.  What a driver process has written and not dropped goes when the process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/driftframe-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df from a table of its own in the shared folder; options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    context = spark.sparkContext._jsc
    conf = context.hadoopConfiguration() if context is not None else spark._jvm.org.apache.hadoop.conf.Configuration()
    return hadoop.getFileSystem(conf), hadoop


def remove(spark: SparkSession, path: str) -> None:
    files, hadoop = _hadoop(spark, path)
    files.delete(hadoop, True)
    _tables.pop(path, None)


def keep(path: str) -> None:
    """Leaves a table, or a folder of them, where it is at the end of the process."""
    for known in [p for p in _tables if p == path or p.startswith(path + "/")]:
        del _tables[known]


def drop(df: DataFrame) -> None:
    """Removes a table of written() that no plan needs any more."""
    remove(df.sparkSession, df._written_path)


def bytes_of(df: DataFrame) -> int:
    files, hadoop = _hadoop(df.sparkSession, df._written_path)
    return files.getContentSummary(hadoop).getLength()


def mark() -> set[str]:
    """The tables there are now."""
    return set(_tables)


def drop_since(before: set[str], *but: DataFrame) -> None:
    """Removes the tables written since mark(), but for some."""
    stay = {df._written_path for df in but}
    for path, spark in list(_tables.items()):
        if path not in before and path not in stay:
            remove(spark, path)


@atexit.register
def _end() -> None:
    for path, spark in list(_tables.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM has gone before
            return
