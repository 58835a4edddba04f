"""Where jobs keep tables between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: For tables of whole documents, where small files count most.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    The setting is the cluster's.  A local session without it gets a folder in its warehouse;
    on a cluster a machine's own disk cannot be read by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/lintlake-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The rows written as a table and read back: computed once, safe from lost executors."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of tables that nothing reads any more; one that is gone is passed over."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
