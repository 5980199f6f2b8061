"""Tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder of ``spark.checkpoint.dir`` (a new temporary one where it is unset, as in tests).

    Later steps read them instead of working them out again, also after executors are lost, and Spark's skew join can
    divide them where a join needs it.  They stay until the folder's owner clears it.
    """
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, by: str) -> DataFrame:
    """The rows dealt by hash, for work that costs more than a shuffle: a file of one row group is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), by)
