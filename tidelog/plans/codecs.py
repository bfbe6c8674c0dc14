"""Bytes of a log under each Parquet codec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scratch


def sizes(log: DataFrame, codecs: tuple[str, ...] = ("none", "snappy", "zstd")) -> DataFrame:
    """codec, bytes, ratio to none. Files go to the folder that the cluster shares and are deleted again."""
    spark = log.sparkSession
    found = {}
    for codec in codecs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "codec"))
        log.write.option("compression", codec).parquet(path.toString())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found[codec] = fs.getContentSummary(path).getLength()
        fs.delete(path, True)
    rows = [(c, n, round(n / max(1, found[codecs[0]]), 4)) for c, n in found.items()]
    return spark.createDataFrame(rows, "codec string, bytes long, ratio double").orderBy(F.col("bytes"))
