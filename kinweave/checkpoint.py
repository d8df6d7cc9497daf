"""Tables that cut a plan's lineage, in the folder that the cluster shares.

Every executor sees that folder, which ``spark.checkpoint.dir`` names, so a lost executor
costs a retry and never a result. Only on one machine (tests, notebooks), where it may be
unset, a folder of our own is chosen; on a cluster that would lose results without an
error, so there the setting is asked for.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = "file:///tmp/checkpoints/kinweave"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder's name in the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/kinweave-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, tasks can be retried."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` of which no plan is left to be run."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch).getParent()
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
