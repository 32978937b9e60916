"""Where intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the folder that the cluster names in spark.checkpoint.dir; one machine's
    tests, which name none, get a temporary folder. A cluster that names none is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") and not sc.getConf().get("spark.checkpoint.dir", None):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


def clean(spark: SparkSession) -> bool:
    """Remove this application's checkpoints, and say whether there were any. Results that have not been
    read or saved yet need them, so the caller says when; later ones make the folder anew."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if not folder:
        return False
    fs = sc._jvm.org.apache.hadoop.fs
    path = fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    parts = list(files.listStatus(path)) if files.exists(path) else []
    return any([files.delete(p.getPath(), True) for p in parts])
