"""Results of a long plan's steps as tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once, so that what follows reads it instead of planning and computing it again, and a lost executor
    loses nothing. The folder is spark.checkpoint.dir; where that is unset, a temporary one for a local master, and an
    error on a cluster, whose machines would each have their own."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="curvetrail-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of staged() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        root = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/").split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if root and folder.split(":", 1)[-1].lstrip("/").startswith(root):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
