"""Results that grow run by run, so that a run that was killed is resumed without doing its finished part again.

A result folder has rows/bucket=.../run=... (rows, by bucket of videos), videos/run=... (which videos a run covers, those
without rows too) and commits/ (a file a run, renamed into place when all else is written). What no commit names does not
count: readers pass over it, and the next run, which takes the same number, overwrites it partition by partition.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEY = "video_id"


class ResultFolder:
    """The committed runs of a result, in any file system that Spark reaches. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet", buckets: int = BUCKETS):
        self.spark, self.path, self.kind, self.buckets = spark, path.rstrip("/"), kind, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """What each committed run says of itself: run, buckets, schema; at most a file a run is read."""
        folder, fs = self._file("commits")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        lines = self.spark.read.text([f"{self.path}/commits/{n}" for n in names]).collect() if names else []
        return sorted((json.loads(r.value) for r in lines), key=lambda c: c["run"])

    def _commit(self, entry: dict) -> None:
        """The file appears whole or not at all."""
        hidden, fs = self._file(f"commits/.run-{entry['run']:06d}.tmp")
        final, _ = self._file(f"commits/run-{entry['run']:06d}.json")
        out = fs.create(hidden, True)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        if not fs.rename(hidden, final):
            raise OSError(f"run {entry['run']} is committed already")

    def done(self) -> DataFrame:
        """The videos of committed runs."""
        runs = [c["run"] for c in self.commits()]
        if not runs:
            return self.spark.createDataFrame([], f"{KEY} long")
        return self.spark.read.parquet(*[f"{self.path}/videos/run={n}" for n in runs])

    def read(self) -> DataFrame | None:
        """Rows of committed runs; None before the first. Only their partitions are listed and read."""
        commits = self.commits()
        folders = [f"{self.path}/rows/bucket={b}/run={c['run']}" for c in commits for b in c["buckets"]]
        if not commits:
            return None
        schema = commits[-1]["schema"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(self.kind).load(folders)

    def add(self, rows: DataFrame, videos: DataFrame) -> int:
        """Writes the rows of those videos that no committed run has, and commits them as a run of their own. Gives the
        number of videos written. rows has a column video_id; rows of other videos are left out."""
        new = videos.select(KEY).distinct().join(self.done(), KEY, "left_anti")
        run = len(self.commits())
        new.write.mode("overwrite").parquet(f"{self.path}/videos/run={run}")
        new = self.spark.read.parquet(f"{self.path}/videos/run={run}")
        count = new.count()
        if not count:
            return 0
        bucket = F.pmod(F.xxhash64(KEY), F.lit(self.buckets)).alias("bucket")
        out = rows.join(new, KEY, "left_semi").select("*", bucket, F.lit(run).alias("run"))
        # a task has whole buckets, so a bucket gets few files; partitions of a killed run with this number are replaced
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").format(self.kind).save(f"{self.path}/rows")
        kept = new.join(rows.select(KEY).distinct(), KEY, "left_semi").select(bucket).distinct()
        self._commit({"run": run, "videos": count, "buckets": sorted(r.bucket for r in kept.collect()), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)})
        return count
