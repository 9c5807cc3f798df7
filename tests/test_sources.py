"""Result folders that grow run by run, and folders of pictures as a table and as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from curvetrail.operators import tables
from curvetrail.sources import clips, runs


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_runs_resume(spark, tmp_path, monkeypatch, kind):
    """A run that is killed before its commit does not count; the next one ends with the tables of an undisturbed run."""
    rows = spark.createDataFrame([(v, i, v * 0.5) for v in range(1, 40) for i in range(v % 4)], "video_id long, i long, score double")
    folder = runs.ResultFolder(spark, str(tmp_path / "r"), kind, buckets=8)
    assert folder.read() is None and folder.done().count() == 0
    assert folder.add(rows, rows.where("video_id < 10")) == 7  # videos without rows are not in this list of videos
    every = spark.range(1, 40).withColumnRenamed("id", "video_id")
    real = runs.ResultFolder._commit
    monkeypatch.setattr(runs.ResultFolder, "_commit", lambda self, entry: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        folder.add(rows.where("video_id < 25"), every.where("video_id < 25"))
    kept = folder.read().collect()
    assert {r.video_id for r in kept} == {r.video_id for r in rows.where("video_id < 10").collect()} and folder.done().count() == 7
    monkeypatch.setattr(runs.ResultFolder, "_commit", real)
    assert folder.add(rows, every) == 39 - 7
    assert sorted(map(tuple, folder.read().select("video_id", "i", "score").collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(r.video_id for r in folder.done().collect()) == list(range(1, 40))
    assert folder.add(rows, every) == 0 and len(folder.commits()) == 2
    # a video without rows is done as well, and nobody commits a number twice
    with pytest.raises(Exception):
        folder._commit({"run": 0, "buckets": [], "schema": "video_id long"})


def picture_tree(root):
    for clip, names in {"a_1": ["f_10.jpg", "f_2.JPG", "notes.txt"], "b_2": ["x.png", "y7.png"], "c_3": [], "d 4": ["3.webp", "03.bmp"]}.items():
        os.makedirs(root / clip)
        for n in names:
            (root / clip / n).write_bytes(b"")
    (root / "labels.txt").write_text("# name total first last\na_1 12 9 5\nb_2 4\nbroken 1 2\na_1 12 3 11 -1 -1\n")


def test_clips(spark, tmp_path):
    clips.register(spark)
    picture_tree(tmp_path)
    df = spark.read.format("clips").option("labels", str(tmp_path / "labels.txt")).load(str(tmp_path))
    got = sorted((r.video_id, r.pos, r.frame_id, os.path.basename(r.path), r.label) for r in df.collect())
    assert got == [("a_1", 0, 2, "f_2.JPG", 0), ("a_1", 1, 10, "f_10.jpg", 1), ("b_2", 0, 0, "y7.png", 0), ("b_2", 1, 1, "x.png", 0), ("d 4", 0, 0, "03.bmp", None), ("d 4", 1, 1, "3.webp", None)]
    one = df.where("video_id = 'a_1' and frame_id > 5")
    assert one.rdd.getNumPartitions() == 1 and [r.frame_id for r in one.collect()] == [10]
    two = df.where(F.col("video_id").isin("a_1", "b_2", "zz"))
    assert two.rdd.getNumPartitions() == 2 and two.count() == 4
    os.makedirs(tmp_path / "none")
    assert spark.read.format("clips").load(str(tmp_path / "none")).count() == 0
    assert spark.read.format("clips").load("file://" + str(tmp_path)).count() == 6


def test_clips_as_a_stream(spark, tmp_path):
    """Clips come in once they are complete, each once, across restarts of the query."""
    clips.register(spark)
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def put(name, done=True):
        os.makedirs(root / name, exist_ok=True)
        (root / name / "1.jpg").write_bytes(b"")
        if done:
            (root / name / "_DONE").write_bytes(b"")

    def run():
        stream = spark.readStream.format("clips").option("marker", "_DONE").load(str(root))
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.video_id for r in spark.read.parquet(out).collect())

    put("2024-01")
    put("2024-02")
    put("2024-03", done=False)
    assert run() == ["2024-01", "2024-02"]
    put("2024-03")
    put("2024-04")
    assert run() == ["2024-01", "2024-02", "2024-03", "2024-04"]


def test_table_functions(spark):
    tables.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM key_frames(5, 5, NULL, 9)").collect()] == [(0, 5), (1, 9)]
    df = spark.createDataFrame([(1, 0, 2, 4, 8), (1, 8, 9, 9, 12), (2, 8, 8, 8, 8), (1, 3, 4, None, 5)], "video_id long, start_frame long, middle_frame long, peak_frame long, end_frame long")
    got = spark.sql("SELECT * FROM numbered_key_frames(TABLE({t}) PARTITION BY video_id ORDER BY start_frame)", t=df).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 0), (1, 1, 1, 2), (1, 1, 2, 4), (1, 1, 3, 8), (1, 2, 0, 3), (1, 2, 2, 5), (1, 3, 1, 9), (1, 3, 2, 12), (2, 1, 0, 8)]
