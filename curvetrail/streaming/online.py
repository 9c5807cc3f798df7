"""Window features and alerts from a stream of observations or scores.

The batch operators are the reference; these keep what a window needs as state, per video, and emit rows as frames
close. A late frame (behind the last one closed) is left out, as the batch order cannot be rebuilt. Motion features of a
stream are those of the batch operators over the new frames and the few before them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curvetrail.config import Motion
from curvetrail.operators.motion import track_features

WINDOW_ROWS = "video_id long, window_id long, start_frame long, end_frame long, mean_score double, max_score double"


def sliding_scores(scores: DataFrame, size: int = 8) -> DataFrame:
    """scores: a stream of (video_id, idx, frame_id, score), frames of a video in order across batches. Emits a row for
    each full window; the state of a video is its last size - 1 frames."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(state.get[0]) if state.exists else [], columns=["idx", "frame_id", "score"])
        new = pd.concat([f[["idx", "frame_id", "score"]] for f in frames])
        if len(held):
            new = new[new["idx"] > held["idx"].iloc[-1]]
        rows = pd.concat([held, new]).sort_values("idx") if len(held) else new.sort_values("idx")
        out = []
        for i in range(size - 1, len(rows)):
            w = rows.iloc[i - size + 1 : i + 1]
            out.append((int(key[0]), int(w["idx"].iloc[0]), int(w["frame_id"].iloc[0]), int(w["frame_id"].iloc[-1]), float(w["score"].mean()), float(w["score"].max())))
        keep = rows.tail(size - 1)
        state.update(([(int(a), int(b), float(c)) for a, b, c in keep.itertuples(index=False)],))
        yield pd.DataFrame(out, columns=["video_id", "window_id", "start_frame", "end_frame", "mean_score", "max_score"])

    return scores.groupBy("video_id").applyInPandasWithState(
        step, WINDOW_ROWS, "held array<struct<idx:bigint,frame_id:bigint,score:double>>", "append", GroupStateTimeout.NoTimeout
    )


#: A frame of a stream: all its objects in one row, an empty list where there are none.
OBJECTS = "array<struct<track_id:bigint,cls_id:bigint,x1:double,y1:double,x2:double,y2:double,area:double,frame_w:double,frame_h:double>>"


def with_context(frames: DataFrame, size: int = 8, late: str = "1 minute", idle: str = "10 minutes") -> DataFrame:
    """frames: a stream of (video_id, idx, frame_id, ts, objects), frames of a video in order across batches. Emits the
    new frames (fresh) with the size - 1 before them, which is all that windows ending on the new ones need. The state of
    a video is these frames as JSON; it goes when event time (ts, with a watermark) has passed its last frame by idle, and
    a video that comes back starts anew."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    names = ["idx", "frame_id", "objects"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(f) for f in json.loads(state.get[0])] if state.exists else []
        parts = list(parts)
        new = [(int(i), int(f), [dict(o) for o in objects]) for part in parts for i, f, objects in part[names].itertuples(index=False)]
        new = sorted((f for f in new if not held or f[0] > held[-1][0]), key=lambda f: f[0])
        last = max(int(part["ts"].max().timestamp() * 1000) for part in parts)
        keep = [*held, *new][-(size - 1) :]
        state.update((json.dumps(keep, default=lambda x: x.item()),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        if new:
            yield pd.DataFrame([(int(key[0]), *f, False) for f in held] + [(int(key[0]), *f, True) for f in new], columns=["video_id", *names, "fresh"])

    return frames.withWatermark("ts", late).groupBy("video_id").applyInPandasWithState(
        step, f"video_id long, idx long, frame_id long, objects {OBJECTS}, fresh boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout
    )


def fresh_features(frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """A batch of with_context() to the motion features of the windows that end on fresh frames, by the batch operators."""
    tracks = frames.select("video_id", "frame_id", F.explode("objects").alias("o")).select("video_id", "frame_id", "o.*")
    ends = frames.where("fresh").select("video_id", F.col("frame_id").alias("end_frame"))
    return track_features(tracks, frames.select("video_id", "idx", "frame_id"), size, cfg).join(ends, ["video_id", "end_frame"], "left_semi")


def motion_stream(frames: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, size: int = 8, cfg: Motion = Motion(), late: str = "1 minute", idle: str = "10 minutes", **trigger) -> StreamingQuery:
    """Starts a query that hands the motion features of each batch of new frames to sink (features, batch number).
    trigger: as for a stream's trigger(), processingTime="10 seconds" where none is given."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sink(fresh_features(batch, size, cfg), number)
        finally:
            batch.unpersist()

    writer = with_context(frames, size, late, idle).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def event_counts(events: DataFrame, length: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean value of events (ts, event_type, value) in sliding windows of event time, late rows cut off by a
    watermark; the state is one row a window and type."""
    w = F.window("ts", length, slide)
    agg = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")
