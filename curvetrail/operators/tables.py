"""Table functions that SQL can call.

key_frames(start, middle, peak, end), for each row of a LATERAL join: the key frames of a span, each once, in order.
numbered_key_frames(TABLE(spans) PARTITION BY video_id ORDER BY start_frame): the same for whole tables of (video_id,
start_frame, middle_frame, peak_frame, end_frame), with spans numbered within their video and frames that an earlier span
of the video has shown left out. A task holds one partition's frames shown so far, that is at most four numbers a span.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


def distinct_frames(*frames: int | None) -> list[int]:
    """Each frame once, in the order given; nulls are none."""
    return [f for f in dict.fromkeys(frames) if f is not None]


@udtf(returnType="pos long, frame_id long", useArrow=False)
class KeyFrames:
    def eval(self, start: int, middle: int, peak: int, end: int) -> Iterator[tuple]:
        yield from enumerate(distinct_frames(start, middle, peak, end))


@udtf(returnType="video_id long, span_no long, pos long, frame_id long", useArrow=False)
class NumberedKeyFrames:
    def __init__(self):
        self.spans, self.shown = 0, set()

    def eval(self, row: Row) -> Iterator[tuple]:
        self.spans += 1
        for pos, frame in enumerate(distinct_frames(row["start_frame"], row["middle_frame"], row["peak_frame"], row["end_frame"])):
            if frame not in self.shown:
                self.shown.add(frame)
                yield row["video_id"], self.spans, pos, frame


def register(spark: SparkSession) -> None:
    spark.udtf.register("key_frames", KeyFrames)
    spark.udtf.register("numbered_key_frames", NumberedKeyFrames)
