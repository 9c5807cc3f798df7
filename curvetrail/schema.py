"""Declared schemas of the tables that operators exchange, as DDL (no session is needed to import them)."""

TRACKS = (
    "video_id long, frame_id long, track_id long, cls_id long, x1 double, y1 double, x2 double, y2 double, "
    "cx double, cy double, w double, h double, area double, frame_w double, frame_h double"
)
FRAMES = ("video_id long, idx long, frame_id long")
SCORES = ("video_id long, idx long, frame_id long, score double")
INTERVALS = ("video_id string, total_frames long, interval_no long, s long, e long")
BOXES = "array<struct<track_id:bigint,cls_id:bigint,score:double,x1:double,y1:double,x2:double,y2:double>>"
TRACK_JSON = (
    "video_id long, frame_ids array<long>, tracks_per_frame array<struct<frame_id:bigint,tracks:array<struct<"
    "track_id:bigint,cls_id:bigint,x1:double,y1:double,x2:double,y2:double>>>>"
)
