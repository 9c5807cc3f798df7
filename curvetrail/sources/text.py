"""Manifests, interval labels and frame listings as DataFrames of lines or paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What counts as a picture, and the endings tried for a video without one.
PICTURES = ["jpg", "jpeg", "png", "bmp", "webp"]
VIDEO_ENDINGS = [".mp4", ".avi", ".mov", ".mkv", ".webm"]

PAIRS = "array<struct<s:bigint,e:bigint>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of a small text file; a file is read whole so that its lines keep their order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n"))).select((F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def _text(lines: DataFrame) -> DataFrame:
    t = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    return lines.withColumn("text", t).where((F.col("text") != "") & ~F.col("text").startswith("#"))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def sanitize_name(name: Column, default: str = "video") -> Column:
    safe = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(default))


def manifest_items(lines: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """line_no, video_id, path, exists. lines: line_no, line; files: path. The first word of a line is a path below
    root (or absolute); without an ending, those of videos are tried in turn, the first that there is wins."""
    t = _text(lines).withColumn("token", F.regexp_extract("text", r"^(\S+)", 1))
    base = F.when(F.col("token").startswith("/"), F.col("token")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "token"))
    has_ending = base.rlike(r"/[^/]+\.[^/.]+$")
    tries = F.when(has_ending, F.array(base)).otherwise(F.array(base, *[F.concat(base, F.lit(x)) for x in VIDEO_ENDINGS]))
    t = t.withColumn("base", base).select("line_no", "base", F.posexplode(tries).alias("nth", "path"))
    found = t.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    best = found.groupBy("line_no", "base").agg(F.min_by("path", F.when(F.col("there"), F.col("nth"))).alias("path"))
    out = best.withColumns({"exists": F.col("path").isNotNull(), "path": F.coalesce("path", "base")})
    return out.select("line_no", file_stem(F.col("path")).alias("video_id"), "path", "exists")


def require_existing(items: DataFrame) -> DataFrame:
    """Fails on the first line whose source is missing."""
    bad = F.concat(F.lit("manifest line "), F.col("line_no").cast("string"), F.lit(": no such source: "), F.col("path"))
    return items.withColumn("path", F.when(F.col("exists"), F.col("path")).otherwise(F.raise_error(bad).cast("string")))


def _ordered(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(F.least(p["s"], p["e"]).alias("s"), F.greatest(p["s"], p["e"]).alias("e")))


def interval_token(token: Column) -> Column:
    """[[a,b],...] or 10-20,40-55 as an array of ordered (s, e)."""
    token = F.trim(token)
    json = F.filter(F.from_json(token, "array<array<bigint>>"), lambda p: F.size(p) == 2)
    from_json = F.transform(json, lambda p: F.struct(p[0].alias("s"), p[1].alias("e")))
    parts = F.filter(F.transform(F.split(token, ","), lambda x: F.trim(x)), lambda x: x.contains("-"))
    cut = lambda x, g: F.trim(F.regexp_extract(x, r"^([^-]*)-(.*)$", g)).cast("bigint")
    plain = F.transform(parts, lambda x: F.struct(cut(x, 1).alias("s"), cut(x, 2).alias("e")))
    return _ordered(F.when(token.startswith("["), from_json).when(token == "", F.array().cast(PAIRS)).otherwise(plain))


def _number_pairs(tokens: Column) -> Column:
    numbers = F.transform(tokens, lambda x: x.try_cast("bigint"))
    half = F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1)
    pairs = F.transform(half, lambda i: F.struct(F.element_at(numbers, i * 2 + 1).alias("s"), F.element_at(numbers, i * 2 + 2).alias("e")))
    return _ordered(F.when(F.size(numbers) >= 2, pairs).otherwise(F.array().cast(PAIRS)))


def gt_manifest(lines: DataFrame, frames_root: str = "frames") -> DataFrame:
    """line_no, video_id, frame_source, total_frames, intervals of each line: a JSON object, id total s e ..., or
    path<TAB>intervals. An odd count of interval numbers fails."""
    t = _text(lines)
    text = F.col("text")
    j = F.from_json(text, "video_id string, frame_dir string, frame_source string, total_frames string, gt_intervals string")
    is_json = text.startswith("{")
    words = F.split(text, r"\s+")
    whole = F.forall(F.slice(words, 2, F.size(words)), lambda x: x.rlike(r"^[+-]?[0-9]+$"))
    is_id = ~is_json & (F.size(words) >= 2) & words[0].rlike(r"^[A-Za-z0-9_.-]+$") & whole
    odd = F.raise_error(F.concat(F.lit("odd count of interval numbers: "), text)).cast(PAIRS)
    tabs = F.filter(F.transform(F.split(text, "\t"), lambda x: F.trim(x)), lambda x: x != "")
    source = F.nullif(F.trim(F.coalesce(j["frame_dir"], j["frame_source"])), F.lit(""))
    source = F.coalesce(source, F.raise_error(F.lit("a line without frame_dir or frame_source")).cast("string"))
    from_json = _ordered(F.transform(F.filter(F.from_json(j["gt_intervals"], "array<array<bigint>>"), lambda p: F.size(p) == 2), lambda p: F.struct(p[0].alias("s"), p[1].alias("e"))))
    none = F.array().cast(PAIRS)
    id_pairs = F.when(F.size(words) % 2 == 1, odd).otherwise(_number_pairs(F.slice(words, 3, F.size(words))))
    return t.select(
        "line_no",
        F.when(is_json, F.coalesce(F.nullif(j["video_id"], F.lit("")), file_stem(source))).when(is_id, words[0]).otherwise(file_stem(tabs[0])).alias("video_id"),
        F.when(is_json, source).when(is_id, F.concat(F.lit(frames_root.rstrip("/") + "/"), words[0])).otherwise(tabs[0]).alias("frame_source"),
        F.when(is_json, F.when(j["total_frames"].rlike("^[0-9]+$"), j["total_frames"].cast("bigint")).otherwise(F.lit(0))).when(is_id, words[1].try_cast("bigint")).otherwise(F.lit(0)).cast("bigint").alias("total_frames"),
        F.coalesce(F.when(is_json, from_json).when(is_id, id_pairs).otherwise(F.when(F.size(tabs) > 1, interval_token(F.get(tabs, F.lit(1)))).otherwise(none)), none).alias("intervals"),
    )


def gt_lookup(lines: DataFrame) -> DataFrame:
    """The lenient reading: of each id the first line, all whole numbers from the third word on in pairs, -1 -1 kept."""
    t = _text(lines)
    words = F.split("text", r"\s+")
    first = t.withColumn("video_id", words[0]).groupBy("video_id").agg(F.min_by("text", "line_no").alias("text"))
    words = F.split("text", r"\s+")
    numbers = F.filter(F.slice(words, 3, F.size(words)), lambda x: x.rlike(r"^-?[0-9]+$"))
    return first.select("video_id", _number_pairs(numbers).alias("intervals"))


def intervals_long(items: DataFrame, *keep: str) -> DataFrame:
    return items.select("video_id", *keep, F.posexplode("intervals").alias("pos", "p")).select("video_id", *keep, (F.col("pos") + 1).cast("long").alias("interval_no"), F.col("p.s").alias("s"), F.col("p.e").alias("e"))


def read_labels(lines: DataFrame) -> DataFrame:
    """video_id, total_frames, intervals; malformed lines are passed over, of an id's lines the last counts."""
    t = _text(lines)
    words = F.split("text", r"\s+")
    fine = (F.size(words) >= 2) & (F.size(words) % 2 == 0) & F.forall(F.slice(words, 2, F.size(words)), lambda x: x.rlike(r"^[+-]?[0-9]+$"))
    t = t.where(fine).select("line_no", words[0].alias("video_id"), words[1].cast("bigint").alias("total_frames"), _number_pairs(F.slice(words, 3, F.size(words))).alias("intervals"))
    return t.groupBy("video_id").agg(F.max_by(F.struct("total_frames", "intervals"), "line_no").alias("r")).select("video_id", "r.total_frames", "r.intervals")


def label_lines(labels: DataFrame) -> DataFrame:
    """Labels as lines of text."""
    pairs = F.transform("intervals", lambda p: F.concat_ws(" ", p["s"].cast("string"), p["e"].cast("string")))
    return labels.select("video_id", F.concat_ws(" ", F.col("video_id"), F.col("total_frames").cast("string"), F.array_join(pairs, " ")).alias("line")).withColumn("line", F.rtrim("line"))


def write_labels(labels: DataFrame, order: DataFrame, path: str) -> None:
    """Lines in the order of order (video_id, ord); ids that it lacks are left out."""
    label_lines(labels).join(order, "video_id").orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def list_pictures(files: DataFrame) -> DataFrame:
    """path, stem, num of picture files, in order: those with a number at the end by it, then the others by name.
    frame_id is that number if all files have one and they differ, else the place in the order."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    p = files.withColumns({"name": name, "stem": file_stem(F.col("path"))}).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(PICTURES))
    p = p.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    p = p.withColumn("num", F.regexp_extract("stem", r"([0-9]+)$", 1).try_cast("bigint"))
    w = W.partitionBy("folder")
    order = W.partitionBy("folder").orderBy(F.col("num").isNull(), "num", F.when(F.col("num").isNull(), F.col("stem")), "name")
    all_numbered = (F.count_if(F.col("num").isNull()).over(w) == 0) & (F.size(F.collect_set("num").over(w)) == F.count("*").over(w))
    place = F.row_number().over(order).cast("long") - 1
    return p.withColumns({"pos": place, "frame_id": F.when(all_numbered, F.col("num")).otherwise(place)}).select("folder", "path", "stem", "pos", "frame_id")


def listed_pictures(lines: DataFrame, parent: str, files: DataFrame) -> DataFrame:
    """The picture files that a list names, relative to the list's folder."""
    t = _text(lines)
    path = F.when(F.col("text").startswith("/"), F.col("text")).otherwise(F.concat(F.lit(parent.rstrip("/") + "/"), "text"))
    return list_pictures(t.select(path.alias("path")).join(files.select("path"), "path", "left_semi"))


def digits_frame_id(path: Column) -> Column:
    """All digits of the stem as one number, -1 without any."""
    return F.coalesce(F.regexp_replace(file_stem(path), "[^0-9]", "").try_cast("bigint"), F.lit(-1))


def natural_key(path: Column) -> Column:
    """Sorts digit runs as numbers: runs padded with zeros to 20 digits, text in lower case. A longer number has a colon,
    which follows 9, and its length before it."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    long = lambda x: F.concat(F.lit(":"), F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))
    number = lambda x: F.when(F.length(bare(x)) > 20, long(x)).otherwise(F.lpad(bare(x), 20, "0"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), number(x)).otherwise(x)), "")


def source_kind(path: Column) -> Column:
    """pictures for a folder or a list, else video."""
    return F.when(F.lower(path).rlike(r"\.(txt|lst)$") | ~path.rlike(r"\.[^./]+$"), "pictures").otherwise("video")


def resume(items: DataFrame, done: DataFrame, most: int = 0, key: str = "video_id") -> DataFrame:
    """Items that are not done yet; the first `most` by key if positive."""
    left = items.join(done.select(key).distinct(), key, "left_anti")
    return left.orderBy(key).limit(most) if most > 0 else left
