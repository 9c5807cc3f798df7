"""What a model's free-text answer says: JSON with every field checked. The parsers take a struct of fields as text;
with_answer() reads it from raw answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.functions.geometry import clip01, num

#: The words that answers may use.
RISK_HINTS = ["normal", "possibly_risky", "clearly_risky"]
ANOMALY_HINTS = ["normal", "possibly_abnormal", "clearly_abnormal"]
ANOMALY_TYPES = [
    "collision_like", "dangerous_interaction", "abnormal_stop", "wrong_direction", "possible_overspeed",
    "fire_or_smoke", "road_obstruction", "normal", "unknown",
]


def json_object(raw: Column) -> Column:
    """The text from the first { to the last }; null if there is none or it is no JSON object."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    valid = F.get_json_object(body, "$").isNotNull()
    return F.when((body != "") & valid, body)


def fields_of(body: Column, names: list[str]) -> Column:
    """The named fields as text, null where absent or null."""
    return F.from_json(body, ", ".join(f"`{n}` string" for n in names))


def number(text: Column) -> Column:
    """Text as a double; true and false are 1 and 0, anything else that is no number is null."""
    return F.when(text == "true", num(1)).when(text == "false", num(0)).otherwise(text.try_cast("double"))


def word(text: Column, allowed: list[str], default: str) -> Column:
    return F.when(text.isin(allowed), text).otherwise(F.lit(default))


def texts(text: Column) -> Column:
    """A JSON list's items as text; an empty list where it is no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def truth(text: Column, default: Column) -> Column:
    """A field as a condition: absent takes the default; false, 0, null, empty text, lists and objects are false."""
    return F.when(text.isNull(), default).otherwise(~text.isin("false", "0", "0.0", "", "[]", "{}"))


#: The fields that each kind of answer is read for.
FIELDS = {
    "span_score": ["anomaly_score", "score", "overall_score", "confidence", "reason"],
    "span_stage1": ["scene_summary", "main_objects", "motion_summary", "anomaly_hint", "evidence_tags"],
    "span_stage2": ["anomaly_score", "score", "overall_score", "confidence", "reason", "evidence_tags"],
    "clip_stage1": ["main_objects", "scene_summary", "chunk_descriptions", "noticeable_change", "likely_abnormal_chunks", "risk_hint"],
    "chunk_scores": ["chunk_scores", "abnormal_chunks", "anomaly_type", "overall_score", "confidence", "is_anomaly", "short_reason", "supporting_evidence"],
}


def with_answer(df: DataFrame, raw: str, kind: str, out: str, **options) -> DataFrame:
    """Adds a struct of what the answers in column raw say. The JSON is read once a row: its fields are a column of
    their own before they are checked."""
    df = df.withColumn("_fields", fields_of(json_object(F.col(raw)), FIELDS[kind]))
    return df.withColumn(out, globals()[kind](F.col("_fields"), **options)).drop("_fields")


def span_score(f: Column) -> Column:
    """Struct of anomaly_score, confidence, reason. The score is the first present of three names, default 0; the
    confidence defaults to the score; what is no number is 0; all are held to [0, 1]."""
    given = F.coalesce(f["anomaly_score"], f["score"], f["overall_score"])
    score = clip01(F.coalesce(number(given), num(0)))
    confidence = F.when(f["confidence"].isNull(), score).otherwise(clip01(F.coalesce(number(f["confidence"]), num(0))))
    return F.struct(score.alias("anomaly_score"), confidence.alias("confidence"), F.coalesce(f["reason"], F.lit("")).alias("reason"))


def span_stage1(f: Column) -> Column:
    return F.struct(
        F.coalesce(f["scene_summary"], F.lit("")).alias("scene_summary"), texts(f["main_objects"]).alias("main_objects"),
        F.coalesce(f["motion_summary"], F.lit("")).alias("motion_summary"), word(f["anomaly_hint"], ANOMALY_HINTS, "normal").alias("anomaly_hint"),
        texts(f["evidence_tags"]).alias("evidence_tags"),
    )


def span_stage2(f: Column) -> Column:
    base, tags = span_score(f), texts(f["evidence_tags"])
    return F.struct(base["anomaly_score"].alias("anomaly_score"), base["confidence"].alias("confidence"), base["reason"].alias("reason"), tags.alias("evidence_tags"))


def _padded(items: Column, n: int, fill: Column) -> Column:
    return F.slice(F.concat(items, F.array_repeat(fill, n)), 1, n)


def _chunk_numbers(items: Column, chunks: int) -> Column:
    whole = F.transform(F.filter(items, lambda x: x.rlike(r"^[0-9]+$")), lambda x: x.cast("long"))
    return F.filter(whole, lambda x: (x >= 1) & (x <= chunks))


def clip_stage1(f: Column, chunks: int = 4) -> Column:
    """Struct of a window's description: lists cut or padded to the number of chunks, chunk numbers in range."""
    return F.struct(
        texts(f["main_objects"]).alias("main_objects"), F.coalesce(f["scene_summary"], F.lit("")).alias("scene_summary"),
        _padded(texts(f["chunk_descriptions"]), chunks, F.lit("")).alias("chunk_descriptions"),
        truth(f["noticeable_change"], F.lit(False)).alias("noticeable_change"),
        _chunk_numbers(texts(f["likely_abnormal_chunks"]), chunks).alias("likely_abnormal_chunks"),
        word(f["risk_hint"], RISK_HINTS, "normal").alias("risk_hint"),
    )


def chunk_scores(f: Column, chunks: int = 4) -> Column:
    """Struct of a window's scores. Where the answer says normal and yet scores high, scores are turned round."""
    scores = F.transform(_padded(texts(f["chunk_scores"]), chunks, F.lit("0")), lambda x: clip01(F.coalesce(number(x), num(0))))
    kind = word(f["anomaly_type"], ANOMALY_TYPES, "unknown")
    overall = clip01(F.coalesce(number(f["overall_score"]), num(0)))
    confidence = clip01(F.coalesce(number(f["confidence"]), num(0)))
    anomaly = truth(f["is_anomaly"], overall >= 0.5)
    turn = (~anomaly | (kind == "normal")) & ((overall > 0.5) | F.exists(scores, lambda s: s > 0.5))
    # a float counts as its whole part
    cut = F.transform(texts(f["abnormal_chunks"]), lambda x: F.regexp_replace(x, r"^(-?[0-9]+)\.[0-9]+$", "$1"))
    return F.struct(
        anomaly.alias("is_anomaly"), F.when(turn, num(1) - overall).otherwise(overall).alias("overall_score"),
        F.when(turn, F.transform(scores, lambda s: num(1) - s)).otherwise(scores).alias("chunk_scores"), kind.alias("anomaly_type"),
        F.array_sort(F.array_distinct(_chunk_numbers(cut, chunks))).alias("abnormal_chunks"), confidence.alias("confidence"),
        F.coalesce(f["short_reason"], F.lit("")).alias("short_reason"), texts(f["supporting_evidence"]).alias("supporting_evidence"),
    )
