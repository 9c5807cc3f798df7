"""Prompt texts as Column expressions; the wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE = {
    "montage": "one picture that tiles the key frames in time order",
    "frames": "the key frames as single pictures in time order",
    "enhanced": "key frames with boxes and trails drawn, and a close-up of the main object",
}


def evidence_text(method: str) -> str:
    return EVIDENCE.get(method, EVIDENCE["montage"])


def span_prompt(summary: Column, method: str = "montage") -> Column:
    """Asks for anomaly_score, confidence, reason and evidence_tags of one span. summary: a struct."""
    head = f"You see {evidence_text(method)} from a traffic camera. Facts about the span: "
    tail = ". Reply with a JSON object alone: anomaly_score (0 to 1), confidence (0 to 1), reason, evidence_tags."
    return F.concat(F.lit(head), F.to_json(summary), F.lit(tail))


def span_stage1_prompt(summary: Column, method: str = "montage") -> Column:
    head = f"You see {evidence_text(method)}. Describe it without judging. Facts: "
    tail = ". Reply with a JSON object alone: scene_summary, main_objects, motion_summary, anomaly_hint, evidence_tags."
    return F.concat(F.lit(head), F.to_json(summary), F.lit(tail))


def span_stage2_prompt(stage1: Column, summary: Column, method: str = "montage") -> Column:
    head = f"An observer of {evidence_text(method)} noted: "
    tail = ". Reply with a JSON object alone: anomaly_score, confidence, reason, evidence_tags."
    return F.concat(F.lit(head), stage1, F.lit(". Facts: "), F.to_json(summary), F.lit(tail))


def clip_stage1_prompt(chunks: int = 4, frames: int = 4) -> str:
    return (
        f"The pictures are {chunks * frames} frames of a clip in time order, {frames} for each of its {chunks} parts. Describe each part. "
        "Reply with a JSON object alone: main_objects, scene_summary, chunk_descriptions, noticeable_change, likely_abnormal_chunks, risk_hint."
    )


def clip_stage2_prompt(stage1: Column, chunks: int = 4) -> Column:
    tail = f". Score each of the {chunks} parts. Reply with a JSON object alone: is_anomaly, overall_score, chunk_scores, anomaly_type, abnormal_chunks, confidence, short_reason."
    return F.concat(F.lit("Notes on a clip: "), stage1, F.lit(tail))
