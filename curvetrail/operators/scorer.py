"""The slot for a model: prompts go to any callable in batches on the workers, answers come back as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A model takes rows and a budget of new tokens, and gives a text for each row. What makes one runs once a task.
Model = Callable[[list[dict], int], list[str]]


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def answers_of(model: Model, rows: list[dict], budget: int, least: int = 16) -> list[str]:
    """The model's answers. Where memory runs out, half the rows at a time; a single row gets half the budget, once.
    Other errors are the caller's."""
    try:
        return [str(a or "").strip() for a in model(rows, budget)]
    except Exception as error:
        if not out_of_memory(error):
            raise
    if len(rows) > 1:
        half = len(rows) // 2
        return answers_of(model, rows[:half], budget, least) + answers_of(model, rows[half:], budget, least)
    return [str(a or "").strip() for a in model(rows, max(least, budget // 2))]


def with_answers(items: DataFrame, load: Callable[[], Model], columns: list[str], out: str = "raw", batch: int = 16, budget: int = 256) -> DataFrame:
    """items with the model's answer to each row (null only in an input without rows to ask). columns: what the model
    sees of a row. load runs on the worker, so a model is neither shipped nor shared; rows keep their partitions."""
    if out in items.columns:
        raise ValueError(f"there is a column {out} already")
    schema = T.StructType([*items.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch)
                model = model or load()
                answers = answers_of(model, rows.select(columns).to_pylist(), budget)
                if len(answers) != rows.num_rows:
                    raise ValueError(f"{len(answers)} answers to {rows.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string())], names=[*rows.schema.names, out])

    return items.mapInArrow(run, schema)
