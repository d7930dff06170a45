"""Prompts and their completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded, is_blank, normalize_space
from .shared import exploded, issue


def issues(records: DataFrame) -> DataFrame:
    p = F.col("pair")
    sample = bounded(F.col("sample"), 800)
    copied = ~is_blank(p["input"]) & (normalize_space(p["input"]) == normalize_space(p["output"]))
    found = F.array(
        F.when(is_blank(p["output"]), issue("CRITICAL", "empty_completion", F.concat(p["output_name"], F.lit(" is empty")), sample)),
        F.when(copied, issue("WARNING", "completion_copies_prompt", F.concat(p["output_name"], F.lit(" appears to copy "), p["input_name"]), sample)),
    )
    return exploded(records.where(F.col("fmt") == "prompt_completion"), found)
