"""Stage labels: packed texts such as ``evaluation+training`` and what they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

MODES = ("expand", "primary", "fractional")


def _known(stage: Column) -> Column:
    return stage.isin(*dims.PIPELINE_STAGES)


def stage_list(label: Column) -> Column:
    """Known stages of a label in its own order; empty for labels off the pipeline."""
    return F.coalesce(F.filter(F.transform(F.split(label, r"\+"), lambda s: F.trim(s)), _known), F.array().cast("array<string>"))


def pack_stages(stages: Column) -> Column:
    """Sorted stages joined by plus signs; null for none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(stages)), "+"), F.lit(""))


def scope(label: Column) -> Column:
    return F.when(F.size(stage_list(label)) > 0, "pipeline").when(label == "dependencies", "dependencies").otherwise("out_of_scope")


def is_multi_stage(label: Column) -> Column:
    return F.coalesce(F.contains(label, F.lit("+")), F.lit(False))


def stage_weights(label: Column, mode: str = "expand") -> Column:
    """Array of ``(stage, weight)`` structs: the matrix rows that a label counts in.

    ``expand`` counts one in each stage, ``primary`` one in the first,
    ``fractional`` shares one among all.  Other labels count one in
    ``dependencies`` or ``out_of_scope``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    stages = stage_list(label)
    share = F.lit(1.0) if mode != "fractional" else F.lit(1.0) / F.size(stages)
    used = F.slice(stages, 1, 1) if mode == "primary" else stages
    row = lambda s, w: F.struct(s.alias("stage"), w.cast("double").alias("weight"))
    return F.when(F.size(stages) > 0, F.transform(used, lambda s: row(s, share))).otherwise(F.array(row(scope(label), F.lit(1.0))))


def counts_for_pipeline(label: Column) -> Column:
    """True if any untrimmed part of the label is a stage (the rule that correlation counts use)."""
    return F.coalesce(F.exists(F.split(label, r"\+"), _known), F.lit(False))
