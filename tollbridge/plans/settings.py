"""From settings files to the effective settings of each environment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tollbridge.operators.settings import overlay_layers, resolve_refs
from tollbridge.session import cut_lineage
from tollbridge.sources.assignments import read_assignments


def load_settings(
    spark: SparkSession,
    layers: DataFrame,
    externals: Mapping[str, str] | DataFrame | None = None,
    root: str | None = None,
) -> DataFrame:
    """(env_id, key, value): read the layers, resolve references at their line, keep the last.

    The files are read once: every step of the references goes on from the table of their lines.
    """
    assignments = cut_lineage(read_assignments(spark, layers, root), "assignments")
    return overlay_layers(resolve_refs(assignments, externals))
