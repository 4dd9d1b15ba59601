"""Written tables (``sinks.export.write_tables``) read back so that only the folders and columns asked for are opened.

Runs and spans lie in folders by source and start day (UTC) of their run. ``filters.filter_runs`` turns its day and period conditions into
conditions on these folders; ``spans_of`` hands the chosen runs' folders on to the spans when the query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..skew import bounded

PLACE = ["source", "start_day", "run_id"]


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``runs``, ``spans`` or another table written beside them."""
    return spark.read.parquet(f"{path}/{name}")


def spans_of(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Spans of the chosen ``runs`` (rows of the written run table): other (source, day) folders are pruned at run time.

    The runs are broadcast where their count is bounded, and then their folders prune the scan; a larger choice is a shuffled semi join.
    """
    return read_table(spark, path, "spans").join(bounded(runs.select(*PLACE)), PLACE, "left_semi")
