"""The row-wise operators on streams.

What needs no state works on a stream unchanged:
rules (but de-duplication), projections and the record parser. Everything that
fits or aggregates runs batch by batch through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.records import STATION_LINE, Layout, parse_records
from ..operators.selection import Rules, reason_text, rule_reasons


def stream_reasons(stations: DataFrame, rules: Rules, station_id: str = "station_id") -> DataFrame:
    """Rule reasons of streamed stations; de-duplication needs all rows and is refused."""
    if rules.deduplicate_within_m is not None:
        raise ValueError("de-duplication needs all rows: use each_batch")
    return rule_reasons(stations, rules, station_id).withColumn("selection_reason", reason_text("reasons"))


def stream_records(lines: DataFrame, line_id: str = "line_id", text: str = "raw_text", layout: Layout = STATION_LINE) -> DataFrame:
    """Parsed lines with reasons, as they arrive."""
    return parse_records(lines, line_id, text, layout)


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that applies any batch operator to each micro-batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
