"""Live feeds (an extension): running I/O totals and timer spans as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeline.operators.stats import IO_COUNTERS
from treeline.sources.files import IO_SCHEMA

SPANS = "file long, label string, layer string, depth int, start_micros long, end_micros long"


def io_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(IO_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_io_totals(records: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Totals by command and window of record time; a window closes once the watermark passes it."""
    timed = records.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "cmd").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in IO_COUNTERS])


def span_stream(lines: DataFrame) -> DataFrame:
    """Spans of a stream of log lines; the open starts of each (file, depth, label, layer) are its state."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file, depth, label, layer = key
        opened = list(state.get[0]) if state.exists else []
        for rows in batches:
            found = []
            for kind, at in rows.sort_values("line_no")[["kind", "micros"]].itertuples(index=False):
                if kind == "start":
                    opened.append(int(at))
                elif opened:
                    found.append((file, label, layer, depth, opened.pop(), int(at)))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in SPANS.split(", ")])
        state.update((opened,))

    return lines.groupBy("file", "depth", "label", "layer").applyInPandasWithState(pair, SPANS, "opened array<long>", "append", GroupStateTimeout.NoTimeout)
