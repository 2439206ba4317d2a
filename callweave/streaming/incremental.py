"""Graphs that grow while they are queried: command scripts arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..graph import CallGraph
from ..sources.readers import located, numbered_lines, script_source
from ..sources.store import Store


def script_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the scripts that arrive in a folder, as a stream."""
    return located(spark.readStream.text(folder))


def collect_facts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Load what has arrived into the `Store` at path and stop. A batch's files follow one another by their paths, after those of earlier batches; commands
    act on the graph of the lines before them. A batch is loaded once, also if it is tried again after a failure."""

    def loaded(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, path).load(script_source(numbered_lines(batch)), (checkpoint, number))

    return stream.writeStream.foreachBatch(loaded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> CallGraph:
    """The graph of all that was loaded so far."""
    return Store(spark, path).graph()
