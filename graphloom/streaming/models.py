"""Recompile a folder of modules as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.schema_graph import compile_model
from ..sources.yang import read_modules


def watch_models(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, main: str | None = None, base_uri: str = "http://example.org/ontology/", once: bool = False) -> StreamingQuery:
    """Call ``sink(triples, batch)`` with the whole compiled model whenever modules were added.

    A model is only meaningful as a whole (imports cross files), so a batch of
    new files triggers a compilation of the folder; the stream's checkpoint
    keeps which files have been seen.
    """
    files = spark.readStream.option("pathGlobFilter", "*.yang").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"))

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            stmts, _ = read_modules(rows.sparkSession, folder, main)
            sink(compile_model(stmts, base_uri), number)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
