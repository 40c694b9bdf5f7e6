"""Feature extraction over arriving files: each micro-batch does what isn't done yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrakiln.operators.assemble import resume


def extract_arriving(spark: SparkSession, incoming: str, schema: str, out: str, checkpoint: str, key: str, features: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads Parquet files as they come to `incoming` and appends their features to `out`, all that are there now, then stops.

    A batch leaves out keys that `out` has, so a batch that runs again after a failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        todo = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(out)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            todo = resume(todo, done, key)[1]
        features(todo).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
