"""Running endpoint and parameter counts over a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hitpath.functions.request import endpoint
from hitpath.operators import params, trend
from hitpath.sources.scratch import scratch_dir


def endpoint_counts(entries: DataFrame) -> DataFrame:
    """Requests per endpoint so far."""
    return trend.endpoint_counts(entries)


def query_value_counts(entries: DataFrame) -> DataFrame:
    """Occurrences of each query parameter value so far."""
    values = params.param_values(entries, kind="query")
    return values.select(endpoint().alias("endpoint"), F.col("name").alias("key"), "value", "count")


def combo_counts(entries: DataFrame) -> DataFrame:
    """Counts of query key combinations and of whole key-value combinations so far.

    An endpoint's requests without a query count once it has had one. Before
    that they are kept under ``(none)`` all the same, as the query may still come;
    ``params.of_queried_endpoints`` leaves such endpoints out of the table.
    """
    return params.combo_counts(entries)


def run_update(stream: DataFrame, keys: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is available in update mode and return the last row of each key.

    Each micro-batch writes its updates to a folder named after it, so that a
    repeated batch replaces its own only; the result is read from all of them.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, "stream-updates")
    # There may be no batch at all.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def save(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    updates = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(path)
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return latest.select(*keys, "_last.*").select(*stream.columns)


def run_complete(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is available and return the resulting table.

    Each micro-batch writes the whole result to a folder named after the
    batch, so that a repeated batch replaces its own output only.
    """
    spark = stream.sparkSession
    path = path or scratch_dir(spark, "stream-table")
    written = []

    def save(table: DataFrame, batch: int) -> None:
        target = f"{path}/batch={batch}"
        table.write.mode("overwrite").parquet(target)
        written.append(target)

    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(written[-1])
