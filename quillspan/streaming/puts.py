"""Put-if-absent: the first write of a key wins, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.joins import first_wins


def put_if_absent(store: DataFrame, arrivals: DataFrame, key: str, order: Column) -> DataFrame:
    """The rows to append: the first arrival of each key that the store lacks."""
    return first_wins(arrivals, key, order).join(store.select(key), key, "left_anti")


def stream_into(arrivals: DataFrame, store_path: str, checkpoint: str, key: str, order: str):
    """Append a stream of arrivals to a Parquet store, idempotent by key. Starts the query."""
    schema = arrivals.schema

    def batch(df: DataFrame, _epoch: int) -> None:
        store = df.sparkSession.read.schema(schema).parquet(store_path)
        new = put_if_absent(store, df, key, F.col(order)).select(df.columns)
        new.write.mode("append").parquet(store_path)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
