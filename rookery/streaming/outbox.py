"""An outbox: messages of runs are delivered once each, in the order they came, whatever is lost or run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outbox(sent: str, send: Callable[[DataFrame], None] | None = None):
    """A foreachBatch writer. `sent` is the folder of what was delivered, a folder a batch; `send` carries a batch's messages out.

    A message is known by its run_id. One that any batch has delivered, this one included, isn't sent again; one whose batch was lost before its folder was written is. Of messages that repeat a run within a batch the first by
    position goes. What `send` has begun when a task is lost may come twice, so it has to name messages by run_id too.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.filter("run_id <> ''").groupBy("run_id").agg(F.min(F.struct("position", "message")).alias("_m")).select("run_id", "_m.position", "_m.message")
        # a batch without messages, so that there is always something to read
        spark.createDataFrame([], "run_id string, position long, message string").write.mode("ignore").parquet(f"{sent}/batch=-1")
        done = spark.read.schema("run_id string, batch int").parquet(sent)
        again = done.filter(F.col("batch") == number).limit(1).count() > 0
        first = first.join(done.select("run_id").distinct(), "run_id", "left_anti")
        if again:  # the batch was delivered whole, as its folder appears only then
            return
        first = first.orderBy("position")
        if send is not None:
            send(first)
        first.write.mode("overwrite").parquet(f"{sent}/batch={number}")

    return write
