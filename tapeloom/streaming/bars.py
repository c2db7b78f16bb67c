"""Bars that arrive in files, classified as they come.

Not part of the reference's surface, which is batch only: new price files are picked up
by Structured Streaming, and each micro-batch is classified with the last known bar of its
tickers, so the statuses equal those of one batch over all files. Bars of a ticker must
arrive in date order, several to a batch or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.bars import classify
from ..sources.mirror import SCHEMAS


def prices(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, t) for n, t in SCHEMAS["daily_prices"].items()])
    return spark.readStream.schema(schema).parquet(folder)


def classified(stream: DataFrame, symbols: DataFrame, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Write classified bars under ``out``, one folder a batch, so that a repeated batch
    replaces what it wrote; ``state`` keeps each ticker's last bar as of each batch."""
    spark = stream.sparkSession

    def last_bars(batch: int) -> DataFrame | None:
        return spark.read.parquet(f"{state}/batch={batch - 1}") if batch else None

    def step(rows: DataFrame, batch: int) -> None:
        before = last_bars(batch)
        tagged = rows.withColumn("new", F.lit(True))
        if before is not None:
            tagged = tagged.unionByName(before.withColumn("new", F.lit(False)))
        fresh = rows.select("ticker", "date").withColumn("fresh", F.lit(True)).distinct()
        done = classify(tagged.drop("new"), symbols).join(fresh, ["ticker", "date"]).drop("fresh")
        done.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        order = F.struct("date", "new")
        latest = tagged.groupBy("ticker").agg(F.max_by(F.struct(*rows.columns), order).alias("b")).select("b.*")
        latest.write.mode("overwrite").parquet(f"{state}/batch={batch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
