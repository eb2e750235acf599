"""Product files as they arrive.

The operators have no state, so that extraction, clips and polygon joins take a streaming table as they are; `arrivals`
watches a folder, and `keep_clipping` writes what lies in a box or in polygons, each file once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    """A streaming table of the Parquet files in a folder; schema: that of the files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keep_clipping(rows: DataFrame, clip: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write clip(rows) as Parquet as rows arrive; once: what is there now, and then stop. A batch that is tried again
    after a failure is written once, as the checkpoint tells."""
    writer = clip(rows).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
