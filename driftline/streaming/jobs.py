"""Running a stateful query over files to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from driftline.session import shared_folder
from driftline.streaming.detectors import detect


def replay(points: DataFrame, files: int = 4, by: str = "step", through=detect) -> DataFrame:
    """Write points as files, stream them a file at a time through the detectors (or what is given) into a parquet sink, and read that.

    Both folders lie in the shared folder, so any executor can go on with them.
    """
    spark = points.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    points.repartitionByRange(files, by).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run = through(stream).writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out")
