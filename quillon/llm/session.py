"""Session settings that the text operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Keeps Arrow batches of whole texts small where the session still has Spark's default of 10,000 rows."""
    conf = df.sparkSession.conf
    if conf.get(ROWS, "10000") == "10000":
        conf.set(ROWS, "512")
        conf.set(BYTES, str(16 << 20))
