"""How much of a table Python gets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session was told to hand rows to Python in batches of BATCH_BYTES, unless it was told a size already: cut
    by rows alone, a batch of long texts would be as large as they are together. It changes no result."""
    if _BATCH not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df
