"""Arrow UDFs that are made when they are used, so that workers can import their modules."""

from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Unless the session says otherwise, Arrow batches end at BATCH_BYTES: ten thousand long texts fill a worker's memory."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def arrow_udf(kind: str):
    """Turn a function over pandas Series into one over Columns; ``kind`` is the result's type."""

    def decorate(f):
        @wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return decorate
