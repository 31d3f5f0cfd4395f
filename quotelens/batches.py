"""Arrow batches of bounded size for Python functions over texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of texts that a Python worker gets at once. Spark's default of 10,000 makes batches of tens of MB of documents of usual size,
#: which the executor and each of its workers hold several times over.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """For jobs over texts: lower the session's Arrow batches to BATCH_ROWS, unless they are smaller already. The setting stays, as Spark asks for it when the lazy job runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
