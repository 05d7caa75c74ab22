"""Arrow batches of a bounded size for tasks that hand texts to Python.

By default Spark sends 10,000 rows at once, whatever they hold; a worker then has them several times over (Arrow, strings,
what is made of them, Arrow again), and so has each worker of a chain of functions. With these bounds its memory is that of a few MB of texts, or of
one row that is longer.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch.
ROWS, BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches. Spark reads both settings when a plan is run, after its query has returned; so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
