"""What the queries hand to Python comes in small batches; large tables are dealt over enough tasks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholion import queries as own
from scholion.functions import batches as b
from scholion.plans import inputs
from scholion.sources import documents as src

SF = "/root/testdata/sf0.001"
ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def largest(df):
    """The most rows of ``df`` that a task has at once."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)]})

    return df.coalesce(1).mapInPandas(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", ["pdf_pages", "element_coordinates", "sanitize_tree", "page_sections", "markdown_files", "sentence_chunks", "call_events", "prepared_chunks", "respond"])
def test_batches_are_bounded(spark, name):
    for key in (ROWS, BYTES):
        spark.conf.unset(key)
    own.QUERIES[name](spark, SF)
    assert largest(spark.range(2000)) <= b.ROWS
    long = spark.range(24).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert largest(long) <= (b.BYTES >> 20) + 1


def test_batches_of_operators_are_bounded(spark):
    """Also without the tables of the queries."""
    files = spark.range(1).select(F.lit("a.pdf").alias("path"), F.lit("ok").alias("status"), F.lit(b"no pdf").alias("content"))
    for use in (lambda: src.scan_pdf(files), lambda: src.scan_pages(files, None)):
        spark.conf.unset(ROWS)
        use()
        assert largest(spark.range(2000)) <= b.ROWS


def test_one_row_group_is_dealt_over_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(inputs, "TASK_BYTES", 20_000)
    monkeypatch.setattr(inputs, "SMALL_BYTES", 1000)
    from scholion.document_queries import written

    files = written(spark, str(tmp_path), False)
    sizes = [r["n"] for r in files.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    assert sum(sizes) == 4000 and len(sizes) > 4 and max(sizes) < 1000


def test_coordinates_parse_each_file_once(spark):
    plan = own.QUERIES["element_coordinates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan
