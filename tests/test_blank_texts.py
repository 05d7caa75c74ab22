"""Texts that are empty or white space alone give what the SQL says of them."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from scholion import queries as own
from scholion.functions import markup
from scholion.operators import annotate as ann


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """180 documents; their remainders by 4, 5 and 6 meet in all ways, for a text, an empty one and one of white space."""
    at = tmp_path_factory.mktemp("blank")
    text = "CASE doc_id // 60 WHEN 0 THEN 'We aim at ' || doc_id || '. The result is good.' WHEN 1 THEN '' ELSE ' ' || chr(10) || chr(9) || '  ' END"
    duckdb.sql(f"COPY (SELECT range AS doc_id, {text.replace('doc_id', 'range')} AS text, 'en' AS lang, 'web' AS source FROM range(180)) TO '{at}/documents.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["markdown_export", "paper_summary", "respond", "section_analysis", "section_events", "markdown_files"])
def test_blank_texts(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = own.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    answer = con.sql(own.ORACLE[name]).select(*[duckdb.ColumnExpression(c) for c in columns])
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(answer.fetchall())


def test_heading_of_a_blank_summary(spark):
    made = lambda t, **a: spark.range(1).select(markup.markdown(F.lit("T"), F.array(F.lit("A")), F.lit(1.5), F.lit(t).cast("string"), F.lit(""), F.lit("2024-01-01"), **a)).first()[0]
    said = "## Plain Language Summary"
    assert said in made("x") and said not in made("") and said not in made(None)
    assert said in made("", blank_summary=True) and said not in made(None, blank_summary=True)


def test_blank_sections(spark):
    found = lambda t, *a: len(spark.range(1).select(ann.analyze_section(F.lit(t), F.lit("<goal>g</goal>"), *a).alias("a")).first()["a"]["elements"])
    assert found("x") == 1 and found("") == 0 and found(" \n") == 0
    assert found("", F.lit(False)) == 1 and found("x", F.lit(True)) == 0
