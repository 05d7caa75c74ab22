"""Elements (goals, methods, results): validation, constraints, filters, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# What is valid.
ELEMENT_TYPES = ("goal", "method", "result")
EVIDENCE_TYPES = ("quantitative", "qualitative", "theoretical", "mixed", "unknown")
MIN_TEXT_CHARS = 10
YEARS = (1900, 2030)


def by_confidence(df: DataFrame, least: float) -> DataFrame:
    return df.filter(F.col("confidence") >= least)


def by_type(df: DataFrame, *types: str) -> DataFrame:
    return df.filter(F.col("element_type").isin(*types))


def includable(text: Column) -> Column:
    """Long enough to be kept; a missing text is not."""
    return F.coalesce(F.length(text), F.lit(0)) >= MIN_TEXT_CHARS


def element_error(element_type: Column, text: Column, evidence: Column, confidence: Column) -> Column:
    """Code of the first rule that an element breaks, null if it is valid. Null means that the field is missing."""
    missing = element_type.isNull() | text.isNull() | evidence.isNull() | confidence.isNull()
    return (
        F.when(missing, "missing_required_field")
        .when(~element_type.isin(*ELEMENT_TYPES), "invalid_element_type")
        .when(~evidence.isin(*EVIDENCE_TYPES), "invalid_evidence_type")
        .when(~confidence.between(0.0, 1.0) | F.isnan(confidence), "invalid_confidence")
        .when(strip(text) == "", "invalid_text")
    )


def json_kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is_number(v: Column) -> Column:
    return json_kind(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$")


def json_element_error(v: Column) -> Column:
    """``element_error`` for one element held as a variant, with its types checked."""
    names = ("element_type", "text", "evidence_type", "confidence")
    kind, text, evidence, confidence = (_field(v, n) for n in names)
    as_text = lambda x: x.try_cast("string")
    number = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.try_variant_get(v, "$.confidence", "boolean").cast("double"))
    missing = kind.isNull() | text.isNull() | evidence.isNull() | confidence.isNull()
    return (
        F.when(~json_kind(v).startswith("OBJECT"), "element_format")
        .when(missing, "missing_required_field")
        .when(~F.coalesce(as_text(kind).isin(*ELEMENT_TYPES), F.lit(False)), "invalid_element_type")
        .when(~F.coalesce(as_text(evidence).isin(*EVIDENCE_TYPES), F.lit(False)), "invalid_evidence_type")
        .when(~_is_number(confidence) | ~F.coalesce(number.between(0.0, 1.0), F.lit(False)), "invalid_confidence")
        .when((json_kind(text) != "STRING") | F.coalesce(strip(as_text(text)) == "", F.lit(True)), "invalid_text")
    )


def response_error(json: Column) -> Column:
    """Code of the first fault of a response {"elements": [...]}; null if it is valid."""
    v = F.try_parse_json(json)
    listed = _field(v, "elements")
    items = F.try_variant_get(v, "$.elements", "array<variant>")
    faults = F.filter(F.transform(items, json_element_error), lambda e: e.isNotNull())
    return (
        F.when(v.isNull() | ~json_kind(v).startswith("OBJECT"), "response_format")
        .when(listed.isNull() | ~json_kind(listed).startswith("ARRAY"), "response_field")
        .otherwise(F.get(faults, F.lit(0)))
    )


def summary_error(json: Column) -> Column:
    """Code of the first fault of a summary {"summary", "confidence", "source_sections"}; null if it is valid."""
    v = F.try_parse_json(json)
    text, confidence, sections = (_field(v, n) for n in ("summary", "confidence", "source_sections"))
    number = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.try_variant_get(v, "$.confidence", "boolean").cast("double"))
    return (
        F.when(v.isNull() | ~json_kind(v).startswith("OBJECT"), "response_format")
        .when(text.isNull() | confidence.isNull() | sections.isNull(), "missing_required_field")
        .when(json_kind(text) != "STRING", "invalid_text")
        .when(~_is_number(confidence) | ~F.coalesce(number.between(0.0, 1.0), F.lit(False)), "invalid_confidence")
        .when(~json_kind(sections).startswith("ARRAY"), "response_field")
    )


def constraints() -> dict[str, Column]:
    """Row constraints by name, over the columns of the entities; a name's prefix is its entity."""
    c = F.col
    given = lambda x: F.coalesce(c(x).cast("string") != "", F.lit(False))
    nonblank = lambda x: F.coalesce(strip(c(x)) != "", F.lit(False))
    unit = lambda x: F.coalesce(c(x).between(0.0, 1.0), F.lit(False))
    span = (c("char_start") >= 0) & (c("char_end") > c("char_start"))
    return {
        "position.index": c("char_index") >= 0,
        "position.page": c("page_number") >= 1,
        "position.bbox": F.size("bbox") == 4,
        "page.number": c("page_number") >= 1,
        "page.count": c("char_count") == F.length("text"),
        "page.size": (c("width") > 0) & (c("height") > 0),
        "content.path": given("file_path"),
        "content.pages": (c("total_pages") >= 1) & (c("total_pages") == c("n_pages")),
        "transformation.text": ~((F.length("original") == 0) & (F.length("cleaned") == 0)),
        "section.ids": given("section_id") & given("section_type"),
        "section.text": nonblank("text"),
        "section.pages": (c("start_page") >= 1) & (c("end_page") >= c("start_page")),
        "section.confidence": unit("confidence"),
        "section.span": span,
        "paper.id": given("paper_id"),
        "paper.title": given("title"),
        "paper.authors": F.size("authors") > 0,
        "paper.year": c("year").isNull() | c("year").between(*YEARS),
        "coordinates.page": c("page_number") >= 1,
        "coordinates.size": (c("width") > 0) & (c("height") > 0),
        "coordinates.span": span,
        "element.ids": given("element_id") & given("paper_id") & given("section_id"),
        "element.page": c("page_number").isNull() | (c("page_number") >= 1),
        "element.type": c("element_type").isin(*ELEMENT_TYPES),
        "element.evidence": c("evidence_type").isin(*EVIDENCE_TYPES),
        "element.text": nonblank("text"),
        "element.confidence": unit("confidence"),
        "request.year": c("year").isNull() | c("year").between(*YEARS),
    }


def check(df: DataFrame, entity: str) -> DataFrame:
    """``df`` with ``violations``: the names of the constraints of ``entity`` that a row breaks (a null result breaks)."""
    mine = {k: v for k, v in constraints().items() if k.startswith(entity + ".")}
    broken = [F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in mine.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def quarantine(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their violations)."""
    checked = check(df, entity)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def orphans(elements: DataFrame, papers: DataFrame) -> DataFrame:
    """Elements whose paper_id no paper has; must be empty."""
    return elements.join(papers.select("paper_id").distinct(), "paper_id", "left_anti")


def author_list(c: Column) -> Column:
    """Comma-separated authors as an array of stripped, non-blank names."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def type_counts(df: DataFrame, *keys: str) -> DataFrame:
    """total and a count for each of the three types, 0 where there is none; without keys one row."""
    counts = [F.count_if(F.col("element_type") == t).alias(f"{t}s") for t in ELEMENT_TYPES]
    return df.groupBy(*keys).agg(F.count("*").alias("total_elements"), *counts)


def section_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "section_id").agg(F.count("*").alias("n"))


def average_confidence(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
