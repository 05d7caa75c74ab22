"""Error classification, user messages, retry rules: ordered CASE WHEN chains over literal tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

SEVERITIES = ("low", "medium", "high", "critical")
RESULT = "category string, severity string, is_retriable boolean, retry_strategy string, user_message string, remediation_steps array<string>, confidence double, metadata map<string,string>"

# Code, parent code of every kind of error.
TAXONOMY = (
    ("ApplicationError", None), ("ProcessingError", "ApplicationError"),
    ("PdfError", "ProcessingError"), ("PasswordProtectedError", "PdfError"), ("CorruptedFileError", "PdfError"), ("NoTextLayerError", "PdfError"),
    ("ExtractionQualityError", "PdfError"), ("FileNotFoundError", "PdfError"), ("InvalidFileTypeError", "PdfError"),
    ("LLMError", "ProcessingError"), ("RateLimitError", "LLMError"), ("LLMValidationError", "LLMError"), ("ElementValidationError", "LLMValidationError"),
    ("ElementFormatError", "ElementValidationError"), ("MissingRequiredFieldError", "ElementValidationError"), ("InvalidElementTypeError", "ElementValidationError"),
    ("InvalidEvidenceTypeError", "ElementValidationError"), ("InvalidConfidenceError", "ElementValidationError"), ("InvalidTextError", "ElementValidationError"),
    ("ResponseFormatError", "LLMValidationError"), ("ResponseFieldError", "LLMValidationError"), ("ApiKeyError", "LLMError"), ("ProviderConfigurationError", "LLMError"),
    ("MissingApiKeyError", "ProviderConfigurationError"), ("ProviderInitializationError", "ProviderConfigurationError"), ("EmptyResponseError", "LLMError"),
    ("ContentFilterError", "LLMError"), ("GeminiAuthenticationError", "ApiKeyError"), ("GeminiSafetyFilterError", "ContentFilterError"), ("GeminiApiError", "LLMError"),
    ("ModelNotFoundError", "LLMError"), ("DataError", "ProcessingError"), ("SerializationError", "DataError"), ("DataValidationError", "DataError"),
    ("PdfModelValidationError", "DataValidationError"), ("InvalidCharacterPosition", "PdfModelValidationError"), ("InvalidPageNumber", "PdfModelValidationError"),
    ("InvalidBoundingBox", "PdfModelValidationError"), ("InvalidDimensions", "PdfModelValidationError"), ("TextLengthMismatch", "PdfModelValidationError"),
    ("InvalidElementData", "PdfModelValidationError"), ("InvalidElementType", "PdfModelValidationError"), ("InvalidConfidenceScore", "PdfModelValidationError"),
    ("ConfigurationError", "ApplicationError"), ("DependencyError", "ConfigurationError"),
    ("CliError", "ApplicationError"), ("InvalidProfileError", "CliError"), ("InvalidParameterError", "CliError"),
)


@dataclass(frozen=True)
class Rule:
    category: str
    severity: str
    retriable: bool
    strategy: str | None
    message: str
    steps: tuple[str, ...]
    confidence: float
    metadata: tuple[tuple[str, str], ...]

    def fields(self) -> dict:
        values = (self.category, self.severity, self.retriable, self.strategy, self.message, self.steps, self.confidence, dict(self.metadata))
        return dict(zip((part.split(" ")[0] for part in re.split(r", (?=[a-z_]+ )", RESULT)), values, strict=True))


_EXP, _LIN, _NOW = "exponential_backoff", "linear_backoff", "immediate"

# Classification by the kind of an error, in order.
TYPE_RULES = {
    "PasswordProtectedError": Rule("user_input", "high", False, None, "PDF is password protected", ("Provide the PDF password if available", "Try a different version of the PDF", "Contact the document owner for access"), 0.95, (("pdf_issue", "password_protected"),)),
    "CorruptedFileError": Rule("document_quality", "high", False, None, "PDF file is corrupted or unreadable", ("Try re-downloading the PDF", "Verify the file is not corrupted", "Use a different version of the document"), 0.95, (("pdf_issue", "corrupted"),)),
    "NoTextLayerError": Rule("document_quality", "high", False, None, "PDF contains only images with no extractable text", ("Use OCR software to extract text first", "Try a text-searchable version of the PDF", "Consider manual text extraction"), 0.95, (("pdf_issue", "no_text_layer"),)),
    "ExtractionQualityError": Rule("document_quality", "medium", True, _LIN, "Extracted text quality is below acceptable threshold", ("Try with different extraction settings", "Verify PDF quality and readability", "Consider preprocessing the document"), 0.9, (("pdf_issue", "low_quality"),)),
    "RateLimitError": Rule("api_provider", "medium", True, _EXP, "API rate limit exceeded, will retry with delay", ("Wait for rate limit reset", "Reduce concurrent requests", "Consider upgrading API plan"), 0.98, (("api_issue", "rate_limit"),)),
    "ApiKeyError": Rule("configuration", "critical", False, None, "API key is invalid or missing", ("Verify API key is correctly set", "Check API key permissions", "Regenerate API key if needed"), 0.98, (("config_issue", "api_key"),)),
    "ModelNotFoundError": Rule("configuration", "high", False, None, "Requested model is not available", ("Check model name spelling", "Verify model is available with your API key", "Try a different model"), 0.95, (("config_issue", "model_not_found"),)),
    "ContentFilterError": Rule("document_quality", "medium", False, None, "Content blocked by safety filters", ("Review document content for sensitive material", "Try with different extraction settings", "Consider content preprocessing"), 0.9, (("api_issue", "content_filter"),)),
    "LLMValidationError": Rule("retriable", "medium", True, _NOW, "LLM response validation failed, will retry", ("Automatic retry with JSON recovery", "Consider adjusting temperature settings", "Check prompt formatting"), 0.85, (("llm_issue", "validation_failed"),)),
    "ConfigurationError": Rule("configuration", "high", False, None, "Configuration error detected", ("Check configuration settings", "Verify environment variables", "Review configuration documentation"), 0.9, (("config_issue", "general"),)),
    "DependencyError": Rule("configuration", "critical", False, None, "Required dependency is missing or incompatible", ("Install required dependencies", "Check dependency versions", "Review installation instructions"), 0.95, (("config_issue", "dependencies"),)),
    "DataValidationError": Rule("retriable", "medium", True, _NOW, "Data validation failed, will retry", ("Automatic retry with data recovery", "Check data format requirements", "Review input data quality"), 0.8, (("data_issue", "validation"),)),
    "SerializationError": Rule("retriable", "medium", True, _NOW, "Data serialization failed, will retry", ("Automatic retry with format recovery", "Check output format settings", "Verify data structure compatibility"), 0.8, (("data_issue", "serialization"),)),
}
DEFAULT_RULE = Rule("system_resource", "medium", True, None, "", (), 0.3, ())

_NETWORK = Rule("retriable", "medium", True, _EXP, "Network connection issue, will retry", ("Check internet connection", "Verify API endpoint availability", "Try again in a few moments"), 0.9, (("network_issue", "true"), ("pattern_match", "network")))
_MEMORY = Rule("system_resource", "high", False, None, "Insufficient memory for processing", ("Try processing smaller documents", "Close other applications", "Consider increasing system memory"), 0.95, (("resource_issue", "memory"), ("pattern_match", "memory")))
_DISK = Rule("system_resource", "high", False, None, "Insufficient disk space", ("Free up disk space", "Choose a different output directory", "Clean up temporary files"), 0.95, (("resource_issue", "disk"), ("pattern_match", "disk")))
_RESOURCE = Rule("system_resource", "medium", True, _LIN, "System resource constraints, will retry", ("Close unnecessary applications", "Reduce concurrent processing", "Try again with fewer resources"), 0.8, (("resource_issue", "general"), ("pattern_match", "resource")))
_QUOTA = Rule("api_provider", "high", False, None, "API quota exceeded", ("Wait for quota reset", "Upgrade API plan", "Consider alternative providers"), 0.95, (("api_issue", "quota"), ("pattern_match", "quota")))
_AUTH = Rule("configuration", "critical", False, None, "Authentication failed", ("Verify API credentials", "Check authentication configuration", "Regenerate API keys if needed"), 0.95, (("config_issue", "authentication"), ("pattern_match", "auth")))
_PERMISSION = Rule("configuration", "high", False, None, "Permission denied", ("Check file/directory permissions", "Verify API key permissions", "Run with appropriate privileges"), 0.9, (("config_issue", "permissions"), ("pattern_match", "permission")))
_SERVICE = Rule("api_provider", "medium", True, _EXP, "Service temporarily unavailable, will retry", ("Wait for service recovery", "Check service status page", "Try alternative providers"), 0.9, (("api_issue", "service_unavailable"), ("pattern_match", "service")))
_FILE = Rule("user_input", "high", False, None, "File not found or inaccessible", ("Verify file path is correct", "Check file exists and is readable", "Ensure proper file permissions"), 0.9, (("file_issue", "true"), ("pattern_match", "file")))
_LOCK = Rule("system_resource", "medium", True, _LIN, "File is locked or in use, will retry", ("Close applications using the file", "Wait for file to be released", "Try with a different file"), 0.85, (("file_issue", "locked"), ("pattern_match", "file_lock")))
_JSON = Rule("retriable", "medium", True, _NOW, "JSON parsing failed, will retry with recovery", ("Automatic JSON recovery attempt", "Check JSON format requirements", "Review data structure"), 0.85, (("data_issue", "json"), ("pattern_match", "json")))
_PARSING = Rule("retriable", "medium", True, _NOW, "Parsing error, will retry with recovery", ("Automatic parsing recovery attempt", "Check data format", "Review input structure"), 0.8, (("data_issue", "parsing"), ("pattern_match", "parsing")))
_TIMEOUT = Rule("retriable", "medium", True, _EXP, "Request timed out, will retry", ("Automatic retry with longer timeout", "Check network connectivity", "Try with smaller requests"), 0.9, (("timeout_issue", "true"), ("pattern_match", "timeout")))

# Classification by the message in lower case, the first match in order.
MESSAGE_RULES = (
    (r"connection.*(?:timeout|refused|reset|failed)", _NETWORK), (r"(?:network|socket|ssl).*error", _NETWORK), (r"dns.*(?:resolution|lookup).*failed", _NETWORK),
    (r"memory.*(?:error|allocation|insufficient)", _MEMORY), (r"out of memory|memory exhausted", _MEMORY), (r"disk.*(?:full|space|quota)", _DISK), (r"too many open files", _RESOURCE),
    (r"quota.*(?:exceeded|exhausted)", _QUOTA), (r"unauthorized|authentication.*failed", _AUTH), (r"forbidden|access.*denied", _PERMISSION), (r"service.*unavailable|502|503|504", _SERVICE),
    (r"permission.*denied|access.*denied", _PERMISSION), (r"file.*not.*found|no such file", _FILE), (r"directory.*not.*found", _FILE), (r"file.*(?:locked|in use)", _LOCK),
    (r"json.*(?:decode|parse).*error", _JSON), (r"invalid.*json|malformed.*json", _JSON), (r"unexpected.*(?:token|character)", _PARSING),
    (r"timeout|timed out", _TIMEOUT), (r"request.*(?:timeout|exceeded)", _TIMEOUT),
)

# User messages by what a lower-case message contains, the first in order.
USER_MESSAGES = (
    (("timeout", "timed out"), "Request Timeout", "The request took too long to complete.", "warning", ("Try again in a few moments", "Check your network connection"), ("Retry the operation", "Check network connectivity")),
    (("connection", "network"), "Network Issue", "There was a problem connecting to the service.", "warning", ("Check your internet connection", "Try again in a few moments"), ("Verify network connectivity", "Retry the operation")),
    (("permission", "access"), "Permission Error", "Access to the resource was denied.", "error", ("Check file permissions", "Verify access rights"), ("Check permissions", "Contact administrator")),
    (("memory",), "Memory Issue", "Insufficient memory to complete the operation.", "error", ("Close other applications", "Try with smaller files"), ("Free memory", "Use smaller data sets")),
    (("file not found", "no such file"), "File Not Found", "The specified file could not be found.", "error", ("Check file path", "Verify file exists"), ("Verify file path", "Check file existence")),
    (("api", "authentication"), "API Error", "There was an issue with the API service.", "error", ("Check API credentials", "Verify service availability"), ("Check API key", "Verify service status")),
)
OTHER_MESSAGE = ("Processing Error", "An error occurred during processing.", "error", ("Try again", "Check input data"), ("Retry operation", "Verify input"))
#: Where a user may read on.
DOCS = ("README.md",)
# HTTP status by the root of an error's kind.
HTTP_STATUS = (("PdfError", 400), ("LLMError", 500), ("ConfigurationError", 400), ("DataError", 422))


def taxonomy(spark: SparkSession) -> DataFrame:
    """code, parent, and the line of codes from it up to the root."""
    rows = [(code, parent, ancestors(code)) for code, parent in TAXONOMY]
    return spark.createDataFrame(rows, "code string, parent string, line array<string>")


def ancestors(code: str) -> list[str]:
    parent = dict(TAXONOMY)
    out = []
    while code in parent:
        out.append(code)
        code = parent[code]
    return out


def chain(pairs: list[tuple[Column, Column]], last: Column) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(last)


def rule_table(rules: list[Rule]) -> Column:
    """The rules as one array. As text of JSON it is folded to a literal when a query is planned; an array of structs would be made for each row."""
    return F.from_json(F.lit(json.dumps([r.fields() for r in rules], ensure_ascii=False)), f"array<{_struct()}>")


#: The rules of kinds with the default, and of messages.
KIND_RULES = (*TYPE_RULES.values(), DEFAULT_RULE)


def kind_number(kind: Column) -> Column:
    """The number of the exact kind's rule, else of the first rule among its ancestors, else of the default."""
    names = list(TYPE_RULES)
    codes: dict[int, list[str]] = {}
    for code, _ in TAXONOMY:
        line = ancestors(code)
        hit = code if code in TYPE_RULES else next((k for k in names if k in line), None)
        if hit:
            codes.setdefault(names.index(hit), []).append(code)
    return chain([(kind.isin(*c), F.lit(n)) for n, c in codes.items()], F.lit(len(names)))


def by_kind(kind: Column) -> Column:
    """Rule of the exact kind, else of the first rule among its ancestors, else the default."""
    return F.get(rule_table(list(KIND_RULES)), kind_number(kind))


def heads(pattern: str) -> tuple[str, ...]:
    """Words of which a match of ``pattern`` begins with one: what stands first in each alternative."""
    out, depth, part = [], 0, ""
    for c in pattern + "|":
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            group = re.match(r"\(\?:([a-z |]+)\)(?![?*{])", part)
            plain = re.match(r"[a-z0-9 ]+(?![a-z0-9 ?*{])", part)
            if not (group or plain):
                raise ValueError(f"{pattern!r} does not begin with a word")
            out += group[1].split("|") if group else [plain[0]]
            part = ""
        else:
            part += c
    return tuple(out)


def message_number(message: Column) -> Column:
    """The number of the first pattern that a message matches; null if there is none.

    A pattern is tried only on messages that contain one of the words it may begin with, which is much cheaper to see.
    """

    def first(low: Column) -> Column:
        may = lambda p: reduce(Column.__or__, [low.contains(w) for w in heads(p)])
        return chain([(may(p) & low.rlike(p), F.lit(n)) for n, (p, _) in enumerate(MESSAGE_RULES)], F.lit(None).cast("int"))

    return let(F.lower(message), first)


def by_message(message: Column) -> Column:
    """Rule of the first pattern that a message matches; null if there is none."""
    return F.get(rule_table([r for _, r in MESSAGE_RULES]), message_number(message))


def _struct() -> str:
    return "struct<" + ", ".join(":".join(part.split(" ", 1)) for part in re.split(r", (?=[a-z_]+ )", RESULT)) + ">"


def classify(kind: Column, message: Column) -> Column:
    """The two classifications combined.

    The more confident message rule wins alone; else both are merged: the severer severity (by rank),
    retriable if both are, sorted union of steps, the message's metadata over the kind's.
    """
    # every pair is put together once, as a literal; a row only looks its pair up
    several = len(MESSAGE_RULES) + 1
    table = rule_table([combined(a, b) for a in KIND_RULES for b in (*(r for _, r in MESSAGE_RULES), None)])
    return F.get(table, kind_number(kind) * several + F.coalesce(message_number(message), F.lit(several - 1)))


def combined(a: Rule, b: Rule | None) -> Rule:
    """One classification of a kind's and a message's."""
    if b is None or b.confidence > a.confidence:
        return b or a
    return Rule(
        b.category if b.confidence > 0.7 else a.category, max(a.severity, b.severity, key=SEVERITIES.index), a.retriable and b.retriable, a.strategy if b.strategy is None else b.strategy,
        b.message or a.message, tuple(sorted({*a.steps, *b.steps})), max(a.confidence, b.confidence), (*((k, v) for k, v in a.metadata if k not in dict(b.metadata)), *b.metadata),
    )


def user_message(message: Column, kind: Column | None = None) -> Column:
    """struct(title, message, severity, steps, fixes, details, docs); details are ``kind: message``, docs where to read on."""
    details = F.coalesce(message, F.lit("")) if kind is None else F.concat_ws(": ", kind, F.coalesce(message, F.lit("")))

    def value(title, text, severity, steps, fixes) -> Column:
        return F.struct(
            F.lit(title).alias("title"), F.lit(text).alias("message"), F.lit(severity).alias("severity"), F.array(*map(F.lit, steps)).alias("steps"),
            F.array(*map(F.lit, fixes)).alias("fixes"), details.alias("details"), F.array(*map(F.lit, DOCS)).alias("docs"),
        )

    low = F.coalesce(F.lower(message), F.lit(""))
    pairs = []
    for words, *rest in USER_MESSAGES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        pairs.append((hit, value(*rest)))
    return chain(pairs, value(*OTHER_MESSAGE))


def with_context(base: Column, operation: Column, file_path: Column, section: Column, paper: Column) -> Column:
    """A message and, below it, what is known of its context; nulls are left out."""
    named = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    details = F.concat_ws(" | ", named("During: ", F.initcap(F.replace(operation, F.lit("_"), F.lit(" ")))), named("File: ", file_path), named("Section: ", section), named("Paper: ", paper))
    return F.when(details == "", base).otherwise(F.concat(base, F.lit("\n\nContext: "), details))


def http_status(kind: Column) -> Column:
    pairs = [(kind.isin(*[code for code, _ in TAXONOMY if root in ancestors(code)]), F.lit(status)) for root, status in HTTP_STATUS]
    return chain(pairs, F.lit(500))


def retry_delay(strategy: Column, attempt: Column, initial: float = 2.0, multiplier: float = 2.0, maximum: float = 30.0, retry_after: Column | None = None) -> Column:
    """Seconds before the next attempt (from 0), at most ``maximum``; a positive ``retry_after`` goes first."""
    after = F.lit(None).cast("double") if retry_after is None else retry_after.cast("double")
    plain = (
        F.when(strategy == "exponential_backoff", F.lit(initial) * F.pow(F.lit(multiplier), attempt))
        .when(strategy == "linear_backoff", F.lit(initial) * (attempt + 1))
        .when(strategy == "fixed_delay", F.lit(initial))
        .otherwise(F.lit(0.0))
    )
    return F.least(F.when(after > 0, after).otherwise(plain), F.lit(maximum))


def retryable(kind: Column, never: tuple[str, ...] = ("ApiKeyError", "ContentFilterError"), roots: tuple[str, ...] = ("LLMError",)) -> Column:
    """Not one of ``never`` (or below), and one of ``roots`` (or below)."""
    under = lambda tops: [code for code, _ in TAXONOMY if set(tops) & set(ancestors(code))]
    return kind.isin(*under(roots)) & ~kind.isin(*under(never))
