"""Pieces of DuckDB SQL for what the operators compute: greedy packing, overlap, sentences, normalization, rules.

Everything is text, put together from expressions; DuckDB has no look-around and no back-references,
so these say the same in another way than the operators do.
"""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, REPEATED_LINE_CHARS, REPEATED_LINE_COUNT
from ..operators import errors

BLANK = "(' ' || chr(9) || chr(10) || chr(13))"


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]::VARCHAR[]"


def pack(pieces: str, limit: int, glue: str, smaller=None) -> str:
    """A list of strings packed in order: the state is a list of what is full and the open chunk."""
    big = f"WHEN length(x.c) > {limit} THEN {{'o': a.o || (CASE WHEN a.c = '' THEN []::VARCHAR[] ELSE [a.c] END) || {smaller('x.c')}, 'c': ''}} " if smaller else ""
    size = 2 if "||" in glue else len(glue) - 2
    step = (
        f"lambda a, x: CASE {big}WHEN a.c <> '' AND length(a.c) + length(x.c) + {size} > {limit} THEN {{'o': list_append(a.o, a.c), 'c': x.c}} "
        f"WHEN a.c = '' THEN {{'o': a.o, 'c': x.c}} ELSE {{'o': a.o, 'c': a.c || {glue} || x.c}} END"
    )
    start = "{'o': []::VARCHAR[], 'c': ''}"
    return f"list_transform([list_reduce([{{'o': []::VARCHAR[], 'c': p}} FOR p IN {pieces}], {step}, {start})], lambda r: r.o || (CASE WHEN r.c = '' THEN []::VARCHAR[] ELSE [r.c] END))[1]"


def by_words(t: str, limit: int) -> str:
    return pack(f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')", limit, "' '")


def sentences(t: str) -> str:
    masked = t
    for w in ABBREVIATIONS:
        masked = f"replace({masked}, '{w}', '{w.replace('.', '·')}')"
    cut = f"string_split(regexp_replace({masked}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: trim(replace(s, '·', '.'), {BLANK})), lambda s: s <> '')"


def by_sentences(t: str, limit: int) -> str:
    return pack(sentences(t), limit, "' '", lambda s: by_words(s, limit))


def chunks(t: str, limit: int) -> str:
    """Paragraphs, sentences, words, whichever fits; a text that fits is left alone."""
    paragraphs = f"list_filter(list_transform(string_split_regex({t}, '\\n\\s*\\n'), lambda p: trim(p, {BLANK})), lambda p: p <> '')"
    return f"CASE WHEN length({t}) <= {limit} THEN [{t}] ELSE {pack(paragraphs, limit, 'chr(10) || chr(10)', lambda p: by_sentences(p, limit))} END"


def overlapped(c: str, overlap: int) -> str:
    """``c``: the name of a column of chunks."""
    tail = f"regexp_replace(right({c}[i - 1], {overlap}), '(?s)^.*?[.!?]\\s+', '')"
    return f"[CASE WHEN i > 1 AND length({c}[i - 1]) > {overlap} THEN {tail} || ' ' || x ELSE x END FOR x, i IN {c}]"


PROTECTED = r"\[[0-9,\s-]+\]|\([^)]*(?:et al\.|[0-9]{4})[^)]*\)"
CONTENT = (
    "NOT (length(l) < 5 OR regexp_full_match(l, '[0-9]+|[ivxlcdmIVXLCDM]+') OR lower(l) LIKE 'http://%' OR lower(l) LIKE 'https://%' OR lower(l) LIKE 'www.%' "
    "OR regexp_matches(lower(l), 'copyright|©\\s*\\d{4}|all rights reserved|acm\\s+digital\\s+library|doi:'))"
)


def dehyphenated(t: str) -> str:
    return f"regexp_replace({t}, '([\\pL\\pN_]+)-\\s*\\n\\s*([\\pL\\pN_]+)', '\\1\\2', 'g')"


def collapsed(x: str) -> str:
    return f"replace(replace(regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '\\n{{2,}}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10))"


def whitespace(t: str) -> str:
    pieces = f"[{collapsed('p')} FOR p IN string_split_regex({t}, '{PROTECTED}')]"
    return f"array_to_string([a || coalesce(regexp_extract_all({t}, '{PROTECTED}')[i], '') FOR a, i IN {pieces}], '')"


def without_furniture(source: str, t: str, others: str = "") -> str:
    """A SELECT of doc_id, ``others`` and ``t`` without repeated lines, from a table with a row for each doc_id."""
    return (
        f"SELECT s.doc_id{others}, CASE WHEN count(c.l) > 0 THEN regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.l IS NULL), ''), '^\\n+', '') ELSE string_agg(line, chr(10) ORDER BY pos) END AS {t} "
        f"FROM (SELECT *, trim(line, {BLANK}) AS l FROM (SELECT *, unnest(string_split({t}, chr(10))) AS line, generate_subscripts(string_split({t}, chr(10)), 1) AS pos FROM {source})) s "
        f"LEFT JOIN (SELECT doc_id, l FROM (SELECT doc_id, trim(unnest(string_split({t}, chr(10))), {BLANK}) AS l FROM {source}) WHERE length(l) > 0 AND length(l) < {REPEATED_LINE_CHARS} AND NOT ({CONTENT}) "
        f"GROUP BY doc_id, l HAVING count(*) >= {REPEATED_LINE_COUNT}) c ON s.doc_id = c.doc_id AND s.l = c.l GROUP BY s.doc_id{others}"
    )


def mapped(source: str) -> str:
    """CTEs ending in ``mapped``: doc_id, and ``v``, the original index of each cleaned character of ``source`` (doc_id, t), -1 if inserted."""
    word, other = "([\\pL\\pN_]+)-\\s*\\n\\s*([\\pL\\pN_]+)", "(?s:.)"
    placed = "sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) - length(w)"
    token = f"{PROTECTED}| {{2,}}|\\n+|[^ \\n(\\[]+|{other}"
    return f"""src AS ({source}), t1 AS (SELECT doc_id, {dehyphenated('t')} AS t FROM src), t2 AS (SELECT doc_id, {whitespace('t')} AS t FROM t1),
 e1 AS (SELECT doc_id, 2 * generate_subscripts(p, 1) AS k, unnest(p) AS w, NULL AS g, NULL AS h FROM (SELECT doc_id, string_split_regex(t, '{word}') AS p FROM src)
  UNION ALL SELECT doc_id, 2 * generate_subscripts(m, 1) + 1, unnest(m), unnest(g), unnest(h) FROM (SELECT doc_id, regexp_extract_all(t, '{word}') AS m, regexp_extract_all(t, '{word}', 1) AS g, regexp_extract_all(t, '{word}', 2) AS h FROM src)),
 m1 AS (SELECT doc_id, flatten(list(CASE WHEN g IS NULL THEN range(s, s + length(w)) ELSE range(s, s + length(g)) || range(s + length(w) - length(h), s + length(w)) END ORDER BY k)) AS m
  FROM (SELECT *, CAST({placed} AS BIGINT) AS s FROM e1) GROUP BY doc_id),
 e2 AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{token}') AS p FROM t1)),
 m2 AS (SELECT doc_id, flatten(list(CASE WHEN starts_with(w, '  ') OR w = chr(10) THEN [s] WHEN starts_with(w, chr(10)) THEN [s, s] ELSE range(s, s + length(w)) END ORDER BY k)) AS m
  FROM (SELECT *, CAST({placed} AS BIGINT) AS s FROM e2) GROUP BY doc_id),
 e3 AS (SELECT *, trim(w, {BLANK}) AS l FROM (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS p FROM t2))),
 f3 AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1 AS BIGINT) AS s FROM e3),
 gone AS (SELECT doc_id, l FROM e3 WHERE length(l) > 0 AND length(l) < {REPEATED_LINE_CHARS} AND NOT ({CONTENT}) GROUP BY doc_id, l HAVING count(*) >= {REPEATED_LINE_COUNT}),
 kept AS (SELECT f3.*, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = f3.doc_id) AS cut_some FROM f3 ANTI JOIN gone ON f3.doc_id = gone.doc_id AND f3.l = gone.l),
 m3 AS (SELECT doc_id, flatten(list((CASE WHEN NOT cut_some AND k > 1 THEN [s - 1] WHEN cut_some AND before THEN [CAST(-1 AS BIGINT)] ELSE []::BIGINT[] END) || range(s, s + length(w)) ORDER BY k)) AS m
  FROM (SELECT *, coalesce(bool_or(length(w) > 0) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM kept) GROUP BY doc_id),
 mapped AS (SELECT src.doc_id, [CASE WHEN x >= 0 THEN m1.m[m2.m[x + 1] + 1] ELSE -1 END FOR x IN coalesce(m3.m, []::BIGINT[])] AS v
  FROM src LEFT JOIN m1 ON src.doc_id = m1.doc_id LEFT JOIN m2 ON src.doc_id = m2.doc_id LEFT JOIN m3 ON src.doc_id = m3.doc_id)"""


def unescaped(t: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return t


def plain(t: str) -> str:
    return unescaped(f"regexp_replace({t}, '(?s)</?[a-zA-Z][^>]*>', '', 'g')")


def html_text(t: str) -> str:
    """Without tags, references resolved; those of & and < may lack their semicolon."""
    t = f"regexp_replace({t}, '(?s)</?[a-zA-Z][^>]*>', '', 'g')"
    for entity, char in (("lt;?", "<"), ("gt;?", ">"), ("quot;?", '"'), ("#39;?", "''"), ("nbsp;?", "\u00a0"), ("copy;?", "©"), ("middot;?", "·"), ("amp;?", "&")):
        t = f"regexp_replace({t}, '&{entity}', '{char}', 'g')"
    return t


def sanitized(t: str) -> str:
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "iframe", "object", "embed"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)</?(?:script|style|iframe|object|embed|link|meta|base|form)\\b[^>]*>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)\\son[a-z]+\\s*=\\s*(?:\\x22[^\\x22]*\\x22|\\x27[^\\x27]*\\x27|[^\\s>]+)', '', 'g')"
    for mark in ("\\x22", "\\x27"):
        t = f"regexp_replace({t}, '(?is)\\b(href|src)\\s*=\\s*{mark}\\s*javascript:[^\\x22\\x27]*{mark}', '', 'g')"
    return t


def annotated(t: str) -> str:
    """A list of the sentences of ``t`` and the white space between them, in turn."""
    return f"string_split(regexp_replace({t}, '([.!?])(\\s+)([\\pL])', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1))"


def category(p: str, cues) -> str:
    """The first category one of whose cues ``p`` has; cues begin at a word's start, which has to be said for letters beyond ASCII."""
    tests = " ".join(f"WHEN regexp_matches({p}, '(?i)(?:^|[^\\pL\\pN_])(?:{cue.split('(?:')[1].split(')')[0]})') THEN '{kind}'" for kind, _, cue in cues)
    return f"CASE WHEN trim({p}, {BLANK}) = '' THEN NULL {tests} END"


def rows(values) -> str:
    return ", ".join("(" + ", ".join(v) + ")" for v in values)


#: The kinds of errors, and each kind with itself and all above it.
KINDS = (
    f"tax(code, parent) AS (VALUES {rows((quoted(c), quoted(p)) for c, p in errors.TAXONOMY)}), "
    "anc(code, up, depth) AS (SELECT code, code, 0 FROM tax UNION ALL SELECT anc.code, tax.parent, depth + 1 FROM anc JOIN tax ON anc.up = tax.code WHERE tax.parent IS NOT NULL)"
)


def _rule(n: int, key: str | None, r: errors.Rule) -> tuple[str, ...]:
    return str(n), quoted(key), quoted(r.category), str(errors.SEVERITIES.index(r.severity)), quoted(r.severity), str(r.retriable).lower(), quoted(r.strategy), quoted(r.message), listed(r.steps), str(r.confidence)


_COLUMNS = "category, rank, severity, retriable, strategy, message, steps, confidence"
RULES = (
    f"kr(n, key, {_COLUMNS}) AS (VALUES {rows(_rule(n, k, r) for n, (k, r) in enumerate([*errors.TYPE_RULES.items(), (None, errors.DEFAULT_RULE)]))}), "
    f"mr(n, key, {_COLUMNS}) AS (VALUES {rows(_rule(n, k, r) for n, (k, r) in enumerate(errors.MESSAGE_RULES))}), "
    "ofkind AS (SELECT code, coalesce(max(n) FILTER (key = code), min(n)) AS n FROM anc JOIN kr ON up = key GROUP BY code)"
)
USER_MESSAGES = f"um(n, words, title, text, severity, steps, fixes) AS (VALUES {rows((str(n), listed(w), quoted(t), quoted(m), quoted(sev), listed(st), listed(fx)) for n, (w, t, m, sev, st, fx) in enumerate([*errors.USER_MESSAGES, ((), *errors.OTHER_MESSAGE)]))})"
