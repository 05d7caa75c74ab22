"""HTML by a tokenizer and a stack of open elements: headings, heading ids, and a sanitizer with an allow list.

``tokens`` follows the states that tags, attributes, comments and raw text bring about, so a heading in a comment, a
script or an attribute is none. ``nested`` makes the tokens balanced: void elements, elements that others close
(paragraphs, list items, table parts, options, headings), end tags without a begin, and elements open at the end.
Formatting elements that a paragraph's end closes are not opened anew, and text in tables stays where it is.
Nesting needs a stack, which expressions lack, so the columns are Arrow UDFs with one pass over a text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import CATEGORIES
from .text import WHITE

# Elements by how they are parsed, and what a sanitizer lets through.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes plaintext script style textarea title xmp".split())
REFERENCES_IN_RAW = frozenset(("textarea", "title"))
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
CLOSE_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
SCOPE = frozenset("applet button caption marquee object table td template th".split())
SPECIAL = CLOSE_P | SCOPE | frozenset("body colgroup select tbody tfoot thead tr".split())
#: What a start tag closes, up to which elements.
CLOSES = {
    "li": (("li",), ("ol", "ul", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption", "colgroup"), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "a": (("a",), tuple(SCOPE)), "button": (("button",), ()), "nobr": (("nobr",), tuple(SCOPE)),
}
NOT_ELEMENTS = frozenset(("html", "head", "body"))
ALLOWED_TAGS = frozenset(CATEGORIES) | frozenset(
    "a abbr acronym address area article aside audio b bdi bdo big blink blockquote br button canvas caption center cite code col colgroup content data datalist dd decorator del details dfn dialog dir div "
    "dl dt element em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 header hgroup hr i img input ins kbd label legend li main map mark marquee menu menuitem meter nav nobr ol optgroup option "
    "output p picture pre progress q rp rt ruby s samp search section select shadow slot small source spacer span strike strong sub summary sup table tbody td textarea tfoot th thead time tr track tt u ul "
    "var video wbr".split()
)
ALLOWED_ATTRIBUTES = frozenset(
    "accept action align alt autocapitalize autocomplete autopictureinpicture autoplay background bgcolor border capture cellpadding cellspacing checked cite class clear color cols colspan confidence controls "
    "controlslist coords crossorigin datetime decoding default dir disabled disablepictureinpicture disableremoteplayback download draggable enctype enterkeyhint face for headers height hidden high href "
    "hreflang id inert inputmode integrity ismap kind label lang list loading loop low max maxlength media method min minlength multiple muted name nonce noshade novalidate nowrap open optimum pattern "
    "placeholder playsinline popover popovertarget popovertargetaction poster preload pubdate radiogroup readonly rel required rev reversed role rows rowspan selected shape size sizes slot span spellcheck src "
    "srclang srcset start step style summary tabindex title translate type usemap valign value width wrap xmlns".split()
)
ADDRESSES = frozenset("action background cite href poster src srcset xmlns".split())
#: Elements that go with all that is in them; others that are not allowed leave their contents.
DROPPED_WHOLE = frozenset("annotation-xml audio colgroup desc foreignobject head iframe math mi mn mo ms mtext noembed noframes noscript plaintext script style svg template thead title video xmp".split()) - ALLOWED_TAGS
_SAFE_ADDRESS = re.compile(r"(?:(?:(?:f|ht)tps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$))", re.IGNORECASE)
#: What browsers leave out of an address before they look at it.
_SPACES = re.compile(r"[\x00-\x20\xa0\u1680\u180e\u2000-\u2029\u205f\u3000]")
_DATA_TAGS = frozenset("audio image img source track video".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*|(?=>))))?)")


def attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from behind a tag's name (the first of a name counts), and the position behind the tag; -1 if it does not end."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m[1]:
            return found, m.end()
        name, last = m[2].lower(), at
        at = m.end()
        if name:
            value = next((v for v in m.groups()[2:] if v is not None), "")
            found.setdefault(name, entities.unescape(value) if "&" in value else value)
        rest = html[at : at + 1]
        if not rest or at == last or name and re.compile(r"\s*=\s*[\"']").match(html, at):  # a quote that does not end
            return found, -1


def tokens(html: str) -> Iterator[tuple]:
    """("text", text), ("start", name, attributes), ("end", name), ("comment",) in order."""
    at, n = 0, len(html)
    text = lambda s: ("text", entities.unescape(s) if "&" in s else s)
    while at < n:
        lt = html.find("<", at)
        while lt >= 0 and not (html[lt + 1 : lt + 2] in ("!", "?", "/") or html[lt + 1 : lt + 2].isalpha() and html[lt + 1].isascii()):
            lt = html.find("<", lt + 1)
        if lt != at:
            yield text(html[at : lt if lt >= 0 else n])
        if lt < 0:
            return
        after = html[lt + 1]
        if html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
            else:
                ends = [(k, len(mark)) for mark in ("-->", "--!>") if (k := html.find(mark, lt + 4)) >= 0]
                at = sum(min(ends)) if ends else n
            yield ("comment",)
        elif after in "!?" or after == "/" and not _NAME.match(html, lt + 2):
            end = html.find(">", lt + 1)
            if after == "/" and lt + 2 >= n:
                yield text("</")
            at = n if end < 0 else end + 1
            yield ("comment",)
        else:
            m = _NAME.match(html, lt + 1 + (after == "/"))
            name = m[0].lower()
            found, at = attributes(html, m.end())
            if at < 0:
                return  # a tag that the text ends in
            if after == "/":
                yield ("end", name)
                continue
            yield ("start", name, found)
            if name in RAW:
                end = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                inner = html[at : end.start() if end else n]
                if inner:
                    yield text(inner) if name in REFERENCES_IN_RAW else ("text", inner)
                at = end.start() if end else n


def nested(html: str) -> Iterator[tuple]:
    """Tokens, each start with its end, one within the other; without comments."""
    held: list[str] = []
    many: Counter[str] = Counter()  # of each name that is open, so a deep stack is not searched for what it lacks

    def until(names, stops=frozenset()) -> list[tuple]:
        """Ends of what is open down to the innermost of ``names``, if no stop comes first."""
        if not any(many[x] for x in names):
            return []
        for k in range(len(held) - 1, -1, -1):
            if held[k] in names:
                gone = [("end", x) for x in reversed(held[k:])]
                many.subtract(held[k:])
                del held[k:]
                return gone
            if held[k] in stops:
                break
        return []

    for token in tokens(html):
        kind = token[0]
        if kind == "text":
            yield token
        elif kind == "start" and token[1] not in NOT_ELEMENTS:
            name = token[1]
            if name in CLOSE_P:
                yield from until(("p",), SCOPE)
            if name in HEADINGS and held and held[-1] in HEADINGS:
                yield from until((held[-1],))
            if name in CLOSES:
                yield from until(*CLOSES[name])
            yield token
            if name in VOID:
                yield ("end", name)
            else:
                held.append(name)
                many[name] += 1
        elif kind == "end" and token[1] not in NOT_ELEMENTS:
            name = token[1]
            if name in HEADINGS:
                yield from until(HEADINGS, SCOPE)
            elif name == "p" and not many["p"]:
                yield from (("start", "p", {}), ("end", "p"))
            elif name == "br":
                yield from (("start", "br", {}), ("end", "br"))
            elif name not in VOID:
                yield from until((name,), SCOPE - {name} if name in SPECIAL and not name.startswith("t") and name != "caption" else {"table"} - {name} if name in SPECIAL else SPECIAL)
    yield from (("end", x) for x in reversed(held))


def serialized(events: Iterator[tuple]) -> str:
    out = []
    raw = 0
    for token in events:
        if token[0] == "text":
            out.append(token[1] if raw else token[1].replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif token[0] == "start":
            own = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(160), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in token[2].items())
            out.append(f"<{token[1]}{own}>")
            raw += token[1] in RAW - REFERENCES_IN_RAW
        else:
            raw -= token[1] in RAW - REFERENCES_IN_RAW
            if token[1] not in VOID:
                out.append(f"</{token[1]}>")
    return "".join(out)


def headings(events: list[tuple]) -> list[tuple[int, str, str, int]]:
    """(position, id, stripped text, level) of each heading that has text; ids count those, unless they have one."""
    held, found = [], []
    for k, token in enumerate(events):
        if token[0] == "text":
            for h in held:
                h[2].append(token[1])
        elif token[0] == "start" and token[1] in HEADINGS:
            held.append([k, token[2].get("id", ""), [], int(token[1][1])])
            found.append(held[-1])
        elif token[0] == "end" and token[1] in HEADINGS:
            held.pop()
    with_text = [(k, own, text, level) for k, own, parts, level in found if (text := "".join(parts).strip(WHITE + "\ufeff"))]
    return [(k, own or f"heading-{n}", text, level) for n, (k, own, text, level) in enumerate(with_text)]


def toc_of(html: str) -> list[dict]:
    return [{"id": own, "text": text, "level": level} for _, own, text, level in headings(list(nested(html)))]


def ids_added(html: str) -> str:
    events = list(nested(html))
    for k, own, _, _ in headings(events):
        events[k] = ("start", events[k][1], {**events[k][2], "id": own})
    return serialized(iter(events))


def allowed(name: str, key: str, value: str) -> bool:
    if not (key in ALLOWED_ATTRIBUTES or re.fullmatch(r"(?:data|aria)-[\w.\-]+", key)):
        return False
    plain = _SPACES.sub("", value)
    if key not in ADDRESSES or not plain or _SAFE_ADDRESS.match(plain):
        return True
    return key == "src" and name in _DATA_TAGS and plain.lower().startswith("data:")


def kept(html: str) -> Iterator[tuple]:
    """What the allow lists let through."""
    dropped = 0
    for token in nested(html):
        if token[0] == "text":
            if not dropped:
                yield token
        elif token[1] in DROPPED_WHOLE:
            dropped += 1 if token[0] == "start" else -1
        elif not dropped and token[1] in ALLOWED_TAGS:
            yield ("start", token[1], {k: v for k, v in token[2].items() if allowed(token[1], k, v)}) if token[0] == "start" else token


def sanitized(html: str) -> str:
    return serialized(kept(html))


def text_of(html: str) -> str:
    return "".join(token[1] for token in kept(html) if token[0] == "text")


def toc(html: Column) -> Column:
    """array<struct(id, text, level)>: headings with text, numbered in order unless they have an id; null for null."""

    @F.pandas_udf("array<struct<id:string,text:string,level:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else toc_of(t))

    return run(html)


def _each(f, html: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run(html)


def heading_ids(html: Column) -> Column:
    """The HTML, balanced, with an id on each heading that has text."""
    return _each(ids_added, html)


def sanitize(html: Column) -> Column:
    """The HTML, balanced, with allowed elements, attributes and addresses only; null for null."""
    return _each(sanitized, html)


def visible_text(html: Column) -> Column:
    """The text of what ``sanitize`` keeps."""
    return _each(text_of, html)
