"""HTML against a plain tree: nodes with children, walked by recursion."""

import random
from html import escape
from html.parser import HTMLParser

import pytest

from scholion.functions import html

DATA = "/root/testdata/sf0.1/pages.parquet"


class Node:
    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []


class Tree(HTMLParser):
    """A tree of well-formed and of usual markup: paragraphs and list items end where others begin."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "iframe", "xmp", "noembed", "noframes")
    BLOCKS = ("p", "div", "ul", "ol", "nav", "article", "table", "h1", "h2", "h3", "footer", "header", "section")

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.feed(text)
        self.close()

    def shut(self, tag):
        if any(n.tag == tag for n in self.open):
            while self.open.pop().tag != tag:
                pass

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            return
        if tag in self.BLOCKS:
            self.shut("p")
        if tag == "li" and self.open[-1].tag != "ul":
            self.shut("li")
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first)
        self.open[-1].children.append(node)
        if tag not in html.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in html.VOID and tag not in ("html", "head", "body"):
            self.shut(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def content(node):
    return node if isinstance(node, str) else "".join(map(content, node.children))


def plain_toc(text):
    found = []

    def walk(node):
        for c in node.children:
            if not isinstance(c, str):
                if c.tag in html.HEADINGS and content(c).strip():
                    found.append((c.attrs.get("id") or f"heading-{len(found)}", content(c).strip(), int(c.tag[1])))
                walk(c)

    walk(Tree(text).root)
    return found


def plain_sanitized(text):
    def show(node):
        if isinstance(node, str):
            return node.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")
        inner = "".join(map(show, node.children))
        if node.tag in html.DROPPED_WHOLE:
            return ""
        if node.tag not in html.ALLOWED_TAGS:
            return inner
        own = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items() if html.allowed(node.tag, k, v))
        return f"<{node.tag}{own}>" + ("" if node.tag in html.VOID else f"{inner}</{node.tag}>")

    return "".join(map(show, Tree(text).root.children))


def test_pages_equal_the_tree(spark):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(DATA).select("html", html.toc(F.col("html")).alias("toc"), html.sanitize(F.col("html")).alias("clean"), html.visible_text(F.col("html")).alias("text")).collect()
    assert len(rows) == 2500
    for r in rows:
        assert [(h["id"], h["text"], h["level"]) for h in r["toc"]] == plain_toc(r["html"])
        assert r["clean"] == plain_sanitized(r["html"])
        assert r["text"] == content(Tree(r["clean"]).root) and html.sanitized(r["clean"]) == r["clean"]


def grown(rng, depth=0):
    parts = []
    for _ in range(rng.randint(0, 4) if depth < 4 else 0):
        tag = rng.choice(["div", "b", "i", "section", "h1", "h2", "span", "goal", "unknown", "script", "svg"])
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in (("id", "n1"), ("onclick", "x()"), ("href", "javascript:x"), ("title", '<h1> "q"'), ("data-x", "1")) if rng.random() < 0.2)
        heading = tag in html.HEADINGS
        inner = "var a = '<h1>no</h1>';" if tag == "script" else rng.choice(["text", " ", "a &amp; b", "&lt;h1&gt;"]) if heading else grown(rng, depth + 1)
        parts.append(rng.choice(["", "word ", "<!-- <h1>c</h1> -->", "<br>", "&nbsp;", "3 < 4 "]) + f"<{tag}{attrs}>{inner}</{tag}>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(5))
def test_any_balanced_markup_equals_the_tree(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = grown(rng)
        assert [(h["id"], h["text"], h["level"]) for h in html.toc_of(text)] == plain_toc(text)
        assert html.sanitized(text) == plain_sanitized(text)


CASES = {
    '<h1>a<!-- <h2>x</h2> --></h1><script>"<h3>n</h3>"</script><p title="<h4>q</h4>">t': '<h1>a</h1><p title="<h4>q</h4>">t</p>',
    "<h1 id=x>A</h2><h2>  </h2><h3>C<h4>D": '<h1 id="x">A</h1><h2>  </h2><h3>C</h3><h4>D</h4>',
    "<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<div>z": "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><p>x</p><p>y</p><div>z</div>",
    "<table><tr><td>1<td>2<tr><th>3</table>after": "<table><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></table>after",
    '<a href="java&#10;script:alert(1)" onclick=x>l</a>': "<a>l</a>", "<a href=' JaVaScRiPt:x'>l</a>": "<a>l</a>", '<a href="/p?a=1&b=2">l</a>': '<a href="/p?a=1&amp;b=2">l</a>',
    "<img src=data:image/png,x onerror=1>": '<img src="data:image/png,x">', "<a href=data:text/html,x>y</a>": "<a>y</a>",
    "<svg><b>no</b></svg><foo>yes</foo><goal confidence='0.9'>g</goal>": 'yes<goal confidence="0.9">g</goal>',
    "<b>x</div></b>": "<b>x</b>", '<p title="a': "", "< b <3 <": "&lt; b &lt;3 &lt;", "</p></br>": "<p></p><br>", "<p title=a\"b c='>'>q": '<p title="a&quot;b">q</p>',
    "<textarea><b>&lt;</textarea>": "<textarea>&lt;b&gt;&lt;</textarea>", "<iframe><script>1</script></iframe>x<style>p{}</style>y": "xy", "a&nbsp;b & c": "a&nbsp;b &amp; c",
    "<!DOCTYPE html><html><head><title>t</title></head><body>b</body></html>": "b", "<?php x ?>a<!x>b</ >c": "abc", "<script>alert(1)": "", "<!-->a<!--->b<!-- c --!>d": "abd", "<plaintext><b>": "", "": "",
    "<option>a<option>b": "<option>a</option><option>b</option>", "<a>x<a>y": "<a>x</a><a>y</a>", "<P CLASS=A class=b>": '<p class="A"></p>', "<br/><hr />": "<br><hr>",
}


@pytest.mark.parametrize("text", CASES)
def test_usual_faults(text):
    assert html.sanitized(text) == CASES[text]
    assert html.sanitized(CASES[text]) == CASES[text]


def test_no_script_is_left_and_all_ends():
    rng = random.Random(7)
    bits = ["<script>", "</script>", "<scr", "ipt>", "<!--", "-->", "<img src=x ", "onerror=a ", ">", '"', "'", "<a href=", "javascript:x", "<svg>", "<style>", "</style>", "<p", "=", "/", "<textarea>", "</textarea >", "&lt;", "x", " ", "<h1>", "</h2>"]
    for _ in range(3000):
        clean = html.sanitized("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))
        tree = Tree(clean)
        nodes, held = [], [tree.root]
        while held:
            node = held.pop()
            nodes += [c for c in node.children if not isinstance(c, str)]
            held += [c for c in node.children if not isinstance(c, str)]
        assert all(n.tag in html.ALLOWED_TAGS and not any(k.startswith("on") or v.startswith("javascript:") for k, v in n.attrs.items()) for n in nodes)
    assert html.sanitized("<b>" * 20_000).count("</b>") == 20_000 and html.sanitized("<div>" * 20_000 + "<li>" * 20_000).count("</div>") == 20_000


def test_ids_are_added(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<h1>A</h1><h2> </h2><h3 id=own>B</h3><h4 class=c>C",), (None,), ("",)], "t string")
    got = [r["x"] for r in df.select(html.heading_ids(F.col("t")).alias("x")).collect()]
    assert got == ['<h1 id="heading-0">A</h1><h2> </h2><h3 id="own">B</h3><h4 class="c" id="heading-2">C</h4>', None, ""]
