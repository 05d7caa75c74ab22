"""URL filters, whitening, filter audit: against plain models and brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from scholion.llm import filteraudit, linkfilter, whitening

# URL filters

PAGES = "page_id long, url string, html string, host string, verdict int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], PAGES)


def lower(host):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host)


def plain_judge(rows, steps=80):
    """The rules, and both rankings by matrices."""
    parts, links, named, seen = [], set(), [], defaultdict(list)
    for n, (i, url, html) in enumerate(rows):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(o + p), o + p, v) for v, o, p in linkfilter.RULES if (host == o or host.endswith("." + o)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        parts.append([i, host, path, rule, verdict])
        if rule:
            seen[host].append(verdict == "allow")
        shown = re.sub(r"(?is)<!--.*?(-->|\Z)|<script.*?(</script>|\Z)", " ", html or "")
        for u in re.findall(r"""(?is)<a\s[^<>]*?href=["']?((?:https?:)?//[^\s"'<>]*)""", shown):
            links.add((n, host, lower(re.match(r"[^/]*//([^/?#]*)", u)[1])))
        named += [(n, host, lower(x)) for x in re.findall(r"[A-Za-z0-9.-]+", shown) if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x.rstrip("."))]
    links |= {x for x in named if x[2] in {p[1] for p in parts}}
    edges = Counter((a, b) for _, a, b in links if a and b and a != b)
    hosts = sorted({x for e in edges for x in e} | set(seen))
    at = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        w[at[a], at[b]] = n
    start = np.array([[np.mean(seen[h]), 1 - np.mean(seen[h])] if seen[h] else [0, 0] for h in hosts]).reshape(-1, 2)
    scores = []
    for k, m in ((0, w), (1, w.T)):
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        mass = total = start[:, k]
        for _ in range(steps):
            mass = 0.7 * mass @ share
            total = total + mass
        scores.append(total)
    for p in parts:
        k = at.get(p[1])
        p[4] = p[4] or ("allow" if k is None else "block" if scores[1][k] > scores[0][k] else "allow")
    return sorted(map(str, map(tuple, parts)))


def web(seed, n=300):
    rng = random.Random(seed)
    hosts = [f"H{i}.{'net' if i % 3 else 'example.com'}" for i in range(30)] + ["a.org", "b.example.org", "hub.net"]
    rows = []
    for i in range(n):
        host = "hub.net" if i % 3 == 0 else rng.choice(hosts)  # a third of all pages is of one host, and most link to it
        to = [rng.choice(hosts) for _ in range(rng.randint(0, 4))] + ["hub.net"] * (rng.random() < 0.6)
        links = "".join(f'<a class=x href="{rng.choice(["http://", "https://", "//"])}{t}/q">t</a>' for t in to)
        rows.append((i, f"http://{host}/{rng.choice(['fr', 'de', 'en', 'es'])}/{i}", f"<!-- <a href='http://evil.net/'> --><script>x='<a href=\"http://bad.net\">'</script>{links}<p>&copy; {rng.choice([*hosts, "Nobody.net"])} &middot; a..b<a href=/own>"))
    return rows


@pytest.mark.parametrize("seed, broadcast", [(1, -1), (2, 10 << 20)])
def test_judged_by_rules_and_links(spark, seed, broadcast):
    rows = web(seed)
    rows += [rows[5], (None, "http://x.net/a?b", None), (1000, None, '<a href="http://a.org">'), (1001, "HTTP://A.ORG?x#y", "<!-- <a href='http://open.net'>"), (1002, "://", ""), (1003, "no url", "x" * 200_000), (1004, "http://example.org/en/1", "")]
    rows += [(1005, "ftp://É.Com/fr/", "<a\nhref = 'https://lone.net:80/'>"), (1006, "http://lone.net:80", "<a <a href="), (1007, "http://notorg/", ""), (1008, "http://org/", ""), (1009, "http://m.example.org/es", "")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = linkfilter.judge(pages_of(spark, rows), tolerance=1e-6)
        assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(str(tuple(r)) for r in out.collect()) == plain_judge(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_carry_verdicts(spark):
    page = lambda i, host, lang, *to: (i, f"http://{host}/{lang}/{i}", "".join(f'<a href="http://{t}/">' for t in to))
    rows = [page(1, "good.com", "fr", "liked.net"), page(2, "bad.com", "de"), page(3, "liked.net", "en", "further.net"), page(4, "spam.net", "en", "bad.com"), page(5, "further.net", "en"), page(6, "links-to-spam.net", "en", "spam.net"), page(7, "far.net", "en")]
    got = {r["host"]: r["verdict"] for r in linkfilter.judge(pages_of(spark, rows), unknown="unknown").collect()}
    assert got == {"good.com": "allow", "bad.com": "block", "liked.net": "allow", "further.net": "allow", "spam.net": "block", "links-to-spam.net": "block", "far.net": "unknown"}
    assert {r["verdict"] for r in linkfilter.judge(pages_of(spark, rows), rules=()).collect()} == {"allow"}


def test_judge_of_nothing_and_its_plan(spark):
    assert linkfilter.judge(pages_of(spark, [])).count() == 0
    plan = linkfilter.host_links(pages_of(spark, web(3, 10)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all") == 2


# Whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


def check_whitened(out, rows, k, atol=1e-7):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    t = x * n - s
    c = (t / n).astype(float)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = Counter((i, int((row * row).sum())) for (i, _), row in zip(rows, t, strict=True))
    assert Counter((r["vec_id"], r["deviation"]) for r in out if r["component"] == 1) == deviation
    assert Counter(r["component"] for r in out) == {j: n for j in range(1, k + 1)} and {r["n"] for r in out} == {n}
    want = c @ v / np.sqrt(e)
    of = defaultdict(list)
    for r in out:
        of[r["component"]].append((str(r["vec_id"]), r["whitened"]))
        assert abs(r["explained"] * (c * c).sum() / n / e[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    for j in range(k):
        mine = np.array([y for _, y in sorted(of[j + 1])])
        plain = [sorted((str(i), sign * y) for (i, _), y in zip(rows, want[:, j], strict=True)) for sign in (1, -1)]
        assert min(np.abs(mine - np.array([y for _, y in p])).max() for p in plain) < atol


@pytest.mark.parametrize("d, k, flat", [(64, 32, False), (64, 32, True), (20, 3, False), (90, 4, True)])
def test_whitening_equals_eigenvectors(spark, d, k, flat):
    rng = np.random.default_rng(d + k)
    scale = np.ones(d) if flat else 1.25 ** -np.arange(d)
    rows = [(i, (rng.normal(size=d) * scale * 4).tolist()) for i in range(400)]
    odd = [(900, None), (901, [None] * d), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("-inf")] * d), (904, []), (905, [1.0] * (d + 1))]
    check_whitened(whitening.whiten(vectors_of(spark, rows + odd).repartition(5), k).collect(), rows, k, 1e-5 if flat else 1e-7)


def test_block_iterates_and_widens(spark, monkeypatch):
    """The first passes are not enough: the residuals say so, and each pass multiplies a block narrower than the vectors."""
    widths = []
    real = whitening.product
    monkeypatch.setattr(whitening, "product", lambda rows, centre, q: widths.append(q.shape[1]) or real(rows, centre, q))
    rng = np.random.default_rng(4)
    steep = [(i, (rng.normal(size=40) * 0.4 ** np.arange(40) * 4e4).tolist()) for i in range(120)]
    check_whitened(whitening.whiten(vectors_of(spark, steep), 3).collect(), steep, 3)
    assert len(widths) > 1 and set(widths) == {6}
    widths.clear()
    monkeypatch.setattr(whitening, "PASSES", 2)
    flat = [(i, rng.normal(size=40).tolist()) for i in range(120)]
    check_whitened(whitening.whiten(vectors_of(spark, flat), 3).collect(), flat, 3)
    assert widths == [6, 6, 12, 12, 24, 24, 40]


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0 and whitening.whiten(vectors_of(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0  # one row has no spread
    rows = [(1, [1.0, 5.0, 2.0]), (1, [1.0, 5.0, 2.0]), (None, [3.0, 5.0, 6.0]), (None, [-1.0, 5.0, -2.0])]
    out = whitening.whiten(vectors_of(spark, rows)).collect()
    check_whitened(out, rows, 1)  # a constant column, and one that another decides
    large = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r["deviation"] for r in large} == {None} or None in {r["deviation"] for r in large}
    assert all(np.isfinite(r["whitened"]) for r in large)


def test_whitening_of_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check_whitened(whitening.whiten(df).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()], 32)


# Filter audit


def plain_audit(rows, labels):
    """Every order applied document by document."""
    first, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good[i], toxic[i] = good[i] or i is not None and q == 1, toxic[i] or i is not None and x == 1
    out = defaultdict(Counter)
    for i, t, part in rows:
        t, part = t or "", part or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order):
                c = out[part, order, k + 1]
                c["removed"] += (here := fails[f] and not gone)
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += here and good[i]
                c["toxic_lost"] += here and toxic[i]
                gone = gone or fails[f]
                c["kept"] += not gone
    for (part, order, k), c in out.items():
        c["shapley"] = sum(o["removed"] for (p, other, j), o in out.items() if p == part and other[j - 1] == order[k - 1]) if k else 0
    return {key: tuple(int(c[m]) for m in filteraudit.MEASURES) for key, c in out.items()}


@pytest.mark.parametrize("parts", [1, 500])
def test_audit_equals_every_order(spark, monkeypatch, parts):
    monkeypatch.setattr(filteraudit, "PARTS", parts)
    rng = random.Random(3)
    rows = []
    for i in range(60):
        n = rng.choice([3, 99, 100, 130])
        words = [rng.choice(["Ab", "c d", "é"]) + str(rng.randrange(rng.choice([40, 4000]))) for _ in range(n)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words) + rng.choice(["", "", " #", " ABCDEFGH" * 40]), rng.choice(["en", "de", None, ""])))
    rows += [(100 + k, rows[k % 5][1], rng.choice(["en", "fr"])) for k in range(30)]  # a third are copies
    rows += [(7, rows[0][1], "en"), (7, rows[7][1], "en"), (200, None, "en"), (201, "", None), (None, rows[1][1], "en"), (None, None, "xx"), (202, "W" * 200_000 + " w" * 100, "en"), (203, "\x00 \x1c" * 120, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, digest string, fails int").repartition(4)
    out = filteraudit.audit(docs, spark.createDataFrame([(*x, "l") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in filteraudit.MEASURES) for r in out} == plain_audit(rows, labels)
    assert len(out) == 600 * 5


def test_audit_of_nothing(spark):
    none = filteraudit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0 and none.columns == ["part", "filter_order", "step", *filteraudit.MEASURES]


def test_first_failures():
    for fails in range(32):
        for n, order in enumerate(filteraudit.ORDERS):
            steps = [k for k, f in enumerate(order) if fails >> "ABCDE".index(f) & 1]
            assert filteraudit.FIRST[fails, n] == (steps[0] if steps else 5)
