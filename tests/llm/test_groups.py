"""Operators over groups of rows: WARC, substrings, packing, near-duplicates, top-k, the pipeline."""

import gzip
import hashlib
import random
import tracemalloc
from base64 import b32encode
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholion.llm import chunkdedup, dartminhash, mih, packing, warc
from scholion.llm.components import components

DOCS = "doc_id long, text string, digest string, shard int"
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in ("al", "er", "on", "it") for c in ("", "ing", "ed", "ou", "esh")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)


# WARC


def brute_warc(pages):
    """(page_id, bytes, digest, type, refers_to) of each row, by hand: null ids last."""
    out, first = [], {}
    for i, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (html or "").encode()
        out.append((i, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), *(("revisit", first[raw]) if raw in first else ("response", None))))
        first.setdefault(raw, i)
    return Counter(out)


@pytest.mark.parametrize("broadcast", [-1, 10 << 20])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    pages = [(5, "http://a/x y", "é" * 10), (2, None, "é" * 10), (9, "http://b", None), (7, "http://c", ""), (1, "http://d", "WARC/1.0\r\n\r\nx\r\n\r\n"), (1, "http://d", "WARC/1.0\r\n\r\nx\r\n\r\n")]
    pages += [(1, "http://d", "other"), (1, "http://dd", "other"), (None, "http://e", "e"), (None, "http://f", "e"), (None, "http://f", "other"), (30, "u", "z" * 200_000)]
    pages += [(100 + k, f"http://g/{k}", "common" if k % 3 == 0 else f"page {k}\r\n\r\n") for k in range(60)]
    monkeypatch.setattr(warc.write, "__defaults__", (9,))  # many archives
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = warc.round_trip(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == brute_warc(pages)
        assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_warc_read_tells_broken_archives(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <g>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    for name, content in (("a", good + b"junk\r\n"), ("b", gzip.compress(good)[:-9]), ("c", good.replace(b"Content-Length: 1\r\n", b"")), ("d", good.replace(b": 1", b": nine")), ("e", b"")):
        (tmp_path / name).write_bytes(content)
    got = Counter((r["record_id"], r["error"] is None) for r in warc.read(spark, str(tmp_path)).collect())
    assert got[(None, False)] == 4 and got[("<g>", True)] >= 1
    assert warc.assemble(warc.read(spark, str(tmp_path))).count() == 1


def test_warc_long_archives_are_streamed(spark, tmp_path):
    """Records as of whole files, whatever the pieces; a broken one says so and others go on."""
    rec = lambda name, block: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    blocks = [b"", b"x", b"\r\n", b"\r\n\r\n", b"a\r\n\r\nb\r\n", b"\xff\x00" * 5000, b"WARC/1.0\r\n\r\n", b"end\r\n\r\n\r\n"]
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(rec(f"a{k}", x)) for k, x in enumerate(blocks)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(rec(f"b{k}", x) for k, x in enumerate(blocks))[:-4]))
    (tmp_path / "c.gz").write_bytes(gzip.compress(rec("c", b"good") + b"junk\r\n\r\n" + rec("lost", b"")))
    (tmp_path / "d.gz").write_bytes(gzip.compress(rec("d", b"good") + rec("cut", b"abcdef")[:-8]))
    (tmp_path / "e").write_bytes(rec("plain", b"e"))
    key = lambda rows: Counter((r["record_id"], r["block_bytes"], r["payload_digest"], r["error"] is None) for r in rows)
    whole, parts = (key(warc.read(spark, str(tmp_path), n).collect()) for n in (1 << 20, 0))
    assert whole == parts and sum(whole.values()) == 2 * len(blocks) + 3 + 2 and whole[None, None, None, False] == 2


def test_warc_parse_and_assemble(spark):
    def rec(kind, uri, block, *more):
        head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri}>", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http"
    archive = b"".join(gzip.compress(x) for x in (rec("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Concurrent-To: <q1>"), rec("request", "q1", b"GET /\r\n\r\n", http), rec("metadata", "m1", b"a: b\r\n", "WARC-Concurrent-To: <q1>", "Content-Type: application/warc-fields"), rec("metadata", "m2", b"", "WARC-Concurrent-To: <none>")))
    rows = [warc.describe(*x) for x in warc.parse(archive)]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows + rows[:1], warc.RECORD_SCHEMA)).collect()}
    assert set(got) == {"<r1>", "<m2>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and [m["record_id"] for m in got["<r1>"]["metadata"]] == ["<m1>"] and got["<r1>"]["metadata"][0]["fields"] == {"a": "b"}
    assert got["<r1>"]["response"]["payload_bytes"] == 4 and got["<m2>"]["response"] is None
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx"))


def test_warc_assembles_far_and_shared_records(spark):
    def rec(kind, name, *to):
        return (f"<{name}>", kind, None, None, [f"<{t}>" for t in to], None, None, "", 0, 0, "", {}, None)

    rows = [rec("response", "r1"), rec("request", "q1", "r1"), rec("request", "q2", "r1"), rec("metadata", "m1", "q1"), rec("metadata", "m2", "m1"), rec("metadata", "m3", "m2", "gone")]
    rows += [rec("response", "r2"), rec("metadata", "both", "r2", "r1"), rec("metadata", "far", "both"), rec("request", "q3", "m4"), rec("metadata", "m4"), rec("metadata", "m5", "m5")]
    ids = lambda records: [x["record_id"][1:-1] for x in records]
    got = {r["capture_id"][1:-1]: (r["request"] and r["request"]["record_id"][1:-1], ids(r["requests"]), ids(r["metadata"])) for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert got == {
        "r1": ("q1", ["q1", "q2"], ["both", "far", "m1", "m2", "m3"]), "r2": (None, [], ["both", "far"]),
        "m4": ("q3", ["q3"], ["m4"]), "m5": (None, [], ["m5"]),
    }


# Substrings


def slow_gear(raw):
    h, out = 0, []
    for b in raw:
        h = (2 * h + int(chunkdedup.GEAR[b])) & 0xFFFF
        out.append(h)
    return out


def test_gear_hash_and_boundaries():
    rng = random.Random(0)
    for text in (b"x" * 1000, "é".encode() * 400, " ".join(rng.choice(WORDS) for _ in range(400)).encode(), b"", b"a"):
        assert chunkdedup.gear_hash(np.frombuffer(text, np.uint8)).tolist() == slow_gear(text)
        b = chunkdedup.boundaries(text)
        assert b[0] == 0 and b[-1] == len(text) and all(x < y for x, y in zip(b, b[1:]))
        assert all(y - x <= chunkdedup.MAX_BYTES + chunkdedup.MIN_BYTES for x, y in zip(b, b[1:]))
        for i, j in zip(b, b[1:]):
            text[i:j].decode()


def plain_cuts(rows):
    """(doc_id, text) to byte spans: owners by a plain loop, runs extended byte by byte against the owner's whole text."""
    places = {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda r: (r[0], th_of(r[1]))):
        b, digests = chunkdedup.chunks(t.encode())
        for k, d in enumerate(digests):
            places.setdefault(d, (i, t, b[k], b[k + 1]))
    space, out = b" \t\n\r\x0b\x0c", {}
    for i, t in {(i, t) for i, t in rows if i is not None and t}:
        raw = t.encode()
        b, digests = chunkdedup.chunks(raw)
        own, seen = [], {}
        for k, d in enumerate(digests):
            o = places[d] if places[d][0] != i else (i, t, *seen[d]) if d in seen else None
            seen.setdefault(d, (b[k], b[k + 1]))
            own.append(o)
        spans, k = [], 0
        while k < len(digests):
            if own[k] is None:
                k += 1
                continue
            j = k
            while j < len(digests) and own[j] is not None:
                j += 1
            (_, lt, la, _), (ri, rt, _, rz) = own[k], own[j - 1]
            lt, rt, start, end = lt.encode(), rt.encode(), b[k], b[j]
            floor, least, most = rz if (ri, rt.decode()) == (i, t) else 0, start, end
            for n in range(1, 513):  # every length that agrees and ends between words in both texts
                if start - n < floor or la - n < 0 or raw[start - n] != lt[la - n]:
                    break
                edge = lambda x, at: at <= 0 or x[at - 1] in space
                if (edge(raw, start - n) or start - n == floor) and edge(lt, la - n):
                    least = start - n
            for n in range(1, 513):
                if end + n > len(raw) or rz + n > len(rt) or raw[end + n - 1] != rt[rz + n - 1]:
                    break
                after = lambda x, at: at == len(x) or x[at] in space or x[at - 1] in space
                if after(raw, end + n) and after(rt, rz + n):
                    most = end + n
            if end - start >= 24 and most - least >= 80 and (j - k > 1 or most - least - (end - start) >= 8):
                if spans and least <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(most, spans[-1][1]))
                else:
                    spans.append((least, most))
            k = j
        out[i, t] = spans
    return out


def th_of(text):
    """Any fixed order of an id's texts: those of these tests have one text for each id that owns."""
    return text


def test_repeated_passages_are_cut(spark):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice(WORDS) for _ in range(2)) for _ in range(n))
    passage = say(70)
    rows = [(1, say(100) + " " + passage + " " + say(50)), (2, say(90) + " " + passage + " " + say(60)), (3, say(120)), (4, None), (5, ""), (None, passage), (6, "é" * 5000)]
    rows += [(7, rows[2][1]), (8, rows[0][1][:300] + " " + rows[0][1])]
    for k in range(40):  # short passages, also at the ends of texts, next to others, in capitals and accents
        some = say(rng.randint(4, 30)) + rng.choice(["", " é", "\n"])
        rows += [(100 + 3 * k, say(rng.randint(0, 40)) + " " + some + rng.choice([" ", "x", ""]) + say(rng.randint(0, 20))), (101 + 3 * k, say(rng.randint(0, 9)) + rng.choice([" ", "", "\n"]) + some + " " + say(rng.randint(0, 9))), (102 + 3 * k, some + " " + some)]
    out = {(r["doc_id"], r["text"] if not r["cut_spans"] else dict(rows)[r["doc_id"]]): r for r in chunkdedup.spans(docs_of(spark, rows)).collect()}
    of = {i: r for (i, _), r in out.items()}
    want = dict(rows)
    assert all(of[i]["text"] == want[i] for i in (1, 3, 4, 5, None))
    assert of[2]["cut_bytes"] >= len(passage) and passage not in of[2]["text"] and of[2]["text"].startswith(want[2][:300])
    assert len(of[7]["text"]) == 0 and of[8]["cut_bytes"] > 0.95 * len(want[8]) - 300 and of[6]["cut_bytes"] > 9000
    plain = plain_cuts(rows)
    assert {k: [(x["start"], x["end"]) for x in r["cut_spans"]] for k, r in out.items() if k[1] and k[0] is not None} == plain
    clean = chunkdedup.deduplicate(docs_of(spark, rows))
    assert clean.columns == ["doc_id", "text", "digest", "shard"] and {(r["doc_id"], r["text"]) for r in clean.collect()} == {(r["doc_id"], r["text"]) for r in out.values()}
    assert chunkdedup.spans(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("words", [25, 40, 55, 100, 300])
def test_recall_of_passages_by_length(spark, words):
    """At least 0.9 of the bytes of passages that two documents share, and next to nothing else."""
    rng = random.Random(words)
    text = [w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(200).collect() for w in (r["text"] or "").split()]
    say = lambda n: " ".join(rng.choice(text) for _ in range(n))
    rows, passages = [], {}
    for k in range(150):
        p = say(words)
        rows += [(k, f"{say(rng.randint(20, 60))} {p} {say(rng.randint(20, 60))}"), (1000 + k, f"{say(rng.randint(20, 60))} {p} {say(rng.randint(20, 60))}")]
        passages[1000 + k] = p
    inside = outside = whole = 0
    for r in chunkdedup.spans(docs_of(spark, rows)).collect():
        raw = dict(rows)[r["doc_id"]].encode()
        a = raw.index(passages[r["doc_id"]].encode()) if r["doc_id"] in passages else 0
        z = a + len(passages[r["doc_id"]].encode()) if r["doc_id"] in passages else 0
        whole += z - a
        for x in r["cut_spans"]:
            both = max(0, min(z, x["end"]) - max(a, x["start"]))
            inside, outside = inside + both, outside + x["end"] - x["start"] - both
    assert inside >= 0.9 * whole and outside <= 0.01 * whole, (words, inside / whole, outside / whole)


def test_equal_rows_and_ids_with_two_texts_in_substrings(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    a, b = say(90), say(90)
    rows = [(1, a), (1, a), (1, b), (2, b), (2, say(20)), (3, a + " " + a)]
    got = Counter((r["doc_id"], r["cut_bytes"] > 0, r["n_repeats"] > 0) for r in chunkdedup.spans(docs_of(spark, rows)).collect())
    assert got == Counter({(1, False, False): 3, (2, True, True): 1, (2, False, False): 1, (3, True, True): 1})


def test_one_equal_chunk_is_left_unless_its_surroundings_are_equal():
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) * 9 for _ in range(40)).encode()
    b, _ = chunkdedup.chunks(text)
    start, end = b[2], b[3]
    assert chunkdedup.cuts(text, [(start, end, 1, b"other words ", b"other words", 0)]) == ([], 0)
    spans, many = chunkdedup.cuts(text, [(start, end, 1, text[:start], text[end:], 0)])
    assert spans[0][0] == 0 and end + 400 < spans[0][1] <= end + chunkdedup.REACH and many == 1  # the whole text agrees
    assert chunkdedup.cuts(text, [(start, b[6], 4, None, None, 0)]) == ([(start, b[6])], 4)
    assert chunkdedup.cuts(text, [(start, end, 1, text[:start], text[end:], start - 5)])[0][0][0] >= start - 5
    found = [(0, 20, 9, 1, 4, 24), (20, 50, 9, 1, 24, 54), (60, 70, 9, 1, 0, 10), (20, 50, 12, 1, 0, 30)]
    assert chunkdedup.anchors(found) == [(0, 50, 2, (9, 1, 4), (9, 1, 54))]


# Packing


def unpacked(out, lengths):
    """The units of each document in order, by its id; checks every bin."""
    parts = {}
    for r in out:
        assert len(r["ids"]) == r["n_units"] == sum(r["sizes"]) and r["offsets"] == [sum(r["sizes"][:k]) for k in range(len(r["sizes"]))]
        if r["bin_id"] is None:
            assert r["n_units"] == 0 and r["bin_length"] is None
        else:
            assert r["bin_length"] == min(c for c in lengths if c >= r["n_units"]) and min(r["sizes"]) > 0
        for doc, start, at, n in zip(r["doc_ids"], r["starts"], r["offsets"], r["sizes"]):
            parts.setdefault(doc, []).append((start, r["ids"][at : at + n]))
    assert len({r["bin_id"] for r in out if r["bin_id"]}) == sum(r["bin_id"] is not None for r in out)
    return parts


def test_every_token_is_packed_once_and_in_order(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, lengths = Tokenizer.from_file(path), (16, 64, 200)
    lib.encode_special_tokens = True
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "word " * 3000), (1004, "<|endoftext|> é" + " " * 3000 + "x\n\n "), (3, rows[3][1]), (3, rows[3][1]), (3, "other"), (None, "w w"), (None, "v"), (None, None)]
    monkeypatch.setattr(packing, "SHARD", 40)
    out = packing.packed(docs_of(spark, rows), path, lengths=lengths).collect()
    parts = unpacked(out, lengths)
    want = {}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, []).append([*ids, 50256] if ids else [])
    for i, texts in want.items():
        if len(texts) == 1:
            assert [u for _, ids in sorted(parts[i]) for u in ids] == texts[0]
        else:
            assert sorted(u for _, ids in parts[i] for u in ids) == sorted(u for t in texts for u in t)
    placed = [r for r in out if r["bin_id"]]
    assert sum(r["n_units"] for r in placed) / sum(r["bin_length"] for r in placed) > 0.85
    key = lambda found: sorted((r["bin_id"] or "", r["ids"], str(r["doc_ids"])) for r in found)
    single = [r for r in rows if r != (3, rows[3][1])]
    a, b = (packing.packed(docs_of(spark, single).repartition(n), path, lengths=lengths).collect() for n in (1, 5))
    assert key(a) == key(b)  # partitions do not matter
    assert packing.packed(docs_of(spark, []), path).count() == 0


def test_packing_of_given_tokens(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, []), (3, None), (4, list(range(70)))], "doc_id long, toks array<int>")
    out = packing.packed(df, tokens_col="toks", lengths=(8, 32), end=9).collect()
    parts = unpacked(out, (8, 32))
    assert {i: [u for _, ids in sorted(p) for u in ids] for i, p in parts.items()} == {1: [5, 6, 7, 9], 2: [], 3: [], 4: [*range(70), 9]}


def test_joint_choice_by_brute_force():
    """The rule, written plainly, over several lengths."""
    rng = random.Random(2)
    for _ in range(60):
        lengths = tuple(sorted(rng.sample(range(4, 60), 3)))
        sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 40))), reverse=True)
        bins = []  # [length, fill]
        placed = []
        for k, size in enumerate(sizes):
            fits = [(c - f, n) for n, (c, f) in enumerate(bins) if c - f >= size]
            room = min(fits)[0] if fits else None
            if fits:
                options = {n for r, n in fits if r == room}
            else:
                left = sum(sizes[k + 1 :])
                each = lambda c: packing.cost(c) / (size + (min(c - size, left) if c - size >= sizes[-1] else 0))  # noqa: E731, B023
                bins.append([min((c for c in lengths if c >= size), key=each), 0])
                options = {len(bins) - 1}
            b = packing.best_fit(sizes, lengths)[0][k]
            assert b in options
            bins[b][1] += size
            placed.append(b)
        assert packing.best_fit(sizes, lengths)[0] == placed


def spent(bins, sizes, lengths):
    fill = Counter()
    for b, s in zip(bins, sizes, strict=True):
        fill[b] += s
    return sum(packing.cost(min(c for c in lengths if c >= f)) for f in fill.values())


def test_joint_choice_is_no_dearer_than_simple_rules():
    rng = random.Random(11)
    clip = lambda x: max(1, min(4096, int(x)))
    shapes = {
        "log-normal": lambda: clip(rng.lognormvariate(6, 1)), "uniform": lambda: rng.randint(1, 4096), "near a half": lambda: rng.randint(260, 500),
        "just under a length": lambda: rng.randint(1500, 2047), "two kinds": lambda: rng.choice([rng.randint(1, 60), rng.randint(2100, 4000)]), "equal": lambda: 700,
    }
    gained = 0
    for draw in shapes.values():
        sizes = sorted((draw() for _ in range(2048)), reverse=True)
        bins, offsets, final = packing.pack(sizes)
        fill = Counter()
        for b, at, s in sorted(zip(bins, offsets, sizes)):
            assert at == fill[b]
            fill[b] += s
        assert all(fill[b] <= c for b, c in enumerate(final)) and len(fill) == len(final)
        mine = sum(map(packing.cost, final))
        simple = [spent(packing.best_fit(sizes, packing.LENGTHS, least)[0], sizes, packing.LENGTHS) for least in packing.LENGTHS]
        assert mine <= min(simple) + 1e-6 and mine == pytest.approx(spent(bins, sizes, packing.LENGTHS))
        gained += mine < min(simple) - 1
    assert gained >= 3


def test_small_shards_cost_the_least_there_is():
    def least(sizes, lengths):
        """All partitions, piece by piece."""
        best = [float("inf")]

        def go(k, fills):
            if k == len(sizes):
                best[0] = min(best[0], sum(packing.cost(min(c for c in lengths if c >= f)) for f in fills))
                return
            for n, f in enumerate(fills):
                if f + sizes[k] <= lengths[-1]:
                    go(k + 1, [*fills[:n], f + sizes[k], *fills[n + 1 :]])
            go(k + 1, [*fills, sizes[k]])

        go(0, [])
        return best[0]

    rng = random.Random(12)
    for _ in range(60):
        lengths = tuple(sorted(rng.sample(range(4, 60), rng.randint(1, 3))))
        sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(1, 8))), reverse=True)
        assert spent(packing.pack(sizes, lengths)[0], sizes, lengths) == pytest.approx(least(sizes, lengths))


def test_best_fit_takes_the_tightest_bin():
    sizes = sorted((random.Random(1).randint(1, 100) for _ in range(400)), reverse=True)
    bins, offsets, fills = packing.best_fit(sizes, (128,))
    rooms = []
    for s, b in zip(sizes, bins, strict=True):
        fits = [r for r in rooms if r >= s]
        if b == len(rooms):
            assert not fits
            rooms.append(128)
        else:
            assert rooms[b] == min(fits)
        rooms[b] -= s
    assert [128 - r for r in rooms] == fills and packing.pack([]) == ([], [], [])


# Near-duplicates


def brute_classes(rows, t=0.8):
    bags = {}
    for i, text in rows:
        if i is None:
            continue
        w = (text or "").split()
        bags[i] = (Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter(), text)
    label = {i: i for i in bags}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, ta) in bags.items():
        for j, (b, tb) in bags.items():
            low = sum((a & b).values())
            if j < i and (low and low / sum((a | b).values()) >= t or ta is not None and ta == tb):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i in bags}


def family_rows(seed=6):
    rng = random.Random(seed)
    say = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    rows, n = [], 0
    for size, edits in ((40, (0, 14)), (12, (0, 3)), (25, (4, 10))):
        base = say(150)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(*edits)):
                k, how = rng.randrange(len(w)), rng.random()
                if how < 0.6:
                    w[k] = rng.choice(WORDS) + "q"
                elif how < 0.8:
                    del w[k : k + rng.randint(1, 4)]
                else:
                    w[k:k] = say(2)
            rows.append((n := n + 1, " ".join(w)))
    rows += [(n + k, " ".join(say(80))) for k in range(1, 20)]
    return rows


@pytest.mark.parametrize("seed", [6, 7])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = family_rows(seed)
    rows += [(500, None), (501, None), (502, ""), (503, ""), (504, " "), (505, "one two"), (506, "one  two"), (507, "solo"), (None, rows[0][1]), (508, rows[0][1]), (509, "x " * 3000), (510, "x " * 2990), rows[0]]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("seed, shrunk", [(6, 0.0), (8, 0.5), (9, 0.9)])
def test_divided_blocks_equal_brute_force(spark, monkeypatch, seed, shrunk):
    """Blocks of more than two documents are divided; one line that a third of all share, and one large near group."""
    for name, value in (("FEW", 2), ("SAMPLED", 6), ("SHRUNK", shrunk)):
        monkeypatch.setattr(dartminhash, name, value)
    rng = random.Random(seed)
    line = " ".join(rng.choice(WORDS) * 2 for _ in range(60))
    rows = [(i, f"{t} {line}" if i % 3 == 0 else t) for i, t in family_rows(seed)]
    got = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    import corpus_pipeline

    a, b, c = ("a " * 30).strip(), " ".join(WORDS[:40]), " ".join(WORDS[40:80])
    rows = [(5, b), (5, a), (3, a), (7, b), (8, None), (8, c), (9, c), (11, c), (11, "zz " + c[::-1]), (None, a)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in dartminhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {3: (3, 2), 5: (3, 2), 7: (7, 1), 8: (8, 3), 9: (8, 3), 11: (8, 3)}
    left = corpus_pipeline.near_duplicate_stage(spark, docs_of(spark, rows), "")
    assert left.columns == ["doc_id", "text", "digest", "shard"]
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(3, a), (7, b), (8, None), (8, c), (11, "zz " + c[::-1]), (None, a)])
    assert corpus_pipeline.near_duplicate_stage(spark, docs_of(spark, [(5, a), (5, b), (3, a)]), "").count() == 2  # b has no other copy


def exact_pairs(texts, t=0.8):
    """All pairs of different texts with a weighted Jaccard similarity of at least t, by an index of all shingles."""
    bags = [dartminhash.bag(x.encode()) for x in texts]
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    kinds, counts = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    order = np.argsort(kinds, kind="stable")
    kinds, owner, counts = kinds[order], owner[order], counts[order]
    size, out = np.array([b[1].sum() for b in bags]), []
    for i, (mine, times) in enumerate(bags):
        low = np.zeros(len(bags), np.int64)
        for a, z, c in zip(np.searchsorted(kinds, mine), np.searchsorted(kinds, mine, side="right"), times):
            if z - a > 1:
                np.add.at(low, owner[a:z], np.minimum(counts[a:z], c))
        out += [(i, int(j)) for j in np.flatnonzero(low >= t * np.maximum(size[i] + size - low, 1)) if j < i]
    return out


def test_recall_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    label = {r["doc_id"]: r["class_id"] for r in dartminhash.near_duplicates(docs).collect()}
    first = {}
    for r in docs.collect():
        first[r["text"]] = min(r["doc_id"], first.get(r["text"], r["doc_id"]))
        assert label[r["doc_id"]] is not None
    texts, ids = list(first), list(first.values())
    pairs = exact_pairs(texts)
    assert len(pairs) >= 40 and np.mean([label[ids[i]] == label[ids[j]] for i, j in pairs]) >= 0.99


def test_near_duplicates_of_nothing(spark):
    assert dartminhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in dartminhash.near_duplicates(docs_of(spark, [(4, "a b")])).collect()] == [(4, 4, 1)]


def test_overlaps_of_bags():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["", "a b a b a b a b a b a b a b"]
    bags = [dartminhash.bag(t.encode()) for t in texts]
    low, sizes = dartminhash.overlaps(bags)
    for i, (a, na) in enumerate(bags):
        assert sizes[i] == na.sum()
        for j, (b, nb) in enumerate(bags):
            want = sum((Counter(dict(zip(a.tolist(), na.tolist()))) & Counter(dict(zip(b.tolist(), nb.tolist())))).values())
            assert low[i, j] == want or i == j and low[i, j] <= want


def test_darts_estimate_weighted_similarity():
    a, b = np.array([1, 50, 7]), np.array([3, 20, 7])
    same = []
    for k in range(60):
        e = np.sort(dartminhash.mix64(np.array([1, 2, 3], np.uint64) + np.uint64(1000 * k)))
        s = dartminhash.signatures([(e, a), (e, b)])
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - 28 / 60) < 0.02


def test_short_texts_are_sketched_in_small_lots():
    """The darts of a short text take far more memory than the text."""
    rows = pd.DataFrame({"doc_id": range(4000), "text": [f"{WORDS[k % 100]} {WORDS[k // 100]} a b c {k}" for k in range(4000)], "digest": "d"})
    one = next(dartminhash.sketches([rows[:1]]))
    tracemalloc.start()
    got = pd.concat(dartminhash.sketches([rows[k : k + 1000] for k in range(0, 4000, 1000)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["doc_id"].tolist() == list(range(4000)) and got["keys"].iloc[0].tolist() == one["keys"].iloc[0].tolist()
    assert peak < 80e6


def test_words_and_shingles():
    raw = "the cat  sat\non the cat sat on the".encode()
    w = dartminhash.word_hashes(raw)
    assert len(w) == 9 and w[0] == w[4] == w[8] and w[1] == w[5] and len(set(w.tolist())) == 4
    assert len(dartminhash.shingles(raw)) == 5 and len(dartminhash.shingles(b"")) == 0 and len(dartminhash.shingles(b"a b")) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(3, 64))
    vectors = {i: centre[i % 3] + rng.normal(size=64) for i in range(260)} | {i: centre[0] for i in range(1000, 1040)}
    rows = [(i, [float(x) for x in v], "c") for i, v in vectors.items()] + [(50, [float(x) for x in vectors[50]], "c"), (2000, None, "c"), (2050, [], "c"), (None, [1.0] * 64, "c")]
    got = {}
    for r in mih.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    bits = {i: v > 0 for i, v in vectors.items()}
    assert set(got) == {i for i in vectors if i % 50 == 0}
    for q, found in got.items():
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:10]
        assert [(d, i) for _, d, i in sorted(found)] == want


@pytest.mark.parametrize("size", [3, 65, 128])
def test_top_k_of_long_vectors(spark, size):
    rng = np.random.default_rng(size)
    centre = rng.normal(size=(3, size))
    vectors = {i: centre[i % 3] + 0.2 * rng.normal(size=size) for i in range(60)}
    vectors[7] = vectors[7][:40]
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    got = [tuple(r) for r in mih.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).collect()]
    bits = {i: np.pad(v > 0, (0, size - len(v))) for i, v in vectors.items()}
    want = []
    for q in (0, 50):
        near = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:3]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted(got) == want


@pytest.mark.parametrize("width", [13, 32])
def test_search_by_segments_of_any_width(spark, width):
    rng = np.random.default_rng(width)
    centre = rng.normal(size=(4, 100))
    vectors = {i: centre[i % 4] * (i % 3 > 0) + rng.normal(size=100) for i in range(150)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, v array<float>")
    codes = df.select("id", mih.sign_code(F.col("v"), 100, width).alias("code"))
    got = [tuple(r) for r in mih.search(codes, codes.filter("id % 30 = 0"), 4, width, 100).collect()]
    bits = {i: v > 0 for i, v in vectors.items()}
    want = []
    for q in range(0, 150, 30):
        near = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:4]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted(got) == want and mih.width_for(51_000) == 16 and mih.width_for(10**12) == 32


def test_top_k_of_few(spark):
    rows = [(0, [1.0] * 64), (50, [1.0] * 63 + [-1.0]), (7, [-1.0] * 64)]
    got = sorted((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in mih.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 50, 1), (0, 2, 7, 64), (50, 1, 0, 1), (50, 2, 7, 63)]
    assert mih.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.filter("n_chars <> length(text)").count() == 0
    final = corpus_pipeline.run(spark, sf)
    assert {i for r in final.select("doc_ids").collect() for i in r["doc_ids"]} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls, empty and repeated rows, columns with clashing names, no rows, no labels."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, block long"
    say = " ".join(WORDS[k % 60] + WORDS[(7 * k) % 60] for k in range(200))
    rows = [(1, say), (1, say), (2, say), (3, None), (4, ""), (4, ""), (None, say), (None, None), (5, None), (6, "é " * 4000), (7, "x" * 300_000)]
    odd = spark.createDataFrame([(i, t, None, None, None, 0.5, "d", 3) for i, t in rows], schema)
    import pathlib
    import tempfile

    folder = pathlib.Path(tempfile.mkdtemp())
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = stage(spark, docs, str(folder)).cache()
            assert docs.columns == odd.columns
            if name != "near_duplicates":
                assert docs.count() == before, name
        docs.count()
        left = Counter(r["doc_id"] for r in docs.collect())
        assert left == (Counter() if before == 0 else Counter({1: 1, 3: 1, 4: 1, None: 2, 5: 1, 6: 1, 7: 1}))
        bins = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
        assert Counter(i for r in bins for i in set(r["doc_ids"])).keys() == left.keys()
