"""PDF files, places of characters, and intervals."""

import random

import pytest
from pyspark.sql import functions as F

from scholion.functions import charmap
from scholion.plans import pdfs
from scholion.sources import documents as src
from scholion.sources import pdf

TEXT = [f"Line {k} of a paper (with) \\ é “quotes” and words enough" for k in range(95)]


def shown(pages):
    return ["".join(s[0] for s in line) for _, _, lines in pages for line in lines]


@pytest.mark.parametrize("style", [0, 1, 2])
def test_files_are_read_back(style):
    for lines in (TEXT, ["", "x", "", ""], [], ["日本語 𝒳 \r\t\x00 end", " spaces  kept "], ["word " * 4000]):
        raw = pdfs.write(lines, style)
        pages = pdf.parse(raw)
        assert len(pages) == -(-len(lines) // pdfs.LINES) and shown(pages) == [x for x in lines if x]
        assert all((w, h) == (612, 792) for w, h, _ in pages)
    with pytest.raises(pdf.Encrypted, match="password"):
        pdf.parse(pdfs.write(TEXT, style, True))
    with pytest.raises(pdf.Malformed):
        pdf.parse(pdfs.write(TEXT, style)[20:])
    raw = pdfs.write(TEXT, style)
    lost = raw[: raw.rindex(b"startxref")] + b"startxref\n7\n%%EOF"
    assert shown(pdf.parse(lost)) == TEXT  # found without the cross references


def test_broken_files_say_so():
    rng, seen = random.Random(1), set()
    for k in range(150):
        raw = bytearray(pdfs.write(TEXT[:50], k % 3))
        for _ in range(rng.randint(1, 30)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            pdf.parse(bytes(raw[: rng.randrange(len(raw))] if k % 5 == 0 else raw))
            seen.add("read")
        except (pdf.Malformed, pdf.Encrypted, NotImplementedError) as e:
            seen.add(type(e).__name__)
    assert "Malformed" in seen and "read" in seen


def by_hand(content: bytes, fonts: bytes = b"<< /F 4 0 R >>", font: bytes = b"<< /Type /Font /Subtype /TrueType /FirstChar 65 /Widths [1000 500] >>", more: bytes = b"") -> bytes:
    head = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [10 10 210 110] >> endobj\n"
    page = b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font " + fonts + b" /XObject << /X 6 0 R >> >> >> endobj\n4 0 obj " + font + b" endobj\n"
    return head + page + b"5 0 obj << /Length 8 0 R >> stream\n" + content + b"\nendstream endobj\n8 0 obj " + str(len(content)).encode() + b" endobj\n" + more + b"trailer << /Root 1 0 R >>"


def test_text_operators():
    spans = lambda content, **k: pdf.parse(by_hand(content, **k))[0][2]
    assert spans(b"BT /F 10 Tf 20 60 Td (AB) Tj ET") == [[("AB", 10.0, 42.0, 25.0, 52.0)]]
    assert spans(b"BT /F 10 Tf 20 60 Td [(A) -600 (B) 10 (A)] TJ ET")[0][0][0] == "A BA"  # a gap is a space
    assert [x[0][0] for x in spans(b"BT /F 10 Tf 12 TL 20 60 Td (A) Tj T* (B) Tj (A) ' 1 2 (B) \" 0 -5 TD (AB) Tj ET")] == ["A", "B", "A", "B", "AB"]
    assert [s[0] for s in spans(b"BT /F 10 Tf 1 0 0 1 20 60 Tm (A) Tj 1 0 0 1 60 60 Tm (B) Tj ET")[0]] == ["A ", "B"]
    assert spans(b"q 2 0 0 2 0 0 cm BT /F 5 Tf 10 30 Td (A) Tj ET Q")[0][0][1:] == (10.0, 42.0, 20.0, 52.0)
    assert spans(b"BT /F 10 Tf 20 60 Td <41 42 4> Tj ET")[0][0][0] == "AB@" and spans(b"BT /F 10 Tf 20 60 Td (\\101\\(x\\)\\\n(in)) Tj ET")[0][0][0] == "A(x)(in)"
    assert spans(b"BI /W 1 ID (A) Tj \x00\xff EI BT /F 10 Tf 20 60 Td (B) Tj ET")[0][0][0] == "B"
    form = b"6 0 obj << /Subtype /Form /Matrix [1 0 0 1 5 0] /Length 36 >> stream\nBT /F 10 Tf 20 60 Td (AB) Tj ET /X Do\nendstream endobj\n"
    found = [x for line in spans(b"/X Do", more=form) for x in line]  # a form that shows itself ends
    assert found[0][1] == 15.0 and {x[0].strip() for x in found} == {"AB"} and len(found) == pdf.NESTED
    assert spans(b"BT /F 10 Tf 20 60 Td (AB) Tj ET", font=b"<< /Type /Font /Encoding << /Differences [65 /uni00E9 /x] >> >>")[0][0][0] == "éx"
    with pytest.raises(pdf.Malformed):
        pdf.parse(by_hand(b"BT 20 Td ET"))


def test_faults_are_rows_of_their_kinds(spark, tmp_path):
    files = {
        "good.pdf": pdfs.write(TEXT, 2), "UPPER.PDF": pdfs.write(TEXT, 1), "locked.pdf": pdfs.write(TEXT, 1, True), "broken.pdf": b"%PDF-1.4 nothing", "none.pdf": pdfs.write([], 0),
        "short.pdf": pdfs.write(["too short"], 0), "filter.pdf": pdfs.write(TEXT, 1).replace(b"/FlateDecode", b"/CryptDecode"), "note.txt": b"text",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = src.assembled(src.scan_pdf(src.scan_files(spark, str(tmp_path)))).collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["page_number"], r["error"], r["char_count"]))
    errors = {name: found[0][1] for name, found in got.items()}
    assert errors == {"good.pdf": None, "UPPER.PDF": None, "locked.pdf": "PasswordProtectedError", "broken.pdf": "CorruptedFileError", "none.pdf": "ExtractionQualityError", "short.pdf": "NoTextLayerError", "filter.pdf": "PdfError"}
    assert [p for p, _, _ in sorted(got["good.pdf"])] == [1, 2, 3]
    texts = {r["page_number"]: r["text"] for r in rows if r["path"].endswith("good.pdf")}
    assert "".join(texts[k] for k in (1, 2, 3)) == "\n".join(TEXT) + "\n"
    assert src.scan_pdf(src.scan_files(spark, str(tmp_path)).limit(0)).count() == 0


def test_positions_and_spans_of_pages(spark):
    lines = [[("ab", 0.0, 0.0, 4.0, 2.0), ("c\n", 4.0, 0.0, 8.0, 2.0)], [], [("", 0.0, 3.0, 0.0, 5.0)], [("xyz", 1.0, 6.0, 7.0, 8.0)]]
    schema = "path string, page_number int, lines array<array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>"
    pages = src.assembled(spark.createDataFrame([("p", 1, lines), ("p", 2, [[("q", 5.0, 5.0, 6.0, 6.0)]]), ("p", None, None), ("r", 1, [])], schema))
    got = {(r["path"], r["page_number"]): r for r in src.page_positions(pages).collect()}
    assert got["p", 1]["text"] == "abc\nxyz\n" and got["p", 2]["text"] == "q\n" and got["r", 1]["text"] == ""
    at = [(p["char_index"], p["x"], p["y"]) for p in got["p", 1]["positions"]]
    assert at == [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 4.0, 0.0), (3, 6.0, 0.0), (4, 1.0, 6.0), (5, 3.0, 6.0), (6, 5.0, 6.0), (7, 0.0, 8.0)]
    assert len(got["p", 2]["positions"]) == 2 and got["p", 2]["positions"][1]["bbox"]["x1"] == 0.0
    spans = sorted(tuple(r) for r in src.page_spans(pages, "path").select("path", "page_number", "from", "to", "x0").collect())
    assert spans == [("p", 1, 0, 2, 0.0), ("p", 1, 2, 4, 4.0), ("p", 1, 4, 4, 0.0), ("p", 1, 4, 7, 1.0), ("p", 2, 9, 10, 5.0)]


def test_runs_say_what_a_map_says(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice(["word", "tion-\n tail", "  ", "\n", "\n\n\n", "(Lee et  al. 2020)", " ", "© 2023 X\n", "12\n", "[1,  2]", "é-\nß"])
    texts = ["".join(piece() for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "\n\n", "© 2023 X\n" * 4 + "end", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", charmap.traced(F.col("t")).alias("r"), charmap.char_mapping(F.col("t")).alias("m"), charmap.original_index(charmap.char_runs(F.col("t")), F.lit(7)).alias("at")).collect()
    for r in rows:
        text = texts[r["i"]]
        if text is None:
            assert r["r"] is None and r["m"] is None
            continue
        clean, plain = charmap.mapped(text)
        assert r["r"]["cleaned"] == clean and r["m"] == plain and r["at"] == plain.get(7, -1)
        assert all(clean[c] == text[o] or clean[c] in " \n" and text[o] in " \n" for c, o in plain.items())
        runs = [tuple(x) for x in r["r"]["runs"]]
        assert all(a + n <= b for (a, _, n), (b, _, _) in zip(runs, runs[1:])) and sum(n for _, _, n in runs) == len(plain)
        assert len(runs) <= 1 + 3 * sum(text.count(x) for x in ("\n", "  ", "-"))


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_intervals_meet_as_in_a_plain_loop(spark, block):
    rng = random.Random(block)
    some = lambda n: [(rng.choice("xyz"), k, a := rng.randint(0, 200), a + rng.randint(0, 60)) for k in range(n)]
    a, b = some(60), some(60)
    left = spark.createDataFrame(a, "key string, i int, start int, end int")
    right = spark.createDataFrame(b, "key string, j int, from int, to int")
    got = sorted((r["i"], r["j"]) for r in charmap.overlapping(left, right, "key", block).collect())
    assert got == sorted((i, j) for k, i, s, e in a for m, j, f, t in b if k == m and s < t and f < e and s < e and f < t)


def test_coordinates_of_elements(spark):
    runs = spark.createDataFrame([("d", [(0, 0, 5), (5, 8, 4), (10, 20, 5)])], f"k string, runs {charmap.RUNS}")
    spans = spark.createDataFrame([("d", 1, 0, 5, 1.0, 1.0, 6.0, 2.0), ("d", 1, 6, 12, 2.0, 3.0, 8.0, 4.0), ("d", 2, 20, 30, 0.0, 0.0, 10.0, 1.0)], "k string, page_number int, from int, to int, x0 double, y0 double, x1 double, y1 double")
    wanted = [("d", 1, 0, 3), ("d", 2, 3, 7), ("d", 3, 8, 12), ("d", 4, 9, 10), ("d", 5, 12, 12), ("e", 6, 0, 5)]
    got = charmap.element_coordinates(spark.createDataFrame(wanted, "k string, e int, start int, end int"), runs, spans, "k", "e")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("d", 1, 1, 1.0, 1.0, 5.0, 1.0, 0, 3), ("d", 2, 1, 1.0, 1.0, 7.0, 3.0, 3, 10), ("d", 3, 1, 2.0, 3.0, 6.0, 1.0, 11, 22),
    ]


def test_chunks_in_one_pass(spark):
    from scholion import queries

    plan = queries.QUERIES["prepared_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan
