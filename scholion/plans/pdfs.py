"""PDF files made of texts: inputs for the PDF scan, since the tables have none.

Three kinds of files, by a number: classic cross references and WinAnsi strings; compressed streams and a font with
its own codes; cross-reference and object streams. A page has ``LINES`` lines.
"""

from __future__ import annotations

import re
import zlib

LINES = 40
WIDTH, HEIGHT, SIZE, LEADING, LEFT, FIRST = 612, 792, 10, 12, 36, 750


def _literal(raw: bytes) -> bytes:
    return b"(" + re.sub(rb"[()\\\r\n]", lambda m: b"\\%03o" % m[0][0], raw) + b")"


def _stream(info: bytes, raw: bytes, packed: bool) -> bytes:
    raw, more = (zlib.compress(raw, 1), b" /Filter /FlateDecode") if packed else (raw, b"")
    return b"<< %s%s /Length %d >>\nstream\n%s\nendstream" % (info, more, len(raw), raw)


def write(lines: list[str], style: int = 0, locked: bool = False) -> bytes:
    """A PDF with ``lines``, each as one line of text; empty ones take room only."""
    pages = [lines[k : k + LINES] for k in range(0, len(lines), LINES)]
    codes: dict[str, int] = {}
    try:
        plain = style == 0 and [[x.encode("cp1252") for x in page] for page in pages]
    except UnicodeEncodeError:
        plain = False
    if plain:
        encoded = [[_literal(x) + b" Tj" for x in page] for page in plain]
        fonts = {3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [%s] >>" % b" ".join([b"600"] * 256)}
    else:
        for c in dict.fromkeys("".join(lines)):
            codes[c] = len(codes) + 1
        hexed = lambda s: b"<" + b"".join(b"%04X" % codes[c] for c in s) + b">"
        encoded = [[b"[" + hexed(x[: len(x) // 2]) + b" -20 " + hexed(x[len(x) // 2 :]) + b"] TJ" for x in page] for page in pages]
        pairs = [b"<%04X> <%s>" % (k, c.encode("utf-16-be", "surrogatepass").hex().upper().encode()) for c, k in codes.items()]
        blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(pairs[k : k + 100]), b"\n".join(pairs[k : k + 100])) for k in range(0, len(pairs), 100)]
        cmap = b"begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n%s\nendcmap" % b"\n".join(blocks)
        fonts = {
            3: b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
            4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>",
            5: _stream(b"", cmap, True),
        }
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", **fonts}
    kids = []
    for k, page in enumerate(encoded):
        shows = b"\nT*\n".join(x if raw else b"" for x, raw in zip(page, pages[k], strict=True))
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = _stream(b"", b"BT /F1 %d Tf %d TL %d %d Td\n%s\nET" % (SIZE, LEADING, LEFT, FIRST, shows), style > 0)
        kids.append(b"%d 0 R" % (10 + 2 * k))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(kids), WIDTH, HEIGHT)
    lock = b" /Encrypt << /Filter /Standard >>" if locked else b""
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    if style == 2:
        packed = {n: x for n, x in objects.items() if b"\nstream\n" not in x}
        head, body = [], b""
        for n, x in packed.items():
            head.append(b"%d %d" % (n, len(body)))
            body += x + b"\n"
        front = b" ".join(head) + b"\n"
        objects = {n: x for n, x in objects.items() if n not in packed} | {7: _stream(b"/Type /ObjStm /N %d /First %d" % (len(packed), len(front)), front + body, True)}
    for n, x in sorted(objects.items()):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    at, size = len(out), max([*objects, 9]) + 1 + 2 * (style == 2) * len(pages)
    if style == 2:
        rows, before = b"", bytes(7)
        for n in range(size):
            row = (2).to_bytes() + (7).to_bytes(4) + list(packed).index(n).to_bytes(2) if n in packed else (1).to_bytes() + places[n].to_bytes(4) + bytes(2) if n in places else bytes(7)
            rows += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before))
            before = row
        out += b"8 0 obj\n%s\nendobj\n" % _stream(b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R%s /DecodeParms << /Predictor 12 /Columns 7 >>" % (size, lock), rows, True)
    else:
        out += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(size))
        out += b"trailer\n<< /Size %d /Root 1 0 R%s >>\n" % (size, lock)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)
