"""PDF files made here: plain, with object and reference streams, code maps, predictors, forms; broken ones."""

import zlib

import pytest
from pyspark.sql import functions as F

from lakefind.sources import extract, pdf


def stream(about: str, data: bytes, flate: bool = True) -> bytes:
    data = zlib.compress(data) if flate else data
    return f"<< {about} {'/Filter /FlateDecode ' if flate else ''}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


def objects(pages: list[bytes], font: str = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", more: dict[int, bytes] | None = None, xobjects: str = "", nested: bool = False) -> dict[int, bytes]:
    """Catalogue 1, page tree 2, font 3, then two objects for each page."""
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font.encode()}
    kids = []
    for k, content in enumerate(pages):
        n = 10 + 2 * k
        kids.append(f"{n} 0 R")
        out[n] = f"<< /Type /Page /Parent {'4' if nested else '2'} 0 R /Contents {n + 1} 0 R >>".encode()
        out[n + 1] = stream("", content)
    about = f"/MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> /XObject << {xobjects} >> >>"
    if nested:
        out[2] = f"<< /Type /Pages {about} /Count {len(kids)} /Kids [4 0 R] >>".encode()
        out[4] = f"<< /Type /Pages /Parent 2 0 R /Count {len(kids)} /Kids [{' '.join(kids)}] >>".encode()
    else:
        out[2] = f"<< /Type /Pages {about} /Count {len(kids)} /Kids [{' '.join(kids)}] >>".encode()
    return out | (more or {})


def plain_file(objs: dict[int, bytes], broken: bool = False) -> bytes:
    data, at = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, o in objs.items():
        at[n] = len(data)
        data += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    start, top = len(data), max(objs) + 1
    rows = "".join(f"{at[n]:010d} 00000 n \n" if n in at else "0000000000 65535 f \n" for n in range(top))
    return data + f"xref\n0 {top}\n{rows}trailer\n<< /Size {top} /Root 1 0 R >>\nstartxref\n{7 if broken else start}\n%%EOF".encode()


def packed_file(objs: dict[int, bytes], predictor: bool = False) -> bytes:
    """All but streams in an object stream, references in a stream."""
    data, at = b"%PDF-1.5\n", {}
    inner = {n: o for n, o in objs.items() if b"stream" not in o}
    for n, o in objs.items():
        if n not in inner:
            at[n] = (1, len(data), 0)
            data += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    box, refs = max(objs) + 1, max(objs) + 2
    heads, body = "", b""
    for k, (n, o) in enumerate(inner.items()):
        heads += f"{n} {len(body)} "
        body += o + b" "
        at[n] = (2, box, k)
    at[box] = (1, len(data), 0)
    data += f"{box} 0 obj\n".encode() + stream(f"/Type /ObjStm /N {len(inner)} /First {len(heads)}", heads.encode() + body) + b"\nendobj\n"
    at[refs] = (1, len(data), 0)
    rows = [bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (at.get(n, (0, 0, 0)) for n in range(refs + 1))]
    how = ""
    if predictor:
        how = "/DecodeParms << /Predictor 12 /Columns 7 >> "
        rows = [b"\2" + bytes((x - y) & 255 for x, y in zip(r, before, strict=True)) for r, before in zip(rows, [bytes(7), *rows], strict=False)]
    return data + f"{refs} 0 obj\n".encode() + stream(f"/Type /XRef /Size {refs + 1} /W [1 4 2] {how}/Root 1 0 R", b"".join(rows)) + f"\nendobj\nstartxref\n{at[refs][1]}\n%%EOF".encode()


LINES = [["First line (with brackets) of page one.", "Second line, 100 % \\ done.", "", "A new paragraph äöü €5."], ["Page two has one line."]]


def content(lines: list[str]) -> bytes:
    out = b"BT /F1 12 Tf 14 TL 50 700 Td\n"
    for x in lines:
        raw = x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        out += b"T*\n" if not x else b"(" + raw + b") Tj T*\n"
    return out + b"ET"


def texts(data: bytes) -> list[str]:
    return [p.text for p in pdf.read_pages(data)]


def wanted(lines):
    return ["\n".join(x).replace("\n\n", "\n\n") for x in lines]


@pytest.mark.parametrize("nested", [False, True])
def test_what_was_written_is_read(nested):
    objs = objects([content(x) for x in LINES], nested=nested)
    want = wanted(LINES)
    for data in (plain_file(objs), packed_file(objs), packed_file(objs, predictor=True), plain_file(objs, broken=True), packed_file(objs).replace(b"startxref", b"startxxxx")):
        assert texts(data) == want


def test_a_newer_revision_counts():
    first = plain_file(objects([content(["old text of the page"])]))
    at = len(first) + 1
    new = stream("", content(["new text of the page"]))
    more = b"\n11 0 obj\n" + new + b"\nendobj\n"
    start = len(first) + len(more)
    prev = first.rindex(b"xref\n0")
    last = f"xref\n11 1\n{at:010d} 00000 n \ntrailer\n<< /Size 12 /Root 1 0 R /Prev {prev} >>\nstartxref\n{start}\n%%EOF".encode()
    assert texts(first + more + last) == ["new text of the page"]


def test_code_maps_and_wide_fonts():
    text = "日本語と中文 ﬁn"
    codes = {c: k + 1 for k, c in enumerate(dict.fromkeys(text))}
    chars = "".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, k in codes.items())
    cmap = f"/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(codes)} beginbfchar\n{chars}endbfchar\n2 beginbfrange <0100> <0104> <0041> <0200> <0201> [<0058> <00590059>] endbfrange".encode()
    font = "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [6 0 R] >>"
    more = {5: stream("", cmap), 6: b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [1 [500 600] 3 9 700] >>"}
    shown = "".join(f"{codes[c]:04x}" for c in text) + "010001040200" + "0201"
    objs = objects([f"BT /F1 10 Tf 1 0 0 1 40 500 Tm <{shown}> Tj ET".encode()], font, more)
    assert texts(plain_file(objs)) == texts(packed_file(objs)) == [text + "AEXYY"]


def test_differences_spaces_and_forms():
    font = "<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250 500 500 500] /Encoding << /Differences [33 /H /eacute /uni4E2D /fi 40 /quoteright] >> >>"
    form = {7: stream("/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -40] /Resources << /Font << /F1 3 0 R >> >>", b"BT /F1 10 Tf 50 600 Td (!) Tj ET")}
    page = b"q BT /F1 10 Tf 50 600 Td [(!\") -600 (#) 20 ($)] TJ 200 0 Td (\\050) Tj ET Q /X1 Do"
    assert texts(plain_file(objects([page], font, form, "/X1 7 0 R"))) == ["Hé 中fi ’\n\nH"]


def library(spark, files):
    return spark.createDataFrame([("l", k, f"h{k}", v) for k, v in files.items()], "library_id string, path string, content_hash string, content binary")


def test_pages_kinds_and_failures(spark):
    picture = {8: stream("/Type /XObject /Subtype /Image /Width 1 /Height 1", b"\0")}
    mixed = [content(LINES[0]), b"q 600 0 0 800 0 0 cm /Im Do Q", b"", b"BT /F1 9 Tf (x) Tj ET q 10 0 0 10 0 0 cm BI /W 1 /H 1 ID \xff(BT\x00 EI Q"]
    scan = [b"q 600 0 0 800 0 0 cm /Im Do Q"] * 2
    mark = [content(["draft copy only"])] * 3
    good = plain_file(objects([content(x) for x in LINES]))
    files = {"good.pdf": good, "mixed.PDF": plain_file(objects(mixed, more=picture, xobjects="/Im 8 0 R")), "scan.pdf": plain_file(objects(scan, more=picture, xobjects="/Im 8 0 R")), "mark.pdf": plain_file(objects(mark)), "bad.pdf": b"%PDF-1.4 nothing", "none.pdf": None, "not.pdf": b"hello", "cut.pdf": good[: len(good) // 3], "locked.pdf": good.replace(b"/Size", b"/Encrypt 3 0 R /Size"), "a.txt": b"plain"}
    p = pdf.classified(pdf.pages(library(spark, files))).cache()
    kinds = {(r.path, r.page): (r.kind, r.has_image) for r in p.filter("page is not null").collect()}
    assert [kinds["mixed.PDF", k] for k in (1, 2, 3, 4)] == [("text", False), ("image", True), ("blank", False), ("image", True)]
    got = {r.path: r for r in pdf.documents(p).collect()}
    assert got["good.pdf"].text == "\n\n".join(wanted(LINES)) and got["good.pdf"].failure_state is None and got["good.pdf"].image_pages == []
    assert got["mixed.PDF"].image_pages == [2, 4] and got["mixed.PDF"].text.startswith("First line")
    assert (got["scan.pdf"].failure_state, got["scan.pdf"].image_pages, got["scan.pdf"].text) == ("scanned", [1, 2], None)
    assert (got["mark.pdf"].failure_state, got["mark.pdf"].image_pages) == ("scanned", [1, 2, 3])
    assert {k: got[k].failure_state for k in ("bad.pdf", "none.pdf", "not.pdf", "locked.pdf")} == {"bad.pdf": "extract-failed", "none.pdf": "unreadable", "not.pdf": "extract-failed", "locked.pdf": "extract-failed"}
    assert "a.txt" not in got
    routes = extract.routed(p.filter("page is not null").select("library_id", "path", "page", "kind"), 5)
    assert {r.path: (r.route, r.n) for r in routes.filter("n > 0").collect()} == {"mixed.PDF": ("ocr", 2), "scan.pdf": ("ocr", 2)}


def test_provider_in_the_chain(spark):
    good = plain_file(objects([content(x) for x in LINES]))
    out = extract.extracted(library(spark, {"a.pdf": good, "b.pdf": b"%PDF broken", "c.md": b"# t"}), [extract.PLAIN, pdf.PDF]).select("path", "failure_state", "provider", F.length("text").alias("n"))
    got = {r.path: (r.failure_state, r.provider) for r in out.collect()}
    assert got == {"a.pdf": (None, "pdf-text"), "b.pdf": ("extract-failed", "pdf-text"), "c.md": (None, "text")}


def test_random_bytes_never_hang():
    import random

    r = random.Random(2)
    good = packed_file(objects([content(x) for x in LINES]))
    for _ in range(60):
        b = bytearray(good)
        for _ in range(r.randint(1, 40)):
            b[r.randrange(len(b))] = r.randrange(256)
        try:
            list(pdf.read_pages(bytes(b)))
        except (ValueError, KeyError, TypeError, AttributeError, IndexError, zlib.error, pdf.End, RecursionError):
            pass
