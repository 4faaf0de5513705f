"""Text of PDF files: three forms of producers, hand-made pages, damaged and encrypted files."""

import zlib

import pytest

from lexweave.__main__ import main
from lexweave.plans.made_pdf import pdf_bytes
from lexweave.sources import pdf, readers

PAGES = [["first (line) \\ of é", "  and 𝔘nicode\tend ", "x"], ["only ☃ one"], *[[f"page {i}", f"line {i} of it"] for i in range(30)]]


def opened(data):
    return pdf.Pdf(lambda at, n: data[at : at + n], len(data))


def texts(data):
    held = opened(data)
    return [held.page_text(n) for n in held.page_numbers()]


def one_page(content, fonts="/F1 << /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>", rest="", more=()):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << {fonts} >> {rest} >> >>".encode(), b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream", *more]
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places) + b"trailer\n<< /Size 9 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


@pytest.mark.parametrize("form", [0, 1, 2])
def test_three_forms(form):
    data = pdf_bytes(PAGES, form)
    assert texts(data) == ["\n".join(p) for p in PAGES]
    assert texts(data.replace(b"startxref", b"startxxxx")) == ["\n".join(p) for p in PAGES]  # places found without tables


def test_lines_and_spaces():
    assert texts(one_page(b"BT /F1 10 Tf 10 700 Td (one) Tj 18 0 Td (two) Tj 30 0 Td (three) Tj 0 -12 Td (four) Tj ET")) == ["onetwo three\nfour"]
    assert texts(one_page(b"BT /F1 10 Tf [(a) -300 (b) 20 (c)] TJ 21 3 Td (d) Tj T* (e) Tj ET")) == ["a bcde"]
    assert texts(one_page(b"BT /F1 10 Tf 12 TL (a) ' 1 2 (b) \" (c\\051\\\nd) Tj <65 6> Tj ET % (no)\n")) == ["a\nbc)de`"]
    assert texts(one_page(b"BI /W 1 /H 1 ID (\x00 EIx)\nEI BT /F1 1 Tf 0 1 -1 0 0 0 Tm (up) Tj 1 0 0 1 50 50 Tm (on) Tj ET")) == ["up\non"]


def test_encodings():
    named = "/F1 << /Subtype /Type1 /BaseFont /X /Encoding << /Differences [1 /fi /eacute /uni20AC /alpha /Scaron /a.alt /u1F600 /nothing] >> >>"
    assert texts(one_page(b"BT /F1 9 Tf (\\001\\002\\003\\004\\005\\006\\007\\010 '\\252) Tj ET", named)) == ["ﬁé€αŠa😀 ’“"]
    assert texts(one_page(b"BT /F1 9 Tf (\\200\\351) Tj ET")) == ["€é"]
    wide = "/F1 << /Subtype /Type0 /Encoding /UniGB-UCS2-H /DescendantFonts [<< /DW 1000 >>] >>"
    assert texts(one_page(b"BT /F1 9 Tf <4E2D00410042> Tj ET", wide)) == ["中AB"]


def test_filters():
    held = opened(one_page(b""))
    plain = b"-----A---B" * 30
    assert pdf._unpacked(bytes.fromhex("800b6050220c0c8501"), 1) == b"-----A---B"
    assert pdf._runs_back(b"\x02abc\xfed\x80zz") == b"abcddd" and pdf._base85(b"<~87cUR~>") == b"Hell"
    assert pdf._inflated(zlib.compress(plain)[:-3]) == plain
    rows = b"".join(bytes([k]) + bytes([k] * 4) for k in range(5))
    assert pdf._rows_back(rows, {"Predictor": 15, "Columns": 4}) == bytes([0, 0, 0, 0, 1, 2, 3, 4, 3, 4, 5, 6, 4, 7, 9, 10, 8, 12, 16, 20])  # by hand
    assert held.data(pdf.Stream({"Filter": pdf.Name("DCTDecode")}, 0, 5)) == b""


def test_pages_without_text_and_hostile_files():
    assert texts(one_page(b"q 9 0 0 9 0 0 cm /Im Do Q", rest="/XObject << /Im 5 0 R >>", more=(b"<< /Subtype /Image /Filter /DCTDecode /Length 2 >>\nstream\n(a\nendstream",))) == [""]
    encrypted = one_page(b"BT /F1 9 Tf (a) Tj ET").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << >>")
    assert texts(encrypted) == [""]
    loop = one_page(b"/X Do", rest="/XObject << /X 5 0 R >>", more=(b"<< /Subtype /Form /Length 30 >>\nstream\nBT /F1 9 Tf (a) Tj ET /X Do    \nendstream",))
    assert texts(loop) == ["a"]
    assert texts(one_page(b"[" * 100_000 + b"(" * 100_000)) == [""] and texts(one_page(b"%" * 1_000_000)) == [""]
    with pytest.raises(ValueError, match="no PDF"):
        opened(b"")


def test_files(spark, tmp_path):
    """Ranges of three pages, by the job that also reads extracted text."""
    for form in range(3):
        (tmp_path / f"a {form}.PDF").write_bytes(pdf_bytes(PAGES, form))
    (tmp_path / "none.pdf").write_bytes(one_page(b""))
    (tmp_path / "t.txt").write_text("p\fq")
    ranges = pdf.page_ranges(spark.read.format("binaryFile").load(f"{tmp_path}/a*").select("path"), 3)
    assert ranges.count() == 33
    found = {(r["path"].rsplit("/", 1)[1], r["page"]): r["text"] for r in pdf.page_texts(ranges).collect()}
    assert found == {(f"a {f}.PDF", i): "\n".join(p) for f in range(3) for i, p in enumerate(PAGES, 1)}
    assert main(["pages", str(tmp_path), f"file://{tmp_path}/md"], spark) == 0
    told = {r["doc"].rsplit("doc=", 1)[1].split("/")[0]: r["text"] for r in readers.read_texts(spark, f"{tmp_path}/md/*").collect()}
    assert told["none"].strip() == "# none\n\n_No extractable text on this page._" and told["t"].strip() == "# t\n\np\n\nq"
    assert told["a%201"].startswith("# a 1\n\nfirst (line) \\ of é\n  and 𝔘nicode\tend\nx\n\nonly ☃ one\n\npage\n")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/bad.pdf").write_bytes(b"text")
    with pytest.raises(Exception, match="bad.pdf"):
        pdf.read_pages(spark, f"{tmp_path}/bad").collect()


def test_a_long_file_has_few_ranges(spark, tmp_path):
    """Each range reads the places of all objects of its file, so that a file's ranges must not grow with its pages; pages leave together."""
    made = [[f"page {i}"] for i in range(1000)]
    (tmp_path / "long.pdf").write_bytes(pdf_bytes(made, 1))
    ranges = pdf.page_ranges(spark.createDataFrame([(f"file://{tmp_path}/long.pdf",)], "path string"), 10)
    held = sorted((r["first"], len(r["objects"])) for r in ranges.collect())
    assert len(held) == pdf.RANGES and [f for f, _ in held] == [1 + 63 * k for k in range(16)] and sum(n for _, n in held) == 1000
    assert sorted((r["page"], r["text"]) for r in pdf.page_texts(ranges).collect()) == [(i + 1, f"page {i}") for i in range(1000)]


def test_a_code_is_told_once(monkeypatch):
    """What a code stands for is looked up when a file first shows it, not for each character of its pages."""
    told, codes = [], pdf.Font.codes

    def counted(self, shown):
        for x in codes(self, shown):
            told.append(x)
            yield x

    monkeypatch.setattr(pdf.Font, "codes", counted)
    for form in range(3):
        told.clear()
        assert texts(pdf_bytes([["a line of words " * 4] * 50] * 5, form)) == ["\n".join(["a line of words " * 4] * 50)] * 5
        assert len(told) == len(set("a line of words "))


def test_strings_told_at_once():
    """Text and width of a string are those of its codes, for codes of one and two bytes, known and unknown, odd ends and spaces."""
    wide = "/F1 << /Subtype /Type0 /Encoding /UniGB-UCS2-H /DescendantFonts [<< /DW 900 /W [65 [300 400]] >>] >>"
    for fonts, kinds in ((wide, 2), ("/F1 << /Subtype /Type1 /FirstChar 65 /Widths [300 400.5] /Encoding /WinAnsiEncoding >>", 1)):
        held = opened(one_page(b"", fonts))
        font = pdf.Font(held, held.get(pdf.Ref(3, 0))["Resources"]["Font"]["F1"])
        for shown in (b"", b"\0A\0B", b"A B  C\xe9", b"\0A\0B ", bytes(range(256))):
            codes = list(font.codes(shown))
            assert font.lengths == [kinds] and font.told(shown) == ("".join(t for _, t in codes), sum(font.widths.get(c, font.usual) for c, _ in codes), len(codes), sum(c == b" " for c, _ in codes))


def test_tokens():
    found = list(pdf.Items(b"1 -2.5 +3 .5 4. T* 5 0 R [6 0 R 7 8] <</A 9 0 R/B true/C#20D null>> <414 2> 1a 2.3.4 0\0001 (x)'\"q%c\n9"))
    assert found == [1, -2.5, 3, 0.5, 4.0, "T*", 5, 0, "R", [pdf.Ref(6, 0), 7, 8], {"A": pdf.Ref(9, 0), "B": True, "C D": None}, b"AB", "1a", "2.3.4", 0, 1, b"x", "'\"q", 9]
    assert list(pdf.Items(b"(a\\(b\\)\\n\\\\\\101\\7x\\\r\ny\\8\\q) (a(b\\))c) (\\\n) (open \\) (x)")) == [b"a(b)\n\\A\x07xy8q", b"a(b))c", b"", b"open ) (x)"]
