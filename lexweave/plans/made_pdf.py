"""PDF files in the forms of three kinds of producers, as inputs for the source that reads them."""

from __future__ import annotations

import zlib

import numpy as np


def _stream(info: str, data: bytes) -> bytes:
    return f"<< {info} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


def _base85(data: bytes) -> bytes:
    short = -len(data) % 4
    words = np.frombuffer(data + bytes(short), ">u4").astype(np.int64)
    digits = (words[:, None] // np.array([85**4, 85**3, 85**2, 85, 1]) % 85 + 33).astype(np.uint8).tobytes()
    return digits[: len(digits) - short] + b"~>"


def _content(lines: list[bytes], form: int) -> bytes:
    if form == 0:
        return b"BT /F1 10 Tf 12 TL 50 780 Td\n" + b"".join(b"<" + x.hex().encode() + b"> Tj T*\n" for x in lines) + b"ET"
    if form == 1:
        return b"\n".join(b"BT /F1 1 Tf 10 0 0 10 50 %d Tm [<%s> -40 <%s>] TJ ET" % (780 - 12 * i, x[: len(x) // 4 * 2].hex().encode(), x[len(x) // 4 * 2 :].hex().encode()) for i, x in enumerate(lines))
    literal = [x.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\012") for x in lines]
    return b"q .5 0 0 .5 0 0 cm BT /F1 20 Tf 24 TL 100 1560 Td " + b"".join(b"(" + x + b") '\n" for x in literal) + b"ET Q"


def pdf_bytes(pages: list[list[str]], form: int) -> bytes:
    """A file whose pages show lines. Form 0: a table, plain contents, hexadecimal strings. Form 1: objects and places in streams, a
    predictor, a deep tree with resources above the pages, kerned strings. Form 2: literal strings in contents of two parts, the second
    of which is a form of its own, encoded twice; a later revision that puts the first page in place."""
    chars = sorted(set().union(*("".join(lines) for lines in pages)))
    code = {c: (i + 1).to_bytes(2, "big") for i, c in enumerate(chars)}
    own = {ord(c): i + 1 for i, c in enumerate(chars)}
    to = [(code[c].hex(), c.encode("utf-16-be").hex()) for c in chars]
    if form == 1:
        maps = [f"1 beginbfrange <{to[i][0]}> <{to[min(i + 99, len(to) - 1)][0]}> [{' '.join(f'<{b}>' for _, b in to[i : i + 100])}] endbfrange" for i in range(0, len(to), 100)]
    else:
        maps = [f"{len(to[i : i + 100])} beginbfchar {' '.join(f'<{a}> <{b}>' for a, b in to[i : i + 100])} endbfchar" for i in range(0, len(to), 100)]
    table = ("begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "\n".join(maps) + "\nendcmap").encode()
    bodies = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /DW 500 /W [1 [500 500] 3 9 500] >>",
        5: _stream("", table) if form == 0 else _stream("/Filter /FlateDecode", zlib.compress(table)),
    }
    font = "/Resources << /Font << /F1 3 0 R >> >>"
    kids, number, late = [], 6, {}
    for k, lines in enumerate(pages):
        shown = [x.translate(own).encode("utf-16-be", "surrogatepass") for x in lines]
        page = f"<< /Type /Page /Parent 2 0 R {'' if form == 1 else font}"
        kids.append(number)
        if form == 2:
            half = len(shown) // 2
            inner = _base85(zlib.compress(_content(shown[half:], 2), 1))
            bodies[number + 1] = _stream("/Filter /FlateDecode", zlib.compress(_content(shown[:half], 2), 1))
            bodies[number + 2] = _stream("", f"q 1 0 0 1 0 {-12 * half} cm /X1 Do Q".encode())
            bodies[number + 3] = _stream(f"/Type /XObject /Subtype /Form {font} /Filter [/ASCII85Decode /FlateDecode]", inner)
            told = f"{page[:-3]} /XObject << /X1 {number + 3} 0 R >> >> /Contents [{number + 1} 0 R {number + 2} 0 R] >>".encode()
            bodies[number] = told
            if k == 0:
                bodies[number], late[number] = f"{page} >>".encode(), told
            number += 4
        else:
            content = _content(shown, form)
            bodies[number + 1] = _stream("", content) if form == 0 else _stream("/Filter /FlateDecode", zlib.compress(content, 1))
            bodies[number] = f"{page} /Contents {number + 1} 0 R >>".encode()
            number += 2
    if form == 1:  # groups of ten pages
        groups = [kids[i : i + 10] for i in range(0, len(kids), 10)]
        for g in groups:
            bodies[number] = f"<< /Type /Pages /Parent 2 0 R /Count {len(g)} /Kids [{' '.join(f'{x} 0 R' for x in g)}] >>".encode()
            number += 1
        top = range(number - len(groups), number)
    else:
        top = kids
    bodies[2] = f"<< /Type /Pages /Count {len(kids)} {font if form == 1 else ''} /Kids [{' '.join(f'{x} 0 R' for x in top)}] >>".encode()
    return _packed(bodies, number) if form == 1 else _tabled(bodies, number, late)


def _tabled(bodies: dict[int, bytes], size: int, late: dict[int, bytes]) -> bytes:
    out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
    before = ""
    for some in (bodies, late):
        if not some:
            continue
        at = {}
        for n, body in sorted(some.items()):
            at[n] = len(out)
            out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + "".join(f"{n} 1\n{p:010d} 00000 n \n" for n, p in at.items()).encode()
        out += f"trailer\n<< /Size {size} /Root 1 0 R {before} >>\nstartxref\n{start}\n%%EOF\n".encode()
        before = f"/Prev {start}"
    return bytes(out)


def _packed(bodies: dict[int, bytes], size: int) -> bytes:
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    places = {0: (0, 0, 65535)}
    plain = [n for n, b in sorted(bodies.items()) if not b.endswith(b"endstream")]
    for i in range(0, len(plain), 50):
        some, starts, at = plain[i : i + 50], [], 0
        for n in some:
            starts.append(f"{n} {at}")
            at += len(bodies[n]) + 1
        head = (" ".join(starts) + "\n").encode()
        bodies[size] = _stream(f"/Type /ObjStm /N {len(some)} /First {len(head)} /Filter /FlateDecode", zlib.compress(head + b"\n".join(bodies[n] for n in some)))
        places |= {n: (2, size, k) for k, n in enumerate(some)}
        size += 1
    for n, body in sorted(bodies.items()):
        if n not in places:
            places[n] = (1, len(out), 0)
            out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    places[size] = (1, len(out), 0)
    rows, last = bytearray(), bytes(7)
    for n in range(size + 1):
        kind, a, b = places[n]
        row = bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
        rows += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, last))
        last = row
    start = len(out)
    out += f"{size} 0 obj\n".encode() + _stream(f"/Type /XRef /Size {size + 1} /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>", zlib.compress(bytes(rows))) + f"\nendobj\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)
