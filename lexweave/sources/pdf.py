"""Text of PDF files, page by page.

A file is never read whole and never one task's work: a first pass reads what leads to its pages and tells ranges of them, a second
one reads only the objects that the pages of a range need. Both read parts of files from the store.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import hypot
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import store

#: Objects of one file that a task keeps.
HELD = 2000
#: Fonts of one file that a task keeps.
FONTS = 200
#: Ranges of pages of one file.
RANGES = 16
#: Characters of pages that leave a task at once.
TOLD = 1 << 19
#: Bytes read at once where the length of an object is not known.
WINDOW = 4096


class Name(str):
    pass


class Word(str):
    pass


class Ref(NamedTuple):
    number: int
    generation: int


class Stream(NamedTuple):
    info: dict
    start: int
    size: int


_NUMBER = rb"[+-]?(?:\d+\.?\d*|\.\d+)(?![^\x00\t\n\f\r ()<>\[\]{}/%])"
_TOKEN = re.compile(
    rb"[\x00\t\n\f\r ]*+(?:%[^\r\n]*+[\x00\t\n\f\r ]*+)*+(?:(?P<word>[A-Za-z'\"][A-Za-z*]*+(?![^\x00\t\n\f\r ()<>\[\]{}/%]))"
    rb"|(?P<numbers>" + _NUMBER + rb"(?:[\x00\t\n\f\r ]++" + _NUMBER + rb")*+)|(?P<hex><[^<>]*>)|(?P<name>/[^\x00\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[)|(?P<close>>>|\])|(?P<string>\()|(?P<odd>[^\x00\t\n\f\r ()<>\[\]{}/%]+)|(?P<other>.))",
    re.S,
)
_PLAIN = re.compile(rb"[^()\\]*+")
_ESCAPE = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S)
#: Fixed values of the format.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_FLAT = re.compile(rb"((?:[^()\\]++|\\.)*+)\)", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_VALUES = {b"true": True, b"false": False, b"null": None}


def _meant(escape: bytes) -> bytes:
    """What stands behind a backslash, as bytes of the string."""
    return bytes([int(escape, 8) & 255]) if escape[:1].isdigit() and escape < b"8" else _ESCAPES.get(escape, escape)


def _unescaped(m: re.Match) -> bytes:
    return _meant(m[1])


@lru_cache(maxsize=4096)
def _word(raw: bytes) -> Any:
    return _VALUES[raw] if raw in _VALUES else Word(raw.decode("latin-1"))


@lru_cache(maxsize=4096)
def _name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))


_WORD, _NUMBERS, _HEX, _NAME, _OPEN, _CLOSE, _STRING, _ODD = (_TOKEN.groupindex[k] for k in ("word", "numbers", "hex", "name", "open", "close", "string", "odd"))


class Items:
    """The objects and words of some bytes, arrays and dictionaries whole; `at` is the place behind the last one."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _string(self) -> bytes:
        if m := _FLAT.match(self.data, self.at):
            self.at = m.end()
            return _ESCAPED.sub(_unescaped, m[1]) if b"\\" in m[1] else m[1]
        out, depth = bytearray(), 1
        while self.at < len(self.data):
            m = _PLAIN.match(self.data, self.at)
            out += m[0]
            self.at = m.end() + 1
            c = self.data[m.end() : self.at]
            if c == b"\\" and (m := _ESCAPE.match(self.data, self.at)):
                self.at = m.end()
                out += _meant(m[0])
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def __iter__(self) -> Iterator[Any]:
        open_: list[tuple[bytes, list]] = []
        match, data = _TOKEN.match, self.data
        while m := match(data, self.at):
            kind = m.lastindex
            raw, self.at = m[kind], m.end()
            if kind == _WORD or kind == _ODD:
                v: Any = _word(raw)
                if raw == b"R" and open_ and len(open_[-1][1]) > 1 and all(isinstance(x, int) for x in open_[-1][1][-2:]):
                    v = Ref(*open_[-1][1][-2:])
                    del open_[-1][1][-2:]
            elif kind == _NUMBERS:  # all that stand in a row
                some = (raw.replace(b"\0", b" ") if b"\0" in raw else raw).split()
                got = [float(x) if b"." in x else int(x) for x in some] if b"." in raw else list(map(int, some))
                if open_:
                    open_[-1][1].extend(got)
                else:
                    yield from got
                continue
            elif kind == _HEX:
                try:
                    v = bytes.fromhex(raw[1:-1].decode("latin-1"))
                except ValueError:
                    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
                    v = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif kind == _NAME:
                v = _name(raw[1:])
            elif kind == _STRING:
                v = self._string()
            elif kind == _OPEN:
                open_.append((raw, []))
                continue
            elif kind == _CLOSE and open_:
                mark, got = open_.pop()
                v = got if mark == b"[" else {k: x for k, x in zip(got[::2], got[1::2]) if isinstance(k, Name)}
            else:
                continue
            if open_:
                open_[-1][1].append(v)
            else:
                yield v


def _rows_back(data: bytes, parms: dict) -> bytes:
    """Undoes a predictor."""
    kind, colors, bits, columns = (parms.get(k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if kind < 2:
        return data
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, width // step, step)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    rows = np.frombuffer(data[: len(data) // (width + 1) * (width + 1)], np.uint8).reshape(-1, width + 1)
    if len(rows) * (width + 1) == len(data) and (rows[:, 0] == 2).all():  # the usual one of tables: sums down the columns
        return np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8).tobytes()
    out, last = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width].ljust(width, b"\0"))
        if how == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(last, np.uint8)).tobytes())
        elif how:
            for i in range(width):
                a, b, c = (row[i - step], last[i], last[i - step]) if i >= step else (0, last[i], 0)
                if how == 4:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                else:
                    guess = a if how == 1 else (a + b) // 2
                row[i] = (row[i] + guess) & 255
        out += row
        last = bytes(row)
    return bytes(out)


def _inflated(data: bytes) -> bytes:
    """What can be inflated of a stream, be its end damaged."""
    out, held = bytearray(), zlib.decompressobj()
    for at in range(0, len(data), 1 << 16):
        try:
            out += held.decompress(data[at : at + (1 << 16)])
        except zlib.error:
            break
    return bytes(out)


def _unpacked(data: bytes, early: int) -> bytes:
    """LZW with codes of 9 to 12 bits."""
    out, table, last, bits, held = bytearray(), [], b"", 0, 0
    size = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, size = [], b"", 9
            continue
        if not last:
            entry = bytes([code & 255])
        else:
            entry = bytes([code]) if code < 256 else table[code - 258] if code - 258 < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        size = min(12, max(9, (len(table) + 258 + early).bit_length()))
    return bytes(out)


def _runs_back(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def _base85(data: bytes) -> bytes:
    digits = re.sub(rb"[^!-uz]", b"", data.split(b"~>")[0].removeprefix(b"<~")).replace(b"z", b"!!!!!")
    short = -len(digits) % 5
    groups = np.frombuffer(digits + b"u" * short, np.uint8).reshape(-1, 5).astype(np.int64) - 33
    out = (groups @ np.array([85**4, 85**3, 85**2, 85, 1]) & 0xFFFFFFFF).astype(">u4").tobytes()
    return out[: len(out) - short]


class Pdf:
    """The objects of one file, read when asked for. read(at, n) gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.places: dict[int, int | tuple[int, int] | None] = {}
        self.trailer: dict = {}
        self._held: dict[int, Any] = {}
        self._packs: dict[int, dict[int, Any]] = {}
        self.fonts: dict[int, tuple[Any, Any]] = {}
        try:
            self._tables()
            whole = isinstance(self.get(self.trailer.get("Root")), dict)
        except (ValueError, IndexError, TypeError, KeyError):
            whole = False
        if not whole:
            self._scan()

    def _parsed(self, at: int) -> tuple[Any, Any]:
        """The number and the value of the object at a place."""
        n = WINDOW
        while True:
            data = self.read(at, n)
            items = Items(data)
            got = []
            for v in items:
                got.append(v)
                if isinstance(v, Word) and v != "obj" and v != "R":
                    break
            if len(got) > 3 and got[2] == "obj" and isinstance(got[-1], Word) and items.at < len(data) or at + n >= self.size:
                break
            if len(got) > 2 and got[2] != "obj":
                break
            n *= 4
        if len(got) < 4 or got[2] != "obj" or not isinstance(got[0], int):
            raise ValueError("there is no object where the file names one")
        if len(got) > 5 and got[5] == "R":
            return got[0], Ref(got[3], got[4])
        if got[-1] != "stream" or not isinstance(got[3], dict):
            return got[0], got[3]
        start = items.at + (2 if data[items.at : items.at + 2] == b"\r\n" else 1)
        size = self.get(got[3].get("Length"))
        if not isinstance(size, int) or b"endstream" not in self.read(at + start + size, 32):
            size = self._find(b"endstream", at + start) - at - start
        return got[0], Stream(got[3], at + start, size)

    def _find(self, what: bytes, at: int) -> int:
        while at < self.size:
            data = self.read(at, 1 << 20)
            if (found := data.find(what)) >= 0:
                return at + found
            at += max(1, len(data) - len(what))
        return self.size

    def _tables(self) -> None:
        """Places of objects from tables and streams, the newest first."""
        told = re.findall(rb"startxref\s+(\d+)", self.read(max(0, self.size - 2048), 2048))
        todo, seen = [int(told[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            trailer = self._table(at) if self.read(at, 32).lstrip().startswith(b"xref") else self._table_stream(at)
            self.trailer = trailer | self.trailer
            todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        end = self._find(b"trailer", at)
        words = self.read(at, end - at).split()[1:]
        i = 0
        while i + 1 < len(words):
            first, n = int(words[i]), int(words[i + 1])
            for k in range(n):
                place, _, state = words[i + 2 + 3 * k : i + 5 + 3 * k]
                self.places.setdefault(first + k, int(place) if state == b"n" else None)
            i += 2 + 3 * n
        n = WINDOW
        while True:
            items = Items(self.read(end + 7, n))
            found = next(iter(items), None)
            if isinstance(found, dict) or end + 7 + n >= self.size:
                return found
            n *= 4

    def _table_stream(self, at: int) -> dict:
        _, stream = self._parsed(at)
        data, widths = self.data(stream), stream.info["W"]
        index = stream.info.get("Index", [0, stream.info["Size"]])
        a, b = widths[0], widths[0] + widths[1]
        row, step = 0, sum(widths)
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                cells = data[row : row + step]
                row += step
                kind = int.from_bytes(cells[:a], "big") if a else 1
                place, rest = int.from_bytes(cells[a:b], "big"), int.from_bytes(cells[b:], "big")
                if len(cells) == step:
                    self.places.setdefault(number, place if kind == 1 else (place, rest) if kind == 2 else None)
        return stream.info

    def _scan(self) -> None:
        """Places of objects from the whole file, read in blocks, where its tables are damaged; the last of a number counts."""
        self._held, self._packs = {}, {}
        self.places, at, trailers = {}, 0, []
        while at < self.size:
            data = self.read(at, 1 << 20)
            for m in re.finditer(rb"(?<!\d)(\d{1,10})\s{1,4}\d{1,5}\s{1,4}obj(?![a-z])|trailer", data):
                if m[1]:
                    self.places[int(m[1])] = at + m.start()
                else:
                    trailers.append(at + m.end())
            at += len(data) if at + len(data) >= self.size else len(data) - 64
        if not self.places:
            raise ValueError("this is no PDF file")
        found = [next(iter(Items(self.read(t, 1 << 16))), None) for t in trailers]
        for number in sorted(self.places):
            try:
                v = self.get(Ref(number, 0))
            except ValueError:
                continue
            info = v.info if isinstance(v, Stream) else v
            if isinstance(info, dict) and info.get("Type") == "XRef":
                found.append(info)
            elif isinstance(info, dict) and info.get("Type") == "Catalog":
                found.insert(0, {"Root": Ref(number, 0)})
            elif isinstance(info, dict) and info.get("Type") == "ObjStm":
                for inner in self._pack(number):
                    self.places.setdefault(inner, (number, 0))
                    if isinstance(self._pack(number)[inner], dict) and self._pack(number)[inner].get("Type") == "Catalog":
                        found.insert(0, {"Root": Ref(inner, 0)})
        for t in found:
            self.trailer = self.trailer | t if isinstance(t, dict) else self.trailer

    def _pack(self, number: int) -> dict[int, Any]:
        """The objects of an object stream."""
        if number not in self._packs:
            stream = self.get(Ref(number, 0))
            data, first = self.data(stream), self.get(stream.info["First"])
            heads = [int(x) for x in data[:first].split()[: 2 * self.get(stream.info["N"])]]
            if len(self._packs) >= 16:
                self._packs.pop(next(iter(self._packs)))
            made = {}
            for n, place in zip(heads[::2], heads[1::2]):
                items = iter(Items(data, first + place))
                v = next(items, None)
                if isinstance(v, int) and not isinstance(v, bool) and re.match(rb"\s*\d+\s+\d+\s+R\b", data[first + place : first + place + 40]):
                    v = Ref(v, next(items))
                made[n] = v
            self._packs[number] = made
        return self._packs[number]

    def get(self, v: Any) -> Any:
        """The value that a reference leads to, null if to nothing."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            if v.number in self._held:
                v = self._held[v.number]
                continue
            place = self.places.get(v.number)
            if isinstance(place, tuple):
                made = self._pack(place[0]).get(v.number)
            elif place is None:
                made = None
            else:
                number, made = self._parsed(place)
                if number != v.number:
                    raise ValueError("another object stands where the file names one")
            if len(self._held) >= HELD:
                self._held.pop(next(iter(self._held)))
            self._held[v.number] = made
            v = made
        return None

    def data(self, stream: Stream) -> bytes:
        """The decoded bytes of a stream; those of an image format are none."""
        filters = self.get(stream.info.get("Filter"))
        parms = self.get(stream.info.get("DecodeParms"))
        filters = [] if filters is None else [self.get(f) for f in filters] if isinstance(filters, list) else [filters]
        parms = [self.get(p) for p in parms] if isinstance(parms, list) else [parms]
        known = {"FlateDecode", "Fl", "LZWDecode", "LZW", "ASCIIHexDecode", "AHx", "ASCII85Decode", "A85", "RunLengthDecode", "RL"}
        if not known.issuperset(filters):
            return b""
        data = self.read(stream.start, stream.size)
        for i, name in enumerate(filters):
            given = {k: self.get(x) for k, x in parms[i].items()} if i < len(parms) and isinstance(parms[i], dict) else {}
            if name in ("FlateDecode", "Fl"):
                data = _rows_back(_inflated(data), given)
            elif name in ("LZWDecode", "LZW"):
                data = _rows_back(_unpacked(data, given.get("EarlyChange", 1)), given)
            elif name in ("ASCIIHexDecode", "AHx"):
                data = next(iter(Items(b"<" + data.split(b">")[0] + b">")), b"")
            elif name in ("ASCII85Decode", "A85"):
                data = _base85(data)
            else:
                data = _runs_back(data)
        return data

    @property
    def encrypted(self) -> bool:
        return self.trailer.get("Encrypt") is not None

    def page_numbers(self) -> list[int]:
        """The object numbers of the pages in order."""
        root = self.get(self.trailer.get("Root"))
        todo, seen, out = [root.get("Pages") if isinstance(root, dict) else None], set(), []
        while todo:
            ref = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref):
                continue
            kids = self.get(node.get("Kids"))
            if not isinstance(kids, list):
                out.append(ref.number)
            elif ref.number not in seen:
                seen.add(ref.number)
                todo += reversed(kids)
        return out

    def page_text(self, number: int) -> str:
        """The text of the page that an object is, empty where it shows none."""
        page = self.get(Ref(number, 0))
        if self.encrypted or not isinstance(page, dict):
            return ""
        node, resources = page, None
        for _ in range(64):  # resources come from the nearest node above that has some
            if not isinstance(node, dict) or (resources := self.get(node.get("Resources"))) is not None:
                break
            node = self.get(node.get("Parent"))
        contents = self.get(page.get("Contents"))
        parts = [self.get(c) for c in contents] if isinstance(contents, list) else [contents]
        return Shown(self).of(b"\n".join(self.data(p) for p in parts if isinstance(p, Stream)), resources or {})


#: What glyph names mean that no rule tells.
GLYPHS = dict(
    space=" ", exclam="!", quotedbl='"', numbersign="#", dollar="$", percent="%", ampersand="&", quotesingle="'", parenleft="(", parenright=")",
    asterisk="*", plus="+", comma=",", hyphen="-", minus="−", period=".", slash="/", zero="0", one="1", two="2", three="3", four="4", five="5",
    six="6", seven="7", eight="8", nine="9", colon=":", semicolon=";", less="<", equal="=", greater=">", question="?", at="@", bracketleft="[",
    backslash="\\", bracketright="]", asciicircum="^", underscore="_", grave="`", braceleft="{", bar="|", braceright="}", asciitilde="~",
    quoteleft="‘", quoteright="’", quotedblleft="“", quotedblright="”", quotesinglbase="‚", quotedblbase="„", guillemotleft="«",
    guillemotright="»", guilsinglleft="‹", guilsinglright="›", endash="–", emdash="—", bullet="•", ellipsis="…", dagger="†", daggerdbl="‡",
    degree="°", section="§", paragraph="¶", copyright="©", registered="®", trademark="™", cent="¢", sterling="£", yen="¥", Euro="€",
    currency="¤", florin="ƒ", fraction="⁄", perthousand="‰", plusminus="±", multiply="×", divide="÷", mu="µ", periodcentered="·",
    exclamdown="¡", questiondown="¿", logicalnot="¬", brokenbar="¦", ordfeminine="ª", ordmasculine="º", onehalf="½", onequarter="¼",
    threequarters="¾", onesuperior="¹", twosuperior="²", threesuperior="³", lessequal="≤", greaterequal="≥", notequal="≠", fi="ﬁ", fl="ﬂ",
    ff="ﬀ", ffi="ﬃ", ffl="ﬄ", AE="Æ", ae="æ", OE="Œ", oe="œ", germandbls="ß", Oslash="Ø", oslash="ø", Lslash="Ł", lslash="ł", Eth="Ð",
    eth="ð", Thorn="Þ", thorn="þ", dotlessi="ı", acute="´", dieresis="¨", macron="¯", cedilla="¸", circumflex="ˆ", tilde="˜", caron="ˇ",
)
#: Marks that names of letters end with.
MARKS = dict(acute=0x301, grave=0x300, circumflex=0x302, dieresis=0x308, tilde=0x303, caron=0x30C, cedilla=0x327, ring=0x30A, breve=0x306, macron=0x304, ogonek=0x328, dotaccent=0x307, hungarumlaut=0x30B, commaaccent=0x326)
#: The standard encoding where it is not ASCII, from A1 on; a space stands for no character.
STANDARD = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ –†‡· ¶•‚„”»…‰ ¿ `´ˆ˜¯˘˙¨ ˚¸ ˝˛ˇ—                Æ ª    ŁØŒº     æ   ı  łøœß"


def glyph(name: str) -> str:
    """The character of a glyph's name."""
    name = name.split(".")[0]
    if len(name) == 1 or name in GLYPHS:
        return GLYPHS.get(name, name)
    if m := re.fullmatch(r"(?:uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6}))", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "ignore") if m[1] else chr(int(m[2], 16)) if int(m[2], 16) < 0x110000 else ""
    if name[1:] in MARKS:
        return unicodedata.normalize("NFC", name[0] + chr(MARKS[name[1:]]))
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[:1].isupper() else 'SMALL'} LETTER {name.upper()}")
    except KeyError:
        return ""


def code_map(data: bytes) -> tuple[set[int], dict[bytes, str]]:
    """The lengths of the codes and the texts that a character map gives."""
    lengths, texts, got = set(), {}, []
    for v in Items(data):
        if not isinstance(v, Word):
            got.append(v)
            continue
        if v == "endcodespacerange":
            lengths |= {len(x) for x in got if isinstance(x, bytes)}
        elif v == "endbfchar":
            texts |= {a: b.decode("utf-16-be", "ignore") for a, b in zip(got[::2], got[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif v == "endbfrange":
            for lo, hi, to in zip(got[::3], got[1::3], got[2::3]):
                if not isinstance(lo, bytes) or not isinstance(hi, bytes):
                    continue
                at = int.from_bytes(lo, "big")
                for k in range(min(int.from_bytes(hi, "big") - at + 1, 1 << 16)):
                    if isinstance(to, list):
                        made = to[k] if k < len(to) else b""
                    else:
                        made = to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")
                    texts[(at + k).to_bytes(len(lo), "big")] = made.decode("utf-16-be", "ignore")
        got = []
    return lengths, texts


class _Told(dict):
    """What a code, as a number, stands for: told by a function when it is first met."""

    def __init__(self, tell: Callable[[int], Any]):
        super().__init__()
        self.tell = tell

    def __missing__(self, code: int) -> Any:
        made = self[code] = self.tell(code)
        return made


class Font:
    """Codes of shown strings as texts and widths (thousandths of the size)."""

    def __init__(self, pdf: Pdf, info: dict):
        get = pdf.get
        told = get(info.get("ToUnicode"))
        lengths, self.texts = code_map(pdf.data(told)) if isinstance(told, Stream) else (set(), {})
        self.quick: tuple[_Told, _Told] | None = None
        encoding = get(info.get("Encoding"))
        self.widths: dict[bytes, float] = {}
        self.utf16 = False
        if get(info.get("Subtype")) == "Type0":
            if isinstance(encoding, Stream):
                lengths = code_map(pdf.data(encoding))[0] or lengths
            elif isinstance(encoding, str) and not encoding.startswith("Identity"):
                self.utf16 = "UCS2" in encoding or "UTF16" in encoding
            else:
                lengths = {2}
            self.lengths = sorted(lengths - {0}) or [2]
            inner = get((get(info.get("DescendantFonts")) or [None])[0]) or {}
            self.usual = get(inner.get("DW")) or 1000
            self._wide(pdf, [get(x) for x in get(inner.get("W")) or []])
            return
        self.lengths = [1]
        base, changes = (get(encoding.get("BaseEncoding")), get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else (encoding, [])
        if base is None and get(info.get("Subtype")) == "TrueType":
            base = "WinAnsiEncoding"
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(base)
        plain = {}
        for c in range(32, 256):
            if codec:
                plain[c] = bytes([c]).decode(codec, "ignore")
            else:
                plain[c] = {39: "’", 96: "‘"}.get(c, chr(c) if c < 127 else STANDARD[c - 0xA1 : c - 0xA0].strip() if c > 0xA0 else "")
        at = 0
        for x in changes:
            x = get(x)
            if isinstance(x, int):
                at = x
            elif isinstance(x, Name):
                plain[at] = glyph(x)
                at += 1
        self.texts = {bytes([c]): v for c, v in plain.items() if 0 <= c < 256} | self.texts
        first = get(info.get("FirstChar")) or 0
        for i, w in enumerate(get(info.get("Widths")) or []):
            if isinstance(w := get(w), (int, float)) and 0 <= first + i < 256:
                self.widths[bytes([first + i])] = w
        self.usual = (get((get(info.get("FontDescriptor")) or {}).get("MissingWidth")) or 0) if self.widths else 600 if "Courier" in str(get(info.get("BaseFont"))) else 500

    def _wide(self, pdf: Pdf, told: list) -> None:
        i = 0
        n = self.lengths[-1]
        while i + 1 < len(told):
            if isinstance(told[i + 1], list):
                some = {told[i] + k: pdf.get(w) for k, w in enumerate(told[i + 1])}
                i += 2
            else:
                some = dict.fromkeys(range(told[i], min(told[i + 1], 0xFFFF) + 1), told[i + 2]) if i + 2 < len(told) else {}
                i += 3
            self.widths |= {c.to_bytes(n, "big"): w for c, w in some.items() if 0 <= c < 256**n}

    def told(self, shown: bytes) -> tuple[str, float, int, int]:
        """The text of a shown string, its width, its number of codes, and how many of them are the byte of a space."""
        n = self.lengths[0]
        if len(self.lengths) > 1 or n > 2 or len(shown) % n:
            codes = list(self.codes(shown))
            return "".join(t for _, t in codes), sum(self.widths.get(c, self.usual) for c, _ in codes), len(codes), sum(c == b" " for c, _ in codes)
        if self.quick is None:
            self.quick = (
                _Told(lambda c: next(self.codes(c.to_bytes(n, "big")))[1]),
                _Told(lambda c: self.widths.get(c.to_bytes(n, "big"), self.usual)),
            )
        numbers = shown if n == 1 else struct.unpack(f">{len(shown) // 2}H", shown)
        texts, widths = self.quick
        wide = sum(map(widths.__getitem__, numbers)) if self.widths else self.usual * len(numbers)
        return "".join(map(texts.__getitem__, numbers)), wide, len(numbers), shown.count(b" ") if n == 1 else 0

    def codes(self, shown: bytes) -> Iterator[tuple[bytes, str]]:
        at = 0
        while at < len(shown):
            n = next((n for n in self.lengths if shown[at : at + n] in self.texts), self.lengths[-1])
            code = shown[at : at + n]
            yield code, self.texts.get(code, code.decode("utf-16-be", "ignore") if self.utf16 else "")
            at += n


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _moved(x: float, y: float, b: tuple) -> tuple:
    """b behind a step."""
    return (b[0], b[1], b[2], b[3], x * b[0] + y * b[2] + b[4], x * b[1] + y * b[3] + b[5])


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: What text state begins with: matrix of the page, font, size, spaces between characters and words, scale, leading.
_START = {"page": _UNIT, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0}
#: Operators that take numbers.
_NUMBERED = {"cm", "Tf", "Tc", "Tw", "TL", "Tz", "Tm", "Td", "TD", '"'}
_INLINE_END = re.compile(rb"[\x00\t\n\f\r ]EI(?=[\x00\t\n\f\r ]|\Z)")
#: Shares of the size: a step across the line that begins a new one, a gap along it that is a space.
LINE, GAP = 0.5, 0.2


class Shown:
    """Text in the order in which it is shown; lines and spaces come from where it stands."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.out, self.own = pdf, [], {}
        self.end: tuple[float, float, float] | None = None

    def _font(self, resources: dict, name: str) -> Font | None:
        ref = (self.pdf.get(resources.get("Font")) or {}).get(name)
        known = self.pdf.fonts if isinstance(ref, Ref) else self.own  # fonts of a file are shared by its pages
        key = ref.number if isinstance(ref, Ref) else id(ref)
        if key not in known:
            held = self.pdf.get(ref)
            if len(known) >= FONTS:
                known.pop(next(iter(known)))
            known[key] = (Font(self.pdf, held) if isinstance(held, dict) else None, ref)
        return known[key][0]

    def _show(self, shown: Any, s: dict) -> None:
        font, size = s["font"], s["size"]
        if font is None or not isinstance(shown, bytes):
            return
        told, wide, count, blanks = font.told(shown)
        move = (wide / 1000 * size + count * s["Tc"] + blanks * s["Tw"]) * s["Tz"]
        page = s["page"]
        at = s["text"] if page is _UNIT else _times(s["text"], page)
        s["text"] = _moved(move, 0, s["text"])
        if not told:
            return
        tall, wide = abs(size) * hypot(at[2], at[3]), hypot(at[0], at[1]) or 1.0
        if self.end is not None:
            dx, dy = at[4] - self.end[0], at[5] - self.end[1]
            along, across = (dx * at[0] + dy * at[1]) / wide, abs(dy * at[0] - dx * at[1]) / wide
            scale = max(tall, self.end[2])
            if across > LINE * scale or along < -2 * scale:
                self.out.append("\n")
            elif along > GAP * scale and not self.out[-1][-1].isspace() and not told[0].isspace():
                self.out.append(" ")
        self.out.append(told)
        behind = s["text"] if page is _UNIT else _times(s["text"], page)
        self.end = (behind[4], behind[5], tall)

    def of(self, content: bytes, resources: dict) -> str:
        s = dict(_START, text=_UNIT, line=_UNIT)
        frames = [(Items(content), resources, [], s, None)]
        streams = [iter(frames[0][0])]
        args: list = []
        while frames:
            items, resources, saved, _, _ = frames[-1]
            v = next(streams[-1], frames)
            if v is frames:  # this content is over
                s = frames.pop()[3]
                streams.pop()
                continue
            if type(v) is not Word:
                args.append(v)
                continue
            given, args = args, []
            numbers = [x for x in given if isinstance(x, (int, float))] if v in _NUMBERED else ()
            if v == "q":
                saved.append(dict(s))
            elif v == "Q" and saved:
                s = saved.pop()
            elif v == "cm" and len(numbers) == 6:
                s["page"] = _times(tuple(numbers), s["page"])
            elif v == "BT":
                s["text"] = s["line"] = _UNIT
            elif v == "Tf" and len(given) > 1:
                s["font"], s["size"] = self._font(resources, given[0]), numbers[-1] if numbers else 0.0
            elif v in ("Tc", "Tw", "TL") and numbers:
                s[v] = numbers[0]
            elif v == "Tz" and numbers:
                s["Tz"] = numbers[0] / 100
            elif v == "Tm" and len(numbers) == 6:
                s["text"] = s["line"] = tuple(numbers)
            elif v in ("Td", "TD") and len(numbers) == 2:
                s["TL"] = -numbers[1] if v == "TD" else s["TL"]
                s["text"] = s["line"] = _moved(*numbers, s["line"])
            elif v in ("T*", "'", '"'):
                if v == '"' and len(numbers) == 2:
                    s["Tw"], s["Tc"] = numbers
                s["text"] = s["line"] = _moved(0, -s["TL"], s["line"])
                if v != "T*" and given:
                    self._show(given[-1], s)
            elif v == "Tj" and given:
                self._show(given[0], s)
            elif v == "TJ" and given and isinstance(given[0], list):
                for x in given[0]:
                    if isinstance(x, (int, float)):
                        s["text"] = _moved(-x / 1000 * s["size"] * s["Tz"], 0, s["text"])
                    else:
                        self._show(x, s)
            elif v == "ID":
                end = _INLINE_END.search(items.data, items.at)
                items.at = end.end() if end else len(items.data)
            elif v == "Do" and given:
                ref = (self.pdf.get(resources.get("XObject")) or {}).get(given[0])
                form = self.pdf.get(ref)
                if isinstance(form, Stream) and self.pdf.get(form.info.get("Subtype")) == "Form" and all(f[4] is None or f[4] != form.start for f in frames):
                    inner = Items(self.pdf.data(form))
                    matrix = self.pdf.get(form.info.get("Matrix")) or _UNIT
                    frames.append((inner, self.pdf.get(form.info.get("Resources")) or resources, [], s, form.start))
                    streams.append(iter(inner))
                    s = dict(s, page=_times(tuple(matrix), s["page"]))
        return "".join(self.out)


def _pdf(file) -> Pdf:
    return Pdf(lambda at, n: file.read_at(max(0, min(n, file.size() - at)), at) if at < file.size() else b"", file.size())


def page_ranges(files: DataFrame, pages: int = 64) -> DataFrame:
    """path, first, objects: the objects that are the pages of each file (path), the first numbered `first`. A range has `pages` of them,
    or more in a file of which there would be over RANGES ranges, as each reads the places of all objects of its file. An encrypted file
    of which no page can be told has one, which is no object. What is no PDF file is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with store.opened(path) as file:
                    try:
                        pdf = _pdf(file)
                        numbers = pdf.page_numbers() or ([-1] if pdf.encrypted else [])
                    except (ValueError, KeyError, TypeError) as e:
                        raise ValueError(f"{path}: {e}") from e
                size = max(pages, -(-len(numbers) // RANGES))
                begins = range(0, len(numbers), size)
                yield pd.DataFrame({"path": [path] * len(begins), "first": [at + 1 for at in begins], "objects": [numbers[at : at + size] for at in begins]})

    return files.select("path").mapInPandas(run, "path string, first int, objects array<int>")


def page_texts(ranges: DataFrame) -> DataFrame:
    """path, page, text of ranges of pages, each read by itself. A page that shows no text, or is encrypted, has an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, numbers in zip(batch["path"], batch["first"], batch["objects"], strict=True):
                with store.opened(path) as file:
                    pdf = _pdf(file)
                    held, size = [], 0
                    for i, number in enumerate(numbers, first):
                        held.append((path, i, pdf.page_text(int(number))))
                        size += len(held[-1][2])
                        if size > TOLD or len(held) == 1000:
                            yield pd.DataFrame(held, columns=["path", "page", "text"])
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held, columns=["path", "page", "text"])

    # a plan of its own size: told ranges are few bytes, which adaptive execution would put into one task
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "first").mapInPandas(run, "path string, page int, text string")


def read_pages(spark: SparkSession, path: str, pattern: str = "*.[pP][dD][fF]", pages: int = 64) -> DataFrame:
    """path, page, text of all PDF files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return page_texts(page_ranges(files, pages)).select(F.col("path"), "page", "text")
