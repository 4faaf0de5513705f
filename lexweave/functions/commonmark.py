"""Markdown by the public CommonMark rules, without raw HTML, as helpers of the pandas UDFs in `markup`.

Blocks are kept on an explicit stack of open containers, inline marks on a stack of delimiters, and both are rendered in a loop, so that
neither depth nor length of a text ends a task and time grows with the text.
"""

from __future__ import annotations

import html.entities
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from urllib.parse import quote

_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
_PLAIN = re.compile(r"[^\\`*_\[\]!<&\n]+")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{1,31}));")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*)>")
_MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.DOTALL)
_POINTED = re.compile(r"<((?:[^<>\\\n]|\\.)*)>")
_TITLES = {q: re.compile(rf"{re.escape(a)}((?:[^{re.escape(a + b)}\\]|\\.)*){re.escape(b)}", re.DOTALL) for q, a, b in (('"', '"', '"'), ("'", "'", "'"), ("(", "(", ")"))}
_SPACE = re.compile(r"[ \t]*(?:\n[ \t]*)?")
_LINE_END = re.compile(r"[ \t]*(?:\n|\Z)")
# Addresses that make no link.
_REFUSED = re.compile(r"(?:vbscript|javascript|file|data):", re.IGNORECASE)
_ALLOWED = re.compile(r"data:image/(?:gif|png|jpeg|webp);", re.IGNORECASE)

_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_FENCE = re.compile(r"(`{3,})(?!.*`)|(~{3,})")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_MARKER = re.compile(r"([-*+])|([0-9]{1,9})([.)])")
_TABLE_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def escaped(text: str) -> str:
    return re.sub('[&<>"]', lambda m: _ESCAPES[m[0]], text)


def _entity(m: re.Match) -> str:
    if m[3]:
        return html.entities.html5.get(m[3] + ";", m[0])
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def unescaped(text: str) -> str:
    """Backslash escapes and entities read."""
    return re.sub(r"\\([!-/:-@\[-`{-~])|" + _ENTITY.pattern, lambda m: m[1] or _ENTITY.sub(_entity, m[0]), text) if "\\" in text or "&" in text else text


def address(to: str) -> str | None:
    """A link's address with what may not stand in one as %XX; None for one that makes no link."""
    if _REFUSED.match(to.strip()) and not _ALLOWED.match(to.strip()):
        return None
    whole = re.sub(r"%(?![0-9a-fA-F]{2})", "%25", to)
    return quote(whole, safe=";/?:@&=+$,-_.!~*'()#%", errors="replace")


def label_key(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold().upper()


def destination(text: str, at: int) -> tuple[str, int] | None:
    """A link's address at a place, and the place behind it."""
    if text.startswith("<", at):
        m = _POINTED.match(text, at)
        return (unescaped(m[1]), m.end()) if m else None
    end, depth = at, 0
    while end < len(text) and text[end] > " " and text[end] != "\x7f":
        c = text[end]
        if c == "\\" and end + 1 < len(text) and text[end + 1] in _PUNCTUATION:
            end += 1
        elif c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if depth == 0:
                break
            depth -= 1
        end += 1
    return (unescaped(text[at:end]), end) if depth == 0 and end > at else None


def title(text: str, at: int) -> tuple[str, int] | None:
    found = _TITLES[text[at]].match(text, at) if text[at : at + 1] in _TITLES else None
    return (unescaped(found[1]), found.end()) if found else None


@lru_cache(maxsize=4096)
def _nature(c: str) -> int:
    """1 for white space, 2 for punctuation and symbols, 0 for what makes words."""
    if not c or c.isspace():
        return 1
    return 2 if c in _PUNCTUATION or unicodedata.category(c)[0] in "PS" else 0


class Marks:
    """A run of * or _: what is left of it, and the tags that matches have put behind and before it."""

    __slots__ = ("char", "count", "size", "opens", "closes", "before", "after", "tags_in", "tags_out")

    def __init__(self, char: str, count: int, left: str, right: str):
        self.char, self.count, self.size = char, count, count
        a, b = _nature(left), _nature(right)
        to_right = b != 1 and (b != 2 or a != 0)
        to_left = a != 1 and (a != 2 or b != 0)
        self.opens = to_right and (char == "*" or not to_left or a == 2)
        self.closes = to_left and (char == "*" or not to_right or b == 2)
        self.before = self.after = None
        self.tags_in: list[str] = []
        self.tags_out: list[str] = []

    def told(self) -> str:
        return "".join(self.tags_out) + self.char * self.count + "".join(reversed(self.tags_in))


class Bracket:
    __slots__ = ("piece", "at", "image", "active", "marks")

    def __init__(self, piece: int, at: int, image: bool, marks: Marks | None):
        self.piece, self.at, self.image, self.active, self.marks = piece, at, image, True, marks


class Inline:
    """One block's text as HTML. Pieces are (HTML, plain text) or runs of marks, which are told at the end."""

    def __init__(self, text: str, targets: dict[str, tuple[str, str]]):
        self.text, self.targets = text, targets
        self.pieces: list[tuple[str, str] | Marks] = []
        self.last: Marks | None = None
        self.brackets: list[Bracket] = []
        self.ticks: dict[int, list[int]] | None = None

    def render(self) -> str:
        text, at = self.text, 0
        while at < len(text):
            m = _PLAIN.match(text, at)
            if m:
                self.plain(m[0])
                at = m.end()
                continue
            c = text[at]
            if c in "*_":
                end = at
                while end < len(text) and text[end] == c:
                    end += 1
                self.push(Marks(c, end - at, text[at - 1 : at] if at else "", text[end : end + 1]))
                at = end
            elif c == "\n":
                at = self.line_end(at)
            elif c == "\\":
                at = self.backslash(at)
            elif c == "`":
                at = self.code(at)
            elif c == "[" or text.startswith("![", at):
                size = 1 if c == "[" else 2
                self.brackets.append(Bracket(len(self.pieces), at + size, size == 2, self.last))
                self.plain(text[at : at + size])
                at += size
            elif c == "]":
                at = self.close(at)
            elif c == "<":
                at = self.pointed(at)
            elif c == "&" and (m := _ENTITY.match(text, at)):
                self.plain(_entity(m))
                at = m.end()
            else:
                self.plain(c)
                at += 1
        self.emphasis(None)
        return "".join(x.told() if isinstance(x, Marks) else x[0] for x in self.pieces)

    def plain(self, text: str) -> None:
        self.pieces.append((escaped(text), text))

    def push(self, marks: Marks) -> None:
        marks.before = self.last
        if self.last is not None:
            self.last.after = marks
        self.last = marks
        self.pieces.append(marks)

    def drop(self, marks: Marks) -> None:
        if marks.before is not None:
            marks.before.after = marks.after
        if marks.after is not None:
            marks.after.before = marks.before
        else:
            self.last = marks.before

    def line_end(self, at: int) -> int:
        hard = False
        if self.pieces and not isinstance(self.pieces[-1], Marks) and self.pieces[-1][1].endswith(" ") and self.text[at - 1] == " ":
            told = self.pieces[-1][1]
            hard = told.endswith("  ")
            self.pieces[-1] = (escaped(told.rstrip(" ")), told.rstrip(" "))
        self.pieces.append(("<br />\n" if hard else "\n", "\n"))
        at += 1
        while self.text.startswith(" ", at):
            at += 1
        return at

    def backslash(self, at: int) -> int:
        c = self.text[at + 1 : at + 2]
        if c == "\n":
            self.pieces.append(("<br />\n", "\n"))
            at += 2
            while self.text.startswith(" ", at):
                at += 1
            return at
        if c and c in _PUNCTUATION:
            self.plain(c)
            return at + 2
        self.plain("\\")
        return at + 1

    def code(self, at: int) -> int:
        if self.ticks is None:
            self.ticks = {}
            for m in re.finditer("`+", self.text):
                self.ticks.setdefault(len(m[0]), []).append(m.start())
        size = 1
        while self.text.startswith("`", at + size):
            size += 1
        places = self.ticks.get(size, [])
        k = bisect_right(places, at)
        if k == len(places):
            self.plain("`" * size)
            return at + size
        inside = self.text[at + size : places[k]].replace("\n", " ")
        if len(inside) > 2 and inside[0] == inside[-1] == " " and inside.strip(" "):
            inside = inside[1:-1]
        self.pieces.append((f"<code>{escaped(inside)}</code>", inside))
        return places[k] + size

    def pointed(self, at: int) -> int:
        for found, before in ((_AUTOLINK, ""), (_MAIL, "mailto:")):
            m = found.match(self.text, at)
            to = address(before + m[1]) if m else None
            if to is not None:
                self.pieces.append((f'<a href="{escaped(to)}">{escaped(m[1])}</a>', m[1]))
                return m.end()
        self.plain("<")
        return at + 1

    def target(self, bracket: Bracket, at: int) -> tuple[str, str, int] | None:
        """(address, title, place behind) of the link whose text ends before at."""
        text = self.text
        if text.startswith("(", at):
            here = _SPACE.match(text, at + 1).end()
            to = ("", here) if text.startswith(")", here) else destination(text, here)
            if to is not None:
                after = _SPACE.match(text, to[1]).end()
                name = title(text, after) if after > to[1] else None
                end = _SPACE.match(text, name[1]).end() if name else after
                if text.startswith(")", end) and (to[0] or to[1] > here or name is None):
                    return to[0], name[0] if name else "", end + 1
        m = _LABEL.match(text, at)
        label, end = (m[1], m.end()) if m and m[1].strip() else (text[bracket.at : at - 1] if at - bracket.at < 1001 else "", m.end() if m and not m[1] else at)
        if m is None and re.search(r"(?<!\\)(?:\\\\)*[\[]", label):
            return None  # a label holds no brackets
        found = self.targets.get(label_key(label)) if label.strip() else None
        return (*found, end) if found else None

    def close(self, at: int) -> int:
        bracket = self.brackets.pop() if self.brackets else None
        found = self.target(bracket, at + 1) if bracket is not None and bracket.active else None
        to = address(found[0]) if found else None
        if to is None:
            self.plain("]")
            return at + 1
        self.emphasis(bracket.marks)
        name = f' title="{escaped(found[1])}"' if found[1] else ""
        if bracket.image:
            inner = "".join((x.char * x.count) if isinstance(x, Marks) else x[1] for x in self.pieces[bracket.piece + 1 :])
            del self.pieces[bracket.piece :]
            self.pieces.append((f'<img src="{escaped(to)}" alt="{escaped(inner)}"{name} />', inner))
        else:
            self.pieces[bracket.piece] = (f'<a href="{escaped(to)}"{name}>', "")
            self.pieces.append(("</a>", ""))
            for earlier in reversed(self.brackets):  # no link within a link
                if not earlier.image:
                    if not earlier.active:
                        break
                    earlier.active = False
        return found[2]

    def emphasis(self, bottom: Marks | None) -> None:
        """Pairs the runs of marks above bottom and takes them off the stack."""
        floor: dict[tuple, Marks | None] = {}
        closer = self.last
        while closer is not None and closer.before is not bottom:
            closer = closer.before
        if closer is bottom:
            closer = None
        while closer is not None:
            if not closer.closes:
                closer = closer.after
                continue
            kind = (closer.char, closer.opens, closer.size % 3)
            low = floor.get(kind, bottom)
            opener = closer.before
            while opener is not None and opener is not bottom and opener is not low:
                odd = (closer.opens or opener.closes) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
                if opener.opens and opener.char == closer.char and not odd:
                    break
                opener = opener.before
            if opener is None or opener is bottom or opener is low:
                floor[kind] = closer.before
                after = closer.after
                if not closer.opens:
                    self.drop(closer)
                closer = after
                continue
            both = 2 if opener.count > 1 and closer.count > 1 else 1
            tag = "strong" if both == 2 else "em"
            opener.tags_in.append(f"<{tag}>")
            closer.tags_out.append(f"</{tag}>")
            opener.count -= both
            closer.count -= both
            opener.after, closer.before = closer, opener  # what stands between pairs no more
            if not opener.count:
                self.drop(opener)
            if not closer.count:
                after = closer.after
                self.drop(closer)
                closer = after
        self.last = bottom
        if bottom is not None:
            bottom.after = None


class Block:
    __slots__ = ("kind", "children", "lines", "start", "end", "level", "mark", "number", "width", "info", "columns")

    def __init__(self, kind: str, start: int):
        self.kind, self.start, self.end = kind, start, start
        self.children: list[Block] = []
        self.lines: list[str] = []
        self.level, self.mark, self.number, self.width, self.info = 0, "", 0, 0, ""
        self.columns: list[str] = []


def cells(row: str) -> list[str]:
    row = row.strip()
    out = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]
    return out[1 if row.startswith("|") and len(out) > 1 else 0 : -1 if row.endswith("|") and not row.endswith("\\|") and len(out) > 1 else None]


class Document:
    """The blocks of a text, from its lines in order, on a stack of open ones."""

    def __init__(self, tables: bool = False):
        self.tables = tables
        self.root = Block("document", 0)
        self.open = [self.root]
        self.targets: dict[str, tuple[str, str]] = {}
        self.number = 0

    # --- a place within a line; tabs reach to columns of four ---

    def look(self) -> None:
        """Where the next character that is not blank stands, and how many columns away."""
        at, column = self.at, self.column
        while at < len(self.line) and self.line[at] in " \t":
            column += 4 - column % 4 if self.line[at] == "\t" else 1
            at += 1
        self.next, self.indent, self.blank = at, column - self.column, at == len(self.line)
        self.next_column = column

    def go(self) -> None:
        self.at, self.column = self.next, self.next_column

    def pass_columns(self, count: int) -> None:
        while count > 0 and self.at < len(self.line) and self.line[self.at] in " \t":
            size = 4 - self.column % 4 if self.line[self.at] == "\t" else 1
            if size > count:
                self.column += count  # within a tab, which stays
                return
            self.column += size
            self.at += 1
            count -= size

    def rest(self) -> str:
        if self.at < len(self.line) and self.line[self.at] == "\t" and self.column % 4:
            return " " * (4 - self.column % 4) + self.line[self.at + 1 :]
        return self.line[self.at :]

    # --- blocks ---

    def push(self, kind: str, matched: int) -> Block:
        """A new block in the last matched container."""
        self.shut(matched)
        if self.open[-1].kind == "para" or (self.open[-1].kind == "list" and kind != "item"):
            self.shut(len(self.open) - 1)
        block = Block(kind, self.number)
        self.open[-1].children.append(block)
        self.open.append(block)
        return block

    def leaf(self, kind: str, matched: int) -> Block:
        block = self.push(kind, matched)
        self.open.pop()
        self.reach(len(self.open))
        block.end = self.number
        return block

    def shut(self, count: int) -> None:
        while len(self.open) > count:
            block = self.open.pop()
            if block.kind == "para":
                self.define(block)

    def reach(self, count: int) -> None:
        for b in self.open[:count]:
            b.end = self.number

    def define(self, para: Block) -> None:
        """Takes the definitions of references off the beginning of a paragraph."""
        if not para.lines or not para.lines[0].startswith("["):
            return
        text, at = "\n".join(para.lines), 0
        while (m := _LABEL.match(text, at)) and m[1].strip() and text.startswith(":", m.end()):
            here = _SPACE.match(text, m.end() + 1).end()
            to = destination(text, here)
            if to is None:
                break
            after = _SPACE.match(text, to[1]).end()
            name = title(text, after) if after > to[1] else None
            end = _LINE_END.match(text, name[1]) if name else None
            if end is None:
                name, end = None, _LINE_END.match(text, to[1])
            if end is None:
                break
            self.targets.setdefault(label_key(m[1]), (to[0], name[0] if name else ""))
            at = end.end()
            if at >= len(text):
                break
        para.lines = text[at:].split("\n") if at < len(text) else []

    def take(self, line: str) -> None:
        self.line, self.at, self.column = line, 0, 0
        self.number += 1
        matched, quoted_to = self.matched()
        if matched < 0:
            return
        tip = self.open[-1]
        if matched == len(self.open) and tip.kind in ("fence", "code"):
            tip.lines.append(self.rest())
            if not (tip.kind == "code" and self.blank):
                self.reach(matched)
            return
        lazy, begun = tip.kind == "para" and matched < len(self.open), False
        while True:
            self.look()
            if self.blank:
                break
            step = self.start(matched, lazy)
            if step is None:
                break
            if step == "done":
                return
            matched, lazy, begun = len(self.open), False, True
            if self.open[-1].kind == "code":
                self.reach(matched)
                return
        self.look()
        if self.blank:
            # a table or paragraph ends, a quote's own blank line is part of it
            self.shut(matched if self.open[min(matched, len(self.open)) - 1].kind not in ("para", "table") else matched - 1)
            self.reach(len(self.open) if begun else quoted_to)
            return
        self.go()
        if lazy and matched < len(self.open):
            tip.lines.append(self.line[self.at :])
            self.reach(len(self.open))
            return
        self.shut(matched)
        tip = self.open[-1]
        if tip.kind == "table":
            tip.lines.append(self.line[self.at :])
        elif tip.kind == "para":
            tip.lines.append(self.line[self.at :])
        else:
            self.push("para", matched).lines.append(self.line[self.at :])
        self.reach(len(self.open))

    def matched(self) -> tuple[int, int]:
        """How many open blocks go on in this line (-1: the line is done), and up to which a quote's mark reaches."""
        matched, quoted_to = 1, 0
        while matched < len(self.open):
            b = self.open[matched]
            self.look()
            if b.kind == "quote":
                if self.indent > 3 or self.blank or self.line[self.next] != ">":
                    break
                self.past_quote()
                quoted_to = matched + 1
            elif b.kind == "item":
                if self.blank:
                    if not b.children:
                        break
                    self.go()
                elif self.indent >= b.width:
                    self.pass_columns(b.width)
                else:
                    break
            elif b.kind == "fence":
                m = re.compile(rf"{re.escape(b.mark)}{{{b.number},}}[ \t]*$").match(self.line, self.next) if self.indent < 4 else None
                if m:
                    self.reach(matched + 1)
                    self.shut(matched)
                    return -1, 0
                self.pass_columns(b.width)
            elif b.kind == "code":
                if self.indent >= 4:
                    self.pass_columns(4)
                elif self.blank:
                    self.go()
                else:
                    break
            elif b.kind == "para" and self.blank:
                break
            matched += 1
        self.look()
        return matched, quoted_to

    def past_quote(self) -> None:
        self.at, self.column = self.next + 1, self.next_column + 1
        if self.at < len(self.line) and self.line[self.at] in " \t":
            self.pass_columns(1)

    def start(self, matched: int, lazy: bool) -> str | None:
        """Begins the block that begins here: container, done (the line is used up) or None."""
        line, here, last = self.line, self.next, self.open[matched - 1]
        in_para = lazy or last.kind == "para"
        if self.indent >= 4:
            if in_para or last.kind == "table":
                return None
            self.pass_columns(4)
            code = self.push("code", matched)
            code.lines.append(self.rest())
            return "container"
        c = line[here]
        if c == ">":
            self.go()
            self.past_quote()
            self.push("quote", matched)
            return "container"
        if c == "#" and (m := _HEADING.match(line, here)):
            block = self.leaf("heading", matched)
            block.level = len(m[1])
            block.lines = [_CLOSING.sub("", line[m.end() :]).strip(" \t")]
            return "done"
        if c in "`~" and (m := _FENCE.match(line, here)):
            block = self.push("fence", matched)
            block.mark, block.number, block.width = c, len(m[0]), self.indent
            block.info = unescaped(line[m.end() :].strip(" \t"))
            self.reach(len(self.open))
            return "done"
        if last.kind == "para" and not lazy:
            if self.tables and _TABLE_RULE.match(line, here) and "|" in last.lines[-1] and len(cells(last.lines[-1])) == len(cells(line[here:])):
                return self.table(last, matched)
            if c in "=-" and (m := _UNDERLINE.match(line, here)):
                self.define(last)
                if last.lines:
                    last.kind, last.level = "heading", 1 if c == "=" else 2
                    self.reach(matched)
                    self.shut(matched - 1)
                    return "done"
                last.lines = []
        if c in "*_-" and _RULE.match(line, here):
            self.leaf("rule", matched)
            return "done"
        return self.item(matched, in_para)

    def table(self, para: Block, matched: int) -> str:
        header = para.lines.pop()
        if not para.lines:
            self.open[matched - 2].children.pop()
            self.open.pop()
            block = self.push("table", matched - 1)
        else:
            block = self.push("table", matched)
        block.lines = [header]
        marks = [(c.startswith(":"), c.endswith(":")) for c in cells(self.line[self.next :])]
        block.columns = ["center" if a and b else "left" if a else "right" if b else "" for a, b in marks]
        self.reach(len(self.open))
        return "done"

    def item(self, matched: int, in_para: bool) -> str | None:
        m = _MARKER.match(self.line, self.next)
        if not m or not (m.end() == len(self.line) or self.line[m.end()] in " \t"):
            return None
        bare = not self.line[m.end() :].strip(" \t") if m.end() + 64 > len(self.line) or self.line[m.end() : m.end() + 64].isspace() else False
        last = self.open[matched - 1]
        if in_para and last.kind != "list" and (bare or (m[2] and int(m[2]) != 1)):
            return None
        indent = self.indent
        self.go()
        self.at = m.end()
        self.column += m.end() - m.start()
        mark = m[1] or m[3]
        if last.kind == "para":
            self.shut(matched - 1)
            matched -= 1
            last = self.open[matched - 1]
        if last.kind == "list" and last.mark != mark:
            matched -= 1
            last = self.open[matched - 1]
        if last.kind != "list":
            of = self.push("list", matched)
            of.mark, of.number = mark, int(m[2]) if m[2] else -1
            matched = len(self.open)
        self.look()
        gap = self.indent
        if self.blank or gap > 4:
            gap = 1
        self.pass_columns(gap)
        block = self.push("item", matched)
        block.width = indent + (m.end() - m.start()) + gap
        return "container"


def _loose(block: Block) -> bool:
    """Whether a blank line stands between a list's items, or between the blocks of one."""
    for a, b in zip(block.children, block.children[1:], strict=False):
        if b.start > a.end + 1:
            return True
    return any(b.start > a.end + 1 for item in block.children for a, b in zip(item.children, item.children[1:], strict=False))


def render(text: str, tables: bool = False) -> str:
    """text as HTML."""
    doc = Document(tables)
    lines = re.sub(r"\r\n?", "\n", text).replace("\0", "\ufffd").split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        doc.take(line)
    doc.shut(0)
    out: list[str] = []

    def fresh() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    def inline(lines: list[str]) -> str:
        return Inline("\n".join(x.lstrip(" \t") for x in lines).rstrip(" \t"), doc.targets).render()

    todo: list[tuple[Block | str, bool]] = [(doc.root, False)]
    while todo:
        block, tight = todo.pop()
        if isinstance(block, str):
            if block != "</li>":
                fresh()
            out.append(block + "\n")
            continue
        if block.kind == "document":
            todo += [(x, False) for x in reversed(block.children)]
        elif block.kind == "para":
            if block.lines:
                if tight:
                    if out and not out[-1].endswith(("<li>", "\n")):
                        out.append("\n")
                    out.append(inline(block.lines))
                else:
                    fresh()
                    out.append(f"<p>{inline(block.lines)}</p>\n")
        elif block.kind == "heading":
            fresh()
            out.append(f"<h{block.level}>{inline(block.lines)}</h{block.level}>\n")
        elif block.kind == "rule":
            fresh()
            out.append("<hr />\n")
        elif block.kind in ("code", "fence"):
            fresh()
            kept = block.lines
            if block.kind == "code":
                while kept and not kept[-1].strip(" \t"):
                    kept = kept[:-1]
            language = block.info.split()[0] if block.info.split() else ""
            kind = f' class="language-{escaped(language)}"' if language else ""
            out.append(f"<pre><code{kind}>" + escaped("".join(x + "\n" for x in kept)) + "</code></pre>\n")
        elif block.kind == "quote":
            fresh()
            out.append("<blockquote>\n")
            todo.append(("</blockquote>", False))
            todo += [(x, False) for x in reversed(block.children)]
        elif block.kind == "list":
            fresh()
            loose = _loose(block)
            tag = "ul" if block.number < 0 else "ol"
            out.append(f"<{tag}" + (f' start="{block.number}"' if block.number not in (-1, 1) else "") + ">\n")
            todo.append((f"</{tag}>", False))
            todo += [(x, not loose) for x in reversed(block.children)]
        elif block.kind == "item":
            out.append("<li>")
            todo.append(("</li>", False))
            todo += [(x, tight) for x in reversed(block.children)]
        elif block.kind == "table":
            fresh()
            n = len(block.columns)

            def row(line: str, tag: str, block: Block = block, n: int = n) -> str:
                held = [*cells(line), *[""] * n][:n]
                style = [f' style="text-align:{a}"' if a else "" for a in block.columns]
                return "<tr>\n" + "".join(f"<{tag}{s}>{inline([c])}</{tag}>\n" for s, c in zip(style, held, strict=True)) + "</tr>\n"

            body = "".join(row(x, "td") for x in block.lines[1:])
            out.append("<table>\n<thead>\n" + row(block.lines[0], "th") + "</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>\n")
    return "".join(out)
