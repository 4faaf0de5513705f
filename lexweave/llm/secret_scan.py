"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean trigram query is derived. A slice of documents gets postings (trigram to documents) for the
trigrams that any query names, the queries intersect and unite postings, and only the documents they leave are matched against
the rule itself. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm._common import map_texts, quoted, text_buffers

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches, leftmost and non-overlapping, whose group of that number has at least that many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in the order in which they are listed. Fixed values.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Well-known public key formats that the scan knows besides. Each is linear in the text: a match that fails is not tried again
#: from within the run that it failed on.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:(?!PRIVATE )[A-Z]+ )*+PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("web_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("bearer", r"(?i:authorization: *bearer) +[A-Za-z0-9._~+/=-]{16,}+"),
)
ALL_RULES = BASE_RULES + MORE_RULES
#: Sets of strings that a part of a pattern may stand for are followed up to this size; beyond it the query only gets weaker.
STRINGS = 64


def _both(kind: str, parts: list[Query]) -> Query:
    """The parts under one operator, flat and without repeats; True takes part in no `and` and is all of an `or`."""
    flat = list(dict.fromkeys(y for x in parts for y in (x[1] if isinstance(x, tuple) and x[0] == kind else (x,))))
    if kind == "and":
        flat = [x for x in flat if x is not True]
    if not flat or True in flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> Query:
    """What a text holding one of the strings must have."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


class Unsupported(ValueError):
    """A pattern of which no query can be derived; its rule scans every text."""


#: What the letter behind a backslash stands for: one character of many, no character, or itself as a control character.
_MANY, _NONE, _CONTROL = "dDsSwW", "AbBZ", {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}


class _Pattern:
    """A regex taken apart into sequences of parts: ("chars", characters or None for unknown ones), ("either", sequences),
    ("repeat", least, most or None, part), ("nothing",) and ("anything",)."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0
        self.whole = self.either()
        if self.at < len(pattern):
            raise Unsupported(pattern)

    def sees(self, *options: str) -> str | None:
        """The first option that stands here, which is passed over."""
        for x in options:
            if self.pattern.startswith(x, self.at):
                self.at += len(x)
                return x
        return None

    def next(self) -> str:
        if self.at >= len(self.pattern):
            raise Unsupported(self.pattern)
        self.at += 1
        return self.pattern[self.at - 1]

    def either(self) -> tuple:
        options = [self.sequence()]
        while self.sees("|"):
            options.append(self.sequence())
        return ("either", options)

    def sequence(self) -> list[tuple]:
        parts: list[tuple] = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            parts.append(self.repeated(self.part()))
        return parts

    def part(self) -> tuple:
        c = self.next()
        if c == "(":
            return self.group()
        if c == "[":
            return self.one_of()
        if c == ".":
            return ("chars", None)
        if c in "^$":
            return ("nothing",)
        if c in "*+?":
            raise Unsupported(self.pattern)
        return self.escape(False) if c == "\\" else ("chars", {c})

    def escape(self, in_class: bool) -> tuple:
        c = self.next()
        if c in _MANY:
            return ("chars", None)
        if c in _NONE and not in_class:
            return ("nothing",)
        if c in _CONTROL:
            return ("chars", {chr(_CONTROL[c])})
        if c in "xuU":
            digits = self.pattern[self.at : self.at + {"x": 2, "u": 4, "U": 8}[c]]
            self.at += len(digits)
            return ("chars", {chr(int(digits, 16))})
        if c.isalnum():
            raise Unsupported(self.pattern)  # numbers of groups, octal and named characters
        return ("chars", {c})

    def one_of(self) -> tuple:
        known: set[str] | None = None if self.sees("^") else set()
        first = True
        while first or not self.sees("]"):
            first = False
            c = self.next()
            part = self.escape(True)[1] if c == "\\" else {c}
            if self.pattern[self.at : self.at + 1] == "-" and self.pattern[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                c = self.next()
                high = self.escape(True)[1] if c == "\\" else {c}
                if part is None or high is None:
                    raise Unsupported(self.pattern)
                span = range(ord(min(part)), ord(min(high)) + 1)
                part = {chr(x) for x in span} if len(span) <= STRINGS else None
            known = None if known is None or part is None else known | part
        return ("chars", known)

    def group(self) -> tuple:
        if self.sees("?#"):
            while self.next() != ")":
                pass
            return ("nothing",)
        look = self.sees("?=", "?!", "?<=", "?<!")
        if look is None and not self.sees("?:", "?>"):
            if self.sees("?P<"):
                while self.next() != ">":
                    pass
            elif self.sees("?"):
                flags = ""
                while (c := self.next()) not in ":)":
                    flags += c
                if not flags.strip("aims-") == "":
                    raise Unsupported(self.pattern)  # verbose patterns, references, conditions
                if c == ")":
                    return ("nothing",)
        inner = self.either()
        if self.next() != ")":
            raise Unsupported(self.pattern)
        return inner if look is None else ("nothing",)

    def repeated(self, part: tuple) -> tuple:
        while self.at < len(self.pattern):
            found = re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.pattern, self.at)
            if c := self.sees("*", "+", "?"):
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            elif found and (found[1] or found[3]):
                self.at = found.end()
                least = int(found[1] or 0)
                most = int(found[3]) if found[3] else None if found[2] else least
            else:
                return part
            self.sees("?", "+")  # lazy or possessive: the same strings or fewer
            part = ("repeat", least, most, part)
        return part


def _strings(part: tuple) -> tuple[set[str] | None, Query]:
    """The lower-cased strings that one part of a pattern can stand for (None: too many or unknown), and a query it implies."""
    if part[0] == "chars":
        chars = part[1]
        return (None if chars is None or len(chars) > STRINGS or not all(c.isascii() for c in chars) else {c.lower() for c in chars}), True
    if part[0] == "either":
        parts = [_sequence(x) for x in part[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), _both("or", [q for _, q in parts])
        return None, _both("or", [q if s is None else _both("and", [q, _of_strings(s)]) for s, q in parts])
    if part[0] == "repeat":
        _, least, most, inner = part
        s, q = _strings(inner)
        if s is not None and (least, most) == (0, 1):
            return s | {""}, True
        if s is not None and least == most and len(s) ** least <= STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in s}
            return out, q
        return None, True if not least else q if s is None else _both("and", [q, _of_strings(s)])
    return ({""} if part[0] == "nothing" else None), True


def _sequence(parts: list[tuple]) -> tuple[set[str] | None, Query]:
    queries, run, whole = [], {""}, True
    for part in parts:
        strings, query = _strings(part)
        queries.append(query)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        queries.append(_of_strings(run))
        whole, run = False, {""} if strings is None else strings
    return (run if whole else None), _both("and", [*queries, True if whole else _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query, over ASCII-lower-cased text, that every text with a match satisfies; True if there is none."""
    try:
        strings, query = _strings(_Pattern(pattern).whole)
    except Unsupported:
        return True
    return query if strings is None else _both("and", [query, _of_strings(strings)])


def trigrams_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


class TrigramIndex:
    """Postings of the named trigrams over a slice of texts."""

    def __init__(self, names: list[str]):
        self.slot = np.zeros(1 << 21, np.uint16)  # trigrams of 7-bit characters
        for i, t in enumerate(names):
            a, b, c = t.encode()
            self.slot[a << 14 | b << 7 | c] = i + 1
        self.names = {t: i for i, t in enumerate(names)}

    def build(self, texts: pa.StringArray) -> np.ndarray:
        """A row of bits (documents) for each trigram."""
        data, rows = text_buffers(texts)
        held = np.zeros((len(self.names) + 1, len(texts)), bool)
        if len(data) > 2:
            low = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, np.where(data < 0x80, data, 0)).astype(np.uint32)
            code = low[:-2] << 14 | low[1:-1] << 7 | low[2:]
            found = self.slot[code]
            at = np.flatnonzero(found)
            row = np.searchsorted(rows, at, side="right") - 1
            inside = at + 2 < rows[row + 1]  # not across two texts
            held[found[at[inside]], row[inside]] = True
        return held[1:]

    def meets(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.names[query]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.meets(q, postings) for q in query[1]])


class Scanner:
    """Texts to their secrets, through the index; use_index=False matches every rule against every text."""

    def __init__(self, rules: tuple[Rule, ...] = ALL_RULES, use_index: bool = True):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) if use_index else True for r in rules]
        self.index = TrigramIndex(sorted(set().union(*map(trigrams_of, self.queries))))
        # a repeated class at a pattern's end is greedy, so a lower bound on it keeps exactly the long matches
        self.found = [re.compile(re.sub(r"\A(AKIA)?(\[[^\]]*\])\+\Z", lambda m, r=r: f"{m[1] or ''}{m[2]}{{{r.least - len(m[1] or '')},}}", r.pattern) if r.least and not r.group else r.pattern, re.ASCII) for r in rules]

    def __call__(self, texts: pa.StringArray) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule, end), sorted; places count code points, the end is exclusive."""
        postings = self.index.build(texts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        plain: dict[int, str] = {}
        full = texts.to_pylist() if True in self.queries else None
        for k, (rule, query, found) in enumerate(zip(self.rules, self.queries, self.found, strict=True)):
            for i in np.flatnonzero(self.index.meets(query, postings)).tolist():
                text = full[i] if full else plain.setdefault(i, texts[i].as_py())
                spans[i] += [(m.start(), k, m.end()) for m in found.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in spans]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _work(rules: tuple[Rule, ...], use_index: bool, redact: str | None) -> Callable:
    def work():
        scanner = Scanner(rules, use_index)

        def each(texts: pa.StringArray) -> list[pa.Array]:
            found = scanner(texts)
            kinds = [r.kind for r in rules]
            flat = [x for spans in found for x in spans]
            struct = pa.StructArray.from_arrays([pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], names=["kind", "start", "end"])
            out = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)), struct)]
            if redact is not None:
                out.append(pa.array([blanked(t.as_py(), x, redact) if x else t.as_py() for t, x in zip(texts, found, strict=True)], pa.string()))
            return out

        return each

    return work


def blanked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES, keep: list[str] | None = None, use_index: bool = True) -> DataFrame:
    """Adds `secrets`, an array of (kind, start, end) sorted by start and then by the order of the rules, to df.

    Null and empty texts have an empty array, repeated rows are scanned alike, an empty df gives an empty result, and a column
    of that name is replaced. Texts are scanned whole, whatever their length."""
    return map_texts(df, text_col, T.StructType([T.StructField("secrets", T.ArrayType(SPAN))]), _work(rules, use_index, None), keep)


def redact_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES, mark: str = "[SECRET]") -> DataFrame:
    """df with its secrets replaced by mark; a null text stays null, every row and the columns' order stay."""
    made = T.StructType([T.StructField("__spans", T.ArrayType(SPAN)), T.StructField("__redacted", T.StringType())])
    out = map_texts(df, text_col, made, _work(rules, True, mark), None)
    text = F.when(F.col("__redacted") == "", quoted(text_col)).otherwise(F.col("__redacted"))
    return out.select(*[text.alias(c) if c == text_col else quoted(c) for c in df.columns])
