"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a shunting-yard parser evaluates the
and/or/with expressions behind the tags."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lexweave.llm._common import map_texts

#: Base notice phrases and their labels. Fixed values.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases (words as the scan sees them) and their labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: What counts as permitted where nothing else is asked for.
PERMISSIVE = frozenset({"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "unlicense"})
#: The tag behind which a license expression stands, as the scan sees its words.
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx[^a-z0-9\x80-\U0010ffff]+license[^a-z0-9\x80-\U0010ffff]+identifier[^a-z0-9\x80-\U0010ffff:]*:?[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
#: Words are runs of digits, letters and everything beyond ASCII; A-Z count as a-z.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
#: How strongly the operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str]:
    """The license expression that text begins with, in postfix order: identifiers as they stand, operators in lower case behind
    their two sides. Operators in either case, `with` before `and` before `or`, all from the left. Empty without an identifier;
    what cannot belong ends it, and an operator or a bracket without its right side is left out."""
    output: list[str] = []
    waiting: list[str] = []

    def settle(binds: int) -> None:
        while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= binds:
            output.append(waiting.pop())

    operand, at = True, 0
    for m in _TOKEN.finditer(text):
        if text[at : m.start()].strip():
            break  # another character stands between
        at, token = m.end(), m[0]
        low = token.lower()
        if operand:
            name = token.rstrip(".:")
            if low == "(":
                waiting.append("(")
            elif low == ")" or low in BINDS or not name:
                break
            else:
                output.append(name)
                operand = False
        elif low == ")":
            if "(" not in waiting:
                break
            settle(0)
            waiting.pop()
        elif low in BINDS:
            settle(BINDS[low])
            waiting.append(low)
            operand = True
        else:
            break
    if operand:
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return output + [x for x in reversed(waiting) if x != "("]


def label_of(identifier: str) -> str:
    """The label of an identifier: its family in lower case, without version and variant."""
    low = identifier.lower()
    for start, label in (("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("bsd", "bsd"), ("mpl", "mpl"), ("epl", "epl"), ("bsl", "bsl"), ("isc", "isc"), ("unlicense", "unlicense")):
        if low == start or low.startswith((start + "-", start + "+")):
            return label
    return low


def labels_in(expression: list[str]) -> set[str]:
    """The labels an expression names; an exception counts as with:its name."""
    # the right side of `with` is one identifier, which stands before it, unless brackets make it an expression
    out: set[str] = set()
    for i, x in enumerate(expression):
        if x in BINDS:
            continue
        exception = expression[i + 1 : i + 2] == ["with"]
        out.add(f"with:{x.lower()}" if exception else label_of(x))
    return out


def permits(expression: list[str], allowed: frozenset[str]) -> bool:
    """Whether licenses of the allowed labels meet the expression: either side of `or`, both of `and`, the license of `with`."""
    held: list[bool] = []
    for x in expression:
        if x not in BINDS:
            held.append(label_of(x) in allowed)
            continue
        right, left = held.pop(), held.pop()
        held.append(left or right if x == "or" else left and (right or x == "with"))
    return held[0]


def written(expression: list[str]) -> str:
    """The expression with all its brackets. Its identifiers stand in postfix order as they stand in the text, so every operator
    only says where its brackets open and close and between which two identifiers it stands."""
    names = [x for x in expression if x not in BINDS]
    opens, closes, between = [0] * len(names), [0] * len(names), [""] * len(names)
    spans: list[tuple[int, int]] = []
    for x in expression:
        if x not in BINDS:
            at = spans[-1][1] + 1 if spans else 0
            spans.append((at, at))
            continue
        (middle, last), (first, end) = spans.pop(), spans.pop()
        opens[first] += 1
        closes[last] += 1
        between[end] = f" {x.upper()} "
        spans.append((first, last))
    return "".join(["(" * o + n + ")" * c + b for o, n, c, b in zip(opens, names, closes, between, strict=True)])


class LicenseScanner:
    def __init__(self, base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES, allowed: frozenset[str] = PERMISSIVE):
        import ahocorasick

        self.allowed = allowed
        self.machine = ahocorasick.Automaton()
        for is_base, phrases in ((True, base), (False, {k: v for k, v in more.items() if k not in base}), (None, {TAG: ""})):
            for phrase, label in phrases.items():
                self.machine.add_word(f" {phrase} ", (is_base, label, phrase.count(" ") + 1, len(phrase) + 2))
        self.machine.make_automaton()

    def __call__(self, text: str) -> dict:
        words = text.encode().translate(_WORDS).split()
        line = f" {b' '.join(words).decode()} "
        places, labels, base_labels, more, tags = [], set(), set(), 0, False
        for end, (is_base, label, _, length) in self.machine.iter(line):
            if is_base is None:
                tags = True
                continue
            if is_base:
                places.append(end - length + 1)
                base_labels.add(label)
            else:
                more += 1
            labels.add(label)
        found: list[list[str]] = []
        if tags:
            for m in TAG_TEXT.finditer(text):
                if expression := parse_expression(m[1]):
                    found.append(expression)
                    labels |= labels_in(expression)
        first, last = (line.count(" ", 0, f(places)) for f in (min, max)) if places else (None, None)
        # a tag names the license; a phrase may only mention it, and more of them say more
        score = 1.0 if found else 1 - 0.5 ** (len(places) + more)
        return {"n_words": len(words), "n_base": len(places), "first_word": first, "last_word": last, "base_labels": sorted(base_labels), "labels": sorted(labels), "expressions": [written(e) for e in found], "permitted": all(permits(e, self.allowed) for e in found) if found else None, "score": score}


MADE = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, permitted boolean, score double"
NAMES = [x.split()[0] for x in MADE.split(", ")]


def scan_licenses(df: DataFrame, text_col: str = "text", base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = MORE_PHRASES, allowed: frozenset[str] = PERMISSIVE, keep: list[str] | None = None) -> DataFrame:
    """Adds to df what the scan of each whole text finds: n_words; n_base, the places of base phrases (overlapping ones all
    count), with first_word and last_word, the smallest and largest word at which one starts (null without any); base_labels and
    labels, sorted and distinct; expressions, those behind the tags with all their brackets; permitted, whether the allowed labels
    meet all of them (null without any); score, 1 with a tag, else
    1 - 2^-(phrases found).

    Expressions of any length are read with a stack in linear time. Null and empty texts have no words, no labels and score 0. Repeated rows get equal answers, an empty df an empty result.
    Input columns of these names are replaced."""

    def work():
        scanner = LicenseScanner(base, more, allowed)

        def each(texts: pa.StringArray) -> list[pa.Array]:
            found = [scanner(t) for t in texts.to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.float64())
            return [pa.array([x[n] for x in found], k) for n, k in zip(NAMES, kinds, strict=True)]

        return each

    return map_texts(df, text_col, MADE, work, keep)
