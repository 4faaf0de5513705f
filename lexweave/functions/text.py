"""Text functions on columns. Everything here is a built-in expression that stays in code generation.

White space and word characters follow Unicode: Java's classes and those of other engines differ, so both are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One Unicode white-space character (for Java regexes).
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: One word character.
W = r"[\p{L}\p{N}_]"
#: What ends a line beside \n: also separators that a plain text reader does not know.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: Page furniture that a text extraction leaves behind, whatever the document; a parameter where it is used, so that a caller adds
#: the running titles of its own documents. Fixed values.
BOILERPLATE = (r"do\s+not\s+cite,\s*quote\s+or\s+distribute", r"total\s+pages\s*:\s*\d+")
# The forms that a report's lines, its citations' markup and a summary's section on issues are written in.
#: The assessment markup that is removed before terms are paired: (high confidence, ...) and {...}.
ASSESSMENT = r"(?i)\((?:very |high |medium |low )?(?:confidence|agreement|evidence)(?:,\s*(?:very |high |medium |low )?(?:confidence|agreement|evidence))?\)|\{[^}]*\}"
NUMBERED = r"^([A-D]\d+(?:\.\d+)+)" + WS + r"+(.*)$"
FIRST_LEVEL = r"^([A-D]\d)" + WS + r"+(.*)$"
FIGURE = r"^Figure" + WS + r"+(SPM\.\d+):" + WS + r"+(.*)$"
SUMMARY_ITEM = r"^(?:#{1,6}" + WS + r"+)?\[(ES\d+\.\d+(?:\.\d+)?)\]" + WS + r"+(.*)$"
ISSUES = r"(?imsd)^###\s+Potential issues(?:\s+(?:needing|for))?\s+substantive review[^\n]*\n(.*?)(?=\n###\s|\z)"
NO_ISSUE = r"(?i)^-?\s*none identified\b"
#: What `See X (under P)` begins with, and `See X.`; `See also` is neither.
SEE_UNDER = rf"(?iud)^See(?!{WS}+also\b){WS}+.+?{WS}+\(under{WS}+"
SEE = rf"(?iud)^See(?!{WS}+also\b){WS}+(.+?)\.?\z"
#: Phrases of style names and the heading levels they stand for, the first that fits counting.
STYLE_LEVELS = (
    ("0th level chapter heading", 1),
    ("1st level heading", 2),
    ("2nd level heading", 3),
    ("3rd level heading", 4),
    ("4th level heading", 5),
)


def lit_regex(text: str) -> str:
    """text as a regex that matches it."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where use names its argument several times but the value is to be computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapsed(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def cell(c: Column) -> Column:
    """A worksheet cell as text: null is empty."""
    return collapsed(F.coalesce(c.cast("string"), F.lit("")))


def folded(c: Column) -> Column:
    """Caseless form. Characters whose folding is longer than one character are covered for the sharp s only."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def lines(c: Column) -> Column:
    """The lines of a text; a line end at its end begins no further line."""
    plain = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    cut = once(F.split(plain, "\n"), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(cut)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])" + WS + "+")


def slug(c: Column, empty: str) -> Column:
    made = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(empty))


def term_anchor(c: Column) -> Column:
    return F.concat(F.lit("term-"), slug(F.lower(c), "item"))


def heading_anchor(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), slug(folded(c), "section"))


def statement_key(number: Column, text: Column) -> Column:
    return F.struct(folded(collapsed(number)).alias("number_key"), folded(collapsed(text)).alias("text_key"))


def table_cell(c: Column) -> Column:
    return F.replace(collapsed(c), F.lit("|"), F.lit("\\|"))


def drops_line(line: Column, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    """Whether a line of an extracted page is a page number or furniture; blank lines stay."""
    def drops(bare: Column) -> Column:
        out = bare.rlike(r"^\d{1,3}$")
        for p in patterns:
            out = out | bare.rlike("(?i)" + p)
        return (bare != "") & out

    return once(stripped(line), drops)


def clean_page(c: Column, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    """An extracted page made readable, in this order: line ends, trailing blanks, furniture, hyphenated breaks, trailing page
    numbers (a true number of up to three digits at a line's end goes as well), blank lines."""
    rows = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), lambda x: F.rtrim(x, F.lit(BLANKS)))
    kept = F.array_join(F.filter(rows, lambda x: ~drops_line(x, patterns)), "\n")
    # most texts and lines hold nothing to replace, which a plain search tells sooner than a regex
    joined = once(kept, lambda x: F.when(F.contains(x, F.lit("-\n")), F.regexp_replace(x, f"(?<={W})-\n(?={W})", "")).otherwise(x))
    plain = F.array_join(F.transform(F.split(joined, "\n"), lambda x: F.when(F.substring(x, -1, 1).between("0", "9"), F.regexp_replace(x, r"(?<=\S)" + WS + r"+\d{1,3}\z", "")).otherwise(x)), "\n")
    return F.coalesce(stripped(F.regexp_replace(plain, "\n{3,}", "\n\n")), F.lit(""))


def parent_of(explanation: Column) -> Column:
    """The parent in `See X (under P)` or `See X.`; `See also` names none."""
    rest = F.rtrim(F.regexp_replace(F.regexp_replace(explanation, SEE_UNDER, ""), r"\.+\z", ""), F.lit(BLANKS))
    direct = stripped(F.regexp_replace(F.regexp_extract(explanation, SEE, 1), r"\.+\z", ""))
    under = F.rtrim(F.regexp_replace(rest, r"\)\z", ""), F.lit(BLANKS))
    return F.when(explanation.rlike(SEE_UNDER) & rest.endswith(")"), under).otherwise(direct)


def chapter_of(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?i)_ch(\d+)_", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no chapter number in "), name))).otherwise(found).cast("int")


def heading_level(style: Column) -> Column:
    """The level a paragraph style stands for, or null."""
    low = F.lower(stripped(style))
    named = F.regexp_extract(low, f"heading{WS}*([0-9]+)", 1)
    # a number of any length is at least 6 where it does not fit
    out = F.when(named != "", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(named.try_cast("int"), F.lit(6)))))
    for phrase, level in STYLE_LEVELS:
        out = out.when(F.contains(low, F.lit(phrase)), F.lit(level))
    return out


def marked_heading(text: Column, level: Column) -> Column:
    return F.when(level.isNull(), text).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))


def shifted_headings(c: Column) -> Column:
    """Headings of one to four marks go down two levels, six at most."""
    out = c
    for level in (4, 3, 2, 1):
        out = F.regexp_replace(out, r"(?md)^#{" + str(level) + r"}(?=\s)", "\x00" * min(level + 2, 6))
    return F.replace(out, F.lit("\x00"), F.lit("#"))


def statement_of(section: Column, line: Column) -> Column:
    """(statement, text, whole) of a report line: a figure caption of a lettered section (never split), a numbered statement, a
    first-level one, or the section's own line."""
    figure = (F.regexp_extract(line, FIGURE, 1) != "") & section.startswith("Section ")
    numbered, first = F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, FIRST_LEVEL, 1)
    number = F.when(figure, F.concat(F.substr(section, F.lit(9)), F.lit("-Figure "), F.regexp_extract(line, FIGURE, 1))).when(numbered != "", numbered).when(first != "", first).otherwise(section)
    text = F.when(figure, F.regexp_extract(line, FIGURE, 2)).when(numbered != "", F.regexp_extract(line, NUMBERED, 2)).when(first != "", F.regexp_extract(line, FIRST_LEVEL, 2)).otherwise(line)
    return F.struct(number.alias("statement"), text.alias("statement_text"), figure.alias("whole"))


def references(c: Column) -> Column:
    """The numeric references in braces, distinct, in order of appearance."""
    blocks = F.regexp_extract_all(c, F.lit(r"\{([^}]*)\}"), 1)
    parts = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "[;,]"))), collapsed)
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"^\d+(?:\.\d+)+$")))


def has_potential_issue(summary: Column) -> Column:
    """Whether a summary's section on potential issues says more than `none identified`; an empty section counts as more."""
    there = summary.rlike(ISSUES)
    said = stripped(F.regexp_replace(F.regexp_extract(summary, ISSUES, 1), "[*_`]", ""))
    return F.coalesce(there & ~said.rlike(NO_ISSUE), F.lit(False))


def text_chunks(c: Column, size: int = 2000) -> Column:
    """The stripped text in pieces of at most size characters; none for a blank one."""
    def cut(text: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), ((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(made)

    return once(stripped(F.coalesce(c, F.lit(""))), cut)


def flag_value(flag: Column, kind: Column) -> Column:
    """A yes/no value as JSON for a property of the given kind."""
    label = F.when(flag, "Yes").otherwise("No")
    named = F.struct(label.alias("name"))
    return (
        F.when(kind == "checkbox", F.to_json(F.struct(flag.alias("checkbox"))))
        .when(kind == "select", F.to_json(F.struct(named.alias("select"))))
        .when(kind == "status", F.to_json(F.struct(named.alias("status"))))
        .otherwise(F.to_json(F.struct(F.transform(text_chunks(label), lambda t: F.struct(F.struct(t.alias("content")).alias("text"))).alias("rich_text"))))
    )


def property_name(c: Column) -> Column:
    return folded(collapsed(c))


# Fixed values of the address formats: IPv4 and IPv6.
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV6 = r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=(?:.*::))(?!.*::.*::)(?:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?::(?:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?"


def client_ip(*headers: Column) -> Column:
    """The first valid address in the headers, each a comma list, in this order; else Unavailable."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(h, F.lit("")), ",") for h in headers]))
    valid = F.filter(F.transform(parts, stripped), lambda p: p.rlike(f"^(?:{IPV4}|{IPV6})$"))
    return F.coalesce(F.get(valid, F.lit(0)), F.lit("Unavailable"))


def json_text(c: Column) -> Column:
    """A text as a JSON literal, other scripts left readable."""
    told = F.to_json(F.struct(c.alias("v")))
    return F.substring(told, F.lit(6), F.length(told) - 6)


def utc_stamp(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def zoned_stamp(c: Column, zone: str) -> Column:
    """Local time of a UTC instant with microseconds and offset."""
    utc = F.to_utc_timestamp(c, F.current_timezone())
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), sign, F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))


def occurrence_at(occurrences: Column, index: Column) -> Column:
    """The occurrence a clicked index names; null for what is no number or out of range."""
    at = index.try_cast("int")
    return F.when(at >= 0, F.get(occurrences, at))


def setting(*names: Column) -> Column:
    """The first non-blank value, without one matching pair of quotes."""
    def clean(c: Column) -> Column:
        text = stripped(c)
        return F.when(text.rlike(r"""(?s)^(["']).*\1$""") & (F.length(text) > 1), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)

    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in names])


def matches_term(text: Column, term: Column) -> Column:
    """Whether the folded term stands in the folded text with no word character beside it. The plain search first."""
    body = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    # the term first, then what stands before it: the search is for fixed characters
    return F.contains(text, term) & F.regexp_like(text, F.concat(body, F.lit(f"(?!{W})(?<!{W}"), body, F.lit(")")))


def has_constant(text: Column, term: str) -> Column:
    """matches_term for a term that is known when the plan is made."""
    return F.contains(text, F.lit(term)) & text.rlike(f"{lit_regex(term)}(?!{W})(?<!{W}{lit_regex(term)})")


def escaped(c: Column) -> Column:
    """HTML escaping, quotes included."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlighted(c: Column, term: str) -> Column:
    """The escaped text with the term marked. The term itself is not escaped, so one with & or quotes never matches."""
    pattern = f"(?iu)(?<!{W}){lit_regex(term)}(?!{W})"
    return F.regexp_replace(escaped(c), pattern, "<mark>$0</mark>")


def highlighted_by(c: Column, term: Column) -> Column:
    """`highlighted` with a term of each row."""
    body = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_replace(escaped(c), F.concat(F.lit(f"(?iu)(?<!{W})"), body, F.lit(f"(?!{W})")), F.lit("<mark>$0</mark>"))
