import hashlib
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import licenses, queries, secret_scan

PLAIN = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, keep) in enumerate(PLAIN) for m in p.finditer(text) if keep(m))


def test_secrets_equal_plain_regexes_on_all_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op5_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base_spans(texts[r["doc_id"]])
        told = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{n}"] for n, _, _ in PLAIN] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert not found or all(s in r["spans"].split(",") for s in told.split(","))


ALPHABET = st.lists(st.sampled_from(["password", "Token", "API_KEY", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGHIJKLMN", "AKIAAKIA", "0123456789abcdef", "dead", "beef", "Kabcdefghijkl", "é", "ſecret", "toKen", "\n", "gh", "p_", "a" * 36, "eyJ", "."]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_the_index_loses_no_match(texts):
    array = pa.array(texts, pa.string())
    with_index, without = secret_scan.Scanner()(array), secret_scan.Scanner(use_index=False)(array)
    assert with_index == without
    assert [[s for s in spans if s[1] < 3] for spans in with_index] == [base_spans(t) for t in texts]


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigram_query("ab(c|d)e") == ("or", (("and", ("abc", "bce")), ("and", ("abd", "bde"))))
    assert secret_scan.trigram_query("ab?c") is True
    assert secret_scan.trigram_query("(abc)*def") == "def"
    assert secret_scan.trigram_query(r"(?<![a-z])a\x62[c](?i:D)e{2}") == ("and", ("abc", "bcd", "cde", "dee"))
    assert secret_scan.trigram_query(r"(a)\1bcd") is True  # what is not understood scans every text
    assert [secret_scan.trigram_query(r.pattern) is True for r in secret_scan.ALL_RULES] == [r.kind == "hex" for r in secret_scan.ALL_RULES]


PATTERN = st.recursive(
    st.sampled_from(["a", "b", "c", "ab", "abc", "[ab]", "[a-c]", "[^a]", ".", r"\d", r"\x61", "A", r"\.", "é", "(?=a)", "(?<!b)", "^", r"\b"]),
    lambda inner: st.tuples(inner, inner).map("".join) | st.tuples(inner, inner).map(lambda t: f"(?:{t[0]}|{t[1]})") | st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{1,2}", "{,2}", "{2,}", "*?", "++"])).map(lambda t: f"(?:{t[0]}){t[1]}") | inner.map(lambda t: f"(?i:{t})") | inner.map(lambda t: f"({t})"),
    max_leaves=8,
)


@settings(max_examples=600, deadline=None)
@given(PATTERN, st.lists(st.sampled_from(["a", "b", "c", "A", "B", "ab", "abc", "1", ".", "é", " "]), max_size=14).map("".join))
def test_a_query_holds_where_its_pattern_matches(pattern, text):
    if re.search(pattern, text, re.ASCII):
        query = secret_scan.trigram_query(pattern)
        index = secret_scan.TrigramIndex(sorted(secret_scan.trigrams_of(query)))
        assert index.meets(query, index.build(pa.array([text]))).all()


@pytest.mark.parametrize("rule", secret_scan.ALL_RULES, ids=lambda r: r.kind)
def test_rules_take_linear_time(rule):
    """Ten million characters that begin a match again and again and never, or only at the end, complete it."""
    starts = {"assign": "password ", "access": "AKIA0", "hex": "0123456789abcde-", "private_key": "-----BEGIN A B ", "git_token": "ghp_abc", "chat_token": "xoxb-", "web_key": "AIzaAIza-", "jwt": "eyJabc-", "bearer": "authorization: bearer  "}
    rnd = random.Random(1)
    blob = "".join(rnd.choices("ABCDEFabcdef0123456789-_eyJ.", k=100_000))
    for text in (starts[rule.kind] * (10_000_000 // len(starts[rule.kind])), starts[rule.kind] + " " * 10_000_000, starts[rule.kind] + "A" * 10_000_000, starts[rule.kind] + "A " * 5_000_000, blob * 100):
        began = time.time()
        secret_scan.Scanner((rule,))(pa.array([text]))
        assert time.time() - began < 20


def test_secrets_of_odd_texts(odd, empty):
    out = secret_scan.find_secrets(odd)
    assert out.columns == [*odd.columns, "secrets"] and out.count() == odd.count()
    for r in out.collect():
        found = [(s["start"], [n for n, _, _ in PLAIN].index(s["kind"]), s["end"]) for s in r["secrets"] if s["kind"] in ("assign", "access", "hex")]
        assert found == base_spans(r["text"] or "")
    clean = secret_scan.redact_secrets(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    changed = set(key(odd.collect())) - set(key(clean.collect()))
    assert [t for _, t in changed] == ["token = 'abcdefghijklmnop'"]
    assert secret_scan.find_secrets(empty).count() == 0 and secret_scan.redact_secrets(empty).count() == 0


def test_blanked_spans_may_overlap():
    assert secret_scan.blanked("abcdefghij", [(1, 0, 4), (3, 1, 6), (8, 2, 9)], "#") == "a#ghi"[:1] + "#gh#j"


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})


def test_licenses_equal_plain_search_on_all_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op7_licenses(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], [x for x in r["base_labels"].split(",") if x]) == plain_scan(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "Apache", "cc", "BY", "by", "gnu", "general", "public", "İ", "é", " ", " ", "-", "\n", ".", "Kcc"]), max_size=25).map("".join))
def test_license_places(text):
    r = licenses.LicenseScanner()(text)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(text)


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("MIT", "MIT"),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "(MIT OR (Apache-2.0 AND BSD-3-Clause))"),
        ("(MIT or Apache-2.0) and GPL-2.0-only WITH Classpath-exception-2.0", "((MIT OR Apache-2.0) AND (GPL-2.0-only WITH Classpath-exception-2.0))"),
        ("MIT and", "MIT"),
        ("MIT */", "MIT"),
        ("(MIT", "MIT"),
        ("or MIT", None),
        ("", None),
        ("MIT AND (", "MIT"),
        ("MIT OR ((", "MIT"),
        (") MIT", None),
        ("MIT AND (BSD-2-Clause", "(MIT AND BSD-2-Clause)"),
    ],
)
def test_license_expressions(text, told):
    found = licenses.parse_expression(text)
    assert (licenses.written(found) if found else None) == told


def test_long_expressions():
    """Expressions of 100,000 operands, nested either way, through the whole scan."""
    n = 100_000
    for text, told in (
        (" OR ".join(["MIT"] * n), "(" * (n - 1) + "MIT" + " OR MIT)" * (n - 1)),
        ("(" * n + "MIT" + ")" * n, "MIT"),
        ("MIT OR (" * n + "MIT" + ")" * n, "(MIT OR " * n + "MIT" + ")" * n),
        ("(" * n, None),
        ("MIT AND (" * n, "(MIT AND " * (n - 1) + "MIT" + ")" * (n - 1)),
    ):
        began = time.time()
        r = licenses.LicenseScanner()("SPDX-License-Identifier: " + text + "\n" + "spdx " * n + "spdx license " * n)
        assert r["expressions"] == ([] if told is None else [told]) and r["permitted"] is (None if told is None else True)
        assert time.time() - began < 20


def plain_tree(tokens):
    """A small parser that climbs precedences, for whole expressions."""
    def climb(least):
        if tokens[0] == "(":
            tokens.pop(0)
            left = climb(1)
            tokens.pop(0)
        else:
            left = tokens.pop(0)
        while tokens and tokens[0] in licenses.BINDS and licenses.BINDS[tokens[0]] >= least:
            op = tokens.pop(0)
            left = (op, left, climb(licenses.BINDS[op] + 1))
        return left

    return climb(1)


def told_tree(tree):
    return tree if isinstance(tree, str) else f"({told_tree(tree[1])} {tree[0].upper()} {told_tree(tree[2])})"


def allows(tree, allowed):
    if isinstance(tree, str):
        return tree.lower() in allowed
    left, right = allows(tree[1], allowed), allows(tree[2], allowed)
    return left or right if tree[0] == "or" else left if tree[0] == "with" else left and right


EXPRESSION = st.recursive(st.sampled_from(["MIT", "isc", "zlib", "x-1"]), lambda inner: st.tuples(inner, st.sampled_from(["or", "and", "with"]), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | st.tuples(inner, st.sampled_from(["or", "AND"]), inner).map(" ".join), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(EXPRESSION)
def test_expressions_equal_a_plain_parser(text):
    tree = plain_tree(re.findall(r"[()]|[^() ]+", text.replace("AND", "and")))
    found = licenses.parse_expression(text)
    assert licenses.written(found) == told_tree(tree)
    assert licenses.permits(found, frozenset({"mit", "isc"})) == allows(tree, {"mit", "isc"})


def test_license_tags_are_evaluated():
    scan = licenses.LicenseScanner()
    r = scan("x\n// SPDX-License-Identifier: (MIT OR GPL-3.0+) AND Zlib\nrest")
    assert r["expressions"] == ["((MIT OR GPL-3.0+) AND Zlib)"] and r["labels"] == ["gpl", "mit", "zlib"] and r["permitted"] is False and r["score"] == 1.0
    assert scan("SPDX-License-Identifier: GPL-2.0 OR MIT")["permitted"] is True
    assert scan("spdx license identifier")["expressions"] == [] and scan("nothing")["permitted"] is None


def test_licenses_of_odd_texts(odd, empty):
    out = licenses.scan_licenses(odd)
    assert out.count() == odd.count() and all((r["n_words"], r["n_base"]) == plain_scan(r["text"] or "")[:2] for r in out.collect())
    assert licenses.scan_licenses(empty).count() == 0
