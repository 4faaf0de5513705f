"""Parsers and matchers on hand-made documents."""

import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexweave.functions import markup
from lexweave.functions import text as t
from lexweave.operators import anchors, documents, glossary, matching, network, summaries

REPORT = """# Demo Report
Ada Lovelace, Climate Risk Team
Table of Contents
1 Introduction
## Introduction
Urban areas face risk. CO₂ matters!
## Acknowledgements
dropped risk
## Section A: State
A1 Climate risk is rising (high confidence).
A1.1 Climate risk grows. Adaptation helps (medium evidence, high agreement) {1.4.2; 1.2, CCB; 1.4.2}.
A1.10 Risks differ {2.3}.
Figure SPM.1: Urban area map. Risk shown.
### A9.9 not numbered
"""
SUMMARY = "# Executive Summary\n\n## [ES1.1] Heading on risk\n\n[ES1.1.1] Adaptation lowers **climate risk**. Risk-free is rare.\n"
TERMS = ["risk", "climate risk", "adaptation", "urban area", "confidence", "co₂"]


@pytest.fixture(scope="module")
def lines(spark):
    return documents.text_lines(spark.createDataFrame([(1, REPORT), (2, None)], "doc_id long, text string"))


@pytest.fixture(scope="module")
def sentences(spark, lines):
    summary = documents.text_lines(spark.createDataFrame([(1, SUMMARY)], "doc_id long, text string"))
    return documents.sentence_rows(documents.statements(documents.report_lines(lines)), documents.summary_items(summary)).cache()


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(x, x) for x in TERMS], "term_key string, term string")


def test_sections(lines):
    assert [(r["section"], r["n_lines"]) for r in documents.sections_of(lines).orderBy("section_rank").collect()] == [("Author Team", 1), ("Introduction", 1), ("Section A", 5), ("Section B", 0), ("Section C", 0), ("Section D", 0)]
    assert documents.report_titles(lines).first()["title"] == "Demo Report"


def test_sentences(sentences):
    rows = [(r["statement"], r["sentence"]) for r in sentences.orderBy(*documents.CORPUS_ORDER).collect()]
    assert [s for s, _ in rows] == ["Author Team", "Introduction", "Introduction", "A1", "A1.1", "A1.1", "A1.10", "A-Figure SPM.1", "Section A", "ES1.1", "ES1.1.1", "ES1.1.1"]
    assert rows[7][1] == "Urban area map. Risk shown." and rows[10][1] == "Adaptation lowers climate risk."


def test_usage(sentences, terms):
    want = {"risk": 8, "climate risk": 4, "adaptation": 2, "urban area": 1, "confidence": 1, "co₂": 1}
    assert {r["term_key"]: r["n"] for r in matching.usage_counts(sentences, terms).collect()} == want
    folded = sentences.select(F.lower("sentence").alias("folded"))
    many = matching.containing(folded, terms.select("term_key"), constant_terms=0).groupBy("term_key").count()
    assert {r["term_key"]: r["count"] for r in many.collect()} == want


def test_terms_without_word_characters(spark):
    s = spark.createDataFrame([("a -- b",), ("c",), ("x😀y ++",), ("a--",)], "folded string")
    marks = [chr(0x2190 + i) for i in range(100)]  # more than are made constants
    k = spark.createDataFrame([("--",), ("b",), ("😀",), ("+",), (" ",), *((m,) for m in marks)], "term_key string")
    assert sorted((r["folded"], r["term_key"]) for r in matching.containing(s, k, constant_terms=0).collect()) == [("a -- b", "--"), ("a -- b", "b"), ("x😀y ++", "+")]
    rows = spark.createDataFrame([(i, f"see {m} here") for i, m in enumerate(marks)], "n int, folded string")
    assert matching.containing(rows, k.filter("term_key <> ' '")).count() == 100


def test_both_ways_of_matching_agree(spark):
    rnd = random.Random(3)
    parts = ["risk", "climate", " ", " ", "-", "co₂", "c", "+", ".", "net", "a", "é", "\u00a0", "😀", "_", "1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    terms = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 6))).strip() for _ in range(60)} - {""})
    s = spark.createDataFrame([(i, x) for i, x in enumerate(texts + texts[:50])], "n int, folded string")
    k = spark.createDataFrame([(x, x.upper()) for x in terms], "term_key string, term string")
    told = [sorted(tuple(r) for r in f.select("n", "term_key", "term").collect()) for f in (matching.containing(s, k, constant_terms=100), matching.by_first_words(s, k))]
    plain = sorted((i, x, x.upper()) for i, text in enumerate(texts + texts[:50]) for x in terms if re.search(rf"(?<!\w){re.escape(x)}(?!\w)", text))
    assert told[0] == told[1] == plain and plain


def test_sentences_move_once(spark):
    """No exchange under the join of beginnings carries the text."""
    s, k = spark.range(10).select(F.concat(F.lit("text "), "id").alias("folded"), F.lit("more").alias("other")), spark.createDataFrame([("text",)], "term_key string")
    plan = matching.by_first_words(s, k)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(i for i, x in enumerate(plan.split("\n")) if "Generate inline" in x)
    assert "other" in plan and "other#" not in "\n".join(plan.split("\n")[generate : generate + 2]).split("Range")[0]


def test_quoted_terms(spark):
    s = spark.createDataFrame([(r"uses c++ and a\Eb and (x)",)], "folded string")
    k = spark.createDataFrame([("c++",), (r"a\Eb",), ("(x)",), ("c",), ("use",)], "term_key string")
    assert sorted(r["term_key"] for r in matching.containing(s, k).collect()) == ["(x)", r"a\Eb", "c", "c++"]


def test_network(spark, sentences, terms):
    usage = matching.usage_counts(sentences, terms)
    edges = network.edges(sentences, usage.filter("n > 0"))
    rows = {(r["source"], r["target"]): r for r in edges.collect()}
    assert {k: [e["statement"] for e in r["evidence"]] for k, r in rows.items()} == {
        ("climate risk", "risk"): ["Author Team", "A1", "A1.1", "ES1.1.1"],
        ("risk", "urban area"): ["A-Figure SPM.1"],
        ("adaptation", "climate risk"): ["ES1.1.1"],
        ("adaptation", "risk"): ["ES1.1.1"],
    }
    assert all(r["weight"] == len(r["evidence"]) and r["source"] < r["target"] and r["statements"] == sorted(set(r["statements"])) for r in rows.values())
    nodes = network.nodes(terms, usage)
    assert {r["id"] for r in nodes.collect()} == set(TERMS)
    inside, held = network.filtered(nodes, edges, (2, 100), (2, 100))
    assert {r["id"] for r in inside.collect()} == {"risk", "climate risk"} and held.count() == 1
    text = network.cypher_lines(nodes, edges).orderBy("kind", "a", "b").collect()
    read = spark.createDataFrame([(x,) for r in text for x in r["text"].split("\n")], "value string")
    n2, e2 = network.parse_cypher(read)
    assert sorted(map(str, n2.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(str, e2.select(*edges.columns).collect())) == sorted(map(str, edges.collect()))
    assert 'SET connection.weight = 1, connection.statements = ["A-Figure SPM.1"]' in "\n".join(r["text"] for r in text)
    assert [tuple(r) for r in network.ranges(nodes, edges).orderBy("of").collect()] == [("count", 1, 5, 8), ("weight", 1, 4, 4)]


def test_citations(lines):
    links = documents.citations(documents.report_lines(lines))
    assert [(r["statement"], r["reference"]) for r in links.orderBy("pos", "ref_pos").collect()] == [("A1.1", "1.4.2"), ("A1.1", "1.2"), ("A1.10", "2.3")]
    assert [r["label"] for r in network.sankey_nodes(links).orderBy("node_index").collect()] == ["A1.1", "A1.10", "1.2", "1.4.2", "2.3"]
    assert sorted((r["source"], r["target"]) for r in network.sankey_links(links).collect()) == [(0, 2), (0, 3), (1, 4)]


def test_numbered_lines(spark):
    rows = ["intro", "# Title", "## One", "first", "second", "### Two", "third"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(rows)], "doc string, pos int, line string")
    got = [r["line"] for r in documents.numbered_lines(df, F.lit(3)).orderBy("pos").collect()]
    assert got == ["[ES3.0.1] intro", "# Title", "## [ES3.1] One", "[ES3.1.1] first", "[ES3.1.2] second", "### [ES3.2] Two", "[ES3.2.1] third"]


def test_listed_entries(spark):
    rows = ["Preface", "Adaptation  The process of", "  adjusting.", "", "Climate  Average   weather", "continued", "References", "Zeta  no"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "doc int, pos int, line string")
    got = [(r["term"], r["definition"]) for r in documents.listed_entries(df, "Adaptation", "references").orderBy("pos").collect()]
    assert got == [("Adaptation", "The process of adjusting."), ("Climate", "Average weather continued")]
    assert documents.listed_entries(df, " ", "x").count() == 0


PARAGRAPHS = "doc int, pos int, style string, left_indent_pt double, runs array<struct<text:string,bold:boolean,italic:boolean>>"


def paragraph(pos, text, bold=None, indent=None, style="Normal"):
    return (1, pos, style, indent, [Row(text=text, bold=bold, italic=None)])


def test_bold_entries(spark):
    rows = [paragraph(0, "ignored"), paragraph(1, "Sub first", True, 10.0), paragraph(2, "about it"), paragraph(3, "Main", True), paragraph(4, "See other"), paragraph(5, "Child", True, 5.0), paragraph(6, "of main"), paragraph(7, "MAIN", True), paragraph(8, "a real one"), paragraph(9, "more"), paragraph(10, "Child 2", True, 5.0)]
    got = [(r["term"], r["explanation"], r["parent"]) for r in documents.bold_entries(spark.createDataFrame(rows, PARAGRAPHS)).orderBy("pos").collect()]
    assert got == [("Sub first", "about it", ""), ("MAIN", "a real one more", ""), ("Child", "of main", "Main"), ("Child 2", "", "MAIN")]


def test_sections_of_paragraphs(spark):
    rows = [paragraph(0, "Front"), paragraph(1, "Executive  Summary", style="Top"), paragraph(2, "text"), paragraph(3, "Next", style="top"), paragraph(4, "References", style="Refs"), paragraph(5, "x")]
    df = spark.createDataFrame(rows, PARAGRAPHS).withColumn("text", F.col("runs")[0]["text"])
    assert [r["pos"] for r in documents.summary_section(df, "Top").orderBy("pos").collect()] == [1, 2]
    assert [r["pos"] for r in documents.until_style(df, "refs").orderBy("pos").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize(
    ("runs", "want"),
    [
        ([("plain  text", None, None)], "plain text"),
        ([("bold", True, None), (" rest", None, None)], "**bold** rest"),
        ([("a ", None, True), ("b", None, None)], "*a* b"),
        ([("strong", True, None), (" and ", None, None), ("leaning.", None, True)], "__strong__ and *leaning.*"),
        ([("both", True, True)], "__*both*__"),
        ([("x", True, None), ("-", None, None), ("y", True, None)], "**x-y**"),
        ([("  ", None, None)], ""),
        ([], ""),
        ([("(", None, True), ("leaning", None, True), (") ", None, True), ("x", None, None)], "(*leaning*) x"),
        ([("a", True, None), (" ", None, None), ("b", True, None)], "**a b**"),
        ([("a", True, None), (" . ", None, None), ("b", None, True)], "__a__ . *b*"),
        ([("A", True, True), ("b", True, None), ("c", None, True)], "__*A*b__*c*"),
        ([("one\n two", None, True), ("\tthree", None, None)], "*one two* three"),
        ([("!", None, True), ("word", None, None)], "!word"),
        ([(None, None, None), ("x_", True, None), ("-", None, None)], "**x_-**"),
    ],
)
def test_run_markdown(runs, want):
    assert markup.run_markdown(runs) == want


def test_marked_paragraphs(spark):
    rows = [paragraph(0, "Head", style="H One"), paragraph(1, "Short bold", True), paragraph(2, "plain"), paragraph(3, " ")]
    df = spark.createDataFrame(rows, PARAGRAPHS)
    assert [r["line"] for r in documents.marked_paragraphs(df, {"h one": 1}).orderBy("pos").collect()] == ["# Head", "## **Short bold**", "plain"]


@pytest.mark.parametrize(
    ("style", "level"),
    [
        ("0th level chapter heading", 1), ("1st level heading", 2), ("2nd level heading", 3), ("3rd level heading", 4), ("4th level heading", 5),
        ("My 1ST Level Heading x", 2), ("Heading 9", 6), ("heading0", 1), ("heading\u00a03", 3), ("2nd level heading 4", 4), ("heading 99999999999999999999", 6),
        ("My 3rd level", None), ("5th level heading", None), ("0th level heading", None), ("", None), ("Normal", None),
    ],
)
def test_levels_of_styles(spark, style, level):
    assert one(spark, t.heading_level(F.col("x")), x=style) == level


def test_styled_paragraphs(spark):
    styled = spark.createDataFrame([paragraph(0, "a", style="Heading 9"), paragraph(1, "b", style="My 2nd level heading"), paragraph(2, "c")], PARAGRAPHS)
    assert [r["line"] for r in documents.styled_paragraphs(styled).orderBy("pos").collect()] == ["###### a", "### b", "c"]


def test_pages(spark):
    text = "Total pages: 7\r\n 12 \nThe exam-\nple ends 45  \nby 50\n\n\n\nlast"
    df = spark.createDataFrame([("d", 1, text), ("d", 2, None)], "doc string, page int, text string")
    assert df.select(t.clean_page(F.col("text"))).first()[0] == "The example ends\nby\n\nlast"
    got = documents.page_markdown(df, F.lit("stem")).first()["markdown"]
    assert got == "# stem\n\nThe example ends\nby\n\nlast\n\n_No extractable text on this page._\n"


def one(spark, expression, **values):
    kinds = {str: "string", int: "int", bool: "boolean", type(None): "string"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(expression).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("See Risk (under Hazard (natural)).", "Hazard (natural)"), ("See Risk.", "Risk"), ("See also Risk.", ""), ("Something. See Risk", ""), ("see risk (under x", "risk (under x"), ("", ""), ("See X (under P ).", "P"), ("See X (under P) ..", "P"), ("See X...", "X"), ("See X .", "X"), ("See\u00a0X.", "X")],
)
def test_parents(spark, text, want):
    assert one(spark, t.parent_of(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    ("summary", "want"),
    [("### Potential issues needing substantive review\n- **None identified**.\n### Next\nx", False), ("### Potential issues for substantive review (list)\nTwo meanings", True), ("no section", False), ("a\n### potential issues substantive review\n", True), ("### Potential issues substantive review\n_none identifiedly_", True)],
)
def test_potential_issues(spark, summary, want):
    assert one(spark, t.has_potential_issue(F.col("x")), x=summary) is want


def test_small_functions(spark):
    assert one(spark, t.collapsed(F.col("x")), x=" a  \x1cb\x85c　") == "a b c"
    assert one(spark, t.lines(F.col("x")), x="a\r\nb\x0bc\u2028d\n") == ["a", "b", "c", "d"] and one(spark, t.lines(F.col("x")), x="") == []
    assert one(spark, t.folded(F.col("x")), x="Straße") == "strasse"
    assert one(spark, t.term_anchor(F.col("x")), x="CO₂ (gas)!") == "term-co-gas" and one(spark, t.term_anchor(F.col("x")), x="₂") == "term-item"
    assert one(spark, t.chapter_of(F.col("x")), x="A_CH07_final.docx") == 7
    with pytest.raises(Exception, match="chapter"):
        one(spark, t.chapter_of(F.col("x")), x="none.docx")
    assert one(spark, t.shifted_headings(F.col("x")), x="# a\n### b\n##### c\n#d") == "### a\n##### b\n##### c\n#d"
    assert one(spark, t.text_chunks(F.col("x"), 3), x=" abcdefg ") == ["abc", "def", "g"] and one(spark, t.text_chunks(F.col("x")), x=None) == []
    assert one(spark, t.flag_value(F.col("x"), F.lit("select")), x=True) == '{"select":{"name":"Yes"}}'
    assert one(spark, t.flag_value(F.col("x"), F.lit("other")), x=False) == '{"rich_text":[{"text":{"content":"No"}}]}'
    assert one(spark, t.client_ip(F.col("a"), F.col("b")), a="unknown, 999.1.1.1", b="x, 2001:db8::1, 10.0.0.1") == "2001:db8::1"
    assert one(spark, t.client_ip(F.col("a")), a=None) == "Unavailable"
    assert one(spark, t.json_text(F.col("x")), x='a"é\n') == '"a\\"é\\n"'
    assert one(spark, t.setting(F.col("a"), F.col("b")), a="  ", b=" 'v' ") == "v"
    assert one(spark, t.highlighted(F.col("x"), "risk"), x="Risk & <risk> risks") == "<mark>Risk</mark> &amp; &lt;<mark>risk</mark>&gt; risks"
    assert one(spark, t.occurrence_at(F.split("x", ","), F.col("i")), x="a,b", i="1") == "b"
    assert one(spark, t.occurrence_at(F.split("x", ","), F.col("i")), x="a,b", i="-1") is None and one(spark, t.occurrence_at(F.split("x", ","), F.col("i")), x="a,b", i="q") is None
    stamp = F.to_timestamp(F.lit("2024-07-01 10:00:00"))
    assert one(spark, t.utc_stamp(stamp), x=1) == "2024-07-01T10:00:00Z"
    assert one(spark, t.zoned_stamp(stamp, "Europe/Paris"), x=1) == "2024-07-01T12:00:00.000000+02:00"


def test_markdown():
    assert markup.plain_of("A **bold** [link](u) and `code` &amp; <b>") == "A bold link and code & <b>"
    assert markup.render_markdown("# T\n\n- a\n- b\n\n1. x\n\n> q\n\n---\n```\n<c>\n```") == "<h1>T</h1>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>x</li>\n</ol>\n<blockquote>\n<p>q</p>\n</blockquote>\n<hr />\n<pre><code>&lt;c&gt;\n</code></pre>\n"
    assert "<td>1</td>" in markup.render_markdown("|a|b|\n|-|-|\n|1|2|", tables=True)
    assert markup.plain_of("snake_case_name and 2 * 3 * 4") == "snake_case_name and 2 * 3 * 4"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("- a\n  - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
        ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
        ("3. x\n4. y", '<ol start="3">\n<li>x</li>\n<li>y</li>\n</ol>\n'),
        ("1. x\n   - y\n\nz", "<ol>\n<li>x\n<ul>\n<li>y</li>\n</ul>\n</li>\n</ol>\n<p>z</p>\n"),
        ("- a\nlazy\n\n  second", "<ul>\n<li>\n<p>a\nlazy</p>\n<p>second</p>\n</li>\n</ul>\n"),
        ("- a\n* b", "<ul>\n<li>a</li>\n</ul>\n<ul>\n<li>b</li>\n</ul>\n"),
        ("see [the text][K] and [k]\n\n[k]: /url 'title'", '<p>see <a href="/url" title="title">the text</a> and <a href="/url" title="title">k</a></p>\n'),
        ("[none] and [x](y \"t\")", '<p>[none] and <a href="y" title="t">x</a></p>\n'),
        ("    code <x>\n\n    more", "<pre><code>code &lt;x&gt;\n\nmore\n</code></pre>\n"),
        ("text\n    goes on", "<p>text\ngoes on</p>\n"),
        ("> - a\n> - b", "<blockquote>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n</blockquote>\n"),
        ("in 2020\n2021. was", "<p>in 2020\n2021. was</p>\n"),
    ],
)
def test_blocks(text, want):
    assert markup.render_markdown(text) == want


def test_linker():
    linker = markup.TermLinker({"climate risk": "Climate risk", "climate": "Climate", "risk": "Risk"})
    assert linker.link("Risk & climate risks") == '<a href="#" data-term="Risk">Risk</a> &amp; climate risks'  # the longer match hides the shorter one
    assert linker.terms("risk, CLIMATE RISK, risk") == ["risk", "climate risk"]
    page = linker.link_page('<p>risk <a href="x">risk</a></p>')
    assert page == '<p><a href="#" data-term="Risk">risk</a> <a href="x">risk</a></p>'
    assert markup.anchored_terms(page, {"risk": "term-risk"}.get) == '<p><a class="glossary-link" href="#term-risk">risk</a> <a href="x">risk</a></p>'
    assert markup.link_statements("<p>A1.1 and A1.10, A1.1.</p><code>A1.1</code>", {"a1.1": "s1", "a1.10": "s2"}, markup.BY_ANCHOR) == '<p><a class="statement-link" href="#s1">A1.1</a> and <a class="statement-link" href="#s2">A1.10</a>, A1.1.</p><code>A1.1</code>'
    assert markup.link_statements("x", {}, markup.BY_INDEX) == "x" and markup.TermLinker({}).link("<") == "&lt;"


def test_anchors(spark, lines):
    keys = spark.createDataFrame([("foo",), ("foo!",), ("foo 2",), ("bar",), ("é",), ("ü",)], "term_key string")
    assert {r["term_key"]: r["anchor"] for r in anchors.term_anchors(keys).collect()} == {"foo": "term-foo", "foo 2": "term-foo-2", "foo!": "term-foo-3", "bar": "term-bar", "é": "term-item", "ü": "term-item-2"}
    many = spark.createDataFrame([(chr(0x4E00 + i),) for i in range(4000)] + [("a",), ("a!",), ("a 2",), ("a 2!",), ("a 3",)], "term_key string")
    given = {r["term_key"]: r["anchor"] for r in anchors.term_anchors(many).collect()}
    assert len(set(given.values())) == 4005 and {given[chr(0x4E00 + i)] for i in range(4000)} == {"term-item", *(f"term-item-{i}" for i in range(2, 4001))}
    assert [given[k] for k in ("a", "a 2", "a 2!", "a 3", "a!")] == ["term-a", "term-a-2", "term-a-2-2", "term-a-3", "term-a-4"]
    units = anchors.statement_units(documents.statements(documents.report_lines(lines)))
    twice = units.unionByName(units.withColumn("pos", F.col("pos") + 100))
    marks = anchors.statement_anchors(twice)
    assert sorted(int(r["anchor"].rsplit("-", 1)[1]) for r in marks.collect()) == list(range(1, units.count() + 1))
    shown = anchors.source_attributes(twice, marks)
    assert shown.filter("attributes <> ''").count() == units.count() and shown.filter("attributes <> '' AND pos >= 100").count() == 0
    linked = anchors.linked_statement(units.limit(1).unionByName(units.limit(1).withColumn("statement", F.lit("Z<9"))), marks)
    labels = {r["label"] for r in linked.collect()}
    assert "Z&lt;9" in labels and any('href="#source-statement-1"' in x for x in labels)
    targets = anchors.statement_targets(units.withColumn("anchor", F.concat(F.lit("s"), "pos")), "anchor", ("section_rank", "pos"))
    assert {r["number_key"]: r["anchor"] for r in targets.collect()}["section a"] == "s13"


def test_glossary(spark):
    a = spark.createDataFrame([(0, "Risk ", "one", None, "B"), (1, "RISK", "two", "P", "A"), (2, "", "x", "", "A"), (3, "Risk", "one", "", "B")], "pos long, term string, explanation string, parent string, source string")
    g = glossary.union_glossaries(a, a.select("pos", "term", "explanation", "source"), sources=("A", "B"))
    assert g.count() == 3
    row = glossary.grouped(g).select("term_key", "term", glossary.source_label(F.col("definitions"), ("A", "B")).alias("s"), glossary.parent_label(F.col("definitions")).alias("p"), glossary.definition_of(F.col("definitions"), "C").alias("c")).first()
    assert tuple(row) == ("risk", "RISK", "A + B", "P", "Definition not available")


def test_summaries(spark, sentences, terms):
    g = glossary.grouped(glossary.union_glossaries(spark.createDataFrame([(i, x, f"about {x}", "S") for i, x in enumerate(TERMS)], "pos long, term string, explanation string, source string")))
    found = matching.occurrences(sentences, g.select("term_key", "term"))
    made = {r["term_key"]: r["prompt"] for r in summaries.prompts(g, found, "{term}|{d}\n{statement_sentence_table}", {"d": "S"}).collect()}
    assert made["adaptation"] == "adaptation|about adaptation\nOccurrence count: 2\n\n| Statement | Sentence |\n| --- | --- |\n| A1.1 | Adaptation helps (medium evidence, high agreement) {1.4.2; 1.2, CCB; 1.4.2}. |\n| ES1.1.1 | Adaptation lowers climate risk. |"
    with pytest.raises(ValueError):
        summaries.prompts(g, found, " ", {})
    counts = matching.usage_counts(sentences, terms)
    old = spark.createDataFrame([("risk", "risk", 1, "The term 'risk' is only used once in the provided texts.", "local occurrence notice", ""), ("adaptation", "adaptation", 2, " ", "m", "")], summaries.SUMMARY_SCHEMA)
    routes = {r["term_key"]: r["route"] for r in summaries.routes(g, counts, old).collect()}
    assert routes == {"risk": "skip", "climate risk": "model", "adaptation": "model", "urban area": "local", "confidence": "notice", "co₂": "local"}
    assert {r["term_key"]: r["route"] for r in summaries.routes(g, counts, old, strict_recheck=True).collect()}["risk"] == "model"
    assert "skip" not in {r["route"] for r in summaries.routes(g, counts, old, overwrite=True).collect()}
    asked = spark.createDataFrame([("a", "a", 2, "good"), ("b", "b", 3, "bad")], "term_key string, term string, n long, prompt string")

    def ask(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return " fine "

    got = {r["term_key"]: (r["summary"], r["error"]) for r in summaries.run_model(asked, ask, "m", "now").collect()}
    assert got == {"a": ("fine", None), "b": (None, "RuntimeError: no")}
    done = spark.createDataFrame([("a", "a", 2, "fine", "m", "now")], summaries.SUMMARY_SCHEMA)
    failed = spark.createDataFrame([("b", "b", "no", "now")], summaries.FAILURE_SCHEMA)
    stale = spark.createDataFrame([("a", "a", "old", ""), ("c", "c", "old", "")], summaries.FAILURE_SCHEMA)
    kept, still = summaries.merged(old, stale, done, failed)
    assert {r["term_key"] for r in kept.collect()} == {"risk", "adaptation", "a"} and {r["term_key"] for r in still.collect()} == {"b", "c"}
    assert [r["term_key"] for r in summaries.selected(g, limit=2).collect()] == ["adaptation", "climate risk"] and summaries.selected(g, ("RISK",)).count() == 1
    with pytest.raises(ValueError):
        summaries.selected(g, limit=0)
    assert summaries.outcome(spark.createDataFrame([("a", "model"), ("b", "model"), ("c", "skip")], "term_key string, route string"), failed).first().asDict() == {"completed": 1, "skipped": 1, "failed": 1}
