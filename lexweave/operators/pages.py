"""The exported page of a corpus: reports, executive summaries and the glossary with its evidence, linked with each other.

The page is a table of fragments in the order of ORDER: a line of a report, a block of a summary, a row of a term's evidence and what
stands round them are a row each, so that neither a section nor a term's evidence is ever one value. Terms link to the glossary's entries,
statements in evidence and summaries to their first rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import markup
from lexweave.functions import text as t
from lexweave.operators import anchors, glossary, summaries
from lexweave.operators.documents import CORPUS_ORDER, SECTIONS

#: What stands where there is nothing to show.
NO_LINES, NO_SUMMARY, NO_USE = "No content parsed for this section.", "No precomputed summary is available for this term.", "No usage found in the texts."
EXCLUDED = ("confidence",)
#: The headings of the page's parts, and what stands under that of the glossary before its entries.
PARTS = ("Report", "Executive summaries", "Glossary")
SEARCH = '<p><label for="glossary-search">Find a term <input id="glossary-search" type="search"></label></p>'
#: The order of the page: part, step (its head, its index and that one's end, what it holds, its end), document or place, term, section, stage (begin, rows,
#: end), and the order of rows.
ORDER = ("part", "step", "a", "b", "rank", "stage", *CORPUS_ORDER)
HEAD, INDEX, INDEXED, BODY, END = 0, 1, 2, 3, 4


def _joined(rows: DataFrame, keys: list[str], order: list[str], html: str = "html") -> DataFrame:
    """html of each group of keys, its fragments in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(html).alias("html"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["html"]), "\n").alias("html"))


def _name(doc: Column) -> Column:
    """A document's name: of a path its last part."""
    return F.regexp_extract(doc.cast("string"), "([^/]*)$", 1)


def _element(tag: str, attributes: Column, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}"), attributes, F.lit(">"), body, F.lit(f"</{tag}>"))


def summary_blocks(texts: DataFrame) -> DataFrame:
    """doc, pos, block, statement, statement_text: the blocks of executive summaries (doc, text), headings two levels down. A
    numbered item of one line names its statement; one of several lines has none (null)."""
    blocks = texts.select("doc", F.posexplode(F.split(t.shifted_headings(F.col("text")), f"\n{t.WS}*\n")).alias("pos", "block")).filter(t.stripped(F.col("block")) != "")
    bare = t.stripped(F.col("block"))
    single = (F.size(t.lines(bare)) == 1) & bare.rlike(t.SUMMARY_ITEM)
    return blocks.withColumns({"statement": F.when(single, F.regexp_extract(bare, t.SUMMARY_ITEM, 1)), "statement_text": F.when(single, F.regexp_extract(bare, t.SUMMARY_ITEM, 2))})


def rendered_units(report: DataFrame, stated: DataFrame, blocks: DataFrame | None, marks: DataFrame) -> DataFrame:
    """doc, origin, section_rank, pos, attributes of report lines and summary blocks; the first rendering of a statement has its id.
    marks: anchors of the corpus by (page, number_key, text_key)."""
    units = anchors.statement_units(stated)
    if blocks is not None:
        told = blocks.filter("statement IS NOT NULL")
        units = units.unionByName(told.select("doc", F.lit(1).alias("origin"), F.lit(0).alias("section_rank"), "pos", "statement", "statement_text"))
    return anchors.source_attributes(units, marks, ()).select("doc", "origin", "section_rank", "pos", "attributes")


def _placed(rows: DataFrame, text: Column, part: int, step: int, a: Column | None = None, b: Column | None = None, rank: Column | None = None, stage: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """rows as fragments: their place, and text as a line of the page."""
    at = [F.lit(part).alias("part"), F.lit(step).alias("step"), (F.lit("") if a is None else a.cast("string")).alias("a"), (F.lit("") if b is None else b).alias("b"), (F.lit(0) if rank is None else rank).alias("rank"), F.lit(stage).alias("stage")]
    return rows.select(*at, *order, F.concat(text, F.lit("\n")).alias("text"))


def _together(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def _link(anchor: Column, name: Column) -> Column:
    return F.concat(F.lit('<a href="#'), anchor, F.lit('">'), t.escaped(name), F.lit("</a>"))


def report_rows(report: DataFrame, units: DataFrame, labels: markup.Labels, entries: markup.Labels) -> DataFrame:
    """doc, section_rank, pos, html: the lines of reports as elements; first-level statements are headings."""
    held = report.join(units.filter("origin = 0").drop("origin"), ["doc", "section_rank", "pos"], "left")
    linked = markup.anchored(markup.linked_terms(F.col("line"), labels), entries)
    tag = F.when(F.col("line").rlike(t.FIRST_LEVEL), "h4").otherwise("p")
    return held.select("doc", "section_rank", "pos", F.concat(F.lit("<"), tag, F.coalesce("attributes", F.lit("")), F.lit(">"), linked, F.lit("</"), tag, F.lit(">")).alias("html"))


def _sections(report: DataFrame) -> DataFrame:
    """doc, section, section_rank, anchor of all sections of each report."""
    anchor = t.heading_anchor("report", F.concat_ws(" ", _name(F.col("doc")), "section"))
    every = report.select("doc").distinct().select("doc", F.posexplode(F.array(*[F.lit(s) for s in SECTIONS])).alias("at", "section"))
    return every.select("doc", "section", (F.col("at") + 1).alias("section_rank"), anchor.alias("anchor"))


def _opened(anchor: Column, name: Column) -> Column:
    return F.concat(F.lit('<section id="'), anchor, F.lit('">\n<h3>'), name, F.lit("</h3>"))


def report_part(report: DataFrame, units: DataFrame, labels: markup.Labels, entries: markup.Labels) -> DataFrame:
    """doc, html: each report as one text, for reports that are small enough: all its sections, empty ones with a notice."""
    filled = _joined(report_rows(report, units, labels, entries), ["doc", "section_rank"], ["pos"])
    body = F.coalesce("html", F.lit(f"<p>{NO_LINES}</p>"))
    sections = _sections(report).join(filled, ["doc", "section_rank"], "left").withColumn("html", F.concat(_opened(F.col("anchor"), F.col("section")), F.lit("\n"), body, F.lit("\n</section>")))
    return _joined(sections, ["doc"], ["section_rank"])


def report_fragments(report: DataFrame, units: DataFrame, labels: markup.Labels, entries: markup.Labels) -> DataFrame:
    """The reports in pieces, after an index of their sections."""
    every, doc, rank = _sections(report), F.col("doc"), F.col("section_rank")
    empty = every.join(report.select("doc", "section_rank").distinct(), ["doc", "section_rank"], "left_anti")
    return _together(
        _placed(every, _link(F.col("anchor"), F.concat_ws(" ", _name(doc), "section")), 0, INDEX, doc, rank=rank, stage=1),
        _placed(every, _opened(F.col("anchor"), F.col("section")), 0, BODY, doc, rank=rank),
        _placed(empty, F.lit(f"<p>{NO_LINES}</p>"), 0, BODY, doc, rank=rank, stage=1),
        _placed(report_rows(report, units, labels, entries), F.col("html"), 0, BODY, doc, rank=rank, stage=1, order=("pos",)),
        _placed(every, F.lit("</section>"), 0, BODY, doc, rank=rank, stage=2),
    )


def summary_fragments(blocks: DataFrame, units: DataFrame, labels: markup.Labels, entries: markup.Labels) -> DataFrame:
    """The executive summaries in pieces, block by block, after an index of them."""
    held = blocks.join(units.filter("origin = 1").select("doc", "pos", "attributes"), ["doc", "pos"], "left")
    linked = markup.anchored(markup.linked_terms_html(markup.markdown_html(F.col("block")), labels), entries)
    shown = F.when(F.coalesce("attributes", F.lit("")) != "", _element("div", F.col("attributes"), linked)).otherwise(linked)
    doc = F.col("doc")
    chapters = blocks.select("doc").distinct().withColumn("anchor", t.heading_anchor("summary", _name(doc)))
    return _together(
        _placed(chapters, _link(F.col("anchor"), _name(doc)), 1, INDEX, doc, stage=1),
        _placed(chapters, _opened(F.col("anchor"), t.escaped(_name(doc))), 1, BODY, doc),
        _placed(held, shown, 1, BODY, doc, stage=1, order=("pos",)),
        _placed(chapters, F.lit("</section>"), 1, BODY, doc, stage=2),
    )


def evidence_rows(occurrences: DataFrame, marks: DataFrame) -> DataFrame:
    """term_key, the corpus order, number, target (an anchor or null) and html of each sentence that a term is used in."""
    linked = anchors.linked_statement(occurrences, marks, ())
    row = F.concat(F.lit("<tr><td>"), "label", F.lit("</td><td>"), t.highlighted_by(F.col("sentence"), F.col("term")), F.lit("</td></tr>"))
    target = F.nullif(F.regexp_extract("label", 'href="#([^"]*)"', 1), F.lit(""))
    return linked.select("term_key", *CORPUS_ORDER, t.folded(t.collapsed(F.col("statement"))).alias("number"), target.alias("target"), row.alias("html"))


def linked_summaries(stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """term_key, summary, rendered: summaries as HTML, their statements linked to where a term's evidence stands last. Of a term's
    statements only those that its summary may name are gathered, so the map of a row is bounded by its text."""
    shown = stored.select("term_key", "summary").filter(t.stripped(F.col("summary")) != "").withColumn("page", markup.markdown_html(F.col("summary"), tables=True))
    bare = lambda c: F.regexp_replace(F.lower(c), t.WS + "+", "")
    named = evidence.filter("target IS NOT NULL").join(shown.select("term_key", bare(F.col("page")).alias("bare")), "term_key")
    named = named.filter(F.col("number").rlike("[&<>\"']") | F.contains(F.col("bare"), bare(F.col("number"))))
    last = named.groupBy("term_key", "number").agg(F.max_by("target", F.struct(*CORPUS_ORDER)).alias("target"))
    targets = last.groupBy("term_key").agg(F.map_from_entries(F.collect_list(F.struct("number", "target"))).alias("targets"))
    return shown.join(targets, "term_key", "left").select("term_key", "summary", markup.linked_statements_by(F.col("page"), F.col("targets")).alias("rendered"))


def glossary_fragments(terms: DataFrame, usage: DataFrame, stored: DataFrame, evidence: DataFrame, entries: DataFrame, order: tuple[str, ...] = (), excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """The glossary in pieces: an entry for each term (from glossary.grouped) by its folded form, with its definitions, its summary
    with linked statements, and its evidence, each row a piece. usage: term_key, n; stored: term_key, summary; evidence: as of
    evidence_rows; entries: term_key, anchor."""
    counts = evidence.groupBy("term_key").agg(F.count("*").alias("c"))
    held = terms.join(usage.select("term_key", F.col("n").alias("used")), "term_key", "left").join(linked_summaries(stored, evidence), "term_key", "left").join(counts, "term_key", "left").join(entries, "term_key")
    out = F.col("term_key").isin(*excluded)
    said = F.coalesce("summary", F.lit(""))
    issue = F.when(~out & t.has_potential_issue(said), F.lit('<span class="issue" title="Potential issue needing substantive review">!</span>')).otherwise(F.lit(""))
    parent = glossary.parent_label(F.col("definitions"))
    definitions = F.array_join(F.transform("definitions", lambda d: F.concat(F.lit("<section><h4>Explanation in "), t.escaped(d["source"]), F.lit("</h4><p>"), t.escaped(d["explanation"]), F.lit("</p></section>"))), "\n")
    summary = F.when(out, _element("p", F.lit(""), t.escaped(summaries.not_applied(F.col("term"))))).otherwise(F.coalesce("rendered", F.lit(f"<p>{NO_SUMMARY}</p>")))
    n = F.coalesce("c", F.lit(0))
    begun = F.when(n == 0, F.lit(f"<p>{NO_USE}</p>")).otherwise(F.lit("<table><thead><tr><th>Statement</th><th>Sentence</th></tr></thead>\n<tbody>"))
    article = F.concat(
        F.lit('<article id="'), t.escaped(F.col("anchor")), F.lit('" data-search="'), t.escaped(F.col("term_key")), F.lit('">\n<h3>'), t.escaped(F.col("term")), F.lit("</h3> <span>["), F.coalesce("used", F.lit(0)).cast("string"), F.lit("]</span> <span>["), t.escaped(glossary.source_label(F.col("definitions"), order)), F.lit("]</span>"), issue,
        F.when(parent != "", F.concat(F.lit("\n<p>Parent: "), t.escaped(parent), F.lit("</p>"))).otherwise(F.lit("")), F.lit("\n"), definitions,
        F.lit("\n<details><summary>Summary</summary>"), summary, F.lit("</details>\n<details><summary>Evidence ("), n.cast("string"), F.lit(")</summary>"), begun,
    )
    place, key = t.folded(F.col("term")), F.col("term_key")
    rows = evidence.select("term_key", *CORPUS_ORDER, "html").join(terms.join(entries, "term_key", "left_semi").select("term_key", place.alias("place")), "term_key")
    closed = F.concat(F.when(n > 0, F.lit("</tbody></table>")).otherwise(F.lit("")), F.lit("</details>\n</article>"))
    return _together(
        _placed(held, article, 2, BODY, place, key),
        _placed(rows, F.col("html"), 2, BODY, F.col("place"), key, stage=1, order=CORPUS_ORDER),
        _placed(held, closed, 2, BODY, place, key, stage=2),
    )


def page_fragments(report: DataFrame, chapters: DataFrame | None, entries: DataFrame, share: DataFrame, title: str) -> DataFrame:
    """The whole page in the columns of ORDER and text: the parts in order under their headings, with a list of them. share: as of
    glossary.used_share."""
    told = markup.html.escape(title)
    nav = "\n".join(f'<a href="#part-{i}">{n}</a>' for i, n in enumerate(PARTS))
    opened = [f'<section id="part-{i}">\n<h2>{n}</h2>' for i, n in enumerate(PARTS)]
    top = f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{told}</title></head>\n<body>\n<header><h1>{told}</h1>\n<nav>\n{nav}\n</nav></header>\n<main>\n'
    frame = [(0, HEAD, 0, top + opened[0]), (1, HEAD, 0, opened[1]), (2, HEAD, 0, opened[2])]
    frame += [row for i in (0, 1) for row in ((i, INDEX, 0, "<nav>"), (i, INDEXED, 0, "</nav>"), (i, END, 0, "</section>"))]
    frame += [(2, END, 0, "</section>\n</main>\n</body></html>")]
    fixed = share.sparkSession.createDataFrame(frame, "part int, step int, stage int, line string").select("part", "step", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).alias("rank"), "stage", F.concat("line", F.lit("\n")).alias("text"))
    used = F.concat(F.lit("<p>"), F.col("used").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" glossary terms occur in the texts.</p>\n" + SEARCH))
    return _together(entries, report, *([] if chapters is None else [chapters]), fixed, _placed(share, used, 2, HEAD, stage=1)).select(*ORDER, "text")
