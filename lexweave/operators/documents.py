"""From texts to lines, sections, statements, sentences and entries.

Every table carries where a row stands (doc, pos, ...), because order has a meaning; what lines inherit from lines above is a running
state (ordinals.running), which long documents are scanned for in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import markup
from lexweave.functions import text as t
from lexweave.operators import ordinals

#: What stands for a page without text. A fixed value.
NO_TEXT = "_No extractable text on this page._"
#: The sections of a report in their order; headings of other names drop what follows them. Fixed values.
SECTIONS = ("Author Team", "Introduction", "Section A", "Section B", "Section C", "Section D")


def text_lines(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, pos, line for each line of each text; a null text has none."""
    return df.select(F.col(doc).alias("doc"), F.posexplode(t.lines(F.col(text))).alias("pos", "line"))


def report_lines(lines: DataFrame, skip: str = "") -> DataFrame:
    """doc, section, section_rank, pos, line: the report lines in their sections, white space collapsed. Lines under unknown
    headings, of the table of contents, and blank ones go; headings of three marks and more are ordinary lines. The section
    named by skip is left out."""
    bare = lines.withColumn("line", t.collapsed(F.col("line"))).filter(F.col("line") != "")
    heading = F.lower(F.trim(F.substr("line", F.lit(4))))
    is_heading = F.col("line").startswith("## ")
    lettered = F.regexp_extract(heading, "^section ([a-d])", 1)
    named = F.when(heading == "introduction", F.lit("Introduction")).when(lettered != "", F.concat(F.lit("Section "), F.upper(lettered))).otherwise(F.lit(""))
    contents = F.lower("line") == "table of contents"
    told = ordinals.running(bare.select("doc", "pos", "line"), last={"section": F.when(is_heading, named), "in_contents": F.when(is_heading, False).when(contents, True)})
    state = told.select(
        "doc", "pos", "line",
        F.coalesce("section", F.lit(SECTIONS[0])).alias("section"),
        F.coalesce("in_contents", F.lit(False)).alias("in_contents"),
        (is_heading | F.col("line").startswith("# ") | contents).alias("marker"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int")
    return state.filter("NOT marker AND NOT in_contents AND section <> ''").filter(F.col("section") != skip).select("doc", "section", rank.alias("section_rank"), "pos", "line")


def report_titles(lines: DataFrame, default: str = "") -> DataFrame:
    """doc, title: the last `# ` heading with a name."""
    bare = lines.withColumn("line", t.collapsed(F.col("line")))
    name = F.when(F.col("line").startswith("# "), F.nullif(F.trim(F.substr("line", F.lit(3))), F.lit("")))
    return bare.groupBy("doc").agg(F.coalesce(F.max_by(name, F.when(name.isNotNull(), F.col("pos"))), F.lit(default)).alias("title"))


def sections_of(lines: DataFrame) -> DataFrame:
    """doc, section, section_rank, n_lines for all sections of all documents, empty ones too."""
    docs = lines.select("doc").distinct()
    labels = docs.select("doc", F.posexplode(F.array(*[F.lit(s) for s in SECTIONS])).alias("rank", "section"))
    counts = report_lines(lines).groupBy("doc", "section").agg(F.count("*").alias("n"))
    return labels.join(counts, ["doc", "section"], "left").select("doc", "section", (F.col("rank") + 1).alias("section_rank"), F.coalesce("n", F.lit(0)).alias("n_lines"))


def statements(report: DataFrame) -> DataFrame:
    """Report lines with the statement they stand for: doc, section_rank, pos, statement, statement_text, whole."""
    return report.select("doc", "section_rank", "pos", t.statement_of(F.col("section"), F.col("line")).alias("s")).select("doc", "section_rank", "pos", "s.*")


def summary_items(lines: DataFrame, render: bool = True) -> DataFrame:
    """Numbered items of executive summaries: doc, pos, statement, statement_text (Markdown), plain. render=False takes the text
    as it is, for summaries without markup."""
    bare = lines.withColumn("line", t.stripped(F.col("line"))).filter(F.col("line").rlike(t.SUMMARY_ITEM))
    made = bare.select("doc", "pos", F.regexp_extract("line", t.SUMMARY_ITEM, 1).alias("statement"), F.regexp_extract("line", t.SUMMARY_ITEM, 2).alias("statement_text"))
    return made.withColumn("plain", markup.markdown_plain(F.col("statement_text")) if render else t.collapsed(F.col("statement_text")))


def sentence_rows(stated: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """doc, origin (0 report, 1 summary), section_rank, pos, sp, statement, sentence, statement_text: the sentences of report
    statements, then of summary items. Figure captions stay whole; blank sentences go."""
    parts = F.when(F.col("whole"), F.array("statement_text")).otherwise(t.sentences(F.col("statement_text")))
    report = stated.select("doc", F.lit(0).alias("origin"), "section_rank", "pos", "statement", "statement_text", F.posexplode(parts).alias("sp", "sentence"))
    if items is not None:
        summary = items.select("doc", F.lit(1).alias("origin"), F.lit(0).alias("section_rank"), "pos", "statement", "statement_text", F.posexplode(t.sentences(F.col("plain"))).alias("sp", "sentence"))
        report = report.unionByName(summary)
    return report.withColumn("sentence", t.stripped(F.col("sentence"))).filter("sentence <> ''").select("doc", "origin", "section_rank", "pos", "sp", "statement", "sentence", "statement_text")


#: The order of sentences in a corpus.
CORPUS_ORDER = ("origin", "section_rank", "doc", "pos", "sp")


def citations(report: DataFrame) -> DataFrame:
    """doc, section_rank, pos, ref_pos, statement, reference: the numeric references that numbered statements cite in braces,
    distinct within a line."""
    numbered = report.withColumn("statement", F.regexp_extract("line", t.NUMBERED, 1)).filter("statement <> ''")
    return numbered.select("doc", "section_rank", "pos", "statement", F.posexplode(t.references(F.regexp_extract("line", t.NUMBERED, 2))).alias("ref_pos", "reference"))


def take_section(paragraphs: DataFrame, starts: Column, stops: Column) -> DataFrame:
    """The paragraphs of each document from its first start up to the next stop. Documents without a start have none."""
    # the last stop so far lies behind the first start wherever any stop does
    told = ordinals.running(paragraphs, first={"__start": F.when(starts, F.col("pos"))}, last={"__stop": F.when(stops, F.col("pos"))})
    return told.filter("__start IS NOT NULL AND (__stop IS NULL OR __stop <= __start)").drop("__start", "__stop")


def summary_section(paragraphs: DataFrame, first_style: str, name: str = "executive summary") -> DataFrame:
    """The summary of each document: from the first heading of the first level and that name to the next such heading."""
    level = F.lower(F.trim("style")) == first_style.lower()
    return take_section(paragraphs, level & (t.folded(t.collapsed(F.col("text"))) == name), level)


def until_style(paragraphs: DataFrame, style: str) -> DataFrame:
    """Each document's paragraphs before the first of a style."""
    stop = F.when(F.lower(F.trim("style")) == style.lower(), True)
    return ordinals.running(paragraphs, last={"__stop": stop}).filter("__stop IS NULL").drop("__stop")


def numbered_lines(lines: DataFrame, chapter: Column) -> DataFrame:
    """Summary lines with identifiers: headings but the first level count sections, other lines count paragraphs within one;
    what stands before the first heading belongs to section 0."""
    heading = r"^(#{1,6})" + t.WS + r"+(.*)$"
    mark = F.regexp_extract("line", heading, 1)
    kind = F.when(mark == "#", F.lit("title")).when(mark != "", F.lit("heading")).otherwise(F.lit("text"))
    one = lines.withColumns({"kind": kind, "chapter": chapter})
    two = ordinals.running(one, total={"section": F.when(F.col("kind") == "heading", 1), "texts": F.when(F.col("kind") == "text", 1)}).fillna(0, ["section", "texts"])
    three = ordinals.running(two, last={"above": F.when(F.col("kind") == "heading", F.col("texts"))}).withColumn("paragraph", F.col("texts") - F.coalesce("above", F.lit(0)))
    told = (
        F.when(F.col("kind") == "title", F.col("line"))
        .when(F.col("kind") == "heading", F.format_string("%s [ES%d.%d] %s", mark, "chapter", "section", F.regexp_extract("line", heading, 2)))
        .otherwise(F.format_string("[ES%d.%d.%d] %s", "chapter", "section", "paragraph", "line"))
    )
    return three.select("doc", "pos", "kind", F.col("section").cast("long").alias("section"), F.col("paragraph").cast("long").alias("paragraph"), told.alias("line"))


def listed_entries(lines: DataFrame, start_term: str, stop_prefix: str) -> DataFrame:
    """doc, pos, term, definition from glossary lines `term  definition` (two blanks between) and their continuations, between
    the line that begins with start_term and the one that begins with stop_prefix (in any case; empty never stops)."""
    entry = r"^(\S.*?\S)" + t.WS + r"{2,}(\S.*)$"
    start, stop = " ".join(start_term.split()), stop_prefix.strip().lower()
    if not start:
        return lines.select("doc", "pos", F.lit("").alias("term"), F.lit("").alias("definition")).filter(F.lit(False))
    bare = lines.withColumn("line", t.stripped(F.col("line")))
    term = F.regexp_extract("line", entry, 1)
    begins = F.when(t.collapsed(F.col("line")).startswith(start), F.col("pos"))
    stops = F.when(F.lower("line").startswith(stop), F.col("pos")) if stop else F.lit(None).cast("int")
    told = ordinals.running(bare.filter("line <> ''"), first={"a": begins}, last={"z": stops}, total={"n": F.when(term != "", 1)})
    island = told.filter("a IS NOT NULL AND (z IS NULL OR z < a) AND n > 0").withColumns({"term": term, "rest": F.when(term != "", F.regexp_extract("line", entry, 2)).otherwise(F.col("line"))})
    parts = F.array_sort(F.collect_list(F.struct("pos", "rest")))
    return island.groupBy("doc", "n").agg(F.min("pos").alias("pos"), F.max("term").alias("term"), t.collapsed(F.array_join(F.transform(parts, lambda p: p["rest"]), " ")).alias("definition")).filter("term <> ''").select("doc", "pos", "term", "definition")  # lines that go on an entry above the island have no term in it


def bold_entries(paragraphs: DataFrame) -> DataFrame:
    """doc, pos, term, explanation, parent from paragraphs (doc, pos, left_indent_pt, runs): a wholly bold paragraph is a term,
    others explain the last one. An indented term hangs under the last term without a parent; one that has none to hang under
    becomes such a term. Of entries of one term the first stays, unless it only says `see ...` and a later one does not."""
    runs = F.filter("runs", lambda r: t.collapsed(r["text"]) != "")
    text = t.collapsed(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    rows = paragraphs.select("doc", "pos", text.alias("text"), ((F.size(runs) > 0) & F.forall(runs, lambda r: F.coalesce(r["bold"], F.lit(False)))).alias("is_term"), (F.coalesce("left_indent_pt", F.lit(0.0)) > 0).alias("is_sub")).filter("text <> ''")
    is_term, is_sub = F.col("is_term"), F.col("is_sub")
    # an indented term without any term before it has no parent and is a main term itself
    told = ordinals.running(rows, last={"main": F.when(is_term & ~is_sub, F.col("text"))}, first={"head": F.when(is_term, F.col("text"))}, total={"above": F.when(is_term, 1)}, before=True)
    rows = told.withColumns({"parent": F.when(is_term & is_sub, F.coalesce("main", "head")), "n": F.coalesce("above", F.lit(0)) + is_term.cast("int")}).filter("n > 0")
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_term"), F.struct("pos", "text"))))
    entries = rows.groupBy("doc", "n").agg(F.min("pos").alias("pos"), F.max(F.when(F.col("is_term"), F.col("text"))).alias("term"), t.collapsed(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("explanation"), F.coalesce(F.max("parent"), F.lit("")).alias("parent"))
    of_key = Window.partitionBy("doc", t.folded(F.col("term")))
    see = t.folded(F.col("explanation")).startswith("see ")
    chosen = entries.withColumns({"r": F.row_number().over(of_key.orderBy(see.cast("int"), "pos")), "place": F.min("pos").over(of_key)})
    return chosen.filter("r = 1").select("doc", F.col("place").alias("pos"), "term", "explanation", "parent")


def marked_paragraphs(paragraphs: DataFrame, levels: dict[str, int]) -> DataFrame:
    """doc, pos, line: paragraphs (style, runs) as Markdown; levels maps styles to heading levels, and a short wholly bold
    paragraph is a heading of level 2. Blank paragraphs go."""
    text = t.collapsed(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    runs = F.filter("runs", lambda r: t.collapsed(r["text"]) != "")
    bold = (F.length(text).between(1, 100)) & (F.size(runs) > 0) & F.forall(runs, lambda r: F.coalesce(r["bold"], F.lit(False)))
    style = F.lower(F.trim("style"))
    level = F.coalesce(*[F.when(style == k.lower(), F.lit(v)) for k, v in levels.items()], F.when(bold, F.lit(2)))
    return paragraphs.filter(text != "").select("doc", "pos", t.marked_heading(markup.runs_markdown(F.col("runs")), level).alias("line"))


def styled_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """doc, pos, line: plain paragraphs with heading marks by the name of their style."""
    text = t.collapsed(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    return paragraphs.filter(text != "").select("doc", "pos", t.marked_heading(text, t.heading_level(F.col("style"))).alias("line"))


def page_markdown(pages: DataFrame, title: Column, headers: bool = False) -> DataFrame:
    """doc, markdown from extracted pages (doc, page, text)."""
    body = F.coalesce(F.nullif(t.clean_page(F.coalesce("text", F.lit(""))), F.lit("")), F.lit(NO_TEXT))
    part = F.concat(F.format_string("\n## Page %d\n\n\n", "page"), body) if headers else body
    parts = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return pages.groupBy("doc").agg(F.concat(t.stripped(F.concat(F.lit("# "), F.first(title), F.lit("\n\n"), F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n"))), F.lit("\n")).alias("markdown"))
