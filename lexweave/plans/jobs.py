"""Whole jobs from files to files: converters, the term network, term summaries, the HTML report.

Each names its inputs and outputs by paths that Spark can read, and stops with an error where an input is missing or empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators import anchors, documents, glossary, matching, network, pages, summaries
from lexweave.sources import archives, fragments, pdf, readers, store, writers


#: The columns that a corpus needs of its workbooks, and those it can do without.
WORKBOOK = (("term", "explanation", "source"), ("parent",))


class UnknownTerms(ValueError):
    """Terms were asked for that the glossary does not have."""


def required(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row."""
    if not df.take(1):
        raise ValueError(f"there is no {what}")
    return df


def convert_documents(spark: SparkSession, source: str, target: str) -> int:
    """Documents to Markdown by the names of their styles; gives the number of paragraphs."""
    lines = documents.styled_paragraphs(required(readers.read_docx(spark, source), f"document in {source}"))
    writers.write_per_document(writers.markdown_texts(lines), target)
    return lines.count()


def read_pages(spark: SparkSession, source: str) -> DataFrame:
    """doc, page, text of a folder's PDF files, and of its files of extracted text, whose pages end with a form feed."""
    paths = required(spark.read.format("binaryFile").load(source).select("path"), f"file in {source}")
    is_pdf = F.lower("path").endswith(".pdf")
    pages = pdf.page_texts(pdf.page_ranges(paths.filter(is_pdf))).select(F.col("path").alias("doc"), "page", "text")
    texts = spark.read.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~is_pdf)
    told = texts.select(F.col("path").alias("doc"), F.posexplode(F.split(F.regexp_replace("text", "\f\\z", ""), "\f")).alias("page", "text"))
    whole = pages.unionByName(told.withColumn("page", F.col("page") + 1))
    return whole.withColumn("doc", F.regexp_extract("doc", r"([^/]*?)(?:\.[^./]*)?$", 1))


def build_archive(spark: SparkSession, sources: list[str], target: str, key: str | None = None, root: str | None = None) -> int:
    """One ZIP file of the named files, sealed if there is a key, and checked against them byte for byte after it is written. Its
    members have the files' names, or their paths below root. A missing file, one outside root or two of one name are errors."""
    below = None if root is None else spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    place = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    name = F.regexp_extract("path", "([^/]*)$", 1) if below is None else F.when(F.startswith(place, F.lit(below)), F.substring(place, F.lit(len(below) + 1), F.length("path")))
    found = {s: store.listed(spark, s) for s in sources}
    if lost := sorted({s.rstrip("/").rsplit("/", 1)[-1] for s, paths in found.items() if not paths}):
        raise ValueError("missing files: " + ", ".join(lost))
    paths = dict.fromkeys(p for some in found.values() for p in some)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").select("path", name.alias("name"))
    if outside := listed.filter("name IS NULL").take(1):
        raise ValueError(f"{outside[0]['path']} is outside {root}")
    if twice := listed.groupBy("name").count().filter("count > 1").take(1):
        raise ValueError(f"two files are called {twice[0]['name']}")
    wanted = archives.file_digests(listed)
    if key is None:
        n = archives.write_archive(listed, target)
        there = archives.member_digests(spark.createDataFrame([(p,) for p in store.listed(spark, target)], "path string"))
    else:  # a sealed file is one token by its format, so it has to fit the driver
        held = {}
        for r in listed.orderBy("name").collect():
            with store.opened(r["path"]) as file:
                held[r["name"]] = file.read()
        n = len(held)
        writers.write_file(spark, target, writers.sealed_bytes(spark, writers.archive_bytes(held), key))
        there = readers.read_archive(spark, target, "*", key).select("name", F.sha2("content", 256).alias("digest"))
    wrong = wanted.exceptAll(there).union(there.exceptAll(wanted)).take(1)
    if wrong:
        raise ValueError(f"the archive does not hold {wrong[0]['name']} as it is")
    return n


def unpack_archive(spark: SparkSession, source: str, target: str, key: str | None = None) -> int:
    """The members of one archive as files below target; a member whose name leads out of it is an error."""
    n = 0
    for r in readers.read_archive(spark, source, "*", key).toLocalIterator():
        if r["name"].startswith("/") or ".." in r["name"].split("/"):
            raise ValueError(f"{r['name']} is no name below a folder")
        writers.write_file(spark, f"{target.rstrip('/')}/{r['name']}", bytes(r["content"]))
        n += 1
    return n


def convert_pages(pages: DataFrame, target: str, headers: bool = False) -> None:
    """Extracted pages (doc, page, text) to Markdown."""
    writers.write_per_document(documents.page_markdown(required(pages, "page"), F.col("doc"), headers), target)


def extract_summaries(spark: SparkSession, source: str, target: str, levels: dict[str, int]) -> int:
    """The executive summaries of chapter documents, numbered, as Markdown; a document without one is an error. levels maps
    styles to heading levels; that of level 1 begins and ends the summary."""
    # running states read their rows twice: what Python makes is stored first
    rows = required(store.stored(readers.read_docx(spark, source), "paragraphs"), f"document in {source}")
    rows = rows.withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    top = next(k for k, v in levels.items() if v == 1)
    found = documents.summary_section(rows, top)
    lost = rows.select("doc").distinct().join(found.select("doc").distinct(), "doc", "left_anti").take(1)
    if lost:
        raise ValueError(f"{lost[0]['doc']} has no executive summary")
    lines = documents.numbered_lines(store.stored(documents.marked_paragraphs(found, levels), "marked"), t.chapter_of(F.col("doc")))
    writers.write_per_document(writers.markdown_texts(lines), target)
    return lines.select("doc").distinct().count()


def glossary_from_document(spark: SparkSession, source: str, target: str, stop_style: str, name: str) -> int:
    """A glossary document of bold terms as a workbook."""
    entries = documents.bold_entries(documents.until_style(store.stored(readers.read_docx(spark, source), "paragraphs"), stop_style)).withColumn("source", F.lit(name))
    return writers.write_glossary_workbook(entries, target, {"term": "Term", "explanation": "Explanation", "parent": "Parent", "source": "Source"}, ("doc", "pos"))


def glossary_from_lines(spark: SparkSession, source: str, target: str, start_term: str, stop_prefix: str) -> int:
    """A glossary text of `term  definition` lines as a workbook."""
    entries = documents.listed_entries(documents.text_lines(readers.read_texts(spark, source), "doc"), start_term, stop_prefix)
    return writers.write_glossary_workbook(entries, target, {"term": "Term", "definition": "Explanation"}, ("doc", "pos"))


def glossary_with_parents(spark: SparkSession, source: str, target: str, name: str) -> int:
    """A two-column glossary workbook as one with parents, taken from its see-references, and a source."""
    rows = readers.read_workbook(spark, source).withColumns({"parent": t.parent_of(F.col("explanation")), "source": F.lit(name)})
    return writers.write_glossary_workbook(rows, target, {"term": "Term", "explanation": "Explanation", "parent": "Parent", "source": "Source"}, ("doc", "pos"))


@dataclass(frozen=True)
class Members:
    """The names under which an archive holds a corpus. The stored summaries may be missing, all else must be there."""

    reports: tuple[str, ...]
    executive: tuple[str, ...]
    workbooks: tuple[str, ...]
    network: str
    prompt: str
    summaries: str


class Corpus:
    """Reports, executive summaries and a glossary, read once and held for all that asks of them."""

    def __init__(self, spark: SparkSession, reports: str, executive: str | None, workbooks: str, sources: tuple[str, ...] = ()):
        texts = required(readers.read_texts(spark, reports), f"report in {reports}")
        self._hold(texts, None if executive is None else readers.read_texts(spark, executive), readers.read_workbook(spark, workbooks, *WORKBOOK), sources)

    def _hold(self, reports: DataFrame, executive: DataFrame | None, rows: DataFrame, sources: tuple[str, ...]) -> None:
        self.spark = reports.sparkSession
        self.lines = documents.text_lines(reports, "doc")
        self.report = documents.report_lines(self.lines).persist()
        self.stated = documents.statements(self.report)
        self.summaries = executive
        self.items = None if executive is None else documents.summary_items(documents.text_lines(executive, "doc"))
        self.sentences = documents.sentence_rows(self.stated, self.items).persist()
        self.glossary = glossary.union_glossaries(rows.withColumn("pos", F.struct("doc", "pos")), sources=sources)
        self.terms = glossary.grouped(self.glossary).persist()
        self.usage = matching.usage_counts(self.sentences, self.terms).persist()
        self.sources = sources

    def overview(self, stored: DataFrame, search: str = "") -> DataFrame:
        return glossary.overview(self.terms, self.usage, stored, search, self.sources)

    def details(self, term: str) -> DataFrame:
        """The sentences with one term, in corpus order."""
        wanted = self.terms.filter(F.col("term_key") == term.lower().replace("ß", "ss"))
        return matching.occurrences(self.sentences, wanted).orderBy(*documents.CORPUS_ORDER).select("statement", "sentence", "statement_text")

    def citations(self) -> DataFrame:
        return documents.citations(self.report)

    def close(self) -> None:
        for df in (self.report, self.sentences, self.terms, self.usage):
            df.unpersist()


@dataclass(frozen=True)
class Assets:
    """What an archive holds: a corpus, the network's nodes and edges, the prompt's template, and term_key, summary."""

    corpus: Corpus
    nodes: DataFrame
    edges: DataFrame
    prompt: str
    summaries: DataFrame
    members: DataFrame

    def close(self) -> None:
        self.corpus.close()
        self.members.unpersist()


def load_assets(spark: SparkSession, source: str, members: Members, key: str | None = None, sources: tuple[str, ...] = ()) -> Assets:
    """All that one archive, sealed if there is a key, holds of a corpus. A member that is missing is an error, but for the stored
    summaries: without them there are none."""
    held = readers.read_archive(spark, source, "*", key).persist()
    there = {r["name"] for r in held.select("name").collect()}
    wanted = (*members.reports, *members.executive, *members.workbooks, members.network, members.prompt)
    if lost := sorted(set(wanted) - there):
        held.unpersist()
        raise ValueError("the archive lacks " + ", ".join(lost))

    def texts(*names: str) -> DataFrame:
        return readers.member_texts(held, names)

    corpus = Corpus.__new__(Corpus)
    books = held.filter(F.col("name").isin(*members.workbooks)).select(F.col("name").alias("path"), "content")
    corpus._hold(texts(*members.reports), texts(*members.executive) if members.executive else None, readers.workbook_rows(books, *WORKBOOK), sources)
    nodes, edges = network.parse_cypher(texts(members.network).select(F.explode(F.split("text", "\\R")).alias("value")))
    stored = spark.createDataFrame([], "term_key string, summary string")
    if members.summaries in there:
        stored = readers.stored_summaries(texts(members.summaries).select(F.col("text").alias("value")))
    return Assets(corpus, nodes, edges, texts(members.prompt).first()["text"], stored, held)


def write_network(corpus: Corpus, target: str) -> None:
    """The network as part files in order. An edge's evidence is never one row: its line is written piece by piece."""
    pairs = store.stored(network.term_pairs(corpus.sentences, corpus.usage.filter("n > 0")), "pairs")
    rows = network.cypher_fragments(network.nodes(corpus.terms, corpus.usage), pairs)
    fragments.write_fragments(rows, target, ("kind", "a", "b"), ("part", "at", "key"))


def generate_summaries(corpus: Corpus, artifact: str, template: str, placeholders: dict[str, str], ask: Callable[[str], str], model: str, stamp: str, only: tuple[str, ...] = (), limit: int | None = None, overwrite: bool = False, pause: float = 0.0) -> dict[str, int]:
    """Brings a summary artifact up to date and gives how many terms were completed, skipped and failed.

    Records of terms that are gone are dropped, what is there is kept unless overwrite, terms in repeated use go to ask, and
    failures are recorded with their terms. Every answer is kept beside the artifact the moment it is given, so a run that is
    stopped, or a lost executor, costs no answer: the next run finds it there. At the end the artifact is replaced whole and
    the kept answers go."""
    spark = corpus.spark
    old, lost, created = readers.artifact_or_new(spark, artifact, model, stamp)
    if only and (unknown := summaries.unknown_terms(spark.createDataFrame([(x,) for x in only], "term string"), corpus.terms.select("term_key")).collect()):
        raise UnknownTerms("unknown terms: " + ", ".join(sorted(r["term_key"] for r in unknown)))
    old, lost = summaries.current(old, corpus.terms).persist(), summaries.current(lost, corpus.terms).persist()
    found = matching.occurrences(corpus.sentences, corpus.terms)
    counts = found.groupBy("term_key").agg(F.count("*").alias("n"))
    routed = summaries.routes(summaries.selected(corpus.terms, only, limit), counts, old, overwrite).persist()
    asked = routed.filter("route = 'model'").select("term_key", "term", "n")
    prompts = summaries.prompts(corpus.terms.join(asked.select("term_key"), "term_key", "left_semi"), found, template, placeholders)
    folder = store.qualified(spark, f"{artifact}.answers")
    answers = summaries.run_model(asked.join(prompts, "term_key"), ask, model, stamp, folder, pause).persist()
    source = F.when(F.col("route") == "notice", summaries.NOTICE_SOURCE).otherwise(summaries.LOCAL_SOURCE)
    notices = routed.filter("route IN ('notice', 'local')").select("term_key", "term", F.col("n").alias("occurrence_count"), "summary", source.alias("summary_source"), F.lit(stamp).alias("generated_at"))
    done = notices.unionByName(answers.filter("error IS NULL").select("term_key", "term", "occurrence_count", "summary", "summary_source", F.col("at").alias("generated_at")))
    failed = answers.filter("error IS NOT NULL").select("term_key", "term", "error", F.col("at").alias("updated_at"))
    kept, still = summaries.merged(old, lost, done, failed)
    writers.write_artifact(artifact, kept, still, model, created, stamp)
    counted = summaries.outcome(routed, failed).first().asDict()
    summaries.Answers(folder).clear()
    for df in (old, lost, routed, answers):
        df.unpersist()
    return counted


def export_html(corpus: Corpus, target: str, stored: DataFrame | None = None, title: str = "Report and glossary") -> None:
    """One page with the reports, the executive summaries and the glossary, linked with each other. stored: term_key, summary of
    the terms that have one. Tasks write its pieces, which are joined in the store: no part of it passes through the driver."""
    spark = corpus.spark
    stored = spark.createDataFrame([], "term_key string, summary string") if stored is None else stored
    units = anchors.statement_units(corpus.stated, corpus.items)
    marks = anchors.statement_anchors(units, ()).persist()
    entries = anchors.term_anchors(corpus.terms.select("term_key")).persist()
    labels, links = glossary.term_index(corpus.terms), glossary.term_index(entries, label="anchor")
    blocks = None if corpus.summaries is None else pages.summary_blocks(corpus.summaries)
    rendered = pages.rendered_units(corpus.report, corpus.stated, blocks, marks)
    evidence = store.stored(pages.evidence_rows(matching.occurrences(corpus.sentences, corpus.terms.select("term_key", "term")), marks), "evidence")
    told = pages.page_fragments(
        pages.report_fragments(corpus.report, rendered, labels, links),
        None if blocks is None else pages.summary_fragments(blocks, rendered, labels, links),
        pages.glossary_fragments(corpus.terms, corpus.usage, stored, evidence, entries, corpus.sources),
        glossary.used_share(corpus.usage), title,
    )
    # stored, as what is sorted by ranges is read twice
    writers.write_joined(store.stored(told, "page").withColumn("item", F.lit(False)), target, pages.ORDER)
    marks.unpersist()
    entries.unpersist()
