"""Whole jobs from files to files."""

import json
import re

import pytest

from lexweave.__main__ import main
from lexweave.operators import documents, pages
from lexweave.plans import jobs
from lexweave.sources import readers, writers
from tests.test_documents import REPORT, SUMMARY, TERMS
from tests.test_sources import docx


@pytest.fixture
def corpus(spark, tmp_path):
    (tmp_path / "report").mkdir()
    (tmp_path / "es").mkdir()
    (tmp_path / "report/r.md").write_text(REPORT)
    (tmp_path / "es/s.md").write_text(SUMMARY)
    (tmp_path / "glossary").mkdir()
    (tmp_path / "glossary/g.xlsx").write_bytes(writers.xlsx_bytes(["Term", "Explanation", "Source"], [[x, f"about {x}", "S"] for x in TERMS]))
    made = jobs.Corpus(spark, str(tmp_path / "report"), str(tmp_path / "es"), str(tmp_path / "glossary"), ("S",))
    yield made
    made.close()


def test_corpus(spark, corpus, tmp_path):
    stored = spark.createDataFrame([], "term_key string, summary string")
    assert [(r["term"], r["n"]) for r in corpus.overview(stored).orderBy("place").collect()] == [("adaptation", 2), ("climate risk", 4), ("confidence", 1), ("co₂", 1), ("risk", 8), ("urban area", 1)]
    assert [r["statement"] for r in corpus.details("Adaptation").collect()] == ["A1.1", "ES1.1.1"]
    assert corpus.citations().count() == 3
    jobs.write_network(corpus, f"file://{tmp_path}/net")
    nodes, edges = readers.read_network(spark, str(tmp_path / "net"))
    assert nodes.count() == 6 and edges.count() == 4
    jobs.export_html(corpus, f"file://{tmp_path}/page.html", spark.createDataFrame([("risk", "Used in A1.1 and `A1.1`.\n\n### Potential issues substantive review\nTwo meanings")], "term_key string, summary string"), "Demo <page>")
    page = (tmp_path / "page.html").read_text()
    assert "<title>Demo &lt;page&gt;</title>" in page and page.index('id="part-0"') < page.index("Section A") < page.index('id="part-1"') < page.index('id="part-2"') < page.index('id="term-adaptation"') < page.index('id="term-risk"')
    assert page.count(f"<p>{pages.NO_LINES}</p>") == 3  # of six sections three have lines
    ids = re.findall(r' id="([^"]*)"', page)
    links = re.findall(r'href="#([^"]*)"', page)
    assert len(ids) == len(set(ids)) and set(links) <= set(ids) and "term-climate-risk" in links
    a11 = next(i for i in ids if i.startswith("source-statement") and f'id="{i}" class="statement-target">A1.1 ' in page)
    assert f'Used in <a class="statement-link" href="#{a11}">A1.1</a> and <code>A1.1</code>.' in page and 'class="issue"' in page
    assert f'<tr><td><a class="statement-link" href="#{a11}">A1.1</a></td><td>Climate <mark>risk</mark> grows.</td></tr>' in page
    assert '<h4 id="source-statement-3" class="statement-target">A1 ' in page and "<summary>Evidence (8)</summary>" in page and "LLM is not applied to the term confidence." in page
    assert '>[ES1.1.1] <a class="glossary-link" href="#term-adaptation">Adaptation</a> lowers <strong>' in page.replace("<p>", "") and "6 of 6 glossary terms" in page


def test_pages_do_not_depend_on_the_tasks(spark, corpus, tmp_path):
    stored = spark.createDataFrame([("risk", "As A1.1 and Section A say."), ("adaptation", " "), ("co₂", None), ("confidence", "A1")], "term_key string, summary string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    told = []
    try:
        for n in (1, 23):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            jobs.export_html(corpus, f"file://{tmp_path}/page{n}.html", stored, "T")
            told.append((tmp_path / f"page{n}.html").read_text())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    page = told[0]
    assert page == told[1]
    for tag in ("section", "article", "table", "tbody", "tr", "details", "nav", "main", "p", "h3"):
        assert len(re.findall(f"<{tag}[ >]", page)) == page.count(f"</{tag}>"), tag
    index = page[page.index("<h2>Report") : page.index('<section id="report-')]
    assert re.findall(r'href="#([^"]*)">([^<]*)<', index) == [(f"report-r-md-{s.lower().replace(' ', '-')}", f"r.md {s}") for s in documents.SECTIONS]
    assert '<a href="#summary-s-md">s.md</a>' in page and 'id="glossary-search"' in page and page.startswith("<!DOCTYPE html>") and page.endswith("</html>\n")
    risk = page[page.index('<article id="term-risk"') :]
    rows = re.findall(r"<tr><td>(?:<a [^>]*>)?([^<]*)(?:</a>)?</td>", risk[: risk.index("</article>")])
    assert rows == [r["statement"] for r in corpus.details("risk").collect()] and len(rows) == 8
    assert re.search(r'As <a class="statement-link" href="#[^"]*">A1\.1</a> and', risk) and page.count(f"<p>{pages.NO_SUMMARY}</p>") == 4
    jobs.export_html(corpus, f"file://{tmp_path}/none.html")
    assert (tmp_path / "none.html").read_text().count(f"<p>{pages.NO_SUMMARY}</p>") == 5


def test_summaries_resume(corpus, tmp_path):
    path = f"file://{tmp_path}/a.json"

    def ask(prompt):
        if prompt.startswith("climate"):
            raise RuntimeError("busy")
        return "said " + prompt.split("|")[0]

    def run(ask, **more):
        return jobs.generate_summaries(corpus, path, "{term}|{d}|{statement_sentence_table}", {"d": "S"}, ask, "m", "now", **more)

    assert run(ask) == {"completed": 5, "skipped": 0, "failed": 1}
    told = json.loads((tmp_path / "a.json").read_text())
    assert told["summaries"]["risk"]["summary"] == "said risk" and list(told["failures"]) == ["climate risk"] and told["summaries"]["confidence"]["summary_source"] == "LLM not applied"
    assert run(lambda p: "now fine") == {"completed": 1, "skipped": 5, "failed": 0}
    told = json.loads((tmp_path / "a.json").read_text())
    assert told["summaries"]["climate risk"]["summary"] == "now fine" and told["failures"] == {} and told["summaries"]["risk"]["summary"] == "said risk"
    assert run(lambda p: "again", only=("RISK",), overwrite=True) == {"completed": 1, "skipped": 0, "failed": 0}
    with pytest.raises(ValueError, match="unknown"):
        run(ask, only=("nothing",))


def test_converters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paragraphs = [("Top", None, [("Executive Summary", None, None)]), (None, None, [("Findings", True, None)]), (None, None, [("Text ", None, None), ("stressed", None, True)]), ("Top", None, [("Next", None, None)])]
    (tmp_path / "in/x_Ch02_y.docx").write_bytes(docx(paragraphs))
    assert main(["documents", str(tmp_path / "in"), f"file://{tmp_path}/md"], spark) == 0
    assert main(["summaries", str(tmp_path / "in"), f"file://{tmp_path}/es", "--level", "Top=1"], spark) == 0
    assert readers.read_texts(spark, f"{tmp_path}/es/*").first()["text"].strip() == "# Executive Summary\n\n## [ES2.1] **Findings**\n\n[ES2.1.1] Text *stressed*"
    assert main(["summaries", str(tmp_path / "in"), f"file://{tmp_path}/es2", "--level", "Other=1"], spark) == 1
    main(["glossary-document", str(tmp_path / "in"), f"file://{tmp_path}/g1.xlsx", "--name", "S"], spark)
    assert [(r["term"], r["explanation"]) for r in readers.read_workbook(spark, str(tmp_path / "g1.xlsx")).collect()] == [("Findings", "Text stressed Next")]
    (tmp_path / "lines.txt").write_text("Alpha  first\nBeta  See Alpha.\n")
    main(["glossary-lines", str(tmp_path / "lines.txt"), f"file://{tmp_path}/g2.xlsx", "--start", "Alpha"], spark)
    main(["glossary-parents", str(tmp_path / "g2.xlsx"), f"file://{tmp_path}/g3.xlsx", "--name", "S"], spark)
    assert [(r["term"], r["parent"], r["source"]) for r in readers.read_workbook(spark, str(tmp_path / "g3.xlsx")).orderBy("pos").collect()] == [("Alpha", "", "S"), ("Beta", "Alpha", "S")]
    jobs.convert_pages(spark.createDataFrame([("d", 1, "page text")], "doc string, page int, text string"), f"file://{tmp_path}/pages", headers=True)
    assert "## Page 1" in readers.read_texts(spark, f"{tmp_path}/pages/*").first()["text"]
    (tmp_path / "none").mkdir()
    assert main(["documents", str(tmp_path / "none"), "x"], spark) == 1
    with pytest.raises(ValueError, match="no document"):
        jobs.convert_documents(spark, str(tmp_path / "none"), "x")


def test_pages_and_archives(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text/a.txt").write_text("first page 1\f12\fthird\f")
    assert main(["pages", str(tmp_path / "text"), f"file://{tmp_path}/md", "--page-headers"], spark) == 0
    assert readers.read_texts(spark, f"{tmp_path}/md/doc=a").first()["text"].strip() == "# a\n\n\n## Page 1\n\n\nfirst page\n\n\n## Page 2\n\n\n_No extractable text on this page._\n\n\n## Page 3\n\n\nthird"
    (tmp_path / "b.bin").write_bytes(b"\x00b")
    assert main(["archive", f"{tmp_path}/text/a.txt", f"file://{tmp_path}/z.zip", "--file", f"{tmp_path}/b.bin"], spark) == 0
    assert {r["name"]: bytes(r["content"]) for r in readers.read_archive(spark, f"{tmp_path}/z.zip").collect()} == {"a.txt": b"first page 1\f12\fthird\f", "b.bin": b"\x00b"}
    assert main(["archive", f"{tmp_path}/nothing", f"file://{tmp_path}/y.zip"], spark) == 1


def asked_of(tmp_path):
    return sorted(p.read_text() for p in tmp_path.glob("asked-*"))


def test_a_stopped_run_loses_no_answer(spark, corpus, tmp_path):
    """The model dies after its first answer; the next run asks for the other term only."""
    path, seen = f"file://{tmp_path}/a.json", str(tmp_path)

    def run(ask):
        return jobs.generate_summaries(corpus, path, "{term}|{statement_sentence_table}", {}, ask, "m", "now")

    def dies(prompt):
        import os
        import time

        try:  # tasks run side by side, and one of them is first
            with open(f"{seen}/asked-first", "x") as out:
                out.write(prompt.split("|")[0])
        except FileExistsError:
            until = time.time() + 60
            while not [x for x in os.listdir(f"{seen}/a.json.answers") if x.endswith(".txt")] and time.time() < until:
                time.sleep(0.05)
            raise NameError("the job ends here") from None
        return "said " + prompt.split("|")[0]

    with pytest.raises(Exception, match="the job ends here"):
        run(dies)
    assert len(asked_of(tmp_path)) == 1 and not (tmp_path / "a.json").exists()

    def goes_on(prompt):
        import uuid

        with open(f"{seen}/asked-{uuid.uuid4().hex}", "w") as out:
            out.write(prompt.split("|")[0])
        return "said " + prompt.split("|")[0]

    told = run(goes_on)
    asked = asked_of(tmp_path)
    assert told["failed"] == 0 and len(asked) == len(set(asked)) >= 2
    held = json.loads((tmp_path / "a.json").read_text())["summaries"]
    assert {r["term"]: r["summary"] for r in held.values() if r["summary_source"] == "m"} == {x: f"said {x}" for x in asked}
    assert not (tmp_path / "a.json.answers").exists()


def answer(prompt):
    if prompt.startswith("climate"):
        raise RuntimeError("busy")
    return "said"


def test_summaries_from_the_command_line(spark, corpus, tmp_path):
    (tmp_path / "prompt.txt").write_text("{term} {d} {statement_sentence_table}")
    args = ["term-summaries", f"{tmp_path}/report", f"file://{tmp_path}/s.json", "--executive", f"{tmp_path}/es", "--glossary", f"{tmp_path}/glossary", "--sources", "S", "--ask", "tests.test_jobs:answer", "--model", "m", "--prompt", f"{tmp_path}/prompt.txt", "--placeholder", "d=S"]
    assert main([*args, "--limit", "0"], spark) == main([*args, "--pause-seconds", "-1"], spark) == main([*args, "--term", "nothing"], spark) == 2
    assert main([*args, "--term", "risk"], spark) == 0
    assert main(args, spark) == 1  # one term is not answered
    assert len(json.loads((tmp_path / "s.json").read_text())["summaries"]) == 5
    args[1] = f"{tmp_path}/nowhere"
    assert main(args, spark) == 1
