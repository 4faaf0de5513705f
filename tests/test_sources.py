"""Sources, sinks, audit records and the stream around them."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.operators import audit, summaries
from lexweave.sources import readers, writers
from lexweave.streaming import audit as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs):
    body = "".join(
        f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{f"<w:ind w:left={chr(34)}{indent}{chr(34)}/>" if indent else ""}</w:pPr>'
        + "".join(f'<w:r><w:rPr>{"<w:b/>" if b else ""}{"<w:i w:val={0}false{0}/>".format(chr(34)) if i is False else "<w:i/>" if i else ""}</w:rPr><w:t>{text}</w:t></w:r>' for text, b, i in runs)
        + "</w:p>"
        for style, indent, runs in paragraphs
    )
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
    return held.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("H1", None, [("Title", True, None)]), (None, 240, [("a", False, False), ("b", False, True)])]))
    rows = readers.read_docx(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["style"], r["left_indent_pt"], [tuple(x) for x in r["runs"]]) for r in rows] == [("Heading 1", None, [("Title", True, None)]), ("Normal", 12.0, [("a", None, False), ("b", None, True)])]


def test_workbooks(spark, tmp_path):
    entries = spark.createDataFrame([(1, "Risk & co", "about", "first"), (0, "Été", "x < y", "")], "pos long, term string, explanation string, source string")
    path = f"file://{tmp_path}/g.xlsx"
    assert writers.write_glossary_workbook(entries, path, {"explanation": "Explanation", "term": "TERM", "source": "Source"}) == 2
    rows = readers.read_workbook(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["term"], r["explanation"], r["parent"], r["source"]) for r in rows] == [("Été", "x < y", "", ""), ("Risk & co", "about", "", "first")]
    with pytest.raises(Exception, match="no column"):
        readers.read_workbook(spark, str(tmp_path), required=("nothing",)).collect()
    with pytest.raises(ValueError):
        writers.write_glossary_workbook(entries.limit(0), path, {"term": "Term"})


def test_short_and_shared_cells():
    held = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="B2"><v>3.5</v></c></row></sheetData></worksheet>')
    assert readers.xlsx_rows(held.getvalue()) == [["one", None, "two"], [None, "3.5"]]


def test_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(writers.archive_bytes({"x": b"1", "y": b"2"}))
    found = readers.read_archive(spark, str(tmp_path))
    wanted = spark.createDataFrame([("x", bytearray(b"1")), ("y", bytearray(b"3")), ("z", bytearray(b""))], "name string, content binary")
    assert sorted(map(tuple, writers.archive_differences(wanted, found).collect())) == [("y", "missing"), ("y", "unexpected"), ("z", "missing")]


def test_artifacts(spark, tmp_path):
    done = spark.createDataFrame([("b", "B", 2, "text", "m", "t"), ("a", "A", 0, "é", "m", "t")], summaries.SUMMARY_SCHEMA)
    lost = spark.createDataFrame([("c", "C", "error", "t")], summaries.FAILURE_SCHEMA)
    path = f"file://{tmp_path}/art.json"
    writers.write_artifact(path, done, lost, "m", "t0", "t1")
    writers.write_artifact(path, done, lost, "m", "t0", "t1")  # over itself
    told = (tmp_path / "art.json").read_text()
    assert list(json.loads(told)["summaries"]) == ["a", "b"] and json.loads(told)["failures"]["c"]["error"] == "error"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["art.json"]
    s, f = readers.read_artifact(spark, path, "m")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, done.collect())) and f.collect()[0]["error"] == "error"
    with pytest.raises(Exception, match="another model"):
        readers.read_artifact(spark, path, "n")[0].collect()
    writers.write_file(spark, path, json.dumps(json.loads(told), indent=2).encode())  # another layout
    s, f = readers.read_artifact(spark, path, "m")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, done.collect())) and f.count() == 1
    with pytest.raises(Exception, match="another model"):
        readers.read_artifact(spark, path, "n")[0].collect()
    assert readers.artifact_or_new(spark, path, "m", "t2")[2] == "t0"
    writers.write_file(spark, path, told[:-4].encode())
    with pytest.raises(ValueError, match="cut off"):
        readers.read_artifact(spark, path, "m")
    many = spark.range(30_000).selectExpr("concat('k \"', id) AS term_key", "'T' AS term", "id AS occurrence_count", "concat('line\n}}\n', id) AS summary", "'m' AS summary_source", "'t' AS generated_at").repartition(7)
    writers.write_artifact(path, many, lost.limit(0), "m", "t0", "t1")
    s, f = readers.read_artifact(spark, path)
    assert s.exceptAll(many).count() == 0 and s.count() == 30_000 == len(json.loads((tmp_path / "art.json").read_text())["summaries"]) and f.count() == 0
    rows = spark.createDataFrame([(0, "Risk", "a"), (1, " risk ", "b"), (2, "risk", " ")], "place int, term_key string, summary string")
    assert [tuple(r) for r in readers.usable_summaries(rows).collect()] == [("risk", "b")]


def test_texts(spark, tmp_path):
    lines = spark.createDataFrame([("d", 1, "two"), ("d", 0, "one")], "doc string, pos int, line string")
    texts = writers.markdown_texts(lines)
    assert texts.first()["markdown"] == "one\n\ntwo\n"
    writers.write_per_document(texts, f"file://{tmp_path}/out")
    assert readers.read_texts(spark, f"{tmp_path}/out/doc=d").first()["text"].strip() == "one\n\ntwo"
    writers.write_ordered(lines, f"file://{tmp_path}/lines", "pos", text="line")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/lines").collect()] == ["one", "two"]


def test_audit(spark):
    rows = spark.createDataFrame([("Ann", "2024", "10.0.0.1", True), (None, "2025", "", False)], stream.LOGIN_SCHEMA)
    first, second = (json.loads(r["payload"])["properties"] for r in audit.login_records(rows, "checkbox", {"name": "Name"}).collect())
    assert first == {"Name": {"title": [{"text": {"content": "Ann"}}]}, "date": {"date": {"start": "2024"}}, "ip address": {"rich_text": [{"text": {"content": "10.0.0.1"}}]}, "wrong pwd": {"checkbox": True}}
    assert second["Name"]["title"] == [] and second["wrong pwd"] == {"checkbox": False}
    chats = spark.createDataFrame([("q" * 2500, "a", "ip", "app", "now", 3, None)], "question string, answer string, ip string, app_name string, stamp string, token_input int, token_output int")
    record = json.loads(audit.chat_records(chats).first()["payload"])["properties"]
    assert [len(x["text"]["content"]) for x in record["questions"]["rich_text"]] == [2000, 500] and record["token_input"] == {"number": 3} and record["token_output"] == {"number": None}
    as_text = json.loads(audit.chat_records(chats, tokens_as_text=True).first()["payload"])["properties"]
    assert as_text["token_input"]["rich_text"][0]["text"]["content"] == "3" and as_text["token_output"]["rich_text"] == []
    good = [("NAME", "title"), ("Date", "date"), ("IP  Address", "rich_text"), ("wrong pwd", "status")]
    assert audit.schema_problems(spark.createDataFrame(good, "name string, kind string")).count() == 0
    assert {r["property"] for r in audit.schema_problems(spark.createDataFrame([("name", "text"), *good[1:3]], "name string, kind string")).collect()} == {"name", "wrong pwd"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"name":"a","stamp":"s","ip":"i","wrong":true}\n')
    seen = []
    for _ in range(2):
        stream.append(stream.login_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: seen.append(n)).awaitTermination()
        (tmp_path / "in/2.json").write_text('{"name":"b","stamp":"s","ip":"i","wrong":false}\n')
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["name"] for r in rows.collect()) == ["a", "b"] and seen == [0, 1]
    assert rows.filter(F.col("payload").contains('"Yes"')).count() == 1


def test_typed_cells():
    """Zero and false are empty, numbers are written plainly, texts stay."""
    made = writers.xlsx_bytes(["a"] * 9, [["x"] * 9])
    cells = "".join(f'<c r="{chr(65 + i)}2"{kind}><v>{v}</v></c>' for i, (kind, v) in enumerate([("", "0"), ("", "5"), ("", "1.50"), (' t="b"', "1"), (' t="b"', "0"), (' t="str"', "0"), (' t="n"', "0.0"), (' t="e"', "#N/A"), ("", "-3")]))
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        files = {n: z.read(n) for n in z.namelist()}
    name = "xl/worksheets/sheet1.xml"
    files[name] = re.sub(rb'(?s)<row r="2">.*?</row>', f'<row r="2">{cells}</row>'.encode(), files[name])
    assert readers.xlsx_rows(writers.archive_bytes(files))[1] == [None, "5", "1.5", "True", None, "0", None, "#N/A", "-3"]
