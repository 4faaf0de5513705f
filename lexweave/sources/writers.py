"""Sinks: Markdown, network files, artifacts, workbooks, archives, HTML. Tables of any size go through Spark's writers; single
files are made of what fits one of them by nature (a glossary, a network, a page)."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from xml.sax.saxutils import escape

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import sealed
from lexweave.functions import text as t
from lexweave.sources import store
from lexweave.sources.fragments import write_fragments


def markdown_texts(lines: DataFrame) -> DataFrame:
    """doc, markdown: the lines of each document with a blank line between, and a line end behind."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda p: p["line"])
    return lines.groupBy("doc").agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("markdown"))


def write_per_document(texts: DataFrame, path: str, text: str = "markdown") -> None:
    """One folder of text for each doc, by Spark's own writer."""
    texts.select("doc", F.col(text).alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def write_ordered(lines: DataFrame, path: str, *order: str, text: str = "text") -> None:
    """The texts in a total order as part files whose names follow it."""
    lines.orderBy(*order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_file(spark: SparkSession, path: str, data: bytes | list[str]) -> None:
    """A file of some bytes, or of the bytes of other files, which stream from store to store. It is there whole or not at all: written beside and renamed over what stood there, in one step of the store, so
    a crash at any moment leaves the old file or the new one. Stores that do not rename files in one step (objects) put a file in
    its place only when it is closed."""
    at, store, jvm = _store(spark, path)
    fs = jvm.org.apache.hadoop.fs
    at = at.makeQualified(store.getUri(), store.getWorkingDirectory())
    try:
        context = fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    except Py4JJavaError as e:
        if "UnsupportedFileSystemException" not in str(e.java_exception):
            raise
        context = None
    beside = at if context is None else fs.Path(f"{at.toString()}.{uuid.uuid4().hex}.tmp")
    out = store.create(beside, True)
    if isinstance(data, bytes):
        out.write(data)
    else:
        for part in data:
            source, of, _ = _store(spark, part)
            held = of.open(source)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
            held.close()
    out.close()
    if context is not None:
        rename = getattr(fs, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context.rename(beside, at, over)


def artifact_lines(summaries: DataFrame, failures: DataFrame, model: str, created_at: str, updated_at: str) -> DataFrame:
    """kind, key, text, item: the lines of an artifact in the order of kind and key: an envelope whose records, by sorted key, have a line
    each. The whole is one JSON object."""
    def records(df: DataFrame, kind: int) -> DataFrame:
        rest = [c for c in df.columns if c != "term_key"]
        last = df.agg(F.max("term_key")).first()[0]
        told = F.concat(t.json_text(F.col("term_key")), F.lit(":"), F.to_json(F.struct(*rest)), F.when(F.col("term_key") == F.lit(last), "\n").otherwise(",\n"))
        return df.select(F.lit(kind).alias("kind"), F.col("term_key").alias("key"), told.alias("text"))

    head = json.dumps({"format_version": 1, "model": model, "created_at": created_at, "updated_at": updated_at}, ensure_ascii=False)
    frame = summaries.sparkSession.createDataFrame([(0, "", head[:-1] + ', "summaries":{\n'), (2, "", '},"failures":{\n'), (4, "", "}}\n")], "kind int, key string, text string")
    return frame.unionByName(records(summaries, 1)).unionByName(records(failures, 3)).withColumn("item", F.lit(False))


def write_artifact(path: str, summaries: DataFrame, failures: DataFrame, model: str, created_at: str, updated_at: str) -> None:
    """The artifact of a glossary's summaries as one file, replaced in one step. Tasks write its parts, which stream into the file one after
    another, so neither a row nor the driver holds it."""
    write_joined(artifact_lines(summaries, failures, model, created_at, updated_at), path, ("kind", "key"))


def write_joined(rows: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """One file of the texts of rows (item, text) in an order, replaced in one step: parts written by tasks, joined in the store."""
    spark = rows.sparkSession
    folder = store.shared_folder(spark, "joined")
    write_fragments(rows, folder, order, ())
    at, held, _ = _store(spark, folder)
    write_file(spark, path, sorted(f.getPath().toString() for f in held.listStatus(at) if not f.getPath().getName().startswith(".")))
    held.delete(at, True)


def xlsx_bytes(header: list[str], rows: list[list[str]], sheet: str = "Glossary") -> bytes:
    """A workbook of one sheet with a frozen, filtered header row."""
    def row(i: int, cells: list[str]) -> str:
        return f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr" s="1"><is><t xml:space="preserve">{escape(c or "")}</t></is></c>' for k, c in enumerate(cells)) + "</row>"

    last = f"{chr(64 + len(header))}{len(rows) + 1}"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>' + "".join(f'<col min="{k + 1}" max="{k + 1}" width="{80 if k == 1 else 32}" customWidth="1"/>' for k in range(len(header))) + f"</cols><sheetData>{row(1, header)}{''.join(row(i, r) for i, r in enumerate(rows, 2))}</sheetData><autoFilter ref=\"A1:{last}\"/></worksheet>",
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return held.getvalue()


def write_glossary_workbook(entries: DataFrame, path: str, columns: dict[str, str], order: tuple[str, ...] = ("pos",)) -> int:
    """One glossary as a workbook; columns maps its columns to headers. An empty glossary is an error."""
    rows = [[r[c] for c in columns] for r in entries.orderBy(*order).select(*columns).toLocalIterator()]
    if not rows:
        raise ValueError("the glossary is empty")
    write_file(entries.sparkSession, path, xlsx_bytes(list(columns.values()), rows))
    return len(rows)


def docx_bytes(paragraphs: list[tuple[str, float | None, list[tuple[str, bool | None, bool | None]]]]) -> bytes:
    """A document of paragraphs (style name, left indent in points, runs of text, bold, italic)."""
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    package = "http://schemas.openxmlformats.org/package/2006"
    names = {s: f"s{i}" for i, s in enumerate(dict.fromkeys(p[0] for p in paragraphs))}

    def switch(tag: str, on: bool | None) -> str:
        return "" if on is None else f"<w:{tag}/>" if on else f'<w:{tag} w:val="false"/>'

    def paragraph(style: str, indent: float | None, runs: list) -> str:
        shift = "" if indent is None else f'<w:ind w:left="{round(indent * 20)}"/>'
        told = "".join(f'<w:r><w:rPr>{switch("b", b)}{switch("i", i)}</w:rPr><w:t xml:space="preserve">{escape(text or "")}</w:t></w:r>' for text, b, i in runs)
        return f'<w:p><w:pPr><w:pStyle w:val="{names[style]}"/>{shift}</w:pPr>{told}</w:p>'

    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "word/document.xml": f'<w:document xmlns:w="{main}"><w:body>{"".join(paragraph(*p) for p in paragraphs)}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{main}">' + "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{escape(s, {chr(34): "&quot;"})}"/></w:style>' for s, k in names.items()) + "</w:styles>",
    }
    return archive_bytes({name: ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text).encode() for name, text in files.items()})


def archive_bytes(files: dict[str, bytes]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return held.getvalue()


def sealed_bytes(spark: SparkSession, data: bytes, key: str) -> bytes:
    """A file's bytes sealed with a key."""
    keyed = spark.createDataFrame([(data,)], "content binary").withColumn("__key", sealed.key_table(spark, key).scalar())
    return keyed.select(sealed.sealed(F.col("content"), F.col("__key"), F.unix_timestamp())).first()[0].encode()


def archive_differences(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """name, side (missing or unexpected) of the members (name, content) that two archives do not share byte for byte."""
    a, b = (df.select("name", F.sha2("content", 256).alias("digest")) for df in (wanted, found))
    return a.exceptAll(b).select("name", F.lit("missing").alias("side")).unionByName(b.exceptAll(a).select("name", F.lit("unexpected").alias("side")))
