"""Sources: office documents, workbooks, archives, texts, network and summary files.

Files come through Spark's binaryFile and text readers, so any store that Spark reads will do; the formats are opened on the
executors, one file a row.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import sealed
from lexweave.functions import text as t
from lexweave.operators.network import parse_cypher
from lexweave.operators.summaries import FAILURE_SCHEMA, SUMMARY_SCHEMA

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PARAGRAPHS = "doc string, pos long, style string, left_indent_pt double, runs array<struct<text:string,bold:boolean,italic:boolean>>"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _on(properties, name: str) -> bool | None:
    found = properties.find(_W + name) if properties is not None else None
    return None if found is None else found.get(_W + "val", "true") not in ("false", "0", "off")


def docx_rows(content: bytes) -> list[dict]:
    """The paragraphs of a document's body: style name, left indent in points, runs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
                name = s.find(_W + "name")
                styles[s.get(_W + "styleId")] = name.get(_W + "val") if name is not None else s.get(_W + "styleId")
    out = []
    for p in body.findall(_W + "p"):
        properties = p.find(_W + "pPr")
        style = properties.find(_W + "pStyle") if properties is not None else None
        indent = properties.find(_W + "ind") if properties is not None else None
        left = indent.get(_W + "left", indent.get(_W + "start")) if indent is not None else None
        runs = []
        for r in p.iter(_W + "r"):
            text = "".join(x.text or "" if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag in (_W + "br", _W + "cr") else "" for x in r)
            runs.append({"text": text, "bold": _on(r.find(_W + "rPr"), "b"), "italic": _on(r.find(_W + "rPr"), "i")})
        key = style.get(_W + "val") if style is not None else None
        out.append({"style": styles.get(key, key) or "Normal", "left_indent_pt": int(left) / 20 if left else None, "runs": runs})
    return out


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """doc, pos, style, left_indent_pt, runs of documents (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = docx_rows(bytes(content))
                yield pd.DataFrame({"doc": [name] * len(rows), "pos": range(len(rows)), **{k: [r[k] for r in rows] for k in ("style", "left_indent_pt", "runs")}})

    return files.mapInPandas(run, PARAGRAPHS)


def read_docx(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """The paragraphs of all documents of a folder."""
    return docx_paragraphs(_files(spark, path, pattern))


def _typed(kind: str, told: str) -> str | None:
    """The text of a number or a truth value; zero and false are empty cells, as a number that is no text has no words."""
    if kind == "b":
        return "True" if told.strip() == "1" else None
    if kind != "n":
        return told
    try:
        number = int(told) if re.fullmatch(r"\s*[+-]?\d+\s*", told) else float(told)
    except ValueError:
        return told
    return str(number) if number else None


def xlsx_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text; a zero and a false are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(x.text or "" for x in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
        sheet = ElementTree.fromstring(z.read(min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))))
    out = []
    for row in sheet.iter(_S + "row"):
        cells: list[str | None] = []
        for k, c in enumerate(row.findall(_S + "c")):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = k
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            value = c.find(_S + "v")
            text = None if value is None else value.text
            if c.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif c.get("t") == "inlineStr":
                text = "".join(x.text or "" for x in c.iter(_S + "t"))
            elif text is not None:
                text = _typed(c.get("t", "n"), text)
            cells += [None] * (at + 1 - len(cells))
            cells[at] = text
        out.append(cells)
    return out


def workbook_rows(files: DataFrame, required: tuple[str, ...] = ("term", "explanation"), optional: tuple[str, ...] = ("parent", "source")) -> DataFrame:
    """doc, pos and the named columns of workbooks (path, content), found by their headers in any case; short rows are filled up, rows without the first
    required column's value go. A missing required header is an error."""
    wanted = (*required, *optional)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = xlsx_rows(bytes(content))
                head = [(c or "").strip().lower() for c in (rows[0] if rows else [])]
                if lost := [c for c in required if c not in head]:
                    raise ValueError(f"{name} has no column {', '.join(lost)}")
                at = [head.index(c) if c in head else None for c in wanted]
                cells = [[i, *("" if a is None or a >= len(r) or r[a] is None else r[a] for a in at)] for i, r in enumerate(rows[1:])]
                yield pd.DataFrame([[name, *c] for c in cells], columns=["doc", "pos", *wanted])

    found = files.mapInPandas(run, "doc string, pos long, " + ", ".join(f"{c} string" for c in wanted))
    return found.select("doc", "pos", *[t.cell(F.col(c)).alias(c) for c in wanted]).filter(F.col(wanted[0]) != "")


def read_workbook(spark: SparkSession, path: str, required: tuple[str, ...] = ("term", "explanation"), optional: tuple[str, ...] = ("parent", "source"), pattern: str = "*.xlsx") -> DataFrame:
    """The rows of all workbooks of a folder."""
    return workbook_rows(_files(spark, path, pattern), required, optional)


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """doc, text of whole UTF-8 files; lines are split later, by the rules of the text functions."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_cypher(spark.read.text(path))


ENVELOPE = f"format_version int, model string, created_at string, updated_at string, summaries map<string,struct<{', '.join(c.replace(' ', ':', 1) for c in SUMMARY_SCHEMA.split(', ')[1:])}>>, failures map<string,struct<{', '.join(c.replace(' ', ':', 1) for c in FAILURE_SCHEMA.split(', ')[1:])}>>"


def _artifact_head(spark: SparkSession, path: str) -> dict | None:
    """The envelope of an artifact whose records have a line each, without them; None for another layout of the JSON."""
    first = spark.read.text(path).first()
    if first is None or not first["value"].endswith('"summaries":{'):
        return None
    return json.loads(first["value"] + "}}")


def read_artifact(spark: SparkSession, path: str, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The summaries and failures of an artifact file as tables. A file with a line for each record is read by lines, in as many tasks as
    Spark cuts it for; another layout has to be one text. What is an error is one as for `parse_artifact`, as is a file that is cut off."""
    head = _artifact_head(spark, path)
    if head is None:
        return parse_artifact(spark.read.text(path, wholetext=True), model)
    lines = spark.read.text(path)
    if head.get("format_version") != 1:
        raise ValueError("unsupported artifact version")
    if model is not None and head.get("model") != model:
        raise ValueError("artifact is of another model")
    if not lines.filter("value = '}}'").take(1):
        raise ValueError("the artifact is cut off")
    fields = dict(x.split(" ", 1) for schema in (SUMMARY_SCHEMA, FAILURE_SCHEMA) for x in schema.split(", ")[1:])
    record = f"map<string,struct<{','.join(f'{k}:{v}' for k, v in fields.items())}>>"
    told = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}")), record)
    rows = lines.filter(F.col("value").startswith('"')).select(F.explode(told).alias("term_key", "v")).select("term_key", "v.*")

    failed = F.col("error").isNotNull()
    done, lost = ([x.split()[0] for x in schema.split(", ")] for schema in (SUMMARY_SCHEMA, FAILURE_SCHEMA))
    return rows.filter(~failed).select(done), rows.filter(failed).select(lost)


def _envelopes(texts: DataFrame, model: str | None = None) -> DataFrame:
    raw = texts.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")
    wrong = F.when(~F.col("format_version").eqNullSafe(F.lit(1)), "unsupported artifact version").when(F.col("summaries").isNull(), "artifact has no summaries")
    if model is not None:
        wrong = wrong.when(~F.col("model").eqNullSafe(F.lit(model)), "artifact is of another model")
    return raw.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))


def parse_artifact(texts: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The summaries and failures of artifacts (value). Another version, another model (if one is named) or a text without a
    summaries object is an error where the tables are used."""
    checked = _envelopes(texts, model)

    def of(c: str, schema: str) -> DataFrame:
        rows = checked.select(F.explode(c).alias("term_key", "v"))
        return rows.select("term_key", *[F.col(f"v.{x.split()[0]}") for x in schema.split(", ")[1:]])

    return of("summaries", SUMMARY_SCHEMA), of("failures", FAILURE_SCHEMA)


def artifact_or_new(spark: SparkSession, path: str, model: str, stamp: str) -> tuple[DataFrame, DataFrame, str]:
    """An artifact's tables and the time it was made; empty tables and this time if there is no file yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SUMMARY_SCHEMA), spark.createDataFrame([], FAILURE_SCHEMA), stamp
    head = _artifact_head(spark, path)
    made = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.created_at")).first()[0] if head is None else head.get("created_at")
    return *read_artifact(spark, path, model), made


def stored_summaries(texts: DataFrame) -> DataFrame:
    """term_key (folded), summary (trimmed) of artifacts (value) of any model; of keys that fold alike the later one counts. An
    entry without a key or a text is an error."""
    rows = _envelopes(texts).select(F.posexplode("summaries").alias("place", "term_key", "v"))
    held = rows.select("place", t.folded(t.collapsed(F.col("term_key"))).alias("term_key"), t.stripped(F.col("v.summary")).alias("summary"))
    blank = F.coalesce((F.col("term_key") == "") | (F.col("summary") == ""), F.lit(True))
    whole = held.filter(F.when(blank, F.raise_error(F.lit("a stored summary has no key or no text")).cast("boolean")).otherwise(F.lit(True)))
    return whole.groupBy("term_key").agg(F.max_by("summary", "place").alias("summary"))


def usable_summaries(artifact: DataFrame) -> DataFrame:
    """term_key (folded), summary: the entries with a text. artifact: place, term_key, summary; of keys that fold alike the later
    one counts."""
    rows = artifact.filter(t.stripped(F.col("summary")) != "")
    return rows.groupBy(t.folded(t.collapsed(F.col("term_key"))).alias("term_key")).agg(F.max_by("summary", "place").alias("summary"))


def archive_members(files: DataFrame) -> DataFrame:
    """archive, name, content of the members of ZIP archives (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for member in z.namelist():
                        yield pd.DataFrame({"archive": [name], "name": [member], "content": [z.read(member)]})

    return files.mapInPandas(run, "archive string, name string, content binary")


def read_archive(spark: SparkSession, path: str, pattern: str = "*.zip", key: str | None = None) -> DataFrame:
    """The members of all archives of a folder, or of one file. With a key the files are sealed and are opened first; one that the
    key does not open is an error."""
    files = _files(spark, path, pattern)
    if key is not None:
        keyed = files.withColumn("__key", sealed.key_table(spark, key).scalar())
        files = keyed.select("path", sealed.opened(F.col("content"), F.col("__key")).alias("content"))
    return archive_members(files)


def member_texts(members: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """doc, text of the named members of archives; text that is not UTF-8 is an error."""
    wanted = F.col("name").isin(*names)
    # what later steps filter by may be looked at before the names are, so other members must not be decoded there either
    return members.filter(wanted).select(F.col("name").alias("doc"), F.when(wanted, F.decode("content", "UTF-8")).alias("text"))
