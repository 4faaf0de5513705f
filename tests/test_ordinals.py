"""Numbers over a whole corpus and running states of documents, whatever the number of ranges and blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import documents, ordinals
from lexweave.sources import store


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_numbers_do_not_depend_on_the_ranges(spark, partitions):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None, "ccc"]), rnd.choice([None, *range(50)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, doc string, x int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        key = lambda r: (r[2] is not None, r[2] or 0, r[0])
        got = {r["id"]: r["place"] for r in ordinals.numbered(df, [F.col("x"), F.col("id")]).collect()}
        assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=key), 1)}
        got = {r["id"]: r["n"] for r in ordinals.numbered(df, [F.col("x"), F.col("id")], ("doc",), "n").collect()}
        for doc in ("a", "b", None, "ccc"):
            own = [r for r in rows if r[1] == doc]
            assert {r[0]: got[r[0]] for r in own} == {r[0]: k for k, r in enumerate(sorted(own, key=key), 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_window_sees_all_rows(spark, capsys):
    ordinals.numbered(spark.range(1000), [F.col("id")]).explain()
    assert "SinglePartition" not in capsys.readouterr().out
    assert ordinals.numbered(spark.range(0), [F.col("id")]).count() == 0


def test_paths_belong_to_the_default_store(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./kept", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://other/")
    try:
        assert store.qualified(spark, "/kept/a.json.answers") == "viewfs://other/kept/a.json.answers"
        assert store.qualified(spark, "file:///x/y") == "file:///x/y"
    finally:
        conf.set("fs.defaultFS", before)


def one_by_one(rows, before):
    """The running states of (doc, pos, text, n) by a loop over the sorted rows."""
    out, held = {}, {}
    for doc, pos, text, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state = held.get(doc, (None, None, None))
        told = (text if text is not None else state[0], state[1] if state[1] is not None else text, state[2] if n is None else (state[2] or 0) + n)
        out[doc, pos] = state if before else told
        held[doc] = told
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 16])
@pytest.mark.parametrize("before", [False, True])
def test_running_states_do_not_depend_on_the_blocks(spark, monkeypatch, block, before):
    monkeypatch.setattr(ordinals, "BLOCK", block)
    rnd = random.Random(block)
    rows = [(doc, pos, rnd.choice([None, None, None, "x", "y"]), rnd.choice([None, None, 1, 5])) for doc in ("a", None, "empty", "z") for pos in rnd.sample(range(200), 60 if doc != "empty" else 0)]
    df = spark.createDataFrame(rows, "doc string, pos int, text string, n int").repartition(5)
    got = ordinals.running(df, last={"l": F.col("text")}, first={"f": F.col("text")}, total={"t": F.col("n")}, before=before)
    assert got.columns == ["doc", "pos", "text", "n", "l", "f", "t"]
    assert {(r["doc"], r["pos"]): (r["l"], r["f"], r["t"]) for r in got.collect()} == one_by_one(rows, before)
    assert ordinals.running(df.limit(0), total={"t": F.col("n")}).count() == 0


def test_rows_without_a_place_stand_at_the_head(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "BLOCK", 2)
    df = spark.createDataFrame([("d", None, 1), ("d", -5, 2), ("d", 0, 4), ("d", 7, 8)], "doc string, pos int, n int")
    assert [r["t"] for r in ordinals.running(df, total={"t": F.col("n")}).orderBy("pos").collect()] == [1, 3, 7, 15]


LINES = ("# A title", "## Introduction", "## Section A: on one", "## section b", "## Other", "Table of  Contents", "A1 first", "A1.1 more {1.2}", "text", "  ", "### deep", "Adaptation  the word", "Mark  said", "References", "goes on")


def test_documents_do_not_depend_on_the_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(doc, pos, rnd.choice(LINES)) for doc in range(12) for pos in range(40)]
    lines = spark.createDataFrame(rows, "doc int, pos int, line string").repartition(3)
    runs = F.array(F.struct(F.col("line").alias("text"), (F.length("line") < 9).alias("bold"), F.lit(False).alias("italic")))
    paragraphs = lines.select("doc", "pos", F.when(F.length("line") % 3 == 0, 12.0).alias("left_indent_pt"), runs.alias("runs"), F.col("line").alias("style"))
    made = {
        "report": lambda: documents.report_lines(lines),
        "numbered": lambda: documents.numbered_lines(lines, F.lit(3)),
        "section": lambda: documents.take_section(lines, F.col("line").startswith("A1"), F.col("line").startswith("## ") | F.col("line").startswith("A1")),
        "until": lambda: documents.until_style(paragraphs, "references").drop("runs"),
        "listed": lambda: documents.listed_entries(lines, "Adaptation", "references"),
        "bold": lambda: documents.bold_entries(paragraphs),
    }
    whole = {name: sorted(map(tuple, f().collect()), key=str) for name, f in made.items()}
    assert all(whole.values())
    monkeypatch.setattr(ordinals, "BLOCK", 7)
    for name, f in made.items():
        assert sorted(map(tuple, f().collect()), key=str) == whole[name], name

    # the sections once more, by a loop
    section, contents, told, doc = "Author Team", False, [], None
    for d, pos, line in rows:
        if d != doc:
            doc, section, contents = d, "Author Team", False
        line = " ".join(line.split())
        if line.startswith("## "):
            name = line[3:].lower()
            section = "Introduction" if name == "introduction" else f"Section {name[8].upper()}" if name.startswith("section ") else ""
            contents = False
        elif line.lower() == "table of contents":
            contents = True
        elif line and section and not contents and not line.startswith("# "):
            told.append((d, section, documents.SECTIONS.index(section) + 1, pos, line))
    assert sorted(told, key=str) == whole["report"]

    # a section from its first start to the next stop behind it, by a loop
    kept = []
    for d in range(12):
        own = [r for r in rows if r[0] == d]
        a = next((r[1] for r in own if r[2].startswith("A1")), None)
        z = next((r[1] for r in own if a is not None and r[1] > a and r[2].startswith(("## ", "A1"))), 40)
        kept += [r for r in own if a is not None and a <= r[1] < z]
    assert sorted(kept, key=str) == whole["section"]


def test_a_long_document_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "BLOCK", 1 << 12)
    n = 200_000
    line = F.when(F.col("id") == 50_000, "## Section B").when(F.col("id") == 150_000, "## Elsewhere").otherwise(F.concat(F.lit("B1 line "), "id"))
    lines = spark.range(0, n, 1, 8).select(F.lit("one").alias("doc"), F.col("id").alias("pos"), line.alias("line"))
    report = documents.report_lines(lines).withColumn("task", F.spark_partition_id())
    got = {r["section"]: (r["n"], r["a"], r["z"], r["tasks"]) for r in report.groupBy("section").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("z"), F.count_distinct("task").alias("tasks")).collect()}
    assert got["Author Team"][:3] == (50_000, 0, 49_999) and got["Section B"][:3] == (99_999, 50_001, 149_999) and len(got) == 2
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert all("__block" in w for w in plan.split("\n") if "Window [" in w and "__carried" in w)
