"""The registered queries against their SQL, at the smallest scale."""

import datetime
import html
import os
import re
import zipfile

import duckdb
import pytest

import __spark_entry__ as entry
import lexweave
from lexweave.functions import text as t
from lexweave.plans import corpus, sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def connection(sf_dir):
    held = duckdb.connect()
    for name in TABLES.split():
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            held.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return held


def plain(value):
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if isinstance(value, datetime.datetime) else value


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, connection, name):
    df = corpus.QUERIES[name](spark, sf_dir)
    found = connection.sql(sql.ORACLE_SQL[name])
    assert told(df.columns, [tuple(r) for r in df.collect()]) == told(found.columns, found.fetchall())


def test_registration(spark, sf_dir):
    assert set(corpus.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["term_key", "n"]


def test_the_package_is_sent_to_workers_that_lack_it(monkeypatch, tmp_path):
    class Context:
        sent: list = []

        def addPyFile(self, path):
            self.sent.append(path)

    class Session:
        sparkContext = Context()

    lexweave.ship(Session)  # the tests run in the repository
    assert Context.sent == []
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PYTHONPATH", "")
    lexweave.ship(Session)
    lexweave.ship(Session)
    assert len(Context.sent) == 1 and "lexweave/operators/matching.py" in zipfile.ZipFile(Context.sent[0]).namelist()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("one\r\ntwo\rthree", "one\ntwo\nthree"),
        ("  12 \nkept 1234\n 1234 \n7", "kept 1234\n 1234"),
        ("Do not cite, quote or distribute\ntext\nTotal pages: 90 (draft)", "text"),
        ("exam-\nple, a - \nb", "example, a -\nb"),
        ("hyphen-\n 5\nated", "hyphenated"),
        ("rose by 50\n50 rose", "rose by\n50 rose"),
        ("a\n\n\n\n\nb\n\n c", "a\n\nb\n\n c"),
        ("x\u00a07", "x"),
        ("\n\n", ""),
        ("a\x0b12\nb\u2028 3", "a\nb"),
    ],
)
def test_cleaned_pages(spark, page, want):
    assert spark.createDataFrame([(page,)], "text string").select(t.clean_page("text")).first()[0] == want


def test_highlights_by_the_rules(spark, sf_dir):
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for r in corpus.highlighted(spark, sf_dir).collect():
        assert r["html"] == re.sub(r"(?<!\w)the(?!\w)", lambda m: f"<mark>{m[0]}</mark>", html.escape(texts[r["item_id"]]), flags=re.IGNORECASE)


@pytest.mark.parametrize("name", sorted(set(corpus.QUERIES) - set(sql.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert corpus.QUERIES[name](spark, sf_dir).count() > 0
