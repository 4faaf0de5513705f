"""Sealed contents and archives, and the corpus an archive holds."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from lexweave.__main__ import main
from lexweave.functions import sealed
from lexweave.plans import jobs
from lexweave.sources import readers, writers
from tests.test_documents import REPORT, SUMMARY, TERMS

# The published example of the format. Fixed values.
KEY = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
TOKEN = "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
STAMP = 499162800


def with_key(df, key=KEY):
    return df.withColumn("__key", sealed.key_table(df.sparkSession, key).scalar())


def told(spark, token, key=KEY):
    rows = with_key(spark.createDataFrame([(token,)], "token string"), key)
    return rows.select(sealed.opened(F.col("token"), F.col("__key"))).first()[0]


def test_the_published_token(spark):
    rows = with_key(spark.createDataFrame([(bytearray(b"hello"),)], "content binary"))
    made = rows.select(sealed.sealed(F.col("content"), F.col("__key"), F.lit(STAMP), F.lit(bytearray(range(16))))).first()[0]
    assert made == TOKEN and bytes(told(spark, TOKEN)) == b"hello" and bytes(told(spark, TOKEN + "\n")) == b"hello" and told(spark, None) is None


def test_round_trips(spark):
    contents = [b"", b"\0", b"x" * 15, b"y" * 16, bytes(range(256)) * 5000, None, b"", b""]
    rows = with_key(spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id int, content binary"))
    tokens = rows.select("id", "content", "__key", sealed.sealed(F.col("content"), F.col("__key"), F.lit(1)).alias("token")).collect()
    assert len({r["token"] for r in tokens}) == len(contents)  # every start vector is its own, equal contents do not show
    again = rows.drop("content", "__key").join(spark.createDataFrame([(r["id"], r["token"]) for r in tokens], "id int, token string"), "id")
    found = with_key(again).select("id", sealed.opened(F.col("token"), F.col("__key")).alias("c")).collect()
    assert {r["id"]: None if r["c"] is None else bytes(r["c"]) for r in found} == dict(enumerate(contents))


def flipped(at):
    raw = bytearray(base64.urlsafe_b64decode(TOKEN))
    raw[at] ^= 1
    return base64.urlsafe_b64encode(raw).decode()


@pytest.mark.parametrize("token", [flipped(0), flipped(8), flipped(9), flipped(30), flipped(-1), TOKEN[:-4], TOKEN[:40], "", "not base64!", "gA=="])
def test_what_is_no_token(spark, token):
    with pytest.raises(Exception, match="not a token of this key"):
        told(spark, token)


def test_keys(spark):
    with pytest.raises(Exception, match="not a token of this key"):
        told(spark, TOKEN, base64.urlsafe_b64encode(bytes(32)).decode())
    for key in ("", "short", KEY[:-1], KEY[:-4], "ä" * 44, KEY + "AAAA"):
        with pytest.raises(ValueError, match="32 bytes") as e:
            sealed.key_table(spark, key)
        assert key == "" or key not in str(e.value)
    plan = with_key(spark.range(1)).select(sealed.opened(F.lit(TOKEN), F.col("__key")))._jdf.queryExecution().toString()
    raw = base64.urlsafe_b64decode(KEY)
    assert KEY not in plan and raw[16:].hex() not in plan.lower()


def test_sealed_archives(spark, tmp_path, monkeypatch):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"first")
    (tmp_path / "in/sub/a.txt").write_bytes(b"second")
    monkeypatch.setenv("SEAL", KEY)
    files = [f"{tmp_path}/in/a.txt", f"file://{tmp_path}/x.enc", "--file", f"{tmp_path}/in/sub/a.txt"]
    assert main(["archive", *files], spark) == 1  # two of one name
    assert main(["archive", *files, "--root", f"{tmp_path}/in/sub"], spark) == 1  # one is outside
    assert main(["archive", *files, "--root", f"{tmp_path}/in", "--key-variable", "UNSET_HERE"], spark) == 1
    assert not (tmp_path / "x.enc").exists()
    assert main(["archive", *files, "--root", f"{tmp_path}/in", "--key-variable", "SEAL"], spark) == 0
    assert (tmp_path / "x.enc").read_bytes().startswith(b"gAAAA")
    assert main(["unpack", f"{tmp_path}/x.enc", f"file://{tmp_path}/out", "--key-variable", "SEAL"], spark) == 0
    assert (tmp_path / "out/a.txt").read_bytes() == b"first" and (tmp_path / "out/sub/a.txt").read_bytes() == b"second"
    monkeypatch.setenv("SEAL", base64.urlsafe_b64encode(bytes(32)).decode())
    assert main(["unpack", f"{tmp_path}/x.enc", f"file://{tmp_path}/no", "--key-variable", "SEAL"], spark) == 1
    (tmp_path / "bad.zip").write_bytes(writers.archive_bytes({"../up": b"1"}))
    assert main(["unpack", f"{tmp_path}/bad.zip", f"file://{tmp_path}/no"], spark) == 1 and not (tmp_path / "up").exists()


MEMBERS = jobs.Members(("r.md",), ("es.md",), ("g.xlsx",), "net.cypher", "prompt.md", "stored.json")


def held_archive(**more):
    stored = {"format_version": 1, "model": "m", "created_at": "", "updated_at": "", "failures": {}, "summaries": {" Risk": {"summary": "first"}, "risk": {"summary": " second\n"}}}
    node = '// NODE {"id":"risk","label":"Risk","count":2}\n// EDGE {"source":"a","target":"risk","weight":1,"statements":["A1"],"evidence":[]}\n'
    members = {"r.md": REPORT, "es.md": SUMMARY, "net.cypher": node, "prompt.md": "Say {term}.\nNow.", "stored.json": json.dumps(stored), "extra": "x"} | more
    files = {k: v.encode() for k, v in members.items() if v is not None}
    return writers.archive_bytes(files | {"g.xlsx": writers.xlsx_bytes(["Term", "Explanation", "Source"], [[x, f"about {x}", "S"] for x in TERMS])})


def test_assets_of_an_archive(spark, tmp_path):
    (tmp_path / "a.enc").write_bytes(writers.sealed_bytes(spark, held_archive(), KEY))
    found = jobs.load_assets(spark, f"{tmp_path}/a.enc", MEMBERS, KEY, ("S",))
    assert [tuple(r) for r in found.summaries.collect()] == [("risk", "second")] and found.prompt == "Say {term}.\nNow."
    assert [tuple(r) for r in found.nodes.collect()] == [("risk", "Risk", 2)] and [r["weight"] for r in found.edges.collect()] == [1]
    rows = found.corpus.overview(found.summaries).orderBy("place").collect()
    assert [(r["term"], r["n"]) for r in rows] == [("adaptation", 2), ("climate risk", 4), ("confidence", 1), ("co₂", 1), ("risk", 8), ("urban area", 1)]
    found.close()


def test_assets_that_lack_members(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(held_archive(**{"stored.json": None}))
    found = jobs.load_assets(spark, f"{tmp_path}/a.zip", MEMBERS)
    assert found.summaries.count() == 0
    found.close()
    (tmp_path / "b.zip").write_bytes(held_archive(**{"prompt.md": None, "es.md": None}))
    with pytest.raises(ValueError, match="lacks es.md, prompt.md"):
        jobs.load_assets(spark, f"{tmp_path}/b.zip", MEMBERS)
    broken = spark.createDataFrame([("x", bytearray(b"\xff"))], "name string, content binary")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        readers.member_texts(broken, ("x",)).collect()


@pytest.mark.parametrize("entry", [{"": {"summary": "x"}}, {"a": {"summary": " \n"}}, {"a": {}}])
def test_stored_summaries_without_text(spark, entry):
    text = json.dumps({"format_version": 1, "summaries": entry})
    with pytest.raises(Exception, match="no key or no text"):
        readers.stored_summaries(spark.createDataFrame([(text,)], "value string")).collect()
