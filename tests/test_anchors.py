"""Unique anchors against the one-by-one rule, and network lines written in pieces."""

import random

from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators import anchors, network
from lexweave.sources import fragments, readers


def one_by_one(based):
    taken, out = set(), {}
    for key, base in sorted(based):
        anchor, n = base, 1
        while anchor in taken:
            n += 1
            anchor = f"{base}-{n}"
        taken.add(anchor)
        out[key] = anchor
    return out


def test_random_stems(spark):
    """400 small glossaries, told apart by their stems, in one table."""
    draw = random.Random(5)
    keys = set()
    for stem in range(400):
        top = draw.choice((3, 5, 12))
        for _ in range(draw.randrange(1, 40)):
            numbers = "".join(f" {draw.randrange(0, top)}" for _ in range(draw.choice((0, 0, 1, 1, 1, 2, 3))))
            keys.add(draw.choice(("", "", "!", "(", "¡")) + f"s{stem}x" + numbers + "!" * draw.randrange(3))
    df = spark.createDataFrame([(k,) for k in keys], "term_key string")
    based = [tuple(r) for r in df.select("term_key", t.term_anchor(F.col("term_key"))).collect()]
    found = {r["term_key"]: r["anchor"] for r in anchors.term_anchors(df).collect()}
    assert len(found) == len(keys) == len(set(found.values())) and found == one_by_one(based)


def test_one_stem_of_many_terms(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("a"), F.translate(F.format_string("%016d", F.col("id")), "0123456789", "!#%&()*,.;"))).otherwise(F.concat(F.lit("a "), F.expr("id div 2"))).alias("term_key"))
    based = [tuple(r) for r in df.select("term_key", t.term_anchor(F.col("term_key"))).collect()]
    taken, out, free = set(), {}, {}
    for key, base in sorted(based):  # the rule, with a note of where each base got to
        anchor = base
        while anchor in taken:
            free[base] = free.get(base, 1) + 1
            anchor = f"{base}-{free[base]}"
        taken.add(anchor)
        out[key] = anchor
    assert {r["term_key"]: r["anchor"] for r in anchors.term_anchors(df).collect()} == out
    assert anchors.term_anchors(df.limit(0)).count() == 0


def test_lines_in_pieces(spark, tmp_path):
    """One pair in a third of all sentences; texts that need escapes; the file is what whole lines give."""
    at = "struct<origin:int,section_rank:int,doc:string,pos:long,sp:int>"
    rows = [((0, 0, "d", i, 0), f"A{i % 7}" if i % 11 else None, f'say "{i}" \\ , [é]\n', "a", "b") for i in range(500)] + [((0, 0, "d", i, 0), "B", "x", f"p{i % 40}", "q") for i in range(1000)]
    pairs = spark.createDataFrame(rows, f"__at {at}, statement string, sentence string, source string, target string")
    nodes = spark.createDataFrame([("a", 'A "x"', 3), ("b", "B", 2)], "id string, label string, count long")
    evidence = F.array_sort(F.collect_list(F.struct("__at", "statement", "sentence")))
    edges = pairs.groupBy("source", "target").agg(F.count("*").alias("weight"), F.sort_array(F.collect_set("statement")).alias("statements"), F.transform(evidence, lambda e: F.struct(e["statement"].alias("statement"), e["sentence"].alias("sentence"))).alias("evidence"))
    want = "".join(r["text"] + "\n" for r in network.cypher_lines(nodes, edges).orderBy("kind", "a", "b").collect())
    for _ in range(2):  # the second time over the first
        fragments.write_fragments(network.cypher_fragments(nodes, pairs), f"{tmp_path}/net", ("kind", "a", "b"), ("part", "at", "key"))
        files = sorted(p for p in (tmp_path / "net").iterdir() if not p.name.startswith("."))
        assert "".join(p.read_text() for p in files) == want
    n2, e2 = readers.read_network(spark, f"file://{tmp_path}/net")
    assert n2.count() == 2 and sorted(map(str, e2.select(*edges.columns).collect())) == sorted(map(str, edges.collect()))
