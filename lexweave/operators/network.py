"""Networks: terms that stand in one sentence, and findings with what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators import matching
from lexweave.operators.documents import CORPUS_ORDER
from lexweave.operators.ordinals import numbered


def nodes(terms: DataFrame, usage: DataFrame) -> DataFrame:
    """id, label, count of the terms in use. Their counts see the assessment markup that edges do not. terms: term_key, term."""
    return terms.join(usage.filter("n > 0"), "term_key").select(F.col("term_key").alias("id"), F.col("term").alias("label"), F.col("n").alias("count"))


def term_pairs(sentences: DataFrame, active: DataFrame) -> DataFrame:
    """The sentences with each pair source < target of active terms in them, assessment markup left out. The pairs of a sentence
    come from its own sorted array of terms; nothing is joined with itself."""
    clean = sentences.withColumn("__folded", t.folded(F.regexp_replace("sentence", t.ASSESSMENT, ""))).withColumn("__at", F.struct(*CORPUS_ORDER))
    found = matching.containing(clean, active.select("term_key"), "__folded")
    per = found.groupBy("__at", "statement", "sentence").agg(F.sort_array(F.collect_set("term_key")).alias("ts")).filter("size(ts) > 1")
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter(F.col("ts"), lambda b: a < b), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return per.select("__at", "statement", "sentence", F.inline(pairs))


def edge_weights(sentences: DataFrame, active: DataFrame) -> DataFrame:
    """source, target, weight: the edges, summed before they are shuffled. Filters and ranges need no more, and a pair that a
    third of all sentences holds is one row here."""
    return term_pairs(sentences, active).groupBy("source", "target").agg(F.count("*").alias("weight"))


def edge_counts(sentences: DataFrame, active: DataFrame) -> DataFrame:
    """source, target, weight, statements (how many distinct ones) of each edge, from one pass over the sentences."""
    of_statement = term_pairs(sentences, active).groupBy("source", "target", "statement").agg(F.count("*").alias("n"))
    return of_statement.groupBy("source", "target").agg(F.sum("n").alias("weight"), F.count("*").alias("statements"))


def edge_statements(sentences: DataFrame, active: DataFrame) -> DataFrame:
    """source, target, statement: the distinct statements of each edge, a row each."""
    return term_pairs(sentences, active).select("source", "target", "statement").distinct()


def edge_evidence(sentences: DataFrame, active: DataFrame) -> DataFrame:
    """source, target, the corpus order, statement, sentence: the evidence of each edge, a row each."""
    return term_pairs(sentences, active).select("source", "target", "__at.*", "statement", "sentence")


def edges(sentences: DataFrame, active: DataFrame) -> DataFrame:
    """source, target, weight, statements (sorted), evidence (statement, sentence) in corpus order: an edge as one row, as a
    network file holds it in one line. Where no file is written, the tables above hold the same without gathering it."""
    pairs = term_pairs(sentences, active)
    evidence = F.array_sort(F.collect_list(F.struct("__at", "statement", "sentence")))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"), F.sort_array(F.collect_set("statement")).alias("statements"), F.transform(evidence, lambda e: F.struct(e["statement"].alias("statement"), e["sentence"].alias("sentence"))).alias("evidence"))


def ranges(nodes_: DataFrame, edges_: DataFrame, start: int = 5) -> DataFrame:
    """lowest, default_low, highest of counts and of weights: where the filters begin."""
    def of(df: DataFrame, c: str, what: str) -> DataFrame:
        return df.agg(F.min(c).alias("lowest"), F.max(c).alias("highest")).select(F.lit(what).alias("of"), "lowest", F.greatest("lowest", F.least(F.lit(start), "highest")).alias("default_low"), "highest")

    return of(nodes_, "count", "count").unionByName(of(edges_, "weight", "weight"))


def filtered(nodes_: DataFrame, edges_: DataFrame, counts: tuple[int, int], weights: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges in the range of weights between nodes in the range of counts, and the nodes that still have one."""
    inside = nodes_.filter(F.col("count").between(*counts))
    held = edges_ if weights is None else edges_.filter(F.col("weight").between(*weights))
    ids = inside.select("id")
    held = held.join(ids, held["source"] == ids["id"], "left_semi").join(ids, held["target"] == ids["id"], "left_semi")
    ends = held.select(F.col("source").alias("id")).union(held.select(F.col("target").alias("id"))).distinct()
    return inside.join(ends, "id", "left_semi"), held


def numbers(c: Column) -> Column:
    """1.10 as whole numbers, which sort behind those of 1.2."""
    return F.transform(F.split(c, r"\."), lambda p: p.cast("int"))


def sankey_nodes(links: DataFrame, prefix: str = "") -> DataFrame:
    """node_index, label, side (0 finding, 1 reference), x: findings in natural order, then references in theirs."""
    own = links.filter(F.col("statement").startswith(prefix))
    left = own.select(F.col("statement").alias("label")).distinct().select(F.lit(0).alias("side"), "label", F.substring("label", 1, 1).alias("letter"), numbers(F.expr("substring(label, 2)")).alias("parts"))
    right = own.select(F.col("reference").alias("label")).distinct().select(F.lit(1).alias("side"), "label", F.lit("").alias("letter"), numbers(F.col("label")).alias("parts"))
    order = [F.col(c) for c in ("side", "letter", "parts", "label")]
    return numbered(left.unionByName(right), order).select((F.col("place") - 1).alias("node_index"), "label", "side", F.when(F.col("side") == 0, 0.02).otherwise(0.98).alias("x"))


def sankey_links(links: DataFrame, prefix: str = "") -> DataFrame:
    """source, target (node indices), value for each citation."""
    at = sankey_nodes(links, prefix)
    own = links.filter(F.col("statement").startswith(prefix))
    a, b = (at.filter(F.col("side") == s).select(F.col("label").alias(n), F.col("node_index").alias(i)) for s, n, i in ((0, "statement", "source"), (1, "reference", "target")))
    return own.join(a, "statement").join(b, "reference").select("source", "target", F.lit(1).alias("value"))


def _head_and_nodes(nodes_: DataFrame, title: str) -> DataFrame:
    q = t.json_text
    node = F.concat_ws("\n", F.concat(F.lit("// NODE "), F.to_json(F.struct("id", "label", "count"))), F.concat(F.lit("MERGE (term:GlossaryTerm {id: "), q(F.col("id")), F.lit("})")), F.concat(F.lit("SET term.label = "), q(F.col("label")), F.lit(", term.count = "), F.col("count"), F.lit(";")), F.lit(""))
    head = nodes_.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit(f"// {title}\n").alias("text"))
    return head.unionByName(nodes_.select(F.lit(1).alias("kind"), t.folded(F.col("label")).alias("a"), F.col("id").alias("b"), node.alias("text")))


def cypher_lines(nodes_: DataFrame, edges_: DataFrame, title: str = "Term co-occurrence network.") -> DataFrame:
    """kind, sort keys and text of the statements that rebuild the network; comment lines carry each element as JSON."""
    q = t.json_text
    named = lambda what, c: F.concat(F.lit(f"({what}:GlossaryTerm {{id: "), q(F.col(c)), F.lit("})"))
    edge = F.concat_ws(
        "\n",
        F.concat(F.lit("// EDGE "), F.to_json(F.struct("source", "target", "weight", "statements", "evidence"))),
        F.concat(F.lit("MATCH "), named("source", "source"), F.lit(", "), named("target", "target")),
        F.lit("MERGE (source)-[connection:CO_OCCURS]->(target)"),
        F.concat(F.lit("SET connection.weight = "), F.col("weight"), F.lit(", connection.statements = "), F.to_json("statements"), F.lit(", connection.evidence = "), q(F.to_json("evidence")), F.lit(";")),
        F.lit(""),
    )
    es = edges_.select(F.lit(2).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), edge.alias("text"))
    return _head_and_nodes(nodes_, title).unionByName(es)


def cypher_fragments(nodes_: DataFrame, pairs: DataFrame, title: str = "Term co-occurrence network.") -> DataFrame:
    """kind, a, b, part, at, key, item (whether the text is one of a list, which a comma parts from the one before) and text: what the
    lines of `cypher_lines` are made of, in the order of kind, a, b, part, at, key. An edge's statements and its evidence (from the rows of
    `term_pairs`) stand in rows of their own, so no row grows with the number of sentences that hold a pair."""
    nowhere = F.lit(None).cast(pairs.schema["__at"].dataType)

    def fragment(df: DataFrame, part: int, text: Column, at: Column = nowhere, key: Column | None = None) -> DataFrame:
        order = F.lit(None).cast("string") if key is None else key
        return df.select(F.lit(2).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(part).alias("part"), at.alias("at"), order.alias("key"), F.lit(key is not None).alias("item"), text.alias("text"))

    def element(c: Column) -> Column:
        told = F.to_json(F.array(c))
        return F.substring(told, F.lit(2), F.length(told) - 2)

    def inside(c: Column) -> Column:
        told = t.json_text(c)
        return F.substring(told, F.lit(2), F.length(told) - 2)

    weights = pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))
    said = pairs.select("source", "target", "statement").distinct().filter("statement IS NOT NULL")
    head = F.to_json(F.struct("source", "target", "weight"))
    named = lambda what, c: F.concat(F.lit(f"({what}:GlossaryTerm {{id: "), t.json_text(F.col(c)), F.lit("})"))
    match = F.concat(F.lit("]}\nMATCH "), named("source", "source"), F.lit(", "), named("target", "target"), F.lit("\nMERGE (source)-[connection:CO_OCCURS]->(target)\nSET connection.weight = "), F.col("weight"), F.lit(", connection.statements = ["))
    evidence = element(F.struct("statement", "sentence"))
    whole = _head_and_nodes(nodes_, title).select("kind", "a", "b", F.lit(0).alias("part"), nowhere.alias("at"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("item"), F.concat("text", F.lit("\n")).alias("text"))
    rows = [
        fragment(weights.withColumn("h", head), 0, F.concat(F.lit("// EDGE "), F.expr("left(h, length(h) - 1)"), F.lit(',"statements":['))),
        fragment(said, 1, element(F.col("statement")), key=F.col("statement")),
        fragment(weights, 2, F.lit('],"evidence":[')),
        fragment(pairs, 3, evidence, F.col("__at"), F.col("sentence")),
        fragment(weights, 4, match),
        fragment(said, 5, element(F.col("statement")), key=F.col("statement")),
        fragment(weights, 6, F.lit('], connection.evidence = "[')),
        fragment(pairs, 7, inside(evidence), F.col("__at"), F.col("sentence")),
        fragment(weights, 8, F.lit(']";\n\n')),
    ]
    for df in rows:
        whole = whole.unionByName(df)
    return whole


NODE_SCHEMA = "id string, label string, count long"
EDGE_SCHEMA = "source string, target string, weight long, statements array<string>, evidence array<struct<statement:string,sentence:string>>"


def parse_cypher(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that the comment lines of a network file carry. lines: value."""
    def of(mark: str, schema: str) -> DataFrame:
        found = lines.filter(F.col("value").startswith(mark))
        return found.select(F.from_json(F.expr(f"substring(value, {len(mark) + 1})"), schema).alias("e")).select("e.*")

    return of("// NODE ", NODE_SCHEMA), of("// EDGE ", EDGE_SCHEMA)
