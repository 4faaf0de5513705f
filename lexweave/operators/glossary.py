"""Glossaries: union of sources, one entry per folded term, labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import markup
from lexweave.functions import text as t
from lexweave.operators.ordinals import numbered
from lexweave.sources import store


def union_glossaries(*tables: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """term_key, term, explanation, parent, source, src_rank, load_pos: the rows of all tables (pos, term, explanation, source,
    parent if there is one) with term, explanation and source; equal rows once, at their first place. Sources rank as listed,
    others behind."""
    parts = []
    for i, df in enumerate(tables):
        parent = F.col("parent") if "parent" in df.columns else F.lit("")
        parts.append(df.select(F.lit(i).alias("file"), "pos", *[t.cell(c).alias(n) for n, c in (("term", F.col("term")), ("explanation", F.col("explanation")), ("parent", parent), ("source", F.col("source")))]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    whole = rows.filter("term <> '' AND explanation <> '' AND source <> ''")
    once = whole.groupBy("term", "explanation", "parent", "source").agg(F.min(F.struct("file", "pos")).alias("load_pos"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in sources]).cast("array<string>"), F.col("source")), F.lit(0)), F.lit(len(sources) + 1)) - 1
    return once.select(t.folded(F.col("term")).alias("term_key"), "term", "explanation", "parent", "source", rank.cast("int").alias("src_rank"), "load_pos")


#: Terms of one automaton.
INDEX_TERMS = 100_000


def term_index(terms: DataFrame, key: str = "term_key", label: str = "term") -> markup.TermIndex:
    """The automata over terms (folded term, display form or anchor), in files of the shared folder. Each is built by a task of its own
    out of about INDEX_TERMS terms, so no task and no driver holds a glossary of any size; a worker that links texts holds the
    automata, which it reads once. Blank terms are left out; of a term with several labels the first one by code point counts."""
    once = terms.filter(t.stripped(F.col(key)) != "").groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    folder = store.shared_folder(terms.sparkSession, "terms")
    buckets = max(1, -(-once.count() // INDEX_TERMS))

    def build(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        store.put_object(folder, f"automaton-{group[0]:06d}", markup.term_automaton(zip(rows["key"], rows["label"], strict=True)))
        return pd.DataFrame({"bucket": [group[0]], "terms": [len(rows)]})

    built = once.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(build, "bucket int, terms long")
    built.agg(F.sum("terms")).collect()
    return markup.TermIndex(folder)


DEFINITION = ("src_rank", "source", "load_pos", "term", "explanation", "parent")


def grouped(glossary: DataFrame) -> DataFrame:
    """term_key, term (display form: that of the first definition), definitions in order of source rank, source, place."""
    made = F.array_sort(F.collect_list(F.struct(*DEFINITION)))
    return glossary.groupBy("term_key").agg(made.alias("definitions")).select("term_key", F.col("definitions")[0]["term"].alias("term"), "definitions")


def source_label(definitions: Column, order: tuple[str, ...]) -> Column:
    """The known sources of a term in their fixed order, joined by +."""
    return F.array_join(F.array_intersect(F.array(*[F.lit(s) for s in order]), F.transform(definitions, lambda d: d["source"])), " + ")


def parent_label(definitions: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(definitions, lambda d: d["parent"]), lambda p: p != "")), "; ")


def definition_of(definitions: Column, source: str) -> Column:
    """All definitions of one source, or a notice."""
    own = F.transform(F.filter(definitions, lambda d: d["source"] == source), lambda d: d["explanation"])
    return F.coalesce(F.nullif(F.array_join(own, "\n\n"), F.lit("")), F.lit("Definition not available"))


def overview(terms: DataFrame, usage: DataFrame, summaries: DataFrame, search: str = "", order: tuple[str, ...] = (), excluded: tuple[str, ...] = ("confidence",)) -> DataFrame:
    """place, term_key, term, n, sources, issue: the terms in the order of their folded display form. In search, ! asks for terms
    with a potential issue, the rest for a part of the key. terms as from grouped; usage term_key, n; summaries term_key, summary."""
    held = terms.join(usage, "term_key", "left").join(summaries.select("term_key", "summary"), "term_key", "left")
    issue = ~F.col("term_key").isin(*excluded) & t.has_potential_issue(F.coalesce("summary", F.lit("")))
    rows = held.select("term_key", "term", F.coalesce("n", F.lit(0)).cast("long").alias("n"), source_label(F.col("definitions"), order).alias("sources"), issue.alias("issue"))
    wanted = search.replace("!", "").strip().lower()
    if "!" in search:
        rows = rows.filter("issue")
    if wanted:
        rows = rows.filter(F.instr("term_key", wanted) > 0)
    placed = numbered(rows, [t.folded(F.col("term")), F.col("term_key")]).withColumn("place", F.col("place").cast("int"))
    return placed.select("place", "term_key", "term", "n", "sources", "issue")


def used_share(usage: DataFrame) -> DataFrame:
    """used, total: how many terms occur at all."""
    return usage.agg(F.count_if(F.col("n") > 0).alias("used"), F.count("*").alias("total"))
