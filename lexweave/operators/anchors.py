"""Anchors of statements and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators.ordinals import numbered
from lexweave.sources import store


def statement_units(stated: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """doc, origin, section_rank, pos, statement, statement_text: what an anchor can stand for, report before summaries."""
    out = stated.select("doc", F.lit(0).alias("origin"), "section_rank", "pos", "statement", "statement_text")
    if items is not None:
        out = out.unionByName(items.select("doc", F.lit(1).alias("origin"), F.lit(0).alias("section_rank"), "pos", "statement", "statement_text"))
    return out


def statement_anchors(units: DataFrame, per: tuple[str, ...] = ("doc",)) -> DataFrame:
    """number_key, text_key, anchor: source-statement-N in the order of first appearance, numbered within each of per, or over
    the whole corpus."""
    keyed = units.withColumn("k", t.statement_key(F.col("statement"), F.col("statement_text")))
    first = keyed.groupBy(*per, "k").agg(F.min(F.struct("origin", "section_rank", "pos")).alias("at"))
    placed = numbered(first, [F.col("at"), F.col("k")], per)
    return placed.select(*per, "k.number_key", "k.text_key", F.concat(F.lit("source-statement-"), "place").alias("anchor"))


def source_attributes(units: DataFrame, anchors: DataFrame, per: tuple[str, ...] = ("doc",)) -> DataFrame:
    """The units with their HTML attributes: the id goes to the first rendering of a key, later ones have none."""
    keyed = units.withColumn("k", t.statement_key(F.col("statement"), F.col("statement_text"))).select("*", "k.number_key", "k.text_key").drop("k")
    held = keyed.join(anchors, [*per, "number_key", "text_key"], "left")
    turn = F.row_number().over(Window.partitionBy(*per, "number_key", "text_key").orderBy("origin", "section_rank", "pos"))
    return held.withColumn("attributes", F.when((turn == 1) & F.col("anchor").isNotNull(), F.concat(F.lit(' id="'), t.escaped(F.col("anchor")), F.lit('" class="statement-target"'))).otherwise(F.lit("")))


def linked_statement(occurrences: DataFrame, anchors: DataFrame, per: tuple[str, ...] = ("doc",)) -> DataFrame:
    """The occurrences with `label`, their statement as a link to its source where that has an anchor."""
    keyed = occurrences.withColumn("k", t.statement_key(F.col("statement"), F.col("statement_text"))).select("*", "k.number_key", "k.text_key").drop("k")
    held = keyed.join(anchors, [*per, "number_key", "text_key"], "left")
    plain = t.escaped(F.col("statement"))
    return held.withColumn("label", F.when(F.col("anchor").isNull(), plain).otherwise(F.concat(F.lit('<a class="statement-link" href="#'), t.escaped(F.col("anchor")), F.lit('">'), plain, F.lit("</a>")))).drop("number_key", "text_key")


def statement_targets(occurrences: DataFrame, target: str, order: tuple[str, ...]) -> DataFrame:
    """number_key and the target of the last occurrence of that statement."""
    return occurrences.groupBy(t.folded(t.collapsed(F.col("statement"))).alias("number_key")).agg(F.max_by(target, F.struct(*order)).alias(target))


def term_anchors(terms: DataFrame) -> DataFrame:
    """term_key, anchor: unique ids in the order of the keys. A term gets its base, or the base with the first number from 2 on that no
    term before it has, so a numbered id may itself be the plain id of another term. terms: term_key, each once.

    An id can be claimed by the terms of two bases only: its own, as number 1, and that without its last number. Who is first follows
    from how many terms come before, so the bases that may lose their plain id to another one are settled together in rounds, until
    none changes. At least the lowest unsettled number of each base is settled by a round. Numbers are places in ranges of the order:
    the terms of one base, however many, are no one task's work."""
    based = terms.select("term_key", t.term_anchor(F.col("term_key")).alias("base"))
    placed = store.stored(numbered(based, [F.col("term_key")], ("base",), "turn"), "terms")
    tail = r"^(.+)-([2-9]|[1-9][0-9]{1,17})$"
    firsts = placed.filter("turn = 1").select(F.col("base").alias("child"), "term_key", F.regexp_extract("base", tail, 1).alias("parent"), F.expr(f"try_cast(regexp_extract(base, r'{tail}', 2) AS long)").alias("n"))
    rivals = store.stored(firsts.filter("n IS NOT NULL").join(placed.filter("turn = 1").select(F.col("base").alias("parent")), "parent", "left_semi"), "rivals")
    slots = placed.select("base", "term_key", F.col("turn").alias("slot"))
    if rivals.take(1):
        slots = _slots(placed, rivals)
    return slots.select("term_key", F.when(F.col("slot") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "slot")).alias("anchor"))


def _slots(placed: DataFrame, rivals: DataFrame) -> DataFrame:
    """base, term_key, slot: the numbers of terms (base, term_key, turn) where rivals (parent, child, n, term_key: the first term of a
    child) may have taken some."""
    both = placed.join(rivals.select(F.col("parent").alias("base")).distinct(), "base", "left_semi").select("base", "term_key", F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("n"))
    both = numbered(both.unionByName(rivals.select(F.col("parent").alias("base"), "term_key", "child", "n")), [F.col("term_key")], ("base",))
    marks = both.filter("child IS NOT NULL").select(F.col("base").alias("parent"), "child", "n", (F.col("place") - F.row_number().over(Window.partitionBy("base").orderBy("term_key"))).alias("before"))
    # a child keeps its plain id (held) if its first term comes before the term of the parent that would get to it
    settled = store.stored(marks.withColumn("held", F.lit(True)).withColumn("changed", F.lit(True)), "settled")
    while settled.filter("changed").take(1):
        lost = settled.filter("NOT held").select(F.col("child").alias("parent"), F.lit(1).alias("lost"))
        passed = F.coalesce(F.sum(F.col("held").cast("long")).over(Window.partitionBy("parent").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("lost", F.lit(0))
        told = settled.join(lost, "parent", "left").withColumn("now", passed < F.col("n") - F.col("before"))
        settled = store.stored(told.select("parent", "child", "n", "before", F.col("now").alias("held"), (F.col("now") != F.col("held")).alias("changed")), "settled")
    taken = settled.filter("held").select(F.col("parent").alias("base"), "n").unionByName(settled.filter("NOT held").select(F.col("child").alias("base"), F.lit(1).cast("long").alias("n")))
    # the k-th term takes the k-th number that is not taken, which is its place among terms and taken numbers, each of these before the
    # term that meets it
    turn = F.row_number().over(Window.partitionBy("base").orderBy("n"))
    met = taken.select("base", F.lit(None).cast("string").alias("term_key"), (F.col("n") - turn + 1).alias("turn"))
    whole = placed.select("base", "term_key", F.col("turn").cast("long").alias("turn")).unionByName(met)
    return numbered(whole, [F.col("turn"), F.col("term_key").isNotNull()], ("base",), "slot").filter("term_key IS NOT NULL").select("base", "term_key", "slot")
