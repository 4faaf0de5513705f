"""Terms against sentences, by three matchers that differ at the edges and are kept apart.

counts: every term for itself, folded, no word character beside it, a sentence counts once. occurrences: the display form
without regard to case, a row for each sentence. links: one alternation, longest first, see functions.markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t

#: More terms than this are matched by their first words instead of each against each sentence.
CONSTANT_TERMS = 64
#: A first word that many sentences hold is dealt over so many tasks.
SALTS = 16


def containing(sentences: DataFrame, terms: DataFrame, text: str = "folded", key: str = "term_key", constant_terms: int = CONSTANT_TERMS) -> DataFrame:
    """The sentences with each term of terms they contain, both folded. A blank term stands nowhere.

    Few terms (their count is checked) become constants of the plan: one pass over the sentences, no join with them, and every
    pattern is compiled once. For many, `by_first_words` joins on what a term begins with."""
    terms = terms.filter(t.stripped(F.col(key)) != "")
    few = [r[0] for r in terms.select(key).distinct().limit(constant_terms + 1).collect()]
    return _constant(sentences, few, terms, text, key) if len(few) <= constant_terms else by_first_words(sentences, terms, text, key)


def _constant(sentences: DataFrame, keys: list[str], terms: DataFrame, text: str, key: str) -> DataFrame:
    found = [F.when(t.has_constant(F.col(text), k), F.lit(k)) for k in sorted(keys)]
    inside = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    held = sentences.withColumn(key, F.explode(inside))
    return held if terms.columns == [key] else held.join(terms, key)


#: A character that makes no word and is not blank.
ODD = f"[^{t.W[1:-1]}{t.WS[1:-1]}]"


def _tokens(text: Column) -> Column:
    """The words of a text, and behind them its characters that make no word."""
    return F.concat(F.regexp_extract_all(text, F.lit(f"({t.W}+)"), 1), F.regexp_extract_all(text, F.lit(f"({ODD})"), 1))


def by_first_words(sentences: DataFrame, terms: DataFrame, text: str = "folded", key: str = "term_key") -> DataFrame:
    """`containing` for any number of terms. A term can only stand where its first two words do in a row (its one word, or the
    first character of a term without words), so beginnings of sentences and terms are joined, and only then is a term looked
    for.

    Only a hash of the sentence goes with its tokens, and only tokens that begin a term go on; the sentences move once, to meet
    the terms that may stand in them. Sentences that share a hash share their candidates, which are looked for in each. A
    beginning that a third of all sentences hold is dealt over SALTS tasks, and further by adaptive execution."""
    worded = F.regexp_extract_all(F.col("__term"), F.lit(f"({t.W}+)"), 1)
    odd = F.regexp_extract("__term", f"({ODD})", 1)
    wanted = terms.select(F.col(key).alias("__term")).distinct().withColumn("__words", worded)
    wanted = wanted.select("__term", F.when(F.size("__words") > 0, F.get("__words", F.lit(0))).otherwise(odd).alias("__first"), F.array_join(F.slice("__words", 1, 2), " ").alias("__pair"))
    wanted = wanted.select("__term", "__first", F.coalesce(F.nullif("__pair", F.lit("")), "__first").alias("__begin")).filter("__first <> ''")
    hashed = sentences.withColumn("__hash", F.xxhash64(text))
    tokens = hashed.select("__hash", _tokens(F.col(text)).alias("__first")).withColumn("__next", F.slice("__first", F.lit(2), F.size("__first")))
    begun = tokens.select("__hash", F.inline(F.arrays_zip("__first", "__next")))
    known = begun.join(wanted.select("__first").distinct(), "__first", "left_semi").select("__hash", F.explode(F.array("__first", F.concat_ws(" ", "__first", "__next"))).alias("__begin"))
    salted = known.withColumn("__salt", F.pmod("__hash", F.lit(SALTS)).cast("int"))
    spread = wanted.select("__term", "__begin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    candidates = salted.join(spread, ["__begin", "__salt"]).groupBy("__hash").agg(F.collect_set("__term").alias("__terms"))
    met = hashed.join(candidates, "__hash").withColumn(key, F.explode("__terms")).filter(t.matches_term(F.col(text), F.col(key))).drop("__hash", "__terms")
    return met if terms.columns == [key] else met.join(terms, key)


def usage_counts(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """term_key, n: sentences that contain each term; terms without any count 0. terms: term_key (folded)."""
    keys = terms.select("term_key").distinct()
    found = containing(sentences.select(t.folded(F.col("sentence")).alias("folded")).filter("folded <> ''"), keys).groupBy("term_key").agg(F.count("*").alias("n"))
    return keys.join(found, "term_key", "left").select("term_key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def occurrences(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """The sentences with each term (term_key, term) whose display form they contain in any case."""
    folded = sentences.withColumn("__folded", F.lower("sentence"))
    return containing(folded, terms.select("term_key", "term", F.lower("term").alias("__key")), "__folded", "__key").drop("__folded", "__key")
