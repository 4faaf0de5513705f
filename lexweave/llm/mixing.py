"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys. Each source is range-sorted by them in key ranges, distributed prefix sums of the word counts
tell how many words stand before a key, and every source is cut at its exact budget; a budget above the source's size begins
another epoch of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm._common import bins_for, discard, quoted, running_in_bins, stored

KEY_BITS = 60
WORDS = r"[^\x20\x09-\x0D]+"


def random_key(id_col: str, text_col: str, seed: str) -> Column:
    """60 bits of a hash of the id, or of the text of a row without an id: the same on every run, in no relation to the id's
    order."""
    of = F.coalesce(quoted(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(quoted(text_col).cast("string")), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), of)), 1, 15), 16, 10).cast("long")


@dataclass
class Mix:
    """sized: a row for each document (source, key, size; stored). cuts: a row for each source, with its size, its target, the
    whole epochs it gives, the key at which the last epoch ends and how many words of that key's documents it still takes."""

    sized: DataFrame
    cuts: DataFrame
    id_col: str
    text_col: str
    source_col: str
    seed: str

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken (words, repeats counted) of each document."""
        part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), self._at_cut(F.col("size"))).otherwise(F.lit(0))
        held = self.sized.join(self.cuts, self.sized["source"].eqNullSafe(self.cuts["of"]))
        return held.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))

    @staticmethod
    def _at_cut(size: Column) -> Column:
        # documents that share the key at the cut (repeated rows) share what is left in proportion
        return F.when(F.col("cut_size") > 0, F.floor(F.col("cut_words") * size / F.col("cut_size"))).otherwise(F.lit(0))

    def documents(self, df: DataFrame) -> DataFrame:
        """df with each document as often as the mix begins it, in df's columns. Texts do not move: a row needs only the cuts of
        its source."""
        own = df.withColumns({"__key": random_key(self.id_col, self.text_col, self.seed), "__source": quoted(self.source_col).cast("string")})
        cuts = self.cuts.select(*[F.col(c).alias(f"__{c}") for c in self.cuts.columns])  # df may have columns of these names
        in_last = (F.col("__key") < F.col("__cut_key")) | ((F.col("__key") == F.col("__cut_key")) & (F.col("__cut_words") > 0))
        held = own.join(cuts, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__copies", (F.col("__epochs") + F.when(in_last, 1).otherwise(0)).cast("int")).filter("__copies > 0")
        return held.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[quoted(c) for c in df.columns])


def plan_mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> Mix:
    """The mix of df: sources by code point, null last, weigh what weights says, over and over; together they give share times
    all words; no target exceeds most times its source's words, and what is above is shared again by weight.

    A null text has no words. Sources without words have target 0. Repeated rows count each. An empty df mixes to nothing."""
    sized = stored(df.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"), random_key(id_col, text_col, seed).alias("key"), F.coalesce(F.regexp_count(quoted(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    ranges = sized.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(F.col("source").asc_nulls_last())
    # stored, so that a range keeps its number whatever happens later
    sources = stored(ranges.withColumn("bin", F.spark_partition_id()), "mix-sources")
    placed = running_in_bins(sources, [], "bin", [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    # one more column of each source's row: its weight
    weighed = stored(placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))), "mix-weights")
    level = _water_level(weighed, share, most)
    capped = F.col("source_size") * F.lit(most) <= F.lit(level) * F.col("weight")
    target = F.when(capped, F.col("source_size") * F.lit(most)).otherwise(F.lit(level) * F.col("weight"))
    targets = weighed.select("source", "source_size", target.alias("target")).withColumn("words", F.floor("target")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    cuts = stored(_cut(sized, targets), "mix-cuts")
    discard(sources, weighed)
    return Mix(sized, cuts, id_col, text_col, source_col, seed)


def _water_level(sources: DataFrame, share: float, most: float) -> float:
    """Words for each unit of weight, so that all targets, each at most `most` times its source, make `share` of all words.
    Three sums come to the driver in each round, and a round caps every source that is above."""
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("source_size") * F.lit(most) <= F.lit(level) * F.col("weight")
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if not r["weight"] or r["n"] == capped:
            return level or 0.0
        level, capped = (share * r["all"] - most * (r["full"] or 0)) / r["weight"], r["n"]


def _cut(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with the key at which the words before it first do not exceed the rest of each source. Rows of one key are
    summed before they move, so a key that many rows share is one row here."""
    bits = bins_for(sized.count()).bit_length() - 1
    ranged = sized.groupBy("source", "key").agg(F.sum("size").alias("here")).withColumn("bin", F.shiftright("key", KEY_BITS - bits))
    by_key = Window.partitionBy("source", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("source", "bin", "key", F.coalesce(F.sum("here").over(by_key), F.lit(0)).alias("in_bin"), "here")
    totals = ranged.groupBy("source", "bin").agg(F.sum("here").alias("n"))
    before = totals.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    prefix = inside.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).select("source", "key", "here", (F.col("below") + F.col("in_bin")).alias("words_before"))
    of = targets.select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest")
    at = prefix.join(of, prefix["source"].eqNullSafe(of["of"])).filter(F.col("words_before") <= F.col("rest"))
    last = F.max_by(F.struct("key", "words_before", "here"), "key")
    found = at.groupBy("of", "source_size", "target", "epochs", "rest").agg(last.alias("c"))
    return found.select("of", "source_size", "target", "epochs", F.col("c.key").alias("cut_key"), (F.col("rest") - F.col("c.words_before")).alias("cut_words"), F.col("c.here").alias("cut_size"))
