"""Numbers in the order of a whole corpus, and running states of long groups, without a task that sees all of either."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.sources import store

#: Places of one group that a task scans at a time.
BLOCK = 1 << 16


def numbered(df: DataFrame, order: list[Column], per: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in the given order, within each of per or over all rows.

    Rows go to ranges of the order, are numbered within their range, and raised by the counts of the ranges before: of these a row for
    each range moves. Ranges are stored, as another run might draw their bounds elsewhere. Rows of equal order stand in one range, in no
    certain order; a null sorts first. The numbers do not depend on how many ranges there are."""
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    whole = df.withColumns(keys)
    ranged = store.stored(whole.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*per, *keys)]).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*per, "__range").agg(F.count("*").alias("__n"))
    if per:
        before = F.sum("__n").over(Window.partitionBy(*per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(per)], F.col("__range").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    else:
        at, told = 0, []
        for r in sorted(counts.collect(), key=lambda r: r["__range"]):  # a row for each range
            told.append((r["__range"], at))
            at += r["__n"]
        starts = df.sparkSession.createDataFrame(told, "__of int, __before long")
    inside = F.row_number().over(Window.partitionBy(*per, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in keys]))
    same = F.col("__range") == F.col("__of")
    for i, c in enumerate(per):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    held = ranged.withColumn("__inside", inside).join(starts, same)
    return held.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))


def running(df: DataFrame, last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, total: dict[str, Column] | None = None, before: bool = False, by: str = "doc", at: str = "pos") -> DataFrame:
    """df with the running state of each of its groups, in the order of at: the last and the first value that is not null and the sum of
    values, up to a row and with it, or before=True up to the row ahead of it. Null where there is none yet.

    A group is scanned in blocks of BLOCK places, each by itself. What the blocks before have left is one row a block, put at the block's
    head, so the work of a long group is spread over tasks and the rows themselves move once. at counts from 0 (a row without a place
    stands at the head, as do negative ones); rows of equal place stand in no certain order. df is read twice, the second time for the
    states alone: store it first where that is dear."""
    last, first, total = last or {}, first or {}, total or {}
    names = [*last, *first, *total]
    marks = [f"__m{i}" for i in range(len(names))]
    lasts, firsts, totals = marks[: len(last)], marks[len(last) : len(last) + len(first)], marks[len(last) + len(first) :]
    values = [*last.values(), *first.values(), *(c.cast("long") for c in total.values())]
    block = F.greatest(F.coalesce(F.expr(f"`{at}` div {BLOCK}"), F.lit(0)), F.lit(0))
    held = df.withColumns(dict(zip(marks, values, strict=True)) | {"__block": block, "__carried": F.lit(False)})

    told = functools.reduce(operator.or_, [F.col(m).isNotNull() for m in marks])
    placed = {m: F.when(F.col(m).isNotNull(), F.struct(at, m)) for m in marks}
    left = held.filter(told | (F.col("__block") > 0)).groupBy(by, "__block").agg(
        *[F.max(placed[m])[m].alias(m) for m in lasts], *[F.min(placed[m])[m].alias(m) for m in firsts], *[F.sum(m).alias(m) for m in totals]
    )
    ahead = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = left.select(by, "__block", F.lit(True).alias("__carried"), *[c.alias(m) for m, c in _states(lasts, firsts, totals, ahead).items()]).filter("__block > 0")

    within = Window.partitionBy(by, "__block").orderBy(F.col("__carried").desc(), at).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    states = _states(lasts, firsts, totals, within)
    scanned = held.unionByName(heads, allowMissingColumns=True).withColumns({f"__s{m}": c for m, c in states.items()}).filter("NOT __carried")
    return scanned.select(*[c for c in df.columns if c not in names], *[F.col(f"__s{m}").alias(n) for m, n in zip(marks, names, strict=True)])


def _states(lasts: list[str], firsts: list[str], totals: list[str], over: object) -> dict[str, Column]:
    return {m: F.last(m, True).over(over) for m in lasts} | {m: F.first(m, True).over(over) for m in firsts} | {m: F.sum(m).over(over) for m in totals}
